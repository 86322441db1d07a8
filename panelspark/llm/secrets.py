"""Secret scans over a trigram inverted index.

From each rule's regular expression a Boolean trigram query is derived: alternatives, each a set of
trigrams that a match must contain. Postings (trigram, text) are kept for the trigrams of the queries,
intersected by counting, and only candidate texts run the rule's expression. A rule without mandatory
trigrams runs on every text. DataFrame operations only.
"""
from __future__ import annotations

from dataclasses import dataclass
from re import _constants as op, _parser as parser

from pyspark.sql import Column, DataFrame, functions as F

from panelspark.llm.common import span_list, spans, whole
from panelspark.session import cut_lineage

BROADCAST_ROWS = 2_000_000   # more candidates than this are joined by shuffle
_MAX_STRINGS = 64            # strings followed at once while a query is derived
_MAX_CLASS = 4               # characters of a class that are spelled out
MARK = "<SECRET>"


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str             # Java syntax, also readable by Python's parser
    group: str = ""          # what must be matched by least characters, if not the whole match
    least: int = 0


# The base rules, then well-known token formats. Kinds are ranked in this order.
_VALUE = r"[A-Za-z0-9+/_.=-]+"
_ASSIGN = (r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|"
           r"[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?")
RULES = [
    Rule("assign", _ASSIGN + _VALUE, "^" + _ASSIGN, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
]

Query = frozenset  # of frozensets of trigrams: one of these sets must be present as a whole
ANY: Query = frozenset([frozenset()])


def _simpler(query) -> Query:
    """Without alternatives that another one implies."""
    query = frozenset(query)
    return frozenset(a for a in query if not any(b < a for b in query))


def _both(a: Query, b: Query) -> Query:
    if len(a) * len(b) > _MAX_STRINGS:
        return min((a, b), key=len)
    return _simpler(x | y for x in a for y in b)


def _of_strings(strings) -> Query:
    return _simpler(frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings)


def _node(kind, value):
    """(strings the node can match, or None; a query its matches imply), lower-cased."""
    if kind is op.LITERAL:
        return {chr(value).lower()}, ANY
    if kind is op.IN:
        chars: set[str] = set()
        for k, v in value:
            if k is op.LITERAL:
                chars.add(chr(v).lower())
            elif k is op.RANGE and v[1] - v[0] < 2 * _MAX_CLASS:
                chars.update(chr(c).lower() for c in range(v[0], v[1] + 1))
            else:
                return None, ANY
        return (chars, ANY) if len(chars) <= _MAX_CLASS + 1 else (None, ANY)
    if kind is op.SUBPATTERN:
        return _sequence(value[3])
    if kind is op.BRANCH:
        parts = [_sequence(p) for p in value[1]]
        if all(s is not None for s, _ in parts):
            return set().union(*[s for s, _ in parts]), ANY
        return None, _simpler(frozenset().union(*[_both(q, _of_strings(s) if s else ANY) for s, q in parts]))
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
        low, high, body = value
        strings, inner = _sequence(body)
        if (low, high) == (0, 1) and strings is not None:
            return strings | {""}, ANY
        if low == high == 1:
            return strings, inner
        return None, (_both(inner, _of_strings(strings)) if strings is not None else inner) if low else ANY
    if kind is op.AT:
        return {""}, ANY
    return None, ANY


def _sequence(nodes):
    query, now, exact = ANY, {""}, True
    for kind, value in nodes:
        strings, implied = _node(kind, value)
        query = _both(query, implied)
        joined = {a + b for a in now for b in strings} if strings is not None else None
        if joined is None or len(joined) > _MAX_STRINGS:
            query, exact = _both(query, _of_strings(now)), False
            now = strings if strings is not None else {""}
        else:
            now = joined
    return (now, query) if exact else (None, _both(query, _of_strings(now)))


def trigram_query(pattern: str) -> Query:
    """Alternatives of trigrams that every match, lower-cased, must contain; ANY if none is mandatory."""
    strings, query = _sequence(parser.parse(pattern))
    return _both(query, _of_strings(strings)) if strings is not None else query


def postings(texts: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, _t): which texts, named by hash, contain which of the trigrams."""
    low = F.transform(F.array(F.lower("text")), lambda t: F.filter(
        F.array(*[F.lit(x) for x in trigrams]), lambda x: F.contains(t, x)))[0]
    # The outer form keeps Catalyst from repeating the search in a filter below.
    return texts.select("_t", F.explode_outer(low).alias("trigram")).where("trigram is not null").distinct()


def candidates(texts: DataFrame, rules: list[Rule]) -> DataFrame:
    """(_t, rules): texts whose postings satisfy a rule's query, with the kinds of these rules."""
    terms = [(r.kind, n, t, len(alt)) for r in rules for n, alt in enumerate(sorted(map(sorted, trigram_query(r.pattern))))
             for t in alt]
    spark = texts.sparkSession
    wanted = spark.createDataFrame(terms, "kind string, alternative int, trigram string, need int")
    hits = postings(texts, sorted({t for _, _, t, _ in terms})).join(F.broadcast(wanted), "trigram")  # as long as the rules
    full = hits.groupBy("_t", "kind", "alternative", "need").agg(F.count("*").alias("k")).where("k = need")
    return full.groupBy("_t").agg(F.collect_set("kind").alias("kinds"))


def _rule_spans(text: Column, rank: int, rule: Rule) -> Column:
    found = spans(text, rule.pattern)
    if rule.least:
        found = F.filter(found, lambda s: F.length(F.regexp_replace(s["hit"], F.lit(rule.group), F.lit(""))) >= rule.least)
    return F.transform(found, lambda s: F.struct(s["start"], s["end"], F.lit(rule.kind).alias("kind"), F.lit(rank).alias("rank")))


def scan(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """Every input row and column, with spans: an array of (start, end, kind, rank), in code points.

    Defined results: a null or empty text has no spans; equal texts have equal spans, repeated rows
    stay; an input column named spans is replaced; an empty table gives an empty table.
    """
    rules = RULES if rules is None else rules
    docs = docs.drop(*[c for c in ("spans", "_t", "_kinds") if c != text])
    keyed = docs.withColumn("_t", F.xxhash64(whole(text)))
    indexed = [r for r in rules if frozenset() not in trigram_query(r.pattern)]
    names = {r.kind for r in indexed}
    if indexed:
        hits = cut_lineage(candidates(keyed.select("_t", whole(text).alias("text")), indexed).withColumnRenamed("kinds", "_kinds"))
        keyed = keyed.join(F.broadcast(hits) if hits.count() <= BROADCAST_ROWS else hits, "_t", "left")
    found = []
    for rank, rule in enumerate(rules):
        one = _rule_spans(F.col(text), rank, rule)
        if rule.kind in names:
            one = F.when(F.array_contains("_kinds", rule.kind), one)
        found.append(F.coalesce(one, F.array().cast("array<struct<start:int,end:int,kind:string,rank:int>>")))
    # A generator of one row keeps filters on the spans above the scan.
    return keyed.select(*docs.columns, F.inline(F.array(F.struct(F.concat(*found).alias("spans")))))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, SHA-256 of the base spans, all spans as text."""
    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["rank"] < 3)
    counts = [count(kind) for kind in ("assign", "access", "hex")]
    return docs.select("doc_id", *counts, F.sha2(span_list(base), 256).alias("base_sha256"),
                       span_list(F.col("spans")).alias("spans"))


def redact(text: Column, found: Column) -> Column:
    """The text with every span, overlapping ones as one, replaced by MARK."""
    ordered = F.array_sort(F.transform(found, lambda s: F.struct(s["start"], s["end"])))

    def step(acc: Column, s: Column) -> Column:
        gap = F.concat(acc["out"], text.substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit(MARK))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                        F.when(s["start"] >= acc["at"], gap).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
                       lambda acc: F.concat(acc["out"], text.substr(acc["at"] + 1, F.length(text))))
    return F.when(F.size(found) > 0, done).otherwise(text)


def redact_stage(docs: DataFrame) -> DataFrame:
    """All documents, their secrets replaced by MARK, n_chars counted anew; columns unchanged."""
    found = scan(docs.select(F.struct(*docs.columns).alias("_row"), "text"))
    found = found.select("_row", "spans", redact(F.col("text"), F.col("spans")).alias("clean"))
    changed = F.size("spans") > 0
    out = {"text": F.col("clean"),
           "n_chars": F.when(changed, F.length("clean").cast("long")).otherwise(F.col("_row.n_chars"))}
    return found.select(*[out.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])
