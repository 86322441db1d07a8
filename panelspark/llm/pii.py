"""Personal data by weak supervision: labelers vote on candidate spans, a classifier decides.

Candidates are the strict spans of four kinds (email, ip, card, phone) and looser ones: written-out
addresses, national phone numbers, digit groups of card length, IPv6. Five labelers vote for, against or
not at all on each: strict pattern, checksum or length, gazetteer, words before the span, its borders.
Votes are counted by pattern (at most 4 * 3**5 rows reach the driver, whatever the corpus). On these
counts expectation-maximisation estimates how reliable each labeler is, and its posteriors train a
logistic span classifier, which runs as a column expression. Strict spans always stay; looser spans are
added when the classifier accepts them.

DataFrame operations only; texts are searched once and never shuffled.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelspark.llm.common import span_list, spans, whole
from panelspark.session import cut_lineage

KINDS = ["email", "ip", "card", "phone"]
VOTES = ["strict", "form", "gazetteer", "context", "border"]
CONTEXT = 40             # characters before a span that the context labeler reads
ROUNDS = 60              # of expectation-maximisation
THRESHOLD = 0.5

# The strict patterns, written so that no search backtracks or restarts inside a run.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}\x20?[(\[{]\x20?at\x20?[)\]}]\x20?[a-z0-9-]{1,63}"
             r"(?:\x20?(?:\.|[(\[{]\x20?dot\x20?[)\]}])\x20?[a-z0-9-]{2,63}){1,4}",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])(?:[0-9]{4}[\x20-]){3}[0-9]{1,4}(?![0-9])|(?<![0-9])[0-9]{13,19}(?![0-9])",
    "phone": r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.][0-9]{4}(?![0-9])",
}
# Gazetteers and context words.
TOP_DOMAINS = ("com org net edu gov mil int info biz io co ai app dev me eu uk de fr es it nl be ch at pt pl se no dk fi ie "
               "us ca mx br ar cl au nz jp cn kr in za ru ua tr gr cz hu ro").split()
WORDS_FOR = {
    "email": "mail|contact|write to|reach|correo|courriel|adresse|schreib",
    "ip": r"\bip\b|host|server|address|client|login|adresse|servidor",
    "card": "card|visa|master|amex|credit|debit|payment|karte|carte|tarjeta",
    "phone": r"phone|\btel|call|mobile|cell|fax|dial|whatsapp|telef|appel|anruf|llam",
}
WORDS_AGAINST = (r"version|release|section|chapter|isbn|order|invoice|serial|item|account id|ticket|\bref\b|"
                 r"sample|placeholder|dummy|\bid[:=#\x20]*$")

_SPAN = "array<struct<start:int,end:int,kind:string,rank:int,strict:int,form:int,gazetteer:int,context:int,border:int>>"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def value(d: Column, i: Column) -> Column:
        n = d.cast("int") * (1 + i % 2)
        return F.when(n > 9, n - 9).otherwise(n)

    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda d: d != ""), value)
    return F.aggregate(each, F.lit(0), lambda total, n: total + n) % 10 == 0


def _small_parts(hit: Column) -> Column:
    """Whether all parts of a dotted address are at most 255."""
    return F.forall(F.split(hit, r"\."), lambda p: F.rlike(
        p, F.lit(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")))


def _form(kind: str, hit: Column) -> Column:
    n = F.length(_digits(hit))
    if kind == "email":
        return F.length(hit) <= 254
    if kind == "ip":
        return hit.contains(":") | _small_parts(hit)
    if kind == "card":
        return n.between(12, 19) & luhn(_digits(hit))
    return n.between(9, 15)


def _gazetteer(kind: str, hit: Column) -> Column:
    """Vote by lists: known top domains, public address ranges, card issuers, number plans."""
    if kind == "email":
        return F.when(F.lower(F.regexp_extract(hit, "([A-Za-z]+)$", 1)).isin(TOP_DOMAINS), 1).otherwise(-1)
    if kind == "ip":
        return F.when(F.rlike(hit, F.lit(r"^(?:0|10|127|169\.254|192\.168|22[4-9]|2[345][0-9])\.")), 0).otherwise(1)
    if kind == "card":
        issuer = r"^(?:4|5[1-5]|2[2-7]|3[0345678]|6[0245])"
        return F.when(F.rlike(_digits(hit), F.lit(issuer)), 1).otherwise(-1)
    return F.when(F.rlike(hit, F.lit(r"^\+(?:[17]|2[0-9]|3[0-9]|4[0-9]|5[0-9]|6[0-9]|8[0-9]|9[0-9])|^\(?[2-9][0-9]{2}")), 1).otherwise(0)


def _votes(text: Column, kind: str, strict: bool, s: Column) -> Column:
    before = F.lower(text.substr(F.greatest(s["start"] - CONTEXT + 1, F.lit(1)), F.least(s["start"], F.lit(CONTEXT))))
    edge = F.concat(text.substr(s["start"], F.when(s["start"] > 0, 1).otherwise(0)), F.lit(" "), text.substr(s["end"] + 1, F.lit(1)))
    return F.struct(
        s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"), F.lit(KINDS.index(kind)).alias("rank"),
        F.lit(1 if strict else -1).alias("strict"),
        F.when(_form(kind, s["hit"]), 1).otherwise(-1).alias("form"),
        _gazetteer(kind, s["hit"]).alias("gazetteer"),
        F.when(F.rlike(before, F.lit(WORDS_AGAINST)), -1).when(F.rlike(before, F.lit(WORDS_FOR[kind])), 1).otherwise(0).alias("context"),
        F.when(F.rlike(edge, F.lit(r"^[\p{L}\p{N}]|[\p{L}\p{N}]$")), -1).otherwise(1).alias("border"))


def _of_kind(text: Column, kind: str) -> Column:
    """Strict spans that hold the kind's conditions, and loose ones apart from them, with votes."""
    found = spans(text, STRICT[kind])
    if kind != "email":
        found = F.filter(found, lambda s: _form(kind, s["hit"]))

    def with_loose(strict: Column) -> Column:
        loose = F.filter(spans(text, LOOSE[kind]), lambda s: ~F.exists(
            strict, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
        return F.concat(F.transform(strict, lambda s: _votes(text, kind, True, s)),
                        F.transform(loose, lambda s: _votes(text, kind, False, s))).cast(_SPAN)

    return F.get(F.transform(F.array(found), with_loose), 0)


def candidates(docs: DataFrame, text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """The kept columns and found: every candidate span of the text with its votes."""
    body = whole(text)
    has = {"email": r"@|(?i:[(\[{]\x20?at\x20?[)\]}])", "ip": r"[0-9]\.[0-9]|[0-9A-Fa-f]:[0-9A-Fa-f]",
           "card": r"[0-9][0-9\x20-]{11}", "phone": r"\+[0-9]|[0-9)][-.\x20]?[0-9]{3}[-.][0-9]{4}"}
    found = [F.when(F.rlike(body, F.lit(has[k])), _of_kind(body, k)).otherwise(F.array().cast(_SPAN)) for k in KINDS]
    return docs.select(*keep, F.concat(*found).alias("found"))


def _posteriors(rows: list[tuple]) -> list[float]:
    """P(span is personal data) of each (kind, votes, count), by expectation-maximisation."""
    # Pseudo-counts of votes -1, 0, 1 on spans that are no personal data, and that are.
    prior = ((6.0, 3.0, 2.0), (2.0, 3.0, 6.0))
    share = dict.fromkeys(KINDS, 0.5)
    table = [[[p / sum(prior[y]) for p in prior[y]] for _ in VOTES] for y in (0, 1)]
    post = [0.5] * len(rows)
    for _ in range(ROUNDS):
        for r, (kind, votes, _) in enumerate(rows):
            odds = math.log(share[kind]) - math.log(1 - share[kind])
            odds += sum(math.log(table[1][k][v + 1]) - math.log(table[0][k][v + 1]) for k, v in enumerate(votes))
            post[r] = 1 / (1 + math.exp(-max(-40.0, min(40.0, odds))))
        for kind in KINDS:
            own = [(p, n) for p, (k, _, n) in zip(post, rows) if k == kind]
            share[kind] = (1 + sum(p * n for p, n in own)) / (2 + sum(n for _, n in own))
        total = max(1.0, float(sum(n for *_, n in rows)))
        scale = max(1.0, total / 100)      # the prior keeps a hundredth of the evidence's weight
        for y in (0, 1):
            for k in range(len(VOTES)):
                seen = [scale * p for p in prior[y]]
                for p, (_, votes, n) in zip(post, rows):
                    seen[votes[k] + 1] += n * (p if y else 1 - p)
                table[y][k] = [s / sum(seen) for s in seen]
    return post


def _features(kind: str, votes: Sequence[int]) -> list[float]:
    return [1.0] + [float(kind == k) for k in KINDS[1:]] + [float(v == s) for v in votes for s in (-1, 1)]


def train(rows: list[tuple]) -> list[float]:
    """Weights of the logistic span classifier, fitted to the posteriors of (kind, votes, count) rows."""
    post = _posteriors(rows)
    x = [_features(kind, votes) for kind, votes, _ in rows]
    total = sum(n for *_, n in rows) or 1
    w = [0.0] * (len(KINDS) + 2 * len(VOTES))
    for _ in range(400):
        slope = [0.002 * a for a in w]
        for f, p, (*_, n) in zip(x, post, rows):
            z = sum(a * b for a, b in zip(w, f))
            gap = (1 / (1 + math.exp(-max(-40.0, min(40.0, z)))) - p) * n / total
            for j, v in enumerate(f):
                if v:
                    slope[j] += gap * v
        w = [a - 1.0 * s for a, s in zip(w, slope)]
    return w


def _accepted(s: Column, weights: Sequence[float]) -> Column:
    score = F.lit(weights[0])
    for k, kind in enumerate(KINDS[1:], 1):
        score = score + F.when(s["kind"] == kind, weights[k]).otherwise(0.0)
    at = len(KINDS)
    for k, vote in enumerate(VOTES):
        score = score + F.when(s[vote] == -1, weights[at + 2 * k]).when(s[vote] == 1, weights[at + 2 * k + 1]).otherwise(0.0)
    return score >= math.log(THRESHOLD / (1 - THRESHOLD))


def find(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The kept columns and spans: (start, end, kind, rank, base) in code points, per input row.

    Defined results: null and empty texts have no spans; repeated rows have equal spans; a table without
    candidates trains nothing and adds nothing; an empty table gives an empty table. Other columns are
    not read, and one named found or spans must be renamed before it is kept.
    """
    found = cut_lineage(candidates(docs, text, keep))
    each = found.select(F.explode("found").alias("s")).select("s.*")
    counted = each.groupBy("kind", *VOTES).count().collect()      # bounded: kinds times vote patterns
    rows = sorted((r["kind"], tuple(r[v] for v in VOTES), r["count"]) for r in counted)
    weights = train(rows)
    kept = F.filter("found", lambda s: (s["strict"] == 1) | _accepted(s, weights))
    return found.select(*keep, F.transform(kept, lambda s: F.struct(
        s["start"], s["end"], s["kind"], s["rank"], (s["strict"] == 1).alias("base"))).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts of the base spans by kind, SHA-256 of the base spans, all spans as text."""
    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["base"])
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(span_list(base), 256).alias("base_sha256"),
                        span_list(F.col("spans")).alias("spans"))
