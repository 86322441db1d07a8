"""URL verdicts by pattern rules, indexed by their rarest literal token.

A rule is a regular expression over the host and the path. The literal tokens that any URL it fits must hold as
whole tokens are derived from the expression. How often each of these tokens occurs is counted over all
URLs; a rule is filed under its rarest one. A URL's tokens fetch candidate rules, and only these run their
regular expression; rules that demand no token run on every URL. The index is as long as the rule list and
travels with the task; URLs are not shuffled.
"""
from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_TOKEN = re.compile("[a-z0-9]+")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


_GROUP_EDGE = re.compile(r"\(\?<!\[\^[^a-zA-Z0-9\\\]]+\]\)|\(\?(?:<!|!)\[a-z0-9\]\)|\(\?=[/.]")
_CLASS_EDGE = re.compile(r"\[[^\^a-zA-Z0-9\\\]\[][^a-zA-Z0-9\\\]\[]*\]")


def literal_tokens(pattern: str) -> tuple[str, ...]:
    """Tokens that every match of a regular expression holds with no letter or digit beside them; maybe not all of those.

    A token is a run of literal letters and digits outside of groups, classes and quantifiers, between edges: an
    anchor, literal punctuation, a class of punctuation, a look-around that excludes letters and digits, or one
    ahead to punctuation. Expressions with alternatives at the top demand none.
    """
    found, run, edge, at = [], "", False, 0

    def close(is_edge: bool) -> None:
        nonlocal run, edge
        if run and edge and is_edge:
            found.append(run.lower())
        run, edge = "", is_edge

    while at < len(pattern):
        c = pattern[at]
        step, kind = 1, "other"                  # letter, edge, or other
        if c == "|":
            return ()
        if c == "\\":
            step = 2
            kind = "edge" if not pattern[at + 1:at + 2].isalnum() else "other"
        elif c == "[":
            m = _CLASS_EDGE.match(pattern, at)
            kind = "edge" if m else "other"
            end = at + 2 if pattern[at + 1:at + 2] in ("]", "^") else at + 1
            end = end + 1 if pattern[at + 1:at + 3] == "^]" else end
            while pattern[end] != "]":
                end += 2 if pattern[end] == "\\" else 1
            step = end + 1 - at
        elif c == "(":
            kind = "edge" if _GROUP_EDGE.match(pattern, at) else "other"
            depth, end, inside = 1, at + 1, False
            while depth:
                d = pattern[end]
                if d == "\\":
                    end += 1
                elif inside:
                    inside = d != "]"
                elif d == "[":
                    inside = True
                    end += pattern[end + 1] == "^"
                    end += pattern[end + 1] == "]"
                else:
                    depth += (d == "(") - (d == ")")
                end += 1
            step = end - at
        elif c.isascii() and c.isalnum():
            kind = "letter"
        elif c in "^$":
            kind = "edge"
        elif c not in ".*+?{":
            kind = "edge"
        many = pattern[at + step:at + step + 1]
        if many and many in "*+?{":
            # An optional or repeated part may add to the token beside it, or leave it without its edge.
            close(kind == "edge" and many == "+")
            edge = kind == "edge" and many == "+"
            at += step + 1
            if many == "{":
                at = pattern.index("}", at) + 1
            at += pattern[at:at + 1] == "?"
            continue
        if kind == "letter":
            run += c
        else:
            close(kind == "edge")
        at += step
    close(False)
    return tuple(dict.fromkeys(found))


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    pattern: str            # searched in the host with its path
    length: int = 0         # host rules: the longest one that fits decides; 0: counts only without them

    @property
    def tokens(self) -> tuple[str, ...]:
        return literal_tokens(self.pattern)


def host_rule(verdict: str, name: str) -> Rule:
    """A rule like net/ or example.net/en/: a host, its subdomains, and a path prefix."""
    host, _, path = name.partition("/")
    return Rule(name, verdict, rf"^[^/?#]*(?<![^.]){re.escape(host)}(?={re.escape('/' + path)})", len(name))


def word_rule(*words: str) -> Rule:
    """Blocks hosts that hold these words in order, as whole words with single separators between."""
    return Rule("-".join(words), "block", rf"^[^/?#]*(?<![^.-]){'[.-]'.join(words)}(?![a-z0-9])")


def path_rule(name: str) -> Rule:
    """Blocks paths that hold these segments, like /wp-admin/ or /ads/; "*" stands for one whole segment."""
    parts = ["[^/?#]+" if part == "*" else re.escape(part) for part in name.strip("/").split("/")]
    return Rule(name, "block", "/" + "/".join(parts) + "(?![^/])")


# The host rules of the query, then words of unwanted hosts.
HOST_RULES = [host_rule("block", "net/"), host_rule("allow", "example.net/en/"), host_rule("block", "example.com/de/"),
              host_rule("allow", "org/fr/")]
WORD_RULES = [word_rule(*w.split()) for w in (
    "ads track", "adult", "bets", "casino", "casinos", "escort", "gambling", "malware", "phishing", "poker", "porn", "slots", "spam",
    "torrent", "viagra", "warez", "xxx", "cheap pills", "free bets", "free spins", "link farm", "spam farm", "payday loan", "payday loans")]
RULES = HOST_RULES + WORD_RULES

_RESULT = [("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()),
           ("verdict", pa.string()), ("pattern", pa.string())]


def split_url(url: str | None) -> tuple[str, str]:
    """Host with A-Z lower-cased, and path."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return host.translate({ord(c): c.lower() for c in _UPPER}), path


def token_counts(pages: DataFrame, rules: list[Rule]) -> dict[str, int]:
    """How many URLs hold each token of the rules."""
    known = sorted({t for r in rules for t in r.tokens})
    if not known:
        return {}
    tokens = F.split(F.translate("url", _UPPER, _UPPER.lower()), "[^a-z0-9]+")
    own = F.array_intersect(tokens, F.array(*[F.lit(t) for t in known]).cast("array<string>"))
    counted = pages.select(F.explode_outer(own).alias("token")).where("token is not null").groupBy("token").count()
    return dict.fromkeys(known, 0) | {r["token"]: r["count"] for r in counted.collect()}     # as long as the rules


def file_rules(rules: list[Rule], counts: dict[str, int]) -> dict[str | None, list[Rule]]:
    """The rules by their rarest token, or under None; ties go to the longer, then the smaller token."""
    index = defaultdict(list)
    for rule in rules:
        index[min(rule.tokens, key=lambda t: (counts[t], -len(t), t), default=None)].append(rule)
    return dict(index)


def judge(url: str | None, index: dict[str | None, list[Rule]], compiled: dict[str, re.Pattern]) -> tuple:
    """(host, path, rule, verdict, pattern) of one URL."""
    host, path = split_url(url)
    full = host + path
    low = full.translate({ord(c): c.lower() for c in _UPPER})
    near = {r for t in {None, *_TOKEN.findall(low)} if t in index for r in index[t]}
    fits = [r for r in near if compiled[r.pattern].search(full)]
    best = max((r for r in fits if r.length), key=lambda r: (r.length, r.name), default=None)
    if best:
        return host, path, best.name, best.verdict, None
    words = sorted(r.name for r in fits if not r.length)
    return host, path, None, "block" if words else "allow", words[0] if words else None


def url_filter(pages: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and pattern (the first word rule that fits) of every row.

    Defined results: a null url or one without :// has empty host and path and is allowed; repeated rows
    are judged alike; an empty table gives an empty table; other columns are not read.
    """
    rules = RULES if rules is None else rules
    given = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    index = file_rules(rules, token_counts(given, rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = {r.pattern: re.compile(r.pattern, re.S) for r in rules}
        for batch in batches:
            found = [judge(u.as_py(), index, compiled) for u in batch.column(1)]
            columns = [pa.array([f[k] for f in found], pa.string()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[n for n, _ in _RESULT])

    return given.mapInArrow(run, ", ".join(f"{n} {'long' if t == pa.int64() else 'string'}" for n, t in _RESULT))
