"""String predicates."""
from __future__ import annotations

from pyspark.sql import Column, functions as F


def name_stem(name: Column) -> Column:
    """Lower-case name without parenthesised qualifiers."""
    return F.lower(F.regexp_replace(F.regexp_replace(name, r"\s*\(.*?\)", ""), r"^\s+|\s+$", ""))


def is_variant(a: Column, b: Column) -> Column:
    """Whether two names denote one series at another frequency or scale:
    after stemming, one is a prefix of the other (or they are equal)."""
    x, y = name_stem(a), name_stem(b)
    return x.startswith(y) | y.startswith(x)


def contains_ci(col: Column, text: str) -> Column:
    """Case-insensitive literal substring: % and _ have no special meaning."""
    return F.lower(F.coalesce(col, F.lit(""))).contains(text.lower())


def has_tag(csv: Column, tag: str) -> Column:
    """Exact member of a comma-separated list."""
    return F.coalesce(F.array_contains(F.split(csv, ","), tag), F.lit(False))
