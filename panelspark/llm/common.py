"""Column helpers that several operators of this subpackage share."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# White space between words: space and the five control characters tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def whole(text: str | Column) -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: str | Column) -> Column:
    """Words of a text as an array; null and blank texts have none."""
    return F.filter(F.split(whole(text), SPACE), lambda w: w != "")


def word_count(text: str | Column) -> Column:
    return F.size(words(text)).cast("long")


BROADCAST_BYTES = 64 << 20      # a larger table is joined by shuffle


def few(df: DataFrame, width: Column | int) -> DataFrame:
    """A written table with a broadcast hint if its rows, of so many bytes each in memory, are few enough."""
    size = df.agg(F.sum(width if isinstance(width, Column) else F.lit(width))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def unused(df: DataFrame, name: str) -> str:
    """A column name that the table does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


_SPANS = "array<struct<start:int,end:int,hit:string>>"


def spans(text: str | Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as (start, end, hit), in code points, end exclusive.

    The pieces between matches give the offsets, so every pattern without empty matches
    works. A text without a match costs a single search.
    """
    text = whole(text)
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"),
                         F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))

    def step(acc: Column, part: Column) -> Column:
        start = acc["at"] + F.length(part["gap"])
        end = start + F.coalesce(F.length(part["hit"]), F.lit(0))
        found = F.struct(start.alias("start"), end.alias("end"), part["hit"].alias("hit"))
        return F.struct(end.alias("at"),
                        F.when(part["hit"].isNull(), acc["out"])
                        .otherwise(F.array_append(acc["out"], found)).alias("out"))

    empty = F.array().cast(_SPANS)
    first = F.struct(F.lit(0).alias("at"), empty.alias("out"))
    return F.when(F.rlike(text, F.lit(pattern)),
                  F.aggregate(parts, first, step, lambda acc: acc["out"])).otherwise(empty)


def span_list(found: Column) -> Column:
    """kind:start:end of spans with a rank field, by start, then rank, comma-joined."""
    ordered = F.array_sort(F.transform(found, lambda s: F.struct(s["start"], s["rank"], s["end"], s["kind"])))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
