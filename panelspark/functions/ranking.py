"""Ranks, medians and running minima over groups of any size.

A plain ``Window.partitionBy(group).orderBy(value)`` sends one whole group to
one task, and one group may hold a third of the table. Here equal values
collapse to one counted row, and counts are kept on three levels: coarse bands of
the number line, fine bands inside a coarse one, values inside a fine one. A band
follows from the value alone, so nothing is sampled or written out, and counts of
bands merge on the map side. Every level is ordered on its own, offset by the
level above, and no ordering ever holds more rows than a band has members:
about 400,000 coarse bands, ``_FINE`` fine ones, and the doubles of one fine band,
which spans a 2**-30th of its value.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelspark.session import cut_lineage

_COARSE = 256           # coarse bands for a factor of e
_FINE = 1 << 22         # fine bands in a coarse one
_ZERO = 200_000         # more than any |ln(x)| * _COARSE, so that both signs keep apart


def _bands(value: str) -> tuple[Column, Column]:
    """Coarse and fine band: never falling as the value rises, whatever its scale."""
    x = F.col(value).cast("double")
    scale = F.log(F.abs(x)) * _COARSE
    band = F.floor(scale)
    fine = F.floor((scale - band) * _FINE)
    finite = ~F.isnan(x) & (F.abs(x) < float("inf"))
    coarse = (F.when(F.isnan(x), 3 * _ZERO).when(x == float("inf"), 2 * _ZERO + 1).when(x == float("-inf"), -2 * _ZERO - 1)
              .when(x > 0, band + _ZERO).when(x < 0, -band - _ZERO).otherwise(0))
    return coarse.cast("int"), F.when(finite & (x > 0), fine).when(finite & (x < 0), -fine).otherwise(0).cast("int")


def _counted(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    coarse, fine = _bands(value)
    return (df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n_ties"))
            .withColumns({"_coarse": coarse, "_fine": fine}))


def _same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, null groups included."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def cumulative_counts(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Per (group, distinct value): ``n_ties``, ``n_less``, ``n_total``. ``df`` is read several times:
    give it a stored table if it is dear, or if its values could differ when computed again."""
    return _counts(df, groups, value).drop("_coarse", "_fine")


def _counts(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    counted = _counted(df, groups, value)
    coarse, fine = [*groups, "_coarse"], [*groups, "_coarse", "_fine"]

    def before(keys: list[str], order: str, n: str) -> Column:
        return F.sum(n).over(Window.partitionBy(*keys).orderBy(order)) - F.col(n)

    per_fine = counted.groupBy(*fine).agg(F.sum("n_ties").alias("_n"))
    per_coarse = per_fine.groupBy(*coarse).agg(F.sum("_n").alias("_n"))
    above = per_coarse.select(*coarse, before(groups, "_coarse", "_n").alias("_above"),
                              F.sum("_n").over(Window.partitionBy(*groups)).alias("n_total"))
    offsets = _same(per_fine.select(*fine, before(coarse, "_fine", "_n").alias("_beside")), above, coarse).select(
        *fine, (F.col("_above") + F.col("_beside")).alias("_before"), "n_total")
    inside = counted.withColumn("_inside", before(fine, value, "n_ties"))
    return _same(inside, offsets, fine).select(
        *groups, value, "n_ties", (F.col("_before") + F.col("_inside")).alias("n_less"), "n_total", "_coarse", "_fine")


def tie_positions(df: DataFrame, groups: list[str], code: str) -> DataFrame:
    """Adds ``position``: 1, 2, ... by ``code`` within each group of equal rows.

    A third of all rows may tie, so a group is split by ranges of the code itself,
    whatever letters the codes share, and offset by the counts of the ranges before.
    Rows are written out in these ranges, because the numbers must not change between two readings.
    """
    rows = cut_lineage(df.repartitionByRange(*groups, code).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(*groups).orderBy("_part")
    offsets = (rows.groupBy(*groups, "_part").agg(F.count(F.lit(1)).alias("_n"))
               .select(*groups, "_part", (F.sum("_n").over(before) - F.col("_n")).alias("_before")))
    inside = Window.partitionBy(*groups, "_part").orderBy(code)
    return (rows.withColumn("_inside", F.row_number().over(inside)).join(offsets, [*groups, "_part"])
            .withColumn("position", F.col("_before") + F.col("_inside")).drop("_part", "_before", "_inside"))


def _covers(low: Column, high: Column, before: Column, n: Column) -> Column:
    return (before < high) & (low <= before + n)


def medians_from_counts(counts: DataFrame, groups: list[str], value: str,
                        name: str = "median") -> DataFrame:
    """Exact median and size per group from ``cumulative_counts``."""
    low = F.floor((F.col("n_total") + 1) / 2)
    high = F.floor((F.col("n_total") + 2) / 2)
    middle = counts.where(_covers(low, high, F.col("n_less"), F.col("n_ties")))
    return (middle.groupBy(*groups).agg(((F.min(value) + F.max(value)) / 2.0).alias(name), F.max("n_total").alias("n_total")))


def group_median(df: DataFrame, groups: list[str], value: str, name: str = "median") -> DataFrame:
    """Exact median and size per group: the histogram is refined only where the middle ranks lie.

    The rows are read once; their counted values are written out, since every refinement reads some of them
    and a mean computed again could differ in its last bit.
    """
    counted = cut_lineage(_counted(df, groups, value))
    middle = Window.partitionBy(*groups)
    low, high = F.floor((F.col("n_total") + 1) / 2), F.floor((F.col("n_total") + 2) / 2)

    def reached(rows: DataFrame, order: list[str], offset: Column, n: str) -> DataFrame:
        """Rows that hold a middle rank, with the count of smaller values as ``_less``."""
        run = F.sum(n).over(middle.orderBy(*order)) - F.col(n) + offset
        return rows.withColumn("_less", run).where(_covers(low, high, F.col("_less"), F.col(n)))

    per_coarse = counted.groupBy(*groups, "_coarse").agg(F.sum("n_ties").alias("_n")).withColumn(
        "n_total", F.sum("_n").over(middle))
    # At most two coarse bands of a group hold its middle, and their values two fine ones.
    first = reached(per_coarse, ["_coarse"], F.lit(0), "_n").select(*groups, "_coarse", "n_total", F.col("_less").alias("_offset"))
    lowest = F.min("_offset").over(middle)
    per_fine = (_same(counted, first, [*groups, "_coarse"])
                .groupBy(*groups, "_coarse", "_fine", "n_total", "_offset").agg(F.sum("n_ties").alias("_n")))
    second = reached(per_fine.withColumn("_offset", lowest), ["_coarse", "_fine"], F.col("_offset"), "_n").select(
        *groups, "_coarse", "_fine", "n_total", F.col("_less").alias("_offset"))
    last = _same(counted, second, [*groups, "_coarse", "_fine"]).withColumn("_offset", lowest)
    third = reached(last, [value], F.col("_offset"), "n_ties")
    return third.groupBy(*groups).agg(((F.min(value) + F.max(value)) / 2.0).alias(name), F.max("n_total").alias("n_total"))


def benjamini_hochberg(df: DataFrame, p: str, q: str = "q_value") -> DataFrame:
    """Adds the false-discovery-rate adjusted p-value over all rows of ``df``.

    q(p) is the smallest p' * m / rank(p') over p' >= p, so it depends on
    distinct p-values only. The reverse running minimum is taken inside each
    fine band, over the fine bands above it and over the coarse ones above that. Rows
    find their q by their p, so ``df`` is written out first.
    """
    df = cut_lineage(df)
    counts = (_counts(df.withColumn("_all", F.lit(0)), ["_all"], p)
              .select(F.col(p).alias("_p"), "_coarse", "_fine",
                      (F.col(p) * F.col("n_total") / (F.col("n_less") + F.col("n_ties"))).alias("_raw")))

    def above(order: str, *keys: str) -> Column:
        return F.min("_min").over(Window.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1))

    per_fine = counts.groupBy("_coarse", "_fine").agg(F.min("_raw").alias("_min"))
    per_coarse = per_fine.groupBy("_coarse").agg(F.min("_min").alias("_min")).withColumn("_later", above("_coarse"))
    later = (per_fine.withColumn("_beside", above("_fine", "_coarse"))
             .join(per_coarse.select("_coarse", "_later"), "_coarse")
             .select("_coarse", "_fine", F.least("_beside", "_later").alias("_later")))
    inside = (Window.partitionBy("_coarse", "_fine").orderBy(F.desc("_p"))
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    adjusted = (counts.join(later, ["_coarse", "_fine"])
                .select("_p", F.least(F.min("_raw").over(inside), F.col("_later"), F.lit(1.0)).alias(q)))
    return df.join(adjusted, df[p] == adjusted["_p"], "left").drop("_p")
