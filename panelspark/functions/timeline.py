"""Totals over arbitrary time spans, in linear work."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import DecimalType, IntegralType


def totals_before(observations: DataFrame, probes: DataFrame, keys: list[str], chunk: int) -> DataFrame:
    """For each probe, the sum and count of its key's observations strictly before it.

    ``observations`` is (keys, at, value), ``probes`` (keys, at, any other
    columns); returns the probes with ``sum_before`` and ``n_before``. Two such
    readings give any interval, so an interval join of probes with observations
    is never formed. Time is cut into chunks of ``chunk`` units: running totals
    are taken inside a chunk, so a key with a third of all rows is spread over
    its chunks, and one row per (key, chunk) carries the totals of the chunks
    before. Decimal and whole values are summed exactly; doubles as doubles, so that
    neither tiny nor huge values are cut off.
    """
    kind = observations.schema["value"].dataType
    value = F.col("value") if isinstance(kind, (DecimalType, IntegralType)) else F.col("value").cast("double")
    extra = [c for c in probes.columns if c not in (*keys, "at")]
    obs = observations.where(F.col("value").isNotNull()).select(
        *keys, "at", F.lit(1).alias("_kind"), value.alias("_value"),
        F.lit(None).cast(probes.select(F.struct(*extra)).schema[0].dataType).alias("_probe"))
    tape = obs.unionByName(probes.select(
        *keys, "at", F.lit(0).alias("_kind"), F.lit(None).cast(obs.schema["_value"].dataType).alias("_value"),
        F.struct(*extra).alias("_probe"))).withColumn("_chunk", F.floor(F.col("at") / chunk))
    past = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (tape.groupBy(*keys, "_chunk").agg(F.sum("_value").alias("_s"), F.count("_value").alias("_c"))
               .select(*keys, "_chunk", F.sum("_s").over(past).alias("_s0"), F.sum("_c").over(past).alias("_c0")))
    # a probe sorts before the observations of its own instant
    inside = (Window.partitionBy(*keys, "_chunk").orderBy("at", "_kind")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    read = (tape.withColumn("_s", F.sum("_value").over(inside)).withColumn("_c", F.count("_value").over(inside))
            .where("_kind = 0").join(offsets, [*keys, "_chunk"]))
    return read.select(
        *keys, "at", "_probe.*",
        (F.coalesce("_s0", F.lit(0)) + F.coalesce("_s", F.lit(0))).alias("sum_before"),
        (F.coalesce("_c0", F.lit(0)) + F.col("_c")).alias("n_before"))
