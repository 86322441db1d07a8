"""Trial run, not part of the suite: operators on inputs with a third of all rows in one key.

    python tests/hot_keys.py
"""
from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import functions as F  # noqa: E402

from panelspark.operators import aggregates as agg, events as ev, ingest as ing, views  # noqa: E402
from panelspark.session import local_session  # noqa: E402

DAY = 86400


def timed(name: str, df) -> None:
    start = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    print(f"{name:24s} {time.perf_counter() - start:6.1f} s", flush=True)


def main() -> None:
    spark = local_session()

    def a_third(hot, other):
        return F.when(F.col("id") % 3 == 0, hot).otherwise(other)

    unit = a_third(F.lit("u0"), F.concat(F.lit("u"), (F.col("id") % 50_000).cast("string")))
    tick = F.xxhash64("id") % (30 * DAY) + 30 * DAY
    obs = spark.range(2_000_000).select(unit.alias("unit"), tick.alias("tick"),
                                        (F.col("id") % 97).cast("double").alias("value"))
    events = spark.range(200_000).select(F.col("id").alias("event_code"), unit.alias("unit"), (tick + 7).alias("tick"))
    timed("point_event_study", ev.point_event_study(events, obs, window=DAY, chunk=DAY // 4))

    facts = spark.range(3_000_000).select(
        a_third(F.lit(1), F.col("id") % 100_000).cast("int").alias("geography_id"), F.lit(1).alias("indicator_id"),
        F.lit(1).alias("source_id"), F.lit(2020).alias("year"), F.lit(0).alias("quarter"), F.lit(0).alias("month"),
        F.col("id").cast("double").alias("value"), F.lit("2020-01-01").cast("date").alias("vintage_date"))
    source = spark.createDataFrame([(1, "s", .9)], "id int, name string, reliability_score double")
    timed("current_vintage", views.current_vintage(facts))
    timed("best_source", views.best_source(views.current_vintage(facts), source))

    rows = spark.range(3_000_000).select(
        F.col("id").alias("ordinal"), a_third(F.lit("A"), F.concat(F.lit("A"), F.col("id") % 5000)).alias("iso3"),
        F.lit("x").alias("indicator_code"), F.lit(1990).alias("year"), F.lit(None).cast("int").alias("quarter"),
        F.lit(None).cast("int").alias("month"), F.lit(1.0).alias("value"))
    codes = spark.range(5001).select(F.when(F.col("id") == 5000, "A").otherwise(
        F.concat(F.lit("A"), F.col("id"))).alias("code"))
    timed("validate", ing.classify(rows, codes))

    latest = spark.range(1_000_000).select(
        F.concat(F.lit("u"), F.col("id").cast("string")).alias("unit"), F.lit("I").alias("indicator"),
        a_third(F.lit(0.0), F.rand(1) * 1000).alias("value"), F.lit("x").alias("value_unit"),
        F.lit("2020").alias("period"))
    start = time.perf_counter()
    ranked = agg.headline(latest, ["I"])
    print("headline: its own tables", f"{time.perf_counter() - start:.1f} s")
    timed("headline: ranks", ranked)


if __name__ == "__main__":
    main()
