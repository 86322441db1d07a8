"""Revision analysis: one source re-reporting a period at a later vintage.

All of it reads the full vintage history. Rows without a vintage are left out.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from panelspark.functions.periods import period_label
from panelspark.operators.views import unit_code
from panelspark.schema import SOURCE_KEY


def revisions(records: DataFrame) -> DataFrame:
    """Every vintage of each (unit, indicator, source, period) that was revised at least once.

    Revised keys are found first with a map-side min/max, so only they reach the
    window. Within one of them rows are unique per vintage date, so the group is
    bounded by the number of publication dates.
    """
    dated = records.where(F.col("vintage_date").isNotNull())
    revised = (dated.groupBy(*SOURCE_KEY)
               .agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
               .where(F.col("_lo") != F.col("_hi")).select(*SOURCE_KEY))
    w = Window.partitionBy(*SOURCE_KEY).orderBy("vintage_date", "value")
    delta = F.col("value") - F.col("previous_value")
    return (dated.join(revised, SOURCE_KEY, "left_semi")
            .select(*SOURCE_KEY, period_label().alias("period"), "vintage_date", "value",
                    F.lag("value").over(w).alias("previous_value"),
                    F.lead("vintage_date").over(w).isNull().alias("is_latest"))
            .withColumn("delta", delta)
            .withColumn("pct_change", F.try_divide("delta", F.nullif("previous_value", F.lit(0.0))) * 100.0))


def _first_last(dated: DataFrame, keys: list[str]) -> DataFrame:
    # distinct vintages: collapse to one row per vintage first, both steps map-side
    per_vintage = dated.groupBy(*keys, "vintage_date").agg(F.min("value").alias("_v0"),
                                                           F.max("value").alias("_v1"))
    return per_vintage.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_vintages"),
        F.min_by("_v0", "vintage_date").alias("first_value"),
        F.max_by("_v1", "vintage_date").alias("latest_value"),
        F.min("vintage_date").alias("first_vintage"), F.max("vintage_date").alias("latest_vintage"),
        F.min("_v0").alias("_lo"), F.max("_v1").alias("_hi"))


def revision_periods(records: DataFrame) -> DataFrame:
    """Summary of each revised (unit, indicator, source, period). Sources are kept apart."""
    dated = records.where(F.col("vintage_date").isNotNull())
    return (_first_last(dated, SOURCE_KEY).where(F.col("_lo") != F.col("_hi"))
            .select(*SOURCE_KEY, period_label().alias("period"), "n_vintages", "first_value", "latest_value",
                    (F.col("latest_value") - F.col("first_value")).alias("delta")))


def revisions_summary(records: DataFrame, indicator: DataFrame, domain: DataFrame,
                      geography: DataFrame, source: DataFrame, ordered: bool = False) -> DataFrame:
    """Keys with several vintages whose first and latest values differ."""
    dated = records.where(F.col("vintage_date").isNotNull())
    delta = F.col("latest_value") - F.col("first_value")
    facts = (_first_last(dated, SOURCE_KEY)
             .where((F.col("n_vintages") > 1) & ~F.col("first_value").eqNullSafe(F.col("latest_value"))))
    ind = indicator.select(F.col("id").alias("indicator_id"), "domain_id", F.col("name").alias("indicator"))
    dom = domain.select(F.col("id").alias("domain_id"), F.col("name").alias("domain"))
    geo = unit_code(geography).select(F.col("id").alias("geography_id"), F.col("unit").alias("country"))
    src = source.select(F.col("id").alias("source_id"), F.col("name").alias("source"))
    out = (facts.join(ind, "indicator_id").join(dom, "domain_id").join(src, "source_id")
           .join(geo, "geography_id")
           .select("indicator", "country", "domain", "source", period_label().alias("period"), "year",
                   "n_vintages", "first_value", "latest_value", "first_vintage", "latest_vintage",
                   delta.alias("delta"),
                   (F.try_divide(delta, F.nullif("first_value", F.lit(0.0))) * 100.0).alias("pct_change")))
    return out.orderBy(F.abs("pct_change").desc_nulls_last()) if ordered else out


def most_revised(summary: DataFrame, k: int = 10) -> DataFrame:
    """Indicators with the most revised periods."""
    return (summary.groupBy("indicator").agg(F.count(F.lit(1)).alias("revised_periods"))
            .orderBy(F.desc("revised_periods"), "indicator").limit(k))
