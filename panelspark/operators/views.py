"""Bitemporal views: latest vintage, best source, as-of, provenance."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelspark.functions.periods import decimal_year, period_label
from panelspark.schema import BEST_KEY, NO_VINTAGE, SOURCE_KEY, PanelLookupError

__all__ = ["annualize", "as_of", "best_source", "current_vintage", "known_on", "provenance",
           "source_disagreements", "unit_code", "unit_year_frame", "validity", "PanelLookupError"]


def vintage_order(col: str = "vintage_date") -> Column:
    return F.coalesce(F.col(col), F.lit(NO_VINTAGE).cast("date"))


def unit_code(geography: DataFrame) -> DataFrame:
    """Geography with ``unit`` = iso3 for countries, code for regions."""
    return geography.withColumn("unit", F.coalesce("iso3", "code"))


def current_vintage(records: DataFrame) -> DataFrame:
    """Rows carrying the latest vintage of their (unit, indicator, source, period).

    Ties are kept: every row at the latest vintage is returned. ``rank() = 1`` plans as a
    group limit before the one shuffle, so a task sends on only its own latest rows of a key.
    """
    latest = Window.partitionBy(*SOURCE_KEY).orderBy(vintage_order().desc())
    return records.withColumn("_rank", F.rank().over(latest)).where("_rank = 1").drop("_rank")


def best_source(records: DataFrame, source: DataFrame) -> DataFrame:
    """One row per (unit, indicator, period): highest reliability, then lowest source id,
    then its latest vintage, then the lowest value.

    The vintage is part of the order, so the facts need not be reduced to their current
    vintage first: one window, one shuffle of the facts, and a group limit before it.
    """
    scores = source.select(F.col("id").alias("source_id"), F.col("reliability_score").alias("_score"))
    order = (Window.partitionBy(*BEST_KEY)
             .orderBy(F.desc("_score"), "source_id", vintage_order().desc(), F.col("value").asc_nulls_last()))
    return (records.join(scores, "source_id")
            .withColumn("_rn", F.row_number().over(order)).where("_rn = 1")
            .select(*records.columns))


def as_of(records: DataFrame, date: str | dt.date) -> DataFrame:
    """The panel as known on a date: latest vintage not after it."""
    return current_vintage(records.where(vintage_order() <= F.lit(str(date)).cast("date")))


def validity(records: DataFrame) -> DataFrame:
    """Every fact with the days on which it was the latest: ``valid_from``, and ``valid_to``, the day of its
    successor's vintage (null while there is none). Facts of one vintage share their interval.

    Stored once per refresh, it answers any as-of date by a filter: see ``known_on``.
    """
    day = F.unix_date(vintage_order())
    later = Window.partitionBy(*SOURCE_KEY).orderBy(F.col("_day").desc()).rangeBetween(Window.unboundedPreceding, -1)
    return (records.withColumn("_day", day)
            .withColumns({"valid_from": vintage_order(), "valid_to": F.date_from_unix_date(F.min("_day").over(later))}).drop("_day"))


def known_on(intervals: DataFrame, date: str | dt.date) -> DataFrame:
    """The rows of ``as_of`` from a stored ``validity`` table: a scan filter, no window and no shuffle."""
    on = F.lit(str(date)).cast("date")      # years below 1000 pass only as text
    return (intervals.where((F.col("valid_from") <= on) & (F.col("valid_to").isNull() | (F.col("valid_to") > on)))
            .drop("valid_from", "valid_to"))


def provenance(current: DataFrame, source: DataFrame, indicator: DataFrame,
               geography: DataFrame) -> DataFrame:
    """Every source's latest value per period, repeats collapsed, with ``is_best``.

    The marked row is the most reliable one; source id, then value, break ties.
    Copies collapse before the window, so a period's group holds one row per
    source (more only if a source contradicts itself within a vintage).
    """
    return _named_provenance(_ranked_sources(current, source), indicator, geography)


def source_disagreements(current: DataFrame, source: DataFrame, indicator: DataFrame,
                         geography: DataFrame) -> DataFrame:
    """Provenance rows of periods where at least two sources report different values."""
    group = Window.partitionBy(*BEST_KEY)

    def differ(col: str) -> Column:
        return F.min(col).over(group) != F.max(col).over(group)

    ranked = (_ranked_sources(current, source)
              .withColumn("_differ", differ("source_id") & differ("value")).where("_differ").drop("_differ"))
    return _named_provenance(ranked, indicator, geography)


def _ranked_sources(current: DataFrame, source: DataFrame) -> DataFrame:
    src = source.select(F.col("id").alias("source_id"), F.col("name").alias("source"), "reliability_score")
    w = (Window.partitionBy(*BEST_KEY)
         .orderBy(F.desc("reliability_score"), "source_id", "value", F.col("unit").asc_nulls_last()))
    return (current.select(*SOURCE_KEY, "value", "unit").distinct().join(src, "source_id")
            .withColumn("is_best", F.row_number().over(w) == 1))


def _named_provenance(ranked: DataFrame, indicator: DataFrame, geography: DataFrame) -> DataFrame:
    ind = indicator.select(F.col("id").alias("indicator_id"), F.col("name").alias("indicator"),
                           F.col("unit").alias("_default_unit"))
    geo = unit_code(geography).select(F.col("id").alias("geography_id"), F.col("unit").alias("_code"))
    return (ranked.join(ind, "indicator_id").join(geo, "geography_id")
            .select(F.col("_code").alias("unit"), "indicator", period_label().alias("period"), "year",
                    decimal_year().alias("t"), "source", "value",
                    F.coalesce(F.col("unit"), F.col("_default_unit")).alias("value_unit"),
                    "reliability_score", "is_best"))


def annualize(df: DataFrame, keys: tuple[str, ...] = ("unit", "indicator")) -> DataFrame:
    """Mean of all observations of a year."""
    return df.groupBy(*keys, "year").agg(F.avg("value").alias("value"))


def unit_year_frame(best: DataFrame, geography: DataFrame, indicator: DataFrame,
                    level: str | None = None) -> DataFrame:
    """(unit, indicator, year, value): the annual frame the statistics run on.

    Averages are taken on the ids, so the dimensions meet one row per year.
    """
    geo = unit_code(geography)
    if level is not None:
        geo = geo.where(F.col("level") == level)
    geo = geo.select(F.col("id").alias("geography_id"), "unit")
    ind = indicator.select(F.col("id").alias("indicator_id"), F.col("name").alias("indicator"))
    facts = best.select("geography_id", "indicator_id", "year", "value")
    return (annualize(facts, ("geography_id", "indicator_id")).join(geo, "geography_id").join(ind, "indicator_id")
            .select("unit", "indicator", "year", "value"))
