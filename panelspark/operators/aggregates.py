"""Latest values, rankings, coverage and unit profiles."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelspark.functions.ranking import cumulative_counts, medians_from_counts, tie_positions
from panelspark.operators.views import unit_code
from panelspark.panel import Panel
from panelspark.schema import LEVEL_COUNTRY, PROFILE_INDICATORS
from panelspark.session import cut_lineage


def latest(df: DataFrame, annual: bool = False) -> DataFrame:
    """Most recent observation of each series. ``annual`` orders by year first;
    both break ties by period, so the result is repeatable."""
    order = [F.desc("year"), F.desc("t")] if annual else [F.desc("t"), F.desc("period")]
    w = Window.partitionBy("unit", "indicator").orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def ranking(latest_df: DataFrame, k: int, order: str = "highest") -> DataFrame:
    """Top or bottom k of the latest values (one indicator, or all of them)."""
    value = F.col("value").desc_nulls_last() if order == "highest" else F.col("value").asc_nulls_last()
    return latest_df.orderBy(value, "unit", "indicator").limit(k)


def bloc_rankings(latest_df: DataFrame, geography: DataFrame, bloc: DataFrame,
                  geography_bloc: DataFrame, current_only: bool = True) -> DataFrame:
    """Mean of the members' latest values per bloc and indicator."""
    members = geography_bloc.where(F.col("until_year").isNull()) if current_only else geography_bloc
    spans = (members.join(bloc.select(F.col("id").alias("bloc_id"), F.col("name").alias("bloc")), "bloc_id")
             .join(unit_code(geography).select(F.col("id").alias("geography_id"), "unit"), "geography_id")
             .select("unit", "bloc"))
    return (latest_df.join(spans, "unit").groupBy("indicator", "bloc")
            .agg(F.avg("value").alias("mean_value"), F.count(F.lit(1)).alias("countries")))


def coverage(panel: Panel, as_of_year: int, catalog: bool = False) -> DataFrame:
    """Rows, units, level and year span per indicator. Empty indicators stay in.

    ``catalog`` returns the provenance columns of the catalog table instead of
    level and staleness.
    """
    facts = panel.best.select("indicator_id", "geography_id", "year", "value")
    # distinct units: one row per (indicator, unit) first, so the count is map-side
    per_unit = facts.groupBy("indicator_id", "geography_id").agg(
        F.count("value").alias("_rows"), F.min("year").alias("_first"), F.max("year").alias("_last"))
    levels = panel.geography.select(F.col("id").alias("geography_id"), "level")
    stats = (per_unit.join(levels, "geography_id", "left").groupBy("indicator_id")
             .agg(F.sum("_rows").alias("rows"), F.count(F.lit(1)).alias("countries"),
                  F.min("level").alias("geo_level"),
                  F.min("_first").alias("first_year"), F.max("_last").alias("last_year")))
    dom = panel.domain.select(F.col("id").alias("domain_id"), F.col("name").alias("domain"))
    out = (panel.indicator.withColumnRenamed("id", "indicator_id").withColumnRenamed("name", "indicator")
           .join(dom, "domain_id").join(stats, "indicator_id", "left")
           .withColumn("rows", F.coalesce("rows", F.lit(0)))
           .withColumn("countries", F.coalesce("countries", F.lit(0))))
    if catalog:
        return out.select("indicator", "domain", "unit", "api_code", "definition", "is_proxy",
                          "proxy_note", "rows", "countries", "first_year", "last_year")
    return out.select("indicator", "domain", "is_proxy", "rows", "countries", "geo_level",
                      "first_year", "last_year", (F.lit(as_of_year) - F.col("last_year")).alias("years_stale"))


def coverage_matrix(df: DataFrame, years: Sequence[int]) -> DataFrame:
    """Distinct units per indicator and year, one column per year."""
    return (df.select("indicator", "year", "unit").distinct()
            .groupBy("indicator").pivot("year", list(years)).agg(F.count(F.lit(1))))


def unit_indicators(df: DataFrame) -> DataFrame:
    """Indicators present for each unit, with the last year."""
    return df.groupBy("unit", "indicator", "domain").agg(F.max("year").alias("last_year"))


def populated_indicators(panel: Panel) -> DataFrame:
    """Indicators with at least one best-view row, with row counts."""
    counts = panel.best.groupBy("indicator_id").agg(F.count("geography_id").alias("rows"))
    dom = panel.domain.select(F.col("id").alias("domain_id"), F.col("name").alias("domain"))
    return (panel.indicator.withColumnRenamed("id", "indicator_id").join(dom, "domain_id")
            .join(counts, "indicator_id", "left").where(F.col("rows") > 0)
            .select("name", "domain", "unit", "rows"))


def headline(latest_df: DataFrame, indicators: Sequence[str] = PROFILE_INDICATORS) -> DataFrame:
    """Value, rank (high to low, unit code breaks ties), field size and median.

    One indicator may hold a third of all units, and a third of those the same
    value, so ranks and medians come from banded counts, and only rows that tie
    are put in order by their code. The rows are read several times, hence written out first.
    """
    rows = cut_lineage(latest_df.where(F.col("indicator").isin(list(indicators)) & F.col("value").isNotNull())
                       .select("unit", "indicator", "value", "value_unit", "period"))
    counts = cumulative_counts(rows, ["indicator"], "value")
    medians = medians_from_counts(counts, ["indicator"], "value").select("indicator", "median")
    sizes = rows.groupBy("indicator", "value").agg(F.count(F.lit(1)).alias("_same"))
    marked = rows.join(sizes, ["indicator", "value"])
    tied = tie_positions(marked.where(F.col("_same") > 1), ["indicator", "value"], "unit")
    placed = marked.where(F.col("_same") == 1).withColumn("position", F.lit(1)).unionByName(tied)
    rank = F.col("n_total") - F.col("n_less") - F.col("n_ties") + F.col("position")
    return (placed.join(counts, ["indicator", "value"]).join(medians, "indicator")
            .select("unit", "indicator", "value", "value_unit", "period", rank.alias("rank"),
                    F.col("n_total").alias("of"), "median"))


def movers(df: DataFrame, levels: DataFrame, years: int = 10, min_peers: int = 5) -> DataFrame:
    """The most distinctive rise and fall of every unit.

    Change is taken over the trailing window, and its percentile among the
    indicator's peers uses average ranks. The top one counts only if it rose,
    the bottom one only if it fell. ``levels`` is (unit, level).
    """
    last = df.agg(F.max("year")).scalar()
    window = (df.where(F.col("value").isNotNull())
              .join(levels.where(F.col("level") == LEVEL_COUNTRY), "unit", "left_semi")
              .where(F.col("year") >= last - years))
    when = F.struct("year", "t")
    changes = (window.groupBy("unit", "indicator")
               .agg(F.min("year").alias("from_year"), F.max("year").alias("to_year"),
                    F.min("value_unit").alias("value_unit"),
                    (F.max_by("value", when) - F.min_by("value", when)).alias("change"))
               .where(F.col("from_year") < F.col("to_year")))
    changes = cut_lineage(changes)      # read twice: to count peers and to score
    counts = (cumulative_counts(changes, ["indicator"], "change")
              .where(F.col("n_total") >= min_peers)
              .withColumn("pct", (F.col("n_less") + (F.col("n_ties") + 1) / 2.0) / F.col("n_total"))
              .select("indicator", "change", "pct"))
    scored = changes.join(counts, ["indicator", "change"])
    fact = F.struct("indicator", "change", F.bround(F.col("pct") * 100.0).alias("percentile"),
                    F.col("value_unit").alias("unit"), "from_year", "to_year")
    picked = scored.groupBy("unit").agg(
        F.max_by(fact, F.struct(F.col("pct"), F.col("indicator"))).alias("top"),
        F.min_by(fact, F.struct(F.col("pct"), F.col("indicator"))).alias("bottom"))
    return picked.select(
        "unit", F.when(F.col("top.change") > 0, F.col("top")).alias("fastest_rising"),
        F.when(F.col("bottom.change") < 0, F.col("bottom")).alias("fastest_falling"))


def profiles(panel: Panel, series_df: DataFrame, latest_df: DataFrame, *,
             indicators: Sequence[str] = PROFILE_INDICATORS, trend_years: int = 10) -> DataFrame:
    """One nested row per unit: identity, blocs, headline figures, movers, coverage."""
    geo = unit_code(panel.geography)
    blocs = (panel.geography_bloc
             .join(panel.bloc.select(F.col("id").alias("bloc_id"), "code", "name"), "bloc_id")
             .groupBy("geography_id")
             .agg(F.array_sort(F.collect_list(F.struct("since_year", "code", "name", "until_year")))
                  .alias("blocs")))
    heads = (headline(latest_df, indicators).groupBy("unit")
             .agg(F.array_sort(F.collect_list(F.struct(
                 "indicator", "value", "value_unit", "period", "rank", "of", "median")))
                 .alias("headline")))
    moved = movers(series_df, geo.select("unit", "level"), trend_years)
    stats = (series_df.groupBy("unit", "indicator").agg(F.max("year").alias("_last"))
             .groupBy("unit").agg(F.count(F.lit(1)).alias("n_indicators"),
                                  F.max("_last").alias("last_year")))
    return (geo.select(F.col("id").alias("geography_id"), "unit", "iso2", "name")
            .join(blocs, "geography_id", "left").join(heads, "unit", "left")
            .join(moved, "unit", "left").join(stats, "unit", "left")
            .withColumn("n_indicators", F.coalesce("n_indicators", F.lit(0)))
            .drop("geography_id"))


def with_prefix(latest_df: DataFrame, prefix: str | Column) -> DataFrame:
    """Latest values of the regions whose code starts with a country prefix."""
    return latest_df.where(F.col("unit").startswith(prefix) & F.col("value").isNotNull())


def panel_stats(records: DataFrame) -> DataFrame:
    return records.agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"),
                       F.max("vintage_date").alias("max_vintage"), F.count(F.lit(1)).alias("rows"))


def freshness_badge(records: DataFrame, as_of_year: int, warn_years: int = 3) -> DataFrame:
    """One row: size, last year and vintage, age, and the badge's colour and text."""
    stats = panel_stats(records)
    age = F.lit(as_of_year) - F.col("last_year")
    text = F.when(F.col("last_year").isNull(), F.lit("empty")).otherwise(
        F.concat(F.format_number("rows", 0), F.lit(" rows · to "), F.col("last_year").cast("string")))
    text = F.when(F.col("max_vintage").isNull(), text).otherwise(
        F.concat(text, F.lit(" · "), F.col("max_vintage").cast("string")))
    return stats.select("rows", "last_year", "max_vintage", age.alias("age"),
                        F.when(age <= warn_years, "brightgreen").otherwise("yellow").alias("color"),
                        text.alias("message"))
