"""Series projection, filters and transforms."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelspark.functions.periods import decimal_year, period_label
from panelspark.functions.ranking import group_median
from panelspark.operators.views import unit_code
from panelspark.panel import Panel
from panelspark.schema import PanelLookupError
from panelspark.session import dealt

SERIES_KEY = ["unit", "indicator"]


def require_bloc(bloc: DataFrame, code: str) -> None:
    if bloc.where(F.upper("code") == code.upper()).limit(1).count() == 0:
        raise PanelLookupError(f"unknown bloc: {code!r}")


def in_bloc(df: DataFrame, bloc: DataFrame, geography_bloc: DataFrame, code: str,
            current_only: bool = True) -> DataFrame:
    """Rows of ``df`` (by geography_id) whose unit belongs to the bloc."""
    members = geography_bloc
    if current_only:
        members = members.where(F.col("until_year").isNull())
    wanted = bloc.where(F.upper("code") == code.upper()).select(F.col("id").alias("bloc_id"))
    return df.join(members.join(wanted, "bloc_id", "left_semi").select("geography_id"),
                   "geography_id", "left_semi")


def members_at(df: DataFrame, geography_bloc: DataFrame, bloc: DataFrame,
               bloc_col: str = "bloc_code", year_col: str = "year") -> DataFrame:
    """Adds ``geography_id`` for each unit that is a member in the row's year."""
    spans = (geography_bloc.join(bloc.select(F.col("id").alias("bloc_id"), F.col("code").alias(bloc_col)),
                                 "bloc_id")
             .select(bloc_col, "geography_id", "since_year", "until_year"))
    joined = df.join(spans, bloc_col)
    inside = ((F.col("since_year") <= F.col(year_col))
              & (F.col("until_year").isNull() | (F.col("until_year") > F.col(year_col))))
    return joined.where(inside).drop("since_year", "until_year")


def series_facts(panel: Panel, *, unit_ids: Sequence[int] | None = None,
                 indicator_ids: Sequence[int] | None = None, domain: str | None = None,
                 source: str | None = None, bloc: str | None = None,
                 start: int | None = None, end: int | None = None) -> DataFrame:
    """Best-source observations by id, without labels: what reductions should run on.

    Unit, indicator, bloc and year filters are applied to the window's partition
    keys, so Catalyst moves them below it, down to the scan. The source filter
    has to stay above: it picks among winners, not among candidates.
    """
    facts = panel.best
    if unit_ids is not None:
        facts = facts.where(F.col("geography_id").isin(list(unit_ids)))
    if indicator_ids is not None:
        facts = facts.where(F.col("indicator_id").isin(list(indicator_ids)))
    if start is not None:
        facts = facts.where(F.col("year") >= start)
    if end is not None:
        facts = facts.where(F.col("year") <= end)
    if bloc is not None:
        facts = in_bloc(facts, panel.bloc, panel.geography_bloc, bloc)
    if domain is not None:
        wanted = panel.domain.where(F.lower("name") == domain.lower()).select(F.col("id").alias("domain_id"))
        ids = panel.indicator.join(wanted, "domain_id").select(F.col("id").alias("indicator_id"))
        facts = facts.join(ids, "indicator_id", "left_semi")
    if source is not None:
        ids = panel.source.where(F.lower("name") == source.lower()).select(F.col("id").alias("source_id"))
        facts = facts.join(ids, "source_id", "left_semi")
    return facts


def labelled(panel: Panel, facts: DataFrame) -> DataFrame:
    """Observations by id with the names of unit, indicator, domain and source."""
    geo = unit_code(panel.geography).select(
        F.col("id").alias("geography_id"), F.col("unit").alias("_code"), F.col("name").alias("country"))
    dom = panel.domain.select(F.col("id").alias("domain_id"), F.col("name").alias("domain"))
    ind = panel.indicator.select(
        F.col("id").alias("indicator_id"), "domain_id", F.col("name").alias("indicator"),
        F.col("unit").alias("_default_unit"), "is_proxy", "proxy_note")
    src = panel.source.select(F.col("id").alias("source_id"), F.col("name").alias("source"))
    return (facts.join(ind, "indicator_id").join(dom, "domain_id").join(src, "source_id")
            .join(geo, "geography_id")
            .select(F.col("_code").alias("unit"), "country", "domain", "indicator", "year", "quarter", "month",
                    period_label().alias("period"), decimal_year().alias("t"), "value",
                    F.coalesce("unit", "_default_unit").alias("value_unit"), "source",
                    "is_proxy", "proxy_note"))


def series(panel: Panel, *, ordered: bool = False, **filters) -> DataFrame:
    """Best-source observations with labels; the filters are those of ``series_facts``."""
    out = labelled(panel, series_facts(panel, **filters))
    return out.orderBy("indicator", "unit", "t") if ordered else out


def latest_series(panel: Panel, *, annual: bool = False, **filters) -> DataFrame:
    """The most recent observation of each series, labelled after the reduction.

    ``annual`` orders by year first; both break ties by period, so the result is repeatable.
    """
    order = [F.desc("year"), decimal_year().desc()] if annual else [decimal_year().desc(), period_label().desc()]
    w = Window.partitionBy("geography_id", "indicator_id").orderBy(*order)
    facts = series_facts(panel, **filters)
    return labelled(panel, facts.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn"))


def yoy_series(panel: Panel, **filters) -> DataFrame:
    """Percent change on the same period a year earlier, joined by id and labelled last.

    Missing or zero bases drop out.
    """
    facts = series_facts(panel, **filters)
    key = ["geography_id", "indicator_id", "year", "quarter", "month"]
    base = facts.select(*key[:2], (F.col("year") + 1).alias("year"), *key[3:], F.col("value").alias("_base")).where(
        F.col("_base") != 0)
    moved = facts.join(base, key).withColumn("value", (F.col("value") / F.col("_base") - 1.0) * 100.0).select(*facts.columns)
    return labelled(panel, moved).withColumn("value_unit", F.lit("% y/y"))


def narrow_series(df: DataFrame, units: Sequence[str], indicator: str) -> DataFrame:
    """(year, unit, value) of some units for one indicator."""
    return (df.where(F.col("unit").isin(list(units)) & (F.col("indicator") == indicator))
            .select("year", "unit", "value"))


def yoy(df: DataFrame) -> DataFrame:
    """Percent change on the same period a year earlier. Missing or zero bases drop out."""
    key = [*SERIES_KEY, "year", "quarter", "month"]
    base = df.select(*SERIES_KEY, (F.col("year") + 1).alias("year"), "quarter", "month",
                     F.col("value").alias("_base")).where(F.col("_base") != 0)
    change = (F.col("value") / F.col("_base") - 1.0) * 100.0
    return (df.join(base, key)
            .withColumn("value", change).withColumn("value_unit", F.lit("% y/y"))
            .select(*df.columns))


def rebase(df: DataFrame, base_year: int) -> DataFrame:
    """Index each series to 100 at the mean of its base-year observations."""
    base = (df.where(F.col("year") == base_year).groupBy(*SERIES_KEY)
            .agg(F.avg("value").alias("_base")).where(F.col("_base") != 0))
    return (df.join(base, SERIES_KEY)
            .withColumn("value", F.col("value") / F.col("_base") * 100.0)
            .withColumn("value_unit", F.lit(f"index ({base_year}=100)"))
            .select(*df.columns))


def growth(df: DataFrame, scale: float = 100.0, strict_gap: bool = False,
           keys: Sequence[str] = ("unit", "indicator")) -> DataFrame:
    """Change on the previous observation of the series, in year order.

    Positional by default: a gap counts as one step. ``strict_gap`` keeps only
    steps of exactly one year. A series holds at most one row per year here, so
    its window is bounded by the calendar.
    """
    w = Window.partitionBy(*keys).orderBy("year")
    ratio = F.try_divide(F.col("value"), F.lag("value").over(w))
    out = df.withColumn("growth", (ratio - 1.0) * scale)
    if strict_gap:
        out = out.withColumn("growth", F.when(F.col("year") - F.lag("year").over(w) == 1,
                                              F.col("growth")))
    keep = F.col("growth").isNotNull() & ~F.isnan("growth")
    return out.where(keep).select(*keys, "year", "growth")


def compare(df: DataFrame, units: Sequence[str], indicator: str, *,
            start: int | None = None, end: int | None = None) -> DataFrame:
    """Wide period x unit table. The row key is the year when every year holds
    one period, else the period label; duplicates are averaged."""
    rows = df.where(F.col("unit").isin(list(units)) & (F.col("indicator") == indicator))
    if start is not None:
        rows = rows.where(F.col("year") >= start)
    if end is not None:
        rows = rows.where(F.col("year") <= end)
    annual = rows.agg(F.countDistinct("period") == F.countDistinct("year")).scalar()
    return (rows
            .withColumn("period", F.when(annual, F.col("year").cast("string"))
                        .otherwise(F.col("period")))
            .groupBy("period").pivot("unit", list(units)).agg(F.avg("value")))


def trends(frame: DataFrame, indicators: Sequence[str], *, start: int | None = None,
           end: int | None = None, rebased: bool = True) -> DataFrame:
    """Cross-unit median per indicator and year, indexed to 100 at the first
    year every indicator covers. Empty if an indicator has no data or no year is shared.

    ``frame`` is (unit, indicator, year, value).
    """
    wanted = sorted(set(indicators))
    rows = frame.where(F.col("indicator").isin(wanted))
    if start is not None:
        rows = rows.where(F.col("year") >= start)
    if end is not None:
        rows = rows.where(F.col("year") <= end)
    medians = (group_median(rows, ["indicator", "year"], "value")
               .withColumnRenamed("n_total", "n_countries"))
    # from here on there is one row per indicator and year
    covered = F.count(F.lit(1)).over(Window.partitionBy("year")) == len(wanted)
    out = (medians.withColumn("_covered", covered)
           .withColumn("base_year", F.min(F.when(F.col("_covered"), F.col("year"))).over(Window.partitionBy(F.lit(0))))
           .where(F.col("base_year").isNotNull()))
    if rebased:
        base = F.max(F.when(F.col("year") == F.col("base_year"), F.col("median"))).over(Window.partitionBy("indicator"))
        out = out.withColumn("median", F.try_divide("median", F.nullif(base, F.lit(0.0))) * 100.0)
    return out.select("indicator", "year", F.col("median").alias("value"), "n_countries", "base_year")


def observation_matrix(df: DataFrame, indicators: Sequence[str]) -> DataFrame:
    """(unit, year) x indicator, mean. The columns are given, so no extra job lists them.

    A unit's year holds few values, so rows are dealt by it over all tasks: the means and the wide rows need no other shuffle.
    """
    return (dealt(df.select("unit", "year", "indicator", "value"), "unit", "year")
            .groupBy("unit", "year").pivot("indicator", list(indicators))
            .agg(F.avg("value")))


def span_change(df: DataFrame) -> DataFrame:
    """First and last observation of each series and the change between them."""
    order = F.struct("t", "period")
    out = df.where(F.col("value").isNotNull()).groupBy(*SERIES_KEY).agg(
        F.min_by("period", order).alias("first_period"), F.min_by("value", order).alias("first_value"),
        F.max_by("period", order).alias("last_period"), F.max_by("value", order).alias("last_value"))
    change = F.col("last_value") - F.col("first_value")
    return (out.withColumn("net_change", change)
            .withColumn("pct_change", F.try_divide(change, F.abs("first_value")) * 100.0))


def kpi(df: DataFrame) -> DataFrame:
    """Latest value of each series and its percent change on the observation before it."""
    w = Window.partitionBy(*SERIES_KEY).orderBy(F.desc("year"), F.desc("t"))
    latest_two = df.withColumn("_rn", F.row_number().over(w)).where("_rn <= 2")
    return (latest_two.groupBy(*SERIES_KEY)
            .agg(F.max(F.when(F.col("_rn") == 1, F.col("value"))).alias("value"),
                 F.max(F.when(F.col("_rn") == 1, F.col("year"))).alias("year"),
                 F.max(F.when(F.col("_rn") == 1, F.col("value_unit"))).alias("value_unit"),
                 F.max(F.when(F.col("_rn") == 2, F.col("value"))).alias("_prev"))
            .withColumn("yoy", F.try_divide(F.col("value") - F.col("_prev"), F.abs("_prev")) * 100.0)
            .drop("_prev"))


def years_clause(start: int | None, end: int | None) -> Column:
    cond = F.lit(True)
    if start is not None:
        cond = cond & (F.col("year") >= start)
    if end is not None:
        cond = cond & (F.col("year") <= end)
    return cond
