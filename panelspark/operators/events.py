"""Dated events: filters, scope expansion and before/after studies."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelspark.functions.periods import mid_tick
from panelspark.functions.text import has_tag
from panelspark.functions.timeline import totals_before
from panelspark.operators.views import unit_code
from panelspark.schema import LEVEL_COUNTRY


def events(event: DataFrame, *, event_type: str | None = None, bloc: str | None = None,
           since: str | None = None, until: str | None = None, tag: str | None = None) -> DataFrame:
    out = event
    if event_type is not None:
        out = out.where(F.lower("event_type") == event_type.lower())
    if bloc is not None:
        out = out.where(F.upper("bloc_code") == bloc.upper())
    if since is not None:
        out = out.where(F.col("start_date") >= F.lit(since).cast("date"))
    if until is not None:
        out = out.where(F.col("start_date") <= F.lit(until).cast("date"))
    if tag is not None:
        out = out.where(has_tag(F.col("tags"), tag))
    return out


def _scope(iso3: Column, bloc_code: Column) -> Column:
    """The one scope key of an event: its country, else its bloc, else everyone."""
    return (F.when(iso3.isNotNull(), F.concat(F.lit("unit:"), iso3))
            .when(bloc_code.isNotNull(), F.concat(F.lit("bloc:"), bloc_code)).otherwise(F.lit("all")))


def _unit_scopes(geography: DataFrame, bloc: DataFrame, geography_bloc: DataFrame) -> DataFrame:
    """(unit, scope, since_year, until_year): every scope that reaches a country."""
    countries = geography.where((F.col("level") == LEVEL_COUNTRY) & F.col("iso3").isNotNull())
    none = F.lit(None).cast("int")
    own = countries.select(F.col("iso3").alias("unit"), F.concat(F.lit("unit:"), "iso3").alias("scope"),
                           none.alias("since_year"), none.alias("until_year"))
    everyone = countries.select(F.col("iso3").alias("unit"), F.lit("all").alias("scope"),
                                none.alias("since_year"), none.alias("until_year"))
    members = (geography_bloc.join(countries.select(F.col("id").alias("geography_id"), "iso3"), "geography_id")
               .join(bloc.select(F.col("id").alias("bloc_id"), "code"), "bloc_id")
               .select(F.col("iso3").alias("unit"), F.concat(F.lit("bloc:"), "code").alias("scope"),
                       F.coalesce("since_year", F.lit(9999)).alias("since_year"), "until_year"))
    return own.unionByName(everyone).unionByName(members)


def expand_events(event: DataFrame, geography: DataFrame, bloc: DataFrame,
                  geography_bloc: DataFrame) -> DataFrame:
    """One row per event and unit: its country, its bloc's members in the event
    year, or every country. All three cases are one equi-join on a scope key."""
    year = F.year("start_date")
    inside = (F.col("since_year").isNull()
              | ((F.col("since_year") <= year) & (F.col("until_year").isNull() | (F.col("until_year") > year))))
    return (event.withColumn("scope", _scope(F.col("iso3"), F.col("bloc_code")))
            .join(_unit_scopes(geography, bloc, geography_bloc), "scope").where(inside)
            .drop("scope", "since_year", "until_year"))


def events_for(event: DataFrame, geography: DataFrame, bloc: DataFrame, geography_bloc: DataFrame) -> DataFrame:
    """Events that concern each unit: its own, those of everyone, those of its
    current blocs."""
    scopes = (_unit_scopes(geography, bloc, geography_bloc)
              .where(F.col("until_year").isNull()).select("unit", "scope").distinct())
    return (event.withColumn("scope", _scope(F.col("iso3"), F.col("bloc_code")))
            .join(scopes, "scope").drop("scope"))


def event_types(event: DataFrame) -> DataFrame:
    return event.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))


def _effect(before: Column, after: Column) -> list[Column]:
    delta = after - before
    return [before.alias("before_mean"), after.alias("after_mean"), delta.alias("delta"),
            (F.try_divide(delta, F.abs(before)) * 100.0).alias("pct_change")]


def event_study(expanded: DataFrame, series: DataFrame, window_years: int = 3) -> DataFrame:
    """Mean before and after each (event, unit, indicator).

    Observations sit at their period midpoint, events at the middle of their
    month: before is [e - w, e), after is [e, e + w]; both must hold something.
    Time is counted in whole half-months. Events are joined to the calendar
    years their window touches, so the join is an equality on (unit, year
    bucket) and an event meets at most 12 * (2w + 2) periods of a series.
    """
    width = 24 * window_years
    tick = F.year("start_date") * 24 + F.month("start_date") * 2 - 1
    spots = (expanded.select(F.col("code").alias("event_code"), F.col("title").alias("event_title"),
                             F.year("start_date").alias("event_year"), "unit", tick.alias("_e"))
             .withColumn("_bucket", F.explode(F.sequence(
                 F.floor((F.col("_e") - width) / 24), F.floor((F.col("_e") + width) / 24)))))
    obs = (series.where(F.col("value").isNotNull())
           .select("unit", "indicator", "value", mid_tick().alias("_t"))
           .withColumn("_bucket", F.floor(F.col("_t") / 24)))
    gap = F.col("_t") - F.col("_e")
    before = (gap >= -width) & (gap < 0)
    after = (gap >= 0) & (gap <= width)
    out = (spots.join(obs, ["unit", "_bucket"]).where(before | after)
           .groupBy("event_code", "event_title", "event_year", "unit", "indicator")
           .agg(F.avg(F.when(before, F.col("value"))).alias("_b"),
                F.avg(F.when(after, F.col("value"))).alias("_a"),
                F.count(F.when(before, 1)).alias("n_before"), F.count(F.when(after, 1)).alias("n_after"))
           .where((F.col("n_before") > 0) & (F.col("n_after") > 0)))
    return out.select("event_code", "event_title", "event_year", "unit", "indicator",
                      *_effect(F.col("_b"), F.col("_a")), "n_before", "n_after")


def point_event_study(events: DataFrame, observations: DataFrame, *, window: int, chunk: int) -> DataFrame:
    """The same study for raw events and raw observations of any density.

    ``events`` is (event_code, unit, tick), ``observations`` (unit, tick, value),
    ticks and window in the same whole units. Matching each event of a busy unit
    with each observation in reach would be quadratic; instead the totals up to
    the window's three edges are read off the unit's timeline and subtracted.
    """
    edges = F.array(F.struct(F.lit("start").alias("edge"), (F.col("tick") - window).alias("at")),
                    F.struct(F.lit("event").alias("edge"), F.col("tick").alias("at")),
                    # closed end: up to and including tick + window
                    F.struct(F.lit("end").alias("edge"), (F.col("tick") + window + 1).alias("at")))
    probes = events.select("unit", "event_code", F.explode(edges).alias("e")).select(
        "unit", "event_code", "e.edge", "e.at")
    obs = observations.select("unit", F.col("tick").alias("at"), "value")
    read = (totals_before(obs, probes, ["unit"], chunk).groupBy("event_code", "unit")
            .agg(*[F.max(F.when(F.col("edge") == e, F.col(c))).alias(f"{c}_{e}")
                   for e in ("start", "event", "end") for c in ("sum_before", "n_before")]))
    n_b = F.col("n_before_event") - F.col("n_before_start")
    n_a = F.col("n_before_end") - F.col("n_before_event")
    mean_b = (F.col("sum_before_event") - F.col("sum_before_start")).cast("double") / n_b
    mean_a = (F.col("sum_before_end") - F.col("sum_before_event")).cast("double") / n_a
    return (read.where((n_b > 0) & (n_a > 0))
            .select("event_code", "unit", *_effect(mean_b, mean_a), n_b.alias("n_before"), n_a.alias("n_after")))


def most_affected(study: DataFrame, k: int, by: str = "delta") -> DataFrame:
    """Top k by absolute delta or percent change."""
    return study.orderBy(F.abs(by).desc_nulls_last(), "event_code", "unit", "indicator").limit(k)


def markers(event: DataFrame, series: DataFrame, k: int = 6) -> DataFrame:
    """The first ``k`` events inside each series' year span.

    Only the span of a series matters, and many series share one: candidates are
    picked per distinct span, then joined to the series that have it.
    """
    spans = (series.where(F.col("value").isNotNull()).groupBy("unit", "indicator")
             .agg(F.min("year").alias("_y0"), F.max("year").alias("_y1")))
    # at most k events per year can ever be shown, whatever the span
    w = Window.partitionBy("year").orderBy("start_date", "code")
    firsts = (event.select("code", "title", "start_date", F.year("start_date").alias("year"))
              .withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn"))
    distinct = spans.select("_y0", "_y1").distinct()
    years = distinct.withColumn("year", F.explode(F.sequence("_y0", "_y1")))
    order = Window.partitionBy("_y0", "_y1").orderBy("start_date", "code")
    shown = (years.join(firsts, "year").withColumn("position", F.row_number().over(order))
             .where(F.col("position") <= k))
    return (spans.join(shown, ["_y0", "_y1"])
            .select("unit", "indicator", "position", "code", "title", "year"))


def countries_of(geography: DataFrame) -> DataFrame:
    return unit_code(geography).where(F.col("level") == LEVEL_COUNTRY).select("unit")
