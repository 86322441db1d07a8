"""Correlation, lag and causality mining over (unit, indicator, year, growth) frames.

A series is one row: its first year and an array of values. Series of a unit meet as such rows, one per
indicator pair and unit, and every statistic is a fold over the two aligned arrays: years never become rows
again. No aggregation sits on the join, so a unit with many indicators is split like any skewed join.
"""
from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelspark.functions.ranking import benjamini_hochberg
from panelspark.functions.stats import (P_FLOOR, chi2_even_sf, correlation, f1_p, fisher_z, moment_correlation, moments,
                                        normal_two_sided_p, pearson_stats)
from panelspark.operators.series import growth
from panelspark.session import cut_lineage

# Least points per unit, units per pair, and the two significance levels.
MIN_POINTS = 8
MIN_UNITS = 3
FDR_ALPHA = 0.05
GRANGER_ALPHA = 0.05
LAG_TESTS = ("contemporaneous", "a_leads_b", "b_leads_a")
PAIR = ["indicator_a", "indicator_b"]


def lagged_correlation(frame: DataFrame, pairs: DataFrame, *, lag: int = 0, min_years: int = 10,
                       on: str = "growth") -> DataFrame:
    """Per unit and pair, Pearson r of a(t) with b(t + lag), with p-value and interval.

    ``pairs`` is (indicator_a, indicator_b). Units with fewer than ``min_years``
    shared points or a constant side drop out.
    """
    if on not in ("growth", "levels"):
        raise ValueError(f"no such basis of correlation: {on!r}")
    points = (growth(frame).withColumnRenamed("growth", "v") if on == "growth"
              else frame.select("unit", "indicator", "year", F.col("value").alias("v")))
    a = (points.join(pairs, points["indicator"] == pairs["indicator_a"])
         .select("unit", *PAIR, "year", F.col("v").alias("a")))
    b = points.select("unit", F.col("indicator").alias("indicator_b"), (F.col("year") - lag).alias("year"),
                      F.col("v").alias("b"))
    stats = (a.join(b, ["unit", "indicator_b", "year"]).groupBy(*PAIR, "unit")
             .agg(F.count(F.lit(1)).alias("n_years"), correlation("a", "b").alias("correlation"))
             .where((F.col("n_years") >= min_years) & F.col("correlation").isNotNull()))
    return (stats.withColumn("_s", pearson_stats(F.col("correlation"), F.col("n_years")))
            .select(*PAIR, "unit", "n_years", "correlation", "_s.p_value", "_s.ci_low", "_s.ci_high",
                    F.lit(lag).alias("lag")))


def correlate(frame: DataFrame, pairs: DataFrame, *, min_years: int = 10, on: str = "growth") -> DataFrame:
    return lagged_correlation(frame, pairs, lag=0, min_years=min_years, on=on)


def fisher_pool(df: DataFrame, keys: list[str]) -> DataFrame:
    """Fixed-effect pool of per-unit r (columns r, n) by Fisher z with weight n - 3."""
    weight = (F.col("n") - 3).cast("double")
    pooled = df.groupBy(*keys).agg(F.sum(fisher_z(F.col("r")) * weight).alias("_zw"), F.sum(weight).alias("_w"),
                                   F.count(F.lit(1)).alias("n_units"))
    z_bar = F.try_divide("_zw", "_w")
    z = z_bar * F.sqrt("_w")
    return pooled.select(*keys, F.tanh(z_bar).alias("pooled_r"), normal_two_sided_p(z).alias("pooled_p"),
                         F.abs(z).alias("abs_z"), "n_units")


def _as_arrays(points: DataFrame, value: str = "growth") -> DataFrame:
    """(unit, indicator, y0, v): every series as one array from its first year on, gaps null."""
    listed = points.groupBy("unit", "indicator").agg(
        F.array_sort(F.collect_list(F.struct("year", F.col(value).alias("v")))).alias("_p"))
    placed = F.flatten(F.transform("_p", lambda p, i: F.concat(
        F.array_repeat(F.lit(None).cast("double"), p["year"] - F.coalesce(F.get("_p", i - 1)["year"], p["year"] - 1) - 1),
        F.array(p["v"].cast("double")))))
    return listed.select("unit", "indicator", F.get("_p", 0)["year"].alias("y0"), placed.alias("v"))


def _side(rows: DataFrame, name: str) -> DataFrame:
    return rows.select("unit", F.col("indicator").alias(f"indicator_{name}"), F.col("y0").alias(f"y_{name}"), F.col("v").alias(name))


def _met(rows: DataFrame) -> DataFrame:
    """Every two series of a unit, the alphabetically first as a."""
    return _side(rows, "a").join(_side(rows, "b").hint("merge"), "unit").where(F.col("indicator_a") < F.col("indicator_b"))


def _aligned(lag: int = 0) -> Column:
    """Array of (a, b): the values of a at t and of b at t + lag, over the years that both arrays span."""
    low = F.greatest(F.col("y_a"), F.col("y_b") - lag)
    high = F.least(F.col("y_a") + F.size("a"), F.col("y_b") + F.size("b") - lag)
    n = F.greatest(high - low, F.lit(0))
    return F.arrays_zip(F.slice("a", low - F.col("y_a") + 1, n).alias("a"), F.slice("b", low + lag - F.col("y_b") + 1, n).alias("b"))


_AB = {"a": lambda p: p["a"], "b": lambda p: p["b"]}
_AB_PRODUCTS = [("a", "a"), ("b", "b"), ("a", "b")]


def unit_lag_correlations(growths: DataFrame, min_points: int = MIN_POINTS) -> DataFrame:
    """(indicator_a, indicator_b, test, unit, r, n) at lags 0, +1 and -1: three folds over the arrays of a pair."""
    met = _met(_as_arrays(growths))
    lags = {test: lag for test, lag in zip(LAG_TESTS, (0, 1, -1))}
    folded = met.select("unit", *PAIR, *[moments(_aligned(lag), _AB, _AB_PRODUCTS).alias(test) for test, lag in lags.items()])
    tests = F.array(*[F.struct(F.lit(test).alias("test"), moment_correlation(F.col(test), "a", "b").alias("r"),
                               F.col(test)["n"].cast("long").alias("n")) for test in LAG_TESTS])
    kept = F.filter(tests, lambda t: (t["n"] >= min_points) & t["r"].isNotNull())
    return folded.select(*PAIR, "unit", F.explode(kept).alias("_t")).select(*PAIR, "unit", "_t.*")


def pooled_lags(growths: DataFrame, *, min_points: int = MIN_POINTS, min_units: int = MIN_UNITS) -> DataFrame:
    """The pooled test of every pair and lag that enough units contribute to."""
    return fisher_pool(unit_lag_correlations(growths, min_points), [*PAIR, "test"]).where(
        F.col("n_units") >= min_units)


def select_lag(pooled: DataFrame) -> DataFrame:
    """Strongest test per pair and its p-value times the number of tests tried (capped at 1).

    Strength is |z|: p-values underflow to ties, |z| does not. The remaining
    ties fall to the order contemporaneous, a leads b, b leads a.
    """
    order = F.array_position(F.array(*map(F.lit, LAG_TESTS)), F.col("test"))
    best = F.max_by(F.struct("test", "pooled_r", "pooled_p", "n_units"), F.struct("abs_z", -order))
    return (pooled.groupBy(*PAIR).agg(best.alias("_b"), F.count(F.lit(1)).alias("n_tests"))
            .select(*PAIR, F.col("_b.test").alias("relationship"), F.col("_b.pooled_r").alias("weight"),
                    F.least(F.lit(1.0), F.col("_b.pooled_p") * F.col("n_tests")).alias("p_value"),
                    F.col("_b.n_units").alias("n_units"), "n_tests"))


def bh_fdr(df: DataFrame, p: str = "p_value") -> DataFrame:
    """Adds ``q_value``: Benjamini-Hochberg over all rows."""
    return benjamini_hochberg(df, p)


def granger(growths: DataFrame, pairs: DataFrame | None = None, min_points: int = MIN_POINTS) -> DataFrame:
    """Lag-1 Granger F-test p-values per pair and unit, both directions.

    The F statistic of adding x(t-1) to a regression of y(t) on y(t-1) follows
    from three correlations: F = v r2 / (1 - r2), r the partial correlation of
    y(t) and x(t-1) given y(t-1), v = n - 4 for n shared points. Lags are
    positional among shared points, and a (pair, unit) group holds at most one
    point per year.
    """
    rows = _as_arrays(growths)
    if pairs is None:
        met = _met(rows)
    else:
        met = _side(rows, "a").join(pairs.select(*PAIR).distinct(), "indicator_a").join(
            _side(rows, "b").hint("merge"), ["unit", "indicator_b"]).where(F.col("indicator_a") < F.col("indicator_b"))
    shared = met.select("unit", *PAIR, F.filter(_aligned(), lambda p: p["a"].isNotNull() & p["b"].isNotNull()).alias("_s")).where(
        F.size("_s") >= min_points)
    steps = F.arrays_zip(F.slice("_s", F.lit(2), F.size("_s") - 1).alias("now"), F.slice("_s", F.lit(1), F.size("_s") - 1).alias("old"))
    fields = {"a": lambda p: p["now"]["a"], "b": lambda p: p["now"]["b"], "la": lambda p: p["old"]["a"], "lb": lambda p: p["old"]["b"]}
    products = [(f, f) for f in fields] + [("la", "lb"), ("a", "la"), ("b", "lb"), ("b", "la"), ("a", "lb")]
    folded = shared.select("unit", *PAIR, F.size("_s").cast("long").alias("n"), moments(steps, fields, products).alias("_m"))
    stats = folded.select("unit", *PAIR, "n", *[moment_correlation(F.col("_m"), x, y).alias(name) for name, x, y in (
        ("_lalb", "la", "lb"), ("_aa", "a", "la"), ("_bb", "b", "lb"), ("_ba", "b", "la"), ("_ab", "a", "lb"))])

    def f_statistic(y_x: str, y_own: str) -> Column:
        top = F.col(y_x) - F.col(y_own) * F.col("_lalb")
        below = (F.lit(1.0) - F.col(y_own) * F.col(y_own)) * (F.lit(1.0) - F.col("_lalb") * F.col("_lalb"))
        r2 = F.try_divide(top * top, F.nullif(F.greatest(below, F.lit(0.0)), F.lit(0.0)))
        f = F.try_divide(r2 * F.col("_v"), F.nullif(F.lit(1.0) - r2, F.lit(0.0)))
        return F.when(f >= 0, f)

    # columns of their own, so the p-value series do not re-evaluate them at every step
    ready = (stats.withColumn("_v", (F.col("n") - 4).cast("int"))
             .withColumn("_f_ab", f_statistic("_ba", "_bb")).withColumn("_f_ba", f_statistic("_ab", "_aa")))
    return ready.select(*PAIR, "unit", "n", f1_p(F.col("_f_ab"), F.col("_v")).alias("p_a_to_b"),
                        f1_p(F.col("_f_ba"), F.col("_v")).alias("p_b_to_a"))


def fisher_combine(df: DataFrame, keys: list[str], p: str, name: str) -> DataFrame:
    """Fisher's method over the non-null p-values of each group."""
    # Nulls are passed over inside the aggregate: a filter on p would be pushed below whatever computes p, and copy it there.
    log_p = F.when(F.col(p).isNotNull(), F.ln(F.greatest(F.col(p), F.lit(P_FLOOR))))
    sums = df.groupBy(*keys).agg((F.sum(log_p) * -2.0).alias("_x"), F.count(p).alias("_k")).where(F.col("_k") > 0)
    return sums.select(*keys, chi2_even_sf(F.col("_x"), F.col("_k")).alias(name), F.col("_k").alias(f"{name}_n"))


def pooled_granger(detail: DataFrame) -> DataFrame:
    """Both directions combined over units, one pass."""
    def part(p: str) -> list[Column]:
        return [F.sum(F.ln(F.greatest(F.col(p), F.lit(P_FLOOR)))).alias(f"_x_{p}"), F.count(p).alias(f"_k_{p}")]

    sums = detail.groupBy(*PAIR).agg(*part("p_a_to_b"), *part("p_b_to_a"))
    return sums.select(*PAIR, *[chi2_even_sf(F.col(f"_x_{p}") * -2.0, F.col(f"_k_{p}")).alias(f"granger_{p}")
                                for p in ("p_a_to_b", "p_b_to_a")])


def direction(relationship: Column, p_ab: Column, p_ba: Column, alpha: float = GRANGER_ALPHA) -> Column:
    """A leader is named only if a lag won and causality is one-sided that way."""
    return (F.when((relationship == "a_leads_b") & (p_ab < alpha) & (p_ba >= alpha), "a_leads_b")
            .when((relationship == "b_leads_a") & (p_ba < alpha) & (p_ab >= alpha), "b_leads_a")
            .otherwise("undetermined"))


class Mined(NamedTuple):
    """Surviving edges, and the per-unit evidence behind them as rows."""

    edges: DataFrame
    evidence: DataFrame


def mine_edges(growths: DataFrame, *, alpha: float = FDR_ALPHA, min_points: int = MIN_POINTS,
               min_units: int = MIN_UNITS) -> Mined:
    """Pairs whose strongest pooled relationship survives FDR over all pairs, with
    leader and follower where causality confirms one.

    What is read more than once is written out: the per-unit correlations, the significant pairs
    and the causality detail. Evidence stays in rows, one per edge and unit; ``nest_evidence`` packs it per edge.
    """
    per_unit = cut_lineage(unit_lag_correlations(growths, min_points))
    tested = select_lag(fisher_pool(per_unit, [*PAIR, "test"]).where(F.col("n_units") >= min_units))
    significant = cut_lineage(bh_fdr(tested).where(F.col("q_value") <= alpha))
    lagged = significant.where(F.col("relationship") != LAG_TESTS[0])
    detail = cut_lineage(granger(growths, lagged, min_points))
    a, b = F.col("indicator_a"), F.col("indicator_b")
    edges = (significant.join(pooled_granger(detail), PAIR, "left")
             .withColumn("direction", direction(F.col("relationship"), F.col("granger_p_a_to_b"),
                                                F.col("granger_p_b_to_a")))
             .withColumn("leader", F.when(F.col("direction") == "a_leads_b", a)
                         .when(F.col("direction") == "b_leads_a", b))
             .withColumn("follower", F.when(F.col("direction") == "a_leads_b", b)
                         .when(F.col("direction") == "b_leads_a", a)))
    winners = per_unit.join(significant.select(*PAIR, F.col("relationship").alias("test")), [*PAIR, "test"],
                            "left_semi")
    evidence = winners.join(detail.select(*PAIR, "unit", "p_a_to_b", "p_b_to_a"), [*PAIR, "unit"], "left").select(
        *PAIR, "unit", F.col("test").alias("relationship"), F.round("r", 4).alias("correlation"),
        F.col("n").alias("n_years"), F.col("p_a_to_b").alias("granger_p_a_to_b"),
        F.col("p_b_to_a").alias("granger_p_b_to_a"))
    return Mined(edges, evidence)


def nest_evidence(evidence: DataFrame) -> DataFrame:
    """Evidence as one array per edge: for panels whose units are a catalog, such as countries."""
    item = F.struct("unit", "relationship", "correlation", "n_years", "granger_p_a_to_b", "granger_p_b_to_a")
    return evidence.groupBy(*PAIR).agg(F.array_sort(F.collect_list(item)).alias("per_unit"))


def edge_listing(edges: DataFrame, indicator_domains: DataFrame, indicator: str | None = None) -> DataFrame:
    """Edges with both domains, strongest first; optionally those touching one indicator.

    ``indicator_domains`` is (indicator, domain).
    """
    out = edges
    if indicator is not None:
        out = out.where((F.col("indicator_a") == indicator) | (F.col("indicator_b") == indicator))
    dom_a = indicator_domains.select(F.col("indicator").alias("indicator_a"), F.col("domain").alias("domain_a"))
    dom_b = indicator_domains.select(F.col("indicator").alias("indicator_b"), F.col("domain").alias("domain_b"))
    return (out.join(dom_a, "indicator_a").join(dom_b, "indicator_b")
            .select(*PAIR, "domain_a", "domain_b", "weight", "relationship", "direction", "q_value", "n_units")
            .orderBy(F.desc(F.abs("weight")), *PAIR))


def local_correlations(growths: DataFrame, edges: DataFrame, *, min_years: int = MIN_POINTS,
                       limit: int | None = None) -> DataFrame:
    """Each unit's own correlation for the surviving pairs; on request the strongest ``limit`` per unit."""
    rows = _as_arrays(growths)
    met = _side(rows, "a").join(edges.select(*PAIR, "relationship", "q_value"), "indicator_a").join(
        _side(rows, "b"), ["unit", "indicator_b"])
    folded = met.select("unit", *PAIR, "relationship", "q_value", moments(_aligned(), _AB, _AB_PRODUCTS).alias("_m"))
    stats = (folded.select("unit", *PAIR, "relationship", "q_value", moment_correlation(F.col("_m"), "a", "b").alias("correlation"),
                           F.col("_m.n").cast("long").alias("n_years"))
             .where((F.col("n_years") >= min_years) & F.col("correlation").isNotNull())
             .withColumn("p_value", pearson_stats(F.col("correlation"), F.col("n_years"))["p_value"]))
    if limit is None:
        return stats
    w = Window.partitionBy("unit").orderBy(F.desc(F.abs("correlation")), *PAIR)
    return stats.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit).drop("_rn")


def correlation_matrix(frame: DataFrame, min_pairs: int = 30) -> DataFrame:
    """Pearson r of every indicator pair over pooled (unit, year) observations,
    pairwise complete; the diagonal and both triangles, as (indicator_a, indicator_b, r, n)."""
    # Deviations from the indicator's mean: what is added up over units then stays near zero.
    centre = frame.groupBy("indicator").agg(F.avg("value").alias("_c"))
    rows = _as_arrays(frame.join(centre, "indicator").withColumn("_v", F.col("value") - F.col("_c")), "_v")
    met = _side(rows, "a").join(_side(rows, "b").hint("merge"), "unit").where(F.col("indicator_a") <= F.col("indicator_b"))
    m = F.col("_m")
    units = met.select(*PAIR, moments(_aligned(), _AB, _AB_PRODUCTS).alias("_m")).where("_m.n > 0")
    # Equal values all over a pair have no deviation, in a unit or between units; sums would leave a trace of rounding.
    flat = [F.min(m["m_" + x]) == F.max(m["m_" + x]) for x in "ab"]
    totals = units.groupBy(*PAIR).agg(
        F.sum(m["n"]).alias("n"), *[F.sum(m["n"] * m[f"m_{x}"]).alias(f"t_{x}") for x in "ab"],
        *[F.sum(m[f"s_{x}_{y}"] + m["n"] * m[f"m_{x}"] * m[f"m_{y}"]).alias(f"q_{x}_{y}") for x, y in _AB_PRODUCTS],
        *[(f & (F.max(m[f"s_{x}_{x}"]) == 0.0)).alias(f"flat_{x}") for x, f in zip("ab", flat)])

    def deviation(x: str, y: str) -> Column:
        return F.col(f"q_{x}_{y}") - F.col(f"t_{x}") * F.col(f"t_{y}") / F.col("n")

    spread = F.sqrt(F.greatest(deviation("a", "a"), F.lit(0.0))) * F.sqrt(F.greatest(deviation("b", "b"), F.lit(0.0)))
    r = F.when(~F.col("flat_a") & ~F.col("flat_b"), F.try_divide(deviation("a", "b"), F.nullif(spread, F.lit(0.0))))
    half = totals.select(*PAIR, F.col("n").cast("long").alias("n"), F.when(F.col("indicator_a") == F.col("indicator_b"), F.when(r.isNotNull(), 1.0)).otherwise(r).alias("r")).where(
        (F.col("n") >= min_pairs) & F.col("r").isNotNull())
    sides = F.array(F.struct(F.col("indicator_a").alias("x"), F.col("indicator_b").alias("y")),
                    F.struct(F.col("indicator_b").alias("x"), F.col("indicator_a").alias("y")))
    return (half.select("r", "n", F.explode(F.array_distinct(sides)).alias("_s"))
            .select(F.col("_s.x").alias("indicator_a"), F.col("_s.y").alias("indicator_b"), "r", "n"))
