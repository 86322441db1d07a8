from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from panelspark.functions import stats
from panelspark.functions.ranking import benjamini_hochberg
from panelspark.operators import convergence as conv, correlate as cor, series as ser


def test_erf_and_normal_p(spark):
    xs = [-7.0, -1.0, 0.0, 1e-9, 0.3, 1.0, 2.5, 5.9, 6.1]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select(
        "x", stats.erf(F.col("x")).alias("e"), stats.normal_two_sided_p(F.col("x")).alias("p")).collect()
    for r in rows:
        assert r["e"] == pytest.approx(math.erf(r["x"]), abs=1e-14)
        assert r["p"] == pytest.approx(math.erfc(abs(r["x"]) / math.sqrt(2)), abs=1e-14)


def _t_p(t: float, v: int) -> float:
    """Two-sided p by Simpson's rule on the density, in s = tan(u)."""
    c = math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / math.sqrt(v * math.pi)
    a, b, n = math.atan(abs(t)), math.pi / 2, 4000
    h = (b - a) / n

    def f(u: float) -> float:
        return 0.0 if u >= b else c * (1 + math.tan(u) ** 2 / v) ** (-(v + 1) / 2) / math.cos(u) ** 2

    s = f(a) + f(b - 1e-12) + sum((4 if i % 2 else 2) * f(a + i * h) for i in range(1, n))
    return 2 * s * h / 3


def test_student_t_p(spark):
    cases = [(t, v) for t in (0.0, 0.5, 1.0, 2.0, 5.0, 12.0, 40.0) for v in (1, 2, 3, 4, 7, 10, 30, 61)]
    rows = spark.createDataFrame(cases, "t double, v int").select(
        "t", "v", stats.t_two_sided_p(F.col("t"), F.col("v")).alias("p")).collect()
    for r in rows:
        want = _t_p(r["t"], r["v"])
        assert r["p"] == pytest.approx(want, rel=2e-4 if r["v"] == 1 else 1e-6, abs=1e-300)


def test_chi2_even(spark):
    cases = [(0.5, 1), (10.0, 3), (900.0, 25), (60.0, 40)]
    rows = spark.createDataFrame(cases, "x double, k int").select(
        "x", "k", stats.chi2_even_sf(F.col("x"), F.col("k")).alias("p")).collect()
    for r in rows:
        y = r["x"] / 2
        want = sum(math.exp(-y + i * math.log(y) - math.lgamma(i + 1)) for i in range(r["k"]))
        assert r["p"] == pytest.approx(want, rel=1e-10)


def test_pearson_stats_needs_four_points(spark):
    row = spark.createDataFrame([(0.5, 3), (0.5, 10), (1.0, 10)], "r double, n int").select(
        stats.pearson_stats(F.col("r"), F.col("n")).alias("s")).collect()
    assert row[0]["s"]["p_value"] is None and row[0]["s"]["ci_low"] is None
    z, se = math.atanh(.5), 1 / math.sqrt(7)
    assert row[1]["s"]["p_value"] == pytest.approx(math.erfc(z / se / math.sqrt(2)))
    assert row[1]["s"]["ci_high"] == pytest.approx(math.tanh(z + 1.959964 * se))
    assert row[2]["s"]["p_value"] == pytest.approx(0, abs=1e-12)


def test_benjamini_hochberg(spark):
    rng = random.Random(1)
    ps = [rng.random() ** 4 for _ in range(60)] + [1.0] * 5 + [0.0, 0.02, 0.02]
    got = benjamini_hochberg(spark.createDataFrame(list(enumerate(ps)), "i int, p double"), "p").collect()
    order = sorted(range(len(ps)), key=lambda i: ps[i])
    q, low = {}, 1.0
    for rank in range(len(ps), 0, -1):
        i = order[rank - 1]
        low = min(low, ps[i] * len(ps) / rank)
        q[i] = low
    assert len(got) == len(ps)
    for r in got:
        assert r["q_value"] == pytest.approx(q[r["i"]]) and r["q_value"] >= r["p"]


def _planted(spark, lead: int = 1):
    """alpha drives beta one year later in five units; gamma is noise."""
    rng = random.Random(11)
    rows, shock = [], [rng.gauss(0, 8) for _ in range(20)]
    for unit in "ABCDE":
        level = {"alpha": 100.0, "beta": 100.0, "gamma": 100.0}
        for t in range(1, 18):
            growth = {"alpha": shock[t] + rng.gauss(0, .8), "beta": shock[t - lead] + rng.gauss(0, .8),
                      "gamma": rng.gauss(0, 5)}
            for name, g in growth.items():
                level[name] *= 1 + g / 100
                rows.append((unit, name, 2000 + t, level[name]))
    return spark.createDataFrame(rows, "unit string, indicator string, year int, value double")


def test_planted_lead_is_found(spark):
    mined = cor.mine_edges(ser.growth(_planted(spark), scale=1.0))
    edges = mined.edges.collect()
    assert [(e["indicator_a"], e["indicator_b"]) for e in edges] == [("alpha", "beta")]
    e = edges[0]
    assert e["weight"] > .7 and e["relationship"] == "a_leads_b" and e["direction"] == "a_leads_b"
    assert e["leader"] == "alpha" and e["follower"] == "beta" and e["n_units"] == 5
    assert e["q_value"] >= e["p_value"] and mined.evidence.count() == 5
    nested = cor.nest_evidence(mined.evidence).first()["per_unit"]
    assert [u["unit"] for u in nested] == list("ABCDE") and nested[0]["granger_p_a_to_b"] < .05


def test_reverse_lead_names_the_follower(spark):
    renamed = _planted(spark).withColumn("indicator", F.translate("indicator", "ab", "za"))
    edges = cor.mine_edges(ser.growth(renamed, scale=1.0)).edges.collect()
    assert [e["direction"] for e in edges] == ["b_leads_a"] and edges[0]["leader"] == edges[0]["indicator_b"]


def test_granger_matches_regression(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    x, y = rng.normal(size=15), rng.normal(size=15)
    y[1:] += .6 * x[:-1]
    rows = [("U", "a", i, float(v)) for i, v in enumerate(x)] + [("U", "b", i, float(v)) for i, v in enumerate(y)]
    got = cor.granger(spark.createDataFrame(rows, "unit string, indicator string, year int, growth double")).first()

    def p(target, driver):
        own, other, now, one = target[:-1], driver[:-1], target[1:], np.ones(14)
        ssr = [np.sum((now - m @ np.linalg.lstsq(m, now, rcond=None)[0]) ** 2)
               for m in (np.column_stack([one, own]), np.column_stack([one, own, other]))]
        return _t_p(math.sqrt((ssr[0] - ssr[1]) / (ssr[1] / 11)), 11)

    assert got["p_a_to_b"] == pytest.approx(p(y, x), rel=1e-6)
    assert got["p_b_to_a"] == pytest.approx(p(x, y), rel=1e-6)


def test_regions_stay_apart(spark, make_panel):
    from panelspark.operators.views import unit_year_frame

    p = make_panel([(c, 1, 4, 2000 + t, (i + 1) * 10 * 1.1 ** t) for i, c in enumerate(("FR10", "FR20", "DE11"))
                    for t in range(12)])
    frame = unit_year_frame(p.best, p.geography, p.indicator)
    assert {r["unit"] for r in frame.select("unit").distinct().collect()} == {"FR10", "FR20", "DE11"}
    assert conv.beta_scatter(frame).count() == 3


def test_convergence_closed_form(spark):
    rows = [(u, "I", 2000 + t, y0 * math.exp((.10 - .02 * math.log(y0)) * t))
            for u, y0 in (("DEU", 80.), ("FRA", 40.), ("ITA", 20.), ("ESP", 10.)) for t in range(11)]
    out = conv.convergence(spark.createDataFrame(rows, "unit string, indicator string, year int, value double"))
    b = out["beta"].first()
    assert b["coefficient"] == pytest.approx(-2) and b["intercept"] == pytest.approx(10)
    assert b["r_squared"] == pytest.approx(1) and b["converging"] and b["n"] == 4
    assert b["speed"] == pytest.approx(-math.log(.8) / 10) and b["half_life"] == pytest.approx(math.log(2) / b["speed"])
    assert b["std_err"] == pytest.approx(0, abs=1e-6) and b["t_stat"] < -1e6
    sigma = {r["year"]: r["sd_log"] for r in out["sigma"].collect()}
    assert sigma[2010] == pytest.approx(.8 * sigma[2000])
    trend = out["sigma_trend"].first()
    assert trend["slope"] < 0 and trend["converging"] and trend["start_dispersion"] == pytest.approx(sigma[2000])
    two = conv.beta_stats(out["scatter"].where("unit in ('DEU', 'FRA')")).first()
    assert two["coefficient"] is None and two["n"] == 2


def test_local_correlations_cover_surviving_pairs_only(spark):
    frame = _planted(spark)
    growths = ser.growth(frame)
    edges = cor.mine_edges(ser.growth(frame, scale=1.0)).edges
    local = cor.local_correlations(growths, edges).collect()
    assert {(r["indicator_a"], r["indicator_b"]) for r in local} == {("alpha", "beta")} and len(local) == 5


@pytest.mark.parametrize("small, big", [(1e-9, 3e-9), (1e33, 3e33), (1.0, 3.0)])
def test_timeline_keeps_every_magnitude(spark, small, big):
    from panelspark.functions.timeline import totals_before

    obs = spark.createDataFrame([("a", 1, small), ("a", 25, big), ("a", 60, big)], "k string, at long, value double")
    probes = spark.createDataFrame([("a", 0, 1), ("a", 2, 2), ("a", 60, 3), ("a", 61, 4)], "k string, at long, i int")
    out = {r["i"]: (r["sum_before"], r["n_before"]) for r in totals_before(obs, probes, ["k"], 10).collect()}
    assert out == {1: (0.0, 0), 2: (pytest.approx(small), 1), 3: (pytest.approx(small + big), 2),
                   4: (pytest.approx(small + 2 * big), 3)}
    exact = totals_before(obs.withColumn("value", F.lit("0.1").cast("decimal(10,1)")), probes, ["k"], 10)
    assert {str(r["sum_before"]) for r in exact.where("i = 4").collect()} == {"0.3"}


def test_ranks_spread_over_the_tasks(spark):
    """Close values fall into many bands, and codes with one long common prefix are placed right."""
    from panelspark.functions import ranking

    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        close = spark.range(200_000).select(F.lit("g").alias("g"), (F.lit(100.0) + F.col("id") * 5e-7).alias("v"))
        codes = spark.range(100_000).select(F.lit("g").alias("g"), F.concat(F.lit("COMMONPREFIX"), F.lpad("id", 9, "0")).alias("c"))
        for df in (close, close.withColumn("v", -F.col("v") * 1e-200), close.withColumn("v", F.col("v") * 1e200)):
            bands = ranking._counts(df, ["g"], "v").groupBy("_coarse", "_fine").count()
            assert bands.agg(F.max("count")).first()[0] < 100
        counts = ranking.cumulative_counts(close, ["g"], "v").agg(F.max("n_less"), F.min("n_less"), F.max("n_total")).first()
        assert tuple(counts) == (199_999, 0, 200_000)
        placed = ranking.tie_positions(codes, ["g"], "c").where("position <> cast(right(c, 9) as int) + 1").count()
        assert placed == 0
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_chi_square_tail_of_many_degrees(spark):
    """Against the sum of all terms, and in time for a million units."""
    cases = [(2.0, 1), (30.0, 12), (1900.0, 1000), (2100.0, 1000), (2000.0, 1000), (500.0, 1000), (4000.0, 1000), (1e-3, 50)]

    def plain(x, k):
        y = x / 2
        return min(1.0, math.fsum(math.exp(-y + i * math.log(y) - math.lgamma(i + 1)) for i in range(k)))

    rows = spark.createDataFrame(cases + [(2e6 + 3000, 1_000_000)], "x double, k int")
    got = rows.select("x", "k", stats.chi2_even_sf(F.col("x"), F.col("k")).alias("p")).collect()
    for r in got[:-1]:
        assert r["p"] == pytest.approx(plain(r["x"], r["k"]), rel=1e-8, abs=1e-300), r
    assert got[-1]["p"] == pytest.approx(0.0669, abs=2e-3)          # about 1.5 standard deviations above the mean


def test_moments_fold_like_two_passes(spark):
    """Folded deviations equal numpy's, with gaps, far from zero, and exactly none for a constant side."""
    import numpy as np

    from panelspark.functions.stats import moment_correlation, moments

    rng = np.random.default_rng(7)
    rows = []
    for i in range(40):
        n = int(rng.integers(0, 30))
        a, b = (rng.normal(1e9, 1.0, n) if i % 2 else rng.normal(0, 5, n)).tolist(), rng.normal(3, 2, n).tolist()
        if i % 5 == 0:
            a = [0.1] * n
        rows.append((i, [(None if rng.random() < .1 else x, None if rng.random() < .1 else y) for x, y in zip(a, b)]))
    df = spark.createDataFrame(rows, "id int, p array<struct<a:double,b:double>>").select("id", moments(
        F.col("p"), {"a": lambda p: p["a"], "b": lambda p: p["b"]}, [("a", "a"), ("b", "b"), ("a", "b")]).alias("m"))
    out = {r.id: (r.m, r.r) for r in df.select("id", "m", moment_correlation(F.col("m"), "a", "b").alias("r")).collect()}
    for i, points in rows:
        both = np.array([p for p in points if None not in p]).reshape(-1, 2)
        m, r = out[i]
        assert m.n == len(both)
        if len(both) < 2 or i % 5 == 0:
            assert r is None and (i % 5 or m.s_a_a == 0.0)
            continue
        dev = both - both.mean(axis=0)
        assert np.allclose([m.s_a_a, m.s_b_b, m.s_a_b], [(dev[:, 0] ** 2).sum(), (dev[:, 1] ** 2).sum(), dev.prod(axis=1).sum()], rtol=1e-6, atol=1e-6)
        assert r == pytest.approx(np.corrcoef(both.T)[0, 1], abs=1e-7)


def test_years_of_a_pair_never_become_rows(spark):
    from panelspark.operators import correlate

    rows = [(f"U{u}", i, y, float((u * 7 + y * y + ord(i)) % 11)) for u in range(4) for i in "abc" for y in range(2000, 2015) if (u + y) % 6]
    g = spark.createDataFrame(rows, "unit string, indicator string, year int, growth double")
    edges = spark.createDataFrame([("a", "b", "contemporaneous", 0.01)], "indicator_a string, indicator_b string, relationship string, q_value double")
    for df in (correlate.pooled_lags(g), correlate.granger(g), correlate.local_correlations(g, edges),
               correlate.correlation_matrix(g.withColumnRenamed("growth", "value"), 5)):
        plan = df._jdf.queryExecution().optimizedPlan().toString().lower()
        assert "inline" not in plan and df.count() > 0


def test_bands_order_like_the_values(spark):
    """Every double, whatever its sign and size, is ranked, and the median is exact, against brute force."""
    from panelspark.functions import ranking

    rng = random.Random(11)
    tiny, inf = 5e-324, float("inf")
    pool = [0.0, -0.0, tiny, -tiny, 2 * tiny, 1.0, math.nextafter(1.0, 2), math.nextafter(1.0, 0), -1.0, 1.7e308, -1.7e308, inf, -inf]
    pool += [s * math.exp(k / 256) * (1 + d) for s in (-1, 1) for k in (-9, 0, 1, 700) for d in (-1e-16, 0, 1e-16, 1e-9)]
    rows = [(g, rng.choice(pool)) for g in (None, "a", "b") for _ in range(150)] + [("a", None), ("c", 3.5), ("d", 1.0), ("d", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    seen = 0
    for r in ranking.cumulative_counts(df, ["g"], "v").collect():
        mine = [v for g, v in rows if g == r["g"] and v is not None]
        assert (r["n_less"], r["n_ties"], r["n_total"]) == (sum(v < r["v"] for v in mine), mine.count(r["v"]), len(mine))
        seen += 1
    assert seen == sum(len({v for g, v in rows if g == k and v is not None}) for k in (None, "a", "b", "c", "d"))
    got = {r["g"]: (r["median"], r["n_total"]) for r in ranking.group_median(df, ["g"], "v").collect()}
    for g in (None, "a", "b", "c", "d"):
        mine = sorted(v for k, v in rows if k == g and v is not None)
        assert got[g] == ((mine[(len(mine) - 1) // 2] + mine[len(mine) // 2]) / 2, len(mine))
    assert ranking.group_median(df.where("false"), ["g"], "v").count() == 0
    whole = spark.createDataFrame([(k,) for k in (5, -3, 5, 8)], "v long").withColumn("g", F.lit(1))
    assert ranking.group_median(whole, ["g"], "v").first()["median"] == 5.0


def test_false_discovery_rate_over_many_bands(spark):
    rng = random.Random(2)
    ps = [10 ** -rng.uniform(0, 12) for _ in range(3000)] + [0.0] * 4 + [1.0] * 4
    got = benjamini_hochberg(spark.createDataFrame(list(enumerate(ps)), "i int, p double"), "p").collect()
    order = sorted(range(len(ps)), key=lambda i: ps[i])
    want, low, rank = {}, 1.0, len(ps)
    last = {ps[i]: k + 1 for k, i in enumerate(order)}
    for i in reversed(order):
        low = min(low, ps[i] * len(ps) / last[ps[i]])
        want[i] = low
    assert all(r["q_value"] == pytest.approx(want[r["i"]], rel=1e-12, abs=0) for r in got) and len(got) == rank


def test_null_p_values_drop_out_without_a_filter(spark):
    """A filter on p would be pushed below whatever computes p, and carry a copy of all of it (F1)."""
    rows = spark.createDataFrame([("a", "b", 4.0), ("a", "b", None), ("a", "b", 9.0), ("a", "c", None)],
                                 "indicator_a string, indicator_b string, f double")
    tested = rows.withColumn("p", stats.f1_p(F.col("f"), F.lit(12)))
    out = cor.fisher_combine(tested, cor.PAIR, "p", "combined")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "aggregate(" in line]
    ps = [r.p for r in tested.where("f is not null").collect()]
    product = ps[0] * ps[1]
    (got,) = out.collect()
    assert (got.indicator_b, got.combined_n) == ("b", 2)
    assert got.combined == pytest.approx(product * (1 - math.log(product)))


def test_scatter_is_dealt_by_series(spark):
    """Reduced in the packed tasks of the annual averages, both tables took 746 MB (F7)."""
    frame = spark.createDataFrame([(u, "GDP", 2000 + y, 100.0 * (y + 1)) for u in ("u1", "u2", None) for y in range(4)] + [("u3", "GDP", 2000, 1.0)],
                                  "unit string, indicator string, year int, value double")
    out = conv.beta_scatter(frame)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count(", 2), REPARTITION_BY_NUM") == 1 and "ENSURE_REQUIREMENTS" not in plan
    rows = {r["unit"]: (r["initial_year"], r["initial_value"], r["final_year"], r["final_value"]) for r in out.collect()}
    assert rows == {u: (2000, 100.0, 2003, 400.0) for u in ("u1", "u2", None)}
