"""Correlation mining and convergence over the brand panel (nation x brand x quarter)."""
from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from panelspark.functions.stats import pearson_stats, correlation
from panelspark.operators import catalog as cat, convergence as conv, correlate as cor, series as ser, views
from panelspark.plans import tables
from panelspark.plans.registry import register
from panelspark.plans.sql_tables import CTES

BRANDS = [f"Brand#{i}" for i in range(1, 26)]


# --- the same statistics in SQL ----------------------------------------------
def sql_erf(x: str) -> str:
    return (f"(CASE WHEN {x} >= 6 THEN 1.0 WHEN {x} = 0 THEN 0.0 ELSE 2 / sqrt(pi()) * exp(-({x}) * ({x})) * "
            f"list_sum(list_transform(range(0, 120), lambda k: exp(2 * k * ln(2) + (2 * k + 1) * ln({x}) "
            f"- lgamma(2 * k + 2) + lgamma(k + 1)))) END)")


def sql_normal_p(z: str) -> str:
    return f"(1.0 - {sql_erf(f'(abs({z}) / sqrt(2.0))')})"


def sql_fisher_z(r: str) -> str:
    return f"atanh(least(greatest({r}, -0.999999999), 0.999999999))"


def sql_corr(a: str, b: str) -> str:
    return (f"CASE WHEN stddev_samp(CASE WHEN {b} IS NOT NULL THEN {a} END) > 0 "
            f"AND stddev_samp(CASE WHEN {a} IS NOT NULL THEN {b} END) > 0 THEN corr({a}, {b}) END")


def _beta_series(x: str, a: str, b: str, terms: int) -> str:
    return (f"(exp({a} * ln({x}) + {b} * ln(1 - {x}) - ln({a}) - lgamma({a}) - lgamma({b}) + lgamma({a} + {b})) * "
            f"list_sum(list_transform(range(0, {terms}), lambda n: exp(lgamma({a} + {b} + n) - lgamma({a} + {b}) "
            f"- lgamma({a} + 1 + n) + lgamma({a} + 1) + n * ln({x})))))")


def sql_f1_p(f: str, v: str) -> str:
    x = f"({v} / ({v} + {f}))"
    y = f"({f} / ({v} + {f}))"
    return (f"(CASE WHEN {f} = 0 THEN 1.0 WHEN {x} <= 0.9 THEN {_beta_series(x, f'({v} / 2.0)', '0.5::DOUBLE', 400)} "
            f"ELSE 1 - {_beta_series(y, '0.5::DOUBLE', f'({v} / 2.0)', 120)} END)")


def sql_chi2(x: str, k: str) -> str:
    return (f"(CASE WHEN {x} <= 0 THEN 1.0 ELSE least(1.0, list_sum(list_transform(range(0, CAST({k} AS BIGINT)), "
            f"lambda i: exp(-{x} / 2 + i * ln({x} / 2) - lgamma(i + 1))))) END)")


CTES.update({
    "growths": """
        SELECT * FROM (SELECT unit, indicator, year,
          value / nullif(lag(value) OVER (PARTITION BY unit, indicator ORDER BY year), 0) - 1 AS g FROM brand)
        WHERE g IS NOT NULL""",
    "unit_lags": """
        SELECT * FROM (
          SELECT a.indicator AS indicator_a, b.indicator AS indicator_b, t.test, a.unit,
                 """ + sql_corr("a.g", "b.g") + """ AS r, count(*) AS n
          FROM growths a JOIN (VALUES ('contemporaneous', 0), ('a_leads_b', 1), ('b_leads_a', -1)) t(test, lag) ON true
          JOIN growths b ON b.unit = a.unit AND b.year = a.year + t.lag AND a.indicator < b.indicator
          GROUP BY ALL) WHERE n >= 8 AND r IS NOT NULL""",
    "pooled": f"""
        SELECT indicator_a, indicator_b, test, tanh(zb) AS pooled_r, {sql_normal_p('(zb * sqrt(w))')} AS pooled_p,
               abs(zb * sqrt(w)) AS abs_z, n_units
        FROM (SELECT indicator_a, indicator_b, test, sum({sql_fisher_z('r')} * (n - 3)) / sum(n - 3) AS zb,
                     CAST(sum(n - 3) AS DOUBLE) AS w, count(*) AS n_units FROM unit_lags GROUP BY ALL)
        WHERE n_units >= 3""",
    "picked": """
        SELECT indicator_a, indicator_b, test AS relationship, pooled_r AS weight,
               least(1.0, pooled_p * n_tests) AS p_value, n_units, n_tests
        FROM (SELECT *, count(*) OVER (PARTITION BY indicator_a, indicator_b) AS n_tests FROM pooled)
        QUALIFY row_number() OVER (PARTITION BY indicator_a, indicator_b ORDER BY abs_z DESC,
          list_position(['contemporaneous', 'a_leads_b', 'b_leads_a'], test)) = 1""",
    "fdr": """
        SELECT * EXCLUDE (rk, raw), least(1.0, min(raw) OVER (ORDER BY p_value DESC, rk DESC)) AS q_value
        FROM (SELECT *, p_value * count(*) OVER () / rk AS raw
              FROM (SELECT *, row_number() OVER (ORDER BY p_value) AS rk FROM picked))""",
    "gr_stats": """
        SELECT indicator_a, indicator_b, unit, n, CAST(n - 4 AS DOUBLE) AS v,
               pow(ba - bb * ll, 2) / nullif(greatest((1 - bb * bb) * (1 - ll * ll), 0), 0) AS r2ab,
               pow(ab - aa * ll, 2) / nullif(greatest((1 - aa * aa) * (1 - ll * ll), 0), 0) AS r2ba
        FROM (SELECT indicator_a, indicator_b, unit, count(*) AS n, """ + ", ".join(
            f"{sql_corr(x, y)} AS {name}" for x, y, name in (
                ("la", "lb", "ll"), ("na", "la", "aa"), ("nb", "lb", "bb"), ("nb", "la", "ba"), ("na", "lb", "ab"))) + """
              FROM (SELECT *, CASE WHEN la IS NOT NULL THEN ga END AS na, CASE WHEN la IS NOT NULL THEN gb END AS nb
                    FROM (SELECT a.indicator AS indicator_a, b.indicator AS indicator_b, a.unit, a.g AS ga, b.g AS gb,
                                 lag(a.g) OVER w AS la, lag(b.g) OVER w AS lb
                          FROM growths a JOIN growths b ON a.unit = b.unit AND a.year = b.year
                           AND a.indicator < b.indicator
                          WINDOW w AS (PARTITION BY a.indicator, b.indicator, a.unit ORDER BY a.year)))
              GROUP BY ALL) WHERE n >= 8""",
    "gr": f"""
        SELECT indicator_a, indicator_b, unit, n,
               CASE WHEN fab IS NOT NULL THEN {sql_f1_p('fab', 'v')} END AS p_a_to_b,
               CASE WHEN fba IS NOT NULL THEN {sql_f1_p('fba', 'v')} END AS p_b_to_a
        FROM (SELECT *, r2ab * v / nullif(1 - r2ab, 0) AS fab, r2ba * v / nullif(1 - r2ba, 0) AS fba FROM gr_stats)""",
    "gr_pooled": f"""
        SELECT indicator_a, indicator_b, {sql_chi2('xa', 'ka')} AS granger_p_a_to_b,
               {sql_chi2('xb', 'kb')} AS granger_p_b_to_a, ka, kb, xa, xb
        FROM (SELECT indicator_a, indicator_b, -2 * sum(ln(greatest(p_a_to_b, 1e-300))) AS xa, count(p_a_to_b) AS ka,
                     -2 * sum(ln(greatest(p_b_to_a, 1e-300))) AS xb, count(p_b_to_a) AS kb FROM gr GROUP BY ALL)""",
    "mined": """
        SELECT *, CASE WHEN direction = 'a_leads_b' THEN indicator_a WHEN direction = 'b_leads_a' THEN indicator_b END
                    AS leader,
               CASE WHEN direction = 'a_leads_b' THEN indicator_b WHEN direction = 'b_leads_a' THEN indicator_a END
                    AS follower
        FROM (SELECT f.*, CASE
                WHEN relationship = 'a_leads_b' AND granger_p_a_to_b < 0.05 AND granger_p_b_to_a >= 0.05 THEN 'a_leads_b'
                WHEN relationship = 'b_leads_a' AND granger_p_b_to_a < 0.05 AND granger_p_a_to_b >= 0.05 THEN 'b_leads_a'
                ELSE 'undetermined' END AS direction
              FROM fdr f LEFT JOIN gr_pooled g USING (indicator_a, indicator_b) WHERE q_value <= 0.05)""",
    "local_r": f"""
        SELECT *, {sql_normal_p(f"({sql_fisher_z('correlation')} * sqrt(n_years - 3.0))")} AS p_value
        FROM (SELECT a.unit, m.indicator_a, m.indicator_b, m.relationship, m.q_value,
                     {sql_corr('a.g', 'b.g')} AS correlation, count(*) AS n_years
              FROM mined m JOIN growths a ON a.indicator = m.indicator_a
              JOIN growths b ON b.indicator = m.indicator_b AND b.unit = a.unit AND b.year = a.year GROUP BY ALL)
        WHERE n_years >= 8 AND correlation IS NOT NULL""",
    "scatter": """
        SELECT *, (ln(final_value) - ln(initial_value)) / (final_year - initial_year) * 100 AS annualized_growth,
               ln(initial_value) AS log_initial
        FROM (SELECT indicator, unit, min(year) AS initial_year, arg_min(value, year) AS initial_value,
                     max(year) AS final_year, arg_max(value, year) AS final_value
              FROM annual WHERE value > 0 GROUP BY ALL) WHERE final_year > initial_year""",
    "sigma": """
        SELECT indicator, year, count(*) AS n, stddev_samp(ln(value)) AS sd_log, stddev_samp(value) / avg(value) AS cv,
               avg(ln(value)) AS mean_log FROM annual WHERE value > 0 GROUP BY ALL HAVING count(*) >= 2""",
})


def _frame(spark, sf_dir):
    return tables.brand_frame(spark, sf_dir)


def growths(spark, sf_dir):
    return ser.growth(_frame(spark, sf_dir), scale=1.0)


def _pairs(spark):
    return spark.createDataFrame([tuple(sorted(p)) for p in combinations(BRANDS, 2)],
                                 "indicator_a string, indicator_b string")


def _stats_sql(inner: str, lag: int, minimum: int) -> str:
    z, se = sql_fisher_z("correlation"), "(1 / sqrt(n_years - 3.0))"
    return f"""SELECT *, {sql_normal_p(f'({z} / {se})')} AS p_value, tanh({z} - 1.959964 * {se}) AS ci_low,
        tanh({z} + 1.959964 * {se}) AS ci_high, {lag} AS lag
        FROM ({inner}) WHERE n_years >= {minimum} AND correlation IS NOT NULL"""


@register("c1_lagged_correlation", _stats_sql(f"""
    SELECT a.indicator AS indicator_a, b.indicator AS indicator_b, a.unit, count(*) AS n_years,
           {sql_corr('a.g', 'b.g')} AS correlation
    FROM growths a JOIN growths b ON a.unit = b.unit AND b.year = a.year + 2 AND a.indicator < b.indicator
    GROUP BY ALL""", 2, 10), floats="correlation p_value ci_low ci_high")
def _(spark, sf_dir):
    return cor.lagged_correlation(_frame(spark, sf_dir), _pairs(spark), lag=2)


@register("c2_correlate_levels", _stats_sql(f"""
    SELECT a.indicator AS indicator_a, b.indicator AS indicator_b, a.unit, count(*) AS n_years,
           {sql_corr('a.value', 'b.value')} AS correlation
    FROM brand a JOIN brand b ON a.unit = b.unit AND b.year = a.year AND a.indicator < b.indicator
    GROUP BY ALL""", 0, 10), floats="correlation p_value ci_low ci_high")
def _(spark, sf_dir):
    return cor.correlate(_frame(spark, sf_dir), _pairs(spark), on="levels")


@register("c3_pearson_stats", f"""
    SELECT l_suppkey, n, r, CASE WHEN n > 3 THEN {sql_normal_p(f"({sql_fisher_z('r')} * sqrt(greatest(n - 3.0, 0)))")} END
             AS p_value,
           CASE WHEN n > 3 THEN tanh({sql_fisher_z('r')} - 1.959964 / sqrt(greatest(n - 3.0, 1))) END AS ci_low,
           CASE WHEN n > 3 THEN tanh({sql_fisher_z('r')} + 1.959964 / sqrt(greatest(n - 3.0, 1))) END AS ci_high
    FROM (SELECT l_suppkey, count(*) AS n, {sql_corr('l_discount', 'l_tax')} AS r FROM lineitem
          GROUP BY l_suppkey)""", floats="r p_value ci_low ci_high")
def _(spark, sf_dir):
    g = tables.table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), correlation("l_discount", "l_tax").alias("r"))
    return g.withColumn("_s", pearson_stats(F.col("r"), F.col("n"))).select(
        "l_suppkey", "n", "r", "_s.p_value", "_s.ci_low", "_s.ci_high")


@register("c4_fisher_pool", """
    SELECT indicator_a, indicator_b, pooled_r, pooled_p, n_units FROM pooled WHERE test = 'contemporaneous'""",
    floats="pooled_r pooled_p")
def _(spark, sf_dir):
    rows = cor.unit_lag_correlations(growths(spark, sf_dir)).where("test = 'contemporaneous'")
    return cor.fisher_pool(rows, cor.PAIR).where("n_units >= 3").drop("abs_z")


@register("c5_pooled_lags", "SELECT * FROM pooled", floats="pooled_r pooled_p abs_z")
def _(spark, sf_dir):
    return cor.pooled_lags(growths(spark, sf_dir))


@register("c6_select_lag", "SELECT * FROM picked", floats="weight p_value")
def _(spark, sf_dir):
    return cor.select_lag(cor.pooled_lags(growths(spark, sf_dir)))


@register("c7_bh_fdr", "SELECT indicator_a, indicator_b, p_value, q_value FROM fdr", floats="p_value q_value")
def _(spark, sf_dir):
    return cor.bh_fdr(cor.select_lag(cor.pooled_lags(growths(spark, sf_dir)))).select(*cor.PAIR, "p_value", "q_value")


@register("c8_granger", "SELECT * FROM gr", floats="p_a_to_b p_b_to_a")
def _(spark, sf_dir):
    return cor.granger(growths(spark, sf_dir))


@register("c9_fisher_combine", """
    SELECT indicator_a, indicator_b, granger_p_a_to_b AS p_combined, ka AS p_combined_n FROM gr_pooled""",
    floats="p_combined")
def _(spark, sf_dir):
    return cor.fisher_combine(cor.granger(growths(spark, sf_dir)), cor.PAIR, "p_a_to_b", "p_combined")


@register("c10_direction", """
    SELECT indicator_a, indicator_b, relationship, granger_p_a_to_b, granger_p_b_to_a, CASE
      WHEN relationship = 'a_leads_b' AND granger_p_a_to_b < 0.05 AND granger_p_b_to_a >= 0.05 THEN 'a_leads_b'
      WHEN relationship = 'b_leads_a' AND granger_p_b_to_a < 0.05 AND granger_p_a_to_b >= 0.05 THEN 'b_leads_a'
      ELSE 'undetermined' END AS direction
    FROM picked LEFT JOIN gr_pooled USING (indicator_a, indicator_b)""", floats="granger_p_a_to_b granger_p_b_to_a")
def _(spark, sf_dir):
    g = growths(spark, sf_dir)
    joined = cor.select_lag(cor.pooled_lags(g)).join(cor.pooled_granger(cor.granger(g)), cor.PAIR, "left")
    return joined.select(*cor.PAIR, "relationship", "granger_p_a_to_b", "granger_p_b_to_a", cor.direction(
        F.col("relationship"), F.col("granger_p_a_to_b"), F.col("granger_p_b_to_a")).alias("direction"))


_EDGE_COLS = ["indicator_a", "indicator_b", "relationship", "weight", "p_value", "q_value", "n_units", "direction",
              "leader", "follower"]


@register("c11_mine_edges", f"""
    SELECT {', '.join('m.' + c for c in _EDGE_COLS)}, u.unit, round(u.r, 4) AS correlation, u.n AS n_years,
           p_a_to_b AS granger_p_a_to_b, p_b_to_a AS granger_p_b_to_a
    FROM mined m JOIN unit_lags u ON u.indicator_a = m.indicator_a AND u.indicator_b = m.indicator_b
      AND u.test = m.relationship
    LEFT JOIN gr ON m.relationship <> 'contemporaneous' AND gr.indicator_a = m.indicator_a
      AND gr.indicator_b = m.indicator_b AND gr.unit = u.unit""",
    floats="weight p_value q_value correlation granger_p_a_to_b granger_p_b_to_a", digits=4)
def _(spark, sf_dir):
    """Every edge with the evidence of every unit behind it."""
    mined = cor.mine_edges(growths(spark, sf_dir))
    evidence = mined.evidence.drop("relationship")
    return mined.edges.select(*_EDGE_COLS).join(evidence, cor.PAIR).select(
        *_EDGE_COLS, "unit", "correlation", "n_years", "granger_p_a_to_b", "granger_p_b_to_a")


def stored_edges(spark, sf_dir):
    """The mined edges as a stored table: mined once, read by the queries on the graph."""
    return tables.stored(spark, sf_dir, "correlation_edge", lambda: cor.mine_edges(growths(spark, sf_dir)).edges)


def brand_domains(spark, sf_dir):
    """Brands belong to the domain of their most common part type."""
    counts = tables.table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(F.col("p_brand").alias("indicator")).agg(
        F.max_by("p_type", F.struct("n", "p_type")).alias("domain"))


@register("c12_edge_listing", """
    WITH dom AS (SELECT p_brand AS b, arg_max(p_type, (n, p_type)) AS d FROM (
      SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL) GROUP BY p_brand)
    SELECT indicator_a, indicator_b, da.d AS domain_a, db.d AS domain_b, weight, relationship, direction, q_value,
           n_units
    FROM mined JOIN dom da ON da.b = indicator_a JOIN dom db ON db.b = indicator_b""", floats="weight q_value")
def _(spark, sf_dir):
    return cor.edge_listing(stored_edges(spark, sf_dir), brand_domains(spark, sf_dir))


@register("c13_local_correlations", """
    SELECT * FROM local_r""",
    floats="correlation p_value q_value")
def _(spark, sf_dir):
    return cor.local_correlations(growths(spark, sf_dir), stored_edges(spark, sf_dir))


@register("c14_correlation_matrix", f"""
    WITH obs AS (SELECT unit, year, indicator, avg(value) AS value FROM srs GROUP BY ALL)
    SELECT * FROM (SELECT a.indicator AS indicator_a, b.indicator AS indicator_b, count(*) AS n,
                          {sql_corr('a.value', 'b.value')} AS r
                   FROM obs a JOIN obs b ON a.unit = b.unit AND a.year = b.year GROUP BY ALL)
    WHERE n >= 30 AND r IS NOT NULL""", floats="r")
def _(spark, sf_dir):
    return cor.correlation_matrix(views.annualize(ser.series(tables.panel(spark, sf_dir))))


# --- convergence --------------------------------------------------------------
def _annual(spark, sf_dir):
    p = tables.panel(spark, sf_dir)
    return views.unit_year_frame(p.best, p.geography, p.indicator)


@register("g1_beta_scatter", "SELECT * FROM scatter",
          floats="initial_value final_value annualized_growth log_initial")
def _(spark, sf_dir):
    return conv.beta_scatter(_annual(spark, sf_dir))


@register("g1_beta_scatter_bloc", """
    SELECT * FROM scatter WHERE unit IN (
      SELECT g.u FROM geography_bloc gb JOIN bloc b ON b.id = gb.bloc_id JOIN geo g ON g.id = gb.geography_id
      WHERE b.code = 'B2')""", floats="initial_value final_value annualized_growth log_initial")
def _(spark, sf_dir):
    """One bloc's members, former ones included."""
    p = tables.panel(spark, sf_dir)
    members = cat.bloc_members(p.bloc, p.geography_bloc, p.geography).where("bloc = 'B2'")
    return conv.beta_scatter(_annual(spark, sf_dir), units=members)


_P_R = sql_normal_p(f"({sql_fisher_z('r')} * sqrt(n - 3.0))")


@register("g2_beta_stats", f"""
    SELECT indicator, coefficient, intercept, std_err, coefficient / nullif(std_err, 0) AS t_stat,
           {_P_R} AS p_value, r2 AS r_squared, n, speed, CASE WHEN speed > 0 THEN ln(2) / speed END AS half_life,
           coefficient < 0 AS converging
    FROM (SELECT *, sqrt((syy - coefficient * coefficient * sxx) / (n - 2) / sxx) AS std_err,
                 sign(coefficient) * sqrt(r2) AS r,
                 CASE WHEN 1 + coefficient / 100 * span > 0 THEN -ln(1 + coefficient / 100 * span) / span END AS speed
          FROM (SELECT indicator, count(*) AS n, regr_slope(annualized_growth, log_initial) AS coefficient,
                       regr_intercept(annualized_growth, log_initial) AS intercept,
                       regr_r2(annualized_growth, log_initial) AS r2, regr_sxx(annualized_growth, log_initial) AS sxx,
                       regr_syy(annualized_growth, log_initial) AS syy, avg(final_year - initial_year) AS span
                FROM scatter GROUP BY indicator))""",
    floats="coefficient intercept std_err t_stat p_value r_squared speed half_life")
def _(spark, sf_dir):
    return conv.beta_stats(conv.beta_scatter(_annual(spark, sf_dir)))


@register("g3_sigma_series", "SELECT * FROM sigma", floats="sd_log cv mean_log")
def _(spark, sf_dir):
    return conv.sigma_series(_annual(spark, sf_dir))


@register("g4_sigma_trend", f"""
    SELECT indicator, slope, {_P_R} AS p_value, slope < 0 AS converging, start_dispersion, end_dispersion
    FROM (SELECT indicator, count(*) AS n, regr_slope(sd_log, year) AS slope, corr(year, sd_log) AS r,
                 arg_min(sd_log, year) AS start_dispersion, arg_max(sd_log, year) AS end_dispersion
          FROM sigma GROUP BY indicator)""", floats="slope p_value start_dispersion end_dispersion")
def _(spark, sf_dir):
    return conv.sigma_trend(conv.sigma_series(_annual(spark, sf_dir)))
