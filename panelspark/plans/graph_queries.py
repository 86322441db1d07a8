"""Graph and forecast queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions.text import is_variant
from panelspark.operators import correlate as cor, forecast as fc, graph as gr, series as ser
from panelspark.plans import tables
from panelspark.plans.correlation_queries import growths, stored_edges
from panelspark.plans.registry import register
from panelspark.plans.sql_forecast import forecast_sql, predictions
from panelspark.plans.sql_tables import CTES

CTES.update({
    "borders": """
        SELECT 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS a,
               'N' || lpad(CAST((n_nationkey + s) % 25 AS VARCHAR), 2, '0') AS b
        FROM nation, (VALUES (1), (5)) t(s)""",
    "nodes": """
        SELECT row_number() OVER (ORDER BY rk, ref_id) AS id, node_type, ref_id, label FROM (
          SELECT 0 AS rk, 'country' AS node_type, id AS ref_id, name AS label FROM geography
          UNION ALL SELECT 1, 'domain', id, name FROM domain
          UNION ALL SELECT 2, 'indicator', id, name FROM indicator
          UNION ALL SELECT 3, 'source', id, name FROM source
          UNION ALL SELECT 4, 'bloc', id, name FROM bloc)""",
    "g_edges": """
        SELECT 'indicator' AS src_type, id AS src_ref, 'domain' AS dst_type, domain_id AS dst_ref,
               'BELONGS_TO' AS edge_type, 1.0::DOUBLE AS weight FROM indicator
        UNION ALL SELECT DISTINCT 'source', source_id, 'indicator', indicator_id, 'PROVIDES', 1.0 FROM records
        UNION ALL SELECT 'country', geography_id, 'bloc', bloc_id, 'MEMBER_OF', 1.0 FROM geography_bloc
        UNION ALL SELECT 'country', x.id, 'country', y.id, 'BORDERS', 1.0
          FROM borders JOIN geography x ON x.iso3 = a JOIN geography y ON y.iso3 = b
        UNION ALL SELECT 'country', y.id, 'country', x.id, 'BORDERS', 1.0
          FROM borders JOIN geography x ON x.iso3 = a JOIN geography y ON y.iso3 = b""",
    "centrality": """
        SELECT n.id, n.node_type, n.ref_id, n.label, coalesce(d.degree, 0) AS degree,
               coalesce(d.degree, 0) / ((SELECT count(*) FROM nodes) - 1)::DOUBLE AS centrality
        FROM nodes n LEFT JOIN (
          SELECT t, r, count(*) AS degree FROM (
            SELECT src_type AS t, src_ref AS r FROM (SELECT DISTINCT src_type, src_ref, dst_type, dst_ref FROM g_edges)
            UNION ALL
            SELECT dst_type, dst_ref FROM (SELECT DISTINCT src_type, src_ref, dst_type, dst_ref FROM g_edges))
          GROUP BY ALL) d ON d.t = n.node_type AND d.r = n.ref_id""",
    "stems": r"""
        SELECT DISTINCT indicator AS name, lower(trim(regexp_replace(indicator, '\s*\(.*?\)', '', 'g'))) AS stem
        FROM brand""",
    "pooled_arcs": """
        SELECT x AS src, y AS dst, weight, directed FROM (
          SELECT unnest([indicator_a, indicator_b]) AS x, unnest([indicator_b, indicator_a]) AS y, weight, direction,
                 indicator_a, direction <> 'undetermined' AS directed
          FROM mined JOIN stems sa ON sa.name = indicator_a JOIN stems sb ON sb.name = indicator_b
          WHERE NOT starts_with(sa.stem, sb.stem) AND NOT starts_with(sb.stem, sa.stem) AND abs(weight) >= 0.15)
        WHERE direction = 'undetermined' OR (direction = 'a_leads_b') = (x = indicator_a)""",
})


def _borders(spark, sf_dir):
    n = tables.table(spark, sf_dir, "nation")

    def code(col):
        return F.concat(F.lit("N"), F.lpad(col.cast("string"), 2, "0"))

    return n.select(code(F.col("n_nationkey")).alias("iso3_a"),
                    F.explode(F.array(F.lit(1), F.lit(5))).alias("_s"), "n_nationkey").select(
        "iso3_a", code((F.col("n_nationkey") + F.col("_s")) % 25).alias("iso3_b"))


def _nodes(spark, sf_dir):
    return gr.graph_nodes(tables.panel(spark, sf_dir), levels=None)


def _edges(spark, sf_dir):
    return gr.graph_edges(tables.panel(spark, sf_dir), _borders(spark, sf_dir), levels=None)


@register("n1_graph_nodes", "SELECT * FROM nodes")
def _(spark, sf_dir):
    """Countries and regions, so the node set grows with the data."""
    return _nodes(spark, sf_dir)


@register("n2_graph_edges", "SELECT * FROM g_edges")
def _(spark, sf_dir):
    return _edges(spark, sf_dir)


@register("n3_correlation_edges", """
    SELECT 'indicator' AS src_type, CAST(substr(coalesce(leader, indicator_a), 7) AS INTEGER) AS src_ref,
           'indicator' AS dst_type, CAST(substr(coalesce(follower, indicator_b), 7) AS INTEGER) AS dst_ref,
           'CORRELATES_WITH' AS edge_type, weight FROM mined""", floats="weight")
def _(spark, sf_dir):
    brands = tables.table(spark, sf_dir, "part").select(F.col("p_brand").alias("name")).distinct().withColumn(
        "id", F.substring("name", 7, 10).cast("int"))
    return gr.correlation_edges(stored_edges(spark, sf_dir), brands)


@register("n4_degree_centrality", "SELECT * FROM centrality", floats="centrality", digits=9)
def _(spark, sf_dir):
    return gr.degree_centrality(_nodes(spark, sf_dir), _edges(spark, sf_dir))


def _label_rounds(rounds: int) -> str:
    """Label propagation unrolled: one pair of expressions per round."""
    text = """WITH ends AS (SELECT DISTINCT least((src_type, src_ref), (dst_type, dst_ref)) AS a,
                         greatest((src_type, src_ref), (dst_type, dst_ref)) AS b FROM g_edges),
        vertex AS (SELECT (node_type, ref_id) AS node, id FROM nodes),
        near AS (SELECT a AS node, b AS other FROM ends WHERE a <> b UNION ALL SELECT b, a FROM ends WHERE a <> b),
        links AS (SELECT * FROM near UNION ALL SELECT node, node FROM vertex),
        lab0 AS MATERIALIZED (SELECT node, id AS community FROM vertex)"""
    for i in range(1, rounds + 1):
        text += f""", lab{i} AS MATERIALIZED (SELECT node, arg_min(community, (-n, community)) AS community FROM (
            SELECT l.node, p.community, count(*) AS n FROM links l JOIN lab{i - 1} p ON p.node = l.other GROUP BY ALL)
            GROUP BY node)"""
    return text


@register("n5_communities", _label_rounds(5) + """
    SELECT node_type, ref_id, community, NOT EXISTS (
      SELECT 1 FROM lab5 a JOIN lab4 b ON a.node = b.node AND a.community <> b.community) AS converged
    FROM lab5 JOIN nodes n ON (n.node_type, n.ref_id) = lab5.node""")
def _(spark, sf_dir):
    return gr.communities(_nodes(spark, sf_dir), _edges(spark, sf_dir), iterations=5)


@register("n5_modularity", _label_rounds(5) + """,
    per AS (SELECT x.community AS c, count(*) AS deg, count(*) FILTER (x.community = y.community) AS inner_deg
            FROM near JOIN lab5 x ON x.node = near.node JOIN lab5 y ON y.node = near.other GROUP BY ALL)
    SELECT sum(inner_deg / t - (deg / t) * (deg / t)) AS modularity
    FROM per, (SELECT sum(deg)::DOUBLE AS t FROM per)""", floats="modularity")
def _(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return gr.modularity(gr.communities(_nodes(spark, sf_dir), edges, iterations=5), edges)


@register("n6_top_central", _label_rounds(3) + """
    SELECT label, c.node_type, c.ref_id, centrality, community FROM centrality c
    JOIN lab3 ON lab3.node = (c.node_type, c.ref_id) ORDER BY degree DESC, c.node_type, c.ref_id LIMIT 12""",
          floats="centrality", digits=9)
def _(spark, sf_dir):
    nodes, edges = _nodes(spark, sf_dir), _edges(spark, sf_dir)
    return gr.top_central(gr.degree_centrality(nodes, edges), gr.communities(nodes, edges, 3))


@register("n7_arcs", """
    SELECT x AS src, y AS dst, weight, directed FROM (
      SELECT unnest([indicator_a, indicator_b]) AS x, unnest([indicator_b, indicator_a]) AS y, weight, direction,
             indicator_a, direction <> 'undetermined' AS directed FROM mined WHERE abs(weight) >= 0.15)
    WHERE direction = 'undetermined' OR (direction = 'a_leads_b') = (x = indicator_a)""", floats="weight")
def _(spark, sf_dir):
    return gr.arcs(stored_edges(spark, sf_dir), 0.15)


@register("n8_is_variant", r"""
    WITH n AS (SELECT DISTINCT p_name || ' (' || p_type || ')' AS a, p_name || ' ' || p_brand AS b,
                               p_brand || ' ' || p_name AS c FROM part)
    SELECT a, b, c, starts_with(lower(trim(regexp_replace(b, '\s*\(.*?\)', '', 'g'))),
                                lower(trim(regexp_replace(a, '\s*\(.*?\)', '', 'g')))) AS ab,
           starts_with(c, a) OR starts_with(lower(trim(regexp_replace(a, '\s*\(.*?\)', '', 'g'))), lower(c)) AS ac
    FROM n""")
def _(spark, sf_dir):
    names = tables.table(spark, sf_dir, "part").select(
        F.concat("p_name", F.lit(" ("), "p_type", F.lit(")")).alias("a"), F.concat_ws(" ", "p_name", "p_brand").alias("b"),
        F.concat_ws(" ", "p_brand", "p_name").alias("c")).distinct()
    return names.withColumn("ab", is_variant(F.col("a"), F.col("b"))).withColumn(
        "ac", is_variant(F.col("a"), F.col("c")))


_SHOCK = {"max_hops": 3, "decay": 0.9, "threshold": 0.001, "edge_floor": 0.15}


def _sources(spark, sf_dir):
    return tables.table(spark, sf_dir, "part").select(F.col("p_brand").alias("source")).distinct()


def _propagated(spark, sf_dir):
    return gr.propagate(stored_edges(spark, sf_dir), _sources(spark, sf_dir), **_SHOCK)


_WALK = """
    WITH RECURSIVE walk AS (
      SELECT DISTINCT p_brand AS source, p_brand AS node, 0 AS hop, 1.0::DOUBLE AS activation, [p_brand] AS path,
             true AS directed FROM part
      UNION ALL
      SELECT w.source, a.dst, w.hop + 1, w.activation * a.weight * 0.9, list_append(w.path, a.dst),
             w.directed AND a.directed
      FROM walk w JOIN pooled_arcs a ON a.src = w.node
      WHERE w.hop < 3 AND abs(w.activation * a.weight * 0.9) >= 0.001),
    reached AS (
      SELECT w.*, n.stem FROM walk w JOIN stems s ON s.name = w.source JOIN stems n ON n.name = w.node
      WHERE w.node <> w.source AND NOT starts_with(s.stem, n.stem) AND NOT starts_with(n.stem, s.stem)
      QUALIFY row_number() OVER (PARTITION BY w.source, w.node ORDER BY abs(activation) DESC, hop, path) = 1)"""


@register("n9_propagate", _WALK + " SELECT source, node, hop, activation, directed, array_to_string(path, ' → ') AS path FROM reached",
          floats="activation", digits=9)
def _(spark, sf_dir):
    """A shock to every indicator at once."""
    return _propagated(spark, sf_dir).select("source", "node", "hop", "activation", "directed", "path")


@register("n10_collapse_variants", _WALK + """,
    queue AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY hop, -abs(activation), node) AS i FROM reached),
    fold AS (
      SELECT source, i, [stem] AS kept, true AS taken FROM queue WHERE i = 1
      UNION ALL
      SELECT q.source, q.i, CASE WHEN clash THEN kept ELSE list_append(kept, q.stem) END, NOT clash
      FROM (SELECT q.source, q.i, q.stem, f.kept,
                   len(list_filter(f.kept, lambda k: starts_with(k, q.stem) OR starts_with(q.stem, k))) > 0 AS clash
            FROM fold f JOIN queue q ON q.source = f.source AND q.i = f.i + 1) q)
    SELECT q.source, q.node, q.hop, q.activation, array_to_string(q.path, ' → ') AS path
    FROM queue q JOIN fold f ON f.source = q.source AND f.i = q.i AND f.taken""", floats="activation", digits=9)
def _(spark, sf_dir):
    return gr.collapse_variants(_propagated(spark, sf_dir)).select("source", "node", "hop", "activation", "path")


@register("n11_propagate_per_unit", """
    WITH RECURSIVE arc AS (
      SELECT unit, unnest([indicator_a, indicator_b]) AS src, unnest([indicator_b, indicator_a]) AS dst,
             correlation AS weight
      FROM local_r JOIN stems sa ON sa.name = indicator_a JOIN stems sb ON sb.name = indicator_b
      WHERE NOT starts_with(sa.stem, sb.stem) AND NOT starts_with(sb.stem, sa.stem) AND abs(correlation) >= 0.5),
    walk AS (
      SELECT u.unit, b.name AS source, b.name AS node, 0 AS hop, 1.0::DOUBLE AS activation, [b.name] AS path
      FROM (SELECT DISTINCT unit FROM brand) u, stems b
      UNION ALL
      SELECT w.unit, w.source, a.dst, w.hop + 1, w.activation * a.weight * 0.6, list_append(w.path, a.dst)
      FROM walk w JOIN arc a ON a.unit = w.unit AND a.src = w.node
      WHERE w.hop < 2 AND abs(w.activation * a.weight * 0.6) >= 0.05)
    SELECT unit, source, node, hop, activation, array_to_string(path[2:-2], ' → ') AS via,
           array_to_string(path, ' → ') AS path, false AS directed FROM (
      SELECT w.* FROM walk w JOIN stems s ON s.name = w.source JOIN stems n ON n.name = w.node
      WHERE w.node <> w.source AND NOT starts_with(s.stem, n.stem) AND NOT starts_with(n.stem, s.stem))
    QUALIFY row_number() OVER (PARTITION BY unit, source, node ORDER BY abs(activation) DESC, hop, path) = 1""",
          floats="activation", digits=9)
def _(spark, sf_dir):
    """Every unit's own correlations, every indicator as a source."""
    local = (cor.local_correlations(growths(spark, sf_dir), stored_edges(spark, sf_dir))
             .withColumnRenamed("correlation", "weight").withColumn("direction", F.lit("undetermined")))
    sources = tables.brand_frame(spark, sf_dir).select("unit", F.col("indicator").alias("source")).distinct()
    return gr.propagate(local, sources, max_hops=2, edge_floor=0.5, by=["unit"])


# --- forecasts ----------------------------------------------------------------
CTES["fser"] = """
    SELECT unit, indicator, value, CAST(year * 12 + CASE WHEN month > 0 THEN month - 1 WHEN quarter > 0
             THEN (quarter - 1) * 3 ELSE 0 END AS INTEGER) AS ix,
           CAST(max(CASE WHEN month > 0 THEN 12 WHEN quarter > 0 THEN 4 ELSE 1 END)
             OVER (PARTITION BY unit, indicator) AS INTEGER) AS freq,
           row_number() OVER (PARTITION BY unit, indicator ORDER BY year, quarter, month) - 1 AS pos,
           count(*) OVER (PARTITION BY unit, indicator) AS n
    FROM srs WHERE value IS NOT NULL"""
_KEYS = ["unit", "indicator"]
_HORIZON = 5


def _series(spark, sf_dir):
    return ser.series(tables.panel(spark, sf_dir))


@register("f1_frequency", f"""
    SELECT unit, indicator, freq, CAST(n AS INTEGER) AS n_obs,
           CAST((ix1 - ix0) // (12 // freq) + 1 - n AS INTEGER) AS n_gaps, CAST(h AS INTEGER) AS h,
           CASE freq WHEN 12 THEN (ix // 12) || '-' || lpad(CAST(ix % 12 + 1 AS VARCHAR), 2, '0')
                     WHEN 4 THEN (ix // 12) || '-Q' || (ix % 12 // 3 + 1) ELSE CAST(ix // 12 AS VARCHAR) END AS period,
           ix / 12.0::DOUBLE AS t
    FROM (SELECT *, ix1 + h * (12 // freq) AS ix
          FROM (SELECT unit, indicator, freq, n, min(ix) AS ix0, max(ix) AS ix1 FROM fser GROUP BY ALL),
               (SELECT unnest(range(1, {_HORIZON + 1})) AS h))""", floats="t")
def _(spark, sf_dir):
    return fc.horizon_labels(fc.series_rows(_series(spark, sf_dir)), _KEYS, _HORIZON)


def _fan(inner: str, value: str) -> str:
    return f"""SELECT unit, indicator, CAST(h AS INTEGER) AS h, {value} AS value FROM ({inner}),
        (SELECT unnest(range(1, {_HORIZON + 1})) AS h)"""


@register("f2_drift", _fan("""
    SELECT unit, indicator, arg_min(value, ix) AS y0, arg_max(value, ix) AS y1, count(*) AS k FROM fser GROUP BY ALL""",
    "y1 + coalesce((y1 - y0) / nullif(k - 1, 0), 0) * h"), floats="value")
def _(spark, sf_dir):
    return fc.drift(_series(spark, sf_dir), _HORIZON)


_FIT_SQL = """SELECT unit, indicator, regr_slope({y}, pos) AS b, regr_intercept({y}, pos) AS a, count(*) AS k
    FROM fser GROUP BY ALL HAVING count(*) >= 2"""


@register("f3_linear", _fan(_FIT_SQL.format(y="value"), "a + b * (k - 1 + h)"), floats="value", digits=4)
def _(spark, sf_dir):
    return fc.linear(_series(spark, sf_dir), _HORIZON)


@register("f3_log_linear", f"""SELECT * REPLACE (ln(value) AS value) FROM ({
    _fan(_FIT_SQL.format(y="ln(value)") + " AND min(value) > 0", "exp(a + b * (k - 1 + h))")})""", floats="value")
def _(spark, sf_dir):
    """Compared on the log scale, where rounding is meaningful for values of any size."""
    return fc.linear(_series(spark, sf_dir), _HORIZON, log=True).withColumn("value", F.ln("value"))


@register("f4_holt", f"""
    WITH RECURSIVE fold AS (
      SELECT f.unit, f.indicator, f.pos, f.n, f.value AS level, coalesce(s.value - f.value, 0.0) AS trend
      FROM fser f LEFT JOIN fser s ON s.unit = f.unit AND s.indicator = f.indicator AND s.pos = 1 WHERE f.pos = 0
      UNION ALL
      SELECT unit, indicator, pos, n, nl, 0.3 * (nl - level) + 0.7 * trend
      FROM (SELECT f.unit, f.indicator, f.pos, f.n, p.level, p.trend,
                   0.5 * f.value + 0.5 * (p.level + p.trend) AS nl
            FROM fold p JOIN fser f ON f.unit = p.unit AND f.indicator = p.indicator AND f.pos = p.pos + 1))
    SELECT unit, indicator, CAST(h AS INTEGER) AS h, level + trend * h AS value
    FROM fold, (SELECT unnest(range(1, {_HORIZON + 1})) AS h) WHERE pos = n - 1""", floats="value", digits=4)
def _(spark, sf_dir):
    return fc.holt(_series(spark, sf_dir), _HORIZON)


def _seasonal_fan(inner: str, value: str) -> str:
    return predictions() + f"""
    SELECT c.unit, c.indicator, CAST(h AS INTEGER) AS h, {value} AS value
    FROM {inner} CROSS JOIN (SELECT unnest(range(1, {_HORIZON + 1})) AS h) WHERE c.freq > 1 AND c.n >= 2 * c.freq"""


@register("f5_seasonal_naive", _seasonal_fan("arr c", """c.v[c.n - c.freq + (h - 1) % c.freq + 1] + ((h - 1) // c.freq + 1)
    * (list_avg(c.v[c.n - c.freq + 1:c.n]) - list_avg(c.v[c.n - 2 * c.freq + 1:c.n - c.freq]))"""), floats="value", digits=4)
def _(spark, sf_dir):
    return fc.seasonal(_series(spark, sf_dir), _HORIZON, "seasonal_naive")


@register("f6_holt_winters", _seasonal_fan("arr c JOIN hw w ON w.unit = c.unit AND w.indicator = c.indicator AND w.t = c.n",
          "w.level + w.trend * h + w.season[(c.n + h - 1) % c.freq + 1]"), floats="value", digits=4)
def _(spark, sf_dir):
    return fc.seasonal(_series(spark, sf_dir), _HORIZON, "holt_winters")


@register("f7_backtest", predictions() + """
    SELECT s.unit, s.indicator, CAST(a.n AS INTEGER) AS n_obs, mae,
           ['drift', 'linear', 'log_linear', 'holt', 'seasonal_naive', 'holt_winters'][s.model + 1] AS model
    FROM scored s JOIN arr a ON a.unit = s.unit AND a.indicator = s.indicator""", floats="mae", digits=4)
def _(spark, sf_dir):
    return fc.backtest(_series(spark, sf_dir))


_FORECAST_FLOATS = "value lo hi backtest_mae"


@register("f8_forecast", forecast_sql(5, 0.8, with_history=False), floats=_FORECAST_FLOATS, digits=4)
def _(spark, sf_dir):
    return fc.forecast(_series(spark, sf_dir)).where("kind = 'forecast'")


@register("f9_history_and_forecast", forecast_sql(8, 0.95, with_history=True), floats=_FORECAST_FLOATS, digits=4)
def _(spark, sf_dir):
    return fc.forecast(_series(spark, sf_dir), horizon=8, level=0.95)
