"""Views, catalog, series, transforms, rankings and revisions over the derived panel."""
from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import aggregates as agg, catalog as cat, series as ser, views
from panelspark.plans import tables
from panelspark.plans.registry import register
from panelspark.session import cut_lineage

FACT_COLS = ["geography_id", "indicator_id", "source_id", "year", "quarter", "month",
             "vintage_date", "value"]
_FACTS = ", ".join(FACT_COLS)
AS_OF_YEAR = 2001


def _series(spark, sf_dir, **kw):
    return ser.series(tables.panel(spark, sf_dir), **kw)


def _latest(spark, sf_dir):
    return ser.latest_series(tables.panel(spark, sf_dir))


def _annual(spark, sf_dir):
    p = tables.panel(spark, sf_dir)
    return views.unit_year_frame(p.best, p.geography, p.indicator)


# --- views -------------------------------------------------------------------
@register("s1_read_panel", f"SELECT {_FACTS} FROM records")
def _(spark, sf_dir):
    return tables.records(spark, sf_dir).select(FACT_COLS)


@register("v1_current_vintage", f"SELECT {_FACTS} FROM cur_v")
def _(spark, sf_dir):
    return tables.panel(spark, sf_dir).current.select(FACT_COLS)


@register("v2_best_source", f"SELECT {_FACTS} FROM best")
def _(spark, sf_dir):
    return tables.panel(spark, sf_dir, stored_best=False).best.select(FACT_COLS)


_AS_OF = f"""
    SELECT {_FACTS} FROM records WHERE coalesce(vintage_date, DATE '0001-01-01') <= DATE '1998-06-30'
    QUALIFY rank() OVER (PARTITION BY geography_id, indicator_id, source_id, year, quarter, month
                         ORDER BY coalesce(vintage_date, DATE '0001-01-01') DESC) = 1"""


@register("v3_as_of", _AS_OF)
def _(spark, sf_dir):
    return views.as_of(tables.records(spark, sf_dir), "1998-06-30").select(FACT_COLS)


@register("v3_known_on", _AS_OF)
def _(spark, sf_dir):
    """The same day, filtered from every fact's interval of validity, written once for any number of days."""
    intervals = cut_lineage(views.validity(tables.records(spark, sf_dir)))
    return views.known_on(intervals, "1998-06-30").select(FACT_COLS)


@register("v4_provenance", """
    SELECT unit, indicator, period, year, t, source, value, value_unit, reliability_score, is_best FROM prov""",
    floats="t")
def _(spark, sf_dir):
    p = tables.panel(spark, sf_dir)
    return views.provenance(p.current, p.source, p.indicator, p.geography)


@register("v5_source_disagreements", """
    SELECT unit, indicator, period, source, value, is_best FROM prov
    WHERE (unit, indicator, period) IN (
      SELECT (unit, indicator, period) FROM prov GROUP BY unit, indicator, period
      HAVING count(DISTINCT source) >= 2 AND count(DISTINCT value) >= 2)""")
def _(spark, sf_dir):
    p = tables.panel(spark, sf_dir)
    return views.source_disagreements(p.current, p.source, p.indicator, p.geography).select(
        "unit", "indicator", "period", "source", "value", "is_best")


@register("v6_annualize", "SELECT * FROM annual", floats="value")
def _(spark, sf_dir):
    return _annual(spark, sf_dir)


# --- projections, filters, catalog -------------------------------------------
@register("p1_series", "SELECT * FROM srs", floats="t")
def _(spark, sf_dir):
    return _series(spark, sf_dir)


@register("p2_filters", """
    SELECT unit, indicator, period, value, source FROM srs
    WHERE lower(domain) = 'trade' AND lower(source) = 'priority 2' AND year BETWEEN 1997 AND 1999""")
def _(spark, sf_dir):
    return _series(spark, sf_dir, domain="TRADE", source="Priority 2", start=1997, end=1999).select(
        "unit", "indicator", "period", "value", "source")


@register("p3_in_bloc", """
    SELECT unit, indicator, period, value FROM srs WHERE unit IN (
      SELECT g.u FROM geography_bloc gb JOIN bloc b ON b.id = gb.bloc_id JOIN geo g ON g.id = gb.geography_id
      WHERE b.code = 'B1' AND gb.until_year IS NULL)""")
def _(spark, sf_dir):
    return _series(spark, sf_dir, bloc="b1").select("unit", "indicator", "period", "value")


@register("p4_members_at", """
    SELECT e.code, g.u AS unit FROM event e JOIN bloc b ON b.code = e.bloc_code
    JOIN geography_bloc gb ON gb.bloc_id = b.id JOIN geo g ON g.id = gb.geography_id
    WHERE gb.since_year <= year(e.start_date) AND (gb.until_year IS NULL OR gb.until_year > year(e.start_date))""")
def _(spark, sf_dir):
    p = tables.panel(spark, sf_dir)
    evs = p.event.where("bloc_code is not null").select("code", "bloc_code", F.year("start_date").alias("year"))
    geo = views.unit_code(p.geography).select(F.col("id").alias("geography_id"), "unit")
    return (ser.members_at(evs, p.geography_bloc, p.bloc).join(geo, "geography_id").select("code", "unit"))


@register("p5_countries", """
    SELECT iso3, iso2, name, is_transcontinental, is_disputed,
           (SELECT count(*) FROM geography r WHERE r.parent_id = g.id) AS n_regions
    FROM geography g WHERE level = 'country'""")
def _(spark, sf_dir):
    g = tables.geography(spark, sf_dir)
    children = g.where("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n_regions"))
    return cat.countries(g, keep_id=True).join(children, "id", "left").select(
        "iso3", "iso2", "name", "is_transcontinental", "is_disputed",
        F.coalesce("n_regions", F.lit(0)).alias("n_regions"))


@register("p5_regions", """
    WITH nations AS (SELECT id AS parent_id, iso3 AS country_iso3, name AS country FROM geography)
    SELECT code, name, country_iso3, country FROM (SELECT * FROM geography WHERE level = 'NUTS2')
    JOIN nations USING (parent_id)""")
def _(spark, sf_dir):
    return cat.regions(tables.geography(spark, sf_dir))


@register("p6_blocs", """
    WITH held AS (SELECT bloc_id AS id, count(*) AS n FROM geography_bloc WHERE until_year IS NULL GROUP BY bloc_id)
    SELECT code, name, coalesce(n, 0) AS current_members FROM bloc LEFT JOIN held USING (id)""")
def _(spark, sf_dir):
    return cat.blocs(tables.bloc(spark, sf_dir), tables.geography_bloc(spark, sf_dir))


@register("p7_bloc_members", """
    SELECT b.code AS bloc, g.u AS unit, g.name, gb.since_year, gb.until_year FROM geography_bloc gb
    JOIN bloc b ON b.id = gb.bloc_id JOIN geo g ON g.id = gb.geography_id""")
def _(spark, sf_dir):
    p = tables.panel(spark, sf_dir)
    return cat.bloc_members(p.bloc, p.geography_bloc, p.geography)


@register("p7_unit_blocs", """
    SELECT g.u AS unit, b.code AS bloc_code, b.name AS bloc_name, gb.since_year, gb.until_year
    FROM geography_bloc gb JOIN bloc b ON b.id = gb.bloc_id JOIN geo g ON g.id = gb.geography_id""")
def _(spark, sf_dir):
    p = tables.panel(spark, sf_dir)
    return cat.unit_blocs(p.bloc, p.geography_bloc, p.geography)


@register("p8_catalog", """
    SELECT s.name AS source, s.reliability_score, i.name AS indicator, d.name AS domain, i.unit, i.api_code,
           i.definition, i.is_proxy, i.proxy_note, count(*) AS records
    FROM records r JOIN source s ON s.id = r.source_id JOIN indicator i ON i.id = r.indicator_id
    JOIN domain d ON d.id = i.domain_id GROUP BY ALL""")
def _(spark, sf_dir):
    return cat.source_catalog(tables.panel(spark, sf_dir))


@register("p9_search", """
    SELECT i.name, d.name AS domain, i.api_code, count(r.value) AS records
    FROM indicator i JOIN domain d ON d.id = i.domain_id LEFT JOIN records r ON r.indicator_id = i.id
    WHERE contains(lower(i.name), 'pro') OR contains(lower(coalesce(i.definition, '')), 'pro')
       OR contains(lower(coalesce(i.api_code, '')), 'pro') OR contains(lower(d.name), 'pro')
       OR contains(lower(d.name), 'tail') GROUP BY ALL""")
def _(spark, sf_dir):
    p = tables.panel(spark, sf_dir)
    found = cat.search_indicators(p.indicator, p.domain, "PRO").unionByName(
        cat.search_indicators(p.indicator, p.domain, "tail")).distinct()
    counts = p.records.groupBy("indicator_id").agg(F.count("value").alias("records"))
    return found.join(counts, "indicator_id", "left").select(
        "name", "domain", "api_code", F.coalesce("records", F.lit(0)).alias("records"))


@register("p10_resolve_names", """
    WITH asked AS (SELECT DISTINCT upper(c_name) AS asked FROM customer
                   UNION SELECT DISTINCT 'nation_' || s_nationkey || 'x' FROM supplier),
    found AS (SELECT a.asked, min(g.id) AS id FROM asked a LEFT JOIN geography g
              ON lower(a.asked) IN (lower(g.iso3), lower(g.iso2), lower(g.name), lower(g.code)) GROUP BY ALL),
    pool AS (SELECT code AS name FROM geography WHERE level = 'country'
             UNION SELECT name FROM geography WHERE level = 'country'),
    pairs AS (SELECT f.asked, p.name, 1 - levenshtein(lower(f.asked), lower(p.name))
                       / greatest(length(f.asked), length(p.name))::DOUBLE AS score
              FROM found f, pool p WHERE f.id IS NULL),
    top AS (SELECT asked, string_agg(name, '|' ORDER BY rn) AS suggestions
            FROM (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY score DESC, name) AS rn
                  FROM pairs WHERE score >= 0.4) WHERE rn <= 3 GROUP BY asked)
    SELECT f.asked, f.id, coalesce(t.suggestions, '') AS suggestions FROM found f LEFT JOIN top t USING (asked)""")
def _(spark, sf_dir):
    """Customer names in upper case resolve; misspelt nations get suggestions."""
    geo = tables.geography(spark, sf_dir)
    asked = (tables.table(spark, sf_dir, "customer").select(F.upper("c_name").alias("asked"))
             .unionByName(tables.table(spark, sf_dir, "supplier").select(
                 F.concat(F.lit("nation_"), F.col("s_nationkey"), F.lit("x")).alias("asked"))))
    out = cat.resolve_names(asked, "asked", geo, ["iso3", "iso2", "name", "code"],
                            suggest_from=geo.where("level = 'country'"), suggest_cols=["code", "name"])
    return out.withColumn("suggestions", F.array_join("suggestions", "|"))


@register("p11_panel_stats", """
    SELECT min(year) AS first_year, max(year) AS last_year, max(vintage_date) AS max_vintage, count(*) AS rows
    FROM records""")
def _(spark, sf_dir):
    return agg.panel_stats(tables.records(spark, sf_dir))


@register("p12_narrow_series", """
    SELECT year, unit, value FROM srs WHERE unit IN ('N01', 'N07', 'N24') AND indicator = 'STANDARD'""")
def _(spark, sf_dir):
    return ser.narrow_series(_series(spark, sf_dir), ["N01", "N07", "N24"], "STANDARD")


@register("p13_populated_indicators", """
    SELECT i.name, d.name AS domain, i.unit, count(b.geography_id) AS rows
    FROM indicator i JOIN domain d ON d.id = i.domain_id LEFT JOIN best b ON b.indicator_id = i.id
    GROUP BY 1, 2, 3 HAVING count(b.geography_id) > 0""")
def _(spark, sf_dir):
    return agg.populated_indicators(tables.panel(spark, sf_dir))


@register("p14_sql_over_views", """
    SELECT i.name AS indicator, b.year, CAST(sum(b.value) AS DOUBLE) AS total, count(*) AS n
    FROM best b JOIN indicator i ON i.id = b.indicator_id GROUP BY ALL""")
def _(spark, sf_dir):
    cat.register_views(tables.panel(spark, sf_dir))
    return spark.sql("""SELECT i.name AS indicator, b.year, sum(b.value) AS total, count(*) AS n
                        FROM statistic_best b JOIN indicator i ON i.id = b.indicator_id
                        GROUP BY i.name, b.year""")


# --- transforms --------------------------------------------------------------
@register("t1_yoy", """
    SELECT a.unit, a.indicator, a.period, (a.value / b.value - 1) * 100 AS value, '% y/y' AS value_unit
    FROM srs a JOIN srs b ON a.unit = b.unit AND a.indicator = b.indicator AND a.year = b.year + 1
     AND a.quarter = b.quarter AND a.month = b.month WHERE b.value <> 0""", floats="value")
def _(spark, sf_dir):
    return ser.yoy_series(tables.panel(spark, sf_dir)).select("unit", "indicator", "period", "value", "value_unit")


@register("t2_rebase", """
    WITH base AS (SELECT unit, indicator, avg(value) AS base FROM srs WHERE year = 1996 GROUP BY ALL)
    SELECT s.unit, s.indicator, s.period, s.value / base * 100 AS value, 'index (1996=100)' AS value_unit
    FROM srs s JOIN base USING (unit, indicator) WHERE base <> 0""", floats="value")
def _(spark, sf_dir):
    return ser.rebase(_series(spark, sf_dir), 1996).select("unit", "indicator", "period", "value", "value_unit")


@register("t3_growth", """
    SELECT * FROM (SELECT unit, indicator, year,
      (value / nullif(lag(value) OVER (PARTITION BY unit, indicator ORDER BY year), 0) - 1) * 100 AS growth
      FROM annual) WHERE growth IS NOT NULL""", floats="growth")
def _(spark, sf_dir):
    return ser.growth(_annual(spark, sf_dir))


@register("t4_compare", """
    SELECT period, avg(value) FILTER (unit = 'N01') AS "N01", avg(value) FILTER (unit = 'N02') AS "N02",
           avg(value) FILTER (unit = 'N03') AS "N03"
    FROM srs WHERE indicator = 'ECONOMY' AND unit IN ('N01', 'N02', 'N03') AND year >= 1996 GROUP BY period""",
    floats="N01 N02 N03")
def _(spark, sf_dir):
    return ser.compare(_series(spark, sf_dir), ["N01", "N02", "N03"], "ECONOMY", start=1996)


@register("t5_trends", """
    WITH med AS (SELECT indicator, year, median(value) AS m, count(*) AS n_countries FROM annual
                 WHERE indicator IN ('ECONOMY', 'PROMO', 'STANDARD') GROUP BY ALL),
    base_year AS (SELECT min(year) AS y FROM (SELECT year FROM med GROUP BY year HAVING count(*) = 3))
    SELECT a.indicator, a.year, a.m / nullif(b.m, 0) * 100 AS value, a.n_countries, y AS base_year
    FROM med a, base_year JOIN med b ON b.indicator = a.indicator AND b.year = y""", floats="value")
def _(spark, sf_dir):
    return ser.trends(_annual(spark, sf_dir), ["ECONOMY", "PROMO", "STANDARD"])


@register("t6_observation_matrix", """
    SELECT unit, year, """ + ", ".join(
        f'avg(value) FILTER (indicator = \'{t}\') AS "{t}"' for t in tables.PART_TYPES) + """
    FROM srs GROUP BY unit, year""", floats=" ".join(tables.PART_TYPES))
def _(spark, sf_dir):
    return ser.observation_matrix(_series(spark, sf_dir), tables.PART_TYPES)


@register("t7_span_change", """
    SELECT unit, indicator, arg_min(period, t) AS first_period, arg_min(value, t) AS first_value,
           arg_max(period, t) AS last_period, arg_max(value, t) AS last_value,
           arg_max(value, t) - arg_min(value, t) AS net_change,
           (arg_max(value, t) - arg_min(value, t)) / nullif(abs(arg_min(value, t)), 0) * 100 AS pct_change
    FROM srs GROUP BY unit, indicator""", floats="pct_change")
def _(spark, sf_dir):
    return ser.span_change(_series(spark, sf_dir))


@register("t8_kpi", """
    SELECT unit, indicator, value, year, value_unit, (value - prev) / nullif(abs(prev), 0) * 100 AS yoy
    FROM (SELECT *, lag(value) OVER w AS prev, row_number() OVER (
            PARTITION BY unit, indicator ORDER BY year DESC, t DESC) AS rn
          FROM srs WINDOW w AS (PARTITION BY unit, indicator ORDER BY year, t)) WHERE rn = 1""", floats="yoy")
def _(spark, sf_dir):
    return ser.kpi(_series(spark, sf_dir))


# --- aggregates --------------------------------------------------------------
_LATEST_COLS = ["unit", "indicator", "period", "value", "value_unit", "source"]


@register("a1_latest", f"SELECT {', '.join(_LATEST_COLS)} FROM latest")
def _(spark, sf_dir):
    return _latest(spark, sf_dir).select(_LATEST_COLS)


@register("a2_latest_annual", f"""
    SELECT {', '.join(_LATEST_COLS)} FROM srs
    QUALIFY row_number() OVER (PARTITION BY unit, indicator ORDER BY year DESC, t DESC) = 1""")
def _(spark, sf_dir):
    return ser.latest_series(tables.panel(spark, sf_dir), annual=True).select(_LATEST_COLS)


@register("a3_ranking", """
    (SELECT 'highest' AS side, unit, indicator, value FROM latest WHERE indicator = 'LARGE'
     ORDER BY value DESC, unit LIMIT 10)
    UNION ALL
    (SELECT 'lowest', unit, indicator, value FROM latest WHERE indicator = 'LARGE' ORDER BY value, unit LIMIT 10)""")
def _(spark, sf_dir):
    rows = _latest(spark, sf_dir).where("indicator = 'LARGE'").select("unit", "indicator", "value")
    return (agg.ranking(rows, 10).select(F.lit("highest").alias("side"), "*")
            .unionByName(agg.ranking(rows, 10, "lowest").select(F.lit("lowest").alias("side"), "*")))


def _bloc_sql(where: str) -> str:
    return f"""SELECT l.indicator, b.name AS bloc, avg(l.value) AS mean_value, count(*) AS countries
        FROM latest l JOIN geo g ON g.u = l.unit JOIN geography_bloc gb ON gb.geography_id = g.id
        JOIN bloc b ON b.id = gb.bloc_id {where} GROUP BY ALL"""


@register("a4_bloc_rankings", _bloc_sql("WHERE gb.until_year IS NULL"), floats="mean_value")
def _(spark, sf_dir):
    p = tables.panel(spark, sf_dir)
    return agg.bloc_rankings(_latest(spark, sf_dir), p.geography, p.bloc, p.geography_bloc)


@register("a4_bloc_rankings_all_time", _bloc_sql(""), floats="mean_value")
def _(spark, sf_dir):
    p = tables.panel(spark, sf_dir)
    return agg.bloc_rankings(_latest(spark, sf_dir), p.geography, p.bloc, p.geography_bloc, current_only=False)


_COVERAGE = """FROM indicator i JOIN domain d ON d.id = i.domain_id LEFT JOIN best s ON s.indicator_id = i.id
    LEFT JOIN geography g ON g.id = s.geography_id"""


@register("a5_coverage", f"""
    SELECT i.name AS indicator, d.name AS domain, i.is_proxy, count(s.value) AS rows,
           count(DISTINCT s.geography_id) AS countries, min(g.level) AS geo_level, min(s.year) AS first_year,
           max(s.year) AS last_year, CAST({AS_OF_YEAR} - max(s.year) AS INTEGER) AS years_stale
    {_COVERAGE} GROUP BY i.name, d.name, i.is_proxy""")
def _(spark, sf_dir):
    return agg.coverage(tables.panel(spark, sf_dir), AS_OF_YEAR)


@register("a6_catalog_table", f"""
    SELECT i.name AS indicator, d.name AS domain, i.unit, i.api_code, i.definition, i.is_proxy, i.proxy_note,
           count(s.value) AS rows, count(DISTINCT s.geography_id) AS countries, min(s.year) AS first_year,
           max(s.year) AS last_year {_COVERAGE}
    GROUP BY i.name, d.name, i.unit, i.api_code, i.definition, i.is_proxy, i.proxy_note""")
def _(spark, sf_dir):
    return agg.coverage(tables.panel(spark, sf_dir), AS_OF_YEAR, catalog=True)


@register("a7_coverage_matrix", "SELECT indicator, " + ", ".join(
    f'nullif(count(DISTINCT unit) FILTER (year = {y}), 0) AS "{y}"' for y in range(1995, 2002))
    + " FROM srs GROUP BY indicator")
def _(spark, sf_dir):
    return agg.coverage_matrix(_series(spark, sf_dir), range(1995, 2002))


@register("a8_unit_indicators", """
    SELECT unit, indicator, domain, max(year) AS last_year FROM srs GROUP BY ALL""")
def _(spark, sf_dir):
    return agg.unit_indicators(_series(spark, sf_dir))


_HEADLINE = ("ECONOMY", "PROMO", "STANDARD")


@register("a10_headline", f"""
    SELECT unit, indicator, value, value_unit, period,
           row_number() OVER (PARTITION BY indicator ORDER BY value DESC, unit) AS rank,
           count(*) OVER (PARTITION BY indicator) AS of, median(value) OVER (PARTITION BY indicator) AS median
    FROM latest WHERE indicator IN {_HEADLINE}""", floats="median")
def _(spark, sf_dir):
    return agg.headline(_latest(spark, sf_dir), _HEADLINE).withColumn("rank", F.col("rank").cast("long"))


_MOVERS = """
    WITH win AS (SELECT s.* FROM srs s JOIN geo g ON g.u = s.unit
                 WHERE g.level = 'country' AND s.year >= (SELECT max(year) FROM srs) - 10),
    chg AS (SELECT unit, indicator, min(year) AS from_year, max(year) AS to_year,
                   arg_max(value, t) - arg_min(value, t) AS change FROM win GROUP BY ALL
            HAVING min(year) < max(year)),
    pct AS (SELECT *, (rank() OVER (PARTITION BY indicator ORDER BY change)
                       + (count(*) OVER (PARTITION BY indicator, change) - 1) / 2.0)
                      / count(*) OVER (PARTITION BY indicator) AS pct,
                   count(*) OVER (PARTITION BY indicator) AS peers FROM chg),
    ends AS (SELECT unit, arg_max(struct_pack(i := indicator, c := change, p := pct), (pct, indicator)) AS top,
                      arg_min(struct_pack(i := indicator, c := change, p := pct), (pct, indicator)) AS bottom
               FROM pct WHERE peers >= 5 GROUP BY unit)"""


@register("a11_movers", _MOVERS + """
    SELECT unit, CASE WHEN top.c > 0 THEN top.i END AS rising, CASE WHEN top.c > 0 THEN top.c END AS rise,
           CASE WHEN top.c > 0 THEN round_even(top.p * 100, 0) END AS rise_percentile,
           CASE WHEN bottom.c < 0 THEN bottom.i END AS falling, CASE WHEN bottom.c < 0 THEN bottom.c END AS fall,
           CASE WHEN bottom.c < 0 THEN round_even(bottom.p * 100, 0) END AS fall_percentile FROM ends""",
    floats="rise fall")
def _(spark, sf_dir):
    p = tables.panel(spark, sf_dir)
    levels = views.unit_code(p.geography).select("unit", "level")
    up, down = F.col("fastest_rising"), F.col("fastest_falling")
    return agg.movers(_series(spark, sf_dir), levels).select(
        "unit", up["indicator"].alias("rising"), up["change"].alias("rise"),
        up["percentile"].alias("rise_percentile"), down["indicator"].alias("falling"),
        down["change"].alias("fall"), down["percentile"].alias("fall_percentile"))


@register("a12_profiles", _MOVERS + f""",
    heads AS (SELECT unit, string_agg(indicator || ' ' || rank || '/' || n, '; ' ORDER BY indicator) AS headline FROM (
        SELECT unit, indicator, row_number() OVER (PARTITION BY indicator ORDER BY value DESC, unit) AS rank,
               count(*) OVER (PARTITION BY indicator) AS n FROM latest WHERE indicator IN {_HEADLINE}) GROUP BY unit),
    spans AS (SELECT geography_id, string_agg(b.code || ' ' || since_year || coalesce('-' || until_year, ''), '; '
                ORDER BY since_year, b.code) AS blocs
              FROM geography_bloc gb JOIN bloc b ON b.id = gb.bloc_id GROUP BY geography_id),
    stats AS (SELECT unit, count(DISTINCT indicator) AS n_indicators, max(year) AS last_year FROM srs GROUP BY unit)
    SELECT g.u AS unit, g.iso2, g.name, blocs, headline, coalesce(n_indicators, 0) AS n_indicators, last_year,
           CASE WHEN top.c > 0 THEN top.i END AS rising, CASE WHEN bottom.c < 0 THEN bottom.i END AS falling
    FROM geo g LEFT JOIN spans ON spans.geography_id = g.id LEFT JOIN heads ON heads.unit = g.u
    LEFT JOIN ends ON ends.unit = g.u LEFT JOIN stats ON stats.unit = g.u""")
def _(spark, sf_dir):
    """The nested profile row of every unit, its arrays printed for comparison."""
    p = tables.panel(spark, sf_dir)
    rows = ser.series(p)
    nested = agg.profiles(p, rows, agg.latest(rows), indicators=_HEADLINE)

    def listed(col, item):
        return F.when(F.col(col).isNotNull(), F.array_join(F.transform(col, item), "; "))

    return nested.select(
        "unit", "iso2", "name",
        listed("blocs", lambda b: F.concat(b["code"], F.lit(" "), b["since_year"], F.coalesce(
            F.concat(F.lit("-"), b["until_year"]), F.lit("")))).alias("blocs"),
        listed("headline", lambda h: F.concat(h["indicator"], F.lit(" "), h["rank"], F.lit("/"), h["of"])).alias("headline"),
        "n_indicators", "last_year", F.col("fastest_rising.indicator").alias("rising"),
        F.col("fastest_falling.indicator").alias("falling"))


@register("a13_region_map", """
    SELECT unit, indicator, value FROM latest WHERE starts_with(unit, '07') AND value IS NOT NULL""")
def _(spark, sf_dir):
    return agg.with_prefix(_latest(spark, sf_dir), "07").select("unit", "indicator", "value")


@register("a14_freshness_badge", f"""
    SELECT rows, last_year, max_vintage, CAST({AS_OF_YEAR} - last_year AS INTEGER) AS age, 'brightgreen' AS color,
           format('{{:,}}', rows) || ' rows · to ' || last_year || ' · ' || CAST(max_vintage AS VARCHAR) AS message
    FROM (SELECT count(*) AS rows, max(year) AS last_year, max(vintage_date) AS max_vintage FROM records)""")
def _(spark, sf_dir):
    return agg.freshness_badge(tables.records(spark, sf_dir), AS_OF_YEAR)
