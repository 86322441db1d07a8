"""Revisions, events and event studies over the derived panel."""
from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import events as ev, revisions as rev, series as ser
from panelspark.plans import tables
from panelspark.plans.registry import register
from panelspark.plans.sql_tables import LABEL

_KEY = "geography_id, indicator_id, source_id, year, quarter, month"


# --- revisions ---------------------------------------------------------------
@register("r1_revisions", f"""
    WITH trail AS (
      SELECT {_KEY}, {LABEL} AS period, vintage_date, value, lag(value) OVER w AS previous_value,
             lead(vintage_date) OVER w IS NULL AS is_latest,
             min(value) OVER k <> max(value) OVER k AS revised
      FROM records WHERE vintage_date IS NOT NULL
      WINDOW k AS (PARTITION BY {_KEY}), w AS (PARTITION BY {_KEY} ORDER BY vintage_date))
    SELECT * EXCLUDE (revised), value - previous_value AS delta,
           (value - previous_value) / nullif(previous_value, 0) * 100 AS pct_change
    FROM trail WHERE revised""", floats="pct_change")
def _(spark, sf_dir):
    return rev.revisions(tables.records(spark, sf_dir))


@register("r2_revision_periods", f"""
    SELECT {_KEY}, {LABEL} AS period, count(DISTINCT vintage_date) AS n_vintages,
           arg_min(value, vintage_date) AS first_value, arg_max(value, vintage_date) AS latest_value,
           arg_max(value, vintage_date) - arg_min(value, vintage_date) AS delta
    FROM records WHERE vintage_date IS NOT NULL GROUP BY ALL HAVING min(value) <> max(value)""")
def _(spark, sf_dir):
    return rev.revision_periods(tables.records(spark, sf_dir))


_SUMMARY = f"""
    SELECT i.name AS indicator, g.u AS country, d.name AS domain, s.name AS source, {LABEL} AS period, r.year,
           count(DISTINCT vintage_date) AS n_vintages, arg_min(value, vintage_date) AS first_value,
           arg_max(value, vintage_date) AS latest_value, min(vintage_date) AS first_vintage,
           max(vintage_date) AS latest_vintage,
           arg_max(value, vintage_date) - arg_min(value, vintage_date) AS delta,
           (arg_max(value, vintage_date) - arg_min(value, vintage_date))
             / nullif(arg_min(value, vintage_date), 0) * 100 AS pct_change
    FROM records r JOIN geo g ON g.id = r.geography_id JOIN indicator i ON i.id = r.indicator_id
    JOIN domain d ON d.id = i.domain_id JOIN source s ON s.id = r.source_id
    WHERE vintage_date IS NOT NULL
    GROUP BY i.name, g.u, d.name, s.name, {LABEL}, r.year
    HAVING count(DISTINCT vintage_date) > 1
       AND arg_min(value, vintage_date) IS DISTINCT FROM arg_max(value, vintage_date)"""


def _summary(spark, sf_dir):
    p = tables.panel(spark, sf_dir)
    return rev.revisions_summary(p.records, p.indicator, p.domain, p.geography, p.source)


@register("r3_revisions_summary", _SUMMARY, floats="pct_change")
def _(spark, sf_dir):
    return _summary(spark, sf_dir)


@register("r4_most_revised", f"""
    SELECT indicator, count(*) AS revised_periods FROM ({_SUMMARY}) GROUP BY indicator
    ORDER BY revised_periods DESC, indicator LIMIT 10""")
def _(spark, sf_dir):
    return rev.most_revised(_summary(spark, sf_dir))


# --- events ------------------------------------------------------------------
_EVENT_COLS = "code, title, event_type, iso3, bloc_code, start_date, tags"


@register("e1_events", f"""
    SELECT {_EVENT_COLS} FROM event WHERE lower(event_type) = 'f' AND start_date BETWEEN DATE '1996-01-01'
     AND DATE '2000-06-30' AND list_contains(string_split(tags, ','), 'p2')""")
def _(spark, sf_dir):
    return ev.events(tables.events(spark, sf_dir), event_type="F", since="1996-01-01", until="2000-06-30",
                     tag="p2").select(*_EVENT_COLS.split(", "))


@register("e2_events_for", """
    SELECT g.iso3 AS unit, e.code FROM event e JOIN geography g ON g.level = 'country'
    WHERE e.iso3 = g.iso3 OR (e.iso3 IS NULL AND (e.bloc_code IS NULL OR e.bloc_code IN (
      SELECT b.code FROM geography_bloc gb JOIN bloc b ON b.id = gb.bloc_id
      WHERE gb.geography_id = g.id AND gb.until_year IS NULL)))""")
def _(spark, sf_dir):
    p = tables.panel(spark, sf_dir)
    return ev.events_for(p.event, p.geography, p.bloc, p.geography_bloc).select("unit", "code")


_EXPANDED = """
    SELECT e.*, e.iso3 AS unit FROM event e WHERE e.iso3 IS NOT NULL
    UNION ALL
    SELECT e.*, g.iso3 FROM event e JOIN bloc b ON b.code = e.bloc_code
    JOIN geography_bloc gb ON gb.bloc_id = b.id JOIN geography g ON g.id = gb.geography_id AND g.level = 'country'
    WHERE e.iso3 IS NULL AND gb.since_year <= year(e.start_date)
      AND (gb.until_year IS NULL OR gb.until_year > year(e.start_date))
    UNION ALL
    SELECT e.*, g.iso3 FROM event e, geography g
    WHERE e.iso3 IS NULL AND e.bloc_code IS NULL AND g.level = 'country'"""


def _expanded(spark, sf_dir):
    p = tables.panel(spark, sf_dir)
    return ev.expand_events(p.event, p.geography, p.bloc, p.geography_bloc)


@register("e3_expand_events", f"SELECT code, event_type, start_date, unit FROM ({_EXPANDED})")
def _(spark, sf_dir):
    return _expanded(spark, sf_dir).select("code", "event_type", "start_date", "unit")


_STUDY = f"""
    WITH spots AS (SELECT code, title, year(start_date) AS event_year, unit,
                          year(start_date) + (month(start_date) - 0.5) / 12 AS et FROM ({_EXPANDED})),
    obs AS (SELECT unit, indicator, value, year + CASE WHEN month > 0 THEN (month - 0.5) / 12
                   WHEN quarter > 0 THEN (quarter - 0.5) / 4 ELSE 0.5 END AS ot FROM srs),
    cells AS (SELECT code, title, event_year, s.unit, indicator, value,
                     ot < et - 1e-6 AS is_before FROM spots s JOIN obs o ON o.unit = s.unit
              WHERE ot >= et - 2 - 1e-6 AND ot <= et + 2 + 1e-6)
    SELECT code AS event_code, title AS event_title, CAST(event_year AS INTEGER) AS event_year, unit, indicator,
           avg(value) FILTER (is_before) AS before_mean, avg(value) FILTER (NOT is_before) AS after_mean,
           avg(value) FILTER (NOT is_before) - avg(value) FILTER (is_before) AS delta,
           (avg(value) FILTER (NOT is_before) - avg(value) FILTER (is_before))
             / nullif(abs(avg(value) FILTER (is_before)), 0) * 100 AS pct_change,
           count(*) FILTER (is_before) AS n_before, count(*) FILTER (NOT is_before) AS n_after
    FROM cells GROUP BY ALL HAVING count(*) FILTER (is_before) > 0 AND count(*) FILTER (NOT is_before) > 0"""
_STUDY_FLOATS = "before_mean after_mean delta pct_change"


def _study(spark, sf_dir):
    return ev.event_study(_expanded(spark, sf_dir), ser.series(tables.panel(spark, sf_dir)), 2)


@register("e4_event_study", _STUDY, floats=_STUDY_FLOATS)
def _(spark, sf_dir):
    return _study(spark, sf_dir)


_HOUR = 3600


@register("e4_point_event_study", """
    WITH obs AS (SELECT user_id, event_id, event_type, value, CAST(floor(epoch(ts)) AS BIGINT) AS tick FROM events),
    pairs AS (SELECT e.event_id, e.user_id, o.value, o.tick < e.tick AS is_before
              FROM obs e JOIN obs o ON o.user_id = e.user_id
              AND o.tick BETWEEN e.tick - 86400 AND e.tick + 86400 WHERE e.event_type = 'error')
    SELECT event_id AS event_code, user_id AS unit,
           avg(value) FILTER (is_before) AS before_mean, avg(value) FILTER (NOT is_before) AS after_mean,
           avg(value) FILTER (NOT is_before) - avg(value) FILTER (is_before) AS delta,
           (avg(value) FILTER (NOT is_before) - avg(value) FILTER (is_before))
             / nullif(abs(avg(value) FILTER (is_before)), 0) * 100 AS pct_change,
           count(*) FILTER (is_before) AS n_before, count(*) FILTER (NOT is_before) AS n_after
    FROM pairs GROUP BY event_id, user_id
    HAVING count(*) FILTER (is_before) > 0 AND count(*) FILTER (NOT is_before) > 0""", floats=_STUDY_FLOATS)
def _(spark, sf_dir):
    """Each user's error is an event; the user's values a day before and after. The values are
    amounts of few digits, so they are summed as decimals, exactly."""
    rows = tables.table(spark, sf_dir, "events").select(
        "event_id", "event_type", F.col("user_id").alias("unit"), F.col("value").cast("decimal(28,6)").alias("value"),
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("tick"))
    errors = rows.where("event_type = 'error'").select(F.col("event_id").alias("event_code"), "unit", "tick")
    return ev.point_event_study(errors, rows.select("unit", "tick", "value"), window=24 * _HOUR, chunk=6 * _HOUR)


@register("e5_most_affected", f"""
    SELECT event_code, unit, indicator, delta FROM ({_STUDY})
    ORDER BY abs(delta) DESC, event_code, unit, indicator LIMIT 20""", floats="delta")
def _(spark, sf_dir):
    return ev.most_affected(_study(spark, sf_dir), 20).select("event_code", "unit", "indicator", "delta")


@register("e6_markers", """
    WITH spans AS (SELECT unit, indicator, min(year) AS y0, max(year) AS y1 FROM srs GROUP BY ALL),
    shown AS (SELECT y0, y1, code, CAST(year(start_date) AS INTEGER) AS year,
                     CAST(row_number() OVER (PARTITION BY y0, y1 ORDER BY start_date, code) AS INTEGER) AS position
              FROM (SELECT DISTINCT y0, y1 FROM spans) JOIN event ON year(start_date) BETWEEN y0 AND y1)
    SELECT unit, indicator, code, year, position FROM spans JOIN shown USING (y0, y1) WHERE position <= 6""")
def _(spark, sf_dir):
    p = tables.panel(spark, sf_dir)
    return ev.markers(p.event, ser.series(p)).select("unit", "indicator", "code", "year", "position")


@register("a9_event_types", "SELECT event_type, count(*) AS events FROM event GROUP BY event_type")
def _(spark, sf_dir):
    return ev.event_types(tables.events(spark, sf_dir))
