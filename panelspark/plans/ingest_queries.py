"""Normalizers, ingest, contracts and sinks, on rows derived from the test tables."""
from __future__ import annotations

import dataclasses
import json
import uuid

from pyspark.sql import DataFrame, functions as F

from panelspark.operators import ingest as ing, quality as dq, series as ser, aggregates as agg
from panelspark.plans import tables
from panelspark.plans.registry import register
from panelspark.plans.sql_tables import CTES
from panelspark.session import checkpoint_dir
from panelspark.sources import normalize as nz, release as rel, tables as st
from panelspark.streaming import landing

CTES.update({
    "raw_sdmx": """
        SELECT o_orderkey, CASE WHEN o_custkey % 50 = 0 THEN 'ZZ' ELSE lpad(CAST(c_nationkey AS VARCHAR), 2, '0') END
                 AS REF_AREA,
               list_extract(['GBP', 'SEK', 'USD', 'PLN', 'EUR'], CAST(o_orderkey % 5 + 1 AS INTEGER)) AS CURRENCY,
               list_extract([strftime(o_orderdate, '%Y'), strftime(o_orderdate, '%Y') || '-Q' || quarter(o_orderdate),
                             strftime(o_orderdate, '%Y-%m'), ' ' || strftime(o_orderdate, '%Y-%m') || ' ',
                             strftime(o_orderdate, '%Y') || '-W07', strftime(o_orderdate, '%Y-%m-%d'), 'n/a',
                             strftime(o_orderdate, '%Y') || '-13'], CAST(o_orderkey % 8 + 1 AS INTEGER)) AS TIME_PERIOD,
               CASE WHEN o_orderkey % 9 = 0 THEN ':' ELSE CAST(o_totalprice AS VARCHAR) END AS OBS_VALUE
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "sdmx_ok": r"""
        SELECT *, CAST(regexp_extract(trim(TIME_PERIOD), '^(\d{4})', 1) AS INTEGER) AS year,
               coalesce(TRY_CAST(regexp_extract(trim(TIME_PERIOD), '^\d{4}-Q([1-4])$', 1) AS INTEGER), 0) AS quarter,
               coalesce(TRY_CAST(regexp_extract(trim(TIME_PERIOD), '^\d{4}-(\d\d)$', 1) AS INTEGER), 0) AS month,
               TRY_CAST(OBS_VALUE AS DOUBLE) AS value
        FROM raw_sdmx WHERE regexp_matches(trim(TIME_PERIOD), '^\d{4}(-(Q[1-4]|0[1-9]|1[0-2]))?$')
         AND TRY_CAST(OBS_VALUE AS DOUBLE) IS NOT NULL""",
    "batch": """
        SELECT o_orderkey AS ordinal,
               CASE WHEN o_custkey % 50 = 0 THEN 'XX' ELSE lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || 'C'
                 || CAST(c_custkey AS VARCHAR) END AS iso3,
               list_extract(['type_economy', 'type_large', 'type_medium', 'type_missing'],
                            CAST(o_orderkey % 4 + 1 AS INTEGER)) AS indicator_code,
               CASE WHEN o_orderkey % 97 = 0 THEN 1700 ELSE CAST(year(o_orderdate) AS INTEGER) END AS year,
               CAST(NULL AS INTEGER) AS quarter, CAST(NULL AS INTEGER) AS month,
               CASE WHEN o_orderkey % 89 = 0 THEN 'nan'::DOUBLE WHEN o_orderkey % 83 = 0 THEN NULL
                    ELSE o_totalprice END AS value
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "classified": """
        SELECT *, CASE WHEN base IS NOT NULL THEN base
                       WHEN row_number() OVER (PARTITION BY base, iso3, indicator_code, year ORDER BY ordinal) > 1
                       THEN 'duplicate' END AS reason
        FROM (SELECT *, CASE WHEN iso3 NOT IN (SELECT code FROM geography) THEN 'unknown_iso3'
                             WHEN value IS NULL OR isnan(value) OR isinf(value) THEN 'non_finite_value'
                             WHEN year NOT BETWEEN 1900 AND 2035 THEN 'year_out_of_range' END AS base FROM batch)""",
    "runs": """
        SELECT 'priority ' || CAST(user_id % 5 + 1 AS VARCHAR) AS source, ts AS started_at,
               ts + to_microseconds(CAST(round(value * 100) AS BIGINT) * 36000000) AS ended_at,
               list_extract(['failed', 'skipped', 'completed_with_errors', 'completed', 'completed', 'completed',
                             'completed'], CAST(event_id % 7 + 1 AS INTEGER)) AS status,
               CAST(user_id AS INTEGER) AS records_processed,
               CASE WHEN event_id % 7 = 0 THEN 'fetch failed' END AS error FROM events WHERE event_type = 'signup'""",
    "errs": """
        SELECT 'priority ' || CAST(user_id % 5 + 1 AS VARCHAR) AS source, props AS series, ts AS occurred_at
        FROM events WHERE event_type = 'error'""",
    "damaged": """
        SELECT CASE WHEN geography_id % 500 = 0 THEN geography_id + 1000000 ELSE geography_id END AS geography_id,
               CASE WHEN year = 1996 AND indicator_id = 2 THEN 99 ELSE indicator_id END AS indicator_id, source_id,
               year, CASE WHEN geography_id % 97 = 3 THEN 'nan'::DOUBLE WHEN geography_id % 97 = 4 THEN 'inf'::DOUBLE
                          ELSE value END AS value FROM records""",
})


# --- raw rows ----------------------------------------------------------------
def _orders(spark, sf_dir) -> DataFrame:
    return tables.table(spark, sf_dir, "orders").join(
        tables.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"),
        F.col("o_custkey") == F.col("c_custkey"))


def _pick(values, index) -> F.Column:
    return F.element_at(F.array(*values), (index + 1).cast("int"))


def raw_sdmx(spark, sf_dir) -> DataFrame:
    """Order totals as an SDMX extract with unknown areas, odd periods and missing values."""
    d, key = F.col("o_orderdate"), F.col("o_orderkey")
    year, month = F.date_format(d, "yyyy"), F.date_format(d, "yyyy-MM")
    periods = [year, F.concat(year, F.lit("-Q"), F.quarter(d)), month, F.concat(F.lit(" "), month, F.lit(" ")),
               F.concat(year, F.lit("-W07")), F.date_format(d, "yyyy-MM-dd"), F.lit("n/a"),
               F.concat(year, F.lit("-13"))]
    return _orders(spark, sf_dir).select(
        "o_orderkey",
        F.when(F.col("o_custkey") % 50 == 0, "ZZ").otherwise(F.lpad(F.col("c_nationkey").cast("string"), 2, "0"))
        .alias("REF_AREA"),
        _pick([F.lit(c) for c in ("GBP", "SEK", "USD", "PLN", "EUR")], key % 5).alias("CURRENCY"),
        _pick(periods, key % 8).alias("TIME_PERIOD"),
        F.when(key % 9 == 0, ":").otherwise(F.col("o_totalprice").cast("string")).alias("OBS_VALUE"))


def raw_batch(spark, sf_dir) -> DataFrame:
    """Order totals per customer as an ingest batch with every kind of bad row."""
    key, null = F.col("o_orderkey"), F.lit(None)
    return _orders(spark, sf_dir).select(
        key.alias("ordinal"),
        F.when(F.col("o_custkey") % 50 == 0, "XX").otherwise(
            F.concat(F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.lit("C"), F.col("c_custkey"))).alias("iso3"),
        _pick([F.lit(c) for c in ("type_economy", "type_large", "type_medium", "type_missing")], key % 4)
        .alias("indicator_code"),
        F.when(key % 97 == 0, 1700).otherwise(F.year("o_orderdate")).alias("year"),
        null.cast("int").alias("quarter"), null.cast("int").alias("month"),
        F.when(key % 89 == 0, F.lit(float("nan"))).when(key % 83 == 0, null.cast("double"))
        .otherwise(F.col("o_totalprice")).alias("value"))


def runs(spark, sf_dir) -> DataFrame:
    e = tables.table(spark, sf_dir, "events").where("event_type = 'signup'")
    statuses = ["failed", "skipped", "completed_with_errors"] + ["completed"] * 4
    micros = F.unix_micros(F.col("ts").cast("timestamp")) + F.round(F.col("value") * 100).cast("long") * 36_000_000
    return e.select(
        F.concat(F.lit("priority "), F.col("user_id") % 5 + 1).alias("source"), F.col("ts").alias("started_at"),
        F.timestamp_micros(micros).cast("timestamp_ntz").alias("ended_at"),
        _pick([F.lit(s) for s in statuses], F.col("event_id") % 7).alias("status"),
        F.col("user_id").cast("int").alias("records_processed"),
        F.when(F.col("event_id") % 7 == 0, "fetch failed").alias("error"))


def errors(spark, sf_dir) -> DataFrame:
    e = tables.table(spark, sf_dir, "events").where("event_type = 'error'")
    return e.select(F.concat(F.lit("priority "), F.col("user_id") % 5 + 1).alias("source"),
                    F.col("props").alias("series"), F.col("ts").alias("occurred_at"))


def damaged(spark, sf_dir) -> DataFrame:
    """The facts with planted orphans and non-finite values."""
    geo = F.col("geography_id")
    return tables.records(spark, sf_dir).select(
        F.when(geo % 500 == 0, geo + 1000000).otherwise(geo).alias("geography_id"),
        F.when((F.col("year") == 1996) & (F.col("indicator_id") == 2), 99).otherwise(F.col("indicator_id"))
        .alias("indicator_id"), "source_id", "year",
        F.when(geo % 97 == 3, F.lit(float("nan"))).when(geo % 97 == 4, F.lit(float("inf")))
        .otherwise(F.col("value")).alias("value"))


_ROW = "iso3, indicator_code, year, quarter, month, value, unit, currency"
_ROW_COLS = _ROW.split(", ")


# --- normalizers -------------------------------------------------------------
@register("s2_normalize_sdmx", """
    SELECT g.iso3, 'IRS' AS indicator_code, year, quarter, month, value, CAST(NULL AS VARCHAR) AS unit,
           CURRENCY AS currency FROM sdmx_ok JOIN geography g ON g.iso2 = REF_AREA""")
def _(spark, sf_dir):
    areas = tables.geography(spark, sf_dir).where("iso2 is not null").select(F.col("iso2").alias("area"), "iso3")
    return nz.normalize_sdmx(raw_sdmx(spark, sf_dir), areas, "IRS").select(_ROW_COLS)


@register("s3_normalize_exchange_rates", """
    SELECT CASE CURRENCY WHEN 'GBP' THEN 'GBR' WHEN 'SEK' THEN 'SWE' ELSE 'POL' END AS iso3,
           'EXR' AS indicator_code, year, quarter, month, value, CURRENCY || ' per EUR' AS unit, CURRENCY AS currency
    FROM sdmx_ok WHERE CURRENCY IN ('GBP', 'SEK', 'PLN')""")
def _(spark, sf_dir):
    issuers = nz.lookup(spark, nz.CURRENCY_ISSUERS)
    return nz.normalize_exchange_rates(raw_sdmx(spark, sf_dir), issuers, "EXR").select(_ROW_COLS)


@register("s4_normalize_iso3", """
    SELECT 'N' || REF_AREA AS iso3, 'UNE' AS indicator_code, year, quarter, month, value, '%' AS unit,
           CAST(NULL AS VARCHAR) AS currency FROM sdmx_ok WHERE 'N' || REF_AREA IN (SELECT iso3 FROM geography)""")
def _(spark, sf_dir):
    rows = raw_sdmx(spark, sf_dir).withColumn("REF_AREA", F.concat(F.lit("N"), "REF_AREA"))
    known = tables.geography(spark, sf_dir).where("iso3 is not null").select("iso3")
    return nz.normalize_iso3(rows, known, "UNE", "%").select(_ROW_COLS)


def _cubes(spark, sf_dir) -> DataFrame:
    """One sparse JSON-stat cube per brand; the geo index is an object or a list by turns."""
    geos = [f"N{i:02d}" for i in range(25)]
    times = [f"{y}-Q{q}" for y in range(1995, 2002) for q in range(1, 5)]

    def dims(index) -> str:
        return json.dumps({"unit": {"category": {"index": ["X"]}}, "geo": {"category": {"index": index}},
                           "time": {"category": {"index": {t: i for i, t in enumerate(times)}}}})

    flat = F.substring("unit", 2, 2).cast("int") * len(times) + F.col("year") - 1995 * 4
    as_list = F.length("indicator") % 2 == 0
    return (tables.brand_frame(spark, sf_dir).groupBy("indicator")
            .agg(F.map_from_entries(F.collect_list(F.struct(flat.cast("string"), "value"))).alias("cells"))
            .select("indicator", F.concat(
                F.lit(f'{{"id":["unit","geo","time"],"size":[1,{len(geos)},{len(times)}],"dimension":'),
                F.when(as_list, dims(geos)).otherwise(dims({g: i for i, g in enumerate(geos)})),
                F.lit(',"value":'), F.to_json("cells"), F.lit("}")).alias("payload")))


_QUARTER = "CAST(year // 4 AS VARCHAR) || '-Q' || CAST(year % 4 + 1 AS VARCHAR)"


@register("s5_flatten_jsonstat", f"SELECT indicator, unit AS geo, {_QUARTER} AS TIME_PERIOD, value FROM brand")
def _(spark, sf_dir):
    return nz.flatten_jsonstat(_cubes(spark, sf_dir))


@register("s6_normalize_cube", """
    SELECT unit AS iso3, replace(indicator, '#', '') || '#S' AS indicator_code, CAST(b.year // 4 AS INTEGER) AS year,
           CAST(b.year % 4 + 1 AS INTEGER) AS quarter, 0 AS month, value
    FROM brand b JOIN nation ON CAST(substr(unit, 2) AS INTEGER) = n_nationkey WHERE n_regionkey <> 4
    UNION ALL
    SELECT unit, replace(indicator, '#', ''), CAST(b.year // 4 AS INTEGER), CAST(b.year % 4 + 1 AS INTEGER), 0, value
    FROM brand b JOIN nation ON CAST(substr(unit, 2) AS INTEGER) = n_nationkey WHERE n_regionkey = 4""")
def _(spark, sf_dir):
    """Country mode for four regions of the world, region-code mode for the fifth."""
    cells = nz.flatten_jsonstat(_cubes(spark, sf_dir))
    geo = tables.geography(spark, sf_dir).where("level = 'country'")
    mapped = geo.where("not is_disputed").select(F.col("code").alias("area"), "iso3")
    coded = F.concat(F.replace("indicator", F.lit("#"), F.lit("")), F.lit("#S"))
    out = nz.normalize_cube(cells, mapped, coded).unionByName(nz.normalize_cube(
        cells, mapped, nz.dataset_id(coded), known_regions=geo.where("is_disputed").select("code")))
    return out.select("iso3", "indicator_code", "year", "quarter", "month", "value")


_YEARS = range(1995, 2002)


def _wide(spark, sf_dir) -> DataFrame:
    code = F.concat(F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.lit("C"), F.col("c_custkey"))
    year = F.year("o_orderdate")
    return (tables.sales(spark, sf_dir).groupBy(code.alias("economy"), "p_type")
            .agg(*[F.sum(F.when(year == y, F.col("amount"))).alias(f"YR{y}") for y in _YEARS]))


def _long(spark, sf_dir) -> DataFrame:
    geo = tables.geography(spark, sf_dir)
    nations = geo.where("level = 'country' and not is_transcontinental").select(F.col("id").alias("parent_id"))
    known = geo.join(nations, "parent_id", "left_semi").select(F.col("code").alias("iso3"))
    return nz.normalize_wide(_wide(spark, sf_dir), known, F.col("p_type"), [f"YR{y}" for y in _YEARS])


_LONG = """
    SELECT lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || 'C' || CAST(c_custkey AS VARCHAR) AS iso3,
           p_type AS indicator_code, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(sum(amount) AS DOUBLE) AS value
    FROM sales JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 0 GROUP BY ALL"""


@register("s7_normalize_wide", _LONG)
def _(spark, sf_dir):
    return _long(spark, sf_dir).select("iso3", "indicator_code", "year", "value")


@register("s8_map_codes", f"""
    SELECT iso3, CASE indicator_code WHEN 'SMALL' THEN 'type_large' ELSE 'type_' || lower(indicator_code) END
      AS indicator_code, year, value FROM ({_LONG}) WHERE indicator_code <> 'STANDARD'""")
def _(spark, sf_dir):
    codes = tables.indicator(spark).where("id between 1 and 5").select(
        F.col("name").alias("external"),
        F.when(F.col("name") == "SMALL", "type_large").otherwise(F.col("api_code")).alias("catalog"))
    return nz.map_codes(_long(spark, sf_dir), codes).select("iso3", "indicator_code", "year", "value")


# --- sinks and source metadata -----------------------------------------------
_RELEASE = """
    SELECT g.u AS iso3, g.name AS country, d.name AS domain, i.name AS indicator, s.name AS source_name,
           c.year, c.quarter, c.month, c.value, c.vintage_date
    FROM cur_v c JOIN geo g ON g.id = c.geography_id JOIN indicator i ON i.id = c.indicator_id
    JOIN domain d ON d.id = i.domain_id JOIN source s ON s.id = c.source_id WHERE s.redistributable"""
_RELEASE_COLS = ["iso3", "country", "domain", "indicator", "source_name", "year", "quarter", "month", "value",
                 "vintage_date"]


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@register("s9_release_facts", _RELEASE)
def _(spark, sf_dir):
    return rel.release_facts(tables.panel(spark, sf_dir)).select(_RELEASE_COLS)


@register("s10_export_view", """
    SELECT 'csv' AS fmt, unit, indicator, period, value FROM latest
    UNION ALL SELECT 'parquet', unit, indicator, period, value FROM latest""")
def _(spark, sf_dir):
    """The latest view written in both formats and read back."""
    view = ser.latest_series(tables.panel(spark, sf_dir)).select("unit", "indicator", "period", "value")
    csv, parquet = _folder(spark, "latest-csv"), _folder(spark, "latest-parquet")
    rel.export_view(view, csv, "csv")
    rel.export_view(view, parquet, "parquet")
    back = spark.read.option("header", True).schema(view.schema).csv(csv)
    return (back.select(F.lit("csv").alias("fmt"), "*")
            .unionByName(spark.read.parquet(parquet).select(F.lit("parquet").alias("fmt"), "*")))


@register("s11_full_extract", """
    SELECT unit AS iso3, country, domain, indicator, year, value, value_unit AS unit, source, is_proxy FROM srs""")
def _(spark, sf_dir):
    return rel.full_extract(ser.series(tables.panel(spark, sf_dir)))


@register("s12_snapshot_manifest", """
    SELECT 'pages' AS source, regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS endpoint,
           '{"page_id": ' || page_id || '}' AS params, sha256(html) AS sha256,
           replace(regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1), '/', '_') || '_' || substr(sha256(html), 1, 12)
             || '.raw' AS file_name FROM pages""")
def _(spark, sf_dir):
    pages = tables.table(spark, sf_dir, "pages").select(
        F.lit("pages").alias("source"), F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1).alias("endpoint"),
        F.concat(F.lit('{"page_id": '), F.col("page_id"), F.lit("}")).alias("params"), F.col("html").alias("payload"))
    return st.snapshot_manifest(pages)


@register("s13_upsert_dim", """
    SELECT coalesce(c_custkey, s_suppkey) AS id, coalesce(s_name, c_name) AS name,
           CASE WHEN c_custkey IS NOT NULL THEN c_mktsegment ELSE 'NEW' END AS segment,
           coalesce(s_acctbal, c_acctbal) AS balance
    FROM customer FULL JOIN (SELECT s_suppkey * 20 AS s_suppkey, s_name,
                                    CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_acctbal END AS s_acctbal FROM supplier)
      ON c_custkey = s_suppkey""")
def _(spark, sf_dir):
    """Suppliers upserted into customers by id."""
    old = tables.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").alias("balance"))
    new = tables.table(spark, sf_dir, "supplier").select(
        (F.col("s_suppkey") * 20).alias("id"), F.col("s_name").alias("name"), F.lit("NEW").alias("segment"),
        F.when(F.col("s_suppkey") % 3 != 0, F.col("s_acctbal")).alias("balance"))
    return st.upsert_dim(old, new, ["id"], ["name", "balance"])


@register("s14_source_health", """
    SELECT source, coalesce(records, 0) AS records, coalesce(indicators, 0) AS indicators,
           coalesce(series_errors, 0) AS series_errors,
           CASE WHEN last = 'skipped' THEN 'skipped' WHEN last = 'failed' THEN 'FAILED'
                WHEN coalesce(records, 0) = 0 THEN 'EMPTY' WHEN coalesce(series_errors, 0) > 0 THEN 'degraded'
                ELSE 'ok' END AS status
    FROM (SELECT s.name AS source, count(*) AS records, count(DISTINCT indicator_id) AS indicators
          FROM records r JOIN source s ON s.id = r.source_id WHERE s.id <> 2 GROUP BY s.name)
    FULL JOIN (SELECT source, count(*) AS series_errors FROM errs WHERE source <> 'priority 1' GROUP BY source)
      USING (source)
    FULL JOIN (SELECT source, arg_max(status, (started_at, status)) AS last FROM runs GROUP BY source) USING (source)""")
def _(spark, sf_dir):
    src = tables.source(spark).select(F.col("id").alias("source_id"), F.col("name").alias("source"))
    rows = tables.records(spark, sf_dir).where("source_id <> 2").join(src, "source_id").select(
        "source", F.col("indicator_id").alias("indicator_code"))
    return st.source_health(rows, errors(spark, sf_dir).where("source <> 'priority 1'"), runs(spark, sf_dir))


# --- ingest ------------------------------------------------------------------
@register("i1_validate", """
    SELECT ordinal, iso3, indicator_code, year, reason FROM classified""")
def _(spark, sf_dir):
    return ing.classify(raw_batch(spark, sf_dir), tables.geography(spark, sf_dir)).select(
        "ordinal", "iso3", "indicator_code", "year", "reason")


@register("i2_resolve_keys", """
    SELECT c.ordinal, g.id AS geography_id, i.id AS indicator_id, g.id IS NOT NULL AND i.id IS NOT NULL AS matched
    FROM classified c LEFT JOIN geography g ON g.code = c.iso3 LEFT JOIN indicator i ON i.api_code = c.indicator_code
    WHERE c.reason IS NULL""")
def _(spark, sf_dir):
    geo = tables.geography(spark, sf_dir)
    valid, _rejected = ing.validate(raw_batch(spark, sf_dir), geo)
    matched, unmatched = ing.resolve_keys(valid, geo, tables.indicator(spark))
    cols = ["ordinal", "geography_id", "indicator_id"]
    return matched.select(*cols, F.lit(True).alias("matched")).unionByName(
        unmatched.select(*cols, F.lit(False).alias("matched")))


_FACT = ["geography_id", "indicator_id", "source_id", "year", "quarter", "month", "vintage_date", "value"]


@register("i3_append_new", f"""
    WITH facts AS MATERIALIZED (SELECT *, coalesce(vintage_date, DATE '0001-01-01') AS v FROM records),
    stored AS MATERIALIZED (SELECT * FROM facts WHERE v < DATE '1998-01-01'),
    twofold AS (SELECT {', '.join('f.' + c for c in _FACT if c != 'value')}, v, value + twice AS value
              FROM facts f, (VALUES (0), (1)) t(twice)),
    one AS (SELECT * EXCLUDE value, min(value) AS value FROM twofold GROUP BY ALL)
    SELECT {', '.join('b.' + c for c in _FACT)} FROM one b ANTI JOIN stored s
    USING (geography_id, indicator_id, source_id, year, quarter, month, v)""")
def _(spark, sf_dir):
    """Every key comes twice in the batch, with another value."""
    facts = tables.records(spark, sf_dir)
    stored = facts.where("vintage_date is null or vintage_date < '1998-01-01'")
    batch = facts.withColumn("value", F.explode(F.array(F.col("value"), F.col("value") + 1)))
    return ing.append_new(stored, batch).select(_FACT)


@register("i3_load_accounting", """
    WITH landed AS (SELECT c.*, 'priority ' || (c.ordinal % 6 + 1) AS source FROM batch c),
    base AS (SELECT *, CASE WHEN source = 'priority 6' THEN 'unknown_source'
                    WHEN iso3 NOT IN (SELECT code FROM geography) THEN 'rule'
                    WHEN value IS NULL OR isnan(value) OR isinf(value) THEN 'rule'
                    WHEN year NOT BETWEEN 1900 AND 2035 THEN 'rule' END AS why FROM landed),
    once AS (SELECT *, coalesce(why, CASE WHEN row_number() OVER (PARTITION BY source, why, iso3, indicator_code, year
                                          ORDER BY ordinal) > 1 THEN 'rule' END) AS reason FROM base),
    ids AS (SELECT o.*, g.id AS gid, i.id AS iid FROM once o LEFT JOIN geography g ON g.code = o.iso3
            LEFT JOIN indicator i ON i.api_code = o.indicator_code),
    held AS (SELECT DISTINCT geography_id, indicator_id, source_id, year FROM records
             WHERE quarter = 0 AND month = 0 AND vintage_date IS NULL),
    marked AS (SELECT ids.source, CASE WHEN reason IS NOT NULL THEN 'rejected'
                      WHEN gid IS NULL OR iid IS NULL THEN 'unmatched'
                      WHEN EXISTS (SELECT 1 FROM held h WHERE h.geography_id = gid AND h.indicator_id = iid
                        AND 'priority ' || h.source_id = ids.source AND h.year = ids.year) THEN 'known'
                      ELSE 'inserted' END AS fate FROM ids)
    SELECT source, count(*) AS received, count(*) FILTER (fate = 'inserted') AS inserted,
           count(*) FILTER (fate = 'known') AS known, count(*) FILTER (fate = 'unmatched') AS unmatched,
           count(*) FILTER (fate = 'rejected') AS rejected FROM marked GROUP BY source""")
def _(spark, sf_dir):
    """A batch of six sources, one of them unknown, against the stored facts."""
    null = F.lit(None)
    batch = raw_batch(spark, sf_dir).select(
        "*", F.concat(F.lit("priority "), F.col("ordinal") % 6 + 1).alias("source"), null.cast("date").alias("vintage_date"),
        *[null.cast("string").alias(c) for c in ("unit", "currency", "price_basis")])
    return landing.accounting(landing.judge_batch(
        batch, tables.records(spark, sf_dir), tables.geography(spark, sf_dir), tables.indicator(spark), tables.source(spark)))


@register("i4_sentinels", """
    SELECT iso3, indicator_code, year, 0 AS quarter, 0 AS month, count(*) AS n FROM batch GROUP BY ALL""")
def _(spark, sf_dir):
    return (ing.with_sentinels(raw_batch(spark, sf_dir))
            .groupBy("iso3", "indicator_code", "year", "quarter", "month").agg(F.count(F.lit(1)).alias("n")))


def _line_records(spark, sf_dir) -> DataFrame:
    null = F.lit(None)
    return tables.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("geography_id"), F.col("l_linenumber").alias("indicator_id"),
        F.lit(1).alias("source_id"), F.lit(2000).alias("year"), null.cast("int").alias("quarter"),
        null.cast("int").alias("month"), null.cast("date").alias("vintage_date"), F.col("l_quantity").alias("value"),
        (F.col("l_partkey") * 1000000 + F.col("l_suppkey")).alias("id"), F.col("l_shipdate").alias("retrieved_at"))


@register("i5_dedup_records", """
    SELECT l_orderkey AS geography_id, l_linenumber AS indicator_id, l_quantity AS value,
           l_partkey * 1000000 + l_suppkey AS id, l_shipdate AS retrieved_at FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC NULLS LAST,
      l_partkey * 1000000 + l_suppkey DESC, l_quantity DESC) = 1""")
def _(spark, sf_dir):
    """Line items hold repeated (order, line) keys."""
    return ing.dedup_records(_line_records(spark, sf_dir)).select(
        "geography_id", "indicator_id", "value", "id", "retrieved_at")


@register("i6_same_view", """
    SELECT count(*) AS rows_before, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS extra FROM best""")
def _(spark, sf_dir):
    """The best view must not change when every fact is stored twice and de-duplicated."""
    p = tables.panel(spark, sf_dir, stored_best=False)
    stamped = p.records.withColumn("id", F.xxhash64(*_FACT)).withColumn(
        "retrieved_at", F.lit(None).cast("timestamp"))
    clean = dataclasses.replace(p, records=ing.dedup_records(stamped.unionByName(stamped)), _views={})
    return ing.view_difference(p.best, clean.best, [c for c in _FACT if c != "vintage_date"])


@register("i7_run_log", """
    SELECT s.source, started_at, ended_at,
           CASE WHEN s.source = 'priority 3' THEN 'skipped' WHEN s.source = 'priority 4' THEN 'failed'
                WHEN e.n > 0 THEN 'completed_with_errors' ELSE 'completed' END AS status,
           CAST(CASE WHEN s.source IN ('priority 3', 'priority 4') THEN 0 ELSE coalesce(r.n, 0) END AS INTEGER)
             AS records_processed,
           CASE WHEN s.source = 'priority 3' THEN 'disabled' WHEN s.source = 'priority 4' THEN 'timeout' END AS error
    FROM (SELECT 'priority ' || CAST(user_id % 5 + 1 AS VARCHAR) AS source, min(ts) AS started_at,
                 max(ts) AS ended_at FROM events GROUP BY ALL) s
    LEFT JOIN (SELECT source.name AS source, count(*) AS n FROM records
               JOIN source ON source.id = records.source_id GROUP BY ALL) r ON r.source = s.source
    LEFT JOIN (SELECT source, count(*) AS n FROM errs WHERE source <> 'priority 1' GROUP BY source) e
      ON e.source = s.source""")
def _(spark, sf_dir):
    name = F.concat(F.lit("priority "), F.col("user_id") % 5 + 1)
    ran = (tables.table(spark, sf_dir, "events").groupBy(name.alias("source"))
           .agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"))
           .withColumn("disabled_reason", F.when(F.col("source") == "priority 3", "disabled"))
           .withColumn("fatal", F.when(F.col("source") == "priority 4", "timeout")))
    src = tables.source(spark).select(F.col("id").alias("source_id"), F.col("name").alias("source"))
    loaded = tables.records(spark, sf_dir).join(src, "source_id")
    return ing.run_log(ran, loaded, errors(spark, sf_dir).where("source <> 'priority 1'"))


@register("i8_ingestion_summary", """
    WITH numbered AS (SELECT *, row_number() OVER () AS run FROM runs)
    SELECT n.source, n.started_at, n.status, n.records_processed, n.error,
           count(e.occurred_at) FILTER (e.occurred_at >= n.started_at AND e.occurred_at <= n.ended_at) AS series_errors
    FROM numbered n LEFT JOIN errs e ON e.source = n.source 
    GROUP BY n.run, n.source, n.started_at, n.status, n.records_processed, n.error""")
def _(spark, sf_dir):
    return ing.ingestion_summary(runs(spark, sf_dir), errors(spark, sf_dir))


# --- contracts ---------------------------------------------------------------
def _flat(report: DataFrame, *metrics: str, also: list[str] | None = None) -> DataFrame:
    return report.select("name", "passed", "severity", "blocking", *(also or []),
                         *[F.col("metrics")[m].cast("long").alias(m) for m in metrics])


@register("d1_row_count", """
    SELECT 'row_count' AS name, count(*) >= 1000 AS passed, 'error' AS severity, count(*) < 1000 AS blocking,
           count(*) AS rows FROM records""")
def _(spark, sf_dir):
    return _flat(dq.check_row_count(tables.records(spark, sf_dir)), "rows")


@register("d2_referential_integrity", """
    SELECT 'referential_integrity' AS name, a + b + c = 0 AS passed, 'error' AS severity, a + b + c > 0 AS blocking,
           a AS orphan_geography, b AS orphan_indicator, c AS orphan_source
    FROM (SELECT count(*) FILTER (geography_id NOT IN (SELECT id FROM geography)) AS a,
                 count(*) FILTER (indicator_id NOT IN (SELECT id FROM indicator)) AS b,
                 count(*) FILTER (source_id NOT IN (SELECT id FROM source WHERE id < 5)) AS c FROM damaged)""")
def _(spark, sf_dir):
    p = tables.panel(spark, sf_dir)
    return _flat(dq.check_fk(damaged(spark, sf_dir), p.geography, p.indicator, p.source.where("id < 5")),
                 "orphan_geography", "orphan_indicator", "orphan_source")


@register("d3_finiteness", """
    SELECT 'value_finiteness' AS name, bad = 0 AS passed, 'error' AS severity, bad > 0 AS blocking, bad AS non_finite
    FROM (SELECT count(*) FILTER (value IS NOT NULL AND NOT isfinite(value)) AS bad FROM damaged)""")
def _(spark, sf_dir):
    return _flat(dq.check_finite(damaged(spark, sf_dir)), "non_finite")


@register("d4_freshness", """
    WITH ages AS (SELECT i.name, 2006 - max(year) AS age FROM records r JOIN indicator i ON i.id = r.indicator_id
                  WHERE NOT (i.id = 2 AND year > 1997) GROUP BY i.name),
    placed AS (SELECT name, age, CASE WHEN age >= 8 THEN 'error' WHEN age >= 3 THEN 'warn' END AS grade FROM ages),
    worst AS (SELECT grade, string_agg(name || ' (' || age || 'y)', ', ' ORDER BY age DESC, name) AS who FROM (
              SELECT * FROM placed QUALIFY row_number() OVER (PARTITION BY grade ORDER BY age DESC, name) <= 5)
              GROUP BY grade),
    total AS (SELECT count(*) AS n_indicators, count(*) FILTER (grade = 'warn') AS n_warn,
                     count(*) FILTER (grade = 'error') AS n_error FROM placed)
    SELECT 'freshness' AS name, n_error + n_warn = 0 AS passed,
           CASE WHEN n_error > 0 THEN 'error' ELSE 'warn' END AS severity, n_error > 0 AS blocking,
           n_indicators, n_warn, n_error,
           CASE WHEN n_error > 0 THEN 'too old: ' || (SELECT who FROM worst WHERE grade = 'error')
                WHEN n_warn > 0 THEN 'getting old: ' || (SELECT who FROM worst WHERE grade = 'warn')
                ELSE 'all fresh' END AS detail FROM total""")
def _(spark, sf_dir):
    p = tables.panel(spark, sf_dir)
    old = p.records.where("not (indicator_id = 2 and year > 1997)")
    report = dq.check_freshness(old, p.indicator, "2006-05-01")
    return _flat(report, "n_indicators", "n_warn", "n_error", also=["detail"])


@register("d5_runs", """
    SELECT 'ingestion_runs' AS name, bad = 0 AS passed, 'error' AS severity, bad > 0 AS blocking,
           n AS n_sources, bad AS n_failed
    FROM (SELECT count(*) AS n, count(*) FILTER (last = 'failed') AS bad FROM (
            SELECT source, arg_max(status, (started_at, status)) AS last FROM runs GROUP BY source))""")
def _(spark, sf_dir):
    return _flat(dq.check_runs(runs(spark, sf_dir)), "n_sources", "n_failed")


_ADDITIVE = ["type_economy", "type_large"]


@register("d6_rollup_pairs", """
    WITH b AS (SELECT best.*, g.level, g.parent_id FROM best JOIN geography g ON g.id = best.geography_id
               WHERE indicator_id IN (1, 2))
    SELECT c.indicator_id, c.geography_id AS country_id, c.year, c.value AS country_value, r.region_sum, r.n_regions,
           abs(r.region_sum - c.value) / nullif(abs(c.value), 0) AS rel_diff
    FROM b c JOIN (SELECT indicator_id, parent_id, year, sum(value) AS region_sum, count(*) AS n_regions FROM b
                   WHERE level = 'NUTS2' GROUP BY ALL) r
      ON r.indicator_id = c.indicator_id AND r.parent_id = c.geography_id AND r.year = c.year
    WHERE c.level = 'country'""", floats="rel_diff")
def _(spark, sf_dir):
    return dq.rollup_pairs(tables.panel(spark, sf_dir), _ADDITIVE)


@register("d6_rollup", """
    WITH b AS (SELECT best.*, g.level, g.parent_id FROM best JOIN geography g ON g.id = best.geography_id
               WHERE indicator_id IN (1, 2)),
    pairs AS (SELECT abs(r.s - c.value) / nullif(abs(c.value), 0) AS rel
              FROM b c JOIN (SELECT indicator_id, parent_id, year, sum(value) AS s FROM b
                             WHERE level = 'NUTS2' GROUP BY ALL) r
                ON r.indicator_id = c.indicator_id AND r.parent_id = c.geography_id AND r.year = c.year
              WHERE c.level = 'country')
    SELECT 'rollup' AS name, bad = 0 AS passed, 'error' AS severity, bad > 0 AS blocking, n AS n_comparisons,
           bad AS n_mismatched
    FROM (SELECT count(*) AS n, count(*) FILTER (rel IS NULL OR rel > 0.02) AS bad FROM pairs)""")
def _(spark, sf_dir):
    return _flat(dq.check_rollup(tables.panel(spark, sf_dir), additive=_ADDITIVE), "n_comparisons", "n_mismatched")


@register("d7_report", """
    WITH facts AS (SELECT count(*) AS n, count(*) FILTER (value IS NOT NULL AND NOT isfinite(value)) AS odd,
                          count(*) FILTER (geography_id NOT IN (SELECT id FROM geography))
                          + count(*) FILTER (indicator_id NOT IN (SELECT id FROM indicator))
                          + count(*) FILTER (source_id NOT IN (SELECT id FROM source)) AS lost FROM records),
    ages AS (SELECT i.name, 2001 - max(r.year) AS age FROM records r JOIN indicator i ON i.id = r.indicator_id
             WHERE r.value IS NOT NULL GROUP BY i.name),
    aged AS (SELECT count(*) FILTER (age >= 3 AND age < 8) AS n_warn, count(*) FILTER (age >= 8) AS n_error FROM ages),
    ran AS (SELECT count(*) FILTER (last = 'failed') AS bad FROM (
            SELECT source, arg_max(status, (started_at, status)) AS last FROM runs GROUP BY source)),
    additive AS (SELECT b.*, g.level, g.parent_id FROM best b JOIN geography g ON g.id = b.geography_id
                 JOIN indicator i ON i.id = b.indicator_id WHERE i.api_code IN ('demo_pjan', 'nama_10_gdp')),
    sums AS (SELECT indicator_id, parent_id, year, sum(value) AS total FROM additive WHERE level = 'NUTS2' GROUP BY ALL),
    rolled AS (SELECT count(*) AS n, count(*) FILTER (c.value = 0 OR abs(s.total - c.value) > 0.02 * abs(c.value)) AS bad
               FROM additive c JOIN sums s ON s.indicator_id = c.indicator_id AND s.parent_id = c.geography_id
               AND s.year = c.year WHERE c.level = 'country')
    SELECT 'row_count' AS name, n >= 1000 AS passed, 'error' AS severity, n < 1000 AS blocking, n AS metric FROM facts
    UNION ALL SELECT 'referential_integrity', lost = 0, 'error', lost > 0, lost FROM facts
    UNION ALL SELECT 'value_finiteness', odd = 0, 'error', odd > 0, odd FROM facts
    UNION ALL SELECT 'freshness', n_warn + n_error = 0, CASE WHEN n_error > 0 THEN 'error' ELSE 'warn' END,
                     n_error > 0, n_warn + n_error FROM aged
    UNION ALL SELECT 'ingestion_runs', bad = 0, 'error', bad > 0, bad FROM ran
    UNION ALL SELECT 'rollup', bad = 0, CASE WHEN n = 0 THEN 'warn' ELSE 'error' END, bad > 0 AND n > 0, n FROM rolled""")
def _(spark, sf_dir):
    """Six contracts with the number each of them turns on."""
    p = dataclasses.replace(tables.panel(spark, sf_dir), runs=runs(spark, sf_dir), _views={})
    numbers = {"row_count": ["rows"], "referential_integrity": ["orphan_geography", "orphan_indicator", "orphan_source"],
               "value_finiteness": ["non_finite"], "freshness": ["n_warn", "n_error"], "ingestion_runs": ["n_failed"],
               "rollup": ["n_comparisons"]}
    metric = F.lit(None).cast("long")
    for name, keys in numbers.items():
        total = sum((F.col("metrics")[k].cast("long") for k in keys[1:]), F.col("metrics")[keys[0]].cast("long"))
        metric = F.when(F.col("name") == name, total).otherwise(metric)
    return dq.run_checks(p, "2001-12-31").select("name", "passed", "severity", "blocking", metric.alias("metric"))


@register("d8_gated_release", _RELEASE)
def _(spark, sf_dir):
    """Contracts, then the release written and read back."""
    path = _folder(spark, "release")
    rel.gated_release(tables.panel(spark, sf_dir), path, "2001-12-31")
    return spark.read.parquet(path).select(_RELEASE_COLS)
