"""The derived panel in SQL, for checking the Spark results against DuckDB."""
from __future__ import annotations

_LABEL = ("CASE WHEN month > 0 THEN CAST(year AS VARCHAR) || '-' || lpad(CAST(month AS VARCHAR), 2, '0') "
          "WHEN quarter > 0 THEN CAST(year AS VARCHAR) || '-Q' || CAST(quarter AS VARCHAR) "
          "ELSE CAST(year AS VARCHAR) END")
_T = ("year + CASE WHEN month > 0 THEN (month - 1) / 12.0::DOUBLE "
      "WHEN quarter > 0 THEN (quarter - 1) / 4.0::DOUBLE ELSE 0.0::DOUBLE END")

CTES: dict[str, str] = {
    "sales": """
        SELECT c_nationkey, CAST(c_custkey AS INTEGER) AS c_custkey, p_type, p_brand, o_orderdate,
               CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS source_id, l_shipdate,
               CAST(round(l_extendedprice * 100) AS BIGINT)
                 * CAST(round((1 - l_discount) * 100) AS BIGINT) AS amount
        FROM lineitem JOIN part ON l_partkey = p_partkey
        JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""",
    "tagged": """
        SELECT *, CAST(list_position(['ECONOMY','LARGE','MEDIUM','PROMO','SMALL','STANDARD'], p_type) AS INTEGER)
                    AS indicator_id,
               CAST(year(o_orderdate) AS INTEGER) AS year, CAST(quarter(o_orderdate) AS INTEGER) AS q,
               CAST(month(o_orderdate) AS INTEGER) AS m,
               CASE WHEN source_id <> 5 THEN CAST(date_trunc('quarter', l_shipdate) AS DATE) END AS vintage_date
        FROM sales""",
    "records": """
        SELECT geography_id, indicator_id, source_id, year, quarter, month, vintage_date,
               CAST((CAST(sum(amount) AS BIGINT) + 5000) // 10000 AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS unit
        FROM (SELECT c_nationkey + 1 AS geography_id, indicator_id, source_id, year,
                     CASE WHEN indicator_id = 6 THEN 0 ELSE q END AS quarter,
                     CASE WHEN indicator_id = 6 THEN m ELSE 0 END AS month, vintage_date, amount FROM tagged
              UNION ALL
              SELECT c_custkey + 1000, indicator_id, source_id, year, 0, 0, vintage_date, amount FROM tagged)
        GROUP BY ALL""",
    "geography": """
        SELECT n_nationkey + 1 AS id, 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS code,
               'country' AS level, CAST(NULL AS INTEGER) AS parent_id, n_name AS name,
               lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS iso2,
               'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS iso3,
               n_regionkey = 0 AS is_transcontinental, n_regionkey = 4 AS is_disputed FROM nation
        UNION ALL
        SELECT CAST(c_custkey AS INTEGER) + 1000,
               lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || 'C' || CAST(c_custkey AS VARCHAR),
               'NUTS2', c_nationkey + 1, c_name, NULL, NULL, false, false FROM customer""",
    "geo": "SELECT *, coalesce(iso3, code) AS u FROM geography",
    "bloc": """SELECT r_regionkey + 1 AS id, 'B' || CAST(r_regionkey AS VARCHAR) AS code, r_name AS name
               FROM region""",
    "nation_bloc": """
        SELECT n_nationkey, n_regionkey + 1 AS bloc_id, CAST(1990 + n_nationkey % 8 AS INTEGER) AS since_year,
               CAST(NULL AS INTEGER) AS until_year FROM nation
        UNION ALL
        SELECT n_nationkey, (n_regionkey + 1) % 5 + 1, 1985, CAST(1995 + n_nationkey % 5 AS INTEGER) FROM nation
        WHERE n_nationkey % 3 <> 0""",
    "geography_bloc": """
        SELECT n_nationkey + 1 AS geography_id, bloc_id, since_year, until_year FROM nation_bloc
        UNION ALL
        SELECT CAST(c_custkey AS INTEGER) + 1000, bloc_id, since_year, until_year
        FROM customer JOIN nation_bloc ON c_nationkey = n_nationkey""",
    "domain": """SELECT * FROM (VALUES (1, 'Trade', 'Trade figures'), (2, 'Industry', 'Industry figures'),
                 (3, 'Retail', 'Retail figures')) d(id, name, description)""",
    "indicator": """
        SELECT * FROM (VALUES
          (1, 1, 'ECONOMY', 'USD', 'type_economy', 'quarterly', 'Sales of economy parts', false, NULL),
          (2, 2, 'LARGE', 'index', 'type_large', 'quarterly', 'Sales of large parts', false, NULL),
          (3, 3, 'MEDIUM', 'USD', 'type_medium', 'quarterly', 'Sales of medium parts', false, NULL),
          (4, 1, 'PROMO', 'index', 'type_promo', 'quarterly', 'Sales of promo parts', true, 'stand-in'),
          (5, 2, 'SMALL', 'USD', 'type_small', 'quarterly', 'Sales of small parts', false, NULL),
          (6, 3, 'STANDARD', 'index', 'type_standard', 'monthly', 'Sales of standard parts', false, NULL),
          (7, 3, 'UNUSED', '%', 'type_unused', 'annual', 'Has no data', false, NULL))
        i(id, domain_id, name, unit, api_code, frequency, definition, is_proxy, proxy_note)""",
    "source": """
        SELECT * FROM (VALUES (1, 'priority 1', 0.95::DOUBLE, true), (2, 'priority 2', 0.95, true),
          (3, 'priority 3', 0.92, false), (4, 'priority 4', 0.90, true), (5, 'priority 5', 0.85, true))
        s(id, name, reliability_score, redistributable)""",
    "cur_v": """
        SELECT * FROM records QUALIFY rank() OVER (
          PARTITION BY geography_id, indicator_id, source_id, year, quarter, month
          ORDER BY coalesce(vintage_date, DATE '0001-01-01') DESC) = 1""",
    "best": """
        SELECT c.* FROM cur_v c JOIN source s ON s.id = c.source_id QUALIFY row_number() OVER (
          PARTITION BY geography_id, indicator_id, year, quarter, month
          ORDER BY reliability_score DESC, source_id) = 1""",
    "srs": f"""
        SELECT g.u AS unit, g.name AS country, d.name AS domain, i.name AS indicator, b.year, b.quarter, b.month,
               {_LABEL} AS period, {_T} AS t, b.value, coalesce(b.unit, i.unit) AS value_unit,
               s.name AS source, i.is_proxy, i.proxy_note
        FROM best b JOIN geo g ON g.id = b.geography_id JOIN indicator i ON i.id = b.indicator_id
        JOIN domain d ON d.id = i.domain_id JOIN source s ON s.id = b.source_id""",
    "latest": """
        SELECT * FROM srs QUALIFY row_number() OVER (
          PARTITION BY unit, indicator ORDER BY t DESC, period DESC) = 1""",
    "annual": """SELECT unit, indicator, year, avg(value) AS value FROM srs GROUP BY ALL""",
    "prov": f"""
        SELECT *, row_number() OVER (PARTITION BY unit, indicator, period
                    ORDER BY reliability_score DESC, source_id) = 1 AS is_best
        FROM (SELECT DISTINCT g.u AS unit, i.name AS indicator, {_LABEL} AS period, c.year, {_T} AS t,
                     s.name AS source, c.source_id, c.value, coalesce(c.unit, i.unit) AS value_unit,
                     s.reliability_score
              FROM cur_v c JOIN geo g ON g.id = c.geography_id JOIN indicator i ON i.id = c.indicator_id
              JOIN source s ON s.id = c.source_id)""",
    "picks": """
        SELECT o_orderkey, o_orderdate, o_totalprice, o_orderstatus, o_orderpriority, c_nationkey,
               year(o_orderdate) * 12 + month(o_orderdate) AS mon,
               CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS p
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "event": """
        SELECT kind || CAST(o_orderkey AS VARCHAR) AS code, 'Order ' || CAST(o_orderkey AS VARCHAR) AS title,
               o_orderstatus AS event_type, iso3, bloc_code, CAST(o_orderdate AS DATE) AS start_date,
               lower(o_orderstatus) || ',p' || substr(o_orderpriority, 1, 1) || ',order' AS tags
        FROM (SELECT 'n' AS kind, *, 'N' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS iso3,
                     CAST(NULL AS VARCHAR) AS bloc_code
              FROM picks QUALIFY row_number() OVER (PARTITION BY c_nationkey, mon
                                                   ORDER BY o_totalprice DESC, o_orderkey DESC) = 1
              UNION ALL
              SELECT 'b', *, NULL, 'B' || CAST(p - 1 AS VARCHAR)
              FROM picks QUALIFY row_number() OVER (PARTITION BY p, mon // 6
                                                   ORDER BY o_totalprice DESC, o_orderkey DESC) = 1
              UNION ALL
              SELECT 'w', *, NULL, NULL
              FROM picks QUALIFY row_number() OVER (PARTITION BY mon // 12
                                                   ORDER BY o_totalprice DESC, o_orderkey DESC) = 1)""",
    "brand": """
        SELECT 'N' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS unit, p_brand AS indicator,
               CAST(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS INTEGER) AS year,
               CAST((CAST(sum(amount) AS BIGINT) + 5000) // 10000 AS DOUBLE) AS value
        FROM sales GROUP BY ALL""",
}

LABEL, DECIMAL_YEAR = _LABEL, _T
