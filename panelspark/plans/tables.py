"""A panel derived from the test tables.

Facts come from lineitem joined to orders, customer and part: the unit is the
customer's nation (level "country") and the customer itself (level "NUTS2",
child of the nation), the indicator is the part type, the source the order
priority, the period follows the order date and the vintage the ship date.
Amounts are summed as exact integers and rounded to whole units, so equal
inputs give bit-equal values whatever the order of summation.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from panelspark.panel import Panel
from panelspark.schema import LEVEL_COUNTRY, LEVEL_REGION
from panelspark.session import dealt

# Part types of the test tables, and the invented catalog around them.
PART_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
RELIABILITY = [0.95, 0.95, 0.92, 0.90, 0.85]
DOMAINS = [(1, "Trade"), (2, "Industry"), (3, "Retail")]
MONTHLY_INDICATOR = 6
UNDATED_SOURCE = 5
CLOSED_SOURCE = 3
CUSTOMER_OFFSET = 1000
SALES_PER_TASK = 500_000

_STORED: dict[tuple[str, str, str], DataFrame] = {}
_PANELS: dict[tuple[str, str, bool], Panel] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table, built once per session and kept: it stands for a stored table."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        _STORED[key] = build().persist(StorageLevel.MEMORY_AND_DISK)
    return _STORED[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with nation, customer, type, brand, dates and an exact integer amount."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_shipdate",
        (F.round(F.col("l_extendedprice") * 100).cast("long")
         * F.round((1 - F.col("l_discount")) * 100).cast("long")).alias("amount"))
    return (lines.join(part, lines["l_partkey"] == part["p_partkey"])
            .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(customer, F.col("o_custkey") == F.col("c_custkey"))
            .select("c_nationkey", F.col("c_custkey").cast("int").alias("c_custkey"),
                    "p_type", "p_brand", "o_orderdate",
                    F.col("o_orderpriority").substr(1, 1).cast("int").alias("source_id"),
                    "l_shipdate", "amount"))


def whole_units(amount: str = "amount"):
    return F.expr(f"cast((sum({amount}) + 5000) div 10000 as double)")


def build_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both levels in one pass: each sale counts for its nation and its customer.

    Nearly every sale is a customer's fact of its own, so the sales are dealt by that fact's key: a task's table holds few.
    """
    base = sales(spark, sf_dir).select(
        "c_nationkey", "c_custkey", "source_id", "amount",
        F.array_position(F.array(*map(F.lit, PART_TYPES)), F.col("p_type")).cast("int").alias("indicator_id"),
        F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("_q"),
        F.month("o_orderdate").alias("_m"),
        F.when(F.col("source_id") != UNDATED_SOURCE,
               F.date_trunc("quarter", "l_shipdate").cast("date")).alias("vintage_date"))
    monthly = F.col("indicator_id") == MONTHLY_INDICATOR
    nation = F.struct((F.col("c_nationkey") + 1).alias("geography_id"),
                      F.when(monthly, 0).otherwise(F.col("_q")).alias("quarter"),
                      F.when(monthly, F.col("_m")).otherwise(0).alias("month"))
    customer = F.struct((F.col("c_custkey") + CUSTOMER_OFFSET).alias("geography_id"),
                        F.lit(0).alias("quarter"), F.lit(0).alias("month"))
    sold = table(spark, sf_dir, "lineitem").count()     # from the files' footers
    base = dealt(base, "c_custkey", "indicator_id", "source_id", "year", "vintage_date", at_least=-(-sold // SALES_PER_TASK))
    both = base.withColumn("_level", F.explode(F.array(nation, customer)))
    return (both.select("_level.*", "indicator_id", "source_id", "year", "vintage_date", "amount")
            .groupBy("geography_id", "indicator_id", "source_id", "year", "quarter", "month",
                     "vintage_date").agg(whole_units().alias("value"))
            .withColumn("unit", F.expr("cast(null as string)")))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived fact table."""
    return stored(spark, sf_dir, "records", lambda: build_records(spark, sf_dir))


def geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    code = F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"))
    null = F.lit(None)
    countries = nation.select(
        (F.col("n_nationkey") + 1).alias("id"), code.alias("code"), F.lit(LEVEL_COUNTRY).alias("level"),
        null.cast("int").alias("parent_id"), F.col("n_name").alias("name"),
        F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("iso2"), code.alias("iso3"),
        (F.col("n_regionkey") == 0).alias("is_transcontinental"),
        (F.col("n_regionkey") == 4).alias("is_disputed"))
    customers = table(spark, sf_dir, "customer").select(
        (F.col("c_custkey").cast("int") + CUSTOMER_OFFSET).alias("id"),
        F.concat(F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.lit("C"),
                 F.col("c_custkey").cast("string")).alias("code"),
        F.lit(LEVEL_REGION).alias("level"), (F.col("c_nationkey") + 1).alias("parent_id"),
        F.col("c_name").alias("name"), null.cast("string").alias("iso2"),
        null.cast("string").alias("iso3"), F.lit(False).alias("is_transcontinental"),
        F.lit(False).alias("is_disputed"))
    return countries.unionByName(customers)


def bloc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(
        (F.col("r_regionkey") + 1).alias("id"), F.concat(F.lit("B"), F.col("r_regionkey")).alias("code"),
        F.col("r_name").alias("name"))


def geography_bloc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations belong to their region from a staggered year on, and most once
    belonged to the next region; customers follow their nation."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    home = nation.select("n_nationkey", (F.col("n_regionkey") + 1).alias("bloc_id"),
                         (F.lit(1990) + F.col("n_nationkey") % 8).alias("since_year"),
                         F.lit(None).cast("int").alias("until_year"))
    former = (nation.where("n_nationkey % 3 <> 0").select(
        "n_nationkey", ((F.col("n_regionkey") + 1) % 5 + 1).alias("bloc_id"),
        F.lit(1985).alias("since_year"),
        (F.lit(1995) + F.col("n_nationkey") % 5).alias("until_year")))
    spans = home.unionByName(former)
    own = spans.select((F.col("n_nationkey") + 1).alias("geography_id"), "bloc_id", "since_year", "until_year")
    customers = (table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
                 .join(spans, F.col("c_nationkey") == F.col("n_nationkey"))
                 .select((F.col("c_custkey").cast("int") + CUSTOMER_OFFSET).alias("geography_id"), "bloc_id",
                         "since_year", "until_year"))
    return own.unionByName(customers)


def catalog(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of given rows whose size Catalyst knows, as it would of a stored one.

    Rows of plain ``createDataFrame`` count as endless: facts would be shuffled by the catalog's few ids to join them.
    """
    names = [part.split()[0] for part in schema.split(", ")]
    columns = {name: list(values) for name, values in zip(names, zip(*rows))}
    return spark.createDataFrame(pa.table(columns), StructType.fromDDL(schema))


def domain(spark: SparkSession) -> DataFrame:
    return catalog(spark, [(i, n, f"{n} figures") for i, n in DOMAINS], "id int, name string, description string")


def indicator(spark: SparkSession) -> DataFrame:
    rows = [(i, (i - 1) % 3 + 1, name, "USD" if i % 2 else "index", f"type_{name.lower()}",
             "monthly" if i == MONTHLY_INDICATOR else "quarterly", f"Sales of {name.lower()} parts",
             i == 4, "stand-in" if i == 4 else None)
            for i, name in enumerate(PART_TYPES, start=1)]
    rows.append((7, 3, "UNUSED", "%", "type_unused", "annual", "Has no data", False, None))
    return catalog(spark, rows, "id int, domain_id int, name string, unit string, api_code string, frequency string, "
                                "definition string, is_proxy boolean, proxy_note string")


def source(spark: SparkSession) -> DataFrame:
    return catalog(spark, [(i, f"priority {i}", score, i != CLOSED_SOURCE) for i, score in enumerate(RELIABILITY, start=1)],
                   "id int, name string, reliability_score double, redistributable boolean")


def panel(spark: SparkSession, sf_dir: str, stored_best: bool = True) -> Panel:
    """The panel; its best view is stored too, unless the view itself is to be computed."""
    key = (spark.sparkContext.applicationId, sf_dir, stored_best)
    if key not in _PANELS:
        _PANELS[key] = _build_panel(spark, sf_dir, stored_best)
    return _PANELS[key]


def _build_panel(spark: SparkSession, sf_dir: str, stored_best: bool) -> Panel:
    p = Panel(records=records(spark, sf_dir), geography=geography(spark, sf_dir),
              indicator=indicator(spark), domain=domain(spark), source=source(spark),
              bloc=bloc(spark, sf_dir), geography_bloc=geography_bloc(spark, sf_dir),
              event=events(spark, sf_dir))
    if not stored_best:
        return p
    # its own column order, so that the stored copy never stands in for the view when that is asked itself
    best = stored(spark, sf_dir, "best", lambda: panel(spark, sf_dir, stored_best=False).best.select(
        *sorted(p.records.columns)))
    return replace(p, _views={"best": best})


def brand_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(unit, indicator, year, value): brands by nation; the "year" axis is the
    quarter index, so a series has enough points for lag and causality tests."""
    return stored(spark, sf_dir, "brands", lambda: _build_brand_frame(spark, sf_dir))


def _build_brand_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (sales(spark, sf_dir)
            .groupBy(F.concat(F.lit("N"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0")).alias("unit"),
                     F.col("p_brand").alias("indicator"),
                     (F.year("o_orderdate") * 4 + F.quarter("o_orderdate") - 1).alias("year"))
            .agg(whole_units().alias("value")))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated events out of the orders: the largest order of each nation and month,
    each priority group and half-year, and each year, scoped to the nation, a region, everyone."""
    return stored(spark, sf_dir, "events", lambda: _build_events(spark, sf_dir))


def _build_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = (table(spark, sf_dir, "orders")
            .join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"),
                  F.col("o_custkey") == F.col("c_custkey"))
            .select("o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus", "o_orderpriority",
                    "c_nationkey",
                    (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("_month"),
                    F.col("o_orderpriority").substr(1, 1).cast("int").alias("_p")))
    pick = F.max_by(F.struct("o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority"),
                    F.struct("o_totalprice", "o_orderkey")).alias("o")
    nation = (rows.groupBy("c_nationkey", "_month").agg(pick)
              .select("o.*", F.concat(F.lit("N"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0")).alias("iso3"),
                      F.lit(None).cast("string").alias("bloc_code"), F.lit("n").alias("_kind")))
    region = (rows.groupBy("_p", (F.floor(F.col("_month") / 6)).alias("_half")).agg(pick)
              .select("o.*", F.lit(None).cast("string").alias("iso3"),
                      F.concat(F.lit("B"), F.col("_p") - 1).alias("bloc_code"), F.lit("b").alias("_kind")))
    world = (rows.groupBy((F.floor(F.col("_month") / 12)).alias("_year")).agg(pick)
             .select("o.*", F.lit(None).cast("string").alias("iso3"),
                     F.lit(None).cast("string").alias("bloc_code"), F.lit("w").alias("_kind")))
    return (nation.unionByName(region).unionByName(world)
            .select(F.concat("_kind", F.col("o_orderkey")).alias("code"),
                    F.concat(F.lit("Order "), F.col("o_orderkey")).alias("title"),
                    F.col("o_orderstatus").alias("event_type"), "iso3", "bloc_code",
                    F.col("o_orderdate").cast("date").alias("start_date"),
                    F.concat_ws(",", F.lower("o_orderstatus"),
                                F.concat(F.lit("p"), F.col("o_orderpriority").substr(1, 1)),
                                F.lit("order")).alias("tags")))
