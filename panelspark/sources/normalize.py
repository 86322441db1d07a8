"""Source normalizers: raw statistical extracts to ingest rows.

Every function returns iso3, indicator_code, year, quarter, month, value, unit,
currency, price_basis. Rows of unknown areas, unreadable periods or unreadable
numbers drop out. Lookups are small dimension tables; Catalyst broadcasts them
below its size threshold and shuffles them above it.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelspark.functions.periods import parse_period

# Area codes that are not ISO, and the issuers of reference currencies.
AREA_FIXES = {"EL": "GRC", "UK": "GBR"}
CURRENCY_ISSUERS = {
    "GBP": "GBR", "SEK": "SWE", "NOK": "NOR", "DKK": "DNK", "CHF": "CHE",
    "PLN": "POL", "CZK": "CZE", "HUF": "HUN", "RON": "ROU", "BGN": "BGR",
    "ISK": "ISL", "TRY": "TUR", "RUB": "RUS",
}

SDMX_COLUMNS = "REF_AREA string, CURRENCY string, TIME_PERIOD string, OBS_VALUE string"


def read_sdmx_csv(spark: SparkSession, path: str, schema: str = SDMX_COLUMNS) -> DataFrame:
    """Only the named columns, by header name, whatever else the file carries."""
    return (spark.read.option("header", True).csv(path)
            .select(*[F.col(part.split()[0]) for part in schema.split(", ")]))


def lookup(spark: SparkSession, mapping: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(sorted(mapping.items()), "area string, iso3 string")


def _number(col: Column) -> Column:
    return col.cast("string").try_cast("double")


def _finish(df: DataFrame, indicator_code: str | Column, value: Column, period: Column, *,
            unit: Column | None = None, currency: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    code = F.lit(indicator_code) if isinstance(indicator_code, str) else indicator_code
    return (df.withColumn("_p", period).withColumn("_v", value)
            .where(F.col("_p").isNotNull() & F.col("_v").isNotNull())
            .select("iso3", code.alias("indicator_code"), "_p.year", "_p.quarter", "_p.month",
                    F.col("_v").alias("value"), (none if unit is None else unit).alias("unit"),
                    (none if currency is None else currency).alias("currency"), none.alias("price_basis")))


def normalize_sdmx(rows: DataFrame, area_map: DataFrame, indicator_code: str) -> DataFrame:
    """Rows keyed by a two-letter REF_AREA; ``area_map`` is (area, iso3)."""
    joined = rows.join(area_map, rows["REF_AREA"] == area_map["area"])
    return _finish(joined, indicator_code, _number(F.col("OBS_VALUE")), parse_period("TIME_PERIOD"),
                   currency=F.col("CURRENCY"))


def normalize_exchange_rates(rows: DataFrame, currency_map: DataFrame, indicator_code: str) -> DataFrame:
    """Rows keyed by currency, mapped to the issuing country."""
    joined = rows.join(currency_map, rows["CURRENCY"] == currency_map["area"])
    return _finish(joined, indicator_code, _number(F.col("OBS_VALUE")), parse_period("TIME_PERIOD"),
                   unit=F.concat("CURRENCY", F.lit(" per EUR")), currency=F.col("CURRENCY"))


def normalize_iso3(rows: DataFrame, known: DataFrame, indicator_code: str, unit: str | None = None) -> DataFrame:
    """Rows keyed by ISO3; aggregates and foreign areas are not in ``known`` (iso3)."""
    kept = rows.withColumnRenamed("REF_AREA", "iso3").join(known, "iso3", "left_semi")
    return _finish(kept, indicator_code, _number(F.col("OBS_VALUE")), parse_period("TIME_PERIOD"),
                   unit=F.lit(unit).cast("string"))


def normalize_wide(rows: DataFrame, known: DataFrame, indicator_code: str | Column,
                   year_columns: Sequence[str], area: str = "economy") -> DataFrame:
    """One column per year (YR2000, ...), melted; empty cells drop out."""
    ids = [c for c in rows.columns if c not in year_columns]
    long = (rows.unpivot(ids, list(year_columns), "_yr", "_value").where(F.col("_value").isNotNull())
            .withColumnRenamed(area, "iso3").join(known, "iso3", "left_semi"))
    period = parse_period(F.regexp_extract("_yr", r"([0-9]{4})", 1))
    return _finish(long, indicator_code, _number(F.col("_value")), period)


def map_codes(rows: DataFrame, codes: DataFrame, column: str = "indicator_code") -> DataFrame:
    """External series codes to catalog codes; ``codes`` is (external, catalog)."""
    return (rows.join(codes, rows[column] == codes["external"]).drop(column, "external")
            .withColumnRenamed("catalog", column).select(*rows.columns))


def dataset_id(api_code: Column) -> Column:
    """The dataset a catalog code is drawn from: the part before ``#``."""
    return F.split_part(api_code, F.lit("#"), F.lit(1))


_CUBE = ("id array<string>, size array<bigint>, value map<string,double>, "
         "dimension map<string, struct<category: struct<index: string>>>")


def _index_codes(index: Column) -> Column:
    """Category codes in index order; the index is a {code: position} object or a list."""
    listed = F.from_json(index, "array<string>")
    placed = F.from_json(index, "map<string,int>")
    ordered = F.transform(F.array_sort(F.transform(
        F.map_entries(placed), lambda e: F.struct(e["value"].alias("p"), e["key"].alias("c")))), lambda s: s["c"])
    return F.when(F.ltrim(index).startswith("{"), ordered).otherwise(listed)


def flatten_jsonstat(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Sparse JSON-stat cubes to (geo, TIME_PERIOD, value) rows, other columns kept.

    A cell's flat index is row-major over ``size``: a dimension's position is
    the index divided by the product of the later sizes, modulo its own size.
    """
    keep = [c for c in payloads.columns if c != column]
    cube = payloads.select(*keep, F.from_json(column, _CUBE).alias("_c"))

    def axis(name: str) -> Column:
        position = F.array_position("_c.id", name).cast("int")
        later = F.slice(F.col("_c.size"), position + 1, F.size("_c.size"))
        stride = F.aggregate(later, F.lit(1).cast("long"), lambda acc, n: acc * n)
        return F.when(position > 0, F.struct(
            stride.alias("stride"), F.element_at("_c.size", position).alias("size"),
            _index_codes(F.element_at("_c.dimension", name)["category"]["index"]).alias("codes")))

    def code(dim: str, flat: Column) -> Column:
        ahead = F.col(f"{dim}.stride")
        place = F.pmod((flat - F.pmod(flat, ahead)) / ahead, F.col(f"{dim}.size"))
        return F.get(F.col(f"{dim}.codes"), place.cast("int"))

    def cell(entry: Column) -> Column:
        flat = entry["key"].cast("long")
        return F.struct(code("_geo", flat).alias("geo"), code("_time", flat).alias("TIME_PERIOD"),
                        entry["value"].alias("value"))

    # cells are named before they are exploded, so the code lists are not copied to every row
    return (cube.withColumn("_geo", axis("geo")).withColumn("_time", axis("time"))
            .select(*keep, F.explode(F.transform(F.map_entries("_c.value"), cell)).alias("_cell"))
            .select(*keep, "_cell.*"))


def normalize_cube(rows: DataFrame, geo_map: DataFrame, indicator_code: str | Column, *,
                   known_regions: DataFrame | None = None, unit: Column | None = None) -> DataFrame:
    """Cube rows to ingest rows.

    Country mode maps ``geo`` through ``geo_map`` (area, iso3) after the non-ISO
    fixes. With ``known_regions`` (code) the geo column already holds region
    codes and only known ones are accepted.
    """
    if known_regions is not None:
        kept = rows.join(known_regions.select(F.col("code").alias("geo")), "geo", "left_semi").withColumnRenamed(
            "geo", "iso3")
    else:
        fixed = F.create_map(*[F.lit(x) for pair in AREA_FIXES.items() for x in pair])
        mapped = rows.withColumn("_fixed", F.try_element_at(fixed, "geo"))
        kept = (mapped.join(geo_map.withColumnRenamed("iso3", "_mapped"), F.col("geo") == F.col("area"), "left")
                .withColumn("iso3", F.coalesce("_fixed", "_mapped")).where(F.col("iso3").isNotNull()))
    return _finish(kept, indicator_code, _number(F.col("value")), parse_period("TIME_PERIOD"), unit=unit)
