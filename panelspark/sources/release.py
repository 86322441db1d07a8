"""Sinks: the release file, view downloads, the full extract."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelspark.operators.quality import raise_for_status, run_checks
from panelspark.operators.views import unit_code
from panelspark.panel import Panel
from panelspark.schema import RECORD_KEY
from panelspark.session import dealt


def release_facts(panel: Panel) -> DataFrame:
    """Latest-vintage facts of redistributable sources with all dimensions, periods included.

    Labels make wide rows, which a writer sorts: the facts are dealt over all tasks before they get them.
    By the vintage too, since Spark leaves out a second shuffle by the keys of the view's own.
    """
    geo = unit_code(panel.geography).select(F.col("id").alias("geography_id"), F.col("unit").alias("iso3"),
                                            F.col("name").alias("country"))
    ind = panel.indicator.select(F.col("id").alias("indicator_id"), "domain_id", F.col("name").alias("indicator"))
    dom = panel.domain.select(F.col("id").alias("domain_id"), F.col("name").alias("domain"))
    src = panel.source.where("redistributable").select(F.col("id").alias("source_id"),
                                                       F.col("name").alias("source_name"))
    optional = [c for c in ("unit", "currency", "price_basis") if c in panel.records.columns]
    return (dealt(panel.current, *RECORD_KEY).join(src, "source_id").join(ind, "indicator_id").join(dom, "domain_id")
            .join(geo, "geography_id")
            .select("iso3", "country", "domain", "indicator", "source_name", "year", "quarter", "month",
                    "value", *optional, "vintage_date"))


def export_release(panel: Panel, path: str) -> None:
    release_facts(panel).write.mode("overwrite").partitionBy("indicator").parquet(path)


def gated_release(panel: Panel, path: str, as_of: str, **limits) -> None:
    """Publish only if no blocking contract fails."""
    raise_for_status(run_checks(panel, as_of, **limits))
    export_release(panel, path)


def export_view(df: DataFrame, path: str, fmt: str = "csv") -> None:
    if fmt == "csv":
        df.write.mode("overwrite").option("header", True).csv(path)
    elif fmt == "parquet":
        df.write.mode("overwrite").parquet(path)
    else:
        raise ValueError("fmt must be 'csv' or 'parquet'")


def full_extract(series_df: DataFrame, ordered: bool = True) -> DataFrame:
    """The tidy data set of the best view."""
    out = series_df.select(F.col("unit").alias("iso3"), "country", "domain", "indicator", "year", "value",
                           F.col("value_unit").alias("unit"), "source", "is_proxy")
    return out.orderBy("domain", "indicator", "iso3", "year") if ordered else out
