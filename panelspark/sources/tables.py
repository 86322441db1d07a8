"""Reading the stored panel, keeping its dimensions, and raw-payload manifests."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelspark.operators.views import validity
from panelspark.panel import Panel
from panelspark.schema import TABLES


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A stored table's own columns: the batches that logs are partitioned by are left out."""
    return spark.read.schema(TABLES[name]).parquet(f"{root.rstrip('/')}/{name}").select(*TABLES[name].names)


def read_panel(spark: SparkSession, root: str) -> Panel:
    """The panel stored under ``root``, one folder per table."""
    return Panel(records=read_table(spark, root, "statistic_record"),
                 geography=read_table(spark, root, "geography"), indicator=read_table(spark, root, "indicator"),
                 domain=read_table(spark, root, "domain"), source=read_table(spark, root, "source"),
                 bloc=read_table(spark, root, "bloc"), geography_bloc=read_table(spark, root, "geography_bloc"),
                 event=read_table(spark, root, "event"), runs=read_table(spark, root, "ingestion_run"),
                 errors=read_table(spark, root, "ingestion_error"))


def write_records(records: DataFrame, root: str, mode: str = "append") -> None:
    """Facts partitioned by indicator, so an indicator filter prunes files."""
    records.write.mode(mode).partitionBy("indicator_id").parquet(f"{root.rstrip('/')}/statistic_record")


def store_best(panel: Panel, path: str) -> Panel:
    """Write the best view by indicator and read it back: for panels whose view
    is asked often, so that it is computed once per refresh and prunes by indicator."""
    panel.best.write.mode("overwrite").partitionBy("indicator_id").parquet(path)
    return replace(panel, _views={**panel._views, "best": panel.spark.read.parquet(path)})


def store_validity(records: DataFrame, path: str) -> DataFrame:
    """Write every fact's days of validity by indicator and read them back, for ``views.known_on``."""
    validity(records).write.mode("overwrite").partitionBy("indicator_id").parquet(path)
    return records.sparkSession.read.parquet(path).select(*records.columns, "valid_from", "valid_to")


def store_edges(edges: DataFrame, root: str) -> DataFrame:
    """Write mined edges beside the panel, so that every handle opened on it reads them."""
    path = f"{root.rstrip('/')}/correlation_edge"
    edges.write.mode("overwrite").parquet(path)
    return edges.sparkSession.read.parquet(path)


def read_edges(spark: SparkSession, root: str) -> DataFrame | None:
    """The stored edges, None if there are none."""
    try:
        return spark.read.parquet(f"{root.rstrip('/')}/correlation_edge")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def upsert_dim(old: DataFrame, new: DataFrame, key: Sequence[str], update: Sequence[str]) -> DataFrame:
    """Insert rows of ``new`` whose key is absent; on present keys refresh the
    ``update`` columns where ``new`` has a value, and keep the rest."""
    joined = old.alias("o").join(new.alias("n"), list(key), "full_outer")
    out = []
    for column in old.columns:
        o, n = F.col(f"o.{column}"), F.col(f"n.{column}")
        if column in key:
            out.append(F.col(column))
        elif column in update:
            out.append(F.coalesce(n, o).alias(column))
        else:
            present = F.lit(False)
            for k in key:
                present = present | F.col(f"o.{k}").isNotNull()
            out.append(F.when(present, o).otherwise(n).alias(column))
    return joined.select(*out)


def snapshot_manifest(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Digest and file name of each raw payload (source, endpoint, params, payload)."""
    digest = F.sha2(F.col(payload).cast("binary"), 256)
    return payloads.select(
        "source", "endpoint", "params", digest.alias("sha256"),
        F.concat(F.replace("endpoint", F.lit("/"), F.lit("_")), F.lit("_"), F.substring(digest, 1, 12),
                 F.lit(".raw")).alias("file_name"))


def snapshot_files(spark: SparkSession, path: str, source: str) -> DataFrame:
    """The manifest of a folder of payload files; the endpoint is the file's path."""
    files = spark.read.format("binaryFile").load(path)
    return snapshot_manifest(files.select(F.lit(source).alias("source"), F.col("path").alias("endpoint"),
                                          F.lit(None).cast("string").alias("params"),
                                          F.col("content").alias("payload")))


def source_health(records: DataFrame, errors: DataFrame, runs: DataFrame) -> DataFrame:
    """ok / degraded / EMPTY / FAILED / skipped per source.

    ``records`` is (source, indicator_code), ``errors`` the per-series errors,
    ``runs`` the run log; the latest run says whether the source was skipped or failed.
    """
    per_code = records.groupBy("source", "indicator_code").agg(F.count(F.lit(1)).alias("_n"))
    counts = per_code.groupBy("source").agg(F.sum("_n").alias("records"), F.count(F.lit(1)).alias("indicators"))
    failed = errors.groupBy("source").agg(F.count(F.lit(1)).alias("series_errors"))
    last = runs.groupBy("source").agg(F.max_by("status", F.struct("started_at", "status")).alias("_last"))
    zero = F.lit(0)
    status = (F.when(F.col("_last") == "skipped", "skipped").when(F.col("_last") == "failed", "FAILED")
              .when(F.coalesce("records", zero) == 0, "EMPTY")
              .when(F.coalesce("series_errors", zero) > 0, "degraded").otherwise("ok"))
    return (counts.join(failed, "source", "full_outer").join(last, "source", "full_outer")
            .select("source", F.coalesce("records", zero).alias("records"),
                    F.coalesce("indicators", zero).alias("indicators"),
                    F.coalesce("series_errors", zero).alias("series_errors"), status.alias("status")))
