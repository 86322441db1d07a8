"""Incremental refresh: a landing folder of normalized rows, appended to the fact table.

The same validate, resolve and append steps as a batch refresh, run per
micro-batch, with an account of every landed row: stored, already known, or why
it was turned away.

A batch takes effect exactly once, however often it is replayed. Its judgement of every row is written first, to a
journal under the batch's key, and a replay reads that instead of judging anew against a store that already holds
some of its rows. Facts are appended by key, so those of a first attempt are not stored twice; error and run rows
overwrite the batch's own partition of their tables. A journal is deleted when a later batch of its stream is done.
"""
from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DateType, LongType, StructType

from panelspark.operators.ingest import append_new, classify, resolve_keys, run_log, with_sentinels
from panelspark.schema import INGEST_ROW, TABLES
from panelspark.session import cut_lineage, intermediate_tables
from panelspark.sources.tables import read_table, write_records

LANDING = StructType(INGEST_ROW.fields).add("source", "string").add("vintage_date", DateType()).add(
    "ordinal", LongType())


def numbered(batch: DataFrame) -> DataFrame:
    """The rows with a number of their own (_row), from 0 without gaps: ordinals may repeat over the files of a batch.

    Written, since the numbers follow from how the rows lie in tasks; only the tasks' counts are ordered in one.
    """
    placed = cut_lineage(batch.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).alias("_part")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    heads = placed.groupBy(part).agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_head"))
    return cut_lineage(placed.withColumn("_part", part).join(heads, "_part").withColumn(
        "_row", F.col("_head") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_head"))


def judge_batch(batch: DataFrame, existing: DataFrame, geography: DataFrame, indicator: DataFrame,
                source: DataFrame) -> DataFrame:
    """Every landed row with its ids and its ``status``: stored, known, unmatched, or the rule it broke.

    Sources are validated apart: two sources reporting one period are no duplicates. A row of an
    unknown source is not validated at all. Of rows with one key the first in (ordinal, number) counts.
    """
    batch = numbered(batch).withColumn("_seen", F.struct("ordinal", "_row"))
    src = source.select(F.col("id").alias("source_id"), F.col("name").alias("source"))
    tagged = (batch.join(src, "source", "left").withColumn("_code", F.col("indicator_code"))
              .withColumn("indicator_code", F.concat_ws("\x1f", "source", "vintage_date", "indicator_code")))
    known = classify(tagged.where("source_id is not null"), geography, "_seen")
    strangers = with_sentinels(tagged.where("source_id is null")).withColumn("reason", F.lit("unknown_source"))
    judged = known.unionByName(strangers).withColumn("indicator_code", F.col("_code")).drop("_code")
    matched, unmatched = resolve_keys(judged, geography, indicator)
    rows = matched.unionByName(unmatched)
    missing = F.col("geography_id").isNull() | F.col("indicator_id").isNull()
    rows = rows.withColumn("reason", F.coalesce("reason", F.when(missing, "unmatched")))
    fresh = append_new(existing, rows.where("reason is null"), "_seen").select("_row", F.lit("stored").alias("_new"))
    return (rows.join(fresh, "_row", "left")
            .withColumn("status", F.coalesce("reason", "_new", F.lit("known"))).drop("reason", "_new", "_seen"))


def facts(judged: DataFrame, batch_id: int = 0) -> DataFrame:
    """The fact rows of a judged batch. Ids are unique over batches: the batch's number, then the row's."""
    filled = {"id": F.lit(batch_id * (1 << 40)) + F.col("_row"), "confidence_score": F.lit(1.0),
              "is_estimated": F.lit(False), "retrieved_at": F.current_timestamp()}
    return judged.where("status = 'stored'").select(
        *[(filled[f.name] if f.name in filled else F.col(f.name)).cast(f.dataType).alias(f.name)
          for f in TABLES["statistic_record"]])


def problems(judged: DataFrame) -> DataFrame:
    """The error log of a judged batch: one row per source, series and reason, with the number of rows."""
    turned_away = judged.where(~F.col("status").isin("stored", "known"))
    return (turned_away.groupBy("source", F.col("indicator_code").alias("series"), "status")
            .agg(F.count(F.lit(1)).alias("n"))
            .select("source", "series", F.format_string("%s: %d rows", "status", "n").alias("error"),
                    F.current_timestamp().alias("occurred_at")))


def accounting(judged: DataFrame) -> DataFrame:
    """Per source, the landed rows by what became of them."""
    def count(condition: str) -> Column:
        return F.count(F.when(F.expr(condition), 1))

    return judged.groupBy("source").agg(
        F.count(F.lit(1)).alias("received"), count("status = 'stored'").alias("inserted"),
        count("status = 'known'").alias("known"), count("status = 'unmatched'").alias("unmatched"),
        count("status not in ('stored', 'known', 'unmatched')").alias("rejected"))


def load_batch(batch: DataFrame, existing: DataFrame, geography: DataFrame, indicator: DataFrame,
               source: DataFrame, batch_id: int = 0) -> DataFrame:
    """The new fact rows of one batch of landed rows."""
    return facts(judge_batch(batch, existing, geography, indicator, source), batch_id)


def _files(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _journal(batch: DataFrame, spark: SparkSession, root: str, key: str) -> DataFrame:
    """The judgement of a batch: as written by its first attempt, or written now."""
    name = f"{root}/landing_journal/{key}"
    path, fs = _files(spark, f"{name}/_SUCCESS")
    if not fs.exists(path):
        with intermediate_tables(spark):
            dims = [read_table(spark, root, table) for table in ("geography", "indicator", "source")]
            judged = judge_batch(batch, read_table(spark, root, "statistic_record"), *dims)
            judged.withColumn("started_at", F.lit(dt.datetime.now())).write.mode("overwrite").parquet(name)
    return spark.read.parquet(name)


def _forget(spark: SparkSession, root: str, stream: str, before: int | None) -> None:
    """Deletes the journals of a stream's batches before one, or of a whole run."""
    path, fs = _files(spark, f"{root}/landing_journal")
    for found in fs.listStatus(path):
        name, _, number = found.getPath().getName().rpartition("-")
        if name == stream and (before is None or int(number) < before):
            fs.delete(found.getPath(), True)


def refresh(batch: DataFrame, spark: SparkSession, root: str, batch_id: int = 0, stream: str | None = None) -> DataFrame:
    """Store a batch under ``root`` with its error rows and one run row per source; returns the accounting.

    ``stream`` names the stream that numbers the batches; with the same name and number, the batch is a replay.
    Without one, the batch stands for itself.
    """
    root, alone = root.rstrip("/"), stream is None
    stream = stream or uuid.uuid4().hex
    key = f"{stream}-{batch_id}"
    judged = _journal(batch, spark, root, key)
    new = facts(judged, batch_id)
    write_records(append_new(read_table(spark, root, "statistic_record"), new, "id"), root)
    logged = problems(judged)
    logged.write.mode("overwrite").parquet(f"{root}/ingestion_error/batch={key}")
    null = F.lit(None).cast("string")
    sources = judged.groupBy("source").agg(F.min("started_at").alias("started_at")).select(
        "source", "started_at", F.current_timestamp().alias("ended_at"),
        null.alias("disabled_reason"), null.alias("fatal"))
    runs = run_log(sources, judged.where("status = 'stored'"), logged)
    runs.write.mode("overwrite").parquet(f"{root}/ingestion_run/batch={key}")
    # As long as the list of sources.
    account = accounting(judged)
    out = spark.createDataFrame(account.collect(), account.schema)
    _forget(spark, root, stream, None if alone else batch_id)
    return out


def start(spark: SparkSession, landing: str, root: str, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Stream Parquet files of landed rows into the panel stored under ``root``.

    The stream's name is that which Spark keeps in its checkpoint: a stream with a new checkpoint numbers its batches anew.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        refresh(batch, spark, root, batch_id, spark.sparkContext.getLocalProperty("sql.streaming.queryId"))

    writer = (spark.readStream.schema(LANDING).parquet(landing).writeStream.foreachBatch(apply)
              .option("checkpointLocation", checkpoint))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()
