"""Validation, key resolution, idempotent append, de-duplication and run logs."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelspark.functions.timeline import totals_before
from panelspark.operators.views import vintage_order
from panelspark.schema import MAX_YEAR, MIN_YEAR, PERIOD, RECORD_KEY, DataQualityError
from panelspark.session import dealt


def with_sentinels(df: DataFrame) -> DataFrame:
    """0 instead of null for quarter and month."""
    return (df.withColumn("quarter", F.coalesce("quarter", F.lit(0)))
            .withColumn("month", F.coalesce("month", F.lit(0))))


def _is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def classify(rows: DataFrame, known_codes: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Adds ``reason``: null for valid rows, else the first rule that failed.

    Order: unknown_iso3, non_finite_value, year_out_of_range, duplicate. A
    DataFrame has no order, so "first seen" is the smallest ``ordinal``, which
    must be unique. The smallest ordinal per key is found by aggregation and
    joined back: many copies of one key never meet in one window.
    """
    key = ["iso3", "indicator_code", *PERIOD]
    codes = known_codes.select(F.col("code").alias("iso3")).distinct().withColumn("_known", F.lit(True))
    checked = (with_sentinels(rows).join(codes, "iso3", "left")
               .withColumn("reason", F.when(F.col("_known").isNull(), "unknown_iso3")
                           .when(~_is_finite(F.col("value")), "non_finite_value")
                           .when(F.col("year").isNull() | ~F.col("year").between(MIN_YEAR, MAX_YEAR),
                                 "year_out_of_range")).drop("_known"))
    # only repeated keys go into the join back: they are few, and it can be a broadcast
    first = (checked.where("reason is null").groupBy(*key)
             .agg(F.min(ordinal).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"))
    return (checked.join(first, key, "left")
            .withColumn("reason", F.when(F.col("reason").isNull() & (F.col(ordinal) != F.col("_first")),
                                         "duplicate").otherwise(F.col("reason")))
            .drop("_first"))


def validate(rows: DataFrame, known_codes: DataFrame, ordinal: str = "ordinal") -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with reason)."""
    marked = classify(rows, known_codes, ordinal)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def resolve_keys(rows: DataFrame, geography: DataFrame, indicator: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matched, unmatched): natural keys to ids, by geography code and indicator api_code."""
    geo = geography.select(F.col("id").alias("geography_id"), F.col("code").alias("iso3"))
    ind = indicator.where(F.col("api_code").isNotNull()).select(
        F.col("id").alias("indicator_id"), F.col("api_code").alias("indicator_code"))
    joined = rows.join(geo, "iso3", "left").join(ind, "indicator_code", "left")
    missing = F.col("geography_id").isNull() | F.col("indicator_id").isNull()
    return joined.where(~missing), joined.where(missing)


def append_new(existing: DataFrame, batch: DataFrame, ordinal: str | None = None) -> DataFrame:
    """Rows of ``batch`` whose 7-column key is not stored yet, one per key.

    A null vintage equals a null vintage. Of rows with one key in the batch the one with
    the smallest ``ordinal`` stays (then the smallest value). Only the stored rows of the
    batch's indicators and years are compared: these are partition values of the store, so
    the scan skips the rest.
    """
    rows = with_sentinels(batch)
    keys = [*[c for c in RECORD_KEY if c != "vintage_date"], vintage_order()]
    first = Window.partitionBy(*keys).orderBy(*[c for c in (ordinal,) if c], F.col("value").asc_nulls_last())
    rows = rows.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")
    touched = rows.select("indicator_id", "year").distinct()
    near = existing.select(*RECORD_KEY).join(touched, ["indicator_id", "year"], "left_semi")
    plain = [c for c in RECORD_KEY if c != "vintage_date"]
    b = rows.withColumn("_vintage", vintage_order())
    e = with_sentinels(near).select(*plain, vintage_order().alias("_vintage"))
    return b.join(e, [*plain, "_vintage"], "left_anti").select(*rows.columns)


def dedup_records(records: DataFrame) -> DataFrame:
    """One row per key and vintage: newest ``retrieved_at``, then highest id.

    ``row_number() = 1`` is limited per task before the shuffle.
    """
    rows = with_sentinels(records)
    keys = [c for c in RECORD_KEY if c != "vintage_date"]
    w = (Window.partitionBy(*keys, vintage_order())
         .orderBy(F.col("retrieved_at").desc_nulls_last(), F.desc("id"), F.col("value").desc_nulls_last()))
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def view_difference(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """One row: size of the first view, rows missing from and extra in the second.

    Nearly every row is a group of its own, so each view is dealt over all tasks first, by the whole row.
    """
    b, a = (dealt(view.select(*columns), *columns) for view in (before, after))
    tagged = (b.withColumn("_side", F.lit(1)).unionByName(a.withColumn("_side", F.lit(-1)))
              .groupBy(*columns).agg(F.sum("_side").alias("_net"),
                                     F.count(F.when(F.col("_side") == 1, 1)).alias("_before")))
    return tagged.agg(
        F.coalesce(F.sum("_before"), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum(F.greatest("_net", F.lit(0))), F.lit(0)).alias("missing"),
        F.coalesce(F.sum(F.greatest(-F.col("_net"), F.lit(0))), F.lit(0)).alias("extra"))


def assert_same_view(before: DataFrame, after: DataFrame, columns: list[str]) -> None:
    """Raise unless both views hold the same rows, and some rows at all."""
    row = view_difference(before, after, columns).first()
    if row["rows_before"] == 0:
        raise DataQualityError("the view is empty, so it proves nothing")
    if row["missing"] or row["extra"]:
        raise DataQualityError(f"{row['missing']} rows lost, {row['extra']} rows added")


def run_log(sources: DataFrame, loaded: DataFrame, errors: DataFrame) -> DataFrame:
    """Status row per source.

    ``sources`` is (source, started_at, ended_at, disabled_reason, fatal): a
    disabled source is skipped, a fatal error is a failed run. ``loaded`` holds
    one row per stored record with its source, ``errors`` the per-series errors.
    """
    counts = loaded.groupBy("source").agg(F.count(F.lit(1)).cast("int").alias("records_processed"))
    failed = errors.groupBy("source").agg(F.count(F.lit(1)).alias("_errors"))
    ran = F.col("disabled_reason").isNull() & F.col("fatal").isNull()
    return (sources.join(counts, "source", "left").join(failed, "source", "left")
            .select("source", "started_at", "ended_at",
                    F.when(F.col("disabled_reason").isNotNull(), "skipped")
                    .when(F.col("fatal").isNotNull(), "failed")
                    .when(F.col("_errors") > 0, "completed_with_errors").otherwise("completed").alias("status"),
                    F.when(ran, F.coalesce("records_processed", F.lit(0))).otherwise(F.lit(0))
                    .alias("records_processed"),
                    F.coalesce("disabled_reason", "fatal").alias("error")))


def ingestion_summary(runs: DataFrame, errors: DataFrame, chunk_seconds: int = 86400) -> DataFrame:
    """Runs with the number of errors logged while they ran.

    One source may own most runs and errors, so the counts are read off the
    source's timeline at both ends of each run instead of joining runs to errors.
    """
    start = F.unix_micros(F.col("started_at").cast("timestamp"))
    end = F.unix_micros(F.col("ended_at").cast("timestamp"))
    edges = F.array(F.struct(F.lit(-1).alias("sign"), start.alias("at")),
                    F.struct(F.lit(1).alias("sign"), (end + 1).alias("at")))
    marked = runs.withColumn("_e", F.explode(F.filter(edges, lambda e: e["at"].isNotNull())))
    probes = marked.select("source", F.col("_e.at").alias("at"), F.col("_e.sign").alias("sign"),
                           "started_at", "ended_at", "status", "records_processed", "error")
    obs = errors.select("source", F.unix_micros(F.col("occurred_at").cast("timestamp")).alias("at"), F.lit(0).alias("value"))
    key = ["source", "started_at", "ended_at", "status", "records_processed", "error"]
    # identical log rows stay apart: they are counted, summed and repeated
    return (totals_before(obs, probes, ["source"], chunk_seconds * 1_000_000).groupBy(*key)
            .agg(F.sum(F.col("sign") * F.col("n_before")).alias("_n"),
                 F.count(F.when(F.col("sign") == -1, 1)).alias("_copies"))
            .withColumn("series_errors", F.when(F.col("ended_at").isNull(), F.lit(0))
                        .otherwise((F.col("_n") / F.col("_copies")).cast("long")))
            .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
            .select("source", "started_at", "status", "records_processed", "error", "series_errors"))
