"""Data contracts. Each check is a one-row DataFrame; the battery is their union."""
from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelspark.panel import Panel
from panelspark.schema import ADDITIVE_INDICATORS, LEVEL_COUNTRY, LEVEL_REGION, DataQualityError

ERROR, WARN = "error", "warn"


def _report(df: DataFrame, name: str, passed: Column, severity: Column | str, detail: Column,
            metrics: dict[str, Column]) -> DataFrame:
    level = F.lit(severity) if isinstance(severity, str) else severity
    pairs = [x for key, col in metrics.items() for x in (F.lit(key), col.cast("double"))]
    return df.select(F.lit(name).alias("name"), passed.alias("passed"), level.alias("severity"),
                     (~passed & (level == ERROR)).alias("blocking"), detail.alias("detail"),
                     F.create_map(*pairs).alias("metrics"))


def check_row_count(records: DataFrame, minimum: int = 1000) -> DataFrame:
    n = F.col("n")
    return _report(records.agg(F.count(F.lit(1)).alias("n")), "row_count", n >= minimum, ERROR,
                   F.concat(n.cast("string"), F.lit(f" fact rows, at least {minimum} expected")),
                   {"rows": n, "minimum": F.lit(minimum)})


def check_fk(records: DataFrame, geography: DataFrame, indicator: DataFrame, source: DataFrame) -> DataFrame:
    """Facts whose geography, indicator or source does not exist.

    Facts are counted per id combination first, so the joins see a few rows per
    combination and a hot id costs nothing.
    """
    combos = records.groupBy("geography_id", "indicator_id", "source_id").agg(F.count(F.lit(1)).alias("n"))
    for dim, key in ((geography, "geography_id"), (indicator, "indicator_id"), (source, "source_id")):
        ids = dim.select(F.col("id").alias(key)).distinct().withColumn(f"_{key}", F.lit(True))
        combos = combos.join(ids, key, "left")

    def orphans(key: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col(f"_{key}").isNull(), F.col("n"))), F.lit(0))

    counts = combos.agg(orphans("geography_id").alias("geo"), orphans("indicator_id").alias("ind"),
                        orphans("source_id").alias("src"))
    geo, ind, src = F.col("geo"), F.col("ind"), F.col("src")
    total = geo + ind + src
    detail = F.when(total == 0, F.lit("every fact resolves")).otherwise(
        F.format_string("orphans: %d geography, %d indicator, %d source", geo, ind, src))
    return _report(counts, "referential_integrity", total == 0, ERROR, detail,
                   {"orphan_geography": geo, "orphan_indicator": ind, "orphan_source": src})


def check_finite(records: DataFrame) -> DataFrame:
    v, bad = F.col("value"), F.col("bad")
    odd = F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    return _report(records.agg(F.count(F.when(odd, 1)).alias("bad")), "value_finiteness", bad == 0, ERROR,
                   F.when(bad == 0, F.lit("every value is finite")).otherwise(
                       F.concat(bad.cast("string"), F.lit(" values are not finite"))), {"non_finite": bad})


def check_freshness(records: DataFrame, indicator: DataFrame, as_of: str | dt.date, warn_years: int = 3,
                    error_years: int = 8) -> DataFrame:
    """Age of each indicator's last value; the five worst are named."""
    year = int(str(as_of)[:4])
    last = (records.where(F.col("value").isNotNull()).groupBy("indicator_id").agg(F.max("year").alias("last"))
            .join(indicator.select(F.col("id").alias("indicator_id"), "name"), "indicator_id")
            .select("name", (F.lit(year) - F.col("last")).alias("age")))
    age = F.col("age")
    # one row per indicator of the catalog
    stale = last.agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(age >= error_years, 1)).alias("n_error"),
        F.count(F.when((age >= warn_years) & (age < error_years), 1)).alias("n_warn"),
        *[F.slice(F.array_sort(F.collect_list(F.when(cond, F.struct((-age).alias("k"), "name")))), 1, 5).alias(name)
          for name, cond in (("worst_error", age >= error_years),
                             ("worst_warn", (age >= warn_years) & (age < error_years)))])

    def names(col: str) -> Column:
        return F.concat_ws(", ", F.transform(col, lambda s: F.concat(
            s["name"], F.lit(" ("), (-s["k"]).cast("string"), F.lit("y)"))))

    bad, old = F.col("n_error") > 0, F.col("n_warn") > 0
    detail = (F.when(bad, F.concat(F.lit("too old: "), names("worst_error")))
              .when(old, F.concat(F.lit("getting old: "), names("worst_warn"))).otherwise(F.lit("all fresh")))
    return _report(stale, "freshness", ~bad & ~old, F.when(bad, ERROR).otherwise(WARN), detail,
                   {"n_indicators": F.col("n"), "n_warn": F.col("n_warn"), "n_error": F.col("n_error")})


def check_runs(runs: DataFrame) -> DataFrame:
    """The latest run of every source must not have failed."""
    last = runs.groupBy("source").agg(F.max_by("status", F.struct("started_at", "status")).alias("status"))
    failed = F.col("status") == "failed"
    counts = last.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(failed, 1)).alias("bad"),
                      F.array_sort(F.collect_list(F.when(failed, F.col("source")))).alias("names"))
    return _report(counts, "ingestion_runs", F.col("bad") == 0, ERROR,
                   F.when(F.col("bad") == 0, F.lit("no latest run failed")).otherwise(
                       F.concat(F.lit("failed: "), F.concat_ws(", ", "names"))),
                   {"n_sources": F.col("n"), "n_failed": F.col("bad")})


def rollup_pairs(panel: Panel, additive: Sequence[str] = ADDITIVE_INDICATORS) -> DataFrame:
    """Country value, sum of its regions and their relative difference, per indicator and year."""
    ids = panel.indicator.where(F.col("api_code").isin(list(additive))).select(F.col("id").alias("indicator_id"))
    geo = panel.geography.select(F.col("id").alias("geography_id"), "level", "parent_id")
    facts = (panel.best.where(F.col("value").isNotNull()).select("geography_id", "indicator_id", "year", "value")
             .join(ids, "indicator_id", "left_semi").join(geo, "geography_id"))
    regions = (facts.where((F.col("level") == LEVEL_REGION) & F.col("parent_id").isNotNull())
               .groupBy("indicator_id", F.col("parent_id").alias("country_id"), "year")
               .agg(F.sum("value").alias("region_sum"), F.count(F.lit(1)).alias("n_regions")))
    country = facts.where(F.col("level") == LEVEL_COUNTRY).select(
        "indicator_id", F.col("geography_id").alias("country_id"), "year", F.col("value").alias("country_value"))
    gap = F.abs(F.col("region_sum") - F.col("country_value"))
    return (country.join(regions, ["indicator_id", "country_id", "year"])
            .withColumn("rel_diff", F.try_divide(gap, F.abs("country_value"))))


def check_rollup(panel: Panel, tolerance: float = 0.02,
                 additive: Sequence[str] = ADDITIVE_INDICATORS) -> DataFrame:
    """Regions must add up to their country. A zero or null total cannot reconcile."""
    off = F.col("rel_diff").isNull() | (F.col("rel_diff") > tolerance)
    counts = rollup_pairs(panel, additive).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(off, 1)).alias("bad"))
    n, bad = F.col("n"), F.col("bad")
    detail = (F.when(n == 0, F.lit("nothing to compare"))
              .otherwise(F.concat(bad.cast("string"), F.lit(" of "), n.cast("string"),
                                  F.lit(f" totals differ by more than {tolerance:.0%}"))))
    return _report(counts, "rollup", bad == 0, F.when(n == 0, WARN).otherwise(ERROR), detail,
                   {"n_comparisons": n, "n_mismatched": bad})


def run_checks(panel: Panel, as_of: str | dt.date, *, min_rows: int = 1000, warn_years: int = 3,
               error_years: int = 8, tolerance: float = 0.02,
               additive: Sequence[str] = ADDITIVE_INDICATORS) -> DataFrame:
    checks = [check_row_count(panel.records, min_rows),
              check_fk(panel.records, panel.geography, panel.indicator, panel.source),
              check_finite(panel.records),
              check_freshness(panel.records, panel.indicator, as_of, warn_years, error_years)]
    if panel.runs is not None:
        checks.append(check_runs(panel.runs))
    checks.append(check_rollup(panel, tolerance, additive))
    report = checks[0]
    for check in checks[1:]:
        report = report.unionByName(check)
    return report


def raise_for_status(report: DataFrame) -> None:
    """One action: fetch the few check rows, raise if any blocks."""
    blocking = report.where("blocking").select("name", "detail").collect()
    if blocking:
        lines = "; ".join(f"[{r['name']}] {r['detail']}" for r in blocking)
        raise DataQualityError(f"{len(blocking)} blocking contract(s) failed: {lines}")


def summary(report: DataFrame) -> str:
    rows = report.select("name", "passed", "blocking", "detail").collect()
    marks = ["PASS" if r["passed"] else ("FAIL" if r["blocking"] else "WARN") for r in rows]
    verdict = "BLOCKED" if any(r["blocking"] for r in rows) else "OK"
    return "\n".join([f"contracts: {verdict}"] + [f"  {m}  {r['name']}: {r['detail']}" for m, r in zip(marks, rows)])
