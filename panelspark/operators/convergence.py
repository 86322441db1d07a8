"""Beta and sigma convergence over (unit, indicator, year, value)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from panelspark.functions.stats import pearson_stats
from panelspark.operators.series import years_clause
from panelspark.session import dealt


def _positive(frame: DataFrame, start: int | None, end: int | None) -> DataFrame:
    return frame.where((F.col("value") > 0) & years_clause(start, end))


def beta_scatter(frame: DataFrame, *, units: DataFrame | None = None, start: int | None = None,
                 end: int | None = None) -> DataFrame:
    """Per unit and indicator: first and last positive level, annual log growth in %, log initial.

    ``units`` (unit) restricts the field, e.g. to a bloc's members. A series has one row a year, so rows are dealt by
    it over all tasks: reduced where the frame's averages are taken, it would be a second table of that size there.
    """
    rows = _positive(frame, start, end)
    if units is not None:
        rows = rows.join(units.select("unit").distinct(), "unit", "left_semi")
    rows = dealt(rows.select("indicator", "unit", "year", "value"), "indicator", "unit")
    span = F.col("final_year") - F.col("initial_year")
    return (rows.groupBy("indicator", "unit")
            .agg(F.min("year").alias("initial_year"), F.min_by("value", "year").alias("initial_value"),
                 F.max("year").alias("final_year"), F.max_by("value", "year").alias("final_value"))
            .where(span > 0)
            .withColumn("annualized_growth", (F.ln("final_value") - F.ln("initial_value")) / span * 100.0)
            .withColumn("log_initial", F.ln("initial_value")))


def beta_stats(scatter: DataFrame, by: str = "indicator") -> DataFrame:
    """OLS of annual growth on log initial level per group, with speed and half-life.

    Everything is null if fewer than three units qualify or all start level. A
    perfect fit has standard error 0 and an infinite t.
    """
    x, y = "log_initial", "annualized_growth"
    n = F.col("n")
    g = scatter.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.var_pop(x).alias("_vx"), F.var_pop(y).alias("_vy"),
        F.covar_pop(x, y).alias("_cxy"), F.avg(x).alias("_mx"), F.avg(y).alias("_my"),
        F.avg(F.col("final_year") - F.col("initial_year")).alias("_span"))
    usable = (n >= 3) & (F.col("_vx") > 0)
    b = F.when(usable, F.try_divide(F.col("_cxy"), F.nullif("_vx", F.lit(0.0))))
    g = g.withColumn("coefficient", b)
    slope, sxx, syy = F.col("coefficient"), F.col("_vx") * n, F.col("_vy") * n
    # residual sum of squares; cancellation noise of a perfect fit counts as zero
    ssr = F.greatest(syy - slope * slope * sxx, F.lit(0.0))
    ssr = F.when(ssr <= syy * 1e-14, F.lit(0.0)).otherwise(ssr)
    g = g.withColumn("_ssr", F.when(slope.isNotNull(), ssr))
    g = (g.withColumn("r_squared", F.when(slope.isNotNull() & (F.col("_vy") > 0),
                                          F.lit(1.0) - F.try_divide("_ssr", F.nullif(syy, F.lit(0.0)))))
         .withColumn("std_err", F.when(slope.isNotNull(), F.sqrt(
             F.try_divide(F.try_divide("_ssr", F.nullif(n - 2, F.lit(0))), F.nullif(sxx, F.lit(0.0)))))))
    inf = float("inf")
    exact_t = F.when(slope > 0, F.lit(inf)).when(slope < 0, F.lit(-inf)).otherwise(F.lit(0.0))
    t = F.when(F.col("std_err") > 0, F.try_divide("coefficient", F.nullif("std_err", F.lit(0.0)))).when(
        F.col("std_err") == 0, exact_t)
    r = F.signum(slope) * F.sqrt("r_squared")
    base = F.lit(1.0) + slope / 100.0 * F.col("_span")
    speed = F.when((F.col("_span") > 0) & (base > 0), -F.ln(base) / F.col("_span"))
    g = g.withColumn("speed", speed)
    return g.select(
        by, "coefficient", F.when(slope.isNotNull(), F.col("_my") - slope * F.col("_mx")).alias("intercept"),
        "std_err", t.alias("t_stat"), pearson_stats(r, n)["p_value"].alias("p_value"), "r_squared", "n", "speed",
        F.when(F.col("speed") > 0, F.ln(F.lit(2.0)) / F.col("speed")).alias("half_life"),
        (slope < 0).alias("converging"))


def sigma_series(frame: DataFrame, *, units: DataFrame | None = None, start: int | None = None,
                 end: int | None = None) -> DataFrame:
    """Cross-unit dispersion of ln(value) per indicator and year."""
    rows = _positive(frame, start, end)
    if units is not None:
        rows = rows.join(units.select("unit").distinct(), "unit", "left_semi")
    return (rows.groupBy("indicator", "year")
            .agg(F.count(F.lit(1)).alias("n"), F.stddev_samp(F.ln("value")).alias("sd_log"),
                 F.stddev_samp("value").alias("_sd"), F.avg("value").alias("_mean"),
                 F.avg(F.ln("value")).alias("mean_log"))
            .where(F.col("n") >= 2)
            .select("indicator", "year", "n", "sd_log", F.try_divide("_sd", "_mean").alias("cv"), "mean_log"))


def sigma_trend(sigma: DataFrame) -> DataFrame:
    """OLS of dispersion on year per indicator, with first and last dispersion."""
    g = sigma.groupBy("indicator").agg(
        F.count(F.lit(1)).alias("n"), F.var_pop("year").alias("_vx"), F.var_pop("sd_log").alias("_vy"),
        F.covar_pop("year", "sd_log").alias("_cxy"), F.min_by("sd_log", "year").alias("_first"),
        F.max_by("sd_log", "year").alias("_last"))
    usable: Column = (F.col("n") >= 2) & (F.col("_vx") > 0)
    slope = F.when(usable, F.try_divide("_cxy", F.nullif("_vx", F.lit(0.0))))
    r = F.when(usable, F.try_divide("_cxy", F.nullif(F.sqrt(F.col("_vx") * F.col("_vy")), F.lit(0.0))))
    return g.select("indicator", slope.alias("slope"), pearson_stats(r, F.col("n"))["p_value"].alias("p_value"),
                    (slope < 0).alias("converging"), F.when(usable, F.col("_first")).alias("start_dispersion"),
                    F.when(usable, F.col("_last")).alias("end_dispersion"))


def convergence(frame: DataFrame, *, units: DataFrame | None = None, start: int | None = None,
                end: int | None = None) -> dict[str, DataFrame]:
    """The scatter and its three summaries."""
    scatter = beta_scatter(frame, units=units, start=start, end=end)
    sigma = sigma_series(frame, units=units, start=start, end=end)
    return {"scatter": scatter, "beta": beta_stats(scatter), "sigma": sigma, "sigma_trend": sigma_trend(sigma)}
