"""Forecasts for every series at once.

A series is one row holding its ordered values: it has at most one value per
period, so its length is bounded by the calendar. Simple models are Column
expressions. Model selection runs in an Arrow-batched pandas UDF that stacks all
series of equal length in a batch and fits every model to all of them together;
a model is run once over a series and gives its one-step predictions at every
origin along the way, instead of being refitted per origin.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from panelspark.functions.periods import label_from_ix, period_ix

# Shortest history for model selection, most backtest origins, smoothing weights.
MIN_OBS = 6
MAX_ORIGINS = 5
HOLT = (0.5, 0.3)
HOLT_WINTERS = (0.4, 0.1, 0.3)
MODELS = ("drift", "linear", "log_linear", "holt", "seasonal_naive", "holt_winters")


def series_rows(df: DataFrame, keys: Sequence[str] = ("unit", "indicator")) -> DataFrame:
    """One row per series: freq (1, 4 or 12), ordered points, size, ends and gaps."""
    freq = F.when(F.max("month") > 0, 12).when(F.max("quarter") > 0, 4).otherwise(1)
    point = F.struct(period_ix().alias("ix"), F.col("value"))
    out = (df.where(F.col("value").isNotNull()).groupBy(*keys)
           .agg(freq.alias("freq"), F.array_sort(F.collect_list(point)).alias("points")))
    first, last = F.element_at("points", 1)["ix"], F.element_at("points", -1)["ix"]
    step = (F.lit(12) / F.col("freq")).cast("int")
    return (out.withColumn("n_obs", F.size("points")).withColumn("step", step)
            .withColumn("first_ix", first).withColumn("last_ix", last)
            .withColumn("n_gaps", ((F.col("last_ix") - F.col("first_ix")) / F.col("step")).cast("int")
                        + 1 - F.col("n_obs")))


def horizon_labels(rows: DataFrame, keys: Sequence[str], horizon: int) -> DataFrame:
    """The next ``horizon`` periods of every series."""
    return (rows.select(*keys, "freq", "n_obs", "n_gaps", "last_ix", "step",
                        F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"))
            .withColumn("ix", F.col("last_ix") + F.col("h") * F.col("step"))
            .select(*keys, "freq", "n_obs", "n_gaps", "h", label_from_ix("ix", "freq").alias("period"),
                    (F.col("ix") / 12.0).alias("t")))


def _with_steps(df: DataFrame, keys: Sequence[str], horizon: int, value: Column) -> DataFrame:
    return (df.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
            .select(*keys, "h", value.alias("value")))


def drift(df: DataFrame, horizon: int, keys: Sequence[str] = ("unit", "indicator")) -> DataFrame:
    """last + (last - first) / (n - 1) * h"""
    ends = (df.where(F.col("value").isNotNull()).withColumn("_ix", period_ix()).groupBy(*keys)
            .agg(F.min_by("value", "_ix").alias("_first"), F.max_by("value", "_ix").alias("_last"),
                 F.count(F.lit(1)).alias("_n")))
    slope = F.coalesce(F.try_divide(F.col("_last") - F.col("_first"), F.col("_n") - 1), F.lit(0.0))
    return _with_steps(ends, keys, horizon, F.col("_last") + slope * F.col("h"))


def linear(df: DataFrame, horizon: int, keys: Sequence[str] = ("unit", "indicator"), log: bool = False) -> DataFrame:
    """OLS on position; ``log`` fits ln(value) and needs every value positive."""
    rows = series_rows(df, keys)
    if log:
        rows = rows.where(F.forall("points", lambda p: p["value"] > 0))
    points = rows.select(*keys, F.posexplode("points").alias("_x", "_p"))
    y = F.ln(F.col("_p.value")) if log else F.col("_p.value")
    fit = (points.select(*keys, F.col("_x").cast("double").alias("_x"), y.alias("_y")).groupBy(*keys)
           .agg(F.regr_slope("_y", "_x").alias("_b"), F.regr_intercept("_y", "_x").alias("_a"),
                F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= 2))
    at = F.col("_a") + F.col("_b") * (F.col("_n") - 1 + F.col("h"))
    return _with_steps(fit, keys, horizon, F.exp(at) if log else at)


def holt(df: DataFrame, horizon: int, keys: Sequence[str] = ("unit", "indicator")) -> DataFrame:
    """Holt's linear smoothing, as an ordered fold over the series."""
    alpha, beta = HOLT
    rows = series_rows(df, keys).withColumn("_v", F.transform("points", lambda p: p["value"]))
    y0 = F.element_at("_v", 1)
    trend0 = F.coalesce(F.try_element_at("_v", F.lit(2)) - y0, F.lit(0.0))

    def step(acc: Column, y: Column) -> Column:
        level = y * alpha + (acc["level"] + acc["trend"]) * (1 - alpha)
        trend = (level - acc["level"]) * beta + acc["trend"] * (1 - beta)
        return F.struct(level.alias("level"), trend.alias("trend"))

    rest = F.slice("_v", F.lit(2), F.size("_v"))
    state = F.aggregate(rest, F.struct(y0.alias("level"), trend0.alias("trend")), step)
    return _with_steps(rows.withColumn("_s", state), keys, horizon,
                       F.col("_s.level") + F.col("_s.trend") * F.col("h"))


# --- models over a block of equally long series -------------------------------
# Each returns (past, future): past[:, t] predicts y[:, t] from y[:, :t]; the first
# usable t is 2 for plain models and two seasons for seasonal ones.
def _drift_block(y: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = y.shape[1]
    steps = np.maximum(np.arange(n), 1)
    slopes = (y - y[:, :1]) / steps                     # slope of the history ending at t
    past = np.full_like(y, np.nan)
    past[:, 1:] = y[:, :-1] + slopes[:, :-1]
    return past, y[:, -1:] + slopes[:, -1:] * h


def _linear_block(y: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = y.shape[1]
    centre = y.mean(axis=1, keepdims=True)
    z, x = y - centre, np.arange(n, dtype=float)
    size = x + 1
    mean_x = x / 2
    sxx = size * (size * size - 1) / 12
    cum_z, cum_xz = np.cumsum(z, axis=1), np.cumsum(z * x, axis=1)
    slope = np.divide(cum_xz - mean_x * cum_z, sxx, out=np.zeros_like(z), where=sxx > 0)
    level = cum_z / size - slope * mean_x + centre
    past = np.full_like(y, np.nan)
    past[:, 1:] = (level + slope * size)[:, :-1]
    return past, level[:, -1:] + slope[:, -1:] * (n - 1 + h)


def _log_linear_block(y: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    past, future = _linear_block(np.log(np.where(y > 0, y, np.nan)), h)
    return np.exp(past), np.exp(future)


def _holt_block(y: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    alpha, beta = HOLT
    past = np.full_like(y, np.nan)
    level, trend = y[:, 0], (y[:, 1] - y[:, 0] if y.shape[1] > 1 else np.zeros(len(y)))
    for t in range(1, y.shape[1]):
        past[:, t] = level + trend
        new = alpha * y[:, t] + (1 - alpha) * (level + trend)
        trend = beta * (new - level) + (1 - beta) * trend
        level = new
    return past, level[:, None] + trend[:, None] * h


def _seasonal_naive_block(y: np.ndarray, h: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    n = y.shape[1]
    total = np.concatenate([np.zeros((len(y), 1)), np.cumsum(y, axis=1)], axis=1)
    season = (total[:, m:] - total[:, :-m]) / m          # mean of the m values ending before column m + i
    shift = season[:, m:] - season[:, :-m]               # by end of history 2m, 2m + 1, ... n
    past = np.full_like(y, np.nan)
    past[:, 2 * m:] = y[:, m:n - m] + shift[:, :-1]
    back = (h - 1) % m
    return past, y[:, n - m + back] + shift[:, -1:] * ((h - 1) // m + 1)


def _holt_winters_block(y: np.ndarray, h: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    alpha, beta, gamma = HOLT_WINTERS
    n = y.shape[1]
    level = y[:, :m].mean(axis=1)
    trend = (y[:, m:2 * m].mean(axis=1) - level) / m
    season = y[:, :m] - level[:, None]                   # current index per phase
    past = np.full_like(y, np.nan)
    for t in range(n):
        phase = t % m
        past[:, t] = level + trend + season[:, phase]
        new = alpha * (y[:, t] - season[:, phase]) + (1 - alpha) * (level + trend)
        trend = beta * (new - level) + (1 - beta) * trend
        season[:, phase] = gamma * (y[:, t] - new) + (1 - gamma) * season[:, phase]
        level = new
    return past, level[:, None] + trend[:, None] * h + season[:, (n + h - 1) % m]


def _fit_block(y: np.ndarray, freq: int, horizon: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mae, spread, future) by model and series: NaN where a model does not apply."""
    count, n = y.shape
    h = np.arange(1, horizon + 1)
    origins = np.arange(n - min(MAX_ORIGINS, max(1, n // 3)), n)
    mae = np.full((len(MODELS), count), np.nan)
    spread = np.full((len(MODELS), count), np.nan)
    future = np.full((len(MODELS), count, horizon), np.nan)
    blocks = {"drift": _drift_block}
    if n >= MIN_OBS:
        blocks |= {"linear": _linear_block, "log_linear": _log_linear_block, "holt": _holt_block}
        if freq > 1 and n >= 2 * freq:
            blocks |= {"seasonal_naive": _seasonal_naive_block, "holt_winters": _holt_winters_block}
    for i, name in enumerate(MODELS):
        if name not in blocks:
            continue
        seasonal = name in ("seasonal_naive", "holt_winters")
        with np.errstate(all="ignore"):
            past, future[i] = blocks[name](y, h, freq) if seasonal else blocks[name](y, h)
            used = origins[origins >= (2 * freq if seasonal else 2)]
            errors = np.abs(y[:, used] - past[:, used])
        sound = np.isfinite(errors).all(axis=1) & (len(used) > 0)
        if sound.any():
            mae[i, sound] = errors[sound].mean(axis=1)
            spread[i, sound] = errors[sound].std(axis=1)
    return mae, spread, future


def _choose(mae: np.ndarray) -> np.ndarray:
    """Index of the selected model per series, -1 if none fits.

    The lowest error wins. Errors equal but for float noise are a tie: then the
    simpler model wins, except that drift always yields to a fitted model.
    """
    best = np.full(mae.shape[1], -1)
    score = np.full(mae.shape[1], np.nan)
    for i in range(mae.shape[0]):
        m = mae[i]
        with np.errstate(all="ignore"):
            tied = np.abs(m - score) <= np.maximum(1e-9 * np.maximum(np.abs(m), np.abs(score)), 1e-12)
            take = np.isfinite(m) & ((best < 0) | (~tied & (m < score)) | (tied & (best == 0)))
        best, score = np.where(take, i, best), np.where(take, m, score)
    return best


def _blocks(values: pd.Series, freq: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Series of equal length and frequency, stacked: (positions, matrix, freq)."""
    shape = pd.DataFrame({"n": values.map(len), "freq": freq})
    for (_, m), where in shape.groupby(["n", "freq"]).indices.items():
        yield where, np.stack([np.asarray(values.iloc[i], dtype=float) for i in where]), int(m)


_FIT = ("method string, fallback boolean, backtest_mae double, "
        "yhat array<double>, lo array<double>, hi array<double>")


def _fit_udf(horizon: int, level: float):
    z = NormalDist().inv_cdf((1 + level) / 2)
    widen = z * np.sqrt(np.arange(1, horizon + 1))

    @F.pandas_udf(_FIT)
    def fit(values: pd.Series, freq: pd.Series) -> pd.DataFrame:
        rows: list = [None] * len(values)
        for where, y, m in _blocks(values, freq):
            mae, spread, future = _fit_block(y, m, horizon)
            chosen = _choose(mae)
            fallback = (chosen < 0) | (y.shape[1] < MIN_OBS)
            pick = np.maximum(chosen, 0)
            for j, i in enumerate(where):
                k = pick[j]
                band = widen * np.nan_to_num(spread[k, j])
                error = mae[k, j]
                rows[i] = (MODELS[k], bool(fallback[j]), None if np.isnan(error) else float(error),
                           future[k, j], future[k, j] - band, future[k, j] + band)
        return pd.DataFrame(rows, columns=["method", "fallback", "backtest_mae", "yhat", "lo", "hi"])

    return fit


def _backtest_udf():
    @F.pandas_udf("array<double>")
    def errors(values: pd.Series, freq: pd.Series) -> pd.Series:
        rows: list = [None] * len(values)
        for where, y, m in _blocks(values, freq):
            mae, _, _ = _fit_block(y, m, 1)
            for j, i in enumerate(where):
                rows[i] = [None if np.isnan(e) else float(e) for e in mae[:, j]]
        return pd.Series(rows)

    return errors


def seasonal(df: DataFrame, horizon: int, model: str, keys: Sequence[str] = ("unit", "indicator")) -> DataFrame:
    """(keys, h, value) of one seasonal model, for the series that hold two seasons at least."""
    k = MODELS.index(model)

    @F.pandas_udf("array<double>")
    def ahead(values: pd.Series, freq: pd.Series) -> pd.Series:
        rows: list = [None] * len(values)
        for where, y, m in _blocks(values, freq):
            if m > 1 and y.shape[1] >= 2 * m:
                future = _fit_block(y, m, horizon)[2]
                for j, i in enumerate(where):
                    rows[i] = future[k, j]
        return pd.Series(rows)

    values = F.transform("points", lambda p: p["value"])
    rows = series_rows(df, keys).where("freq > 1").select(*keys, ahead(values, F.col("freq")).alias("_y"))
    return rows.select(*keys, F.posexplode("_y").alias("_i", "value")).select(
        *keys, (F.col("_i") + 1).alias("h"), "value")


def backtest(df: DataFrame, keys: Sequence[str] = ("unit", "indicator")) -> DataFrame:
    """Mean one-step error of every model that applies to a series, over its last origins."""
    values = F.transform("points", lambda p: p["value"])
    scored = series_rows(df, keys).withColumn("_mae", _backtest_udf()(values, F.col("freq")))
    return (scored.select(*keys, "n_obs", F.posexplode("_mae").alias("_i", "mae")).where(F.col("mae").isNotNull())
            .select(*keys, "n_obs", F.element_at(F.array(*map(F.lit, MODELS)), F.col("_i") + 1).alias("model"), "mae"))


def forecast(df: DataFrame, keys: Sequence[str] = ("unit", "indicator"), horizon: int = 5,
             level: float = 0.8) -> DataFrame:
    """History and forecast rows of every series, with the chosen model's facts as columns.

    This extends the past pattern with a simple model and an empirical band. It
    is no prediction: it cannot foresee shocks, policy changes or turning points.
    """
    if horizon < 1:
        raise ValueError("a forecast needs at least one period ahead")
    if not 0 < level < 1:
        raise ValueError("the band's probability lies strictly between 0 and 1")
    values = F.transform("points", lambda p: p["value"])
    fitted = series_rows(df, keys).withColumn("_f", _fit_udf(horizon, level)(values, F.col("freq")))
    null = F.lit(None).cast("double")
    past = F.transform("points", lambda p: F.struct(
        p["ix"].alias("ix"), p["value"].alias("value"), F.lit("history").alias("kind"), null.alias("lo"),
        null.alias("hi")))
    future = F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda h: F.struct(
        (F.col("last_ix") + h * F.col("step")).alias("ix"), F.element_at("_f.yhat", h).alias("value"),
        F.lit("forecast").alias("kind"), F.element_at("_f.lo", h).alias("lo"),
        F.element_at("_f.hi", h).alias("hi")))
    rows = fitted.select(*keys, "freq", "n_obs", "n_gaps", "_f.method", "_f.fallback", "_f.backtest_mae",
                         F.explode(F.concat(past, future)).alias("_r"))
    return rows.select(*keys, (F.col("_r.ix") / 12.0).alias("t"), label_from_ix("_r.ix", "freq").alias("period"),
                       "_r.value", "_r.kind", "_r.lo", "_r.hi", "method", "freq", "backtest_mae", "fallback",
                       "n_obs", "n_gaps")
