from __future__ import annotations

import math
import random
from statistics import NormalDist

import numpy as np
import pytest

from panelspark.operators import forecast as fc

SCHEMA = "unit string, indicator string, year int, quarter int, month int, value double"


def rows(name, values, freq=1, start=2000):
    per = {1: lambda i: (start + i, 0, 0), 4: lambda i: (start + i // 4, i % 4 + 1, 0),
           12: lambda i: (start + i // 12, 0, i % 12 + 1)}[freq]
    return [(name, "I", *per(i), float(v)) for i, v in enumerate(values)]


def refit(model, y, m, h):
    """Plain one-series models, refitted from scratch."""
    n = len(y)
    if model == "drift":
        return [y[-1] + (y[-1] - y[0]) / (n - 1) * s for s in range(1, h + 1)] if n > 1 else [y[-1]] * h
    if model in ("linear", "log_linear"):
        z = np.log(y) if model == "log_linear" else np.asarray(y)
        b, a = np.polyfit(range(n), z, 1)
        out = [a + b * (n - 1 + s) for s in range(1, h + 1)]
        return [math.exp(v) for v in out] if model == "log_linear" else out
    if model == "holt":
        level, trend = y[0], y[1] - y[0]
        for v in y[1:]:
            new = .5 * v + .5 * (level + trend)
            level, trend = new, .3 * (new - level) + .7 * trend
        return [level + trend * s for s in range(1, h + 1)]
    if model == "seasonal_naive":
        d = np.mean(y[-m:]) - np.mean(y[-2 * m:-m])
        return [y[n - m + (s - 1) % m] + ((s - 1) // m + 1) * d for s in range(1, h + 1)]
    level = float(np.mean(y[:m]))
    trend = (float(np.mean(y[m:2 * m])) - level) / m
    season = [v - level for v in y[:m]]
    for t, v in enumerate(y):
        s = season[t % m]
        new = .4 * (v - s) + .6 * (level + trend)
        level, trend, season[t % m] = new, .1 * (new - level) + .9 * trend, .3 * (v - new) + .7 * s
    return [level + s * trend + season[(n + s - 1) % m] for s in range(1, h + 1)]


def expected(y, m, h, z):
    n, k = len(y), min(5, max(1, len(y) // 3))
    names = ["drift"] if n < 6 else [x for x in fc.MODELS if (x != "log_linear" or min(y) > 0)
                                     and (not x.startswith(("seasonal", "holt_w")) or (m > 1 and n >= 2 * m))]
    scores = {}
    for name in names:
        first = 2 * m if name in ("seasonal_naive", "holt_winters") else 2
        errs = [abs(y[o] - refit(name, y[:o], m, 1)[0]) for o in range(n - k, n) if o >= first]
        if errs:
            scores[name] = errs
    best = min(scores, key=lambda x: np.mean(scores[x])) if scores else "drift"
    errs = scores.get(best, [])
    yhat = refit(best, y, m, h)
    sd = float(np.std(errs)) if errs else 0.0
    return best, (float(np.mean(errs)) if errs else None), [(v - z * sd * math.sqrt(s), v, v + z * sd * math.sqrt(s))
                                                            for s, v in enumerate(yhat, 1)]


def test_random_series_match_refitting(spark):
    rng = random.Random(2)
    series = {}
    for i in range(40):
        freq = rng.choice([1, 4, 12])
        n = rng.choice([1, 2, 3, 5, 6, 9, 24, 40])
        shape = rng.choice([0, 1, 2])
        series[f"s{i}"] = (freq, [50 * (rng.random() - (shape == 2) * .5) + shape * 3 * t
                                  + 20 * math.sin(2 * math.pi * t / max(freq, 2)) for t in range(n)])
    df = spark.createDataFrame([r for name, (f, v) in series.items() for r in rows(name, v, f)], SCHEMA)
    out: dict[str, list] = {}
    for r in fc.forecast(df, horizon=7, level=.9).where("kind = 'forecast'").orderBy("unit", "t").collect():
        out.setdefault(r["unit"], []).append(r)
    z = NormalDist().inv_cdf(.95)
    for name, (freq, y) in series.items():
        best, mae, points = expected(y, freq, 7, z)
        got = out[name]
        assert got[0]["method"] == best and got[0]["fallback"] == (len(y) < 6) and got[0]["n_obs"] == len(y)
        assert got[0]["backtest_mae"] == (None if mae is None else pytest.approx(mae, rel=1e-9, abs=1e-9))
        for r, (lo, mid, hi) in zip(got, points):
            assert (r["lo"], r["value"], r["hi"]) == (pytest.approx(lo, abs=1e-7), pytest.approx(mid, abs=1e-7),
                                                      pytest.approx(hi, abs=1e-7))


def test_known_cases(spark):
    df = spark.createDataFrame(
        rows("line", [2 * i + 5 for i in range(20)]) + rows("short", [1, 2, 3, 4]) + rows("flat", [7] * 10)
        + rows("season", [10 + 5 * math.sin(2 * math.pi * i / 12) + .1 * i for i in range(72)], 12)
        + rows("brief", [10 + 5 * math.sin(2 * math.pi * i / 12) for i in range(18)], 12)
        + rows("gap", [1, 2, 3]) + [("gap", "I", 2010, 0, 0, 9.0)], SCHEMA)
    got: dict[str, list] = {}
    for r in fc.forecast(df, horizon=3).where("kind = 'forecast'").orderBy("unit", "t").collect():
        got.setdefault(r["unit"], []).append(r)
    line = got["line"]
    assert line[0]["method"] == "linear" and [r["value"] for r in line] == [pytest.approx(v) for v in (45, 47, 49)]
    assert [r["period"] for r in line] == ["2020", "2021", "2022"]
    assert got["short"][0]["method"] == "drift" and got["short"][0]["fallback"]
    assert got["flat"][0]["method"] != "drift" and not got["flat"][0]["fallback"]
    assert got["season"][0]["method"] in ("seasonal_naive", "holt_winters") and got["season"][0]["freq"] == 12
    assert got["brief"][0]["method"] not in ("seasonal_naive", "holt_winters")
    assert got["season"][0]["period"] == "2006-01" and got["gap"][0]["n_gaps"] == 7


def test_history_rows_and_arguments(spark):
    df = spark.createDataFrame(rows("q", [1, 2, 3, 4, 5], 4), SCHEMA)
    out = fc.forecast(df, horizon=2).orderBy("t").collect()
    assert [r["kind"] for r in out] == ["history"] * 5 + ["forecast"] * 2
    assert [r["period"] for r in out][-2:] == ["2001-Q2", "2001-Q3"] and out[0]["lo"] is None
    for bad in ({"horizon": 0}, {"level": 1.0}):
        with pytest.raises(ValueError):
            fc.forecast(df, **bad)
