"""The whole forecast in SQL: every model refitted at every origin, selection and band.

It rests on ``fser``: (unit, indicator, value, ix, freq, pos, n).
"""
from __future__ import annotations

from statistics import NormalDist

_PREDICTIONS = """
    WITH RECURSIVE arr AS (
      SELECT unit, indicator, freq, n, min(ix) AS ix0, max(ix) AS ix1, min(value) AS lowest,
             list(value ORDER BY pos) AS v
      FROM fser GROUP BY ALL),
    holt AS (
      SELECT unit, indicator, n, v, CAST(1 AS BIGINT) AS t, v[1] AS level, coalesce(v[2] - v[1], 0.0) AS trend FROM arr
      UNION ALL
      SELECT unit, indicator, n, v, t + 1, nl, 0.3 * (nl - level) + 0.7 * trend
      FROM (SELECT *, 0.5 * v[t + 1] + 0.5 * (level + trend) AS nl FROM holt WHERE t < n)),
    hw AS (
      SELECT unit, indicator, n, freq AS m, v, CAST(0 AS BIGINT) AS t, list_avg(v[1:freq]) AS level,
             (list_avg(v[freq + 1:2 * freq]) - list_avg(v[1:freq])) / freq AS trend,
             list_transform(v[1:freq], lambda x: x - list_avg(v[1:freq])) AS season
      FROM arr WHERE freq > 1 AND n >= 2 * freq
      UNION ALL
      SELECT unit, indicator, n, m, v, t + 1, nl, 0.1 * (nl - level) + 0.9 * trend,
             list_transform(range(1, m + 1), lambda i: CASE WHEN i = t % m + 1
               THEN 0.3 * (v[t + 1] - nl) + 0.7 * season[t % m + 1] ELSE season[i] END)
      FROM (SELECT *, 0.4 * (v[t + 1] - season[t % m + 1]) + 0.6 * (level + trend) AS nl FROM hw WHERE t < n)),
    past AS (
      SELECT unit, indicator, n, pos, freq, value, least(5, greatest(1, n // 3)) AS k,
             min(value) OVER (PARTITION BY unit, indicator) > 0 AS positive,
             lag(value) OVER w + (lag(value) OVER w - first_value(value) OVER w) / nullif(pos - 1, 0) AS p0,
             regr_intercept(value, pos) OVER p + regr_slope(value, pos) OVER p * pos AS p1,
             exp(regr_intercept(ln(greatest(value, 1e-9)), pos) OVER p
                 + regr_slope(ln(greatest(value, 1e-9)), pos) OVER p * pos) AS p2,
             CASE freq WHEN 4 THEN lag(value, 4) OVER w + avg(value) OVER q1 - avg(value) OVER q2
                       WHEN 12 THEN lag(value, 12) OVER w + avg(value) OVER m1 - avg(value) OVER m2 END AS p4
      FROM fser WINDOW w AS (PARTITION BY unit, indicator ORDER BY pos),
        p AS (PARTITION BY unit, indicator ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
        q1 AS (PARTITION BY unit, indicator ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING),
        q2 AS (PARTITION BY unit, indicator ORDER BY pos ROWS BETWEEN 8 PRECEDING AND 5 PRECEDING),
        m1 AS (PARTITION BY unit, indicator ORDER BY pos ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING),
        m2 AS (PARTITION BY unit, indicator ORDER BY pos ROWS BETWEEN 24 PRECEDING AND 13 PRECEDING)),
    errs AS (
      SELECT unit, indicator, 0 AS model, abs(value - p0) AS e FROM past WHERE pos >= greatest(2, n - k)
      UNION ALL SELECT unit, indicator, 1, abs(value - p1) FROM past WHERE n >= 6 AND pos >= n - k
      UNION ALL SELECT unit, indicator, 2, abs(value - p2) FROM past WHERE n >= 6 AND pos >= n - k AND positive
      UNION ALL SELECT h.unit, h.indicator, 3, abs(h.v[t + 1] - level - trend)
                FROM holt h WHERE h.n >= 6 AND t < n AND t >= n - least(5, n // 3)
      UNION ALL SELECT unit, indicator, 4, abs(value - p4)
                FROM past WHERE n >= 6 AND freq > 1 AND pos >= greatest(2 * freq, n - k)
      UNION ALL SELECT unit, indicator, 5, abs(v[t + 1] - level - trend - season[t % m + 1])
                FROM hw WHERE n >= 6 AND t < n AND t >= greatest(2 * m, n - least(5, n // 3))),
    scored AS (SELECT unit, indicator, model, avg(e) AS mae, stddev_pop(e) AS sd FROM errs GROUP BY ALL),
    chosen AS (
      SELECT a.*, coalesce(s.model, 0) AS model, s.mae, coalesce(s.sd, 0) AS sd, s.model IS NULL OR n < 6 AS fallback
      FROM arr a LEFT JOIN (SELECT * FROM scored QUALIFY row_number() OVER (
             PARTITION BY unit, indicator ORDER BY round(mae, 5), CAST(model = 0 AS INTEGER), model) = 1) s
        USING (unit, indicator)),
    fits AS (SELECT unit, indicator, regr_slope(value, pos) AS b, regr_intercept(value, pos) AS a,
                    regr_slope(ln(greatest(value, 1e-9)), pos) AS lb,
                    regr_intercept(ln(greatest(value, 1e-9)), pos) AS la FROM fser GROUP BY ALL)"""


def predictions() -> str:
    """Every model's state and errors, as common table expressions."""
    return _PREDICTIONS


def forecast_sql(horizon: int, level: float, with_history: bool) -> str:
    z = NormalDist().inv_cdf((1 + level) / 2)
    label = ("CASE freq WHEN 12 THEN (ix // 12) || '-' || lpad(CAST(ix % 12 + 1 AS VARCHAR), 2, '0') "
             "WHEN 4 THEN (ix // 12) || '-Q' || (ix % 12 // 3 + 1) ELSE CAST(ix // 12 AS VARCHAR) END")
    facts = ("['drift', 'linear', 'log_linear', 'holt', 'seasonal_naive', 'holt_winters'][model + 1] AS method, "
             "CAST(freq AS INTEGER) AS freq, mae AS backtest_mae, fallback, CAST(n AS INTEGER) AS n_obs, "
             "CAST((ix1 - ix0) // (12 // freq) + 1 - n AS INTEGER) AS n_gaps")
    future = f"""
      SELECT c.unit, c.indicator, c.ix1 + h * (12 // c.freq) AS ix, 'forecast' AS kind, c.model, c.freq, c.mae,
             c.fallback, c.n, c.ix0, c.ix1, {z!r} * c.sd * sqrt(h) AS band, CASE c.model
               WHEN 0 THEN c.v[c.n] + coalesce((c.v[c.n] - c.v[1]) / nullif(c.n - 1, 0), 0) * h
               WHEN 1 THEN f.a + f.b * (c.n - 1 + h)
               WHEN 2 THEN exp(f.la + f.lb * (c.n - 1 + h))
               WHEN 3 THEN o.level + o.trend * h
               WHEN 4 THEN c.v[c.n - c.freq + (h - 1) % c.freq + 1] + ((h - 1) // c.freq + 1)
                 * (list_avg(c.v[c.n - c.freq + 1:c.n]) - list_avg(c.v[c.n - 2 * c.freq + 1:c.n - c.freq]))
               ELSE w.level + w.trend * h + w.season[(c.n + h - 1) % c.freq + 1] END AS value
      FROM chosen c CROSS JOIN (SELECT unnest(range(1, {horizon + 1})) AS h)
      JOIN fits f USING (unit, indicator)
      JOIN holt o ON o.unit = c.unit AND o.indicator = c.indicator AND o.t = c.n
      LEFT JOIN hw w ON w.unit = c.unit AND w.indicator = c.indicator AND w.t = c.n"""
    history = """
      UNION ALL
      SELECT s.unit, s.indicator, s.ix, 'history', c.model, c.freq, c.mae, c.fallback, c.n, c.ix0, c.ix1, NULL, s.value
      FROM fser s JOIN chosen c USING (unit, indicator)"""
    return f"""{_PREDICTIONS}
    SELECT unit, indicator, ix / 12.0::DOUBLE AS t, {label} AS period, value, kind, value - band AS lo,
           value + band AS hi, {facts}
    FROM ({future} {history if with_history else ''})"""
