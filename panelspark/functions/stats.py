"""Closed-form statistics as Column expressions (no Python workers)."""
from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

# Correlation clamp, normal 97.5% point, smallest p kept when combining.
R_CLAMP = 0.999999999
Z_95 = 1.959964
P_FLOOR = 1e-300


def erf(x: Column) -> Column:
    """Error function from its all-positive series; 1 beyond |x| = 6."""
    a = F.abs(x)
    start = F.struct(a.alias("term"), a.alias("total"))

    def step(acc: Column, k: Column) -> Column:
        term = acc["term"] * (a * a * 2.0 / (k * 2 + 1))
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(119)), start, step, lambda s: s["total"])
    value = F.when(a >= 6.0, F.lit(1.0)).otherwise(
        F.lit(2.0 / math.sqrt(math.pi)) * F.exp(-a * a) * series)
    return F.when(x < 0, -value).otherwise(value)


def normal_two_sided_p(z: Column) -> Column:
    return F.lit(1.0) - erf(F.abs(z) / F.lit(math.sqrt(2.0)))


def fisher_z(r: Column) -> Column:
    clamped = F.least(F.greatest(r, F.lit(-R_CLAMP)), F.lit(R_CLAMP))
    return F.atanh(clamped)


def pearson_stats(r: Column, n: Column) -> Column:
    """Struct(p_value, ci_low, ci_high) by the Fisher z-transform; null if n <= 3."""
    z = fisher_z(r)
    se = F.lit(1.0) / F.sqrt(F.when(n > 3, n - 3).cast("double"))
    return F.struct(
        normal_two_sided_p(z / se).alias("p_value"),
        F.tanh(z - se * Z_95).alias("ci_low"),
        F.tanh(z + se * Z_95).alias("ci_high"))


def correlation(x: str, y: str) -> Column:
    """Pearson r over rows where both are present; null when either is constant."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    sd_x = F.stddev_samp(F.when(both, F.col(x)))
    sd_y = F.stddev_samp(F.when(both, F.col(y)))
    return F.try_divide(F.covar_samp(x, y), F.nullif(sd_x * sd_y, F.lit(0.0)))


def moments(points: Column, fields: dict[str, Callable[[Column], Column]], products: Sequence[tuple[str, str]]) -> Column:
    """Struct of n, the means (m_x) and the sums of products of deviations (s_x_y) over an array's points.

    One fold, updated point by point so that nothing cancels and a constant side has exactly no deviation;
    points that lack a field are passed over. fields gives each from a point.
    """
    start = F.struct(F.lit(0.0).alias("n"), *[F.lit(0.0).alias(f"m_{f}") for f in fields],
                     *[F.lit(0.0).alias(f"s_{x}_{y}") for x, y in products])

    def step(acc: Column, p: Column) -> Column:
        n = acc["n"] + 1.0
        off = {f: get(p) - acc[f"m_{f}"] for f, get in fields.items()}
        new = F.struct(n.alias("n"), *[(acc[f"m_{f}"] + off[f] / n).alias(f"m_{f}") for f in fields],
                       *[(acc[f"s_{x}_{y}"] + off[x] * off[y] * (acc["n"] / n)).alias(f"s_{x}_{y}") for x, y in products])
        there = reduce(lambda a, b: a & b, [get(p).isNotNull() for get in fields.values()])
        return F.when(there, new).otherwise(acc)

    return F.aggregate(points, start, step)


def moment_correlation(m: Column, x: str, y: str) -> Column:
    """Pearson r from moments(); null when either side is constant."""
    return F.try_divide(m[f"s_{x}_{y}"], F.nullif(F.sqrt(m[f"s_{x}_{x}"]) * F.sqrt(m[f"s_{y}_{y}"]), F.lit(0.0)))


def t_two_sided_p(t: Column, df: Column) -> Column:
    """Two-sided Student-t p-value for a whole number of degrees of freedom.

    Near the centre the finite cosine series is exact; in the tail it would
    cancel, so there the incomplete-beta power series (all terms positive) is
    used instead. Small p-values stay accurate, which matters when they are
    combined on a log scale.
    """
    t = F.abs(t)
    v = df.cast("double")
    x = v / (v + t * t)
    half = (v / 2.0)

    # beta(v/2, 1/2) by recurrence from beta(1/2,1/2)=pi or beta(1,1/2)=2
    odd = F.pmod(df, F.lit(2)) == 1
    steps = F.floor((df - 1) / 2).cast("int")
    a0 = F.when(odd, F.lit(0.5)).otherwise(F.lit(1.0))
    beta = F.aggregate(
        F.when(steps >= 1, F.sequence(F.lit(0), steps - 1)).otherwise(F.array().cast("array<int>")),
        F.when(odd, F.lit(math.pi)).otherwise(F.lit(2.0)),
        lambda acc, i: acc * (a0 + i) / (a0 + i + 0.5))

    def tail_step(acc: Column, n: Column) -> Column:
        term = acc["term"] * x * (half + 0.5 + n) / (half + 1.0 + n)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    one = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
    tail_sum = F.aggregate(F.sequence(F.lit(0), F.lit(220)), one, tail_step, lambda s: s["total"])
    tail = F.exp(half * F.ln(x) + F.ln(F.lit(1.0) - x) * 0.5) / (half * beta) * tail_sum

    theta = F.atan(t / F.sqrt(v))
    cos2 = F.cos(theta) * F.cos(theta)
    odd_terms = F.floor((df - 1) / 2).cast("int")
    even_terms = F.floor(df / 2).cast("int")

    def odd_step(acc: Column, k: Column) -> Column:
        term = F.when(k == 1, F.cos(theta)).otherwise(acc["term"] * cos2 * (k * 2 - 2) / (k * 2 - 1))
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    def even_step(acc: Column, k: Column) -> Column:
        term = F.when(k == 1, F.lit(1.0)).otherwise(acc["term"] * cos2 * (k * 2 - 3) / (k * 2 - 2))
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    zero = F.struct(F.lit(0.0).alias("term"), F.lit(0.0).alias("total"))

    def run(count: Column, step) -> Column:
        span = F.when(count >= 1, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(span, zero, step, lambda s: s["total"])

    inner_odd = (theta + F.sin(theta) * run(odd_terms, odd_step)) * (2.0 / math.pi)
    inner_even = F.sin(theta) * run(even_terms, even_step)
    centre = F.lit(1.0) - F.when(odd, inner_odd).otherwise(inner_even)
    return F.when(df >= 1, F.when(t == 0, F.lit(1.0)).when(x <= 0.8, tail).otherwise(centre))


def f1_p(f: Column, df: Column) -> Column:
    """Upper p-value of F(1, df)."""
    return t_two_sided_p(F.sqrt(f), df)


def chi2_even_sf(x: Column, half_df: Column) -> Column:
    """Chi-square survival for 2*half_df degrees of freedom: a finite Poisson sum, in logs.

    Only terms near the largest one count: those within twelve standard deviations, so the
    work grows with the square root of the degrees of freedom.
    """
    y = x / 2.0
    reach = F.sqrt(y) * 12.0 + 40.0
    high = F.least((half_df - 1).cast("double"), F.ceil(y + reach).cast("double"))
    below = F.floor(F.least(high, y) - reach)
    low = F.when(below >= 20, below).otherwise(0).cast("double")
    # ln(low!) by Stirling's series, to 1e-13 from 20 on
    log_factorial = (low * F.ln(low) - low + F.ln(low * (2 * math.pi)) / 2.0
                     + 1.0 / (low * 12.0) - 1.0 / (low * low * low * 360.0))
    first = -y + F.when(low > 0, low * F.ln(y) - log_factorial).otherwise(0.0)

    def step(acc: Column, i: Column) -> Column:
        log_term = acc["log_term"] + F.ln(y) - F.ln(i.cast("double"))
        return F.struct(log_term.alias("log_term"), (acc["total"] + F.exp(log_term)).alias("total"))

    start = F.struct(first.alias("log_term"), F.exp(first).alias("total"))
    span = F.when(high > low, F.sequence((low + 1).cast("int"), high.cast("int"))).otherwise(
        F.array().cast("array<int>"))
    total = F.aggregate(span, start, step, lambda s: s["total"])
    return F.when(half_df >= 1, F.when(y <= 0, F.lit(1.0)).otherwise(F.least(total, F.lit(1.0))))
