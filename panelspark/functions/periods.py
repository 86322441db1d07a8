"""Period arithmetic. A period is three ints: year, quarter, month, with 0
meaning "not applicable": annual (y,0,0), quarterly (y,q,0), monthly (y,0,m)."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed format: YYYY, YYYY-Qn or YYYY-MM. Weekly and daily periods are refused.
PERIOD_PATTERN = r"^([0-9]{4})(?:-(?:Q([1-4])|(0[1-9]|1[0-2])))?$"


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def period_label(year="year", quarter="quarter", month="month") -> Column:
    y, q, m = _c(year), _c(quarter), _c(month)
    return (F.when(m > 0, F.concat_ws("-", y.cast("string"), F.lpad(m.cast("string"), 2, "0")))
            .when(q > 0, F.concat(y.cast("string"), F.lit("-Q"), q.cast("string")))
            .otherwise(y.cast("string")))


def decimal_year(year="year", quarter="quarter", month="month") -> Column:
    """Period start as a decimal year."""
    y, q, m = _c(year), _c(quarter), _c(month)
    start = (F.when(m > 0, (m - 1) / F.lit(12.0)).when(q > 0, (q - 1) / F.lit(4.0))
             .otherwise(F.lit(0.0)))
    return y.cast("double") + start


def period_ix(year="year", quarter="quarter", month="month") -> Column:
    """Months since year 0 at the period start: stepping is integer arithmetic."""
    y, q, m = _c(year), _c(quarter), _c(month)
    return (y * 12 + F.when(m > 0, m - 1).when(q > 0, (q - 1) * 3).otherwise(F.lit(0))).cast("int")


def mid_tick(year="year", quarter="quarter", month="month") -> Column:
    """Period midpoint in half-months since year 0, so that window edges compare exactly."""
    y, q, m = _c(year), _c(quarter), _c(month)
    return (y * 24 + F.when(m > 0, m * 2 - 1).when(q > 0, q * 6 - 3).otherwise(F.lit(12))).cast("int")


def label_from_ix(ix: str | Column, freq: str | Column) -> Column:
    """Label of the period that starts at month index ``ix``; ``freq`` is 1, 4 or 12."""
    ix, freq = _c(ix), _c(freq)
    year = F.floor(ix / 12).cast("int")
    month0 = F.pmod(ix, F.lit(12)).cast("int")
    quarter = F.when(freq == 4, F.floor(month0 / 3).cast("int") + 1).otherwise(F.lit(0))
    month = F.when(freq == 12, month0 + 1).otherwise(F.lit(0))
    return period_label(year, quarter, month)


def parse_period(text: str | Column) -> Column:
    """Struct(year, quarter, month), or null if the text is no supported period."""
    clean = F.regexp_replace(_c(text), r"^\s+|\s+$", "")

    def part(i: int) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(clean, PERIOD_PATTERN, i), F.lit("")).cast("int"), F.lit(0))

    return F.when(clean.rlike(PERIOD_PATTERN),
                  F.struct(part(1).alias("year"), part(2).alias("quarter"), part(3).alias("month")))
