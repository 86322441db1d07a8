"""Registered queries: a Spark callable and, where SQL can say it, the same in SQL."""
from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelspark.plans.sql_tables import CTES

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: QueryFn
    sql: str | None


REGISTRY: dict[str, Query] = {}


def rounded(df: DataFrame, columns: list[str], digits: int) -> DataFrame:
    """Round float outputs: sums differ in the last bits with the order of addition.

    Exact halves are nudged up first, since binary noise would send them either way.
    """
    for name in columns:
        df = df.withColumn(name, F.round(F.col(name) + nudge(digits), digits) + F.lit(0.0))
    return df


def nudge(digits: int) -> float:
    return 10.0 ** -(digits + 3)


def with_ctes(body: str) -> str:
    """Prefix the common table expressions a query needs, in definition order."""
    needed: set[str] = set()
    todo = [body]
    while todo:
        text = todo.pop()
        for name, sql in CTES.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                todo.append(sql)
    used = [f"{name} AS ({sql.strip()})" for name, sql in CTES.items() if name in needed]
    recursive = "RECURSIVE " if "WITH RECURSIVE" in body else ""
    body = body.replace("WITH RECURSIVE", "WITH").strip()
    if body.upper().startswith("WITH "):
        used.append(body[5:].strip())
        return f"WITH {recursive}" + ",\n".join(used)
    return ("WITH " + ",\n".join(used) + "\n" if used else "") + body


def register(name: str, sql: str | None = None, floats: str = "", digits: int = 6):
    """Decorator. ``floats`` names the columns rounded on both sides."""
    columns = floats.split()

    def wrap(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(spark, sf_dir), columns, digits)

        text = None
        if sql is not None:
            text = with_ctes(sql)
            if columns:
                swaps = ", ".join(f"round({c} + {nudge(digits)!r}, {digits}) + 0.0 AS {c}" for c in columns)
                text = f"SELECT * REPLACE ({swaps}) FROM (\n{text}\n)"
        REGISTRY[name] = Query(name, run, text)
        return fn

    return wrap
