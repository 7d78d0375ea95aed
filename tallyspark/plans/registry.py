"""Registry of named queries: a Spark callable ``(spark, sf_dir) -> DataFrame`` and,
where the operator is SQL-expressible, the DuckDB oracle text over the same tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from ..session import compiled_rows
from .oracle_ctes import with_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, ctes: tuple[str, ...] = ()):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            compiled_rows(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = with_ctes(sql, *ctes)
        return fn
    return deco


# DuckDB spellings of the expression library (plans only; the library is Spark).
WS = "' ' || chr(9) || chr(10) || chr(13)"


def s_strip(x: str) -> str:
    return f"trim(CAST({x} AS VARCHAR), {WS})"


def s_null_tokens(x: str) -> str:
    return (f"(CASE WHEN lower({s_strip(x)}) IN ('nan','none','null','nat','') THEN NULL "
            f"ELSE {s_strip(x)} END)")


def s_blank(x: str) -> str:
    return f"({s_null_tokens(x)} IS NULL)"


def s_parse_date(x: str) -> str:
    n = s_null_tokens(x)
    fmts = ["%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%d-%m-%Y", "%Y/%m/%d"]
    return "CAST(coalesce(" + ", ".join(f"try_strptime({n}, '{f}')" for f in fmts) + ") AS DATE)"


def s_parse_amount(x: str) -> str:
    return f"TRY_CAST(regexp_replace(CAST({x} AS VARCHAR), '[^0-9.\\-]', '', 'g') AS DECIMAL(18,2))"


def s_num(x: str) -> str:
    return f"TRY_CAST({s_strip(x)} AS DOUBLE)"


def s_pct(n: str, d: str) -> str:
    return f"(CASE WHEN ({d}) > 0 THEN CAST(floor((({n}) * 20000 + ({d})) / (({d}) * 2)) / 100 AS DECIMAL(9,2)) END)"
