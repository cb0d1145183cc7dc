"""Registry of queries over the provided tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.strings import IDEOGRAPH, TOKEN_CJK, WS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir); @WS, @CJK and @HANJA in the SQL stand for character classes."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql.replace("@WS", WS).replace("@CJK", TOKEN_CJK).replace("@HANJA", IDEOGRAPH)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return found.select(*columns) if columns else found


def pick(values, by: Column) -> Column:
    """The value at a 0-based place."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (by + 1).cast("int"))


def pick_sql(values, by: str) -> str:
    """The same in SQL; values are texts, numbers, truth values or lists of texts."""

    def literal(v) -> str:
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return f"[{', '.join(map(literal, v))}]::VARCHAR[]" if isinstance(v, list) else str(v)

    return f"[{', '.join(map(literal, values))}][CAST({by} + 1 AS INTEGER)]"
