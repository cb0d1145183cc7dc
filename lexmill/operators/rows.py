"""Order-aware row operators: first-seen distinct, exclusion, resume, last row, rolling limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.sinks.scratch import written


def numbered(df: DataFrame, *order: str, name: str = "ord") -> DataFrame:
    """``df`` with its place in the global order, from 0, as a column.

    Rows are dealt by range and numbered within their range; only one offset a range goes to the
    rest, so no task sees all rows.
    """
    placed = written(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("__range").count().select(F.col("__range").alias("__r"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__offset"))
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    joined = placed.withColumn("__n", within).join(F.broadcast(offsets), F.col("__range") == F.col("__r"))
    return joined.select((F.col("__offset") + F.col("__n")).cast("bigint").alias(name), *[F.col(f"`{c}`") for c in df.columns])


def first_seen(df: DataFrame, key: Column, *order: str) -> DataFrame:
    """The first row of each key by ``order``; one shuffle, with partial aggregation before it."""
    names = df.columns
    picked = df.withColumn("__key", key).groupBy("__key").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in names]), F.struct(*order)).alias("__row"))
    return picked.select(*[F.col(f"__row.`{c}`").alias(c) for c in names])


def exclude(df: DataFrame, known: DataFrame, key: Column, known_key: Column) -> DataFrame:
    """Rows whose key no row of ``known`` has; both sides go through their key expression."""
    other = known.select(known_key.alias("__known")).distinct()
    return df.withColumn("__key", key).join(other, F.col("__key") == F.col("__known"), "left_anti").drop("__key")


def resume(df: DataFrame, done: DataFrame, key: Column, done_key: Column, *order: str) -> DataFrame:
    """What an interrupted run still has to do: unknown keys, each once."""
    return exclude(first_seen(df, key, *order), done, key, done_key)


def append_unseen(new: DataFrame, existing: DataFrame, key: Column, existing_key: Column, *order: str) -> DataFrame:
    """Rows of ``new`` to append to a file that must not repeat a key."""
    return resume(new, existing, key, existing_key, *order)


def last_per(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key group by ``order``."""
    names = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*names), order).alias("__row"))
    return picked.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in names])


def rolling_limits(calls: DataFrame, token_limit: int, request_limit: int, window_s: int = 60, by: list[str] | None = None) -> DataFrame:
    """Per call (ts, tokens): what the last ``window_s`` seconds hold, and the wait the limits ask for.

    A call exactly ``window_s`` old has left the window. A limit of 0 is off. A wait lasts until the
    oldest call leaves, plus half a second. ``by``: keys with windows of their own.
    """
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    frame = Window.partitionBy(*(by or [])).orderBy(us).rangeBetween(-(window_s * 1_000_000 - 1), 0)
    held = calls.withColumns({
        "tokens_60s": F.sum("tokens").over(frame).cast("bigint"),
        "requests_60s": F.count("*").over(frame).cast("bigint"),
        "__oldest": F.min(us).over(frame),
    })
    breached = (F.lit(token_limit > 0) & (F.col("tokens_60s") > token_limit)) | (F.lit(request_limit > 0) & (F.col("requests_60s") >= request_limit))
    wait = F.lit(window_s) - (us - F.col("__oldest")) / 1_000_000 + 0.5
    return held.withColumn("wait_s", F.when(breached, F.greatest(wait, F.lit(0.0))).otherwise(F.lit(0.0))).drop("__oldest")
