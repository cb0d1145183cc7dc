"""Written tables that cut lineage, in the folder that spark.checkpoint.dir names."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame

_own: list[str] = []


def scratch_root(df: DataFrame) -> str:
    spark = df.sparkSession
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="lexmill-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return f"file://{_own[0]}"


def written(df: DataFrame, label: str) -> DataFrame:
    path = f"{scratch_root(df)}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
