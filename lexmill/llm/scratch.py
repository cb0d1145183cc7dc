"""Shared-folder scratch tables and small helpers that every operator here uses."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor share.

    ``spark.checkpoint.dir`` names it. Where it is unset a local-mode session (tests) gets a
    temporary folder; a cluster session without the setting is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="lexmill-")
        atexit.register(shutil.rmtree, _OWN_DIRS[app], True)
    return f"file://{_OWN_DIRS[app]}"


class Scratch:
    """Written tables of one query run; they cut lineage and survive the loss of executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def write(self, df: DataFrame, label: str) -> DataFrame:
        path = f"{self.root}/{label}"
        schema = df.schema
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, label: str) -> None:
        """Delete a table that no later step reads."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{label}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Word separators of every contract here: space and U+0009 to U+000D.
SEPARATORS = " \t\n\x0b\x0c\r"


def count_chars(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are in ``chars`` (at least two of them)."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def words_of(text: Column) -> Column:
    """Array of the separator-free runs of ``text``; empty for null, empty and blank texts."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SEPARATORS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def holdout_fold(doc_id: Column) -> Column:
    """crc32 of the decimal doc_id modulo 5; fold 0 is held out. A null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5
