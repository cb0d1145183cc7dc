"""Incremental folder runs: every file once, again only if it changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# States of a file, in order.
STATES = ("pending", "text_done", "vocab_done", "grammar_done", "failed")
#: The states by how much of a file is done.
PROGRESS = ("pending", "failed", "text_done", "vocab_done", "grammar_done")
FILES = "path string, modificationTime timestamp, length long, content binary"


def file_key(path: Column, modified: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", path, modified.cast("string")), 256), 1, 16)


def ingest(spark: SparkSession, folder: str, checkpoint: str, handle: Callable[[DataFrame, int], None], glob: str = "*") -> int:
    """Runs ``handle(batch, id)`` over files that no earlier run saw; returns the number of batches.

    The streaming checkpoint makes a file's batch repeat after a failure, so handle must be idempotent,
    for instance by ``new_files`` against what it wrote.
    """
    seen = []
    stream = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)

    def each(batch: DataFrame, number: int) -> None:
        seen.append(number)
        handle(batch, number)

    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(seen)


def new_files(files: DataFrame, manifest: DataFrame, key: str = "path") -> DataFrame:
    """Files whose key the manifest lacks, or has with another modification time."""
    known = manifest.select(F.col(key).alias("__k"), F.col("modified").alias("__m"))
    return files.join(known, (F.col(key) == F.col("__k")) & (F.col("modified") == F.col("__m")), "left_anti")


def refresh_manifest(files: DataFrame, manifest: DataFrame, key: str = "path") -> DataFrame:
    """(path, modified, status, and the key): one row a present file, reset to pending where the file changed.

    The key names a file in both tables, where paths repeat. Of several entries with the file's key and
    modification time the one furthest on counts.
    """
    furthest = F.max_by("status", F.array_position(F.array(*map(F.lit, PROGRESS)), F.col("status")))
    old = manifest.groupBy(F.col(key).alias("__k"), F.col("modified").alias("__m")).agg(F.lit(True).alias("__same"), furthest.alias("__s"))
    joined = files.join(old, (F.col(key) == F.col("__k")) & (F.col("modified") == F.col("__m")), "left")
    return joined.select(*dict.fromkeys((key, "path", "modified")), F.when(F.col("__same"), F.col("__s")).otherwise(F.lit(STATES[0])).alias("status"))


def is_done(status: Column, mode: str) -> Column:
    """Whether a file's state ends a run of the mode: vocab, grammar or all."""
    ends = {"vocab": ("vocab_done", "grammar_done"), "grammar": ("grammar_done",), "all": ("grammar_done",)}
    return status.isin(*ends[mode])


def run_complete(manifest: DataFrame, mode: str) -> DataFrame:
    """One row: whether all files are done (false without files), and how many can be resumed."""
    return manifest.agg(F.coalesce(F.bool_and(is_done(F.col("status"), mode)), F.lit(False)).alias("complete"), F.count_if(~is_done(F.col("status"), mode)).alias("resumable"))


def pending_chunks(chunks: DataFrame, cache: DataFrame, kind: str) -> DataFrame:
    """Chunks (file_key, chunk) without a cached answer of a kind."""
    done = cache.filter(F.col("kind") == kind).select("file_key", "chunk").distinct()
    return chunks.join(done, ["file_key", "chunk"], "left_anti")
