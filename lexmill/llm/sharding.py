"""Sharding by jump consistent hashing: a stable key and the shard count decide the shard.

No ring table exists: the hash walks forward through ever rarer jumps, driven by a 64-bit linear
congruential generator seeded with the key. Adding a shard moves rows only into the new one.

The 64-bit products are taken in 16-bit halves of the multiplier, so that nothing overflows under
ANSI arithmetic. Everything is a DataFrame expression.

Defined results: a null key hashes as 0 in a key of its own group; a null text has size 16 and
CRC 0. Equal keys share a shard and still get a slot of their own each. An empty table gives no rows.
Rows equal in all three measures take slots in any order. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Multiplier of the published generator, and 2^31.
MULTIPLIER = 2862933555777941757
TWO_31 = 2147483648.0

_LOW32 = 0xFFFFFFFF
#: Bytes that a stored row costs besides its text.
ROW_BYTES = 16
#: Rows of a shard are numbered in this many salted runs, so no task holds a whole shard.
SLOT_RUNS = 64


def _low32_product(x: Column, by: int) -> Column:
    """``x * by`` modulo 2^32 for 32-bit ``x`` and ``by``."""
    low, high = by & 0xFFFF, by >> 16
    return (x * F.lit(low) + F.shiftleft((x * F.lit(high)).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(_LOW32))


def _advance(state: Column) -> Column:
    """The generator's next state; a state is two 32-bit halves held in longs."""
    a_low, a_high = MULTIPLIER & _LOW32, MULTIPLIER >> 32
    low, high = state["low"], state["high"]
    p0, p1 = low * F.lit(a_low & 0xFFFF), low * F.lit(a_low >> 16)
    bottom = p0 + F.shiftleft(p1.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    top = F.shiftright(bottom, 32) + F.shiftright(p1, 16) + _low32_product(high, a_low) + _low32_product(low, a_high)
    next_low, next_high = bottom.bitwiseAND(F.lit(_LOW32)), top.bitwiseAND(F.lit(_LOW32))
    jump = (state["next"] + F.lit(1)).cast("double") * (F.lit(TWO_31) / (F.shiftright(next_high, 1) + F.lit(1)).cast("double"))
    return F.struct(state["next"].alias("at"), jump.cast("bigint").alias("next"), next_low.alias("low"), next_high.alias("high"))


def jump_walk(key: Column, shards: int) -> Column:
    """Struct (at, next): the shard among ``shards``, and the first jump target beyond them.

    Every jump goes at least one shard forward, so ``shards`` steps always suffice.
    """
    key = F.coalesce(key.cast("bigint"), F.lit(0).cast("bigint"))
    zero = F.lit(0).cast("bigint")
    start = F.struct(
        F.lit(-1).cast("bigint").alias("at"), zero.alias("next"),
        key.bitwiseAND(F.lit(_LOW32)).alias("low"), F.shiftright(key, 32).bitwiseAND(F.lit(_LOW32)).alias("high"),
    )
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(shards)), start,
        lambda state, _: F.when(state["next"] < F.lit(shards), _advance(state)).otherwise(state),
        lambda state: F.struct(state["at"].alias("at"), state["next"].alias("next")),
    )


def jump_hash(key: Column, shards: int) -> Column:
    return jump_walk(key, shards)["at"]


def shard_by_key(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's size, CRC, shard, slot within the shard, and shard after one more is added.

    Slots are gapless from 0: a first pass, over the keys alone, counts the rows of each shard's
    salted runs; the runs' offsets (``shards * SLOT_RUNS`` rows at most) are broadcast to the second.
    """
    from pyspark.sql import Window

    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    walk = jump_walk(F.col("doc_id"), shards)
    salt = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % SLOT_RUNS).cast("int")
    run = ["shard", "__run"]
    keyed = docs.select(F.col(f"`{key}`").alias("doc_id"))
    counts = keyed.select(walk["at"].cast("int").alias("shard"), salt.alias("__run")).groupBy(*run).agg(F.count("*").alias("__n"))
    before = Window.partitionBy("shard").orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*run, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    rows = (
        docs.select(F.col(f"`{key}`").alias("doc_id"), (F.octet_length(body) + F.lit(ROW_BYTES)).cast("bigint").alias("size"), F.crc32(body).alias("text_crc32"))
        .withColumn("__walk", walk)
        .select(
            "doc_id", "size", "text_crc32", F.col("__walk.at").cast("int").alias("shard"),
            F.when(F.col("__walk.next") == shards, F.lit(shards)).otherwise(F.col("__walk.at")).cast("int").alias("grown_shard"),
            salt.alias("__run"),
        )
    )
    within = Window.partitionBy(*run).orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("__nth", F.row_number().over(within))
    return numbered.join(F.broadcast(offsets), run).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("__before") + F.col("__nth") - 1).cast("bigint").alias("slot"), "grown_shard",
    )
