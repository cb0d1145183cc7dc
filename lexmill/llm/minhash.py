"""Near-duplicate detection with min-max hashing.

Each of ``HASHES`` linear permutations of a text's shingle hashes yields two signature values, its
minimum and its maximum, so a signature of 2 * HASHES values costs HASHES evaluations. As many keys of
``ROWS`` values each put texts into buckets as a pair at the threshold needs to share one: it shares
none with probability under ``MISS``. Pairs that meet are compared by their signatures first; a pair
at the threshold agrees in too few values with probability under ``MISS`` as well. All links are
confirmed on the full sets.

No bucket's pairs are emitted. Equal sets count as one text first. Then

1. each bucket compares its members with one of them, the one that meets most others over all its
   buckets, so groups of copies of one text become one component at linear cost;
2. buckets that still hold several components compare the members outside their largest component
   with all members, by signatures, in blocks. What may have a link is compared on full sets, again
   in blocks of bounded size and skipping pairs known to be connected; blocks that hold one and the
   same component never meet. A bucket of one large component and a few strays costs linear time.

Defined results: a text without words (or null) has an empty set and is linked with nothing. Rows
without doc_id take no part: their component is null and they are kept. Rows that repeat a doc_id
stay separate rows of that id and share its component. Columns besides doc_id and text are not read;
names that begin with two underscores are taken.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.components import components
from lexmill.llm.scratch import Scratch
from lexmill.llm.shingles import mix, overlap, set_name, shingle_sets, slices

ROWS = 5
#: Bound of the probability that a pair at the threshold shares no bucket, and that its signatures agree too little.
MISS = 5e-7
#: Linked: 100 * intersection >= PERCENT * union, if the caller names no other threshold.
PERCENT = 85
#: Parts that the members of one center are dealt to; each reads the center's text first.
CENTER_PARTS = 4096
#: Members in a block of signatures (outside the largest component, and of it), and shingles in a block of texts.
STRAY_BLOCK, SIGN_BLOCK, TEXT_BLOCK = 1024, 8192, 400_000
#: A set with more than one in so many of all rows is joined apart from the others; there are fewer of them than this.
HOT_SHARE = 1000

_U = np.uint64

SIGNED = "doc_id long, n_shingles long, name binary, keys array<long>, sign binary"


@dataclass(frozen=True)
class Plan:
    """Signature sizes that follow from a threshold."""

    percent: int = PERCENT

    @cached_property
    def bands(self) -> int:
        return math.ceil(math.log(MISS) / math.log1p(-((self.percent / 100) ** ROWS)))

    @cached_property
    def hashes(self) -> int:
        return -(-self.bands * ROWS // 2)

    @cached_property
    def least_agree(self) -> int:
        """Values that must agree: fewer do at the threshold with probability under MISS.

        Minimum and maximum of a permutation are no less reliable together than two draws of their own, so
        the binomial bounds them.
        """
        n, p, below = 2 * self.hashes, self.percent / 100, 0.0
        for k in range(n):
            below += math.comb(n, k) * p**k * (1 - p) ** (n - k)
            if below >= MISS:
                return k
        return n

    def sizes_fit(self, a: Column, b: Column) -> Column:
        """Sets whose sizes alone rule out a link don't pass."""
        return F.least(a, b) * 100 >= F.greatest(a, b) * self.percent

    def linked(self, n_a: int, n_b: int, common: int) -> bool:
        return 100 * common >= self.percent * (n_a + n_b - common)


def signatures(sets: list[np.ndarray], hashes: int) -> np.ndarray:
    """Minimum and maximum of each permutation, side by side, for each non-empty set."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    a, b = mix(np.arange(1, hashes + 1, dtype=_U)) | _U(1), mix(np.arange(1001, hashes + 1001, dtype=_U))
    out = np.empty((len(sets), 2 * hashes), dtype=_U)
    for k in range(hashes):
        value = flat * a[k] + b[k]
        out[:, 2 * k] = np.minimum.reduceat(value, starts)
        out[:, 2 * k + 1] = np.maximum.reduceat(value, starts)
    return out


def band_keys(sign: np.ndarray, bands: int) -> np.ndarray:
    used = sign[:, : bands * ROWS].reshape(len(sign), bands, ROWS)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=_U), used.shape[:2])
    for r in range(ROWS):
        key = mix(key * _U(0x9E3779B97F4A7C15) + used[:, :, r])
    return key.astype(np.int64)


def _sign(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for first, texts in slices(batch.column(1).to_pylist()):
            sets = shingle_sets(texts)
            full = [i for i, s in enumerate(sets) if len(s)]
            keys: list = [[]] * len(sets)
            signs: list = [None] * len(sets)
            if full:
                sign = signatures([sets[i] for i in full], plan.hashes)
                small = (mix(sign) >> _U(56)).astype(np.uint8)
                for i, k, s in zip(full, band_keys(sign, plan.bands), small, strict=True):
                    keys[i], signs[i] = k, s.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(first, len(texts)), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_name(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())), pa.array(signs, pa.binary()),
                ],
                ["doc_id", "n_shingles", "name", "keys", "sign"],
            )


def _agreeing(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) whose signatures agree often enough."""
    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(batch.column(n).to_pylist()), np.uint8).reshape(-1, 2 * plan.hashes) for n in ("sign_a", "sign_b"))
            keep = pa.array((x == y).sum(1) >= plan.least_agree)
            yield batch.select(["a", "b"]).filter(keep)


def _against_center(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    """Confirmed links (a, b) from sorted rows (a, part, member, text); the center's own row comes first."""
    center, own, in_head = None, [], False
    for batch in batches:
        heads, members = batch.column("a").to_pylist(), batch.column("member").to_pylist()
        found = []
        for first, texts in slices(batch.column("text").to_pylist()):
            for i, s in enumerate(shingle_sets(texts), first):
                if members[i] is None:  # rows that repeat the center's id come with its other texts
                    center, own = heads[i], [*(own if center == heads[i] and in_head else []), s]
                    in_head = True
                else:
                    in_head = False
                    if any(plan.linked(len(o), len(s), overlap(o, s)) for o in own):
                        found.append((center, members[i]))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[dict[str, list]]:
    """Columns of each run of rows with equal keys."""
    held: dict[str, list] = {}
    now = None
    for batch in batches:
        cols = {n: batch.column(n).to_pylist() for n in batch.schema.names}
        for i, key in enumerate(zip(*(cols[k] for k in keys), strict=True)):
            if key != now:
                if now is not None:
                    yield held
                now, held = key, {n: [] for n in cols}
            for n in cols:
                held[n].append(cols[n][i])
    if now is not None:
        yield held


def text_blocks(sizes: np.ndarray) -> np.ndarray:
    """Block of each of a row of texts: TEXT_BLOCK shingles a block, or one longer text."""
    out, block, held = np.zeros(len(sizes), dtype=np.int64), 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > TEXT_BLOCK:
            block, held = block + 1, 0
        out[i] = block
        held += n
    return out


def _may_link(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    """Members of a pair of a bucket's blocks that may have a link across components, as rows of a pair of text blocks."""
    for g in _groups(batches, ("key", "low", "high")):
        sign = np.frombuffer(b"".join(g["sign"]), np.uint8).reshape(-1, 2 * plan.hashes)
        n, comp, ids, own = np.array(g["n_shingles"]), np.array(g["component"]), np.array(g["id"]), np.array(g["own"])
        order = np.argsort(own, kind="stable")
        sign, n, comp, ids, own = sign[order], n[order], comp[order], ids[order], own[order]
        hit = np.zeros(len(ids), dtype=bool)
        first = int((own == own[0]).sum())
        for i in range(first):
            rest = slice(i + 1 if g["low"][0] == g["high"][0] else first, len(ids))
            fit = (comp[rest] != comp[i]) & (100 * np.minimum(n[rest], n[i]) >= plan.percent * np.maximum(n[rest], n[i]))
            at = np.flatnonzero(fit) + rest.start
            if len(at):
                at = at[(sign[at] == sign[i]).sum(1) >= plan.least_agree]
                if len(at):
                    hit[i] = True
                    hit[at] = True
        if not hit.any():
            continue
        ids, comp, n = ids[hit], comp[hit], n[hit]
        # the most frequent component comes last; blocks wholly of one component need not meet
        kinds, inverse, counts = np.unique(comp, return_inverse=True, return_counts=True)
        order = np.lexsort((ids, comp, counts[inverse]))
        ids, comp, n = ids[order], comp[order], n[order]
        block = text_blocks(n)
        spans = [(comp[block == k].min(), comp[block == k].max()) for k in range(int(block[-1]) + 1)]
        name = set_name(np.sort(ids).astype(_U))
        rows: list[tuple] = []
        kinds = (pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        made = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["grp", "x", "y", "id", "component"])  # noqa: B023, E731
        for x in range(len(spans)):
            for y in range(x, len(spans)):
                low, high = min(spans[x][0], spans[y][0]), max(spans[x][1], spans[y][1])
                if low == high or (x == y and len(spans) > 1):  # with others, a block's own pairs are compared there
                    continue
                inside = np.flatnonzero((block == x) | (block == y))
                rows += [(name, x, y, i, c) for i, c in zip(ids[inside].tolist(), comp[inside].tolist(), strict=True)]
                if len(rows) > 50_000:
                    yield made()
                    rows.clear()
        if rows:
            yield made()


def _across(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    """A spanning set of the links between components, from the sets of one pair of text blocks at a time."""
    now, ids, comps, sets = None, [], [], []

    def links() -> Iterator[pa.RecordBatch]:
        root = {c: c for c in comps}

        def top(c):
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        found = []
        order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
        for p, i in enumerate(order):
            for j in order[p + 1 :]:
                if 100 * len(sets[i]) < plan.percent * len(sets[j]):
                    break
                a, b = top(comps[i]), top(comps[j])
                if a != b and plan.linked(len(sets[i]), len(sets[j]), overlap(sets[i], sets[j])):
                    root[max(a, b)] = min(a, b)
                    found.append((ids[i], ids[j]))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

    for batch in batches:
        cols = [batch.column(n).to_pylist() for n in ("grp", "x", "y", "id", "component")]
        for first, texts in slices(batch.column("text").to_pylist()):
            for i, own in enumerate(shingle_sets(texts), first):
                key = (cols[0][i], cols[1][i], cols[2][i])
                if key != now:
                    yield from links()
                    now, ids, comps, sets = key, [], [], []
                ids.append(cols[3][i])
                comps.append(cols[4][i])
                sets.append(own)
    yield from links()


def _with_class(rows: DataFrame, of_set: DataFrame, total: int) -> DataFrame:
    """``rows`` with a name, joined with the one row of ``of_set`` that each name has.

    Names with a large share of all rows, HOT_SHARE at most, are broadcast, so no task gathers one of them.
    """
    limit = max(1, total // HOT_SHARE)
    hot = F.col("n_rows") > limit
    slim = [c for c in of_set.columns if c != "n_rows"]
    often = F.broadcast(of_set.filter(hot).select(*[F.col(c).alias("__name" if c == "name" else c) for c in slim]))
    seldom = of_set.filter(~hot).select(*[F.col(c).alias("__name" if c == "name" else f"__{c}") for c in slim])
    more = [c for c in slim if c != "name"]
    found = rows.join(often, F.col("name") == F.col("__name"), "left").withColumn("__hot", F.col("__name").isNotNull()).drop("__name")
    left, right = found.filter("__hot").drop("__hot"), found.filter("NOT __hot").drop("__hot", *more)
    right = right.join(seldom, F.col("name") == F.col("__name")).drop("__name")
    return left.unionByName(right.withColumnsRenamed({f"__{c}": c for c in more}))


def near_duplicates(docs: DataFrame, scratch: Scratch, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    plan = Plan(percent)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    signed = scratch.write(texts.mapInArrow(lambda batches: _sign(batches, plan), SIGNED), "signed")
    real = signed.filter("doc_id IS NOT NULL AND name IS NOT NULL")
    total = real.count()
    classes = scratch.write(real.groupBy("name").agg(F.min("doc_id").alias("id"), F.count("*").alias("n_rows")), "classes")
    # one row for each different set; ids decide, so a set with very many copies is no hot key
    reps = real.select(F.col("doc_id").alias("id"), "n_shingles", "name", "keys", "sign").join(classes.select("id", "name"), ["id", "name"], "left_semi")
    reps = scratch.write(reps.dropDuplicates(["id", "name"]), "reps")
    # an id may stand for several sets if rows repeat it; they are linked by that id anyhow
    slim = reps.select("id", "n_shingles", "sign")

    rows = reps.select("id", F.explode("keys").alias("key"))
    full = rows.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    rows = scratch.write(rows.join(full, "key"), "rows")
    degree = rows.groupBy("id").agg(F.sum("members").alias("degree"))
    ranked = rows.join(degree, "id").select("key", F.struct((F.col("degree") * F.lit(-1)).alias("order"), "id").alias("rank"))
    # a minimum combines before the shuffle, so a bucket of very many members is no hot key here
    centers = ranked.groupBy("key").agg(F.min("rank").alias("rank")).select("key", F.col("rank.id").alias("a"))
    pairs = rows.join(centers, "key").filter("a <> id").select("a", F.col("id").alias("b")).distinct()
    left = slim.select(F.col("id").alias("a"), F.col("n_shingles").alias("n_a"), F.col("sign").alias("sign_a"))
    right = slim.select(F.col("id").alias("b"), F.col("n_shingles").alias("n_b"), F.col("sign").alias("sign_b"))
    close = pairs.join(right, "b").join(left, "a").filter(plan.sizes_fit(F.col("n_a"), F.col("n_b"))).select("a", "b", "sign_a", "sign_b")
    close = scratch.write(close.mapInArrow(lambda batches: _agreeing(batches, plan), "a long, b long"), "close")
    # the center's text goes to each part of its members
    asked = close.select("a", F.pmod(F.xxhash64("b"), F.lit(CENTER_PARTS)).cast("int").alias("part"), "b")
    wanted = asked.select("a", "part", F.col("b").alias("member"), F.col("b").alias("doc_id")).unionByName(
        asked.select("a", "part").distinct().select("a", "part", F.lit(None).cast("bigint").alias("member"), F.col("a").alias("doc_id"))
    )
    # the texts are dealt by id at any size, so that a larger corpus runs the plan of a smaller one
    wanted = scratch.write(wanted, "wanted")
    sent = texts.hint("merge").join(wanted, "doc_id").select("a", "part", "member", "text").repartition("a", "part").sortWithinPartitions("a", "part", F.col("member").asc_nulls_first())
    links = scratch.write(sent.mapInArrow(lambda batches: _against_center(batches, plan), "a long, b long"), "links")
    first = scratch.write(components(links, scratch, "first"), "first")

    placed = rows.join(first, "id", "left").select("key", "id", "members", F.coalesce("component", "id").alias("component"))
    placed = scratch.write(placed.filter("members > 2"), "placed")
    # of each bucket with several components: the largest one, and how many members there are in it and outside
    sizes = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
    bulk = F.max(F.struct("n", (F.col("component") * F.lit(-1)).alias("c")))
    kinds = sizes.groupBy("key").agg(F.sum("n").alias("all"), bulk.alias("bulk")).filter(F.col("bulk.n") < F.col("all"))
    kinds = kinds.select("key", (-F.col("bulk.c")).alias("bulk"), F.ceil((F.col("all") - F.col("bulk.n")) / STRAY_BLOCK).cast("int").alias("strays"), F.ceil(F.col("bulk.n") / SIGN_BLOCK).cast("int").alias("blocks"))
    spread = placed.join(kinds, "key")
    stray = F.col("component") != F.col("bulk")
    own = F.when(stray, F.pmod(F.xxhash64("id"), F.col("strays"))).otherwise(F.col("strays") + F.pmod(F.xxhash64("id"), F.col("blocks"))).cast("int")
    others = F.when(stray, F.col("strays") + F.col("blocks")).otherwise(F.col("strays")).cast("int")
    spread = spread.select("key", "id", "component", own.alias("own"), F.explode(F.sequence(F.lit(0), others - 1)).alias("other"))
    spread = spread.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "id", "component").join(slim, "id")
    grouped = spread.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "id")
    doubtful = scratch.write(grouped.mapInArrow(lambda batches: _may_link(batches, plan), "grp binary, x int, y int, id long, component long").distinct(), "doubtful")
    meet = texts.withColumnRenamed("doc_id", "id").hint("merge").join(doubtful, "id").repartition("grp", "x", "y").sortWithinPartitions("grp", "x", "y", "id")
    more = scratch.write(meet.select("grp", "x", "y", "id", "component", "text").mapInArrow(lambda batches: _across(batches, plan), "a long, b long"), "more")
    # rows that repeat a doc_id link the sets they have
    several = real.groupBy("doc_id").agg(F.min("name").alias("lo"), F.max("name").alias("hi")).filter("lo <> hi").select(F.col("doc_id").alias("a"))
    several = scratch.write(several, "several")
    own_sets = real.select(F.col("doc_id").alias("a"), "name").join(several, "a", "left_semi").distinct()
    same_id = _with_class(own_sets, classes, total).select("a", F.col("id").alias("b"))
    final = first.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more).unionByName(same_id)
    final = components(final, scratch, "final")

    of_set = scratch.write(classes.join(final, "id", "left").select("name", "n_rows", F.coalesce("component", "id").alias("component")), "of_set")
    alone = signed.filter("doc_id IS NULL OR name IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    found = _with_class(real.select("doc_id", "n_shingles", "name"), of_set, total).select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    return alone.unionByName(found).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_duplicates(docs: DataFrame, scratch: Scratch, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the rows that are not kept, and one row of each doc_id, the least by a hash of its columns.

    The texts are dealt by id at any size; rows without an id are kept and need no dealing.
    """
    judged = scratch.write(near_duplicates(docs, scratch, percent), "judged")
    drop = scratch.write(judged.filter(~F.col("kept")).select(F.col("doc_id").alias("__id")).distinct(), "drop")
    left = docs.filter("doc_id IS NOT NULL").hint("merge").join(drop, F.col("doc_id") == F.col("__id"), "left_anti")
    content = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("__content"))
    one = left.withColumn("__content", content).withColumn("__nth", nth).filter("__nth = 1")
    return one.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.filter("doc_id IS NULL"))
