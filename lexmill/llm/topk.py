"""Exact top-k inner products by no-random-access aggregation over sorted lists.

Candidates are packed into groups and queries into blocks. A task holds one block and reads a few
groups after it. Each group has one sorted list per component. Lists are read in step from their
favourable end: the high end where the query's component is positive, the low end where it is
negative. The entries read so far give each candidate's partial score; what stands next in each list
bounds its unread components from above, and the list's far end bounds them from below. A group whose
list heads alone bound it under a query's k-th best lower bound, carried over from the groups before,
is not read for that query; else reading stops when few candidates remain whose upper bound reaches
it, and their scores are resolved exactly. Bounds are matrix products of floating-point numbers,
widened by the most that rounding can change, so one path serves all magnitudes.

Every block meets every group, since each query is asked of all rows: packed rows go to the tasks of
their (block, run of groups) by a salted shuffle, and no task holds more than one block and one group.

Defined results: null vectors and those with a null or non-finite component take no part; vectors
meet only queries of the same length. Rows that share a query's id are its own and no candidates
of it; a repeated query id is searched once per row and its results merge into one list, in which
repeated candidate rows count one by one. Scores beyond 64 bits raise an error. Other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.scratch import Scratch

#: Candidates of a packed group, queries of a packed block and of a slice, and groups that one task reads on average.
GROUP, QUERIES, SLICE, GROUPS_PER_TASK = 4096, 32_768, 256, 8
#: Reading stops when this share of a group's pairs, at most, can still qualify.
FEW = 0.03
#: Entries of each list, as shares of it, after which the bounds are compared.
DEPTHS = (0.375, 0.5, 0.625, 0.75, 1.0)
PACKED = "dim int, kind string, ids binary, vals binary"


def scaled(embedding: Column, scale: int = 256) -> Column:
    """scale * x of each component as doubles, or null where a component is unusable; packing takes their floor."""
    usable = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    floats = F.transform(embedding, lambda x: F.lit(float(scale)) * x.cast("double"))
    return F.when(embedding.isNotNull() & usable, floats)


def _packer(rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def flush(dim: int, every: bool) -> Iterator[pa.RecordBatch]:
            ids = np.concatenate([a for a, _ in waiting[dim]])
            vals = np.concatenate([b for _, b in waiting[dim]])
            end = len(ids) if every else len(ids) // rows * rows
            for at in range(0, end, rows):
                v = vals[at : min(at + rows, end)]
                most = np.abs(v).max(initial=0)
                kind = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<f8"
                cells = [[dim], [kind], [ids[at : min(at + rows, end)].astype("<i8").tobytes()], [v.astype(kind).tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.int32(), pa.string(), pa.binary(), pa.binary()), strict=True)], ["dim", "kind", "ids", "vals"])
            waiting[dim] = [(ids[end:], vals[end:])]

        for batch in batches:
            ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = np.floor(lists.flatten().to_numpy(zero_copy_only=False))
            starts = np.r_[0, np.cumsum(sizes)[:-1]]
            for dim in np.unique(sizes).tolist():
                mine = np.flatnonzero(sizes == dim)
                waiting.setdefault(dim, []).append((ids[mine], flat[starts[mine][:, None] + np.arange(dim)]))
                if sum(len(a) for a, _ in waiting[dim]) >= rows:
                    yield from flush(dim, every=False)
        for dim in list(waiting):
            yield from flush(dim, every=True)

    return run


def pack(vectors: DataFrame, rows: int) -> DataFrame:
    """Rows of up to ``rows`` vectors of one length: their ids and components as arrays of bytes."""
    return vectors.mapInArrow(_packer(rows), PACKED)


def unpack(dim: int, kind: str, ids: bytes, vals: bytes) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, "<i8")
    return own, np.frombuffer(vals, kind).reshape(len(own), dim)


class Lists:
    """The sorted lists of one group of candidates."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x.astype(np.float64)
        self.largest = float(np.abs(self.x).max(initial=0))
        order = np.argsort(-self.x, axis=0, kind="stable")
        self.down = np.take_along_axis(self.x, order, axis=0)
        self.place = np.empty(order.shape, dtype=np.int32)
        np.put_along_axis(self.place, order, np.arange(len(ids), dtype=np.int32)[:, None] * np.ones_like(order, dtype=np.int32), axis=0)

    def slack(self, q: np.ndarray) -> np.ndarray:
        """Most that rounding can change a bound of each query: 0 where all sums are whole numbers under 2^53."""
        size = self.largest * np.abs(q).sum(1)
        return np.where(2 * size < 2.0**53, 0.0, size * (4 * q.shape[1] + 8) * 2.0**-52)

    def heads(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Upper bound of all candidates' scores with each query, from the heads of the lists."""
        return high @ self.down[0] + low @ self.down[-1] if self.x.shape[1] else np.zeros(len(high))

    def bounds(self, high: np.ndarray, low: np.ndarray, depth: int, lower: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """Upper (and lower) bounds of every candidate's score, after ``depth`` entries of each list.

        high, low: the queries' positive and negative components, zero elsewhere.
        """
        n = len(self.ids)
        from_top, from_bottom = self.place < depth, self.place >= n - depth
        seen = np.hstack([self.x * from_top, self.x * from_bottom])
        read = seen @ np.hstack([high, low]).T
        if depth >= n:
            return read, read
        unread = np.hstack([~from_top, ~from_bottom]).astype(np.float64)
        upper = read + unread @ np.hstack([high * self.down[depth], low * self.down[n - 1 - depth]]).T
        return upper, read + unread @ np.hstack([high * self.down[-1], low * self.down[0]]).T if lower else None


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    most = int(np.abs(x).max(initial=0)) * int(np.abs(q).max(initial=0)) * x.shape[1]
    if most < 2**53:
        return np.einsum("ij,ij->i", x.astype(np.float64), q.astype(np.float64)).astype(np.int64)
    return np.array([sum(int(a) * int(b) for a, b in zip(u, v, strict=True)) for u, v in zip(x, q, strict=True)], dtype=np.int64)


class Search:
    """A block of queries that meets groups one after the other and keeps each query's k best."""

    def __init__(self, qids: np.ndarray, q: np.ndarray, k: int):
        self.qids, self.q, self.k = qids, q, k
        self.best = [(np.zeros(0, np.int64),) * 3 for _ in range(0, len(qids), SLICE)]
        self.floor = np.full(len(qids), -np.inf)
        #: List entries read, and those of all groups met.
        self.read, self.met = 0, 0

    def meet(self, ids: np.ndarray, x: np.ndarray) -> None:
        lists, n = Lists(ids, x), len(ids)
        for s, at in enumerate(range(0, len(self.qids), SLICE)):
            part = slice(at, at + SLICE)
            own, q = self.qids[part], self.q[part].astype(np.float64)
            high, low, slack = np.maximum(q, 0), np.minimum(q, 0), lists.slack(q)
            self.met += n * q.size
            asks = np.flatnonzero(lists.heads(high, low) + slack >= self.floor[part])
            if not len(asks):
                continue
            own, high, low, slack, floor = own[asks], high[asks], low[asks], slack[asks], self.floor[part][asks]
            mine = ids[:, None] == own[None, :]
            for share in DEPTHS:
                depth = n if share == 1.0 else max(1, int(n * share))
                know = bool(np.isinf(floor).any())
                upper, lower = lists.bounds(high, low, depth, lower=know)
                level = floor
                if know and n > self.k:
                    level = np.maximum(floor, np.partition(np.where(mine, -np.inf, lower - slack), n - self.k, axis=0)[n - self.k])
                open_ = (upper + slack >= level) & ~mine
                if depth == n or open_.sum() <= FEW * open_.size:
                    break
            self.read += depth * high.size
            cand, row = np.nonzero(open_)
            scores = exact(x[cand], self.q[part][asks][row])
            row = asks[row]
            best = self.best[s]
            best = self.best[s] = best_of(np.r_[best[0], row], np.r_[best[1], ids[cand]], np.r_[best[2], scores], self.k)
            counts = np.bincount(best[0], minlength=len(self.qids[part]))
            last, full = np.cumsum(counts) - 1, counts == self.k
            # a score is at least its floating-point value less the rounding of one conversion
            kth = best[2][last[full]].astype(np.float64)
            self.floor[part][full] = np.where(np.abs(kth) < 2.0**53, kth, np.nextafter(kth, -np.inf))

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, id, score) of the best."""
        parts = [(row + s * SLICE, ids, score) for s, (row, ids, score) in enumerate(self.best)]
        return tuple(np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3


def search(qids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of each query as (query row, id, score), ties to smaller ids."""
    block = Search(qids, q, k)
    for at in range(0, len(ids), GROUP):
        block.meet(ids[at : at + GROUP], x[at : at + GROUP])
    return block.found()


def best_of(row: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -score, row))
    row, ids, score = row[order], ids[order], score[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], ids[keep], score[keep]


def top_k(embeddings: DataFrame, is_query: Column, scratch: Scratch, k: int = 5, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best candidates among all other rows."""
    vectors = embeddings.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), scaled(F.col(f"`{vector}`")).alias("v"), is_query.alias("q")).filter(F.col("v").isNotNull() & F.col("id").isNotNull())
    groups = scratch.write(pack(vectors.select("id", "v"), GROUP).withColumn("name", F.monotonically_increasing_id()), "groups")
    asked = vectors.filter("q").select("id", "v")
    blocks = max(1, -(-asked.count() // QUERIES))
    # as many partitions as blocks, so that blocks are full however the queries lie among the rows
    asked = scratch.write(pack(asked.repartition(blocks, "id"), QUERIES).withColumn("name", F.monotonically_increasing_id()), "asked")
    # how many blocks and runs of groups there are of each length: one row a length
    n_blocks = asked.groupBy("dim").agg(F.collect_list("name").alias("blocks"))
    n_runs = groups.groupBy("dim").agg(F.ceil(F.count("*") / GROUPS_PER_TASK).cast("int").alias("runs"))
    run_of = F.pmod(F.xxhash64("name"), F.col("runs")).cast("int")
    body = ["dim", "kind", "ids", "vals"]
    asks = asked.join(n_runs, "dim").select(F.col("name").alias("block"), F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("run"), F.lit(0).alias("part"), "name", *body)
    gives = groups.join(n_runs, "dim").join(n_blocks, "dim").select(F.explode("blocks").alias("block"), run_of.alias("run"), F.lit(1).alias("part"), "name", *body)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block = None, None

        def done() -> Iterator[pa.RecordBatch]:
            if block is not None:
                row, found, score = block.found()
                yield pa.RecordBatch.from_arrays([pa.array(block.qids[row]), pa.array(found), pa.array(score)], ["query_id", "vec_id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                ids, x = unpack(r["dim"], r["kind"], r["ids"], r["vals"])
                if r["part"] == 0:
                    yield from done()
                    key, block = (r["block"], r["run"]), Search(ids, x, k)
                else:
                    assert key == (r["block"], r["run"])  # the block comes before its groups
                    block.meet(ids, x)
        yield from done()

    # one task for each block and run, so that what a task reads at once is bounded
    tasks = n_blocks.join(n_runs, "dim").agg(F.sum(F.size("blocks") * F.col("runs"))).first()[0] or 1
    met = asks.unionByName(gives).repartition(tasks, "block", "run").sortWithinPartitions("block", "run", "part", "name")
    met = met.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
