"""Quality classifier: a generalised additive model with pairwise interactions.

Measures of a text are binned at quantiles of the training sample. Cyclic boosting visits the
measures in turn; each visit fits a shallow tree on the current residuals' bin sums and adds its
damped leaf values to that measure's lookup table. The pairs whose 2-d bins explain most of what is
left then get tables of their own in the same way. A score is the logistic of a sum of table entries.

Defined results: null, empty and blank texts have all measures 0 and are scored from those bins.
Without training labels of both kinds the score is the share of label 1 (0.5 without labels). A
document labelled twice counts twice; equally good splits take the lowest bin. Columns besides doc_id,
text and quality are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.scratch import Scratch, holdout_fold
from lexmill.llm.textstats import ratios, text_stats

#: The fit uses the labelled rows of the lowest hashes, this many at most.
SAMPLE_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 24, 6, 3
ROUNDS, PAIR_ROUNDS, RATE, LEAVES, L2 = 120, 40, 0.25, 3, 4.0
CUTOFF = 0.3


def measures() -> dict:
    return ratios() | {"log_words": F.log1p(F.col("n_words"))}


class Gam:
    def __init__(self, edges: list[np.ndarray], pair_edges: list[np.ndarray]):
        self.edges, self.pair_edges = edges, pair_edges
        self.bias = 0.0
        self.tables = [np.zeros(len(e) + 1) for e in edges]
        self.pairs: list[tuple[int, int, np.ndarray]] = []

    def bins(self, x: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 by additions of table entries."""
        raw = np.full(len(x), self.bias)
        for table, b in zip(self.tables, self.bins(x, self.edges), strict=True):
            raw += table[b]
        if self.pairs:
            two = self.bins(x, self.pair_edges)
            for i, j, table in self.pairs:
                raw += table[two[i], two[j]]
        return 1.0 / (1.0 + np.exp(-np.clip(raw, -30, 30)))


def _leaf(g: float, h: float) -> float:
    return g / (h + L2)


def _shallow_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf value of each bin, of a tree over ordered bins with LEAVES leaves at most."""
    parts = [(0, len(g))]
    gain = lambda a, b: float(g[a:b].sum()) ** 2 / (float(h[a:b].sum()) + L2)
    while len(parts) < LEAVES:
        best = max(((gain(a, m) + gain(m, b) - gain(a, b), k, m) for k, (a, b) in enumerate(parts) for m in range(a + 1, b)), default=(0.0, 0, 0))
        if best[0] <= 1e-9:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum())
    return out


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    cut = lambda n: [np.unique(np.quantile(x[:, j], np.linspace(0, 1, n + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    model = Gam(cut(BINS), cut(PAIR_BINS))
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    model.bias = math.log(share / (1 - share))
    if len(np.unique(y)) < 2:
        return model
    raw = np.full(len(y), model.bias)
    bins = model.bins(x, model.edges)
    slope = lambda: (lambda p: (y - p, p * (1 - p)))(1 / (1 + np.exp(-raw)))
    for _ in range(ROUNDS):
        for j, b in enumerate(bins):
            g, h = slope()
            n = len(model.tables[j])
            step = RATE * _shallow_tree(np.bincount(b, g, n), np.bincount(b, h, n))
            model.tables[j] += step
            raw += step[b]
    two = model.bins(x, model.pair_edges)
    sizes = [len(e) + 1 for e in model.pair_edges]

    def sums(i, j):
        g, h = slope()
        at, n = two[i] * sizes[j] + two[j], sizes[i] * sizes[j]
        return np.bincount(at, g, n), np.bincount(at, h, n), at

    def strength(pair):
        g, h, _ = sums(*pair)
        return float((g**2 / (h + L2)).sum())

    best = sorted(combinations(range(x.shape[1]), 2), key=lambda p: (-strength(p), p))[:PAIRS]
    grids = {p: np.zeros(sizes[p[0]] * sizes[p[1]]) for p in best}
    for _ in range(PAIR_ROUNDS):
        for p in best:
            g, h, at = sums(*p)
            step = RATE * g / (h + L2)
            grids[p] += step
            raw += step[at]
    model.pairs = [(i, j, t.reshape(sizes[i], sizes[j])) for (i, j), t in grids.items()]
    return model


def train(stats: DataFrame, labels: DataFrame, scratch: Scratch) -> Gam:
    """Fit on the labelled rows outside the held-out fold, SAMPLE_ROWS of them at most, by hash of the id.

    Hashes are uniform, so a level that follows from the count leaves little more than the sample to
    collect, whatever the number of partitions.
    """
    names = list(measures())
    marks = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter(F.col("quality").isin(0, 1) & (holdout_fold(F.col("doc_id")) != 0))
    chosen = stats.join(marks, "doc_id").select(F.xxhash64("doc_id", F.lit("fit")).alias("__h"), "doc_id", "quality", *[F.col(n).cast("double").alias(n) for n in names])
    chosen = scratch.write(chosen, "chosen")
    share = (SAMPLE_ROWS + 6 * SAMPLE_ROWS**0.5) / max(1, chosen.count())
    level = 2**63 - 1 if share >= 1 else int(-(2**63) + share * (2**64 - 1))
    rows = sorted(chosen.filter(F.col("__h") <= F.lit(level)).collect(), key=tuple)[:SAMPLE_ROWS]
    scratch.drop("chosen")
    x = np.array([[r[n] for n in names] for r in rows], dtype=float).reshape(-1, len(names))
    return fit(x, np.array([r["quality"] for r in rows], dtype=float))


def classify(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    # measures come from the written counts, so that no count is taken twice
    stats = scratch.write(text_stats(docs), "stats").withColumns(measures())
    model, names = train(stats, labels, scratch), list(measures())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names]).astype(float)
            score = model.score(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= CUTOFF).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    ready = stats.select("doc_id", (holdout_fold(F.col("doc_id")) == 0).alias("held_out"), *[F.col(n).cast("double").alias(n) for n in names])
    return ready.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
