"""Quality rules: a decision list learned by sequential covering from labelled statistics.

All labelled rows are counted into joint cells of binned measures: at most ``BINS ** 6`` cells,
whatever the number of rows. A rule for low quality grows on one half of the labelled rows by adding
the threshold condition of the highest information gain, is pruned on the other half from its last
condition on, and is kept while it is precise enough there; what it covers leaves, and the next one
grows. The list becomes one ordered CASE expression. Only DataFrame operations touch the rows.

Defined results: null, empty and blank texts have all measures 0. Labels other than 0 and 1, and
labels of unknown documents, are not used; a document labelled twice counts twice. Without labels of
both kinds the list is empty and the verdict is to keep. Of equally good conditions the first measure,
"above" and the lowest threshold win. Columns besides doc_id, text and quality are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.scratch import Scratch
from lexmill.llm.textstats import BASE, ratios, text_stats

BINS = 8
MAX_RULES = 12
MAX_CONDITIONS = 3
#: A rule is kept if so large a share of what it covers, of the pruning half, is of low quality.
LEAST_PRECISION = 0.9
#: Fewer rows of low quality than this, in the growing half, are no reason for a rule.
LEAST_COVER = 5


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.measure)
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.measure} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def column(self) -> Column:
        out = self.conditions[0].column()
        for c in self.conditions[1:]:
            out = out & c.column()
        return out

    def __str__(self) -> str:
        return " AND ".join(map(str, self.conditions))


def verdict(rules: list[Rule]) -> Column:
    """Keep or not, by the first rule that holds."""
    out = None
    for rule in rules:
        out = F.when(rule.column(), False) if out is None else out.when(rule.column(), False)
    return F.lit(True) if out is None else out.otherwise(True)


def thresholds(labelled: DataFrame) -> dict[str, list[float]]:
    """At most BINS - 1 thresholds a measure: quantiles of either label, and what lies between them."""
    names = list(ratios())
    good, bad = F.col("quality") == 1, F.col("quality") == 0
    row = labelled.agg(
        *[F.percentile_approx(F.when(good, F.col(n)), [0.005, 0.5, 0.995], 10000).alias(f"g_{n}") for n in names],
        *[F.percentile_approx(F.when(bad, F.col(n)), [0.1, 0.5, 0.9], 10000).alias(f"b_{n}") for n in names],
    ).first()
    out = {}
    for n in names:
        g, b = row[f"g_{n}"], row[f"b_{n}"]
        if not g or not b:
            return {}
        out[n] = sorted({*g, *b, (g[2] + b[0]) / 2 if g[2] < b[0] else (g[0] + b[2]) / 2})[: BINS - 1]
    return out


def cells(labelled: DataFrame, cuts: dict[str, list[float]]) -> list[tuple[tuple[int, ...], list[int]]]:
    """Counts (grow low, grow high, prune low, prune high) of each occupied cell of bins."""
    bins = [sum(((F.col(n) > F.lit(t)).cast("int") for t in cut), F.lit(0)) for n, cut in cuts.items()]
    code = F.lit(0)
    for b in bins:
        code = code * BINS + b
    half = F.xxhash64("doc_id", F.lit("half")) % 2 == 0
    count = lambda mine, q: F.sum((mine & (F.col("quality") == q)).cast("bigint"))
    rows = labelled.groupBy(code.alias("code")).agg(count(half, 0), count(half, 1), count(~half, 0), count(~half, 1)).collect()
    found = []
    for code_, *counts in rows:
        at = []
        for _ in cuts:
            code_, b = divmod(code_, BINS)
            at.append(b)
        found.append((tuple(reversed(at)), counts))
    return sorted(found)


def learn(labelled: DataFrame) -> list[Rule]:
    """The decision list for rows of doc_id, quality and the measures of ``ratios``."""
    cuts = thresholds(labelled)
    found = cells(labelled, cuts) if cuts else []
    if not found:
        return []
    names = list(cuts)
    bins = np.array([at for at, _ in found], dtype=np.int64).reshape(-1, len(names))
    counts = np.array([n for _, n in found], dtype=np.int64).reshape(-1, 4)
    every = [(k, above, t) for k, n in enumerate(names) for t in range(len(cuts[n])) for above in (True, False)]
    holds = lambda rows, c: (bins[rows, c[0]] > c[2]) == c[1]
    total = lambda rows, k: int(counts[rows, k].sum())
    left = np.arange(len(found))
    rules: list[Rule] = []
    while len(rules) < MAX_RULES and total(left, 0) >= LEAST_COVER:
        chosen: list[tuple[int, bool, int]] = []
        covered = left
        while len(chosen) < MAX_CONDITIONS and total(covered, 1):
            low, high = total(covered, 0), total(covered, 1)
            base = math.log2(low / (low + high))

            def gain(c, covered=covered, base=base):
                kept = covered[holds(covered, c)]
                p, n = total(kept, 0), total(kept, 1)
                return p * (math.log2(p / (p + n)) - base) if p else -1.0

            best = max(every, key=lambda c: (round(gain(c), 9), -c[0], c[1], -c[2]))
            if gain(best) <= 0:
                break
            chosen.append(best)
            covered = covered[holds(covered, best)]
        if not chosen:
            break

        def under(conditions, left=left):
            for c in conditions:
                left = left[holds(left, c)]
            return left

        def worth(conditions):
            kept = under(conditions)
            p, n = total(kept, 2), total(kept, 3)
            return ((p - n) / (p + n), p) if p + n else (-1.0, 0)

        while len(chosen) > 1 and worth(chosen[:-1]) >= worth(chosen):
            chosen.pop()
        if (worth(chosen)[0] + 1) / 2 < LEAST_PRECISION:
            break
        rules.append(Rule(tuple(Condition(names[k], above, cuts[names[k]][t]) for k, above, t in chosen)))
        left = np.setdiff1d(left, under(chosen))
    return rules


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> tuple[DataFrame, list[Rule]]:
    """Statistics, base rules and verdict of every document, and the learned list."""
    stats = scratch.write(text_stats(docs), "stats").withColumns(ratios())
    marks = labels.select("doc_id", F.col("quality")).filter(F.col("quality").isin(0, 1))
    labelled = scratch.write(stats.join(marks, "doc_id").select("doc_id", "quality", *ratios()), "labelled")
    rules = learn(labelled)
    scratch.drop("labelled")
    judged = stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))
    return judged.select("doc_id", *BASE, "base_failed", "kept"), rules
