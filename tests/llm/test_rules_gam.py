import bisect
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import DOC_SCHEMA, awkward_rows, write_docs
from pyspark.sql import functions as F

from lexmill.llm import gam, queries, rules
from lexmill.llm.scratch import Scratch
from lexmill.llm.textstats import text_stats

SF = "/root/testdata/sf0.01"


def brute(text):
    text = text or ""
    words = text.encode().split()
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return {
        "n_words": len(words),
        "word_chars": sum(len(w.decode()) for w in words),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }


ROWS = [
    *awkward_rows(),
    (20, "a b c a b c\n\na b c\na b c\n \n", "en", "a"),
    (21, "x x x x x", "en", "a"),
    (22, "a b c d a b c d a b", "en", "a"),
    (23, "##|| <b> $5 %& \x85 　 end", "en", "a"),
]


def test_statistics(spark, tmp_path):
    folder = write_docs(spark, tmp_path, ROWS)
    got = text_stats(spark.read.parquet(f"{folder}/documents.parquet")).collect()
    texts = {i: t for i, t, _, _ in ROWS}
    assert len(got) == len(ROWS)
    for r in got:
        assert {k: r[k] for k in brute("")} == brute(texts[r.doc_id])


def test_statistics_on_a_real_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in text_stats(docs).collect():
        assert {k: r[k] for k in brute("")} == brute(texts[r.doc_id])


def test_rules_drop_junk_and_keep_clean(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    judged, found = rules.judge(docs, labels, Scratch(spark, "t"))
    assert 1 <= len(found) <= rules.MAX_RULES and all(len(r.conditions) <= rules.MAX_CONDITIONS for r in found)
    rows = judged.join(labels, "doc_id").collect()
    clean = [r for r in rows if r.quality == 1 and not r.base_failed]
    junk = [r for r in rows if r.quality == 0]
    assert np.mean([r.kept for r in clean]) > 0.98
    assert np.mean([not r.kept for r in junk]) > 0.85


def plain_rules(rows, cuts):
    """Sequential covering over single rows (grows, quality, measures), without cells or arrays."""
    names, found = list(cuts), []
    tests = [(n, above, t) for n in names for t in cuts[n] for above in (True, False)]
    holds = lambda r, c: (r[2][c[0]] > c[2]) == c[1]
    count = lambda rows, grows, q: sum(r[0] == grows and r[1] == q for r in rows)
    while len(found) < rules.MAX_RULES and count(rows, True, 0) >= rules.LEAST_COVER:
        chosen, covered = [], rows
        while len(chosen) < rules.MAX_CONDITIONS and count(covered, True, 1):
            low, high, best = count(covered, True, 0), count(covered, True, 1), None
            for c in tests:
                kept = [r for r in covered if holds(r, c)]
                p, n = count(kept, True, 0), count(kept, True, 1)
                gain = p * (math.log2(p / (p + n)) - math.log2(low / (low + high))) if p else -1.0
                if best is None or round(gain, 9) > best[0]:
                    best = (round(gain, 9), c, gain)
            if best[2] <= 0:
                break
            chosen.append(best[1])
            covered = [r for r in covered if holds(r, best[1])]
        if not chosen:
            break

        def worth(conditions, rows=rows):
            kept = [r for r in rows if all(holds(r, c) for c in conditions)]
            p, n = count(kept, False, 0), count(kept, False, 1)
            return ((p - n) / (p + n), p) if p + n else (-1.0, 0)

        while len(chosen) > 1 and worth(chosen[:-1]) >= worth(chosen):
            chosen.pop()
        if (worth(chosen)[0] + 1) / 2 < rules.LEAST_PRECISION:
            break
        found.append(chosen)
        rows = [r for r in rows if not all(holds(r, c) for c in chosen)]
    return found


def test_verdict_equals_plain_covering(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    judged, found = rules.judge(docs, labels, Scratch(spark, "t"))
    stats = text_stats(docs).withColumns(rules.ratios()).withColumn("grows", F.xxhash64("doc_id", F.lit("half")) % 2 == 0)
    rows = {r.doc_id: r for r in stats.collect()}
    marks = [(r.doc_id, r.quality) for r in labels.collect()]
    labelled = stats.join(labels.filter("quality IN (0, 1)"), "doc_id")
    cuts = rules.thresholds(labelled.select("doc_id", "quality", *rules.ratios()))
    want = plain_rules([(rows[i].grows, q, rows[i]) for i, q in marks if i in rows and q in (0, 1)], cuts)
    assert want and [[(c.measure, c.above, c.threshold) for c in r.conditions] for r in found] == [[(n, a, t) for n, a, t in r] for r in want]
    for r in judged.collect():
        hit = any(all((rows[r.doc_id][n] > t) == above for n, above, t in rule) for rule in want)
        assert r.kept == (not r.base_failed and not hit)


def test_rules_query_without_labels_and_empty(spark, tmp_path):
    folder = write_docs(spark, tmp_path, ROWS)
    spark.createDataFrame([(1, None, 0), (999, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = queries.op2_rules(spark, folder).collect()
    assert len(out) == len(ROWS)
    for r in out:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and r.kept == (not r.base_failed)
    assert len(queries.op6_gam(spark, folder).collect()) == len(ROWS)
    spark.createDataFrame([], DOC_SCHEMA).write.parquet(f"{tmp_path}/e/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/e/labels.parquet")
    assert queries.op2_rules(spark, f"{tmp_path}/e").count() == queries.op6_gam(spark, f"{tmp_path}/e").count() == 0


def test_gam_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = gam.fit(x[:3000], y[:3000])
    assert (0, 1) in [(i, j) for i, j, _ in model.pairs]
    assert np.mean((model.score(x[3000:]) > 0.5) == y[3000:]) > 0.85


def plain_gam(x, y, model):
    """The boosting of lookup tables by plain loops, over the given bin edges."""
    n, raw = len(y), [model.bias] * len(y)
    bins = lambda edges: [[bisect.bisect_left(list(edges[j]), x[i][j]) for i in range(n)] for j in range(len(edges))]
    slope = lambda: [(y[i] - 1 / (1 + math.exp(-raw[i])), math.exp(-raw[i]) / (1 + math.exp(-raw[i])) ** 2) for i in range(n)]

    def sums(at, size):
        g, h = [0.0] * size, [0.0] * size
        for k, (a, b) in zip(at, slope(), strict=True):
            g[k] += a
            h[k] += b
        return g, h

    def tree(g, h):
        parts = [(0, len(g))]
        gain = lambda a, b: sum(g[a:b]) ** 2 / (sum(h[a:b]) + gam.L2)
        while len(parts) < gam.LEAVES:
            best = max(((gain(a, m) + gain(m, b) - gain(a, b), k, m) for k, (a, b) in enumerate(parts) for m in range(a + 1, b)), default=(0.0, 0, 0))
            if best[0] <= 1e-9:
                break
            a, b = parts.pop(best[1])
            parts += [(a, best[2]), (best[2], b)]
        out = [0.0] * len(g)
        for a, b in parts:
            for k in range(a, b):
                out[k] = sum(g[a:b]) / (sum(h[a:b]) + gam.L2)
        return out

    one, tables = bins(model.edges), [[0.0] * (len(e) + 1) for e in model.edges]
    for _ in range(gam.ROUNDS):
        for j, at in enumerate(one):
            step = tree(*sums(at, len(tables[j])))
            for k, v in enumerate(step):
                tables[j][k] += gam.RATE * v
            for i in range(n):
                raw[i] += gam.RATE * step[at[i]]
    two, pairs = bins(model.pair_edges), {}
    sizes = [len(e) + 1 for e in model.pair_edges]
    for i, j, _ in model.pairs:
        pairs[i, j] = [0.0] * (sizes[i] * sizes[j])
    for _ in range(gam.PAIR_ROUNDS):
        for (i, j), table in pairs.items():
            at = [two[i][r] * sizes[j] + two[j][r] for r in range(n)]
            g, h = sums(at, len(table))
            for k in range(len(table)):
                table[k] += gam.RATE * g[k] / (h[k] + gam.L2)
            for r in range(n):
                raw[r] += gam.RATE * g[at[r]] / (h[at[r]] + gam.L2)
    return tables, pairs, [1 / (1 + math.exp(-v)) for v in raw]


def test_gam_tables_equal_plain_boosting(monkeypatch):
    monkeypatch.setattr(gam, "ROUNDS", 12)
    monkeypatch.setattr(gam, "PAIR_ROUNDS", 6)
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(160, 4)), 1)  # ties in every measure
    y = ((x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=160) * 0.5) > 0).astype(float)
    model = gam.fit(x, y)
    tables, pairs, score = plain_gam(x.tolist(), y.tolist(), model)
    assert len(pairs) == gam.PAIRS
    for a, b in zip(model.tables, tables, strict=True):
        assert np.allclose(a, b)
    for i, j, t in model.pairs:
        assert np.allclose(t.ravel(), pairs[i, j])
    assert np.allclose(model.score(x), score)


def test_extra_columns_repeats_and_long_texts(spark, tmp_path):
    long = "word other third " * 60_000
    rows = [*ROWS, (30, long, "en", "a"), (30, long, "en", "a")]
    docs = spark.read.parquet(write_docs(spark, tmp_path, rows) + "/documents.parquet").selectExpr("*", "1 AS n_words", "2 AS kept", "3 AS quality", "0.5D AS score", "'x' AS h")
    labels = spark.createDataFrame([(30, 0, 1, 2), (23, 1, 0, 2), (23, 1, 0, 2)], "doc_id long, quality int, toxic int, n_words int")
    judged, _ = rules.judge(docs, labels, Scratch(spark, "t"))
    assert Counter(r.doc_id for r in judged.collect()) == Counter(i for i, *_ in rows)
    for r in judged.filter("doc_id = 30").collect():
        assert (r.n_words, r.n_repeat_words, r.base_failed) == (180_000, 180_000, True)
    scored = gam.classify(docs, labels, Scratch(spark, "t")).collect()
    assert Counter(r.doc_id for r in scored) == Counter(i for i, *_ in rows) and all(0 <= r.score <= 1 for r in scored)


def test_gam_held_out(spark):
    out = {r.doc_id: r for r in queries.op6_gam(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    for i, r in out.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(out[x.doc_id].score, x.quality) for x in labels if out[x.doc_id].held_out]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    assert np.mean([[(a > b) + 0.5 * (a == b) for b in bad] for a in good]) > 0.95
    assert np.mean([s >= 0.3 for s in good]) > 0.97


def test_gam_constant_labels():
    model = gam.fit(np.zeros((3, 2)), np.ones(3))
    assert model.score(np.zeros((2, 2))) == pytest.approx([0.875, 0.875])
