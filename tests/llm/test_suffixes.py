import hashlib
import random

import numpy as np
import pytest
from helpers import DOC_SCHEMA, awkward_rows, write_docs

from lexmill.llm import queries, suffixes
from lexmill.llm.scratch import Scratch

SF = "/root/testdata/sf0.01"
L = suffixes.LENGTH


def brute(rows):
    """Per doc_id: kept bytes and (n_bytes, n_removed, n_spans); ids are unique here."""
    first, out = {}, {}
    rows = sorted(((i, (t or "").encode()) for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0))
    for i, raw in rows:
        gone = bytearray(len(raw))
        for at in range(len(raw) - L + 1):
            if first.setdefault(raw[at : at + L], (i, at)) != (i, at):
                gone[at : at + L] = b"\1" * L
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept)
    return out


def check(spark, folder, rows):
    want = brute(rows)
    got = queries.op9_suffixes(spark, folder).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i, _ in rows)
    bad = [(r, want[r.doc_id][:3]) for r in got if (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) != want[r.doc_id][:4]]
    assert not bad, bad[:3]
    return want


def test_query_on_a_real_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = check(spark, SF, rows)
    assert sum(w[1] for w in want.values()) > 100_000


def planted(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdeé \n") for _ in range(n))
    passages = [text(n) for n in (99, 100, 101, 130, 300, 1200)]
    out = []
    for _ in range(120):
        parts = [text(rng.randrange(0, 150))]
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            cut = rng.randrange(max(1, len(p) - 95))
            parts += [p[cut:] if rng.random() < 0.5 else p, text(rng.randrange(0, 60))]
        out.append("".join(parts))
    base = text(3000)
    for _ in range(20):
        b = list(base)
        for _ in range(rng.randrange(8)):
            b[rng.randrange(len(b))] = "X"
        out.append("".join(b))
    out += ["a" * 400, "a" * 99, "ab" * 300, "!" * 250 + "\n", "\0" * 150, text(50) * 8]
    rng.shuffle(out)
    return out


def test_planted(spark, tmp_path):
    rows = [(i * 7, t, "en", "a") for i, t in enumerate(planted(1))] + [(None, "a" * 300, None, None)]
    check(spark, write_docs(spark, tmp_path, rows), [(i, t) for i, t, *_ in rows])


def direct(rows):
    """The three steps without Spark, in this process."""
    import pyarrow as pa

    scan = [b for b in suffixes._scan(iter([pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part])], ["a", "b"]) for part in (rows[:60], rows[60:])]))]
    table = pa.Table.from_batches(scan).sort_by([(c, "ascending") for c in ("key", "whole", "doc", "place")])
    resolved = pa.Table.from_batches(list(suffixes._resolve(iter(table.to_batches(max_chunksize=37))))).to_pylist()
    text = {r[0]: (r[1] or "").encode() for r in rows}
    spans = {i: [] for i in text}
    open_, rounds = [], 0
    for r in resolved:
        if r["kind"] == "gone":
            spans[r["doc"]].append(r)
        else:
            asked = pa.table({"doc": [r["doc"]], "text": [text[r["doc"]].decode()], "asked": [[{k: r[k] for k in ("key", "lo", "hi", "offset")}]]})
            open_ += [x for b in suffixes._cut(iter(asked.to_batches())) for x in b.to_pylist()]
    while open_:
        table = pa.Table.from_pylist(sorted(open_, key=lambda r: (r["key"], r["doc"], r["lo"])))
        open_, rounds = [], rounds + 1
        for b in suffixes._sorted_arrays(iter(table.to_batches(max_chunksize=11))):
            for r in b.to_pylist():
                if r["kind"] == "gone":
                    spans[r["doc"]].append(r)
                else:
                    open_.append(r)
    return {i: suffixes.kept_bytes(raw, suffixes.merged(spans[i], len(raw))) for i, raw in text.items()}, rounds


@pytest.mark.parametrize(("seed", "array", "chunk", "splits"), [(5, 2_000_000, 1 << 20, False), (6, 700, 1 << 20, True), (7, 2_000_000, 500, False), (8, 1200, 333, True), (9, 5000, 4000, False), (10, 0, 1 << 20, True)])
def test_steps_equal_brute_force(monkeypatch, seed, array, chunk, splits):
    monkeypatch.setattr(suffixes, "ARRAY_BYTES", array)
    monkeypatch.setattr(suffixes, "CHUNK", chunk)
    rows = [(i * 7, t) for i, t in enumerate(planted(seed))]
    got, rounds = direct(rows)
    want = brute(rows)
    assert {i: want[i][4] for i in got} == got
    assert (rounds > 1) == splits


def test_one_line_in_very_many_texts(monkeypatch):
    """A core that all texts share, with other bytes around it, is split until single windows are left."""
    monkeypatch.setattr(suffixes, "ARRAY_BYTES", 20_000)
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    line = text(96)
    rows = [(i, text(60) + line + text(60)) for i in range(600)] + [(1000 + i, text(30) + "xy" + line + "zz" + text(30)) for i in range(5)]
    got, rounds = direct(rows)
    want = brute(rows)
    assert rounds > 2 and {i: want[i][4] for i in got} == got and sum(want[1000 + i][1] for i in range(5)) >= 400


@pytest.mark.parametrize("depth", [8, 24, 100])
def test_suffix_array(depth):
    rng = random.Random(depth)
    for _ in range(80):
        text = bytes(rng.choice(b"ab!z\xff"[: rng.randrange(1, 6)]) for _ in range(rng.randrange(1, 400)))
        data = np.frombuffer(text, dtype=np.uint8)
        order = suffixes.suffix_array(data, depth)
        some = np.array([rng.random() < 0.3 for _ in text])
        few = suffixes.suffix_array(data, depth, some)
        assert sorted(few.tolist()) == np.flatnonzero(some).tolist()
        few_keys = [text[i : i + depth].ljust(depth, b"\0") for i in few]
        assert few_keys == sorted(few_keys)
        keys = [text[i : i + depth].ljust(depth, b"\0") for i in order]
        assert sorted(order.tolist()) == list(range(len(text))) and keys == sorted(keys)
        got = suffixes.common_prefixes(np.r_[data, np.zeros(1, np.uint8)], order, depth)
        for j in range(1, len(order)):
            a, b = text[order[j] :], text[order[j - 1] :]
            common = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            if common + 8 < min(len(a), len(b)):
                assert min(got[j], depth) == min(common, depth)


def test_awkward_and_repeated_rows(spark, tmp_path):
    long = "the cat sat on the mat " * 3000
    rows = [*awkward_rows(), (50, "x" * 30 + "the same row of text twice " * 4, "en", "a"), (50, "x" * 30 + "the same row of text twice " * 4, "en", "a")]
    got = queries.op9_suffixes(spark, write_docs(spark, tmp_path, rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        assert by.setdefault(r.doc_id, r) == r
    assert by[1].n_bytes == by[2].n_bytes == 0 and by[50].n_removed == brute([(50, rows[-1][1])])[50][1]
    assert by[4].n_removed == brute([(4, long)])[4][1]


def test_deduplicate_keeps_columns(spark, tmp_path):
    rows = [(i, t, "en", "a") for i, t in enumerate(planted(11))]
    docs = spark.read.parquet(write_docs(spark, tmp_path, rows) + "/documents.parquet").selectExpr("*", "7 AS lo", "'k' AS key", "1 AS doc")
    out = suffixes.deduplicate(docs, Scratch(spark, "t"))
    assert out.columns == docs.columns
    want = brute([(i, t) for i, t, *_ in rows])
    for r in out.collect():
        assert r.text == want[r.doc_id][4].decode("utf-8", "ignore") and r.n_chars == len(r.text) and (r.lo, r.key) == (7, "k")


def check_rows(spark, folder, rows):
    """Against brute force over documents numbered in their order; rows without an id, and different texts of one id, are apart."""
    hashes = [r.h for r in spark.createDataFrame([(k, t or "") for k, (_, t) in enumerate(rows)], "k long, t string").selectExpr("k", "xxhash64(t) AS h").orderBy("k").collect()]
    order = [(i is None, i or 0, h, k if i is None else 0) for k, ((i, _), h) in enumerate(zip(rows, hashes, strict=True))]
    number = {key: n for n, key in enumerate(sorted(set(order)))}
    want = brute([(number[key], t) for key, (_, t) in zip(order, rows, strict=True)])
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op9_suffixes(spark, folder).collect()]
    assert sorted(got, key=repr) == sorted(((i, *want[number[key]][:4]) for key, (i, _) in zip(order, rows, strict=True)), key=repr)


def test_rows_that_share_an_id_lose_only_their_own_repeats(spark, tmp_path):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, other = text(200), text(200)
    clean = {None: text(700), 60: text(700)}
    rows = [(None, passage + text(50) + passage), (None, clean[None]), (60, other + text(50) + other), (60, clean[60]), *[(None, "z" * 20 + passage[::-1])] * 3]
    folder = write_docs(spark, tmp_path, [(i, t, "en", "a") for i, t in rows])
    check_rows(spark, folder, rows)
    got = queries.op9_suffixes(spark, folder).collect()
    whole = [(r.doc_id, r.kept_sha256) for r in got if not r.n_removed]
    assert all((i, hashlib.sha256(t.encode()).hexdigest()) in whole for i, t in clean.items())
    assert sorted(r.n_removed for r in got if r.n_bytes == 220) == [0, 220, 220]


def test_planted_with_null_and_repeated_ids(spark, tmp_path):
    texts = planted(12)
    rows = [(None if k % 3 == 0 else k // 4 - 9, t) for k, t in enumerate(texts)] + [(None, texts[1])] * 4 + [(7, texts[2])] * 2
    check_rows(spark, write_docs(spark, tmp_path, [(i, t, "en", "a") for i, t in rows]), rows)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], DOC_SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op9_suffixes(spark, str(tmp_path)).count() == 0
