import duckdb
import numpy as np
import pytest

from lexmill.llm import queries, topk

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int, id long, v string"


def brute(rows, k=5):
    ok = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for q in {i for i, _ in ok if i % 50 == 0}:
        found = []
        for _, u in [r for r in ok if r[0] == q]:
            found += [(-sum(a * b for a, b in zip(u, v, strict=True)), i) for i, v in ok if i != q and len(v) == len(u)]
        out[q] = [(i, -s) for s, i in sorted(found)[:k]]
    return {q: v for q, v in out.items() if v}


def collected(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert all([x[0] for x in v] == list(range(1, len(v) + 1)) for v in out.values())
    return {q: [x[1:] for x in v] for q, v in out.items()}


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = sorted(con.sql(queries.ORACLE_SQL["op4_topk"]).fetchall())
    got = queries.op4_topk(spark, SF)
    assert got.columns == ["query_id", "rank", "vec_id", "score"] and sorted(map(tuple, got.collect())) == want


def test_awkward_vectors(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=3).astype(float).tolist(), 0, 7, "x") for i in range(1, 130)]
    rows += [(i, [0.5, 0.25, -0.125], 1, 7, "x") for i in range(200, 1500)]  # one very common vector
    rows += [(50, None, 0, 0, ""), (100, [1.0, None, 2.0], 0, 0, ""), (150, [float("nan"), 0.0, 0.0], 0, 0, ""), (3000, [float("inf"), 1.0, 0.0], 0, 0, "")]
    rows += [(2000, [1.0, 2.0], 0, 0, ""), (2001, [1.0, -2.0], 0, 0, ""), (2050, [], 0, 0, ""), (None, [1.0, 1.0, 1.0], 0, 0, ""), (7, rows[6][1], 0, 0, ""), (4000, [0.0, 0.0, 0.0], 0, 0, "")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert collected(queries.op4_topk(spark, str(tmp_path))) == brute(rows)


@pytest.mark.parametrize("big", [1.0, 2.0**14, 2.0**19, 2.0**22])
def test_search_equals_brute_force(big, monkeypatch):
    monkeypatch.setattr(topk, "GROUP", 400)
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(size=(1500, 16)) * 100 * big)
    x[500:900] = x[500]
    x[900:950] = x[900] + rng.integers(-1, 2, size=(50, 16))  # scores that differ in their last bits only
    ids = rng.permutation(1500).astype(np.int64) * 5
    q, qids = np.vstack([x[::37], x[900:904]]), np.r_[ids[::37], ids[900:904]]
    row, found, score = topk.search(qids, q, ids, x, 5)
    for i in [*range(8), *range(len(q) - 4, len(q))]:
        want = sorted((-sum(int(a) * int(b) for a, b in zip(q[i], v, strict=True)), int(c)) for c, v in zip(ids, x, strict=True) if c != qids[i])[:5]
        assert [(-int(s), int(c)) for r, c, s in zip(row, found, score, strict=True) if r == i] == want


def test_many_blocks_and_runs(spark, tmp_path, monkeypatch):
    for name, size in (("GROUP", 64), ("QUERIES", 4), ("SLICE", 3), ("GROUPS_PER_TASK", 2)):
        monkeypatch.setattr(topk, name, size)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=4 if i % 9 else 6).astype(float).tolist(), 0, 7, "x") for i in range(1, 1200)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert collected(queries.op4_topk(spark, str(tmp_path))) == brute(rows)


def test_share_of_entries_read():
    """Random directions leave half of the entries to read at best; clustered ones let whole groups be passed over."""
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(size=(16_384, 64)) * 32)
    block = topk.Search(np.arange(100, dtype=np.int64), x[:100], 5)
    for at in range(0, len(x), topk.GROUP):
        block.meet(np.arange(at, at + topk.GROUP), x[at : at + topk.GROUP])
    assert block.read < 0.8 * block.met
    centers = rng.normal(size=(8, 64)) * 300
    near = np.floor(np.repeat(centers, topk.GROUP, axis=0) + rng.normal(size=(8 * topk.GROUP, 64)) * 10)
    block = topk.Search(np.arange(100, dtype=np.int64), near[:100], 5)
    for at in range(0, len(near), topk.GROUP):
        block.meet(np.arange(at, at + topk.GROUP), near[at : at + topk.GROUP])
    assert block.read < 0.2 * block.met


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert queries.op4_topk(spark, str(tmp_path)).count() == 0
