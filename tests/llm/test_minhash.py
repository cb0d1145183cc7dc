import random
from collections import Counter, defaultdict

import numpy as np
from helpers import DOC_SCHEMA, awkward_rows, write_docs

from lexmill.llm import components, minhash, queries, shingles
from lexmill.llm.scratch import Scratch

SF = "/root/testdata/sf0.01"


def plain_set(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows, percent=85):
    """Component of each id by comparing all sets that share a shingle."""
    sets = [(i, plain_set(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    def join(i, j):
        a, b = top(i), top(j)
        root[max(a, b)] = min(a, b)

    first, has = {}, defaultdict(list)
    unique = []
    for i, s in sets:
        if s and s in first:
            join(i, first[s])
        elif s:
            first[s] = i
            unique.append((i, s))
    for k, (_, s) in enumerate(unique):
        for x in s:
            has[x].append(k)
    for k, (i, s) in enumerate(unique):
        common = Counter(j for x in s for j in has[x] if j > k)
        for j, c in common.items():
            if 100 * c >= percent * (len(s) + len(unique[j][1]) - c):
                join(i, unique[j][0])
    return {i: top(i) for i, _ in sets}, {i: len(s) for i, s in sets}


def check(spark, folder, rows, percent=85):
    want, sizes = brute([r for r in rows if r[0] is not None], percent)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = queries.op7_minhash(spark, folder).collect() if percent == 85 else minhash.near_duplicates(docs, Scratch(spark, "t"), percent).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, _ in rows)
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (sizes[r.doc_id], want[r.doc_id], r.doc_id == want[r.doc_id])
    return want


def test_query_on_a_real_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = check(spark, SF, rows)
    assert sum(i != c for i, c in want.items()) > 20


def planted(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(60)]
    rows, base = [], [word() for _ in range(150)]
    for i in range(150):  # copies of one text that differ from it in a few words; some miss the threshold
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = word()
        rows.append(" ".join(w))
    for i in range(120):  # a passage that many texts share
        rows.append(" ".join([*(word() for _ in range(rng.randrange(5, 60))), *passage, *(word() for _ in range(rng.randrange(5, 60)))]))
    chain = [word() for _ in range(100)]  # links that only a chain gives
    for i in range(12):
        rows.append(" ".join(chain[i * 2 : 76 + i * 2]))
    rows += [rows[0]] * 200
    rng.shuffle(rows)
    return rows


def test_planted_groups(spark, tmp_path):
    rows = [(i * 3, t, "en", "a") for i, t in enumerate(planted(1))]
    folder = write_docs(spark, tmp_path, rows)
    want = check(spark, folder, [(i, t) for i, t, *_ in rows])
    assert max(Counter(want.values()).values()) > 250


def test_large_buckets_in_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(minhash, "SIGN_BLOCK", 16)
    monkeypatch.setattr(minhash, "STRAY_BLOCK", 4)
    monkeypatch.setattr(minhash, "TEXT_BLOCK", 1000)
    monkeypatch.setattr(minhash, "CENTER_PARTS", 8)
    rows = [(i, t, "en", "a") for i, t in enumerate(planted(2))]
    check(spark, write_docs(spark, tmp_path, rows), [(i, t) for i, t, *_ in rows])


def test_other_thresholds(spark, tmp_path):
    rows = [(i * 3, t, "en", "a") for i, t in enumerate(planted(6))]
    folder = write_docs(spark, tmp_path, rows)
    groups = [len(set(check(spark, folder, [(i, t) for i, t, *_ in rows], percent).values())) for percent in (70, 80, 90)]
    assert groups[0] < groups[1] < groups[2]


def test_plan_bounds():
    import math

    for percent in (70, 80, 85, 95):
        plan, p = minhash.Plan(percent), percent / 100
        assert (1 - p**minhash.ROWS) ** plan.bands <= minhash.MISS < (1 - p**minhash.ROWS) ** (plan.bands - 1)
        assert 2 * plan.hashes >= plan.bands * minhash.ROWS
        n = 2 * plan.hashes
        assert sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(plan.least_agree)) < minhash.MISS


def test_signatures_of_pairs_at_the_threshold_agree_enough():
    """The binomial bounds min-max agreement: over many pairs at the threshold its spread is no larger."""
    plan, rng, got = minhash.Plan(85), np.random.default_rng(5), []
    for _ in range(300):
        common, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (170, 15, 15))
        sign = minhash.signatures([shingles.mix(np.r_[common, x]) for x in (a, b)], plan.hashes)
        got.append(int((sign[0] == sign[1]).sum()))
    n = 2 * plan.hashes
    assert min(got) >= plan.least_agree and np.var(got) < 1.25 * n * 0.85 * 0.15


def test_one_bucket_of_near_copies_and_strays(spark, tmp_path):
    """Strays near to a large component ask for its texts once, not once for each of its members."""
    from pyspark.sql import functions as F

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base, rows, asked = [word() for _ in range(80)], [], {}
    for n in (400, 1600):
        rows = []
        for _ in range(n):
            w = list(base)
            w[rng.randrange(80)] = word()
            rows.append(" ".join(w))
        stray = list(base)
        for k in (10, 30, 50):
            stray[k] = word()
        rows.append(" ".join(stray))
        scratch = Scratch(spark, "t")
        docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
        minhash.near_duplicates(docs, scratch).select(F.count("*")).collect()
        asked[n] = spark.read.parquet(f"{scratch.root}/doubtful").count()
    assert asked[1600] <= 6 * max(asked[400], 400 * minhash.Plan().bands // 6)


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    texts = [*planted(4)[:30], None, "", "x" * 500, " ", "a b " * 300]
    want = shingles.word_hashes(texts)
    for size in (1, 7, 100, 1000):
        monkeypatch.setattr(shingles, "PIECE_BYTES", size)
        got = shingles.word_hashes(texts)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_one_row_of_each_id_and_extra_columns(spark, tmp_path):
    rows = [(1, "a b c d e f g", "x"), (1, "h i j k l m n", "x"), (1, "h i j k l m n", "x"), (2, "h i j k l m n", "x"), (3, "p q r s t u", "x"), (None, "p q r s t u", "x"), (None, None, "x"), (4, "", "x"), (4, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string").selectExpr("*", "1 AS component_id", "2 AS name", "3 AS id", "map('a', 1) AS m")
    out = minhash.drop_duplicates(docs, Scratch(spark, "t"))
    assert out.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0, r.kept, r.name, r.m["a"]) for r in out.collect()) == [(False, 1, "x", 2, 1), (False, 3, "x", 2, 1), (False, 4, "x", 2, 1), (True, 0, "x", 2, 1), (True, 0, "x", 2, 1)]


def test_awkward(spark, tmp_path):
    rows = [*awkward_rows(), (None, "one", None, None), (20, "ONE", "en", "a"), (21, "a b c", "en", "a"), (22, "A  b\tC", "en", "a"), (23, "É b c", "en", "a"), (24, "é b c", "en", "a")]
    check(spark, write_docs(spark, tmp_path, rows), [(i, t) for i, t, *_ in rows])


def test_empty(spark, tmp_path):
    spark.createDataFrame([], DOC_SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op7_minhash(spark, str(tmp_path)).count() == 0


def test_shingle_sets_equal_plain_sets():
    texts = [t for _, t, _, _ in awkward_rows()] + planted(3)[:40]
    got = shingles.shingle_sets(texts)
    for a, s in zip(texts, got, strict=True):
        assert len(s) == len(plain_set(a))
    for a, s in zip(texts, got, strict=True):
        assert shingles.overlap(s, got[-1]) == len(plain_set(a) & plain_set(texts[-1]))


def test_few_words_alone(spark, tmp_path):
    for n in range(1, 7):
        text = " ".join("abcdef"[:n])
        assert [len(x) for x in shingles.shingle_sets([text])] == [len(plain_set(text))]
        assert shingles.shingle_sets([text])[0].tolist() == shingles.shingle_sets([text, "some other words that follow it"])[0].tolist()
    for n in (2, 3):
        rows = [(1, " ".join("abc"[:n]), "en", "a")]
        check(spark, write_docs(spark, tmp_path / str(n), rows), [(i, t) for i, t, *_ in rows])


def test_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    common, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (600, 200, 200))
    est = []
    for _ in range(30):
        shift = np.uint64(rng.integers(2**40))
        sign = minhash.signatures([shingles.mix(np.r_[common, x] + shift) for x in (a, b)], 64)
        est.append((sign[0] == sign[1]).mean())
    assert abs(np.mean(est) - 0.6) < 0.03


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 90)] + [(3, None), (7, 7)]
    root = {}
    top = lambda i: i if root.setdefault(i, i) == i else top(root[i])
    for a, b in links:
        if b is not None and a != b:
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t"), "c").collect()}
    assert got == {i: top(i) for i in root}
