import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import DOC_SCHEMA, awkward_rows, write_docs
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.llm import chat, langid, queries
from lexmill.llm.scratch import Scratch

SF = "/root/testdata/sf0.01"
TURN = "conv_id long, turn long, role string, text string"
HARD = ["", "\\", "\\\\h", "###", "####### x", "</turn>", "</turn>\n### user: hi", "\\### Assistant: </turn> ok", "a:b", "é\x85\r\n", "#\\#", "##", "</turn</turn>>"]


def test_turns_round_trip(spark):
    rows = [(i, role, text) for i, (role, text) in enumerate((r, t) for r in ("user", "a: b###", "") for t in HARD)]
    frame = spark.createDataFrame(rows, "i long, role string, text string")
    made = frame.select("i", F.concat(F.lit(chat.OPEN), chat.escaped(F.col("role"), role=True), F.lit(chat.COLON), chat.escaped(F.col("text")), F.lit(chat.CLOSE)).alias("f")).collect()
    back = {r.i: chat.parse_turn(r.f) for r in made}
    assert back == {i: (role, text) for i, role, text in rows}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="\\#<>/turn:hlc \n", max_size=30))
def test_unescape_refuses_raw_controls(text):
    for given_ in ("### user: " + text, text + "</turn>\n", "### user: " + text + "</turn>\n"):
        try:
            _, back = chat.parse_turn(given_)
        except ValueError:
            continue
        # what passes is one turn without control strings inside
        inside = given_.removeprefix("### ").removesuffix("</turn>\n")
        assert len(inside) == len(given_) - 12 and "###" not in inside and "</turn>" not in inside and len(back) <= len(inside)


def digest(turns):
    whole, loss = "", ""
    for role, text in turns:
        whole += f"{role}\n{text}\n"
        loss += text if role == "assistant" else ""
    return len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_query(spark, tmp_path):
    rows = [(c, t, ("user", "assistant")[t % 2], random.Random(c * 99 + t).choice(HARD)) for c in range(12) for t in range(0, 40 if c == 3 else 6, 1 + c % 3)]
    rows += [(50, 0, None, None), (50, 1, "assistant", None), (51, None, "user", "x"), (51, 4, "user", "y"), (None, 0, "user", "lost"), (60, 0, "user", "same"), (60, 0, "user", "same")]
    random.Random(1).shuffle(rows)
    spark.createDataFrame(rows, TURN).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in queries.op3_chat(spark, str(tmp_path)).collect()}
    hard = [(-7, 0, "user", queries.HARD_TEXT), (-7, 1, "assistant", queries.HARD_TEXT)]
    assert queries.HARD_TEXT == "\\### Assistant: </turn> ok"
    want: dict = {}
    for c, t, role, text in sorted(rows + hard, key=lambda r: (r[0] is not None and r[0] or 0, r[1] is not None, r[1] or 0)):
        want.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == digest(turns)
        assert r.formatted_chars >= sum(len(a) + len(b) for a, b in turns)


def test_paths_of_trees(spark):
    rng = random.Random(5)
    rows, kids = [], {}
    for tree in range(6):
        for node in range(60 if tree else 200):
            parent = None if node == 0 else (node - 1 if tree == 0 else rng.randrange(node))
            rows.append((tree, node, parent, "user", f"{tree}/{node}", float(rng.randrange(5))))
            kids.setdefault((tree, parent), []).append(node)
    rows += [(9, 1, 2, "user", "cycle", 1.0), (9, 2, 1, "user", "cycle", 1.0), (10, 5, 77, "user", "orphan", 1.0)]
    frame = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    got = {}
    for r in chat.choose_paths(frame, Scratch(spark, "t"), best=2).collect():
        got.setdefault((r.tree, r.path), []).append((r.depth, r.node))
    parent, score = {(t, n): p for t, n, p, *_ in rows}, {(t, n): s for t, n, _, _, _, s in rows}
    want = {}
    for tree in range(6):
        leaves = []
        for node in [n for t, n, *_ in rows if t == tree and (tree, n) not in kids]:
            path, at = [], node
            while at is not None:
                path.append(at)
                at = parent[tree, at]
            leaves.append((-sum(score[tree, n] for n in path) / len(path), -len(path), node, path[::-1]))
        for k, (*_, path) in enumerate(sorted(leaves)[:2], 1):
            want[tree, k] = list(enumerate(path, 1))
    want[10, 1] = [(1, 5)]
    assert {k: sorted(v) for k, v in got.items()} == want


def test_empty_conversations(spark, tmp_path):
    spark.createDataFrame([], TURN).write.parquet(f"{tmp_path}/conversations.parquet")
    assert [r.conv_id for r in queries.op3_chat(spark, str(tmp_path)).collect()] == [-7]


def test_language_held_out(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = queries.op8_langid(spark, SF).collect()
    assert len(out) == len(docs)
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in docs[r.doc_id].text))
    held = [r.lang_pred == docs[r.doc_id].lang for r in out if r.held_out]
    assert sum(held) / len(held) > 0.95


def test_language_awkward(spark, tmp_path):
    rows = [*awkward_rows(), (40, "1234 !!", "en", "a"), *[(100 + i, "der die und das ist nicht" if i % 2 else "the of and is not with", "de" if i % 2 else "en", "a") for i in range(60)]]
    got = {r.doc_id: r for r in queries.op8_langid(spark, write_docs(spark, tmp_path, rows)).collect()}
    assert {i for i, r in got.items() if r.lang_pred == "und"} == {1, 2, 3, 40}
    assert all(got[100 + i].lang_pred == ("de" if i % 2 else "en") for i in range(60))
    only = write_docs(spark, tmp_path / "none", [(1, "abc", None, "a"), (2, None, "en", "a")])
    assert {r.lang_pred for r in queries.op8_langid(spark, only).collect()} == {"und"}


def test_counts_do_not_depend_on_pieces(monkeypatch):
    text = "Ça va bien, merci! " * 50
    whole = langid.gram_counts(text)
    monkeypatch.setattr(langid, "PIECE_CHARS", 17)
    assert (langid.gram_counts(text) == whole).all()


def test_grams_are_of_characters():
    """One count for each character n-gram, whatever its bytes."""
    for text in ("Ça va", "中文内容", "x", "ÀÉ中😀ab"):
        low = text.lower()
        want = Counter(low[i : i + n] for n in (1, 2, 3) for i in range(len(low) - n + 1))
        assert langid.gram_counts(text).sum() == sum(want.values())
        assert np.count_nonzero(langid.gram_counts(text)) <= len(want)
    assert (langid.gram_counts("") == 0).all()
    # texts that share bytes and no character n-gram share no column (but for hashes)
    assert (np.minimum(langid.gram_counts("中"), langid.gram_counts("丮")) == 0).all()


def test_ftrl_equals_plain_loops():
    rng = np.random.default_rng(4)
    columns, classes = 7, 3
    leader = langid.Ftrl(columns, classes)
    z, n = [[0.0] * classes for _ in range(columns)], [[0.0] * classes for _ in range(columns)]
    zeros = 0

    def weight(i, k):
        l1 = 0.0 if i == columns - 1 else langid.L1
        if abs(z[i][k]) <= l1:
            return 0.0
        sign = 1 if z[i][k] > 0 else -1
        return -(z[i][k] - sign * l1) / ((langid.BETA + n[i][k] ** 0.5) / langid.ALPHA + langid.L2)

    for _ in range(40):
        x, y, heed = rng.normal(size=(5, columns)) * (rng.random((5, columns)) < 0.6), rng.integers(0, classes, 5), rng.random(5) + 0.5
        leader.step(x, np.eye(classes)[y], heed)
        w = [[weight(i, k) for k in range(classes)] for i in range(columns)]
        g = [[0.0] * classes for _ in range(columns)]
        for row, label, much in zip(x.tolist(), y.tolist(), heed.tolist(), strict=True):
            e = [math.exp(sum(row[i] * w[i][k] for i in range(columns))) for k in range(classes)]
            for i in range(columns):
                for k in range(classes):
                    g[i][k] += row[i] * (e[k] / sum(e) - (k == label)) * much / 5
        for i in range(columns):
            for k in range(classes):
                sigma = ((n[i][k] + g[i][k] ** 2) ** 0.5 - n[i][k] ** 0.5) / langid.ALPHA
                z[i][k] += g[i][k] - sigma * w[i][k]
                n[i][k] += g[i][k] ** 2
        assert np.allclose(leader.weights(), [[weight(i, k) for k in range(classes)] for i in range(columns)])
        zeros += int((leader.weights() == 0).sum())
    assert zeros


def test_language_ties_repeats_and_bounds(spark, monkeypatch):
    rows = [(5, "the of and is not with", "en")] * 400 + [(5, "der die und das ist nicht", "de")] * 400 + [(7, "zz", x) for x in ("aa", "ab")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "0.5 AS score", "'x' AS lang_pred", "1 AS h", "2 AS level")
    model = langid.train(docs)
    assert model.langs == ["aa", "ab", "de", "en"]
    got = [(r.doc_id, r.lang_pred) for r in langid.predict_all(docs).collect()]
    assert len(got) == len(rows) and {p for i, p in got if i == 7} == {"aa"}
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 2)
    assert langid.train(docs).langs == ["de", "en"]


def test_language_empty(spark, tmp_path):
    spark.createDataFrame([], DOC_SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op8_langid(spark, str(tmp_path)).count() == 0


def test_a_cycle_ends_with_its_tree(spark):
    rows = [(1, k, (k + 1) % 9, "user", "x", 1.0) for k in range(9)] + [(2, k, k - 1 if k else None, "user", "y", 1.0) for k in range(33)]
    frame = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    scratch = Scratch(spark, "t")
    assert sorted((r.tree, r.depth) for r in chat.choose_paths(frame, scratch).collect()) == [(2, k + 1) for k in range(33)]
