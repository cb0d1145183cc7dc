import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import DOC_SCHEMA, awkward_rows, write_docs
from test_minhash import brute as near_brute
from test_suffixes import brute as suffix_brute

import corpus_pipeline
from lexmill.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """What each stage returns on a real table, collected."""
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs.collect())
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs.collect())
    return out


def test_columns(spark, steps):
    for rows in steps[:-1]:
        assert rows[0].__fields__ == ["doc_id", "text", "lang", "source", "n_chars"]


def test_language_stage_keeps_what_has_letters(steps):
    given, kept = steps[0], {r.doc_id: r for r in steps[1]}
    lettered = {r.doc_id for r in given if any(c.isalpha() for c in r.text)}
    assert set(kept) <= lettered and len(kept) > 0.99 * len(lettered)
    same = [kept[r.doc_id] == r for r in given if r.doc_id in kept]
    assert sum(same) > 0.99 * len(same)


FOREIGN = [
    "Съешь же ещё этих мягких французских булок да выпей чаю",
    "Ξεσκεπάζω την ψυχοφθόρα βδελυγμία",
    "中文内容是随机的文字测试一下这个系统",
    "이것은 한국어 문장입니다 그리고 테스트입니다",
    "日本語のテキストはここにあります",
    "xqzv kkjw zzxq vvbn qqwx jjkz " * 5,
    "qwrtpsdfg hjklzxcvb " * 20,
]


def test_language_stage_rejects_fills_and_corrects(spark, steps):
    """Planted texts of no learned language and without letters go, clean ones stay, and their language is set."""
    by_lang = {}
    for r in steps[0]:
        if len(r.text) > 200:
            by_lang.setdefault(r.lang, []).append(r.text)
    held_out = iter(i for i in range(10_000_000, 20_000_000) if zlib.crc32(str(i).encode()) % 5 == 0)
    clean = {next(held_out): (lang, text) for lang, texts in sorted(by_lang.items()) for text in sorted(texts, key=len)[-5:]}
    other = dict(zip(sorted(by_lang), [*sorted(by_lang)[1:], sorted(by_lang)[0]], strict=True))
    plain = [(i, text, (None, other[lang])[k % 2]) for k, (i, (lang, text)) in enumerate(clean.items())]
    planted = [(20_000_000 + i, t, None) for i, t in enumerate([*FOREIGN, "1234 567 !!", "", " \n", None])]
    rows = [(r.doc_id, r.text, r.lang, "s", 1, 0.5, "x", 7, 8, 9) for r in steps[0]] + [(i, t, lang, "s", 1, 0.5, "x", 7, 8, 9) for i, t, lang in plain + planted]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, h long, level long, `a b` long")
    out = corpus_pipeline.language_stage(spark, docs, SF)
    assert out.columns == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    assert not [i for i, *_ in planted if i in got]
    assert all(i in got for i in clean)
    set_right = [got[i].lang == lang for i, (lang, _) in clean.items()]
    assert all(set_right[::2]) and sum(set_right[1::2]) > 5
    assert all((r.score, r.lang_pred, r.h, r["a b"]) == (0.5, "x", 7, 9) for r in got.values())


def test_near_duplicate_stage(steps):
    group, _ = near_brute([(r.doc_id, r.text) for r in steps[1]], 80)
    assert sorted(r.doc_id for r in steps[2]) == sorted(i for i, c in group.items() if i == c)


def test_suffix_stage(steps):
    want = suffix_brute([(r.doc_id, r.text) for r in steps[2]])
    assert Counter(r.doc_id for r in steps[3]) == Counter(want.keys())
    for r in steps[3]:
        assert r.text == want[r.doc_id][4].decode("utf-8", "ignore") and r.n_chars == len(r.text)


def test_mixing_stage(steps):
    size = lambda r: len(r.text.encode().split())
    had, got, times = Counter(), Counter(), Counter()
    for r in steps[3]:
        had[r.source] += size(r)
    for r in steps[4]:
        got[r.source] += size(r)
        times[r] += 1
    total = sum(had.values())
    assert set(steps[4]) <= set(steps[3]) and max(times.values()) <= 3
    assert all(got[s] <= 3 * had[s] for s in had) and abs(sum(got.values()) - total) < 0.1 * total


def test_token_stage(steps):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary_path())
    text = {r.doc_id: r.text for r in steps[4]}
    assert Counter(r.doc_id for r in steps[4]) == Counter(r.doc_id for r in steps[5])
    for r in steps[5]:
        ids = np.array(library.encode(text[r.doc_id], add_special_tokens=False).ids, dtype="<u4")
        assert r.ids == ids.tolist()
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_run_agrees_with_the_stages(spark, steps):
    name = lambda r: (r.doc_id, r.source, r.n_tokens, r.ids_sha256)
    assert Counter(map(name, corpus_pipeline.run(spark, SF).collect())) == Counter(map(name, steps[5]))


def test_awkward_and_empty(spark, tmp_path):
    rows = [*awkward_rows(), (30, "été déjà vu", "fr", "é"), (31, "1 2 3", "en", "a"), (None, "some words of no known number", "en", "a")]
    out = corpus_pipeline.run(spark, write_docs(spark, tmp_path / "a", rows)).collect()
    assert {r.doc_id for r in out} <= {4, 5, 6, 8, 30, None}
    spark.createDataFrame([], DOC_SCHEMA).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0
