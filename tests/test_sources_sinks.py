import io
import json
import time
import zipfile
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lexmill.operators import merge, rows
from lexmill.sinks import writers
from lexmill.sources import files, web
from lexmill.streaming import folder


def lines_of(path):
    return [line for p in sorted(Path(path).glob("part-*")) for line in p.read_text().split("\n") if line]


def test_lines_and_listing(spark, tmp_path):
    (tmp_path / "b.txt").write_text(" 가다 \r\n\n학교\n")
    (tmp_path / "a.txt").write_text("첫째\n")
    assert [(r.ord, r.term) for r in files.read_lines(spark, str(tmp_path)).orderBy("ord").collect()] == [(0, "첫째"), (1, "가다"), (2, "학교")]
    docs = tmp_path / "docs"
    (docs / "sub").mkdir(parents=True)
    for name in ("z.pdf", "~x.docx", ".h.png", "m.JPG", "note.txt", "sub/a.docx"):
        (docs / name).write_bytes(docx() if name.endswith("docx") else b"x")
    flat = files.list_files(spark, str(docs)).orderBy("ord").collect()
    assert [(r.path.rsplit("/", 1)[1], r.kind) for r in flat] == [("m.JPG", "image"), ("z.pdf", "pdf")]
    deep = files.extract_text(files.list_files(spark, str(docs), recursive=True), headings=True, image_reader=lambda data, path: "ocr").collect()
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.error is None) for r in deep}
    assert got["a.docx"] == ("[H1] Title\nbody text\nA | B", True) and got["m.JPG"] == ("ocr", True) and not got["z.pdf"][1]


def docx():
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda t, style="": f"<w:p>{f'<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>' if style else ''}<w:r><w:t>{t}</w:t></w:r></w:p>"
    body = p("Title", "Heading1") + p("body text") + p(" ") + f"<w:tbl><w:tr><w:tc>{p('A')}</w:tc><w:tc>{p('')}</w:tc><w:tc>{p('B')}</w:tc></w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_records(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text('{"pattern":"~면","meaning":"if","examples":[{"target":"a"}]}\nnot json\n\n{"pattern":"x"}\n')
    (one,) = files.read_grammar(spark, str(tmp_path / "g.jsonl")).collect()
    assert (one.pattern, one.explanation, one.hanja, one.examples[0].english) == ("~면", "", "", None)
    (tmp_path / "a.jsonl").write_text('{"guid":"g1","fields":{"Korean":"가다"}}\n{"guid":"g2","lang":"zh","resolved":{"headword":"H"}}\n{"guid":"g3","lang":"fr"}\n{broken\n')
    got = {r.guid: r for r in files.read_audit(spark, str(tmp_path / "a.jsonl")).collect()}
    assert set(got) == {"g1", "g2"} and got["g1"].resolved.headword == "Korean" and got["g2"].resolved.headword == "H" and got["g2"].resolved.secondary == "Jyutping"
    assert files.peek_lang(spark, str(tmp_path / "a.jsonl")) == "zh"


def test_card_file_and_resume(spark, tmp_path):
    cards = spark.createDataFrame([(0, "가다", 'say "go", now'), (1, "학교", "a\nb")], "ord long, Korean string, English string")
    body = cards.select("ord", writers.csv_line(F.col("Korean"), F.col("English")).alias("line"))
    out = str(tmp_path / "cards")
    writers.write_single(body, writers.csv_header(["Korean", "English"]), out)
    assert lines_of(out) == ["#separator:comma", "#html:true", "#columns:Korean,English", "#Korean,English", '가다,"say ""go"", now"', '학교,"a', 'b"']
    done = files.completed_csv_keys(spark, out, "Korean", ["Korean", "English"])
    new = spark.createDataFrame([(0, "가다"), (1, "새"), (2, "새")], "ord long, term string")
    left = rows.resume(new, done, F.col("term"), F.col("key"), "ord").collect()
    assert [(r.ord, r.term) for r in left] == [(1, "새")]
    assert writers.tsv_header(["A"])[-1] == "#columns:notetype\tdeck\tguid\tA" and len(writers.tsv_header([])) == 6


def test_append_sinks(spark, tmp_path):
    path = str(tmp_path / "words")
    first = spark.createDataFrame([(0, "가다"), (1, "학교"), (2, "가다")], "ord long, term string")
    writers.append_words(first, first.limit(0), path)
    more = spark.createDataFrame([(0, "학교"), (1, "음식(飮食)")], "ord long, term string")
    writers.append_words(more, files.read_lines(spark, path), path)
    assert sorted(lines_of(path)) == sorted(["가다", "학교", "음식(飮食)"])
    grammar = str(tmp_path / "grammar")
    schema = files.GRAMMAR
    old = spark.createDataFrame([("~면", "if", "", "", [])], schema)
    new = spark.createDataFrame([("~으면", "x", "", "", []), ("~게 되다", "become", "", "", []), ("~게되다", "again", "", "", [])], schema)
    writers.append_grammar(new, old, grammar)
    assert sorted(r.meaning for r in files.read_grammar(spark, grammar).collect()) == ["again", "become"]
    updates = spark.createDataFrame([("My Type", "l1"), ("Other", "l2")], "model_name string, line string")
    writers.write_updates(updates, F.col("line"), str(tmp_path / "up"))
    assert sorted(p.name for p in (tmp_path / "up").glob("notetype=*")) == ["notetype=my_type", "notetype=other"]
    assert writers.default_path("inputs", "ko", "20260101", "", "txt") == "inputs/ko/20260101.txt"


def test_merges(spark):
    words = spark.createDataFrame([(0, "음식"), (1, "가다"), (2, "음식(飮食)"), (3, "음식(食)")], "ord long, word string")
    assert [(r.ord, r.word) for r in merge.merge_words(words, "ko").orderBy("ord").collect()] == [(0, "음식(飮食)"), (1, "가다")]
    assert merge.merge_words(words, "zh").count() == 4
    items = [(0, "~면", "if", "e", "", [("**a** b", "1"), ("a b", "2")]), (1, "~으면", "x", "y", "h", [("a b", "3"), ("**a** b", "4"), ("c", "5")]), (2, "~ㄹ까", "m", "", "", [])]
    frame = spark.createDataFrame(items, f"ord long, {files.GRAMMAR}")
    a, b = merge.merge_grammar(frame).orderBy("ord").collect()
    assert (a.pattern, a.meaning, a.explanation, a.hanja) == ("~(으)면", "if", "e", "h") and [e.english for e in a.examples] == ["1", "4", "5"]
    assert (b.pattern, b.examples) == ("~(으)ㄹ까", [])


def test_web(spark):
    cards = [{"sc_hanzi": "学", "tc_hanzi": "學", "meaning": "m", "hsk_level": 3, "other": 1}, {"sc_hanzi": " ", "tc_hanzi": ""}, {"tc_hanzi": "習"}]
    page = "<script>window.flashcards = " + json.dumps(cards) + "; more</script>"
    frame = spark.createDataFrame([(json.dumps({"words": cards}),)], "payload string")
    assert [(r.headword, r.hsk_level) for r in web.parse_cards(frame).orderBy("ord").collect()] == [("学", 3), ("習", None)]
    html = spark.createDataFrame([(page,), ("none",), (None,)], "html string").select(web.inline_json(F.col("html")).alias("payload"))
    assert [r.headword for r in web.parse_cards(html, traditional=True).orderBy("ord").collect()] == ["學", "習"]

    def broken():
        raise web.Unavailable("no")

    assert web.fetch(broken, lambda: "page") == "page" and web.fetch(lambda: "[]", broken) == "[]"


def test_streaming_folder(spark, tmp_path):
    source, seen = tmp_path / "in", []
    source.mkdir()
    (source / "a.txt").write_text("one")
    take = lambda batch, number: seen.extend(r.path.rsplit("/", 1)[1] for r in batch.select("path").collect())
    args = (spark, str(source), str(tmp_path / "cp"), take)
    folder.ingest(*args)
    folder.ingest(*args)
    time.sleep(0.01)
    (source / "b.txt").write_text("two")
    folder.ingest(*args)
    assert seen == ["a.txt", "b.txt"]


def test_manifest(spark):
    t0 = datetime(2026, 1, 1)
    now = spark.createDataFrame([("a", t0), ("b", t0 + timedelta(days=1)), ("c", t0)], "path string, modified timestamp")
    old = spark.createDataFrame([("a", t0, "vocab_done"), ("b", t0, "grammar_done"), ("gone", t0, "failed")], "path string, modified timestamp, status string")
    fresh = folder.refresh_manifest(now, old)
    assert {r.path: r.status for r in fresh.collect()} == {"a": "vocab_done", "b": "pending", "c": "pending"}
    assert sorted(r.path for r in folder.new_files(now, old).collect()) == ["b", "c"]
    row = folder.run_complete(fresh, "vocab").first()
    assert (row.complete, row.resumable) == (False, 2) and folder.run_complete(fresh.limit(0), "all").first().complete is False
    chunks = spark.createDataFrame([("k", 0), ("k", 1)], "file_key string, chunk int")
    cache = spark.createDataFrame([("k", 0, "vocab"), ("k", 1, "grammar")], "file_key string, chunk int, kind string")
    assert [r.chunk for r in folder.pending_chunks(chunks, cache, "vocab").collect()] == [1]


def test_completed_keys_of_cells_with_line_breaks(spark, tmp_path):
    (tmp_path / "c.csv").write_text('#separator:comma\n#columns:English,Hanzi\n"to go\n#or to leave",走\n"a ""b"", c",学\n,\n')
    keys = files.completed_csv_keys(spark, str(tmp_path / "c.csv"), "Hanzi", ["Hanzi", "English"])
    assert sorted(r.key for r in keys.collect()) == ["学", "走"]
    english = files.completed_csv_keys(spark, str(tmp_path / "c.csv"), "English", ["Hanzi", "English"])
    assert sorted(r.key for r in english.collect()) == ['a "b", c', "to go\n#or to leave"]
    with pytest.raises(ValueError):
        files.completed_csv_keys(spark, str(tmp_path / "c.csv"), "Pinyin", [])
