import json
import zipfile
from pathlib import Path

import pytest
from test_notes import build

from lexmill.cli import main
from lexmill.models.runtime import stub_provider


def text_of(path):
    return [line for p in sorted(Path(path).glob("part-*")) for line in p.read_text().split("\n") if line]


@pytest.fixture
def deck(tmp_path):
    build(tmp_path / "c.anki2", True)
    return ["--deck-path", str(tmp_path / "c.anki2"), "--deck", "Vocab"]


def test_clean_excludes_the_deck(spark, tmp_path, deck, capsys):
    (tmp_path / "w.txt").write_text("1. 음식(飮食)\n가다, to go\n학교(學校)\nhello\n음식\n새로\n")
    out = str(tmp_path / "out")
    main(["clean", str(tmp_path / "w.txt"), "--lang", "ko", "-o", out, *deck], spark)
    assert text_of(out) == ["음식(飮食)", "새로"]
    with pytest.raises(SystemExit):
        main(["clean", str(tmp_path / "w.txt"), "--lang", "ko", "-o", out], spark)


def test_similar(spark, tmp_path, deck, capsys):
    (tmp_path / "w.txt").write_text("가요\n새로\n")
    main(["similar", str(tmp_path / "w.txt"), "--lang", "ko", "-o", str(tmp_path / "r"), "--format", "csv", *deck], spark)
    assert text_of(tmp_path / "r") == ["word_a,word_b,reason,score,source", "가요,가다,shared-stem,0.5,anki"]
    (tmp_path / "x.txt").write_text("测试\n测式\n")
    main(["similar", str(tmp_path / "x.txt")], spark)
    assert "测式, 测试" in capsys.readouterr().out


def test_audit_then_backfill(spark, tmp_path, deck, capsys):
    out = str(tmp_path / "audit")
    main(["audit", "-o", out, *deck], spark)
    assert "too_few_sentences: 1" in capsys.readouterr().out  # the other note lacks a field
    main(["backfill", out, "--dry-run"], spark)
    assert "sentence_calls=1" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["backfill", out, "-o", str(tmp_path / "up")], spark)
    assert not (tmp_path / "up").exists()
    main(["backfill", out, "-o", str(tmp_path / "up")], spark, stub_provider)
    written = [p.read_text().split("\n") for p in (tmp_path / "up").rglob("part-*")]
    assert [x[:6] for x in written] == [["#separator:tab", "#html:true", "#notetype column:1", "#deck column:2", "#guid column:3", written[0][5]]] and written[0][5].startswith("#columns:notetype\tdeck\tguid\t")
    lines = [line for x in written for line in x if line and line[0] != "#"]
    assert len(lines) == 1 and lines[0].split("\t")[2:4] == ["g1", "가다"] and "color: red" in lines[0]
    main(["backfill", out, "-o", str(tmp_path / "up")], spark, stub_provider)
    assert len([line for p in (tmp_path / "up").rglob("part-*") for line in p.read_text().split("\n") if line and line[0] != "#"]) == 1


def test_generate_and_resume(spark, tmp_path):
    (tmp_path / "w.txt").write_text("음식(飮食)\n가다\n음식(飮食)\n")
    out = str(tmp_path / "cards")
    main(["generate", str(tmp_path / "w.txt"), "--lang", "ko", "-n", "2", "-o", out], spark, stub_provider)
    with pytest.raises(SystemExit):
        main(["generate", str(tmp_path / "w.txt"), "--lang", "ko", "-o", str(tmp_path / "none")], spark)
    first = text_of(out)
    assert first[:4] == ["#separator:comma", "#html:true", "#columns:Korean,Hanja,English,Comment", "#Korean,Hanja,English,Comment"] and len(first) == 6
    assert first[4].startswith("음식,飮食,gloss of 음식,")
    main(["generate", str(tmp_path / "w.txt"), "--lang", "ko", "-n", "2", "-o", out], spark, stub_provider)
    assert len([line for line in text_of(out) if not line.startswith("#")]) == 2


def test_extract_and_pull(spark, tmp_path):
    from test_sources_sinks import docx

    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.docx").write_bytes(docx())
    main(["extract", str(tmp_path / "d"), "-o", str(tmp_path / "words"), "--provider", "lexmill.models.runtime:stub_provider"], spark)
    assert sorted(text_of(tmp_path / "words")) == ["A", "B", "Title", "body", "text"]
    (tmp_path / "page.html").write_text('window.flashcards = [{"sc_hanzi": "学"}, {"sc_hanzi": "学"}, {"sc_hanzi": "习"}];')
    main(["pull", str(tmp_path / "page.html"), "-o", str(tmp_path / "pulled")], spark)
    assert text_of(tmp_path / "pulled") == ["学", "习"]


def test_grammar_from_text_to_cards(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name, text in (("a", "~고 and ~지만 then ~고"), ("b", "~고 again and ~면서")):
        with zipfile.ZipFile(tmp_path / "d" / f"{name}.docx", "w") as z:
            z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:body></w:document>')
    out = str(tmp_path / "g")
    with pytest.raises(SystemExit):
        main(["extract", str(tmp_path / "d"), "--lang", "ko", "--mode", "grammar", "-o", out], spark)
    main(["extract", str(tmp_path / "d"), "--lang", "ko", "--mode", "all", "-o", str(tmp_path / "v"), "--grammar-output", out], spark, stub_provider)
    items = [json.loads(x) for x in text_of(out)]
    assert sorted(i["pattern"] for i in items) == ["~(으)면서", "~고", "~지만"] and all(i["meaning"].startswith("gloss of") for i in items)
    assert text_of(tmp_path / "v")
    cards = str(tmp_path / "cards")
    main(["generate", out, "--lang", "ko", "--mode", "grammar", "-o", cards], spark)
    lines = text_of(cards)
    assert lines[:4] == ["#separator:comma", "#html:true", "#columns:Pattern,Hanja,Meaning,Examples", "#Pattern,Hanja,Meaning,Examples"] and len(lines) == 7
    assert all('color: red' in x for x in lines[4:])
    main(["generate", out, "--lang", "ko", "--mode", "grammar", "-o", cards], spark)
    assert len(text_of(cards)) == 7


def test_status_and_check(capsys):
    main(["status"])
    main(["llm-check"])
    out = capsys.readouterr().out
    assert "extract_chunk_tokens: 960" in out and "ok provider openai" in out
