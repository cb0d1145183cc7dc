import json
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from lexmill.operators import audit, backfill, notes
from lexmill.models import prompts, runtime
from lexmill.config import EngineConfig, load_config
from lexmill.sources.collection import read_collection

SEP = "\x1f"
NOTES = [(1, "g1", 10, f"가다{SEP}{SEP}go{SEP}x"), (2, "g2", 10, f" 학교 {SEP}學校{SEP}school"), (3, "g3", 20, f"学习{SEP}{SEP}study{SEP}{SEP}more"), (4, "g4", 99, f"?{SEP}!")]
CARDS = [(1, 5), (1, 6), (2, 6), (3, 7), (4, 5)]
DECKS = {5: "Vocab", 6: "Vocab::Sub", 7: "Vocabulary"}
FIELDS = {10: ("Korean Vocab", ["Korean", "Hanja", "English", "Comment"]), 20: ("Hanzi", ["Hanzi", "Jyutping", "English", "Sentence"])}


def build(path, newer):
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE notes (id, guid, mid, mod, usn, tags, flds, sfld, csum, flags, data)")
    con.execute("CREATE TABLE cards (id, nid, did, ord)")
    con.executemany("INSERT INTO notes VALUES (?,?,?,0,0,'',?,'',0,0,'')", NOTES)
    con.executemany("INSERT INTO cards VALUES (NULL,?,?,0)", CARDS)
    if newer:
        con.execute("CREATE TABLE decks (id, name)")
        con.execute("CREATE TABLE notetypes (id, name)")
        con.execute("CREATE TABLE fields (ntid, ord, name, config)")
        con.executemany("INSERT INTO decks VALUES (?,?)", DECKS.items())
        con.executemany("INSERT INTO notetypes VALUES (?,?)", [(m, n) for m, (n, _) in FIELDS.items()])
        con.executemany("INSERT INTO fields VALUES (?,?,?,'')", [(m, i, f) for m, (_, fs) in FIELDS.items() for i, f in reversed(list(enumerate(fs)))])
    else:
        models = {m: {"name": n, "flds": [{"name": f, "ord": i} for i, f in enumerate(fs)]} for m, (n, fs) in FIELDS.items()}
        con.execute("CREATE TABLE col (id, models, decks)")
        con.execute("INSERT INTO col VALUES (1,?,?)", (json.dumps(models), json.dumps({d: {"name": n} for d, n in DECKS.items()})))
    con.commit()
    con.close()


@pytest.mark.parametrize("shape", ["newer", "legacy", "zip"])
def test_collections_agree(spark, tmp_path, shape):
    path = tmp_path / "collection.anki2"
    build(path, shape != "legacy")
    if shape == "zip":
        with zipfile.ZipFile(tmp_path / "deck.apkg", "w") as z:
            z.write(path, "collection.anki21")
        path = tmp_path / "deck.apkg"
    t = read_collection(spark, str(path))
    decks = notes.deck_ids("Vocab", t["decks"], notes.legacy_decks(t["col"]))
    assert sorted(r.did for r in decks.collect()) == [5, 6]
    schemas = notes.union_first_wins(notes.legacy_schemas(t["col"]), notes.table_schemas(t["notetypes"], t["fields"]), key="mid")
    assert {r.mid: (r.name, r.field_order) for r in schemas.collect()} == FIELDS
    words = {r.term for r in notes.deck_words(t["notes"], t["cards"], decks).collect()}
    assert words == {"가다", "학교", "?"}
    assert {r.term for r in notes.deck_words(t["notes"], t["cards"], decks, "English", schemas).collect()} == {"go", "school"}
    rows = {r.nid: r for r in notes.deck_notes(t["notes"], t["cards"], decks, schemas).collect()}
    assert set(rows) == {1, 2, 4} and rows[1].deck_id == 5 and rows[2].deck_id == 6
    assert rows[1].fields == {"Korean": "가다", "Hanja": "", "English": "go", "Comment": "x"} and rows[1].model_name == "Korean Vocab"
    assert rows[2].field_order == ["Korean", "Hanja", "English"] and rows[4].fields == {"field0": "?", "field1": "!"} and rows[4].model_name == ""
    names = notes.model_names(spark.createDataFrame([(10,), (99,)], "mid long"), schemas).collect()
    assert {r.mid: r.name for r in names} == {10: "Korean Vocab", 99: "model 99"}


def test_missing_collection_is_empty(spark, tmp_path):
    (tmp_path / "bad.anki2").write_text("not a database")
    for name in ("none.anki2", "bad.anki2"):
        assert all(t.count() == 0 for t in read_collection(spark, str(tmp_path / name)).values())


def test_repeated_field_names_keep_the_last(spark):
    frame = spark.createDataFrame([(["a", "b", "a"], ["1", "2", "3"])], "n array<string>, v array<string>")
    assert frame.select(notes.zip_fields(F.col("n"), F.col("v")).alias("m")).first().m == {"b": "2", "a": "3"}


NOTE = "guid string, model_name string, field_order array<string>, fields map<string,string>"
RED = '<span style="color: red;">%s</span>'


def ko(guid, word="가다", hanja="去", english="go", comment="", model="K"):
    return guid, model, ["Korean", "Hanja", "English", "Comment"], {"Korean": word, "Hanja": hanja, "English": english, "Comment": comment}


def zh(guid, word, reading):
    return guid, "Z", ["Hanzi", "Jyutping", "English", "Sentence"], {"Hanzi": word, "Jyutping": reading, "English": "e", "Sentence": "<br>".join([RED % word] * 3)}


def codes(rows):
    return {r.guid: [(x.code, x.detail) for x in r.reasons] for r in rows}


def test_korean_rules(spark):
    each = lambda w: "<br>".join(f"{RED % w} {x}" for x in "abc")
    three = each("가요")
    rows = [
        ko("ok", comment=three), ko("sino", word="음식飮食", hanja="", comment=each("음식飮食")), ko("blank", hanja=" ", english=" ", comment=three),
        ko("few", comment=RED % "가요"), ko("plain", comment="one<br>two<br>three"), ko("bare", comment=f"{RED % '가요'}<br>{RED % '학교'}<br>{RED % '가요'}"),
        ko("dup", comment=f"{RED % '가요'} a<br>{RED % '가요'}  A<br>{RED % '가요'} b"), ko("empty"),
        ("grammar", "G", ["Pattern"], {"Pattern": "x"}), ("both", "B", ["Korean", "Hanzi"], {"Korean": "x", "Hanzi": "y"}), ("short", "S", ["Korean"], {"Korean": "x"}),
    ]
    found = codes(audit.audit(spark.createDataFrame(rows, NOTE), target=3, include_empty_hanja=True, check_content=True).collect())
    assert found == {
        "sino": [("missing_hanja_for_sino", "embedded 飮食")],
        "blank": [("empty_english", "blank English"), ("empty_hanja_optional", "Hangul-only")],
        "few": [("too_few_sentences", "1<3")],
        "plain": [("plain_text_sentences", "no <span> tags")],
        "bare": [("keyword_not_highlighted", "no related red <span> for 가다"), ("duplicate_sentences", "3")],
        "dup": [("duplicate_sentences", "2")],
        "empty": [("too_few_sentences", "0<3")],
    }
    skipped = audit.skipped_models(spark.createDataFrame(rows, NOTE)).collect()
    assert [(r.model_name, r.n) for r in skipped] == [("S", 1)]


def test_notes_rule(spark):
    block = '<div class="card-notes"><span style="color: gray;">%s</span></div>'
    rows = [ko("none", comment=RED % "가다"), ko("hollow", comment=RED % "가다" + block % " "), ko("full", comment=RED % "가다" + block % "n"), ko("empty")]
    at = lambda target: codes(audit.audit(spark.createDataFrame(rows, NOTE), target=target, include_missing_notes=True).collect())
    assert at(0) == {"none": [("missing_context_notes", "no notes block")], "hollow": [("missing_context_notes", "empty notes block")]}
    assert at(1)["empty"] == [("too_few_sentences", "0<1"), ("missing_context_notes", "no notes block")]


def test_reading_rules(spark):
    known = {"促使": "cuk1 si2", "新鲜": "san1 sin1", "什么": "sam6 mo1", "归纳": "gwai1 naap6", "學習": "hok6 zaap6"}
    rows = [zh("missing", "促使", ""), zh("short", "新鲜", "san1"), zh("other", "什么", "zaap6 jiu1"), zh("joined", "归纳", "gwai1naap6"), zh("trad", "學習", "hok6 zaap1"), zh("unknown", "嗰", "")]
    reading = F.try_element_at(F.create_map(*[F.lit(x) for p in known.items() for x in p]), F.col("headword"))
    out = audit.audit(spark.createDataFrame(rows, NOTE), target=0, reading=reading, simplified=F.col("headword") != "學習").collect()
    assert codes(out) == {
        "missing": [("missing_jyutping", "cuk1 si2")],
        "short": [("wrong_jyutping", "san1 -> san1 sin1")],
        "other": [("wrong_jyutping", "zaap6 jiu1 -> sam6 mo1")],
    }


def test_judge_positions_skip_repeats(spark):
    row = ko("j", comment="<br>".join([f"{RED % '가다'} {x}" for x in ("a", "a", "b", "c")]))
    out = audit.audit(spark.createDataFrame([row], NOTE), target=3, check_content=True, rejected=F.array(F.lit(1), F.lit(9))).collect()
    assert codes(out)["j"] == [("duplicate_sentences", "2"), ("sentence_quality", "3")]


def test_overrides_and_suggestions(spark):
    row = ("o", "My Type", ["Korean", "Hanja", "Gloss", "Comment"], {"Korean": "가다", "Hanja": "x", "Gloss": "", "Comment": ""})
    frame = spark.createDataFrame([row], NOTE)
    assert audit.audit(frame, target=0).count() == 0
    out = audit.audit(frame, {"My Type": {"english_field": "Gloss"}}, target=0).collect()
    assert codes(out) == {"o": [("empty_english", "blank English")]} and out[0].resolved.english == "Gloss"
    names = spark.createDataFrame([(["Pinyin", "My Reading", "Word"],)], "f array<string>")
    got = names.select(audit.suggestions("jyutping_field", F.col("f")).alias("a"), audit.trapped("jyutping_field", F.col("f")).alias("b")).first()
    assert (got.a, got.b) == (["My Reading"], ["Pinyin"])
    text = names.select(audit.override_snippet(F.lit("M"), "zh", "jyutping_field", F.array().cast("array<string>")).alias("s")).first().s
    assert json.loads(text)["M"]["jyutping_field"] == "???"


def marked(*sentences):
    return "<br>".join(f'<span style="color: blue;">{s}</span>' for s in sentences)


PLAIN = "오늘 학교"
BACKFILL = {  # case: note, reasons, calls at 3 (translate, sentence, remark, notes)
    "embedded hanja": (ko("1", word="음식飮食", hanja=""), ["missing_hanja_for_sino"], (0, 0, 0, 0)),
    "no ideographs": (ko("2", hanja=""), ["missing_hanja_for_sino"], (1, 0, 0, 0)),
    "english and hanja": (ko("3", hanja="", english=""), ["empty_english", "empty_hanja_optional"], (1, 0, 0, 0)),
    "few, marked": (ko("4", comment=RED % "가요"), ["too_few_sentences"], (0, 1, 0, 0)),
    "few, unmarked": (ko("5", comment=marked(PLAIN)), ["too_few_sentences"], (0, 1, 1, 0)),
    "flagged at target": (ko("6", comment="<br>".join([RED % "가요"] * 3)), ["too_few_sentences"], (0, 0, 0, 0)),
    "judge rejects": (ko("7", comment="<br>".join([RED % "가요"] * 3)), [("sentence_quality", "2")], (0, 1, 0, 0)),
    "stale position": (ko("8", comment="<br>".join([RED % "가요"] * 3)), [("sentence_quality", "9")], (0, 0, 0, 0)),
    "plain with headword": (ko("9", comment="가다 1<br>가다 2<br>가다 3"), ["plain_text_sentences"], (0, 0, 0, 0)),
    "notes only": (ko("10", comment="<br>".join([RED % "가요"] * 3)), ["missing_context_notes"], (0, 0, 0, 1)),
    "notes and few": (ko("11", comment=RED % "가요"), ["missing_context_notes", "too_few_sentences"], (0, 1, 0, 0)),
    "notes at target": (ko("12", comment="<br>".join([RED % "가요"] * 3)), ["missing_context_notes", "too_few_sentences"], (0, 0, 0, 1)),
}


def entries(spark):
    rows = [(*n, "ko", [(r, "") if isinstance(r, str) else r for r in reasons]) for n, reasons, _ in BACKFILL.values()]
    frame = spark.createDataFrame(rows, NOTE + ", lang string, reasons array<struct<code:string,detail:string>>")
    return audit.with_values(frame.withColumn("resolved", audit.resolve_fields(F.col("lang"), F.col("model_name"))))


def test_estimate_per_note_and_totals(spark):
    got = {r.guid: (r["translate"], r["sentence_call"], r["remark"], r["notes"]) for r in backfill.plan(entries(spark), 3).collect()}
    assert got == {n[0]: calls for n, _, calls in BACKFILL.values()}
    row = backfill.estimate(entries(spark), 3, 4096, 50).first()
    sums = [sum(c[k] for *_, c in BACKFILL.values()) for k in range(4)]
    assert [row.translate_calls, row.sentence_calls, row.remark_calls, row.context_notes_calls] == sums
    assert (row.notes, row.total_calls, row.output_ceiling, row.minutes) == (len(BACKFILL), sum(sums), sum(sums) * 4096, sum(sums) / 50) and row.input_tokens > 0
    empty = [(*ko("e"), "ko", [("too_few_sentences", ""), ("missing_context_notes", "")])]
    none = spark.createDataFrame(empty, entries(spark).select("guid", "model_name", "field_order", "fields", "lang", "reasons").schema)
    at0 = backfill.plan(audit.with_values(none.withColumn("resolved", audit.resolve_fields(F.col("lang"), F.col("model_name")))), 0).first()
    assert (at0["translate"], at0["sentence_call"], at0["remark"], at0["notes"]) == (0, 0, 0, 0)


def test_repair_uses_exactly_the_estimated_calls(spark):
    planned = backfill.plan(entries(spark), 3).cache()
    asked = None
    for call, (system, user) in {
        "translate": prompts.translation(F.col("headword"), F.col("lang")), "sentence_call": prompts.sentences(F.col("headword"), F.col("lang"), F.col("needed")),
        "remark": prompts.remark(F.col("headword"), F.col("lang"), F.array_join(F.filter("kept_sentences", lambda s: backfill.lacks_headword(s, F.col("headword"))), "\n")), "notes": prompts.notes(F.col("headword"), F.col("lang"), F.col("english")),
    }.items():
        part = planned.filter(F.col(call) == 1).select(F.concat("guid", F.lit("/" + call)).alias("id"), system.alias("system"), user.alias("user"))
        asked = part if asked is None else asked.union(part)
    replies = runtime.model_stage(asked, runtime.stub_provider, EngineConfig(requests_per_minute=0, tokens_per_minute=0), 2).cache()
    row = backfill.estimate(entries(spark), 3).first()
    assert replies.count() == row.total_calls and runtime.usage_totals(replies).first().estimated_calls == row.total_calls
    parsed = {}
    for r in replies.collect():
        guid, call = r.id.split("/")
        parsed.setdefault(guid, {})[call] = runtime.parse_reply(r.payload)
    answers = []
    for guid, by in parsed.items():
        t, s, n, m = (by.get(k, {}) for k in ("translate", "sentence_call", "notes", "remark"))
        answers.append((guid, t.get("translation"), t.get("hanja"), s.get("sentences"), m.get("sentences"), n.get("notes") or s.get("notes"), "boom" if guid == "3" else None))
    frame = spark.createDataFrame(answers, "guid string, translation string, hanja string, sentences array<string>, remarked array<string>, notes string, error string")
    out = {r.guid: r for r in backfill.repair(planned, frame, 3).collect()}
    assert out["1"].fields["Hanja"] == "飮食" and out["1"].touched == ["Hanja"] and all(r.fields["Korean"] == BACKFILL[c][0][3]["Korean"] for c, r in zip(BACKFILL, (out[str(i)] for i in range(1, 13))))
    assert out["3"].touched == [] and out["3"].error == "boom" and out["3"].fields["English"] == ""
    assert out["4"].fields["Comment"].count("<br>") == 2 and out["5"].fields["Comment"].count(RED % "가다") == 3
    assert out["7"].fields["Comment"].count("<br>") == 2 and out["9"].fields["Comment"].count(RED % "가다") == 3
    assert "card-notes" in out["10"].fields["Comment"] and "card-notes" in out["11"].fields["Comment"]
    line = backfill.repair(planned, frame, 3).filter("guid = '1'").select(backfill.update_line(F.col("model_name"), F.lit("D"), F.col("guid"), F.col("field_order"), F.col("fields")).alias("x")).first().x
    assert line == "K\tD\t1\t음식飮食\t飮食\tgo\t"


def test_runtime():
    config = EngineConfig(max_retries=2)
    calls, slept = [], []

    def flaky(system, user, most):
        calls.append(user)
        if len(calls) < 3:
            raise runtime.Transient("429")
        return "{}", (7, 3)

    got = runtime.call_model(flaky, "s", "u", config, runtime.Limiter(0, 0), slept.append, lambda: 0.0)
    assert got["error"] is None and (got["input_tokens"], got["measured"]) == (7, True) and slept == [5.0, 15.0]
    bad = runtime.call_model(lambda *_: 1 / 0, "s", "u", config, runtime.Limiter(0, 0), slept.append, lambda: 0.0)
    assert "ZeroDivisionError" in bad["error"] and len(slept) == 2
    limit = runtime.Limiter(100, 2)
    limit.record(0.0, 60)
    assert limit.wait_needed(10.0, 50) == 50.5 and limit.wait_needed(60.0, 50) == 0.0 and not limit.events
    limit.record(61.0, 1)
    limit.record(62.0, 1)
    assert limit.wait_needed(70.0, 1) == 51.5
    assert [runtime.backoff(k) for k in range(5)] == [5, 15, 45, 90, 90]
    assert runtime.parse_reply('x ```json {"vocabulary": ["a"]} ```') == {"words": ["a"]} and runtime.parse_reply("{oops") == {}
    assert [p.name for p in runtime.diagnose(config, runtime.stub_provider, "k")] == ["provider", "api_key", "config", "dns", "api_reachable"]


def test_reply_columns(spark):
    frame = spark.createDataFrame([('{"terms": ["a", "b"]}',), ('{"words": ["c"]}',), ("{}",), ("bad",)], "p string")
    assert [r.w for r in frame.select(runtime.words_of_reply(F.col("p")).alias("w")).collect()] == [["a", "b"], ["c"], [], []]
    cost = frame.limit(1).select(runtime.cost(F.lit(2_000_000), F.lit(1_000_000), (1.0, 2.0)).alias("c"), runtime.cost(F.lit(1), F.lit(1), None).alias("n")).first()
    assert (cost.c, cost.n) == (4.0, None)


def test_config():
    assert load_config({}).extract_chunk_tokens == 960
    got = load_config({"LEXMILL_RPM": "x", "LEXMILL_TPM": "-5", "LEXMILL_CHUNK_RATIO": "7", "LEXMILL_DECK_FIELD_KO": "-2", "LEXMILL_DECK_FIELD": "Front", "LEXMILL_PRICE_IN": "2", "LEXMILL_OVERRIDES": '{"M": {"english_field": "E", "bad": "x"}}'}, "ko")
    assert (got.requests_per_minute, got.tokens_per_minute, got.chunk_output_ratio, got.deck_field, got.prices) == (50, 0, 1.0, 0, (2.0, 0.0))
    assert got.overrides == {"M": {"english_field": "E"}} and len(got.warnings) == 2
    with pytest.raises(ValueError):
        load_config({"LEXMILL_PROVIDER": "nobody"})
