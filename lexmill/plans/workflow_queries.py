"""Queries of repair, field names, manifests, web cards, replies and files that are written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexmill.functions import cards, strings
from lexmill.functions.hangul import char_of
from lexmill.models import runtime
from lexmill.operators import audit, backfill, merge, rows
from lexmill.plans.korean_queries import KO_AUDIT_SQL, audited_korean
from lexmill.plans.note_queries import PARSED_SQL, VOCAB_SQL, audited, vocab_notes
from lexmill.plans.registry import pick, pick_sql, query, table
from lexmill.sinks import writers
from lexmill.sinks.scratch import scratch_root
from lexmill.sources import files, web
from lexmill.streaming import folder

# --- card text ---------------------------------------------------------------------

# Markup of a field, its sentences, and the same with markers.
FIELDS = (
    cards.BLUE + "a &eacute; " + cards.END + cards.RED + "b&#8217;s" + cards.END + " b&#8217;s<br> <BR/>x",
    cards.NOTES_OPEN + "n" + cards.NOTES_CLOSE + "one<br>two &amp;lt; &nosuch;",
    "",
    cards.RED + "c" + cards.END + cards.RED + "d" + cards.END + "c d",
)
PLAIN = (("a é b’s b’s", "x"), ("one", "two &lt; &nosuch;"), (), ("cdc d",))
REMARKED = (("a é **b’s** b’s", "x"), ("one", "two &lt; &nosuch;"), (), ("**c****d**c d",))


@query(
    "q55_sentences_read",
    f"SELECT p_partkey, array_to_string({pick_sql([list(x) for x in PLAIN], 'p_partkey % 4')}, '|') AS plain, array_to_string({pick_sql([list(x) for x in REMARKED], 'p_partkey % 4')}, '|') AS marked FROM part",
)
def q55_sentences_read(spark, sf_dir):
    field = pick(FIELDS, F.col("p_partkey") % 4)
    return table(spark, sf_dir, "part", "p_partkey").select("p_partkey", F.array_join(cards.plain_sentences(field), "|").alias("plain"), F.array_join(cards.marked_sentences(field), "|").alias("marked"))


@query(
    "q56_grammar_examples",
    """WITH e AS (SELECT conv_id, turn, regexp_replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '^@WS+|@WS+\\z', '', 'g') AS safe, role FROM conversations),
    lines AS (SELECT *, replace('<span style="color: blue;">' || CASE WHEN regexp_matches(safe, '\\*\\*([^\\n]+?)\\*\\*') THEN regexp_replace(safe, '\\*\\*([^\\n]+?)\\*\\*', '</span><span style="color: red;">\\1</span><span style="color: blue;">', 'g')
      ELSE replace(CASE WHEN contains(safe, '~the') THEN replace(safe, '~the', chr(1)) ELSE replace(safe, 'the', chr(2)) END, chr(1), '</span><span style="color: red;">~the</span><span style="color: blue;">') END || '</span>', '<span style="color: blue;"></span>', '') AS line FROM e WHERE safe <> '')
    SELECT conv_id, turn, replace(replace(line, chr(2), '</span><span style="color: red;">the</span><span style="color: blue;">'), '<span style="color: blue;"></span>', '') || '<br><span style="color: gray; font-size: 90%;">' || role || '</span><br><br><span style="color: blue;">z</span>' AS html FROM lines""",
)
def q56_grammar_examples(spark, sf_dir):
    said = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").filter(~strings.is_blank(F.col("text")))
    example = lambda target, english: F.struct(target.alias("target"), english.alias("english"))
    listed = F.array(example(F.col("text"), F.col("role")), example(F.lit(" "), F.lit("x")), example(F.lit("z"), F.lit(" ")))
    return said.select("conv_id", "turn", cards.grammar_examples(listed, F.lit(" ~the ")).alias("html"))


# Numbered sentences, and what they split into.
NUMBERED = ("1. a b 2. c", "a costs 3.50 now", "1.가.2.나", "  ", "12. x? 13. y 1.5 z")
SPLIT = (("a b", "c"), ("a costs 3.50 now",), ("가.", "나"), (), ("x?", "y 1.5 z"))


@query(
    "q57_numbered",
    f"SELECT p_partkey, array_to_string({pick_sql([list(x) for x in SPLIT], 'p_partkey % 5')}, '|') AS sentences, len({pick_sql([list(x) for x in SPLIT], 'p_partkey % 5')}) = 2 AS exact FROM part",
)
def q57_numbered(spark, sf_dir):
    found = cards.split_numbered(pick(NUMBERED, F.col("p_partkey") % 5))
    return table(spark, sf_dir, "part", "p_partkey").select("p_partkey", F.array_join(found, "|").alias("sentences"), runtime.exact_length(found, 2).alias("exact"))


@query(
    "q58_snippets",
    """SELECT doc_id, CASE WHEN length(t) > 80 THEN left(t, 80) || '…' ELSE t END AS snippet, doc_id::VARCHAR || ['.JPG', '.png', '.webp', ''][CAST(doc_id % 4 + 1 AS INTEGER)] AS path,
    ['image/jpeg', 'image/png', 'image/webp', 'image/png'][CAST(doc_id % 4 + 1 AS INTEGER)] AS media, ['image', 'image', 'image', NULL][CAST(doc_id % 4 + 1 AS INTEGER)] AS kind FROM
    (SELECT doc_id, regexp_replace(regexp_replace(text, '@WS+', ' ', 'g'), '^ | $', '', 'g') AS t FROM documents)""",
)
def q58_snippets(spark, sf_dir):
    path = F.concat(F.col("doc_id").cast("string"), pick((".JPG", ".png", ".webp", ""), F.col("doc_id") % 4))
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return docs.select("doc_id", strings.snippet(F.col("text"), 80).alias("snippet"), path.alias("path"), strings.media_type(path).alias("media"), files.file_kind(path).alias("kind"))


# --- field names -------------------------------------------------------------------

# Fields of three note types; what each suggests for the headword and the reading, and what misleads.
ORDERS = (("Word", "Pinyin", "Jyutping reading", "Def"), ("Korean", "My Word", "Comments"), ("A", "B"))
HEADWORDS, READINGS_OF, TRAPS = (("Word",), ("Korean", "My Word"), ()), (("Jyutping reading",), (), ()), (("Pinyin",), (), ())


@query(
    "q59_field_names",
    f"""SELECT p_partkey, array_to_string({pick_sql([list(x) for x in HEADWORDS], 'p_partkey % 3')}, '|') AS headwords, array_to_string({pick_sql([list(x) for x in READINGS_OF], 'p_partkey % 3')}, '|') AS readings,
    array_to_string({pick_sql([list(x) for x in TRAPS], 'p_partkey % 3')}, '|') AS traps,
    '{{"' || p_brand || '":{{"headword_field":"' || ['Word', 'Korean', '???'][CAST(p_partkey % 3 + 1 AS INTEGER)] || '","jyutping_field":"Jyutping","english_field":"English","sentence_field":"Sentence"}}}}' AS snippet FROM part""",
)
def q59_field_names(spark, sf_dir):
    order = F.element_at(F.array(*[F.array(*map(F.lit, o)) for o in ORDERS]), (F.col("p_partkey") % 3 + 1).cast("int"))
    names = table(spark, sf_dir, "part", "p_partkey", "p_brand").withColumn("order", order)
    words = audit.suggestions("headword_field", F.col("order"))
    return names.select(
        "p_partkey", F.array_join(words, "|").alias("headwords"), F.array_join(audit.suggestions("jyutping_field", F.col("order")), "|").alias("readings"),
        F.array_join(audit.trapped("jyutping_field", F.col("order")), "|").alias("traps"), audit.override_snippet(F.col("p_brand"), "zh", "headword_field", words).alias("snippet"),
    )


@query("q60_skipped_models", "SELECT p_brand AS model_name, count(*) AS n FROM part WHERE p_size % 3 = 0 GROUP BY p_brand")
def q60_skipped_models(spark, sf_dir):
    name = F.when(F.col("p_size") % 3 == 0, "Gloss").otherwise("English")
    fields = F.map_from_arrays(F.array(F.lit("Hanzi"), F.lit("Jyutping"), name, F.lit("Sentence")), F.array_repeat(F.lit("x"), 4))
    return audit.skipped_models(table(spark, sf_dir, "part").select(F.col("p_brand").alias("model_name"), fields.alias("fields")))


# --- repair ------------------------------------------------------------------------

@query(
    "q61_repair",
    f"""WITH {KO_AUDIT_SQL}, flagged AS (SELECT n.*, (SELECT list(code) FROM reasons r WHERE r.p_partkey = n.p_partkey) AS codes, p_partkey % 9 = 8 AS failed FROM noted n),
    made AS (SELECT *, CASE WHEN unread AND NOT failed AND han <> '' THEN han WHEN unread AND NOT failed THEN '答' WHEN unread THEN ' ' ELSE '印' END AS second,
      CASE WHEN untold AND NOT failed THEN 'to &lt;be&gt;' WHEN untold THEN '' ELSE 'x' END AS gloss FROM flagged WHERE codes IS NOT NULL)
    SELECT p_partkey, head AS headword, second, gloss, failed FROM made""",
)
def q61_repair(spark, sf_dir):
    planned = backfill.plan(audited_korean(spark, sf_dir), 2)
    words = F.array().cast("array<string>")
    failed = F.col("p_partkey") % 9 == 8
    answers = table(spark, sf_dir, "part", "p_partkey").select(
        F.concat(F.lit("g"), "p_partkey").alias("guid"), F.lit(" to <be> ").alias("translation"), F.lit("答").alias("hanja"), words.alias("sentences"), F.lit(None).cast("array<string>").alias("remarked"),
        F.lit("").alias("notes"), F.when(failed, "no answer").alias("error"),
    )
    done = backfill.repair(planned, answers, 2)
    at = lambda name: F.col("fields").getItem(name)
    return done.select("p_partkey", at("Korean").alias("headword"), at("Hanja").alias("second"), at("English").alias("gloss"), F.col("error").isNotNull().alias("failed"))


@query(
    "q62_repaired_sentences",
    f"""WITH {VOCAB_SQL}, {PARSED_SQL}, flagged AS (SELECT k.*, (SELECT list(code) FROM reasons r WHERE r.p_partkey = k.p_partkey) AS codes FROM keyed k),
    counted AS (SELECT *, list_has_any(codes, ['too_few_sentences', 'keyword_not_highlighted', 'plain_text_sentences', 'duplicate_sentences']) AS wants,
      len(list_filter(bodies, lambda b, i: list_position(keys, keys[i]) = i)) AS kept FROM flagged WHERE codes IS NOT NULL)
    SELECT p_partkey, CASE WHEN wants THEN (kept + 1)::INTEGER ELSE n::INTEGER END AS blocks, list_contains(codes, 'missing_context_notes') AS noted FROM counted""",
)
def q62_repaired_sentences(spark, sf_dir):
    planned = backfill.plan(audited(spark, sf_dir), 3)
    answers = vocab_notes(spark, sf_dir).select(
        "guid", F.lit(None).cast("string").alias("translation"), F.lit(None).cast("string").alias("hanja"), F.array(F.lit("**new** one")).alias("sentences"), F.lit(None).cast("array<string>").alias("remarked"),
        F.lit("fresh").alias("notes"), F.lit(None).cast("string").alias("error"),
    )
    done = backfill.repair(planned, answers, 3)
    field = F.col("fields").getItem("Sentence")
    return done.select("p_partkey", cards.count_blocks(field).alias("blocks"), F.contains(cards.notes_block(field), F.lit("fresh")).alias("noted"))


@query(
    "q63_estimate_totals",
    f"""WITH {KO_AUDIT_SQL}, flagged AS (SELECT n.*, (SELECT list(code) FROM reasons r WHERE r.p_partkey = n.p_partkey) AS codes FROM noted n),
    calls AS (SELECT (untold OR (unread AND han = ''))::INT AS t, 1 AS s, (f = 2 AND NOT contains('물 마셔요', head))::INT AS r FROM flagged WHERE codes IS NOT NULL)
    SELECT count(*) AS notes, sum(t + s + r)::BIGINT AS total_calls, sum(t + s + r)::BIGINT * 100 AS output_ceiling, sum(t + s + r) / 50 AS minutes FROM calls""",
)
def q63_estimate_totals(spark, sf_dir):
    return backfill.estimate(audited_korean(spark, sf_dir), 2, max_output_tokens=100, rpm=50).select("notes", "total_calls", "output_ceiling", "minutes")


# --- order and manifests -----------------------------------------------------------


@query("q64_ordinals", "SELECT row_number() OVER (ORDER BY c_name, c_custkey) - 1 AS ord, c_custkey FROM customer")
def q64_ordinals(spark, sf_dir):
    return rows.numbered(table(spark, sf_dir, "customer", "c_custkey", "c_name"), "c_name", "c_custkey").select("ord", "c_custkey")


@query("q65_append_unseen", "SELECT min(o_orderkey) AS o_orderkey, o_custkey % 500 AS k FROM orders WHERE o_custkey % 500 NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12) GROUP BY 2")
def q65_append_unseen(spark, sf_dir):
    new = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select("o_orderkey", (F.col("o_custkey") % 500).alias("k"))
    held = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey").filter("c_nationkey < 12")
    return rows.append_unseen(new, held, F.col("k"), F.col("c_custkey"), "o_orderkey")


# Files are pages, by page_id, since urls repeat; every third has changed since the manifest, and every fifth isn't in it.
STATES_SQL = pick_sql(folder.STATES, "page_id % 4")


def _manifest(spark, sf_dir):
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    stamp = lambda by: F.timestamp_seconds(F.lit(1_700_000_000) + by)
    listed = pages.select(F.col("url").alias("path"), stamp(F.col("page_id")).alias("modified"), "page_id")
    older = F.when(F.col("page_id") % 3 == 0, 1).otherwise(0)
    held = pages.filter("page_id % 5 <> 0").select(F.col("url").alias("path"), "page_id", stamp(F.col("page_id") - older).alias("modified"), pick(folder.STATES, F.col("page_id") % 4).alias("status"))
    return listed, held


@query("q66_manifest", f"SELECT url AS path, CASE WHEN page_id % 5 = 0 OR page_id % 3 = 0 THEN 'pending' ELSE {STATES_SQL} END AS status, page_id % 5 = 0 OR page_id % 3 = 0 AS fresh FROM pages")
def q66_manifest(spark, sf_dir):
    listed, held = _manifest(spark, sf_dir)
    status = folder.refresh_manifest(listed, held, "page_id")
    fresh = folder.new_files(listed, held, "page_id").select("page_id", F.lit(True).alias("new")).distinct()
    return status.join(fresh, "page_id", "left").select("path", "status", F.col("new").isNotNull().alias("fresh"))


@query(
    "q67_run_complete",
    f"""WITH s AS (SELECT CASE WHEN page_id % 5 = 0 OR page_id % 3 = 0 THEN 'pending' ELSE {STATES_SQL} END AS status FROM pages), m AS (SELECT unnest(['vocab', 'grammar', 'all']) AS mode)
    SELECT mode, bool_and(done) AS complete, count(*) FILTER (NOT done) AS resumable FROM (SELECT mode, status = 'grammar_done' OR (mode = 'vocab' AND status = 'vocab_done') AS done FROM s, m) GROUP BY mode""",
)
def q67_run_complete(spark, sf_dir):
    status = folder.refresh_manifest(*_manifest(spark, sf_dir), "page_id")
    out = [folder.run_complete(status, mode).select(F.lit(mode).alias("mode"), "complete", "resumable") for mode in ("vocab", "grammar", "all")]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("q68_pending_chunks", "SELECT user_id AS file_key, event_id AS chunk FROM events WHERE event_id % 4 <> 1")
def q68_pending_chunks(spark, sf_dir):
    chunks = table(spark, sf_dir, "events", "user_id", "event_id").select(F.col("user_id").alias("file_key"), F.col("event_id").alias("chunk"))
    kind = F.when(F.col("chunk") % 4 == 1, "vocab").otherwise("grammar")
    return folder.pending_chunks(chunks, chunks.filter("chunk % 2 = 1").withColumn("kind", kind), "vocab")


# --- payloads ----------------------------------------------------------------------


@query("q69_web_cards", "SELECT p_name AS headword, p_type AS meaning, '' AS pinyin, count(*) AS n FROM part WHERE p_size % 3 < 2 GROUP BY ALL")
def q69_web_cards(spark, sf_dir):
    part, c, lit = table(spark, sf_dir, "part"), F.col, F.lit
    card = F.to_json(F.struct(F.when(c("p_size") % 3 == 0, F.concat(lit(" "), "p_name")).alias("sc_hanzi"), F.when(c("p_size") % 3 == 1, c("p_name")).otherwise("").alias("tc_hanzi"), c("p_type").alias("meaning"), lit("y").alias("other")))
    body = F.concat(lit("["), card, lit("]"))
    enveloped = F.concat(lit('{"words": '), body, lit("}"))
    page = F.concat(lit("<script>"), lit(web.MARKER), F.when(c("p_partkey") % 2 == 0, body).otherwise(enveloped), lit("; next()</script>"))
    return web.parse_cards(part.select(web.inline_json(page).alias("payload"))).groupBy("headword", "meaning", "pinyin").agg(F.count("*").alias("n"))


@query(
    "q70_replies",
    """SELECT p_partkey, CASE WHEN p_partkey % 6 < 5 THEN p_name || '|' || p_brand ELSE '' END AS words, CASE WHEN p_partkey % 6 = 5 THEN p_type ELSE '' END AS patterns FROM part""",
)
def q70_replies(spark, sf_dir):
    c, lit = F.col, F.lit
    listed = F.to_json(F.array("p_name", "p_brand"))
    grammar = F.concat(lit('{"patterns": [{"pattern": "'), "p_type", lit('", "meaning": "m"}, {"pattern": " ", "meaning": "m"}, {"pattern": "p"}]}'))
    reply = F.when(c("p_partkey") % 6 == 5, grammar).otherwise(F.concat(lit('{"'), pick(runtime.WORD_KEYS, c("p_partkey") % 6 % 5), lit('": '), listed, lit("}")))
    said = strings.json_payload(F.concat(lit("Here: ```json\n"), reply, lit("\n``` done")))
    replies = table(spark, sf_dir, "part").withColumn("said", said)
    return replies.select("p_partkey", F.array_join(runtime.words_of_reply(c("said")), "|").alias("words"), F.array_join(F.transform(runtime.grammar_of_reply(c("said")), lambda g: g["pattern"]), "|").alias("patterns"))


@query(
    "q71_labels",
    """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_brand WHEN p_size % 2 = 0 THEN p_type ELSE 'deck' END AS label, CASE WHEN p_partkey % 4 = 0 THEN p_name || '|' || p_brand || '|' || p_type WHEN p_partkey % 4 = 3 THEN p_name || '|' || p_brand || '|' || p_type ELSE array_to_string(list_slice([p_name, p_brand, p_type], 1, p_partkey % 4), '|') END AS first FROM part""",
)
def q71_labels(spark, sf_dir):
    c = F.col
    label = backfill.deck_label(F.when(c("p_size") % 3 == 0, F.concat(F.lit(" "), "p_brand")), F.when(c("p_size") % 2 == 0, c("p_type")).otherwise(" "))
    listed = F.array("p_name", "p_brand", "p_type")
    first = merge.first_examples(listed, 0)
    for n in (1, 2, 3):
        first = F.when(c("p_partkey") % 4 == n, merge.first_examples(listed, n)).otherwise(first)
    return table(spark, sf_dir, "part").select("p_partkey", label.alias("label"), F.array_join(first, "|").alias("first"))


@query("q72_vocab_words", "SELECT min(ord) AS ord, coalesce(arg_min(word, ord) FILTER (contains(word, '(')), arg_min(word, ord)) AS word FROM (SELECT p_partkey AS ord, chr(CAST(44032 + p_partkey % 300 AS INTEGER)) || CASE WHEN p_size % 4 = 0 THEN '(水' || chr(CAST(19968 + p_size AS INTEGER)) || ')' ELSE '' END AS word FROM part) GROUP BY word[1]")
def q72_vocab_words(spark, sf_dir):
    ch = lambda code: char_of(code.cast("bigint"))
    word = F.concat(ch(44032 + F.col("p_partkey") % 300), F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("(水"), ch(19968 + F.col("p_size")), F.lit(")"))).otherwise(""))
    return merge.merge_words(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), word.alias("word")), "ko").select("ord", "word")


# --- files written and read back -----------------------------------------------------


def _place(df, name):
    return f"{scratch_root(df)}/{name}-{uuid.uuid4().hex[:12]}"


@query("q73_line_files", "SELECT row_number() OVER (ORDER BY p_name) - 1 AS ord, p_name AS term FROM (SELECT DISTINCT p_name FROM part)")
def q73_line_files(spark, sf_dir):
    names = table(spark, sf_dir, "part", "p_partkey", "p_name").select(F.col("p_name").alias("ord"), F.concat(F.lit("  "), "p_name", F.lit(" ")).alias("term"))
    path = _place(names, "words")
    writers.append_words(names, names.filter("false"), path)
    writers.append_words(names, files.read_lines(spark, path), path, strings.term_key(F.col("term")))  # nothing is new
    return rows.numbered(files.read_lines(spark, path).select("term"), "term")


@query("q74_card_files", "SELECT DISTINCT p_name || chr(10) || '\"' || p_brand || '\", #' AS key FROM part")
def q74_card_files(spark, sf_dir):
    term = F.concat("p_name", F.lit('\n"'), "p_brand", F.lit('", #'))
    part = table(spark, sf_dir, "part")
    columns = writers.CARD_COLUMNS["ko", "vocab"]
    path = _place(part, "cards")
    lines = part.select(F.col("p_partkey").alias("ord"), writers.csv_line(term, F.col("p_type"), F.lit(""), F.lit("a\n#b")).alias("line"))
    writers.write_single(lines, writers.csv_header(columns), path)
    return files.completed_csv_keys(spark, path, "Korean", columns)


@query("q75_update_files", "SELECT DISTINCT 'g' || p_partkey AS guid FROM part")
def q75_update_files(spark, sf_dir):
    notes = vocab_notes(spark, sf_dir)
    path = _place(notes, "updates")
    line = backfill.update_line(F.col("model_name"), F.lit("deck"), F.col("guid"), F.col("field_order"), F.col("fields"))
    writers.write_updates(notes, line, path)
    return files.completed_guids(spark, path)


@query(
    "q76_grammar_files",
    "SELECT pattern, count(*) AS n FROM (SELECT '~' || split_part(p_name, ' ', 1) AS pattern, p_size FROM part) WHERE p_size > 5 GROUP BY pattern",
)
def q76_grammar_files(spark, sf_dir):
    items = table(spark, sf_dir, "part").select(F.concat(F.lit("~"), F.split_part("p_name", F.lit(" "), F.lit(1))).alias("pattern"), F.when(F.col("p_size") > 5, F.col("p_type")).alias("meaning"))
    path = _place(items, "grammar")
    writers.append_grammar(items, items.filter("false"), path, "zh")
    writers.append_grammar(items, files.read_grammar(spark, path), path, "zh")  # nothing that was kept is new
    return files.read_grammar(spark, path).groupBy("pattern").agg(F.count("*").alias("n"))


@query(
    "q77_audit_files",
    f"""WITH {KO_AUDIT_SQL} SELECT p_partkey, lang, headword, deck_name, codes FROM (SELECT p_partkey, 'ko' AS lang, 'Korean' AS headword, CASE WHEN p_partkey % 30 < 25 THEN (SELECT n_name FROM nation WHERE n_nationkey = p_partkey % 30) ELSE '' END AS deck_name,
      (SELECT string_agg(code, '|' ORDER BY ord) FROM reasons r WHERE r.p_partkey = n.p_partkey) AS codes FROM noted n) WHERE codes IS NOT NULL""",
)
def q77_audit_files(spark, sf_dir):
    found = audited_korean(spark, sf_dir).withColumns({"nid": F.col("p_partkey"), "mid": F.lit(1).cast("bigint"), "deck_id": F.col("p_partkey") % 30, "deck_name": F.lit(None).cast("string")})
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("did"), F.col("n_name").alias("name"))
    path = _place(found, "audit")
    writers.write_audit(found, nation, path)
    read = files.read_audit(spark, path)
    return read.select(F.col("nid").alias("p_partkey"), "lang", "resolved.headword", "deck_name", F.array_join(F.transform("reasons", lambda r: r["code"]), "|").alias("codes"))
