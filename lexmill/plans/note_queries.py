"""Queries of note collections, audit, backfill, merging, sinks and model accounting."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import cards, strings
from lexmill.models import runtime
from lexmill.operators import audit, backfill, merge, notes, rows
from lexmill.plans.registry import query, table
from lexmill.sinks import writers

# Notes are customers, cards are orders (in seven decks), note types are nations.
NOTES_SQL = "notes AS (SELECT c_custkey AS id, 'g' || c_custkey AS guid, c_nationkey AS mid, ' ' || c_mktsegment || chr(31) || c_name || chr(31) || c_nationkey AS flds FROM customer)"
CARDS_SQL = "cards AS (SELECT o_custkey AS nid, o_orderkey % 7 AS did FROM orders)"
DECKS_SQL = "decks AS (SELECT n_nationkey AS did, r_name || '::' || n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 1000 + r_regionkey, r_name FROM region)"


def note_rows(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    flds = F.concat_ws(notes.FIELD_SEPARATOR, F.concat(F.lit(" "), "c_mktsegment"), "c_name", F.col("c_nationkey").cast("string"))
    return c.select(F.col("c_custkey").alias("id"), F.concat(F.lit("g"), "c_custkey").alias("guid"), F.col("c_nationkey").cast("bigint").alias("mid"), flds.alias("flds"))


def card_rows(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("nid"), (F.col("o_orderkey") % 7).alias("did"))


def deck_rows(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    leaf = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("bigint").alias("did"), F.concat_ws("::", "r_name", "n_name").alias("name"))
    return leaf.unionByName(region.select((F.col("r_regionkey") + 1000).cast("bigint").alias("did"), F.col("r_name").alias("name")))


@query(
    "q11_deck_subtree",
    f"WITH {DECKS_SQL} SELECT r_name AS deck, did::BIGINT AS did FROM region JOIN decks ON name = r_name OR starts_with(name, r_name || '::')",
)
def q11_deck_subtree(spark, sf_dir):
    decks, tops = deck_rows(spark, sf_dir), [r["r_name"] for r in table(spark, sf_dir, "region", "r_name").collect()]  # five rows
    out = None
    for top in sorted(tops):
        part = decks.filter(notes.subtree(F.col("name"), top)).select(F.lit(top).alias("deck"), "did")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "q12_deck_words",
    f"WITH {NOTES_SQL}, {CARDS_SQL} SELECT DISTINCT regexp_replace(string_split(flds, chr(31))[1], '^@WS+|@WS+\\z', '', 'g') AS term FROM notes JOIN cards ON nid = id WHERE did IN (2, 5)",
)
def q12_deck_words(spark, sf_dir):
    decks = spark.range(2, 6, 3).withColumnRenamed("id", "did")
    return notes.deck_words(note_rows(spark, sf_dir), card_rows(spark, sf_dir), decks)


@query(
    "q13_deck_notes",
    f"""WITH {NOTES_SQL}, {CARDS_SQL} SELECT id AS nid, guid, coalesce(n_name, '') AS model_name, min(did)::BIGINT AS deck_id,
    string_split(flds, chr(31))[2] AS headword, CASE WHEN n_nationkey IS NULL THEN 'field2' WHEN mid % 2 = 0 THEN 'Nation' ELSE 'field2' END AS last_field
    FROM notes JOIN cards ON nid = id LEFT JOIN nation ON n_nationkey = mid AND n_nationkey < 20 WHERE did IN (2, 5) GROUP BY ALL""",
)
def q13_deck_notes(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").filter("n_nationkey < 20")
    even = F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("Segment"), F.lit("Name"), F.lit("Nation"))).otherwise(F.array(F.lit("Segment"), F.lit("Name")))
    schemas = nation.select(F.col("n_nationkey").cast("bigint").alias("mid"), F.col("n_name").alias("name"), even.alias("field_order"))
    decks = spark.range(2, 6, 3).withColumnRenamed("id", "did")
    found = notes.deck_notes(note_rows(spark, sf_dir), card_rows(spark, sf_dir), decks, schemas)
    name = F.coalesce(F.try_element_at("fields", F.lit("Name")), F.try_element_at("fields", F.lit("field1")))
    return found.select("nid", "guid", "model_name", "deck_id", name.alias("headword"), F.element_at("field_order", -1).alias("last_field"))


@query(
    "q14_schema_union",
    """SELECT mid, arg_min(name, rank) AS name FROM (SELECT n_nationkey::BIGINT AS mid, 'old ' || n_name AS name, 0 AS rank FROM nation WHERE n_nationkey % 2 = 0
    UNION ALL SELECT n_nationkey, n_name, 1 FROM nation WHERE n_nationkey < 15) GROUP BY mid""",
)
def q14_schema_union(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("mid"), F.col("n_name").alias("name"))
    legacy = nation.filter("mid % 2 = 0").withColumn("name", F.concat(F.lit("old "), "name"))
    return notes.union_first_wins(legacy, nation.filter("mid < 15"), key="mid")


# Vocabulary notes made of parts: the shape of their fields and their markup vary with size and key.
VOCAB_SQL = """vocab AS (SELECT p_partkey, p_size, p_name AS headword, CASE WHEN p_size % 5 = 0 THEN ' ' ELSE p_brand END AS english,
  CASE p_size % 6 WHEN 0 THEN '' WHEN 1 THEN 'plain ' || p_name
    WHEN 2 THEN '<span style="color: blue;">a </span><span style="color: red;">' || p_name || '</span>'
    WHEN 3 THEN '<span style="color: blue;">b</span><br><span style="color: red;">' || p_name || '</span><BR/> '
    WHEN 4 THEN '<div class="card-notes">n</div><span style="color: red;">' || p_name || '</span> x<br><span style="color: red;">' || p_name || '</span> x<br><span style="color: red;">' || p_name || '</span>  X'
    ELSE '<span style="color: blue;">' || p_type || '</span><br>c &amp; d<br>e' END AS sentence FROM part)"""
PARSED_SQL = """parsed AS (SELECT *, CASE WHEN regexp_matches(sentence, '(?is)<div class="card-notes">.*?</div>') THEN rtrim(regexp_replace(sentence, '(?is)<div class="card-notes">.*?</div>', '', 'g')) ELSE sentence END AS part FROM vocab),
pieces AS (SELECT *, list_filter(string_split_regex(part, '(?i)<br\\s*/?>'), lambda p: trim(p) <> '') AS blocks FROM parsed),
judged AS (SELECT *, len(blocks) AS n, part <> '' AND NOT contains(part, '<span') AS plain,
  list_filter(list_transform(blocks, lambda p: trim(regexp_replace(p, '<span[^>]*>|</span>', '', 'g'))), lambda b: b <> '') AS bodies,
  len(blocks) > 0 AND len(list_filter(blocks, lambda p: len(list_filter(regexp_extract_all(p, '<span style="color: red;">([^<]*)</span>', 1), lambda r: contains(headword, r) OR contains(r, headword))) = 0)) = 0 AS shown FROM pieces),
keyed AS (SELECT *, list_transform(bodies, lambda b: lower(regexp_replace(trim(b), ' +', ' ', 'g'))) AS keys FROM judged),
reasons AS (
  SELECT p_partkey, 1 AS ord, 'empty_english' AS code, 'blank English' AS detail FROM keyed WHERE trim(english) = ''
  UNION ALL SELECT p_partkey, 2, 'too_few_sentences', n || '<3' FROM keyed WHERE n < 3
  UNION ALL SELECT p_partkey, 3, 'keyword_not_highlighted', 'no related red <span> for ' || headword FROM keyed WHERE trim(part) <> '' AND NOT plain AND NOT shown
  UNION ALL SELECT p_partkey, 4, 'plain_text_sentences', 'no <span> tags' FROM keyed WHERE plain
  UNION ALL SELECT p_partkey, 5, 'missing_context_notes', 'no notes block' FROM keyed WHERE NOT contains(sentence, 'card-notes')
  UNION ALL SELECT p_partkey, 6, 'duplicate_sentences', d FROM (SELECT p_partkey, array_to_string(list_filter(list_transform(keys, lambda k, i: CASE WHEN list_position(keys, k) < i THEN i::VARCHAR END), lambda x: x IS NOT NULL), ',') AS d FROM keyed) WHERE d <> '')"""


def vocab_notes(spark, sf_dir):
    c, lit = F.col, F.lit
    red = F.concat(lit(cards.RED), "p_name", lit(cards.END))
    sentence = (
        F.when(c("p_size") % 6 == 0, lit("")).when(c("p_size") % 6 == 1, F.concat(lit("plain "), "p_name"))
        .when(c("p_size") % 6 == 2, F.concat(lit(cards.BLUE + "a " + cards.END), red))
        .when(c("p_size") % 6 == 3, F.concat(lit(cards.BLUE + "b" + cards.END + "<br>"), red, lit("<BR/> ")))
        .when(c("p_size") % 6 == 4, F.concat(lit(cards.NOTES_OPEN + "n" + cards.NOTES_CLOSE), red, lit(" x<br>"), red, lit(" x<br>"), red, lit("  X")))
        .otherwise(F.concat(lit(cards.BLUE), "p_type", lit(cards.END + "<br>c &amp; d<br>e")))
    )
    english = F.when(c("p_size") % 5 == 0, lit(" ")).otherwise(c("p_brand"))
    fields = F.create_map(lit("Hanzi"), c("p_name"), lit("Jyutping"), lit(""), lit("English"), english, lit("Sentence"), sentence)
    order = F.array(*[lit(x) for x in ("Hanzi", "Jyutping", "English", "Sentence")])
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.concat(lit("g"), "p_partkey").alias("guid"), c("p_brand").alias("model_name"), order.alias("field_order"), fields.alias("fields")
    )


def audited(spark, sf_dir):
    return audit.audit(vocab_notes(spark, sf_dir), target=3, include_missing_notes=True, check_content=True)


@query("q16_audit_reasons", f"WITH {VOCAB_SQL}, {PARSED_SQL} SELECT p_partkey, string_agg(code || '=' || detail, '; ' ORDER BY ord) AS reasons FROM reasons GROUP BY p_partkey")
def q16_audit_reasons(spark, sf_dir):
    listed = F.transform("reasons", lambda r: F.concat(r["code"], F.lit("="), r["detail"]))
    return audited(spark, sf_dir).select("p_partkey", F.array_join(listed, "; ").alias("reasons"))


@query("q17_audit_summary", f"WITH {VOCAB_SQL}, {PARSED_SQL} SELECT code, count(*) AS n FROM reasons GROUP BY code")
def q17_audit_summary(spark, sf_dir):
    return audit.summarize(audited(spark, sf_dir))


@query(
    "q15_detect_lang",
    """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'ko' WHEN 1 THEN 'zh' END AS lang,
    CASE WHEN p_size % 4 < 2 THEN CASE WHEN p_brand LIKE '%1' THEN 'Gloss' ELSE 'English' END END AS english_field,
    CASE WHEN p_size % 4 = 0 THEN p_brand NOT LIKE '%1' WHEN p_size % 4 = 1 THEN false END AS resolvable FROM part""",
)
def q15_detect_lang(spark, sf_dir):
    brands = [r["p_brand"] for r in table(spark, sf_dir, "part", "p_brand").distinct().collect()]  # a few brands
    overrides = {b: {"english_field": "Gloss"} for b in brands if b.endswith("1")}
    key = F.when(F.col("p_size") % 4 == 0, F.lit("Korean")).when(F.col("p_size") % 4 == 1, F.lit("Hanzi")).otherwise(F.lit("Pattern"))
    fields = F.map_from_arrays(F.array(key, F.lit("Hanja"), F.lit("English"), F.lit("Comment")), F.array_repeat(F.lit("x"), 4))
    found = table(spark, sf_dir, "part").withColumn("fields", fields).withColumn("lang", audit.detect_lang(F.col("fields")))
    found = found.withColumn("r", audit.resolve_fields(F.col("lang"), F.col("p_brand"), overrides))
    known = F.col("lang").isNotNull()
    return found.select("p_partkey", "lang", F.col("r.english").alias("english_field"), F.when(known, audit.resolvable(F.col("fields"), F.col("r"))).alias("resolvable"))


@query(
    "q30_backfill_estimate",
    f"""WITH {VOCAB_SQL}, {PARSED_SQL}, flagged AS (SELECT k.*, (SELECT list(code) FROM reasons r WHERE r.p_partkey = k.p_partkey) AS codes FROM keyed k),
    counted AS (SELECT *, list_contains(codes, 'empty_english') AS t, list_has_any(codes, ['too_few_sentences', 'keyword_not_highlighted', 'plain_text_sentences', 'duplicate_sentences']) AS wants,
      list_filter(bodies, lambda b, i: list_position(keys, keys[i]) = i) AS kept FROM flagged WHERE codes IS NOT NULL),
    needed AS (SELECT *, CASE WHEN wants AND (list_contains(codes, 'too_few_sentences') OR len(kept) < len(bodies)) THEN greatest(3 - len(kept), 0) ELSE 0 END AS need FROM counted)
    SELECT count(*) AS notes, sum(t::INT)::BIGINT AS translate_calls, sum((need > 0)::INT)::BIGINT AS sentence_calls,
      sum((wants AND len(list_filter(kept, lambda b: NOT contains(b, headword))) > 0)::INT)::BIGINT AS remark_calls,
      sum((list_contains(codes, 'missing_context_notes') AND need = 0)::INT)::BIGINT AS context_notes_calls FROM needed""",
)
def q30_backfill_estimate(spark, sf_dir):
    return backfill.estimate(audited(spark, sf_dir), 3).select("notes", "translate_calls", "sentence_calls", "remark_calls", "context_notes_calls")


@query(
    "q28_rate_window",
    """SELECT event_id, sum(tokens) OVER w::BIGINT AS tokens_60s, count(*) OVER w AS requests_60s,
    CASE WHEN sum(tokens) OVER w > 150 OR count(*) OVER w >= 3 THEN greatest(60 - (us - min(us) OVER w) / 1000000 + 0.5, 0.0) ELSE 0.0 END AS wait_s
    FROM (SELECT event_id, user_id, epoch_us(ts) AS us, CAST(abs(value) AS BIGINT) AS tokens FROM events)
    WINDOW w AS (PARTITION BY user_id % 3 ORDER BY us RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW)""",
)
def q28_rate_window(spark, sf_dir):
    calls = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 3).alias("lane"), "ts", F.rint(F.abs("value")).cast("bigint").alias("tokens"))
    return rows.rolling_limits(calls, 150, 3, by=["lane"]).select("event_id", "tokens_60s", "requests_60s", "wait_s")


@query(
    "q29_usage_cost",
    """SELECT calls, measured_calls, calls - measured_calls AS estimated_calls, i AS input_tokens, o AS output_tokens, i / 1000000 * 0.5 + o / 1000000 * 1.5 AS cost FROM
    (SELECT count(*) AS calls, count(*) FILTER (event_id % 3 = 0) AS measured_calls, sum(event_id % 1000)::BIGINT AS i, sum(user_id % 100)::BIGINT AS o FROM events WHERE event_id % 10 <> 0)""",
)
def q29_usage_cost(spark, sf_dir):
    replies = table(spark, sf_dir, "events").select(
        (F.col("event_id") % 1000).alias("input_tokens"), (F.col("user_id") % 100).alias("output_tokens"), (F.col("event_id") % 3 == 0).alias("measured"), F.when(F.col("event_id") % 10 == 0, "failed").alias("error")
    )
    total = runtime.usage_totals(replies)
    return total.withColumn("cost", runtime.cost(F.col("input_tokens"), F.col("output_tokens"), (0.5, 1.5)))


@query(
    "q31_vocab_merge",
    """SELECT split_part(p_name, ' ', 1) AS bare, min(p_partkey) AS ord, coalesce(arg_min(w, p_partkey) FILTER (p_size % 10 = 0), arg_min(w, p_partkey)) AS word
    FROM (SELECT *, split_part(p_name, ' ', 1) || CASE WHEN p_size % 10 = 0 THEN '(' || p_brand || ')' ELSE '' END AS w FROM part) GROUP BY 1""",
)
def q31_vocab_merge(spark, sf_dir):
    bare, annotated = F.split_part("p_name", F.lit(" "), F.lit(1)), F.col("p_size") % 10 == 0
    word = F.when(annotated, F.concat(bare, F.lit("("), "p_brand", F.lit(")"))).otherwise(bare)
    return merge.merge_annotated(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), word.alias("word"), bare.alias("bare"), annotated.alias("annotated")))


@query(
    "q32_grammar_merge",
    """WITH items AS (SELECT conv_id * 1000 + turn AS ord, 'p' || conv_id % 20 || ' ' || role AS pattern, text AS meaning, CASE WHEN turn > 1 THEN 'h' || conv_id ELSE ' ' END AS hanja,
      unnest(['**' || text || '** a', text]) AS ex, generate_subscripts([1, 2], 1) AS pos FROM conversations),
    heads AS (SELECT replace(pattern, ' ', '') AS key, min(ord) AS ord, arg_min(pattern, ord) AS pattern, arg_min(meaning, ord) AS meaning, coalesce(arg_min(hanja, ord) FILTER (trim(hanja) <> ''), '') AS hanja FROM items GROUP BY 1),
    named AS (SELECT key, i.ord, pos, ex, trim(nfc_normalize(CASE WHEN i.ord = h.ord THEN regexp_replace(ex, '\\*\\*([^\\n]+?)\\*\\*', '\\1', 'g') ELSE ex END)) AS name FROM items i JOIN heads h ON replace(i.pattern, ' ', '') = key),
    once AS (SELECT key, name, min(ord * 10 + pos) AS spot, arg_min(ex, ord * 10 + pos) AS ex FROM named WHERE name <> '' GROUP BY key, name)
    SELECT h.ord, pattern, meaning, hanja, (SELECT string_agg(ex, '|' ORDER BY spot) FROM once o WHERE o.key = h.key) AS examples FROM heads h""",
)
def q32_grammar_merge(spark, sf_dir):
    c, text = F.col, F.col("text")
    ex = lambda t: F.struct(t.alias("target"), F.lit("").alias("english"))
    items = table(spark, sf_dir, "conversations").select(
        (c("conv_id") * 1000 + c("turn")).alias("ord"), F.concat(F.lit("p"), c("conv_id") % 20, F.lit(" "), "role").alias("pattern"), text.alias("meaning"),
        F.lit("").alias("explanation"), F.when(c("turn") > 1, F.concat(F.lit("h"), "conv_id")).otherwise(F.lit(" ")).alias("hanja"),
        F.array(ex(F.concat(F.lit("**"), text, F.lit("** a"))), ex(text)).alias("examples"),
    )
    merged = merge.merge_grammar(items, "zh")
    return merged.select("ord", "pattern", "meaning", "hanja", F.array_join(F.transform("examples", lambda e: e["target"]), "|").alias("examples"))


@query(
    "q33_csv_rows",
    "SELECT p_partkey AS ord, chr(34) || p_name || ', ' || repeat(chr(34), 2) || p_brand || repeat(chr(34), 3) || ',' || p_type || ',' || p_size AS line FROM part",
)
def q33_csv_rows(spark, sf_dir):
    named = F.concat(F.col("p_name"), F.lit(', "'), "p_brand", F.lit('"'))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), writers.csv_line(named, F.col("p_type"), F.col("p_size")).alias("line"))


@query(
    "q34_tsv_rows",
    "SELECT doc_id, lang || chr(9) || source || chr(9) || 'g' || doc_id || chr(9) || replace(replace(replace(replace(text, chr(9), '&#9;'), chr(13) || chr(10), '&#10;'), chr(10), '&#10;'), chr(13), '&#10;') AS line FROM documents",
)
def q34_tsv_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    line = backfill.update_line(F.col("lang"), F.col("source"), F.concat(F.lit("g"), "doc_id"), F.array(F.lit("Text")), F.create_map(F.lit("Text"), F.col("text")))
    return docs.select("doc_id", line.alias("line"))


@query(
    "q35_resume",
    "SELECT min(o_orderkey) AS o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 5 = 0) GROUP BY o_custkey",
)
def q35_resume(spark, sf_dir):
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    return rows.resume(orders, orders.filter("o_orderkey % 5 = 0").select("o_custkey"), F.col("o_custkey"), F.col("o_custkey"), "o_orderkey")


@query("q36_json_ingest", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, len(props)::BIGINT AS size FROM events WHERE json_valid(props)")
def q36_json_ingest(spark, sf_dir):
    parsed = table(spark, sf_dir, "events", "event_id", "props").withColumn("p", F.from_json("props", "k bigint"))
    return parsed.filter("p IS NOT NULL").select("event_id", F.col("p.k").alias("k"), F.length("props").cast("bigint").alias("size"))


@query("q37_last_chunk", "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def q37_last_chunk(spark, sf_dir):
    return rows.last_per(table(spark, sf_dir, "events", "user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query(
    "q42_grammar_cells",
    """SELECT conv_id, turn, CASE WHEN m <> '' AND e <> '' THEN '<b>' || m || '</b><br>' || e ELSE m || e END AS meaning, '<div class="card-notes"><span style="color: gray;">' || m || '</span></div>' AS notes FROM
    (SELECT conv_id, turn, regexp_replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '^@WS+|@WS+\\z', '', 'g') AS m, CASE WHEN turn % 2 = 0 THEN role ELSE '' END AS e FROM conversations) WHERE m <> ''""",
)
def q42_grammar_cells(spark, sf_dir):
    said = table(spark, sf_dir, "conversations").withColumn("m", F.col("text"))
    second = F.when(F.col("turn") % 2 == 0, F.col("role")).otherwise(F.lit(""))
    return said.filter(~strings.is_blank(F.col("m"))).select("conv_id", "turn", cards.grammar_meaning(F.col("m"), second).alias("meaning"), cards.context_notes(F.col("m")).alias("notes"))


@query("q43_json_payload", "SELECT event_id, regexp_extract(reply, '(?s)\\{.*\\}', 0) AS payload FROM (SELECT event_id, '```json ' || props || ' ``` ok' AS reply FROM events)")
def q43_json_payload(spark, sf_dir):
    reply = F.concat(F.lit("```json "), "props", F.lit(" ``` ok"))
    return table(spark, sf_dir, "events", "event_id", "props").select("event_id", strings.json_payload(reply).alias("payload"))
