"""Queries of Korean and Chinese lines, similarity, notation and audit.

The lines and notes are put together from keys, so the SQL can state what must come out of each part.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import cards, clean, hangul, patterns, readings, strings
from lexmill.operators import audit, similar
from lexmill.plans.registry import pick, pick_sql, query, table
from lexmill.plans.text_queries import WORD_SQL, _normal_sql, korean_words, pattern_table

# Parts of a vocabulary line, and what the ideographs of each annotation are.
STARTS = ("", "12. ", "- ", " 3) ", "• ")
NOTED, IDEOGRAPHS = ("", "(水)", " ( 漢 字 )", "(note)"), ("", "水", "漢字", "")
TAILS = ("", ", to go", " - english", ": see x", "　")
LATIN = "only latin"


def _line_sql(word):
    said = f"CASE WHEN p_partkey % 11 = 0 THEN '{LATIN}' ELSE {word} END"
    return f"{pick_sql(STARTS, 'p_size % 5')} || {said} || {pick_sql(NOTED, '(p_partkey // 5) % 4')} || {pick_sql(TAILS, '(p_partkey // 20) % 5')}"


def vocabulary_lines(spark, sf_dir, words):
    """(p_partkey, line) of (p_partkey, word)."""
    key = F.col("p_partkey")
    said = F.when(key % 11 == 0, F.lit(LATIN)).otherwise(F.col("word"))
    parts = table(spark, sf_dir, "part", "p_partkey", "p_size").join(words, "p_partkey")
    line = F.concat(pick(STARTS, F.col("p_size") % 5), said, pick(NOTED, F.floor(key / 5) % 4), pick(TAILS, F.floor(key / 20) % 5))
    return parts.select("p_partkey", line.alias("line"))


def _cleaned(lines, lang):
    made = lines.select("p_partkey", F.explode(F.array(clean.clean_line(F.col("line"), lang))).alias("c"))
    return made.filter("c.word IS NOT NULL").select("p_partkey", F.col("c.word").alias("word"), F.col("c.hanja").alias("hanja"), clean.token(F.col("c")).alias("token"))


@query(
    "q44_clean_ko",
    f"""SELECT p_partkey, word, hanja, CASE WHEN hanja = '' THEN word ELSE word || '(' || hanja || ')' END AS token FROM
    (SELECT p_partkey, {WORD_SQL} AS word, {pick_sql(IDEOGRAPHS, '(p_partkey // 5) % 4')} AS hanja FROM part WHERE p_partkey % 11 <> 0)""",
)
def q44_clean_ko(spark, sf_dir):
    return _cleaned(vocabulary_lines(spark, sf_dir, korean_words(spark, sf_dir)), "ko")


HAN_SQL = "chr(CAST(19968 + (p_partkey * 7919) % 20000 AS INTEGER)) || chr(CAST(19968 + (p_partkey * 104729) % 20000 AS INTEGER))"


@query("q45_clean_zh", f"SELECT p_partkey, {HAN_SQL} AS word, '' AS hanja, {HAN_SQL} AS token FROM part WHERE p_partkey % 11 <> 0")
def q45_clean_zh(spark, sf_dir):
    ch = lambda by: hangul.char_of((F.lit(19968) + (F.col("p_partkey") * by) % 20000).cast("bigint"))
    words = table(spark, sf_dir, "part", "p_partkey").select("p_partkey", F.concat(ch(7919), ch(104729)).alias("word"))
    return _cleaned(vocabulary_lines(spark, sf_dir, words), "zh")


# --- similarity ------------------------------------------------------------------

ENDS = ("다", "요", "어요", "에서", "")
#: Words of few syllables, so that many pairs are alike: first and second syllable by key.
FIRST_SQL, SECOND_SQL = "588 * (p_partkey % 7) + 28 * ((p_partkey // 7) % 5) + p_partkey % 3", "588 * ((p_partkey // 5) % 4) + 4 * (p_partkey % 2)"
ALIKE_SQL = f"""words AS (SELECT term, min(p_partkey) AS ord FROM (SELECT p_partkey, chr(CAST(44032 + {FIRST_SQL} AS INTEGER)) || chr(CAST(44032 + {SECOND_SQL} AS INTEGER)) || {pick_sql(ENDS, '(p_partkey // 3) % 5')} AS term FROM part) GROUP BY term)"""


def ascii_letter(letter: str) -> str:
    """A conjoining letter as one printable byte, since the SQL engine's edit distance counts bytes."""
    code = ord(letter)
    for first, last, start in ((0x1100, 0x1112, 33), (0x1161, 0x1175, 52), (0x11A8, 0x11C2, 73)):
        if first <= code <= last:
            return chr(start + code - first)
    return letter


def _stems_sql(source, term):
    """Columns l (letters as bytes) and stem of every row of ``source``."""
    letters = f"""list_aggregate(list_transform(string_split({term}, ''), lambda c: chr(CAST(33 + (unicode(c) - 44032) // 588 AS INTEGER)) || chr(CAST(52 + ((unicode(c) - 44032) % 588) // 28 AS INTEGER)) ||
      CASE WHEN (unicode(c) - 44032) % 28 > 0 THEN chr(CAST(72 + (unicode(c) - 44032) % 28 AS INTEGER)) ELSE '' END), 'string_agg', '')"""
    endings = ", ".join("'" + "".join(map(ascii_letter, e)).replace("'", "''") + "'" for e in hangul.ending_letters())
    return f"""SELECT *, left(l, length(l) - coalesce(list_max(list_transform(list_filter([{endings}], lambda e: ends_with(l, e) AND length(l) - length(e) >= 2), lambda e: length(e))), 0)) AS stem
      FROM (SELECT *, {letters} AS l FROM {source})"""


def alike_words(spark, sf_dir):
    key = F.col("p_partkey")
    first = 588 * (key % 7) + 28 * (F.floor(key / 7) % 5) + key % 3
    second = 588 * (F.floor(key / 5) % 4) + 4 * (key % 2)
    term = F.concat(hangul.char_of((44032 + first).cast("bigint")), hangul.char_of((44032 + second).cast("bigint")), pick(ENDS, F.floor(key / 3) % 5))
    return table(spark, sf_dir, "part", "p_partkey").groupBy(term.alias("term")).agg(F.min("p_partkey").alias("ord")).select("ord", "term")


@query(
    "q46_similar_ko",
    f"""WITH {ALIKE_SQL}, s AS ({_stems_sql('words', 'term')}),
    ruled AS (SELECT x.ord AS ord_a, y.ord AS ord_b, x.term AS a, y.term AS b, CASE
      WHEN len(list_intersect(string_split(x.l, ''), string_split(y.l, ''))) = 0 THEN NULL
      WHEN least(length(x.l), length(y.l)) >= 3 AND abs(length(x.l) - length(y.l)) <= 1 AND levenshtein(x.l, y.l) = 1 THEN 'near-identical'
      WHEN least(length(x.term), length(y.term)) >= 2 AND (contains(x.term, y.term) OR contains(y.term, x.term)) THEN 'containment'
      WHEN x.stem = y.stem AND length(x.stem) >= 2 THEN 'shared-stem' END AS reason FROM s x JOIN s y ON x.ord < y.ord)
    SELECT ord_a, ord_b, a, b, reason FROM ruled WHERE reason IS NOT NULL""",
)
def q46_similar_ko(spark, sf_dir):
    return similar.find_similar(alike_words(spark, sf_dir), "ko", 0.8).filter("reason <> 'fuzzy'").select("ord_a", "ord_b", "a", "b", "reason")


@query(
    "q47_related_ko",
    f"""WITH {ALIKE_SQL}, s AS ({_stems_sql('words', 'term')}) SELECT x.ord AS ord_a, y.ord AS ord_b, contains(x.term, y.term) OR contains(y.term, x.term) OR levenshtein(x.stem, y.stem) <= 2 AS related,
    levenshtein(x.l, y.l)::INTEGER AS distance FROM s x JOIN s y ON left(x.term, 1) = left(y.term, 1)""",
)
def q47_related_ko(spark, sf_dir):
    words = alike_words(spark, sf_dir).withColumn("first", F.left("term", F.lit(1)))
    other = words.select("first", F.col("ord").alias("ord_b"), F.col("term").alias("b"))
    pairs = words.join(other, "first")
    letters = lambda c: hangul.units(F.col(c), "ko")
    return pairs.select(F.col("ord").alias("ord_a"), "ord_b", hangul.related(F.col("term"), F.col("b"), "ko").alias("related"), F.levenshtein(letters("term"), letters("b")).alias("distance"))


@query(
    "q48_bag_bound",
    """WITH names AS (SELECT p_name AS term, min(p_partkey) AS ord FROM part GROUP BY p_name),
    bags AS (SELECT ord, term, c, count(*) AS n FROM (SELECT ord, term, unnest(string_split(term, '')) AS c FROM names) GROUP BY ALL),
    shared AS (SELECT x.ord AS ord_a, y.ord AS ord_b, length(first(x.term)) + length(first(y.term)) AS total, sum(least(x.n, y.n))::INTEGER AS common FROM bags x JOIN bags y ON x.c = y.c AND x.ord < y.ord GROUP BY ALL)
    SELECT ord_a, ord_b, common, 2.0::DOUBLE * common / total AS bound FROM (SELECT ord_a, ord_b, max(total) AS total, max(common) AS common FROM shared GROUP BY ord_a, ord_b)""",
)
def q48_bag_bound(spark, sf_dir):
    named = table(spark, sf_dir, "part", "p_partkey", "p_name").groupBy("p_name").agg(F.min("p_partkey").alias("ord"))
    bags = named.select("ord", F.length("p_name").alias("n"), F.explode(strings.let(similar.characters(F.col("p_name")), similar.numbered)).alias("token"))
    other = bags.select(F.col("ord").alias("ord_b"), F.col("n").alias("n_b"), "token")
    common = F.count("*").cast("int")
    met = bags.join(other, "token").filter("ord < ord_b").groupBy(F.col("ord").alias("ord_a"), "ord_b").agg(common.alias("common"), F.first(F.col("n") + F.col("n_b")).alias("total"))
    return met.select("ord_a", "ord_b", "common", (2.0 * F.col("common") / F.col("total")).alias("bound"))


# --- notation ----------------------------------------------------------------------

# Patterns, the letters of every reading of each, and whether it counts as notation.
WRITTEN = ("(으)ㄹ까", "ㄹ/을까", "을까", "ㄹ까", "에서", "(이)나", "나", "이나", "~에서", "이/가")
KEYS = (
    ("ㅇ ㅡ ㄹ ㄲ ㅏ", "ㄹ ㄲ ㅏ"), ("ㄹ", "ㅇ ㅡ ㄹ ㄲ ㅏ", "ㄹ ㄲ ㅏ"), ("ㅇ ㅡ ㄹ ㄲ ㅏ",), ("ㄹ ㄲ ㅏ",), ("ㅇ ㅔ ㅅ ㅓ",), ("ㅇ ㅣ ㄴ ㅏ", "ㄴ ㅏ"),
    ("ㄴ ㅏ",), ("ㅇ ㅣ ㄴ ㅏ",), ("ㅇ ㅔ ㅅ ㅓ",), ("ㅇ ㅣ", "ㄱ ㅏ"),
)
NOTATION = (True, True, False, True, False, True, False, False, True, True)
MORE, MORE_KEY = ("", " 하다"), ("", " ㅎ ㅏ ㄷ ㅏ")
FORMS_SQL = f"""forms AS (SELECT p_partkey, {pick_sql(WRITTEN, 'p_partkey % 10')} || {pick_sql(MORE, '(p_partkey // 10) % 2')} AS term, {pick_sql(NOTATION, 'p_partkey % 10')} AS notation,
  list_transform({pick_sql([list(k) for k in KEYS], 'p_partkey % 10')}, lambda k: k || {pick_sql(MORE_KEY, '(p_partkey // 10) % 2')}) AS keys FROM part)"""


def forms(spark, sf_dir):
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part", "p_partkey").select("p_partkey", F.concat(pick(WRITTEN, key % 10), pick(MORE, F.floor(key / 10) % 2)).alias("term"))


@query(
    "q49_variant_pairs",
    f"""WITH {FORMS_SQL}, terms AS (SELECT term, min(p_partkey) AS ord, first(keys) AS keys, first(notation) AS notation FROM forms GROUP BY term)
    SELECT x.ord AS ord_a, y.ord AS ord_b, x.term AS a, y.term AS b, 1.0::DOUBLE AS score FROM terms x JOIN terms y ON x.ord < y.ord AND (x.notation OR y.notation) AND list_has_any(x.keys, y.keys)""",
)
def q49_variant_pairs(spark, sf_dir):
    terms = forms(spark, sf_dir).groupBy("term").agg(F.min("p_partkey").alias("ord")).select("ord", "term")
    return similar.find_similar(terms, "ko", 0.8).filter("reason = 'notation-variant'").select("ord_a", "ord_b", "a", "b", "score")


@query("q50_reading_counts", f"WITH {FORMS_SQL} SELECT p_partkey, len(keys)::INTEGER AS n, notation FROM forms")
def q50_reading_counts(spark, sf_dir):
    return forms(spark, sf_dir).select("p_partkey", F.size(hangul.variant_keys(F.col("term"))).alias("n"), patterns.has_notation(F.col("term")).alias("notation"))


@query(
    "q51_vocab_key",
    f"""SELECT p_partkey, CASE WHEN regexp_matches(pattern, '{patterns.NOTATION}') THEN replace(regexp_replace(normal, '^[~–—-]+', ''), ' ', '') ELSE trim(pattern) END AS key, trim(pattern) AS term_key FROM ({_normal_sql()})""",
)
def q51_vocab_key(spark, sf_dir):
    made = pattern_table(spark, sf_dir)
    return made.select("p_partkey", patterns.vocab_key(F.col("pattern")).alias("key"), strings.term_key(F.col("pattern")).alias("term_key"))


# --- readings ----------------------------------------------------------------------

# A small dictionary, texts, and what each must give: reading, what has none, ideographs, their number.
READINGS, SCRIPT = {"水": "seoi2", "火": "fo2", "水火": "seoi2 fo2", "號": "hou6", "行 ": "hang4"}, {"号": "號"}
TEXTS = ("水", "水火水", "号", "<b>水</b> 火", "水冇冇火乜", "abc", "")
READ = ("seoi2", "seoi2 fo2 seoi2", "hou6", "seoi2 fo2", "", "", "")
MISSING = ((), (), (), (), ("冇冇", "乜"), ("abc",), ())
TRADITIONAL = ("水", "水火水", "號", "<b>水</b> 火", "水冇冇火乜", "abc", "")
IDEOGRAPHS_OF, SYLLABLES = ("水", "水火水", "号", "水火", "水冇冇火乜", "", ""), (1, 3, 1, 2, 0, 0, 0)


@query(
    "q52_readings",
    f"""SELECT p_partkey, {pick_sql(READ, 'p_partkey % 7')} AS reading, array_to_string({pick_sql([list(m) for m in MISSING], 'p_partkey % 7')}, '|') AS unresolved, {pick_sql(TRADITIONAL, 'p_partkey % 7')} AS traditional,
    p_partkey % 7 = 2 AS simplified, {pick_sql(IDEOGRAPHS_OF, 'p_partkey % 7')} AS ideographs, length({pick_sql(IDEOGRAPHS_OF, 'p_partkey % 7')})::INTEGER AS n_ideographs, {pick_sql(SYLLABLES, 'p_partkey % 7')}::INTEGER AS syllables,
    {pick_sql(READ, 'p_partkey % 7')} AS reading_key, CASE WHEN p_partkey % 3 = 0 THEN '印' ELSE {pick_sql(IDEOGRAPHS_OF, 'p_partkey % 7')} END AS hanja FROM part""",
)
def q52_readings(spark, sf_dir):
    key, text = F.col("p_partkey"), F.col("text")
    texts = table(spark, sf_dir, "part", "p_partkey").withColumn("text", pick(TEXTS, key % 7))
    read = texts.withColumn("r", readings.reading_column(text, READINGS, SCRIPT))
    reading = F.col("r.text")
    return read.select(
        "p_partkey", reading.alias("reading"), F.array_join("r.unresolved", "|").alias("unresolved"), readings.traditional_column(text, SCRIPT).alias("traditional"),
        readings.contains_simplified(text, SCRIPT).alias("simplified"), strings.hanja_of(text).alias("ideographs"), readings.count_cjk(text).alias("n_ideographs"),
        readings.count_syllables(reading).alias("syllables"), readings.reading_key(F.upper(reading)).alias("reading_key"),
        strings.resolve_hanja(F.when(key % 3 == 0, "印"), text).alias("hanja"),
    )


# --- audit -------------------------------------------------------------------------

# Korean headwords, the ideographs in each, and sentences of a field with whether its red text shows 물 or 먹다.
KO_HEADS, KO_HANJA = ("가나(水)", "물", "漢字어", "먹다"), ("水", "", "漢字", "")
KO_FIELDS = (
    "",
    cards.BLUE + "나는 " + cards.END + cards.RED + "먹어요" + cards.END,
    "물 마셔요",
    cards.NOTES_OPEN + "n" + cards.NOTES_CLOSE + cards.RED + "비행기" + cards.END + "<br>" + cards.RED + "비행기" + cards.END + " ",
)
KO_AUDIT_SQL = f"""noted AS (SELECT p_partkey, {pick_sql(KO_HEADS, 'p_partkey % 4')} AS head, {pick_sql(KO_HANJA, 'p_partkey % 4')} AS han, p_size % 3 = 0 AS unread, p_size % 5 = 0 AS untold, p_partkey // 4 % 4 AS f FROM part),
reasons AS (
  SELECT p_partkey, 1 AS ord, 'missing_hanja_for_sino' AS code, 'embedded ' || han AS detail FROM noted WHERE unread AND han <> ''
  UNION ALL SELECT p_partkey, 2, 'empty_english', 'blank English' FROM noted WHERE untold
  UNION ALL SELECT p_partkey, 3, 'empty_hanja_optional', 'Hangul-only' FROM noted WHERE unread AND han = ''
  UNION ALL SELECT p_partkey, 4, 'too_few_sentences', [0, 1, 1, 2][CAST(f + 1 AS INTEGER)] || '<2' FROM noted WHERE f < 3
  UNION ALL SELECT p_partkey, 5, 'keyword_not_highlighted', 'no related red <span> for ' || head FROM noted WHERE f = 3 OR (f = 1 AND head NOT IN ('물', '먹다'))
  UNION ALL SELECT p_partkey, 6, 'plain_text_sentences', 'no <span> tags' FROM noted WHERE f = 2
  UNION ALL SELECT p_partkey, 7, 'missing_context_notes', 'no notes block' FROM noted WHERE f <> 3
  UNION ALL SELECT p_partkey, 8, 'duplicate_sentences', '2' FROM noted WHERE f = 3)"""


def korean_notes(spark, sf_dir):
    key, size, lit = F.col("p_partkey"), F.col("p_size"), F.lit
    fields = F.create_map(
        lit("Korean"), pick(KO_HEADS, key % 4), lit("Hanja"), F.when(size % 3 == 0, " ").otherwise("印"),
        lit("English"), F.when(size % 5 == 0, "").otherwise("x"), lit("Comment"), pick(KO_FIELDS, F.floor(key / 4) % 4),
    )
    order = F.array(*[lit(x) for x in ("Korean", "Hanja", "English", "Comment")])
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(lit("g"), key).alias("guid"), F.col("p_brand").alias("model_name"), order.alias("field_order"), fields.alias("fields"))


def audited_korean(spark, sf_dir):
    return audit.audit(korean_notes(spark, sf_dir), target=2, include_empty_hanja=True, include_missing_notes=True, check_content=True)


def _listed(audited):
    return audited.select("p_partkey", F.array_join(F.transform("reasons", lambda r: F.concat(r["code"], F.lit("="), r["detail"])), "; ").alias("reasons"))


@query("q53_audit_ko", f"WITH {KO_AUDIT_SQL} SELECT p_partkey, string_agg(code || '=' || detail, '; ' ORDER BY ord) AS reasons FROM reasons GROUP BY p_partkey")
def q53_audit_ko(spark, sf_dir):
    return _listed(audited_korean(spark, sf_dir))


# Chinese headwords with their reading and whether they are simplified; stored readings with their syllables.
ZH_HEADS, ZH_READ, ZH_COUNT = ("水", "水火", "号", "冇"), ("seoi2", "seoi2 fo2", "hou6", ""), (1, 2, 1, 1)
STORED, STORED_COUNT = ("", "seoi2", "Seoi2 fo2", "hou4"), (0, 1, 2, 1)


@query(
    "q54_audit_readings",
    f"""WITH noted AS (SELECT p_partkey, p_partkey % 4 AS h, p_partkey // 4 % 4 AS s, {pick_sql(ZH_READ, 'p_partkey % 4')} AS read, {pick_sql(ZH_COUNT, 'p_partkey % 4')} AS n,
      {pick_sql(STORED, 'p_partkey // 4 % 4')} AS stored, {pick_sql(STORED_COUNT, 'p_partkey // 4 % 4')} AS m, p_size % 3 AS bad FROM part),
    reasons AS (SELECT p_partkey, 1 AS ord, 'missing_jyutping' AS code, read AS detail FROM noted WHERE read <> '' AND stored = ''
      UNION ALL SELECT p_partkey, 2, 'wrong_jyutping', stored || ' -> ' || read FROM noted WHERE read <> '' AND stored <> '' AND (n <> m OR (h = 2 AND lower(stored) <> read))
      UNION ALL SELECT p_partkey, 3, 'duplicate_sentences', '2' FROM noted
      UNION ALL SELECT p_partkey, 4, 'sentence_quality', CASE bad WHEN 1 THEN '1' ELSE '1,3' END FROM noted WHERE bad > 0)
    SELECT p_partkey, string_agg(code || '=' || detail, '; ' ORDER BY ord) AS reasons FROM reasons GROUP BY p_partkey""",
)
def q54_audit_readings(spark, sf_dir):
    key, lit = F.col("p_partkey"), F.lit
    head = pick(ZH_HEADS, key % 4)
    red = lambda tail: F.concat(lit(cards.RED), head, lit(cards.END + tail))
    sentence = F.concat_ws("<br>", red("a"), red("A"), red("b"))
    fields = F.create_map(lit("Hanzi"), head, lit("Jyutping"), pick(STORED, F.floor(key / 4) % 4), lit("English"), lit("x"), lit("Sentence"), sentence)
    notes = table(spark, sf_dir, "part", "p_partkey", "p_size", "p_brand").select(
        "p_partkey", F.col("p_brand").alias("model_name"), F.map_keys(fields).alias("field_order"), fields.alias("fields"), F.slice(F.array(lit(0), lit(1)), lit(1), F.col("p_size") % 3).alias("bad"),
        readings.reading_column(head, READINGS, SCRIPT).alias("r"), readings.contains_simplified(head, SCRIPT).alias("simplified"),
    )
    found = audit.audit(notes, target=3, check_content=True, reading=F.col("r.text"), simplified=F.col("simplified"), rejected=F.col("bad"))
    return _listed(found)
