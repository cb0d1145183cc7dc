import html
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from lexmill.functions import cards, clean, hangul, patterns, readings, strings
from lexmill.operators import chunk


def apply(spark, values, f, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in frame.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


CLEAN = [
    ("ko", "알람이 울리다, An alarm rings", "알람이 울리다", ""),
    ("ko", "발생하다; To happen; to occur", "발생하다", ""),
    ("ko", "직원 - Employee / worker", "직원", ""),
    ("ko", "2) 사망자", "사망자", ""),
    ("ko", "• 부지런하다", "부지런하다", ""),
    ("ko", "음식(飮食)", "음식", "飮食"),
    ("ko", "박사 과정(博士 課程)", "박사 과정", "博士課程"),
    ("zh", "惆怅 (chóuchàng)", "惆怅", ""),
    ("ko", "Hello world", None, ""),
    ("ko", "你好", None, ""),
    ("ko", "  ", None, ""),
    ("ko", None, None, ""),
    ("ko", "(飮食)", None, ""),
]


@pytest.mark.parametrize("lang", ["ko", "zh"])
def test_clean_line(spark, lang):
    cases = [c for c in CLEAN if c[0] == lang]
    got = apply(spark, [c[1] for c in cases], lambda v: clean.clean_line(v, lang))
    assert [(r.word, r.hanja) for r in got] == [(c[2], c[3]) for c in cases]
    tokens = apply(spark, [c[1] for c in cases], lambda v: clean.token(clean.clean_line(v, lang)))
    assert tokens == [None if c[2] is None else c[2] + (f"({c[3]})" if c[3] else "") for c in cases]


PATTERNS = {
    "~ㄹ까 하다": "~(으)ㄹ까 하다", "~을까 하다": "~(으)ㄹ까 하다", "~ㄹ/을까 하다": "~(으)ㄹ까 하다", "~을/ㄹ까 하다": "~(으)ㄹ까 하다",
    "~ㅂ니다": "~(스)ㅂ니다", "~습니다": "~(스)ㅂ니다", "~ㅂ/습니다": "~(스)ㅂ니다", "~면": "~(으)면", "~으면": "~(으)면",
    "~어/아서": "~아/어서", "~가/이": "~이/가", "~를/을": "~을/를", "ㄹ/을 맛(이) 나다": "(으)ㄹ 맛(이) 나다",
    "~라면": "~라면", "~게 되다": "~게 되다", "나이에 따라": "나이에 따라", "은행에 가다": "은행에 가다", "음식": "음식",
    "–게 되다": "~게 되다", "—게 되다": "~게 되다", "-게 되다": "~게 되다", "~": "", " ": "", "": "",
}


def test_patterns(spark):
    assert apply(spark, list(PATTERNS), patterns.normalize_pattern) == list(PATTERNS.values())
    assert apply(spark, list(PATTERNS.values()), patterns.normalize_pattern) == list(PATTERNS.values())  # idempotent
    assert apply(spark, ["(是)…的"], lambda v: patterns.normalize_pattern(v, "zh")) == ["(是)…的"]
    assert len(set(apply(spark, ["~(으)ㄹ까 하다", "ㄹ까하다", "~ㄹ/을까 하다"], patterns.pattern_key))) == 1
    assert apply(spark, ["음식", "ㄹ/을 맛(이) 나다", None], patterns.vocab_key) == ["음식", "(으)ㄹ맛(이)나다", ""]


def test_hangul(spark):
    every = "".join(chr(c) for c in range(0xAC00, 0xD7A4, 37)) + "a漢ㄹ"
    assert apply(spark, [every], hangul.decompose) == [unicodedata.normalize("NFD", every)]
    words = ["가다", "가요", "갑니다", "듣다", "들어요", "요", "한다"]
    stems = apply(spark, words, lambda v: hangul.stem(hangul.decompose(v)))
    assert stems[0] == stems[1] == stems[2] == unicodedata.normalize("NFD", "가")
    assert stems[5] == unicodedata.normalize("NFD", "요")
    pairs = [("듣다", "들어요"), ("음료", "음식"), ("가다", ""), ("사과", "사과를")]
    frame = spark.createDataFrame(pairs, "a string, b string")
    assert [r.x for r in frame.select(hangul.related(F.col("a"), F.col("b")).alias("x")).collect()][0::3] == [True, True]


def test_variant_keys(spark):
    a, b, c, d = apply(spark, ["~ㄹ/을까 하다", "~(으)ㄹ까 하다", "ㄱㅏ", "가"], hangul.variant_keys)
    assert set(a) & set(b) and c == d
    one, other = apply(spark, ["~게 되다", "~게 하다"], hangul.variant_keys)
    assert not set(one) & set(other)


def test_tokens_and_indices(spark):
    assert apply(spark, ["", "abcdefgh", "안녕하세요飮食漢字", None, "a"], strings.estimate_tokens) == [0, 2, 9, 0, 1]
    assert apply(spark, ["2,3", "0 and 7", None, "x", "3 3 1"], strings.parse_indices) == [[1, 2], [6], [], [], [0, 2]]
    assert apply(spark, [[2, 3, 2], [], [0]], strings.encode_indices, "array<int>") == ["3,4", "", "1"]


def test_strings_equal_python(spark):
    rng = random.Random(1)
    alphabet = " \t\n\r\x0b\x0c\x1c\x1f\x85\xa0 　aB<>&;\"'éß漢가**"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(12))) for _ in range(300)]
    assert apply(spark, texts, strings.strip) == [t.strip() for t in texts]
    assert apply(spark, texts, strings.squeeze) == [" ".join(t.split()) for t in texts]
    assert apply(spark, texts, strings.escape) == [html.escape(t, quote=False) for t in texts]
    assert apply(spark, texts, strings.term_key) == [unicodedata.normalize("NFC", t.strip()) for t in texts]
    assert apply(spark, texts, cards.strip_markers) == [re.sub(r"\*\*(.+?)\*\*", r"\1", t) for t in texts]
    assert apply(spark, texts, cards.sentence_key) == [" ".join(unicodedata.normalize("NFC", re.sub(r"\*\*(.+?)\*\*", r"\1", t)).split()).casefold() for t in texts]
    assert apply(spark, ["a\tb\r\nc\nd\re", None], strings.tsv_safe) == ["a&#9;b&#10;c&#10;d&#10;e", ""]
    assert apply(spark, ["<b>促使</b>&nbsp;", "a &amp;lt; b", "x<y"], strings.strip_html) == ["促使", "a &lt; b", "x<y"]
    assert apply(spark, ["My Deck::가 1", "--", None], lambda v: strings.slug(v, "model")) == ["my_deck_가_1", "model", "model"]
    assert apply(spark, ["a.JPG", "b.webp", "c"], strings.media_type) == ["image/jpeg", "image/webp", "image/png"]
    assert apply(spark, ["ok ```json {\"a\": {\"b\": 1}} ``` bye", "none"], strings.json_payload) == ['{"a": {"b": 1}}', ""]


def test_cards(spark):
    word = F.lit("돕다")
    made = apply(spark, ["저는 **도와요** <b>", "돕다 & 돕다", "없음"], lambda v: cards.highlight(v, word))
    red = lambda t: f'</span><span style="color: red;">{t}</span><span style="color: blue;">'
    assert made == [f"저는 {red('도와요')} &lt;b&gt;", f"{red('돕다')} &amp; {red('돕다')}", "없음"]
    lists = apply(spark, [["**a** b", " ", "c"], []], lambda v: cards.sentence_list(v, F.lit("x")), "array<string>")
    assert lists == ['<span style="color: red;">a</span><span style="color: blue;"> b</span><br><span style="color: blue;">c</span>', ""]
    assert apply(spark, ["1. 句子一 2. 句子二", "값은 3.5달러. 2. 둘", "一。2.二"], cards.split_numbered) == [["句子一", "句子二"], ["값은 3.5달러.", "둘"], ["一。", "二"]]
    field = lists[0] + '<div class="card-notes"><span style="color: gray;">n</span></div>'
    assert apply(spark, [field, "", None, "a<br/>b<br> "], cards.count_blocks) == [2, 0, 0, 2]
    assert apply(spark, [field], cards.marked_sentences) == [["**a** b", "c"]]
    assert apply(spark, [field, "plain", "", "<br>"], cards.is_plain_text) == [False, True, False, True]
    assert apply(spark, [["a", "b", "a", "a", ""]], cards.repeated_positions, "array<string>") == [[2, 3]]
    assert apply(spark, [" n & m ", " "], cards.context_notes) == ['<div class="card-notes"><span style="color: gray;">n &amp; m</span></div>', ""]
    ex = apply(spark, [[("하게 **되었어요**", "became"), (" ", "x"), ("게 되다", None)]], lambda v: cards.grammar_examples(v, F.lit("~게 되다")), "array<struct<target:string,english:string>>")
    assert ex == [f'<span style="color: blue;">하게 {red("되었어요")}</span><br><span style="color: gray; font-size: 90%;">became</span><br><br>'.replace('<span style="color: blue;"></span>', "") + '<span style="color: red;">게 되다</span>']


def test_sentence_round_trip(spark):
    lists = [["**a** b & c", "d **e** f"], ["x < **y**"]]
    back = apply(spark, lists, lambda v: cards.marked_sentences(cards.sentence_list(v, F.lit(""))), "array<string>")
    assert back == lists


READINGS = {"歸納": "gwai1 naap6", "新鮮": "san1 sin1", "頭髮": "tau4 faat3", "什麼": "sam6 mo1", "學習": "hok6 zaap6", "好": "hou2", "促使": "cuk1 si2"}
TABLE = {"归纳": "歸納", "归": "歸", "纳": "納", "鲜": "鮮", "头发": "頭髮", "么": "麼", "习": "習", "学": "學"}


def test_readings(spark):
    words = ["归纳", "新鲜", "头发", "什么", "學習", "<b>促使</b>", "促使&nbsp;", "iPhone好", "", None]
    got = apply(spark, words, lambda v: readings.reading_column(v, READINGS, TABLE))
    assert [r.text for r in got] == ["gwai1 naap6", "san1 sin1", "tau4 faat3", "sam6 mo1", "hok6 zaap6", "cuk1 si2", "cuk1 si2", "", "", ""]
    assert got[7].unresolved == ["iPhone"]
    assert apply(spark, ["归纳", "學習"], lambda v: readings.contains_simplified(v, TABLE)) == [True, False]
    assert apply(spark, ["cuk1si2 A3", "x"], readings.reading_key) == ["cuk1 si2 a3", ""]
    assert apply(spark, ["归纳a", ""], readings.count_cjk) == [2, 0]


def test_chunks(spark):
    text = "[H1] one\n" + "a b c d\n\n" * 30 + "[H2] two\n" + "x" * 900 + "\n" + "漢" * 30
    made = chunk.split_text(text, 40)
    assert all(chunk.tokens_of(c) <= 41 + c.count("\n") for c in made) and made[0].startswith("[H1] one")
    assert "".join("".join(c.split()) for c in made) == "".join(text.split())
    assert chunk.split_text("", 10) == [] and chunk.split_text("short", 10) == ["short"]
    with pytest.raises(ValueError):
        chunk.split_text("x", 0)
    frame = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "s")], "id long, text string")
    rows = chunk.explode_chunks(frame, 40).orderBy("id", "chunk").collect()
    assert [r.chunk_text for r in rows if r.id == 1] == made and {r.id for r in rows} == {1, 4}


def test_unescape_each_equals_html(spark):
    import html

    texts = ["", None, "a & b", "&eacute;&#233;&#xE9;&#XE9; &amp;eacute; &amp;lt;", "&#8217;&hellip;&nbsp;x", "&nosuch; &;&#; &#x; &lt", "&#128512;&#x1F600;", "&#55296;&#1114112;&#0;&#128;&#150;", "&NotEqualTilde;", "&&lt;&gt;&&", "&quot;&apos;&#39;&#039;"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", strings.unescape_each(F.col("t")).alias("u"), F.transform(F.array("t"), strings.unescape_each).alias("l"))
    for r in rows.collect():
        want = None if texts[r.i] is None else html.unescape(texts[r.i].replace("&lt ", "&lt;")) if not texts[r.i].endswith("&lt") else texts[r.i]
        assert r.u == want and r.l == [want], texts[r.i]


def test_sentences_unescape_every_entity(spark):
    row = spark.createDataFrame([('<span style="color: blue;">caf&eacute; &#8217;x&#8217; <span style="color: red;">&agrave;</span> &amp;eacute;</span>',)], "f string")
    assert row.select(cards.plain_sentences(F.col("f"))).first()[0] == ["café ’x’ à &eacute;"]
    assert row.select(cards.marked_sentences(F.col("f"))).first()[0] == ["café ’x’ **à** &eacute;"]
