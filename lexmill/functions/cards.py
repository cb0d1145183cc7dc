"""Card markup: highlighting, sentence lists, context notes, grammar cells, and their parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.hangul import related
from lexmill.functions.strings import WS, blank_if_null, casefold, escape, is_blank, nfc, squeeze, strip, strip_html, unescape_each

# The markup of cards.
RED, BLUE, GRAY, END = '<span style="color: red;">', '<span style="color: blue;">', '<span style="color: gray;">', "</span>"
SMALL_GRAY = '<span style="color: gray; font-size: 90%;">'
NOTES_OPEN, NOTES_CLOSE = '<div class="card-notes">', "</div>"
NOTES_BLOCK = r'(?is)<div class="[a-z]+-notes">.*?</div>'
BREAK = r"(?i)<br[\x09-\x0D\x20]*/?>"
RED_TEXT = r'(?i)<span style="color: red;">([^<]*)</span>'
ANY_SPAN = r"(?i)<span[^>]*>|</span>"
MARKED = r"\*\*([^\n]+?)\*\*"


def has_markers(text: Column) -> Column:
    return text.rlike(MARKED)


def strip_markers(text: Column) -> Column:
    return F.regexp_replace(text, MARKED, "$1")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, f"{WS}+\\z", "")


# --- writing ------------------------------------------------------------------


def highlight(text: Column, *keywords: Column) -> Column:
    """Escaped text with marked spans in red, or else all occurrences of the first keyword that occurs."""
    safe = escape(text)
    out = F.when(safe.rlike(MARKED), F.regexp_replace(safe, MARKED, f"{END}{RED}$1{END}{BLUE}"))
    for keyword in keywords:
        word = escape(blank_if_null(keyword))
        out = out.when((word != "") & F.contains(safe, word), F.replace(safe, word, F.concat(F.lit(END + RED), word, F.lit(END + BLUE))))
    return out.otherwise(safe)


def _without_empty(markup: Column) -> Column:
    return F.replace(markup, F.lit(BLUE + END), F.lit(""))


def sentence_list(sentences: Column, keyword: Column) -> Column:
    lines = F.transform(F.filter(sentences, lambda s: ~is_blank(s)), lambda s: F.concat(F.lit(BLUE), highlight(strip(s), keyword), F.lit(END)))
    return _without_empty(F.array_join(lines, "<br>"))


def split_numbered(text: Column) -> Column:
    """Sentences of ``1. a 2. b``; a number within a sentence, such as a decimal, splits nothing."""
    parts = F.split(blank_if_null(text), rf"(?:^|(?<={WS}|[。．.!?！？]))\p{{Nd}}+\.(?!\p{{Nd}}){WS}*")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def context_notes(notes: Column) -> Column:
    text = strip(blank_if_null(notes))
    return F.when(text == "", F.lit("")).otherwise(F.concat(F.lit(NOTES_OPEN + GRAY), escape(text), F.lit(END + NOTES_CLOSE)))


def grammar_meaning(meaning: Column, explanation: Column) -> Column:
    m, e = escape(strip(blank_if_null(meaning))), escape(strip(blank_if_null(explanation)))
    return F.when((m != "") & (e != ""), F.concat(F.lit("<b>"), m, F.lit("</b><br>"), e)).otherwise(F.concat(m, e))


def grammar_examples(examples: Column, pattern: Column) -> Column:
    """Examples (target, english) in blocks; the pattern, with and without its leading ~, is the fallback."""
    cited = strip(blank_if_null(pattern))
    bare = strip(F.regexp_replace(cited, "^~+", ""))

    def block(ex: Column) -> Column:
        line = F.replace(F.concat(F.lit(BLUE), highlight(strip(ex["target"]), cited, bare), F.lit(END)), F.lit(BLUE + END), F.lit(""))
        english = strip(blank_if_null(ex["english"]))
        return F.concat(line, F.when(english == "", F.lit("")).otherwise(F.concat(F.lit("<br>" + SMALL_GRAY), escape(english), F.lit(END))))

    return F.array_join(F.transform(F.filter(examples, lambda e: ~is_blank(e["target"])), block), "<br><br>")


# --- reading ------------------------------------------------------------------


def notes_block(field: Column) -> Column:
    return F.regexp_extract(blank_if_null(field), NOTES_BLOCK, 0)


def sentences_part(field: Column) -> Column:
    """The field without notes blocks; untouched where it has none."""
    field = blank_if_null(field)
    return F.when(field.rlike(NOTES_BLOCK), rstrip(F.regexp_replace(field, NOTES_BLOCK, ""))).otherwise(field)


def pieces(markup: Column) -> Column:
    return F.split(markup, BREAK)


def count_blocks(field: Column) -> Column:
    """Pieces between breaks that aren't blank, before tags are looked at."""
    return F.size(F.filter(pieces(sentences_part(field)), lambda p: ~is_blank(p)))


def is_plain_text(field: Column) -> Column:
    part = sentences_part(field)
    return ~is_blank(part) & ~F.contains(part, F.lit("<span"))


def parsed(markup: Column) -> Column:
    """array<struct<body, reds>>: plain sentences with the texts of their red spans; blank ones drop."""
    one = lambda p: F.struct(
        strip(unescape_each(F.regexp_replace(p, ANY_SPAN, ""))).alias("body"),
        F.transform(F.regexp_extract_all(p, F.lit(RED_TEXT), F.lit(1)), unescape_each).alias("reds"),
    )
    return F.filter(F.transform(pieces(blank_if_null(markup)), one), lambda s: s["body"] != "")


def plain_sentences(field: Column) -> Column:
    return F.transform(parsed(sentences_part(field)), lambda s: s["body"])


def marked_sentences(field: Column) -> Column:
    """Sentences whose red texts carry markers again, each at its first occurrence."""

    def mark(done: Column, red: Column) -> Column:
        at = F.instr(done, red)
        put = F.concat(F.substr(done, F.lit(1), at - 1), F.lit("**"), red, F.lit("**"), F.substr(done, at + F.length(red)))
        return F.when((red != "") & (at > 0), put).otherwise(done)

    return F.transform(parsed(sentences_part(field)), lambda s: F.aggregate(s["reds"], s["body"], mark))


def every_sentence_highlights(markup: Column, keyword: Column, lang: str) -> Column:
    """Whether each sentence, and one at least, has a red span that shows the keyword."""
    sentences = parsed(sentences_part(markup))
    shown = F.forall(sentences, lambda s: F.exists(s["reds"], lambda r: related(keyword, r, lang)))
    return ~is_blank(keyword) & (F.size(sentences) > 0) & shown


def sentence_key(sentence: Column) -> Column:
    """Key of duplicate sentences: no markers, composed, one space between words, case folded."""
    return casefold(squeeze(nfc(strip_markers(blank_if_null(sentence)))))


def repeated_positions(keys: Column) -> Column:
    """0-based positions whose non-blank key stood earlier in the array."""
    at = F.transform(keys, lambda k, i: F.when((k != "") & (F.array_position(keys, k) <= i), i))
    return F.filter(at, lambda i: i.isNotNull())


def example_key(target: Column, marked: bool = True) -> Column:
    """Key of examples; later sightings of a pattern compare with their markers on."""
    target = blank_if_null(target)
    return nfc(strip(strip_markers(target) if marked else target))


def bare_text(field: Column) -> Column:
    return strip_html(blank_if_null(field))
