"""Cleaning of vocabulary lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.strings import IDEOGRAPH, WS, blank_if_null, let, strip

_INNER = IDEOGRAPH[:-1] + WS[1:]
INLINE_HANJA = rf"{WS}*\({WS}*({IDEOGRAPH}{_INNER}*){WS}*\){WS}*"

# What is cut from a line, in this order, and a character without which it can't occur.
CUTS = (
    (rf"^{WS}*\p{{Nd}}+[.)]{WS}*", ""),  # numbering
    (rf"^{WS}*[-•*]{WS}+", ""),  # bullet
    (rf",{WS}*[A-Za-z][^\n]*\z", ","),  # translation after a comma
    (rf";{WS}*[A-Za-z][^\n]*\z", ";"),  # after a semicolon
    (rf":{WS}*[A-Za-z][^\n]*\z", ":"),  # after a colon
    (rf"{WS}+-{WS}+[A-Za-z][^\n]*\z", "-"),  # after a dash
    (rf"{WS}*\([^)]*\){WS}*", "("),  # parenthesis
)

# A line of the language has one of these characters.
VALID = {"zh": r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}]", "ko": r"[\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}]"}


def split_hanja(text: Column) -> tuple[Column, Column]:
    """(text without its first ideograph annotation, the annotation without spaces or blank)."""
    found = F.regexp_replace(F.regexp_extract(text, INLINE_HANJA, 1), f"{WS}+", "")
    without = strip(F.regexp_replace(text, rf"(?s)\A(.*?){INLINE_HANJA}(.*)\z", "$1 $3"))
    without = F.regexp_replace(without, rf"{WS}{{2,}}", " ")
    return F.when(found == "", text).otherwise(without), found


def bare_word(token: Column) -> Column:
    """The token without its annotation: the key of vocabulary dedupe."""
    return split_hanja(token)[0]


def clean_line(line: Column, lang: str) -> Column:
    """struct(word, hanja); word is null for lines to skip, hanja blank where there is none."""

    def judged(text: Column, hanja: Column) -> Column:
        keep = text != ""
        if lang in VALID:
            keep = keep & text.rlike(VALID[lang])
        return F.struct(F.when(keep, text).alias("word"), F.when(keep, hanja).otherwise(F.lit("")).alias("hanja"))

    def cut(text: Column) -> Column:
        for pattern, needs in CUTS:
            if needs:
                text = _bound(text, pattern, needs)
            else:
                text = F.regexp_replace(text, pattern, "")
        return strip(text)

    given = strip(blank_if_null(line))
    if lang != "ko":
        return let(cut(given), lambda t: judged(t, F.lit("")))
    parts = let(given, lambda t: F.struct(*[c.alias(n) for c, n in zip(split_hanja(t), ("word", "hanja"), strict=True)]))
    return let(parts, lambda p: let(cut(p["word"]), lambda t: judged(t, p["hanja"])))


def _bound(text: Column, pattern: str, needs: str) -> Column:
    """The cut where its character occurs; other texts pass without a scan."""
    return let(text, lambda t: F.when(F.contains(t, F.lit(needs)), F.regexp_replace(t, pattern, "")).otherwise(t))


def token(cleaned: Column) -> Column:
    """``word`` or ``word(hanja)``; null for skipped lines."""
    return F.when(cleaned["hanja"] != "", F.concat(cleaned["word"], F.lit("("), cleaned["hanja"], F.lit(")"))).otherwise(cleaned["word"])
