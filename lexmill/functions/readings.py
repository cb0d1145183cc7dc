"""Dictionary readings by longest match, from tables that the caller provides."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.strings import SYLLABLE_CJK

SYLLABLE = r"[a-z]+[1-6]"


def segment(text: str, words: Mapping[str, str]) -> list[tuple[str, str | None]]:
    """(piece, entry): longest entries from the left; characters without one stand alone with None."""
    longest = max(map(len, words), default=0)
    out, at = [], 0
    while at < len(text):
        for n in range(min(longest, len(text) - at), 0, -1):
            if (piece := text[at : at + n]) in words:
                out.append((piece, words[piece]))
                at += n
                break
        else:
            out.append((text[at], None))
            at += 1
    return out


def converter(table: Mapping[str, str]) -> Callable[[str], str]:
    """Script conversion: entries replaced, all else kept."""
    return lambda text: "".join(entry if entry is not None else piece for piece, entry in segment(text, table))


def plain(text: str) -> str:
    return unicodedata.normalize("NFC", html.unescape(re.sub(r"<[^>]+>", "", text)).replace(" ", " ").strip())


def resolve(text: str, readings: Mapping[str, str], to_traditional: Callable[[str], str]) -> tuple[str, list[str]]:
    """(reading, what has none): all or nothing, of the converted form first, then of the form as it is."""
    raw = plain(text)
    missing: list[str] = []
    for form in dict.fromkeys((to_traditional(raw), raw)):
        found = segment(form, readings)
        gaps = [p for p, r in found if r is None and not p.isspace()]
        if found and not gaps:
            return " ".join(r for _, r in found if r), []
        missing = missing or ["".join(g) for g in _joined(found)]
    return "", missing


def _joined(found: list[tuple[str, str | None]]) -> list[str]:
    """Neighbouring pieces without a reading as one."""
    out, run = [], ""
    for piece, reading in [*found, ("", "")]:
        if reading is None and not piece.isspace():
            run += piece
        elif run:
            out.append(run)
            run = ""
    return out


def reading_column(text: Column, readings: Mapping[str, str], table: Mapping[str, str]) -> Column:
    """struct(text, unresolved, available)."""
    readings, table = dict(readings), dict(table)

    def run(texts: pd.Series) -> pd.DataFrame:
        convert = converter(table)
        rows = [resolve(t or "", readings, convert) for t in texts]
        return pd.DataFrame({"text": [r for r, _ in rows], "unresolved": [u for _, u in rows], "available": [bool(readings)] * len(rows)})

    return F.pandas_udf(run, "text string, unresolved array<string>, available boolean")(text)


def traditional_column(text: Column, table: Mapping[str, str]) -> Column:
    table = dict(table)
    return F.pandas_udf(lambda s: s.map(lambda t: None if t is None else converter(table)(t)), "string")(text)


def contains_simplified(text: Column, table: Mapping[str, str]) -> Column:
    return traditional_column(text, table) != text


def count_syllables(reading: Column) -> Column:
    return F.regexp_count(F.lower(reading), F.lit(SYLLABLE))


def count_cjk(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, SYLLABLE_CJK, ""))


def reading_key(reading: Column) -> Column:
    return F.array_join(F.regexp_extract_all(F.lower(reading), F.lit(SYLLABLE), F.lit(0)), " ")
