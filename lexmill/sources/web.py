"""Web flashcards: a JSON endpoint, or the same JSON inlined in a page."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The marker before inlined cards, and the names of a card's fields.
MARKER = "window.flashcards = "
CARD = "sc_hanzi string, tc_hanzi string, pinyin string, meaning string, uuid string, saved_at string, sentence_sc string, sentence_translation string, hsk_level int"


class Unavailable(Exception):
    """The endpoint can't be used, which differs from having no cards."""


def inline_json(html: Column, marker: str = MARKER) -> Column:
    """The one JSON value after the marker in a page, as text; null where there is none."""

    def run(pages: pd.Series) -> pd.Series:
        decoder = json.JSONDecoder()

        def one(page):
            if page is None or (at := page.find(marker)) < 0:
                return None
            try:
                return json.dumps(decoder.raw_decode(page, at + len(marker))[0], ensure_ascii=False)
            except ValueError:
                return None

        return pages.map(one)

    return F.pandas_udf(run, "string")(html)


def parse_cards(payloads: DataFrame, payload: str = "payload", traditional: bool = False) -> DataFrame:
    """Cards of JSON payloads, each an envelope {"words": [..]} or the bare list; those without a headword drop."""
    envelope = F.from_json(payload, f"words array<struct<{CARD.replace(' ', ':').replace(',:', ',')}>>")["words"]
    bare = F.from_json(payload, f"array<struct<{CARD.replace(' ', ':').replace(',:', ',')}>>")
    rows = payloads.select(F.posexplode(F.when(F.startswith(F.ltrim(payload), F.lit("[")), bare).otherwise(envelope)).alias("ord", "card")).select("ord", "card.*")
    texts = [c for c in rows.columns if c not in ("ord", "hsk_level")]
    rows = rows.select("ord", *[F.coalesce(F.trim(c), F.lit("")).alias(c) for c in texts], "hsk_level")
    return rows.withColumn("headword", headword(F.col("sc_hanzi"), F.col("tc_hanzi"), traditional)).filter("headword <> ''")


def headword(simplified: Column, traditional: Column, prefer_traditional: bool = False) -> Column:
    first, second = (traditional, simplified) if prefer_traditional else (simplified, traditional)
    return F.coalesce(F.nullif(first, F.lit("")), F.nullif(second, F.lit("")), F.lit(""))


def fetch(endpoint: Callable[[], str], page: Callable[[], str]) -> str:
    """The endpoint's payload, or the page's if the endpoint is unavailable; an empty answer is an answer."""
    try:
        return endpoint()
    except Unavailable:
        return page()
