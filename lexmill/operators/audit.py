"""Note audit: language and field resolution, the rules, and summaries.

A note is a row with model_name, field_order and fields (map). Every rule is one expression that
yields a struct(code, detail) or null; the rules run in one projection, in report order.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import cards
from lexmill.functions.clean import INLINE_HANJA
from lexmill.functions.readings import count_cjk, count_syllables, reading_key
from lexmill.functions.strings import blank_if_null, encode_indices, hanja_of, is_blank, parse_indices, strip, strip_html

ROLES = ("headword", "secondary", "english", "sentence")
# Default field of each role, and the names its overrides go by.
DEFAULTS = {
    "ko": {"headword": "Korean", "secondary": "Hanja", "english": "English", "sentence": "Comment"},
    "zh": {"headword": "Hanzi", "secondary": "Jyutping", "english": "English", "sentence": "Sentence"},
}
OVERRIDE_NAMES = {lang: {"headword": "headword_field", "secondary": second, "english": "english_field", "sentence": "sentence_field"} for lang, second in (("ko", "hanja_field"), ("zh", "jyutping_field"))}
# Names that suggest a role, and names that look right but hold another system.
NEEDLES = {
    "headword_field": ("korean", "hanzi", "word", "chinese", "headword"),
    "hanja_field": ("hanja", "hanzi"),
    "jyutping_field": ("jyutping", "romanization", "reading"),
    "english_field": ("english", "translation", "meaning", "def", "definition"),
    "sentence_field": ("comment", "comments", "sentence", "sentences", "examples", "example", "notes", "note"),
}
TRAPS = {"jyutping_field": ("pinyin",)}

SENTENCE_CODES = ("plain_text_sentences", "too_few_sentences", "keyword_not_highlighted", "duplicate_sentences", "sentence_quality")


def detect_lang(fields: Column) -> Column:
    """ko or zh by which headword field a note has; null for both or neither."""
    ko, zh = F.map_contains_key(fields, "Korean"), F.map_contains_key(fields, "Hanzi")
    return F.when(ko & ~zh, "ko").when(zh & ~ko, "zh")


def resolve_fields(lang: Column, model: Column, overrides: Mapping[str, Mapping[str, str]] | None = None) -> Column:
    """struct of the four field names: a model's overrides on top of its language's defaults."""

    def role(name: str) -> Column:
        out = None
        for code, defaults in DEFAULTS.items():
            value = F.lit(defaults[name])
            for known, roles in (overrides or {}).items():
                if own := roles.get(OVERRIDE_NAMES[code][name]):
                    value = F.when(model == known, F.lit(own)).otherwise(value)
            out = F.when(lang == code, value) if out is None else out.when(lang == code, value)
        return out

    return F.struct(*[role(r).alias(r) for r in ROLES])


def resolvable(fields: Column, resolved: Column) -> Column:
    return F.forall(F.array(*[resolved[r] for r in ROLES]), lambda f: F.map_contains_key(fields, f))


def matching_names(needles: tuple[str, ...], field_order: Column) -> Column:
    """Field names that contain a needle, in the order of needles, then of fields."""

    def holding(needle: str) -> Column:
        return F.filter(field_order, lambda f: F.contains(F.lower(f), F.lit(needle)))

    return F.array_distinct(F.flatten(F.array(*map(holding, needles))))


def suggestions(role: str, field_order: Column) -> Column:
    return matching_names(NEEDLES[role], field_order)


def trapped(role: str, field_order: Column) -> Column:
    """Fields of the right shape and the wrong content; never suggested."""
    return matching_names(TRAPS[role], field_order) if role in TRAPS else F.array().cast("array<string>")


def override_snippet(model: Column, lang: str, role: str, suggested: Column) -> Column:
    """JSON text of an override to paste; ??? where nothing is suggested."""
    names = [F.coalesce(F.get(suggested, F.lit(0)), F.lit("???")) if OVERRIDE_NAMES[lang][r] == role else F.lit(DEFAULTS[lang][r]) for r in ROLES]
    inner = F.create_map(*[x for r, n in zip(ROLES, names, strict=True) for x in (F.lit(OVERRIDE_NAMES[lang][r]), n)])
    return F.to_json(F.create_map(model, inner))


def value(fields: Column, name: Column) -> Column:
    return blank_if_null(F.try_element_at(fields, name))


def _reason(code: str, when: Column, detail: Column) -> Column:
    return F.when(when, F.struct(F.lit(code).alias("code"), detail.alias("detail")))


def with_values(notes: DataFrame) -> DataFrame:
    """Adds a column per role with the note's text in it."""
    return notes.withColumns({r: value(F.col("fields"), F.col(f"resolved.{r}")) for r in ROLES})


def reasons(lang: Column, target: int = 3, include_empty_hanja: bool = False, include_missing_notes: bool = False, check_content: bool = False, reading: Column | None = None, simplified: Column | None = None, rejected: Column | None = None) -> Column:
    """The array of reasons of a row of ``with_values``.

    reading, simplified: what a dictionary reads a zh headword as, and whether it has simplified
    characters. rejected: 0-based positions that a judge rejected, counted without the repeats.
    """
    c = F.col
    ko, zh = lang == "ko", lang == "zh"
    embedded = hanja_of(c("headword"))
    blank_second = is_blank(c("secondary"))
    out = [
        _reason("missing_hanja_for_sino", ko & blank_second & (c("headword") != "") & (embedded != ""), F.concat(F.lit("embedded "), embedded)),
        _reason("missing_hanja_for_sino", ko & blank_second & (embedded == "") & c("headword").rlike(INLINE_HANJA), F.lit("inline annotation in the headword")),
    ]
    if reading is not None:
        read, stored = strip(blank_if_null(reading)), strip_html(c("secondary"))
        known = zh & (cards.bare_text(c("headword")) != "") & (read != "")
        differs = count_syllables(stored) != count_cjk(cards.bare_text(c("headword")))
        if simplified is not None:
            differs = differs | (simplified & (reading_key(stored) != reading_key(read)))
        out += [
            _reason("missing_jyutping", known & blank_second, read),
            _reason("wrong_jyutping", known & ~blank_second & differs, F.concat(stored, F.lit(" -> "), read)),
        ]
    out.append(_reason("empty_english", is_blank(c("english")), F.lit("blank English")))
    if include_empty_hanja:
        out.append(_reason("empty_hanja_optional", ko & blank_second & (c("headword") != "") & (embedded == ""), F.lit("Hangul-only")))
    blocks = cards.count_blocks(c("sentence"))
    if target > 0:
        out.append(_reason("too_few_sentences", blocks < target, F.concat(blocks.cast("string"), F.lit(f"<{target}"))))
    part, plain = cards.sentences_part(c("sentence")), cards.is_plain_text(c("sentence"))
    shown = F.when(ko, cards.every_sentence_highlights(part, c("headword"), "ko")).otherwise(cards.every_sentence_highlights(part, c("headword"), "zh"))
    out.append(_reason("keyword_not_highlighted", ~is_blank(part) & ~plain & ~shown, F.concat(F.lit("no related red <span> for "), c("headword"))))
    out.append(_reason("plain_text_sentences", plain, F.lit("no <span> tags")))
    if include_missing_notes:
        block = cards.notes_block(c("sentence"))
        asked = F.lit(target > 0) | ~is_blank(part)
        empty = strip_html(block) == ""
        out.append(_reason("missing_context_notes", asked & ((block == "") | empty), F.when(block == "", "no notes block").otherwise("empty notes block")))
    if check_content:
        repeats = cards.repeated_positions(c("sentence_keys"))
        out.append(_reason("duplicate_sentences", F.size(repeats) > 0, encode_indices(repeats)))
        if rejected is not None:
            # the judge saw the sentences without repeats: its positions map back to the card's
            left = F.filter(F.transform(c("sentence_keys"), lambda _, i: i), lambda i: ~F.array_contains(repeats, i))
            own = F.filter(F.transform(rejected, lambda j: F.get(left, j)), lambda i: i.isNotNull())
            few = blocks < target if target > 0 else F.lit(False)
            out.append(_reason("sentence_quality", ~few & ~plain & (F.size(own) > 0), encode_indices(own)))
    return F.array_compact(F.array(*out))


def audit(notes: DataFrame, overrides: Mapping[str, Mapping[str, str]] | None = None, **options) -> DataFrame:
    """Flagged notes with lang, resolved and reasons; notes of no known shape are left out."""
    known = notes.withColumn("lang", detect_lang(F.col("fields"))).filter("lang IS NOT NULL")
    known = known.withColumn("resolved", resolve_fields(F.col("lang"), F.col("model_name"), overrides))
    ready = with_values(known.filter(resolvable(F.col("fields"), F.col("resolved"))))
    if options.get("check_content"):
        ready = keyed_sentences(ready)
    # a generator, so that the filter above it doesn't repeat the rules
    return ready.select("*", F.explode(F.array(reasons(F.col("lang"), **options))).alias("reasons")).filter(F.size("reasons") > 0)


def keyed_sentences(ready: DataFrame) -> DataFrame:
    """Adds sentence_keys. Case folding needs Python, which sees each note's sentences as one text."""
    joined = F.transform(cards.plain_sentences(F.col("sentence")), lambda s: cards.strip_markers(s))

    def keys(lists: pd.Series) -> pd.Series:
        return lists.map(lambda xs: [" ".join(unicodedata.normalize("NFC", x).split()).casefold() for x in (xs if xs is not None else [])])

    return ready.withColumn("sentence_keys", F.pandas_udf(keys, "array<string>")(joined))


def skipped_models(notes: DataFrame, overrides: Mapping[str, Mapping[str, str]] | None = None) -> DataFrame:
    """(model_name, n) of notes of a known language whose fields don't resolve."""
    known = notes.withColumn("lang", detect_lang(F.col("fields"))).filter("lang IS NOT NULL")
    known = known.withColumn("resolved", resolve_fields(F.col("lang"), F.col("model_name"), overrides))
    return known.filter(~resolvable(F.col("fields"), F.col("resolved"))).groupBy("model_name").agg(F.count("*").alias("n"))


def summarize(audited: DataFrame) -> DataFrame:
    """(code, n) over all reasons."""
    return audited.select(F.explode("reasons").alias("r")).groupBy(F.col("r.code").alias("code")).agg(F.count("*").alias("n"))


def has_code(*codes: str) -> Column:
    return F.exists("reasons", lambda r: r["code"].isin(*codes))


def rejected_positions(n: Column) -> Column:
    """0-based positions below ``n`` that the reasons ask to replace."""
    listed = F.transform(F.filter("reasons", lambda r: r["code"].isin("duplicate_sentences", "sentence_quality")), lambda r: parse_indices(r["detail"]))
    return F.filter(F.array_distinct(F.flatten(listed)), lambda i: i < n)
