"""Selective repair of audited notes: one plan of boolean columns that both the cost estimate and
the repair read, so that what is estimated is what is done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import cards
from lexmill.functions.clean import split_hanja
from lexmill.functions.strings import blank_if_null, escape, estimate_tokens, is_blank, resolve_hanja, strip, strip_html, tsv_safe
from lexmill.models import prompts
from lexmill.operators.audit import SENTENCE_CODES, has_code, rejected_positions

CALLS = ("translate", "sentence", "remark", "notes")


def local_hanja(headword: Column) -> Column:
    word, inline = split_hanja(headword)
    return resolve_hanja(inline, word)


def lacks_headword(sentence: Column, headword: Column) -> Column:
    return ~cards.has_markers(sentence) & (headword != "") & ~F.contains(sentence, headword)


def plan(audited: DataFrame, target: int) -> DataFrame:
    """Adds what each note needs: sentences left, how many more, and the calls as 0 or 1."""
    c = F.col
    ko = c("lang") == "ko"
    sentences = cards.marked_sentences(c("sentence"))
    noted = audited.withColumn("__all", sentences).withColumn("__bad", rejected_positions(F.size("__all")))
    wants = has_code(*SENTENCE_CODES)
    kept = F.filter("__all", lambda s, i: ~F.array_contains(c("__bad"), i))
    noted = noted.withColumn("kept_sentences", F.when(wants, kept).otherwise(F.array().cast("array<string>")))
    needed = F.greatest(F.lit(target) - F.size("kept_sentences"), F.lit(0)) if target > 0 else F.lit(0)
    topping = has_code("too_few_sentences") | (F.size("__bad") > 0)
    noted = noted.withColumn("needed", F.when(wants & topping, needed).otherwise(0))
    translate = has_code("empty_english") | (ko & has_code("empty_hanja_optional")) | (ko & has_code("missing_hanja_for_sino") & (local_hanja(c("headword")) == ""))
    remark = wants & F.exists("kept_sentences", lambda s: lacks_headword(s, c("headword")))
    alone = has_code("missing_context_notes") & (c("needed") == 0) & (F.lit(target > 0) | ~is_blank(cards.sentences_part(c("sentence"))))
    return noted.withColumns({
        "translate": translate.cast("int"), "sentence_call": (c("needed") > 0).cast("int"), "remark": remark.cast("int"), "notes": alone.cast("int"),
    }).drop("__all", "__bad")


def input_tokens() -> Column:
    """Prompt tokens of a planned note's calls."""
    c = F.col
    unmarked = F.array_join(F.filter("kept_sentences", lambda s: lacks_headword(s, c("headword"))), "\n")
    parts = {
        "translate": prompts.translation(c("headword"), c("lang")),
        "notes": prompts.notes(c("headword"), c("lang"), strip_html(c("english"))),
        "sentence_call": prompts.sentences(c("headword"), c("lang"), c("needed")),
        "remark": prompts.remark(c("headword"), c("lang"), unmarked),
    }
    total = F.lit(0)
    for call, (system, user) in parts.items():
        total = total + F.when(c(call) == 1, estimate_tokens(system) + estimate_tokens(user)).otherwise(0)
    return total


def estimate(audited: DataFrame, target: int, max_output_tokens: int = 4096, rpm: int = 50) -> DataFrame:
    """One row: notes, calls of each kind, their total, input tokens, output ceiling, minutes at ``rpm``."""
    planned = plan(audited, target).withColumn("__tokens", input_tokens())
    one = lambda name: F.coalesce(F.sum(name), F.lit(0)).cast("bigint")
    row = planned.agg(
        F.count("*").alias("notes"), one("translate").alias("translate_calls"), one("sentence_call").alias("sentence_calls"),
        one("remark").alias("remark_calls"), one("notes").alias("context_notes_calls"), one("__tokens").alias("input_tokens"),
    ).withColumn("total_calls", F.col("translate_calls") + F.col("sentence_calls") + F.col("remark_calls") + F.col("context_notes_calls"))
    return row.withColumn("output_ceiling", F.col("total_calls") * max_output_tokens).withColumn("minutes", F.col("total_calls") / rpm if rpm > 0 else F.lit(0.0))


def repair(planned: DataFrame, answers: DataFrame, target: int, reading: Column | None = None) -> DataFrame:
    """Notes with new field maps and the list of fields touched.

    answers: guid with translation, hanja, sentences (array), remarked (array like kept_sentences),
    notes, or nulls where no call was made or it failed; a failed note keeps its fields. The headword
    never changes.
    """
    c = F.col
    rows = planned.join(answers.withColumnsRenamed({n: f"a_{n}" for n in ("translation", "hanja", "sentences", "remarked", "notes", "error")}), "guid", "left")
    ko = c("lang") == "ko"
    filled = F.when(ko & has_code("missing_hanja_for_sino", "empty_hanja_optional"), F.coalesce(F.nullif(local_hanja(c("headword")), F.lit("")), blank_if_null(c("a_hanja"))))
    if reading is not None:
        filled = F.coalesce(filled, F.when(has_code("missing_jyutping", "wrong_jyutping"), strip(blank_if_null(reading))))
    second = F.coalesce(F.nullif(filled, F.lit("")), c("secondary"))
    english = F.when(has_code("empty_english") & ~is_blank(c("a_translation")), escape(strip(c("a_translation")))).otherwise(c("english"))
    body = F.concat(F.coalesce("a_remarked", "kept_sentences"), F.coalesce("a_sentences", F.array().cast("array<string>")))
    old_block = cards.notes_block(c("sentence"))
    added = F.when((c("notes") == 1) | (has_code("missing_context_notes") & (c("sentence_call") == 1)), cards.context_notes(c("a_notes"))).otherwise(F.lit(""))
    block = F.coalesce(F.nullif(added, F.lit("")), old_block)
    wants = has_code(*SENTENCE_CODES)
    made = F.when(wants & (F.size(body) > 0), F.concat(block, cards.sentence_list(body, c("headword"))))
    made = F.coalesce(made, F.when(added != "", F.concat(added, cards.sentences_part(c("sentence")))), c("sentence"))
    changes = {"secondary": second, "english": english, "sentence": made}
    ok = c("a_error").isNull()

    def changed(name: Column, old: Column) -> Column:
        out = F.when(~ok | (name == c("resolved.headword")), old)
        for role, new in changes.items():
            out = out.when(name == c(f"resolved.{role}"), new)
        return out.otherwise(old)

    fields = F.transform_values("fields", changed)
    touched = F.array_compact(F.array(*[F.when(ok & (new != c(role)), c(f"resolved.{role}")) for role, new in changes.items()]))
    return rows.select(*[x for x in planned.columns if x != "fields"], fields.alias("fields"), touched.alias("touched"), c("a_error").alias("error"))


def deck_label(deck_name: Column, resolved_name: Column) -> Column:
    return F.coalesce(F.nullif(strip(blank_if_null(deck_name)), F.lit("")), F.nullif(strip(blank_if_null(resolved_name)), F.lit("")), F.lit("deck"))


def update_line(notetype: Column, deck: Column, guid: Column, field_order: Column, fields: Column) -> Column:
    """One line of an update file: note type, deck, guid, then the fields in order."""
    values = F.transform(field_order, lambda f: tsv_safe(F.try_element_at(fields, f)))
    return F.array_join(F.concat(F.array(tsv_safe(notetype), tsv_safe(deck), tsv_safe(guid)), values), "\t")
