"""Prompts as (system, user) column pairs; the estimate measures the very texts that would be sent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _language(lang: Column) -> Column:
    return F.when(lang == "ko", "Korean").otherwise("Chinese")


def translation(word: Column, lang: Column) -> tuple[Column, Column]:
    system = F.concat(F.lit("You gloss "), _language(lang), F.lit(' vocabulary for learners. Reply with a JSON object: {"translation": short English gloss, "hanja": Hanja spelling or empty}.'))
    return system, F.concat(F.lit("Word: "), word)


def sentences(word: Column, lang: Column, n: Column) -> tuple[Column, Column]:
    system = F.concat(F.lit("You write short example sentences in "), _language(lang), F.lit('. Put ** around the word as it appears. Reply with a JSON object: {"sentences": [..], "notes": usage remarks or empty}.'))
    return system, F.concat(F.lit("Word: "), word, F.lit("\nNumber of sentences: "), n.cast("string"))


def notes(word: Column, lang: Column, english: Column) -> tuple[Column, Column]:
    system = F.concat(F.lit("You explain when and how a "), _language(lang), F.lit(' word is used. Reply with a JSON object: {"notes": text}.'))
    return system, F.concat(F.lit("Word: "), word, F.lit("\nMeaning: "), english)


def remark(word: Column, lang: Column, lines: Column) -> tuple[Column, Column]:
    system = F.concat(F.lit("You mark where a "), _language(lang), F.lit(' word occurs, in whatever form, with ** around it. Reply with a JSON object: {"sentences": [..]} in the same order.'))
    return system, F.concat(F.lit("Word: "), word, F.lit("\nSentences:\n"), lines)


def grammar(lang: Column) -> Column:
    """The system prompt of grammar extraction; the text itself is the user prompt."""
    item = '{"pattern": .., "meaning": .., "explanation": .., "hanja": .., "examples": [{"target": sentence with ** around the pattern, "english": ..}]}'
    return F.concat(F.lit("List the "), _language(lang), F.lit(f' grammar patterns that a text teaches. Reply with a JSON object: {{"patterns": [{item}]}}.'))
