"""Whole-text statistics as DataFrame expressions, one pass over the text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.scratch import SEPARATORS, count_chars, words_of

#: Symbol characters of the base rules.
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def text_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and counts of every whole text; a null text counts as empty.

    n_repeat_words: words inside 3-word windows that occur twice or more. Windows are told apart by
    a 64-bit hash of their three words. Only texts with a repeated window (an O(n) set size shows
    it) sort their windows with positions; equal neighbours then give the covered words.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    none = F.array().cast("array<bigint>")
    first = docs.select(F.col("doc_id"), body.alias("__text")).withColumn("__w", words_of(F.col("__text")))
    window = lambda i: F.xxhash64(F.get("__w", i), F.get("__w", i + 1), F.get("__w", i + 2))
    lines = F.filter(F.split("__text", "\n"), lambda x: F.btrim(x, F.lit(SEPARATORS)) != "")
    counted = first.select(
        "doc_id",
        F.size("__w").cast("bigint").alias("n_words"),
        F.length(F.translate("__text", SEPARATORS, "")).cast("bigint").alias("word_chars"),
        count_chars(F.col("__text"), SYMBOLS).cast("bigint").alias("n_symbols"),
        count_chars(F.col("__text"), UPPER).cast("bigint").alias("n_upper"),
        count_chars(F.col("__text"), "!?").cast("bigint").alias("n_bangs"),
        lines.alias("__lines"),
        F.when(F.size("__w") >= 3, F.transform(F.sequence(F.lit(0), F.size("__w") - 3), window)).otherwise(none).alias("__h"),
    )
    counted = counted.withColumns({
        "n_lines": F.size("__lines").cast("bigint"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint"),
        "__s": F.when(F.size(F.array_distinct("__h")) < F.size("__h"), F.sort_array(F.transform("__h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))),
    })
    same = lambda a, b: F.coalesce(F.get("__s", a)["h"] == F.get("__s", b)["h"], F.lit(False))
    twice = F.filter("__s", lambda _, j: same(j, j - 1) | same(j, j + 1))
    counted = counted.withColumn("__p", F.when(F.col("__s").isNotNull(), F.transform(twice, lambda x: x["i"])))
    shifted = lambda n: F.transform("__p", lambda p: p + n)
    covered = F.size(F.array_union(F.array_union(F.col("__p"), shifted(1)), shifted(2)))
    return counted.select(
        "doc_id", *BASE[:4], F.when(F.col("__p").isNull(), F.lit(0)).otherwise(covered).cast("bigint").alias("n_repeat_words"),
        "n_upper", "n_bangs", "n_lines",
    )


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


def ratios() -> dict[str, Column]:
    """Length-free measures of a row of ``text_stats``; 0 for empty texts."""
    return {
        "symbols_per_word": _share("n_symbols", "n_words"),
        "dup_line_share": _share("n_dup_lines", "n_lines"),
        "repeat_word_share": _share("n_repeat_words", "n_words"),
        "mean_word_chars": _share("word_chars", "n_words"),
        "upper_share": _share("n_upper", "word_chars"),
        "bang_share": _share("n_bangs", "word_chars"),
    }
