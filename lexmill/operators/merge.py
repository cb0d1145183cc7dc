"""Merging of per-chunk results in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.cards import example_key
from lexmill.functions.clean import split_hanja
from lexmill.functions.patterns import normalize_pattern, pattern_key


def merge_words(words: DataFrame, lang: str) -> DataFrame:
    """(ord, word) of each different word by first position; for ko an annotated form wins over a bare one."""
    if lang != "ko":
        return words.groupBy("word").agg(F.min("ord").alias("ord")).select("ord", "word")
    bare, hanja = split_hanja(F.col("word"))
    keyed = words.select("ord", "word", bare.alias("bare"), (hanja != "").alias("annotated"))
    return merge_annotated(keyed)


def merge_annotated(keyed: DataFrame) -> DataFrame:
    """From (ord, word, bare, annotated): first position per bare word, first annotated form if any."""
    first_annotated = F.min_by(F.when(F.col("annotated"), F.col("word")), F.when(F.col("annotated"), F.col("ord")))
    return keyed.groupBy("bare").agg(F.min("ord").alias("ord"), F.coalesce(first_annotated, F.min_by("word", "ord")).alias("word"))


def merge_grammar(items: DataFrame, lang: str = "ko") -> DataFrame:
    """One item per pattern key, from (ord, pattern, meaning, explanation, hanja, examples).

    The first sighting gives pattern, meaning and explanation; a blank hanja takes the first later one
    that isn't; examples follow one another without repeats. On the first sighting an example's key
    has no markers, on later ones it keeps them.
    """
    keyed = items.withColumn("key", pattern_key(F.col("pattern"), lang)).withColumn("shown", normalize_pattern(F.col("pattern"), lang))
    heads = keyed.groupBy("key").agg(
        F.min("ord").alias("ord"),
        F.min_by(F.struct("shown", "meaning", "explanation"), "ord").alias("head"),
        F.coalesce(F.min_by("hanja", F.when(F.trim("hanja") != "", F.col("ord"))), F.lit("")).alias("hanja"),
    )
    flat = keyed.select("key", "ord", F.posexplode_outer("examples").alias("pos", "ex")).join(heads.select("key", F.col("ord").alias("first")), "key")
    target = F.col("ex.target")
    named = flat.filter(F.col("ex").isNotNull()).withColumn("name", F.when(F.col("ord") == F.col("first"), example_key(target)).otherwise(example_key(target, marked=False)))
    once = named.filter("name <> ''").groupBy("key", "name").agg(F.min(F.struct("ord", "pos")).alias("at"), F.min_by("ex", F.struct("ord", "pos")).alias("ex"))
    lists = once.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "ex"))), lambda x: x["ex"]).alias("examples"))
    joined = heads.join(lists, "key", "left")
    empty = F.array().cast(items.schema["examples"].dataType)
    return joined.select("ord", F.col("head.shown").alias("pattern"), "head.meaning", "head.explanation", "hanja", F.coalesce("examples", empty).alias("examples"))


def first_examples(examples: Column, n: int) -> Column:
    """The first n examples; all of them if n isn't positive."""
    return examples if n <= 0 else F.slice(examples, 1, n)
