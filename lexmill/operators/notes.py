"""Note collections as relations: deck subtrees, note types, deck words and deck notes.

Inputs are DataFrames: notes (id, guid, mid, flds), cards (nid, did), decks (id, name), and note types
in either of two physical forms. Fields of a note are one string joined with U+001F.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.strings import nfc, strip

FIELD_SEPARATOR = "\x1f"
LEGACY_MODELS = "map<string,struct<name:string,flds:array<struct<name:string,ord:int>>>>"
LEGACY_DECKS = "map<string,struct<name:string>>"


def legacy_decks(col: DataFrame) -> DataFrame:
    """(did, name) from the JSON column of the legacy form."""
    return col.select(F.explode(F.from_json("decks", LEGACY_DECKS)).alias("id", "d")).select(F.col("id").cast("bigint").alias("did"), F.col("d.name").alias("name"))


def legacy_schemas(col: DataFrame) -> DataFrame:
    """(mid, name, field_order) from the JSON column of the legacy form."""
    flat = col.select(F.explode(F.from_json("models", LEGACY_MODELS)).alias("id", "m"))
    ordered = F.array_sort(F.transform(F.col("m.flds"), lambda f: F.struct(F.coalesce(f["ord"], F.lit(0)).alias("ord"), f["name"].alias("name"))))
    return flat.select(F.col("id").cast("bigint").alias("mid"), F.col("m.name").alias("name"), F.transform(ordered, lambda f: f["name"]).alias("field_order"))


def table_schemas(notetypes: DataFrame, fields: DataFrame) -> DataFrame:
    """(mid, name, field_order) from the tables of the newer form."""
    lists = fields.groupBy(F.col("ntid").alias("mid")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda f: f["name"]).alias("field_order"))
    return lists.join(notetypes.select(F.col("id").alias("mid"), "name"), "mid", "left").select("mid", F.coalesce("name", F.lit("")).alias("name"), "field_order")


def union_first_wins(*tables: DataFrame, key: str) -> DataFrame:
    """Rows of all tables; of equal keys the one of the earliest table."""
    ranked = None
    for k, t in enumerate(tables):
        part = t.withColumn("__rank", F.lit(k))
        ranked = part if ranked is None else ranked.unionByName(part)
    first = F.row_number().over(Window.partitionBy(key).orderBy("__rank"))
    return ranked.withColumn("__n", first).filter("__n = 1").drop("__n", "__rank")


def first_non_empty(*tables: DataFrame) -> DataFrame:
    """The first table that has rows, else the last."""
    for t in tables[:-1]:
        if not t.isEmpty():
            return t
    return tables[-1]


def subtree(name: Column, deck: Column | str) -> Column:
    """Whether a deck is ``deck`` or lies under it."""
    deck = F.lit(deck) if isinstance(deck, str) else deck
    return (name == deck) | F.startswith(name, F.concat(deck, F.lit("::")))


def deck_ids(deck: str, newer: DataFrame, legacy: DataFrame) -> DataFrame:
    """Ids of a deck and what lies under it; the newer form decides if it matches anything."""
    return first_non_empty(*[t.filter(subtree(F.col("name"), deck)).select("did") for t in (newer, legacy)])


def deck_cards(notes: DataFrame, cards: DataFrame, decks: DataFrame) -> DataFrame:
    """Notes with a card in one of ``decks`` (did), a row a card."""
    chosen = cards.join(decks.select(F.col("did").alias("__did")), F.col("did") == F.col("__did"), "left_semi").select(F.col("nid").alias("__nid"), "did")
    return notes.join(chosen, F.col("id") == F.col("__nid")).drop("__nid")


def deck_words(notes: DataFrame, cards: DataFrame, decks: DataFrame, field: int | str = 0, schemas: DataFrame | None = None) -> DataFrame:
    """Distinct terms of one field, by number or by name per note type."""
    rows = deck_cards(notes, cards, decks).select("mid", "flds").distinct()
    at = F.lit(field) if isinstance(field, int) else F.col("__at")
    if isinstance(field, str):
        named = schemas.select("mid", (F.array_position("field_order", field) - 1).cast("int").alias("__at")).filter("__at >= 0")
        rows = rows.join(named, "mid")
    value = nfc(strip(F.coalesce(F.get(F.split("flds", FIELD_SEPARATOR), at), F.lit(""))))
    return rows.select(value.alias("term")).filter("term <> ''").distinct()


def named_fields(values: Column, order: Column) -> Column:
    """Names of a note's values: the note type's, then field{i} for values beyond them."""
    known = F.coalesce(order, F.array().cast("array<string>"))
    extra = F.when(F.size(values) > F.size(known), F.transform(F.sequence(F.size(known), F.size(values) - 1), lambda i: F.concat(F.lit("field"), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    return F.slice(F.concat(known, extra), F.lit(1), F.size(values))


def zip_fields(names: Column, values: Column) -> Column:
    """map of names to values; of a repeated name the last value."""
    last = F.filter(F.arrays_zip(names.alias("n"), values.alias("v")), lambda x: x["n"].isNotNull())
    keep = F.filter(last, lambda x, i: ~F.exists(F.slice(F.transform(last, lambda y: y["n"]), i + 2, F.size(last)), lambda n: n == x["n"]))
    return F.map_from_entries(F.transform(keep, lambda x: F.struct(x["n"], x["v"])))


def deck_notes(notes: DataFrame, cards: DataFrame, decks: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row a note with its least matching deck, field order and field map."""
    once = deck_cards(notes, cards, decks).groupBy("id", "guid", "mid", "flds").agg(F.min("did").alias("deck_id"))
    typed = once.join(schemas.select("mid", F.col("name").alias("model_name"), "field_order"), "mid", "left")
    values = F.split("flds", FIELD_SEPARATOR)
    typed = typed.withColumn("field_order", named_fields(values, F.col("field_order")))
    return typed.select(F.col("id").alias("nid"), "guid", "mid", F.coalesce("model_name", F.lit("")).alias("model_name"), "deck_id", "field_order", zip_fields(F.col("field_order"), values).alias("fields"))


def model_names(ids: DataFrame, schemas: DataFrame) -> DataFrame:
    """(mid, name) for ids, with a stand-in for unknown note types."""
    named = ids.join(schemas.select("mid", "name"), "mid", "left")
    return named.select("mid", F.coalesce(F.nullif(F.col("name"), F.lit("")), F.concat(F.lit("model "), F.col("mid").cast("string"))).alias("name"))
