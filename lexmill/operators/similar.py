"""Exact similarity joins over terms, and clusters of similar terms.

No pair is compared unless a rule's own key brings it together: variant keys, one-deletion
neighbourhoods, a term's rarest bigram, stems, and prefixes of rare-first token lists. Each rule's
keys find a superset of the pairs it accepts, so the verdicts equal those of comparing all pairs.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import hangul
from lexmill.functions.patterns import has_notation
from lexmill.functions.strings import let, term_key, vectorised
from lexmill.operators.rows import first_seen
from lexmill.operators.rows import numbered as numbered_rows
from lexmill.sinks.scratch import written

#: Tolerance of the upper bound, so that rounding never drops a pair.
SLACK = 1e-9
#: Jaccard overlap from which zh terms share a stem.
STEM_OVERLAP = 0.6
SCHEMA = "ord_a long, ord_b long, a string, b string, reason string, score double, source string"


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def numbered(chars: Column) -> Column:
    """Each character with how often it stood before: a multiset as a set."""
    return F.transform(chars, lambda c, i: F.concat(c, F.size(F.filter(F.slice(chars, F.lit(1), i), lambda d: d == c)).cast("string")))


def prepare(terms: DataFrame, lang: str) -> DataFrame:
    """Comparison columns of (ord, term), once per term."""
    base = terms.select("ord", "term", term_key(F.col("term")).alias("norm")).filter("norm <> ''")
    split = lambda chars, u: F.struct(u.alias("units"), F.array_distinct(chars).alias("letters"), numbered(chars).alias("bag"), F.size(chars).alias("n"), (hangul.stem(u) if lang == "ko" else F.lit("")).alias("stem"))
    made = let(hangul.units(F.col("norm"), lang), lambda u: let(characters(u), lambda chars: split(chars, u)))
    keyed = base.select("ord", "term", "norm", F.explode(F.array(made)).alias("p"))
    return keyed.select(
        "ord", "term", "norm", "p.units", "p.letters", "p.bag", "p.n", F.length("norm").alias("n_norm"), "p.stem",
        has_notation(F.col("norm")).alias("notation"), hangul.variant_keys(F.col("norm")).alias("variants"),
    )


@vectorised("double")
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio; null inputs stay null. It depends on the order of its arguments."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


@vectorised("double")
def rounded(x: pd.Series) -> pd.Series:
    """Three decimals, half to even on the exact binary value."""
    return x.map(lambda v: round(v, 3), na_action="ignore")


def _rare_first(prepared: DataFrame, column: str) -> DataFrame:
    """(ord, n_set, token, rank): each term's tokens, the globally rarest first."""
    flat = prepared.select("ord", F.size(column).alias("n_set"), F.explode(column).alias("token"))
    counts = flat.groupBy("token").agg(F.count("*").alias("f"))
    order = Window.partitionBy("ord").orderBy("f", "token")
    return flat.join(counts, "token").select("ord", "n_set", "token", F.row_number().over(order).alias("rank"))


def _prefix_pairs(ranked: DataFrame, share: float, needed: float) -> DataFrame:
    """Pairs whose rare-first lists may share ``needed`` times the sum of their sizes.

    A list's prefix is the part of which any partner sharing ``share`` of it holds one token. The first
    token that two lists share also bounds what they can share after it, which the filter asks for.
    """
    kept = ranked.filter(F.col("rank") <= F.col("n_set") - F.ceil(F.col("n_set") * F.lit(share) - F.lit(SLACK)) + 1)
    other = kept.select("token", F.col("ord").alias("other"), F.col("n_set").alias("m_set"), F.col("rank").alias("place"))
    left = F.least(F.col("n_set") - F.col("rank"), F.col("m_set") - F.col("place")) + 1
    met = kept.join(other, "token").filter((F.col("ord") < F.col("other")) & (left >= F.lit(needed) * (F.col("n_set") + F.col("m_set")) - F.lit(SLACK)))
    return met.select(F.col("ord").alias("ord_a"), F.col("other").alias("ord_b"))


def _neighbours(prepared: DataFrame, least: int) -> DataFrame:
    """Terms and all their one-deletions."""
    deleted = F.transform(F.sequence(F.lit(1), F.length("units")), lambda i: F.concat(F.substr("units", F.lit(1), i - 1), F.substr("units", i + 1)))
    return prepared.filter(F.col("n") >= least).select("ord", F.explode(F.array_distinct(F.concat(F.array("units"), deleted))).alias("key"))


def _bigrams(text: Column) -> Column:
    return F.when(F.length(text) >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substr(text, i, F.lit(2))))).otherwise(F.array().cast("array<string>"))


def _met(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right.withColumnRenamed("ord", "other"), "key").filter("ord <> other").select(F.least("ord", "other").alias("ord_a"), F.greatest("ord", "other").alias("ord_b"))


def candidates(prepared: DataFrame, lang: str, threshold: float) -> DataFrame:
    """Distinct (ord_a < ord_b) that some rule may accept, for thresholds above 0."""
    keys = prepared.select("ord", "notation", F.explode("variants").alias("key"))
    found = [_met(keys.filter("notation").select("ord", "key"), keys.select("ord", "key"))]
    near = _neighbours(prepared, 2 if lang == "zh" else 3)
    found.append(_met(near, near))
    grams = prepared.select("ord", F.explode(_bigrams(F.col("norm"))).alias("key"))
    counts = grams.groupBy("key").agg(F.count("*").alias("f"))
    rarest = grams.join(counts, "key").groupBy("ord").agg(F.min(F.struct("f", "key")).alias("g")).select("ord", F.col("g.key").alias("key"))
    found.append(_met(rarest, grams))
    if lang == "ko":
        stems = prepared.filter(F.length("stem") >= 2).select("ord", F.col("stem").alias("key"))
        found.append(_met(stems, stems))
    else:
        found.append(_prefix_pairs(_rare_first(prepared.filter("n_norm >= 2"), "letters"), STEM_OVERLAP, STEM_OVERLAP / (1 + STEM_OVERLAP)))
    found.append(_prefix_pairs(_rare_first(prepared, "bag"), threshold / (2 - threshold), threshold / 2))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.distinct()


def classify(pairs: DataFrame, lang: str, threshold: float) -> DataFrame:
    """Adds reason and score to rows with columns x_a and x_b; rows that no rule accepts drop.

    The ratio, the only step outside the JVM, gets a value only where a rule still needs it.
    """
    c = F.col
    shares = F.arrays_overlap("letters_a", "letters_b") if threshold > 0 else F.lit(True)
    variant = (c("notation_a") | c("notation_b")) & F.coalesce(F.arrays_overlap("variants_a", "variants_b"), F.lit(False))
    near = (F.least("n_a", "n_b") >= (2 if lang == "zh" else 3)) & (F.levenshtein("units_a", "units_b", 1) == 1)
    within = (F.least("n_norm_a", "n_norm_b") >= 2) & F.when(c("n_norm_a") <= c("n_norm_b"), F.contains("norm_b", "norm_a")).otherwise(F.contains("norm_a", "norm_b"))
    overlap = F.size(F.array_intersect("letters_a", "letters_b")) / F.size(F.array_union("letters_a", "letters_b"))
    stem = (F.length("stem_a") >= 2) & (c("stem_a") == c("stem_b")) if lang == "ko" else (F.least("n_norm_a", "n_norm_b") >= 2) & (overlap >= STEM_OVERLAP)
    bound = 2.0 * F.size(F.array_intersect("bag_a", "bag_b")) / (c("n_a") + c("n_b"))
    fuzzy = bound >= threshold - SLACK if threshold > 0 else F.lit(True)
    reason = F.when(variant, "notation-variant").when(~shares, None).when(near, "near-identical").when(within, "containment").when(stem, "shared-stem").when(fuzzy, "fuzzy")
    by_ratio = ["near-identical", "fuzzy", *(["shared-stem"] if lang == "ko" else [])]
    judged = pairs.withColumn("reason", reason).filter(c("reason").isNotNull())
    asked = c("reason").isin(by_ratio)
    judged = judged.withColumn("__ratio", ratio(F.when(asked, c("units_a")), F.when(asked, c("units_b"))))
    exact = F.when(c("reason") == "notation-variant", 1.0).when(c("reason") == "containment", F.least("n_norm_a", "n_norm_b") / F.greatest("n_norm_a", "n_norm_b")).when(asked, c("__ratio")).otherwise(overlap)
    judged = judged.filter((c("reason") != "fuzzy") | (c("__ratio") >= threshold))
    return judged.withColumn("score", rounded(exact)).drop("__ratio")


def _sided(prepared: DataFrame, side: str) -> DataFrame:
    return prepared.select(*[F.col(x).alias(f"{x}_{side}") for x in prepared.columns])


def find_similar(terms: DataFrame, lang: str, threshold: float = 0.8, deck: DataFrame | None = None) -> DataFrame:
    """Similar pairs among ``terms`` (ord, term), and between them and a deck's terms (term).

    ord_b of a deck term is its place in code-point order. ``ranked`` puts the rows in report order.
    """
    own = first_seen(terms, term_key(F.col("term")), "ord")
    prepared = prepare(own, lang)
    if deck is None:
        cards = prepared.limit(0)
    else:
        # cards sort after all input terms, in code-point order; one row a different term
        cards = prepare(deck.select(F.lit(0).cast("bigint").alias("ord"), "term").distinct(), lang).dropDuplicates(["norm"])
        cards = numbered_rows(cards.drop("ord"), "norm").withColumn("ord", F.col("ord") + 1 + 2**40).select(*prepared.columns)
    everything = written(prepared.unionByName(cards), "terms")  # read by every rule; prepared once
    if threshold > 0:
        met = candidates(everything, lang, threshold)
    else:  # every pair is an answer, so every pair is made
        met = everything.select(F.col("ord").alias("ord_a")).join(everything.select(F.col("ord").alias("ord_b")), F.col("ord_a") < F.col("ord_b"))
    met = met.filter(F.col("ord_a") < 2**40)
    pairs = met.join(_sided(everything, "a"), "ord_a").join(_sided(everything, "b"), "ord_b").filter("norm_a <> norm_b")
    source = F.when(F.col("ord_b") >= 2**40, "anki").otherwise("input")
    out = classify(pairs, lang, threshold).select("ord_a", F.when(F.col("ord_b") >= 2**40, F.col("ord_b") - 2**40).otherwise(F.col("ord_b")).alias("ord_b"), F.col("term_a").alias("a"), F.col("term_b").alias("b"), "reason", "score", source.alias("source"))
    return out


def ranked(pairs: DataFrame) -> DataFrame:
    """Pairs by falling score; ties keep the order of generation, input pairs before deck pairs."""
    return pairs.orderBy(F.desc("score"), F.col("source") != "input", "ord_a", "ord_b")


def components(pairs: DataFrame, a: str = "a", b: str = "b", rounds: int = 64) -> DataFrame:
    """(term, root): the least term that each term of the pairs reaches, by label propagation with
    pointer jumping; each round is cut from its lineage in the folder of spark.checkpoint.dir."""
    both = pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).union(pairs.select(F.col(b), F.col(a))).distinct()
    links = written(both, "links")
    labels = written(links.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("root")).withColumnRenamed("u", "term"), "labels")
    for k in range(rounds):
        around = links.join(labels, links.v == labels.term).groupBy("u").agg(F.min("root").alias("low"))
        lower = labels.join(around, labels.term == around.u, "left").select("term", "root", F.least("root", F.coalesce("low", "root")).alias("new"))
        jump = labels.select(F.col("term").alias("t"), F.col("root").alias("r"))
        now = written(lower.join(jump, F.col("new") == F.col("t"), "left").select("term", "root", F.least("new", F.coalesce("r", "new")).alias("new")), f"labels{k}")
        changed = now.filter("new <> root").isEmpty()
        labels = now.select("term", F.col("new").alias("root"))
        if changed:
            return labels
    raise RuntimeError("components did not settle")


def clusters(pairs: DataFrame) -> DataFrame:
    """(cluster_id, members, size, keep): members by code point; the least (length, term) is kept."""
    found = components(pairs)
    members = found.groupBy("root").agg(F.array_sort(F.collect_set("term")).alias("members"))
    keep = F.array_min(F.transform("members", lambda m: F.struct(F.length(m).alias("n"), m.alias("m"))))["m"]
    return members.select(F.col("root").alias("cluster_id"), "members", F.size("members").alias("size"), keep.alias("keep"))


def suggested_keep(cluster_members: DataFrame, deck: DataFrame) -> DataFrame:
    """Per cluster the first member that the deck has, else the least by (length, term)."""
    known = deck.select(term_key(F.col("term")).alias("__k")).distinct()
    placed = cluster_members.withColumn("__t", term_key(F.col("term"))).join(known, F.col("__t") == F.col("__k"), "left")
    return placed.groupBy("cluster_id").agg(F.coalesce(F.min(F.when(F.col("__k").isNotNull(), F.col("term"))), F.min_by("term", F.struct(F.length("term"), F.col("term")))).alias("keep"))
