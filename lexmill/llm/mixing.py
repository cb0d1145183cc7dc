"""Mixing sources to target weights by repetition rates and hash-seeded Bernoulli copies.

Words are added up per source, each source's target divided by its words is its repetition rate,
and a document is emitted floor(rate) times plus one more with the rate's fraction as probability.
The draw compares an MD5 of the document's id and content with the fraction, so reruns agree
on any cluster. Of ``SEEDS`` seeds each source uses the one whose draw ends nearest to its target.

Defined results: sources are ordered by code point with null last; a null text has size 0; a
source without words has target 0 and no copies. Equal rows are drawn alike. An empty table
gives no rows. Columns besides doc_id, source and text pass through ``mix``, whatever their names, and
are not read by ``mix_report``; names that begin with two underscores are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.scratch import Scratch, words_of

#: Sources weigh 1, 2, 3 in turn.
WEIGHT_CYCLE = 3
#: No source is repeated more often than this.
MAX_RATE = 3
#: Seeds tried per source.
SEEDS = 16


def source_targets(sized: DataFrame) -> DataFrame:
    """(source, source_size, target) from rows of (source, size).

    A source is held at ``MAX_RATE`` times its words if its weight asks for more; what it leaves is
    reshared by weight. Sources reach that hold in ascending order of cap / weight, so the level at
    which the rest settles follows from running sums over one row per source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("weight", (F.row_number().over(ranked) - 1) % WEIGHT_CYCLE + 1).withColumn("cap", F.col("source_size") * MAX_RATE)
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    per = (
        per.withColumn("rest", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("rest_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        # the first source, in that order, that its share of the rest doesn't lift over its cap
        .withColumn("settled", F.col("rest") * F.col("weight") <= F.col("cap") * F.col("rest_weight"))
    )
    first = F.min(F.when(F.col("settled"), F.struct((F.col("cap") / F.col("weight")).alias("r"), F.col("source").isNull().alias("z"), F.col("source").alias("s"), F.col("rest"), F.col("rest_weight")))).over(everything)
    per = per.withColumn("level", first).withColumn("held", F.sum(F.col("settled").cast("int")).over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)) == 0)
    share = (F.col("level.rest") * F.col("weight")).cast("double") / F.col("level.rest_weight").cast("double")
    return per.select("source", "source_size", F.when(F.col("held"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def content_name(text: Column) -> Column:
    """Half of the MD5 of a text, a null one being empty."""
    return F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 16)


def _draw(seed: Column, content: Column | None = None) -> Column:
    """A number in [0, 1) from the document's id, its content and the seed."""
    content = F.col("content") if content is None else content
    name = F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), content, seed.cast("string"))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, source, size, content) of every document; size is its number of words."""
    column = F.col(f"`{text}`")
    return docs.select("doc_id", "source", F.size(words_of(column)).cast("bigint").alias("size"), content_name(column).alias("content"))


def plan_sources(sized: DataFrame, scratch: Scratch) -> DataFrame:
    """(source, source_size, target, whole, fraction, seed): a written table of one row per source.

    Its file size lets Spark check whether joins with it can broadcast it.
    """
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rates = source_targets(sized).withColumn("rate", rate)
    rates = scratch.write(rates.select("source", "source_size", "target", F.floor("rate").alias("whole"), (F.col("rate") - F.floor("rate")).alias("fraction")), "rates")
    drawn = with_source(sized, rates)
    one = lambda i: F.sum(F.when(_draw(F.lit(i)) < F.col("fraction"), F.col("size")).otherwise(F.lit(0)))
    sums = drawn.groupBy("source", "source_size", "target", "whole", "fraction").agg(F.sum(F.col("size") * F.col("whole")).alias("sure"), *[one(i).alias(f"s{i}") for i in range(SEEDS)])
    miss = F.array(*[F.struct(F.abs(F.col("sure") + F.col(f"s{i}") - F.col("target")).alias("miss"), F.lit(i).alias("seed")) for i in range(SEEDS)])
    return scratch.write(sums.select("source", "source_size", "target", "whole", "fraction", F.array_min(miss)["seed"].alias("seed")), "plan")


def with_source(docs: DataFrame, per_source: DataFrame) -> DataFrame:
    """``docs`` with its source's columns; null is a source like any other."""
    other = per_source.withColumnRenamed("source", "__source")
    return docs.join(other, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")


def copies() -> Column:
    """How often the mix takes a row that has its source's plan and its content name."""
    return (F.col("whole") + F.when(_draw(F.col("seed")) < F.col("fraction"), 1).otherwise(0)).cast("bigint")


def mix_report(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    sized = scratch.write(measure(docs), "sizes")
    planned = with_source(sized, plan_sources(sized, scratch))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * copies()).alias("taken"))


def mix(docs: DataFrame, scratch: Scratch, text: str = "text") -> DataFrame:
    """The mix itself: each document's row as often as it is taken, with the columns it came with."""
    plan = plan_sources(scratch.write(measure(docs, text), "sizes"), scratch)
    slim = plan.select(*[F.col(c).alias(f"__{c}") for c in ("source", "whole", "fraction", "seed")])
    n = (F.col("__whole") + F.when(_draw(F.col("__seed"), content_name(F.col(f"`{text}`"))) < F.col("__fraction"), 1).otherwise(0)).cast("int")
    taken = docs.join(slim, F.col("source").eqNullSafe(F.col("__source"))).withColumn("__n", n).filter(F.col("__n") > 0)
    return taken.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.array_repeat(F.lit(0), F.col("__n"))).alias("__copy")).drop("__copy")
