"""Connected components of links by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.scratch import Scratch


def components(links: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """(id, component): the least id each linked id reaches, from rows (a, b) of longs.

    Only minima per node and joins on nodes are used; no node's neighbours are gathered, and each
    round's edges are a written table. The number of rounds grows with the logarithm of the size.
    """
    ordered = links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = scratch.write(ordered, f"{label}0")
    k = 0
    while True:
        child = edges.groupBy("a").agg(F.count("*").alias("n"))
        nested = edges.select(F.col("b").alias("a")).distinct().join(child, "a", "left_semi")
        if child.filter("n > 1").isEmpty() and nested.isEmpty():
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = scratch.write(large, f"{label}{k}-large")
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a <> b").distinct()
        edges = scratch.write(small, f"{label}{k + 1}")
        scratch.drop(f"{label}{k}")
        scratch.drop(f"{label}{k}-large")
        k += 1
