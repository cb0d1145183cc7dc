"""Queries of the similarity join and of clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.operators import similar
from lexmill.plans.registry import query, table

NAMES_SQL = "names AS (SELECT p_name AS term, min(p_partkey) AS ord FROM part GROUP BY p_name)"
PAIRS_SQL = """pairs AS (SELECT x.ord AS ord_a, y.ord AS ord_b, x.term AS a, y.term AS b, list_distinct(string_split(x.term, '')) AS la, list_distinct(string_split(y.term, '')) AS lb
  FROM names x JOIN names y ON x.ord < y.ord),
ruled AS (SELECT *, CASE WHEN abs(length(a) - length(b)) <= 1 AND least(length(a), length(b)) >= 2 AND levenshtein(a, b) = 1 THEN 'near-identical'
  WHEN least(length(a), length(b)) >= 2 AND (contains(a, b) OR contains(b, a)) THEN 'containment'
  WHEN len(list_intersect(la, lb)) / len(list_distinct(list_concat(la, lb))) >= 0.6 THEN 'shared-stem' END AS reason FROM pairs)"""


def names(spark, sf_dir):
    return table(spark, sf_dir, "part", "p_partkey", "p_name").groupBy(F.col("p_name").alias("term")).agg(F.min("p_partkey").alias("ord")).select("ord", "term")


@query("q18_similar_rules", f"WITH {NAMES_SQL}, {PAIRS_SQL} SELECT ord_a, ord_b, a, b, reason FROM ruled WHERE reason IS NOT NULL")
def q18_similar_rules(spark, sf_dir):
    found = similar.find_similar(names(spark, sf_dir), "zh", 0.8).filter("reason <> 'fuzzy'")
    return found.select("ord_a", "ord_b", "a", "b", "reason")


@query(
    "q20_similar_overlap",
    f"WITH {NAMES_SQL}, {PAIRS_SQL} SELECT ord_a, ord_b, printf('%.3f', len(list_intersect(la, lb)) / len(list_distinct(list_concat(la, lb))))::DOUBLE AS score FROM ruled WHERE reason = 'shared-stem'",
)
def q20_similar_overlap(spark, sf_dir):
    return similar.find_similar(names(spark, sf_dir), "zh", 0.8).filter("reason = 'shared-stem'").select("ord_a", "ord_b", "score")


@query("q21_similar_full")
def q21_similar_full(spark, sf_dir):
    return similar.ranked(similar.find_similar(names(spark, sf_dir), "zh", 0.8))


CLUSTER_SQL = f"""WITH RECURSIVE {NAMES_SQL}, {PAIRS_SQL}, links AS (SELECT a AS u, b AS v FROM ruled WHERE reason = 'near-identical' OR (reason = 'shared-stem' AND len(list_intersect(la, lb)) >= 0.9 * len(list_distinct(list_concat(la, lb))))),
both_ways AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach AS (SELECT DISTINCT u AS term, u AS other FROM both_ways UNION SELECT r.term, w.v FROM reach r JOIN both_ways w ON w.u = r.other),
roots AS (SELECT term, min(other) AS cluster_id FROM reach GROUP BY term)"""


def close_pairs(spark, sf_dir):
    found = similar.find_similar(names(spark, sf_dir), "zh", 0.8)
    letters = lambda c: F.array_distinct(similar.characters(F.col(c)))
    share = F.size(F.array_intersect(letters("a"), letters("b"))) >= 0.9 * F.size(F.array_union(letters("a"), letters("b")))
    return found.filter((F.col("reason") == "near-identical") | ((F.col("reason") == "shared-stem") & share))


@query("q22_clusters", CLUSTER_SQL + " SELECT cluster_id, string_agg(term, '; ' ORDER BY term) AS members, count(*)::INTEGER AS size FROM roots GROUP BY cluster_id")
def q22_clusters(spark, sf_dir):
    return similar.clusters(close_pairs(spark, sf_dir)).select("cluster_id", F.array_join("members", "; ").alias("members"), "size")


@query("q39_report_keep", CLUSTER_SQL + " SELECT cluster_id, coalesce(min(term) FILTER (term LIKE 'b%'), arg_min(term, (length(term), term))) AS keep FROM roots GROUP BY cluster_id")
def q39_report_keep(spark, sf_dir):
    members = similar.components(close_pairs(spark, sf_dir)).withColumnRenamed("root", "cluster_id")
    return similar.suggested_keep(members, names(spark, sf_dir).filter("term LIKE 'b%'"))


@query(
    "q23_cross_check",
    """WITH i AS (SELECT DISTINCT n_name AS a FROM nation), d AS (SELECT DISTINCT r_name AS b FROM region UNION SELECT DISTINCT upper(split_part(p_name, ' ', 1)) FROM part UNION SELECT left(n_name, 4) FROM nation)
    SELECT a, b, CASE WHEN abs(length(a) - length(b)) <= 1 AND least(length(a), length(b)) >= 2 AND levenshtein(a, b) = 1 THEN 'near-identical' ELSE 'containment' END AS reason
    FROM i JOIN d ON a <> b AND length(a) >= 2 AND length(b) >= 2 AND ((abs(length(a) - length(b)) <= 1 AND levenshtein(a, b) = 1) OR contains(a, b) OR contains(b, a))""",
)
def q23_cross_check(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    own = nation.select(F.col("n_nationkey").cast("bigint").alias("ord"), F.col("n_name").alias("term"))
    first = table(spark, sf_dir, "part", "p_name").select(F.upper(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("term"))
    deck = table(spark, sf_dir, "region").select(F.col("r_name").alias("term")).union(first).union(nation.select(F.left("n_name", F.lit(4)))).distinct()
    found = similar.find_similar(own, "zh", 0.8, deck).filter("source = 'anki'")
    return found.filter(F.col("reason").isin("near-identical", "containment")).select("a", "b", "reason")
