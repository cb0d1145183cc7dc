"""Queries of pages against their SQL on pages that the smallest tables lack."""

import html
import random
import re
from collections import Counter
from datetime import datetime

import duckdb
from pyspark.sql import functions as F

from lexmill.functions import strings
from lexmill.plans.catalogue import ORACLE_SQL, QUERIES
from lexmill.streaming import folder


def same_as_sql(spark, sf_dir, name, pages):
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{sf_dir}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet/*.parquet'")
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, str(sf_dir)).select(*want.columns).collect()
    assert Counter(map(tuple, got)) == Counter(want.fetchall())
    return got


# Urls of many pages and of none, neighbours that share one, and rows that come twice.
REPEATED = [(i, f"u{i // 2 % 7}" if i % 11 else None, "") for i in (*range(60), *range(1000, 1060), *range(30))]


def test_run_complete_of_repeated_urls(spark, tmp_path):
    same_as_sql(spark, tmp_path, "q67_run_complete", REPEATED)


def test_manifest_of_repeated_urls(spark, tmp_path):
    same_as_sql(spark, tmp_path, "q66_manifest", REPEATED)


def test_entries_that_repeat(spark):
    t0, t1 = datetime(2026, 1, 1), datetime(2026, 1, 2)
    now = spark.createDataFrame([("a", t1), ("b", t1), ("c", t1)], "path string, modified timestamp")
    history = [("a", t0, "grammar_done"), ("a", t1, "pending"), ("a", t1, "vocab_done"), ("a", t1, "failed"), ("b", t0, "failed"), ("b", t0, "text_done"), ("c", t1, "failed"), ("c", t1, "pending")]
    old = spark.createDataFrame(history, "path string, modified timestamp, status string")
    assert sorted((r.path, r.status) for r in folder.refresh_manifest(now, old).collect()) == [("a", "vocab_done"), ("b", "pending"), ("c", "failed")]


def test_stripped_pages_with_cut_entities(spark, tmp_path):
    rng = random.Random(7)
    pieces = ["&amp", "&am", "&lt", "&copy", "&", ";", "p", "<b>", "<", ">", "<a\nb>", " ", "\xa0", "\u3000", "\x1c", "\n", "&amp;", "&lt;", "&gt;", "&quot;", "&nbsp;", "&copy;", "&middot;", "&eacute;", "&#39;", "&#x27;", "&#160;", "漢"]
    texts = ["a &ampp{}", "&amp;lt;b&amp;gt;", "", None, *("".join(rng.choices(pieces, k=rng.randrange(12))) for _ in range(400))]
    same_as_sql(spark, tmp_path, "q07_strip_html", [(i, "u", t) for i, t in enumerate(texts)])
    # the function itself reads entities as HTML does
    every = spark.createDataFrame([(t,) for t in texts if t is not None], "t string").select("t", strings.strip_html(F.col("t")).alias("x")).collect()
    assert [r.x for r in every] == [html.unescape(re.sub("<[^>]+>", "", r.t)).replace("\xa0", " ").strip() for r in every]
