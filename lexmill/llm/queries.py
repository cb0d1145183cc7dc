"""Queries ``opN_<name>`` over the provided tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import bpe, chat, gam, langid, minhash, mixing, rules, sharding, suffixes, topk
from lexmill.llm.scratch import Scratch, read_table

#: Shards of the sharding query.
SHARDS = 40


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(spark, read_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_path())


def op2_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "labels")
    return rules.judge(docs, labels, Scratch(spark, "rules"))[0]


def op6_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "labels")
    return gam.classify(docs, labels, Scratch(spark, "gam"))


#: The conversation added to the table: both its turns hold control strings.
HARD_CONVERSATION, HARD_TEXT = -7, "\\### Assistant: </turn> ok"


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    hard = spark.createDataFrame([(HARD_CONVERSATION, k, role, HARD_TEXT) for k, role in enumerate(("user", "assistant"))], rows.schema)
    scratch = Scratch(spark, "chat")
    messages = scratch.write(chat.conversation_turns(rows.unionByName(hard)), "messages")
    return chat.read_back(chat.format_paths(messages, chat.choose_paths(messages, scratch))).drop("path").withColumnRenamed("tree", "conv_id")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, Scratch(spark, "topk"))


OP4_SQL = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark, "minhash"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_all(read_table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_key(read_table(spark, sf_dir, "documents").select("doc_id", "text"), SHARDS)


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.report(read_table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark, "suffixes"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text"), Scratch(spark, "mixing"))



OP3_SQL = """
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, k, ['user', 'assistant'][k + 1], '\\### Assistant: </turn> ok' FROM range(2) AS t(k)
),
turns AS (
  SELECT *, 4 + length(role) + length(regexp_replace(role, '[^:\\\\]', '', 'g')) + 2 + length(text) + 8
    + length(regexp_replace(text, '[^\\\\]', '', 'g'))
    + CAST(coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda r: length(r) - 2)), 0) AS BIGINT)
    + len(regexp_extract_all(text, '</turn>')) AS formatted
  FROM given
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, sha256(text))) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, sha256(text)) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(formatted) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""

OP7_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, string_split_regex(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z', '', 'g'), '[\x20\x09-\x0D]+') AS w
  FROM documents
),
sets AS (
  SELECT doc_id, CASE WHEN w = [''] THEN [] ELSE list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i : i + 4], ' ')))) END AS s
  FROM worded
),
classes AS (SELECT s, min(doc_id) AS rep FROM sets WHERE len(s) > 0 GROUP BY s),
flat AS (SELECT rep, len(s) AS n, unnest(s) AS x FROM classes),
links AS (
  SELECT a.rep AS u, b.rep AS v FROM flat a JOIN flat b ON a.x = b.x AND a.rep < b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
),
both_ways AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach AS (SELECT rep AS id, rep AS other FROM classes UNION SELECT r.id, w.v FROM reach r JOIN both_ways w ON w.u = r.other),
roots AS (SELECT id, min(other) AS component FROM reach GROUP BY id)
SELECT doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id, doc_id = coalesce(component, doc_id) AS kept
FROM sets LEFT JOIN classes ON sets.s = classes.s LEFT JOIN roots ON roots.id = classes.rep
"""

OP10_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, substr(md5(coalesce(text, '')), 1, 16) AS content
  FROM documents
),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, source_size * 3 AS cap FROM per),
running AS (
  SELECT *, row_number() OVER o AS nth, sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_weight
  FROM weighed WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)
),
level AS (SELECT min(nth) AS nth, arg_min(rest, nth) AS rest, arg_min(rest_weight, nth) AS rest_weight FROM running WHERE rest * weight <= cap * rest_weight),
targets AS (
  SELECT r.source, source_size, CASE WHEN r.nth < l.nth THEN CAST(cap AS DOUBLE) ELSE CAST(l.rest * weight AS DOUBLE) / CAST(l.rest_weight AS DOUBLE) END AS target
  FROM running r, level l
),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate FROM targets),
drawn AS (
  SELECT s.*, source_size, target, CAST(floor(rate) AS BIGINT) AS whole, rate - floor(rate) AS fraction, seed,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/' || content || '/' || seed), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < rate - floor(rate) AS more
  FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source, range(16) AS t(seed)
),
missed AS (SELECT source, seed, abs(sum(size * whole + CASE WHEN more THEN size ELSE 0 END) - first(target)) AS miss FROM drawn GROUP BY source, seed),
chosen AS (SELECT source, arg_min(seed, (miss, seed)) AS seed FROM missed GROUP BY source)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN more THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM drawn d JOIN chosen c ON d.source IS NOT DISTINCT FROM c.source AND d.seed = c.seed
"""



def _crc_table() -> str:
    """The 256 remainders of CRC-32 as an SQL list."""
    out = []
    for entry in range(256):
        for _ in range(8):
            entry = entry >> 1 ^ (0xEDB88320 if entry & 1 else 0)
        out.append(entry)
    return f"[{', '.join(map(str, out))}]::BIGINT[]"


def _bytes_sql(text: str) -> str:
    return f"list_transform(regexp_extract_all(hex({text}), '..'), lambda h: CAST('0x' || h AS BIGINT))"


def _crc_sql(text: str) -> str:
    step = f"lambda c, b: xor(({_crc_table()})[xor(c & 255, b) + 1], c >> 8)"
    return f"xor(list_reduce({_bytes_sql(text)}, {step}, 4294967295::BIGINT), 4294967295::BIGINT)"


OP5_SQL = f"""
WITH RECURSIVE keys AS (SELECT DISTINCT doc_id, coalesce(doc_id, 0)::HUGEINT AS k FROM documents),
walk AS (
  SELECT doc_id, -1::BIGINT AS spot, 0::BIGINT AS ahead, CASE WHEN k < 0 THEN k + 18446744073709551616::HUGEINT ELSE k END AS k FROM keys
  UNION ALL
  SELECT doc_id, ahead, CAST(floor((ahead + 1)::DOUBLE * (2147483648.0::DOUBLE / (m // 8589934592 + 1)::DOUBLE)) AS BIGINT), m
  FROM (SELECT doc_id, ahead, (k * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS m FROM walk WHERE ahead < {SHARDS})
),
placed AS (SELECT doc_id, max(spot) AS spot, max(ahead) AS ahead, {_crc_sql("coalesce(doc_id::VARCHAR, '')")} % {sharding.SLOT_RUNS} AS run FROM walk GROUP BY doc_id),
sized AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) + {sharding.ROW_BYTES} AS BIGINT) AS size, {_crc_sql("coalesce(text, '')")} AS text_crc32 FROM documents)
SELECT s.doc_id, size, text_crc32, 'key' AS law, CAST(spot AS INTEGER) AS shard,
  CAST(row_number() OVER (PARTITION BY spot ORDER BY run, s.doc_id NULLS FIRST, text_crc32, size) - 1 AS BIGINT) AS slot,
  CAST(CASE WHEN ahead = {SHARDS} THEN {SHARDS} ELSE spot END AS INTEGER) AS grown_shard
FROM sized s JOIN placed p ON s.doc_id IS NOT DISTINCT FROM p.doc_id
"""

OP9_SQL = """
WITH given AS (SELECT doc_id, hex(coalesce(text, '')) AS x, strlen(coalesce(text, '')) AS n FROM documents),
blocks AS (SELECT doc_id, n, o, substr(x, 2 * o + 1, 2 * (1024 + 99)) AS piece FROM (SELECT doc_id, x, n, unnest(range(0, n, 1024)) AS o FROM given)),
windows AS (SELECT doc_id, o + j AS i, md5(substr(piece, 2 * j + 1, 200)) AS h FROM (SELECT doc_id, o, piece, unnest(range(0, least(1024, n - 99 - o))) AS j FROM blocks)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS nth FROM windows) WHERE nth > 1),
marked AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS opens FROM late),
numbered AS (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM marked),
spans AS (SELECT doc_id, span, min(i) AS lo, max(i) + 100 AS hi FROM numbered GROUP BY doc_id, span),
cuts AS (SELECT doc_id, list(lo ORDER BY lo) AS lo, list(hi ORDER BY lo) AS hi, sum(hi - lo) AS gone FROM spans GROUP BY doc_id),
kept AS (
  SELECT g.doc_id, n, gone, lo, array_to_string(list_transform(range(1, len(lo) + 2), lambda k: substr(x, 2 * coalesce(hi[k - 1], 0) + 1, 2 * (coalesce(lo[k], n) - coalesce(hi[k - 1], 0)))), '') AS rest
  FROM given g JOIN cuts c USING (doc_id)
  UNION ALL SELECT doc_id, n, 0, [], x FROM given WHERE doc_id NOT IN (SELECT doc_id FROM cuts)
)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(gone AS BIGINT) AS n_removed, CAST(len(lo) AS BIGINT) AS n_spans, sha256(unhex(rest)) AS kept_sha256 FROM kept
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_rules": op2_rules,
    "op3_chat": op3_chat,
    "op4_topk": op4_topk,
    "op7_minhash": op7_minhash,
    "op8_langid": op8_langid,
    "op6_gam": op6_gam,
    "op5_sharding": op5_sharding,
    "op9_suffixes": op9_suffixes,
    "op10_mixing": op10_mixing,
}

ORACLE_SQL: dict[str, str] = {"op3_chat": OP3_SQL, "op4_topk": OP4_SQL, "op5_sharding": OP5_SQL, "op7_minhash": OP7_SQL, "op9_suffixes": OP9_SQL, "op10_mixing": OP10_SQL}
