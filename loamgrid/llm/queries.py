"""The queries of this folder's operators and, where SQL can say it, their DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, minmax, neighbours, packing, quality, sharding, suffix_dedup, token_files, toxicity
from .common import slim


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = slim(table(spark, sf_dir, "documents"))
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), parts=5, part=0)
    out = toxicity.scores(docs, model)
    return out.select("doc_id", toxicity.held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = slim(table(spark, sf_dir, "documents"))
    net = quality.fit(docs, table(spark, sf_dir, "labels"), parts=4, part=2)
    out = quality.scores(docs, net)
    return out.select("doc_id", toxicity.held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest_repeats(table(spark, sf_dir, "documents"), length=400, keep="none")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, length=2048, keep_ids=False)
    return pieces.drop("ids")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return token_files.read_token_files(manifest)


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    turns = chat.canonical_turns(table(spark, sf_dir, "conversations")).unionByName(chat.canonical_turns(extra))
    read = chat.parse_chats(chat.format_chats(turns))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("losses", "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(slim(table(spark, sf_dir, "documents")), n_shards=40)


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op9_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.near_duplicates(table(spark, sf_dir, "documents")).drop("text_crc32")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans", "text_crc32")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_quality": op2_quality,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_packing": op4_packing,
    "op5_token_files": op5_token_files,
    "op6_chat": op6_chat,
    "op7_sharding": op7_sharding,
    "op8_neighbours": op8_neighbours,
    "op9_minmax": op9_minmax,
    "op10_decontamination": op10_decontamination,
}

#: A-Z and what they become, as the contracts lower-case them.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SQL: dict[str, str] = {
    # bytes as pairs of hexadecimal digits, so that a string of 400 bytes is one of 800 characters
    "op3_suffix_dedup": """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(coalesce(text, '')) AS h FROM documents
), starts AS (
  SELECT r, unnest(range(0, length(h) // 2 - 399)) AS i, h FROM d WHERE length(h) >= 800
), strings AS (
  SELECT r, i, md5_number(substr(h, CAST(2 * i + 1 AS BIGINT), 800)) AS s FROM starts
), cut AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY s) AS n FROM strings) WHERE n > 1
), runs AS (
  SELECT r, min(i) AS lo, max(i) + 400 AS hi
  FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS run
        FROM (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 400 THEN 0 ELSE 1 END AS new FROM cut))
  GROUP BY r, run
), edges AS (
  SELECT r, lo, hi, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS prior FROM runs
), kept AS (
  SELECT e.r, e.lo, substr(h, CAST(2 * prior + 1 AS BIGINT), CAST(2 * (lo - prior) AS BIGINT)) AS part FROM edges e JOIN d USING (r)
  UNION ALL
  SELECT d.r, 9223372036854775807, substr(h, CAST(2 * coalesce(last, 0) + 1 AS BIGINT)) FROM d LEFT JOIN (SELECT r, max(hi) AS last FROM runs GROUP BY r) USING (r)
), rest AS (
  SELECT r, string_agg(part, '' ORDER BY lo) AS h FROM kept GROUP BY r
), sums AS (
  SELECT r, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans FROM runs GROUP BY r
)
SELECT doc_id, (length(d.h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(rest.h)) AS kept_sha256
FROM d JOIN rest USING (r) LEFT JOIN sums USING (r)""",
    "op9_minmax": rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), links AS (
  SELECT x.a, x.b
  FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS shared FROM sets p JOIN sets q ON p.s = q.s AND p.doc_id <> q.doc_id GROUP BY 1, 2) x
  JOIN sizes m ON m.doc_id = x.a JOIN sizes n ON n.doc_id = x.b
  WHERE 100 * shared >= 75 * (m.n + n.n - shared)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM d
  UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
), classes AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM d JOIN classes USING (doc_id) LEFT JOIN sizes USING (doc_id)""",
    "op10_decontamination": rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), wanted AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)
), windows AS (
  SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM wanted) WHERE len(w) >= n)
), hits AS (
  SELECT r, i, n, item_id FROM windows JOIN wanted USING (n, s)
), hit AS (
  SELECT r, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT r, i, unnest(range(0, n)) AS k FROM hits) GROUP BY r
), held AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN held USING (r)""",
    "op6_chat": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, replace(replace(replace(text, '\', '\b'), '### ', '\h'), '</turn>', '\t') AS et,
         replace(replace(replace(replace(role, '\', '\b'), '### ', '\h'), '</turn>', '\t'), ':', '\c') AS er
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length(er) + length(et) + 14)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""",
}
