"""The registered queries: each applies one operator, with production parameters, to its whole table."""
from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, fingerprints, html_text, line_dedup, packing, pii, prefix_trie, resampling, secret_scan, simhash, token_files, whitening
from .common import shared_folder, table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_exact", "n_near")


OP1_SQL = """
WITH lines AS (
  SELECT doc_id, i - 1 AS line_no, parts[i] AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents) d, unnest(generate_series(1, len(parts))) AS u(i)),
words AS (SELECT doc_id, line_no, list_filter(string_split(lower(line), ' '), lambda w: w <> '') AS w FROM lines),
sets AS (
  SELECT doc_id, line_no, words, len(words) AS size FROM (
    SELECT doc_id, line_no, list_sort(list_distinct(list_transform(generate_series(1, greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i:i + 4], ' ')))) AS words FROM words WHERE len(w) > 0)),
classes AS (
  SELECT row_number() OVER (ORDER BY first_doc, first_line) AS class, words, size, first_doc, first_line FROM (
    SELECT words, any_value(size) AS size, min((doc_id, line_no))[1] AS first_doc, min((doc_id, line_no))[2] AS first_line FROM sets GROUP BY words)),
tokens AS (SELECT class, size, unnest(words) AS w FROM classes),
rarity AS (SELECT w, count(*) AS n FROM tokens GROUP BY w),
prefix AS (
  SELECT class, size, w FROM (
    SELECT class, size, w, row_number() OVER (PARTITION BY class ORDER BY n, w) AS pos FROM tokens JOIN rarity USING (w) WHERE n > 0)
  WHERE pos <= size - CAST(ceil(size * 0.8 - 1e-9) AS BIGINT) + 1),
pairs AS (
  SELECT DISTINCT x.class AS later, y.class AS earlier FROM prefix x JOIN prefix y ON x.w = y.w AND y.class < x.class
  WHERE x.size * 4 <= y.size * 5 AND y.size * 4 <= x.size * 5),
near AS (
  SELECT DISTINCT later FROM (
    SELECT later, len(list_intersect(x.words, y.words)) AS both_have, x.size + y.size AS total
    FROM pairs JOIN classes x ON x.class = later JOIN classes y ON y.class = earlier)
  WHERE both_have * 9 >= total * 4),
marked AS (
  SELECT s.doc_id, s.line_no, (s.doc_id, s.line_no) <> (c.first_doc, c.first_line) AS exact, later IS NOT NULL AS close
  FROM sets s JOIN classes c ON s.words = c.words LEFT JOIN near ON near.later = c.class)
SELECT l.doc_id, coalesce(string_agg(line, chr(10) ORDER BY l.line_no) FILTER (WHERE NOT coalesce(exact OR close, false)), '') AS text,
  count(*) AS n_lines, count(*) FILTER (WHERE exact) AS n_exact, count(*) FILTER (WHERE close AND NOT exact) AS n_near
FROM lines l LEFT JOIN marked m ON l.doc_id = m.doc_id AND l.line_no = m.line_no
GROUP BY l.doc_id
"""


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan_personal(table(spark, sf_dir, "documents"))


def op5_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.cut_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return packing.pack(pieces)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/llm-tokens-{uuid.uuid4().hex}"
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_files.read_token_files(spark, path)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_copies(table(spark, sf_dir, "documents"), hash_all=True).withColumnRenamed("full_hash", "text_sha256")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_by_next(table(spark, sf_dir, "documents"))


OP9_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d
"""

QUERIES = {
    "op1_line_dedup": (op1_line_dedup, OP1_SQL),
    "op2_decontaminate": (op2_decontaminate, None),
    "op3_secret_scan": (op3_secret_scan, None),
    "op4_pii": (op4_pii, None),
    "op5_resampling": (op5_resampling, None),
    "op6_simhash": (op6_simhash, None),
    "op7_packing": (op7_packing, None),
    "op8_token_files": (op8_token_files, None),
    "op9_exact_dedup": (op9_exact_dedup, OP9_SQL),
    "op10_html_text": (op10_html_text, None),
    "op11_conversation_trie": (op11_conversation_trie, None),
    "op12_whitening": (op12_whitening, None),
    "op13_fingerprints": (op13_fingerprints, None),
}
