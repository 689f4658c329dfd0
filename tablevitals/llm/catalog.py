"""The registered queries of the corpus operators, and their SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablevitals.llm.bpe import encode_decode
from tablevitals.llm.common import WORD, fold, table
from tablevitals.llm.conversations import repair_damaged
from tablevitals.llm.exact_dedup import exact_dedup
from tablevitals.llm.hard_negatives import hard_negatives
from tablevitals.llm.language import identify_language
from tablevitals.llm.line_dedup import line_dedup
from tablevitals.llm.mixing import mix_sources
from tablevitals.llm.near_dedup import near_dedup
from tablevitals.llm.neighbours import nearest_neighbours
from tablevitals.llm.quality_rules import BOILERPLATE, ENDS, MARKS, MENU, PAGES, quality_rules
from tablevitals.llm.sharding import shard_by_bytes
from tablevitals.llm.token_counts import token_counts, write_token_files
from tablevitals.llm.toxicity import score_toxicity
from tablevitals.session import scratch_path

#: The end-of-document id of the byte-level vocabulary, which has no token of its own there.
END_OF_DOCUMENT = 50256


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


Query = Callable[[SparkSession, str], DataFrame]


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents as flat token files, then finds their lengths in these alone."""
    path = scratch_path(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), path, END_OF_DOCUMENT)
    shard = F.regexp_extract("file", r"part-(\d+)-[^/]*$", 1).cast("int")
    return token_counts(spark, path, END_OF_DOCUMENT).select(shard.alias("shard"), "doc_no", "start", "n_tokens", "closed")


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"), 24)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold(F.col("doc_id"), 5) == 0
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out).select(
        "doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), "word_bpe_49k.json")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2
    return identify_language(docs, F.col("lang"), ~held_out).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id = F.col("vec_id")
    noisy = F.when(vec_id % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), vec_id % 100 == 0, noisy)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_damaged(table(spark, sf_dir, "conversations"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "n_failed", "text_chars", "lost_chars")


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_exact_dedup, op2_token_counts, op3_neighbours, op4_sharding, op5_toxicity, op6_mixing, op7_bpe, op8_near_dedup,
    op9_line_dedup, op10_language, op11_hard_negatives, op12_conversation_repair, op13_quality_rules)}

ORACLES: dict[str, str] = {
    "op1_exact_dedup": """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                           'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)""",
    "op9_line_dedup": """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS place
  FROM documents WHERE text <> ''),
filled AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS n
  FROM lines WHERE NOT regexp_matches(line, '^[\\x20\\x09-\\x0D]*$')),
windows AS (
  SELECT doc_id, n, line || chr(10) || lead(line, 1) OVER w || chr(10) || lead(line, 2) OVER w AS body
  FROM filled WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
ranked AS (
  SELECT doc_id, n, row_number() OVER w AS k, first_value(doc_id) OVER w AS first_doc, first_value(n) OVER w AS first_n
  FROM windows WHERE body IS NOT NULL WINDOW w AS (PARTITION BY body ORDER BY doc_id, n)),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(CASE WHEN doc_id = first_doc THEN greatest(n, first_n + 3) ELSE n END, n + 3)) AS n
  FROM ranked WHERE k > 1),
kept AS (
  SELECT l.doc_id, l.place, l.line, g.n IS NOT NULL AS goes
  FROM lines l LEFT JOIN filled f ON l.doc_id = f.doc_id AND l.place = f.place
  LEFT JOIN gone g ON f.doc_id = g.doc_id AND f.n = g.n)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL
         ELSE coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT goes), '') END AS text,
       count(k.doc_id) AS n_lines, count(k.doc_id) FILTER (goes) AS n_removed
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id GROUP BY d.doc_id, d.text""",
    "op11_hard_negatives": """
WITH ready AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM ready a JOIN ready b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT same
WHERE 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER w <= 10""",
    "op13_quality_rules": f"""
WITH docs AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT n, unnest(regexp_extract_all(text, '{WORD}')) AS word,
         generate_subscripts(regexp_extract_all(text, '{WORD}'), 1) AS place FROM docs),
windows AS (
  SELECT n, place, word || ' ' || lead(word, 1) OVER w || ' ' || lead(word, 2) OVER w AS body
  FROM words WINDOW w AS (PARTITION BY n ORDER BY place)),
repeated AS (
  SELECT n, place FROM windows WHERE body IS NOT NULL QUALIFY count(*) OVER (PARTITION BY n, body) > 1),
word_counts AS (SELECT n, count(*) AS n_words, sum(length(word))::BIGINT AS word_chars FROM words GROUP BY n),
repeat_counts AS (
  SELECT n, count(*) AS n_repeat_words
  FROM (SELECT DISTINCT n, unnest([place, place + 1, place + 2]) FROM repeated) GROUP BY n),
lines AS (
  SELECT n, line, translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM (SELECT n, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '{WORD}')),
judged AS (
  SELECT n, line,
         (CASE WHEN length(low) < 120 THEN NOT regexp_matches(low, '{_quoted(ENDS[:-1])}[\x20\x09-\x0D]*$')
               ELSE NOT regexp_matches(low, '{MARKS}') END)
         OR (length(low) <= 200 AND (regexp_matches(low, '{MENU}') OR regexp_matches(low, '{PAGES}')))
         OR {' OR '.join(f"contains(low, '{phrase}')" for phrase in BOILERPLATE)} AS fails
  FROM lines),
line_counts AS (
  SELECT n, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (fails) AS n_failed,
         sum(length(line))::BIGINT AS text_chars, coalesce(sum(length(line)) FILTER (fails), 0)::BIGINT AS lost_chars
  FROM judged GROUP BY n),
found AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'gs'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_failed, 0) AS n_failed,
         coalesce(text_chars, 0) AS text_chars, coalesce(lost_chars, 0) AS lost_chars
  FROM docs LEFT JOIN word_counts USING (n) LEFT JOIN repeat_counts USING (n) LEFT JOIN line_counts USING (n))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost_chars <= 40 * text_chars AS kept
FROM found""",
}
