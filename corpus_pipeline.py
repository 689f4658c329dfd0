"""The corpus pipeline: from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written and read again before the next one. All
but the last return the columns of ``documents``. Stages learn and count over what their predecessor kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablevitals.llm.bpe import encode_decode
from tablevitals.llm.common import fold
from tablevitals.llm.language import identify_language
from tablevitals.llm.line_dedup import line_dedup
from tablevitals.llm.mixing import mix_sources
from tablevitals.llm.near_dedup import near_dedup
from tablevitals.session import materialize


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; learnt from the labelled three quarters of them."""
    found = identify_language(docs, F.col("lang"), fold(F.col("doc_id"), 4) != 2)
    return found.where("NOT rejected").select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of later occurrences; a text may end up empty."""
    clean = line_dedup(docs).withColumn(
        "n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return clean.select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group; repeated rows of one id and text are one.

    Texts that share an id are compared and go one by one. Documents without an id are compared, too, and come before
    all others. Rows are compared under 64 bits of id and text and told apart by 128, so that two which share the
    former are compared as one but stay both.
    """
    keyed = docs.withColumns({"row_key": F.xxhash64("doc_id", "text"), "row_check": F.xxhash64(F.lit(1), "text", "doc_id")})
    names = ["row_key", "row_check"]
    places = materialize(keyed.select(*names, "doc_id").dropDuplicates(names))
    groups = near_dedup(keyed.select("row_key", "text"), "row_key").select(
        F.col("doc_id").alias("row_key"), "component_id").distinct()
    first = groups.join(places, "row_key").groupBy("component_id").agg(F.min(F.struct("doc_id", "row_key")).alias("first"))
    return keyed.dropDuplicates(names).join(first.select("first.row_key"), "row_key", "left_semi").select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it.

    Rows of one id, source and text give one row as often as the mix takes all of them; where they differ in another
    column, which of them it is may be any. A missing text has no words, so it is taken no time or as often as its
    source's whole share; an empty table gives none.
    """
    keys = [F.xxhash64("text").alias("text_hash"), F.xxhash64(
        F.col("doc_id").isNull(), "doc_id", F.col("source").isNull(), "source").alias("id_hash")]
    names = ["text_hash", "id_hash"]
    taken = materialize(mix_sources(docs).select("text_hash", keys[1], "copies").groupBy(*names).agg(
        F.sum("copies").alias("copies"), F.count("*").alias("alike")).where("copies > 0"))
    keyed = docs.select(*keys, F.struct(*docs.columns).alias("row"))
    rows = keyed.join(taken.where("alike = 1").drop("alike"), names).select("row", "copies")
    repeated = taken.where("alike > 1").drop("alike")
    if not repeated.isEmpty():  # one row for all of a kind, chosen within tasks before the shuffle
        kept = keyed.join(repeated, names, "left_semi").groupBy(*names).agg(F.first("row").alias("row"))
        rows = rows.unionByName(kept.join(repeated, names).select("row", "copies"))
    return rows.withColumn("copy", F.explode(F.expr("sequence(1L, copies)"))).select("row.*")


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of ids and of the decoded text; a missing text counts as empty.

    Repeated rows are encoded each, rows without an id, too; an empty table gives none.
    """
    return encode_decode(docs, "word_bpe_49k.json", keep_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: A classifier, a random draw and a tokenizer are beyond SQL; the tests compare each stage by brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again, over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
