"""Token counts of documents in flat token files.

A flat token file is nothing but token ids of fixed width, little-endian, with an end-of-document id after each
document; there is no index. Files are cut into blocks, every block is searched for that id at once, and a prefix
scan over the blocks' short summaries stitches documents that cross blocks.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablevitals.llm.common import per_process, ref, slices, small_batches, whole_text
from tablevitals.session import materialize

#: Bytes of blocks that one task reads, one block after the other.
TASK_BYTES = 32 << 20
WIDTHS = {2: np.dtype("<u2"), 4: np.dtype("<u4")}


def _encoding(name: str):
    """The tokenizer of a public vocabulary file, all strings ordinary text."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(name), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("flat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def write_token_files(docs: DataFrame, path: str, end_id: int, width: int = 2, text_col: str = "text",
                      tokenizer: str = "byte_bpe_50k.tiktoken") -> None:
    """Encodes every text whole into flat token files below ``path``, one per partition.

    Spark's text writer does the writing: a document's ids are a line, the end-of-document id is the line's end.
    A missing text is a document without tokens. Ids that ``width`` bytes can't hold, and an ``end_id`` that stands for
    a token, raise.
    """
    most = _encoding(tokenizer).n_vocab - 1
    if max(most, end_id) > np.iinfo(WIDTHS[width]).max:
        raise ValueError(f"ids up to {max(most, end_id)} don't fit into {width} bytes")
    if end_id <= most:
        raise ValueError(f"{end_id} is a token of the vocabulary and can't end documents")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = per_process(("encoding", tokenizer), lambda: _encoding(tokenizer))
        for batch in batches:
            for cut in slices(batch.column("text")):
                ids = [np.asarray(encoding.encode_ordinary(t.as_py())).astype(WIDTHS[width]).tobytes()
                       for t in batch.column("text")[cut]]
                yield pa.RecordBatch.from_pydict({"ids": pa.array(ids, pa.binary())})

    lines = (docs.select(whole_text(ref(text_col)).alias("text")).mapInArrow(encode, "ids binary")
             .select(F.col("ids").cast("string")))
    line_end = end_id.to_bytes(width, "little").decode("latin-1")
    with small_batches(docs.sparkSession):
        lines.write.option("encoding", "ISO-8859-1").option("lineSep", line_end).text(path)


def _opened(file: str):
    """The file, open for reading at any place."""
    if file.startswith("file:"):
        return open("/" + file.removeprefix("file:").lstrip("/"), "rb")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(file)
    return store.open_input_file(path)


def _readable(file: str) -> bool:
    try:
        _opened(file).close()
    except (OSError, ValueError, pa.ArrowException):
        return False
    return True


def _ranges(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    """(file, block, body) of (file, length, block), one block at a time."""
    for batch in batches:
        for row in batch.to_pylist():
            since = row["block"] * block_bytes
            wanted = min(block_bytes, row["length"] - since)
            with _opened(row["file"]) as source:
                source.seek(since)
                body = source.read(wanted)
            if len(body) != wanted:
                raise ValueError(f"{row['file']} has changed while it was read")
            yield pa.RecordBatch.from_pydict({"file": [row["file"]], "block": pa.array([row["block"]], pa.int32()),
                                              "body": pa.array([body], pa.binary())})


def _summarized_blocks(spark: SparkSession, path: str, end_id: int, width: int, block_bytes: int) -> DataFrame:
    """The summary of each block of all files below ``path``.

    Only paths and lengths are listed; blocks are dealt out over tasks whatever file they are of, and each is read by its
    place. Files of a store that Spark alone can read come whole from Spark.
    """
    summary, schema = _summaries(end_id, width), ("file string, block int, n_ids long, n_ends long, tail long, "
                                                  "starts array<long>, counts array<long>")
    found = spark.read.format("binaryFile").load(path).where("length > 0")
    numbers = F.sequence(F.lit(0), F.expr(f"CAST((length - 1) div {block_bytes} AS INT)"))
    listed = found.select(F.col("path").alias("file"), "length")
    total, example = listed.agg(F.sum("length"), F.min("file")).first()
    if example is not None and not _readable(example):
        cut = F.transform(numbers, lambda k: F.struct(
            k.alias("block"), F.substring("content", k * block_bytes + 1, F.lit(block_bytes)).alias("body")))
        whole = found.select(F.col("path").alias("file"), F.explode(cut).alias("b")).select("file", "b.*")
        return whole.mapInArrow(summary, schema)
    tasks = max(spark.sparkContext.defaultParallelism, -(-(total or 0) // TASK_BYTES))
    dealt = listed.select("file", "length", F.explode(numbers).alias("block")).repartition(tasks)
    return dealt.mapInArrow(lambda batches: summary(_ranges(batches, block_bytes)), schema)


def _summaries(end_id: int, width: int):
    """Per block: its tokens, the ends in it, the tokens after the last end, and each document that ends in it.

    ``starts`` and ``counts`` are those documents; the first one counts from the block's start.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for body in batch.column("body"):
                raw = body.as_buffer()
                if len(raw) % width:
                    raise ValueError(f"a token file isn't a multiple of {width} bytes long")
                ids = np.frombuffer(raw, WIDTHS[width])
                ends = np.flatnonzero(ids == end_id)
                starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
                tail = len(ids) - (int(ends[-1]) + 1 if len(ends) else 0)
                rows.append((len(ids), len(ends), tail, starts, ends - starts))
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), batch.column("block"), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(3)),
                 *(pa.array([r[k] for r in rows], pa.list_(pa.int64())) for k in (3, 4))],
                names=["file", "block", "n_ids", "n_ends", "tail", "starts", "counts"])
    return run


def token_counts(spark: SparkSession, path: str, end_id: int, width: int = 2, block_bytes: int = 1 << 20) -> DataFrame:
    """One row per document: file, doc_no (from 0 in its file), start (its first token's place), n_tokens, closed.

    Two ends in a row hold a document without tokens. Tokens after a file's last end are a document that isn't
    ``closed``; documents don't run on into another file. Empty files hold none. A file may have any length that is a whole
    number of tokens; only in a store that neither Python nor pyarrow can read must it be under 2 GB, the most Spark
    hands over of one file. ``block_bytes`` is a multiple of ``width``.
    """
    with small_batches(spark):
        summaries = materialize(_summarized_blocks(spark, path, end_id, width, block_bytes))
    # The scan of a file sees some numbers per block, not its documents.
    ordered = Window.partitionBy("file").orderBy("block")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0).cast("long")
    scanned = (summaries.select("file", "block", "n_ids", "n_ends", "tail")
               .withColumn("ids_before", F.coalesce(F.sum("n_ids").over(before), zero))
               .withColumn("ends_before", F.coalesce(F.sum("n_ends").over(before), zero))
               .withColumn("tails", F.sum("tail").over(upto))
               # What was open before the last block with an end has been closed there.
               .withColumn("settled", F.when(F.col("n_ends") > 0, F.col("tails") - F.col("tail")))
               .withColumn("open_before", F.coalesce(F.max("tails").over(before), zero)
                           - F.coalesce(F.last("settled", ignorenulls=True).over(before), zero))
               .withColumn("is_last", F.lead("block").over(ordered).isNull()))
    documents = summaries.where("n_ends > 0").select("file", "block", "starts", "counts")
    ended = documents.join(scanned, ["file", "block"]).select(
        "file", "ids_before", "ends_before", "open_before",
        F.posexplode(F.arrays_zip("starts", "counts")).alias("k", "doc"))
    first = F.when(F.col("k") == 0, F.col("open_before")).otherwise(0)
    closed = ended.select("file", (F.col("ends_before") + F.col("k")).alias("doc_no"),
                          (F.col("ids_before") + F.col("doc.starts") - first).alias("start"),
                          (F.col("doc.counts") + first).alias("n_tokens"), F.lit(True).alias("closed"))
    left = F.col("tail") + F.when(F.col("n_ends") == 0, F.col("open_before")).otherwise(0)
    rest = scanned.where("is_last").select(
        "file", (F.col("ends_before") + F.col("n_ends")).alias("doc_no"),
        (F.col("ids_before") + F.col("n_ids") - left).alias("start"), left.alias("n_tokens"),
        F.lit(False).alias("closed")).where("n_tokens > 0")
    return closed.unionByName(rest)
