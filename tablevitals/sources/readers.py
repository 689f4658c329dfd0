"""Scans of tables, texts and images."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablevitals.functions.columns import chunks, col
from tablevitals.functions.scalars import FILE_TYPES, KINDS, NUMERIC_TEXT, dataset_kind, strip
from tablevitals.session import few_listing_tasks, gathered, materialize
from tablevitals.sources.listing import contents, files_below

#: Cell texts that mean "missing" in a CSV file (fixed values).
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

#: Cell texts of a boolean column (fixed values).
TRUE_TOKENS = ("True", "TRUE", "true")
FALSE_TOKENS = ("False", "FALSE", "false")

INTEGER_TEXT = r"^\s*[+-]?[0-9]+\s*$"

#: Suffixes of compressed files.
PACKED = r"[.](gz|gzip|bz2|deflate|lz4|snappy|zst|zstd)$"

#: Image suffixes as one glob (fixed values).
IMAGE_GLOB = "*.{jpg,jpeg,png,bmp,JPG,JPEG,PNG,BMP}"


@dataclass
class Dataset:
    """``columnar`` tells whether reading a few columns again is cheap, as it is from Parquet."""

    data: DataFrame
    kind: str
    path: str
    columnar: bool = True


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def scan_json(spark: SparkSession, path: str, lines: bool | None = None,
              schema: T.StructType | str | None = None) -> DataFrame:
    """Records as one per line (``lines=True``), as an array or a record per file (``False``), or as each file has them.

    Line files split into many tasks; a document is read as a whole, so prefer lines at scale, and pass a
    ``schema`` to spare the inference pass. A record that cannot be parsed stops the scan.
    """
    if lines is None:
        by_kind = json_files(spark, path)
        parts = [_json(spark, paths, kind, schema) for kind, paths in by_kind.items() if paths]
        if not parts:
            raise ValueError(f"no records below {path}")
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    return _json(spark, [path], lines, schema)


def _json(spark: SparkSession, paths: list[str], lines: bool, schema: T.StructType | str | None) -> DataFrame:
    reader = spark.read.option("multiLine", str(not lines).lower()).option("mode", "FAILFAST")
    if lines:
        return (reader if schema is None else reader.schema(schema)).json(paths)
    with few_listing_tasks(spark):
        return gathered(reader.schema(_documents_schema(spark, paths) if schema is None else schema).json(paths))


def _documents_schema(spark: SparkSession, paths: list[str]) -> T.StructType:
    """The columns that Spark finds in JSON documents.

    Its own pass over ``multiLine`` files lists them one by one on the driver; here tasks hand it their texts.
    Compressed files take that pass, as only Spark knows their codecs.
    """
    reader, files = spark.read.option("mode", "FAILFAST"), spark.read.format("binaryFile").load(paths)
    if not files.where(F.col("path").rlike(PACKED)).isEmpty():
        return reader.option("multiLine", "true").json(paths).schema
    texts = gathered(files.select("content")).rdd.map(lambda row: row.content.decode(json.detect_encoding(row.content)))
    return reader.json(texts).schema


def json_files(spark: SparkSession, path: str) -> dict[bool, list[str]]:
    """The files below a path that hold one record per line (True), and the others (False).

    A file of lines starts with a whole record on its first line that isn't blank; blank files hold nothing.
    """
    with few_listing_tasks(spark):
        files = spark.read.option("recursiveFileLookup", "true").text(path)
    lines = files.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("place"), strip(F.col("value")).alias("line")).filter("line <> ''")
    first = gathered(lines).groupBy("file").agg(F.min_by(
        F.col("line").startswith("{") & F.get_json_object("line", "$").isNotNull(), F.struct("start", "place")).alias("lines"))
    found: dict[bool, list[str]] = {True: [], False: []}
    for row in first.collect():  # one row per file, as many as the reader's own file list
        found[row["lines"]].append(row["file"])
    # A folder of one kind is read as a folder.
    return {k: [path] if v and not found[not k] else sorted(v) for k, v in found.items()}


def scan_csv(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """A CSV file with header; NA texts become NULL and column types follow the values.

    The text is parsed once and kept as Parquet in the shared folder. Types come from one aggregate over all
    rows: bigint if every value is an integer, double if every value is a number or none is present, boolean if
    every value is a truth word, else string. Dates stay strings. Rows with fewer cells than the header end in
    missing values; rows with more stop the scan. ``multiline`` allows line breaks in quoted cells, at the price of
    unsplit files.
    """
    reader = spark.read.option("header", "true").option("escape", '"').option("multiLine", str(multiline).lower())
    names = reader.option("inferSchema", "false").csv(path).columns
    surplus = "_more_cells"
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, surplus]])
    texts = materialize(reader.schema(schema).csv(path).select(
        *[F.when(~col(c).isin(*NA_TOKENS), col(c)).alias(c) for c in names], col(surplus)))
    kinds: list[str] = []
    for group in chunks(names, 25):
        flags = texts.agg(F.count(col(surplus)).alias("surplus"),
                          *[f for i, c in enumerate(group) for f in _type_flags(col(c), i)]).first()
        if flags["surplus"]:
            raise ValueError(f"{flags['surplus']} rows of {path} have more cells than the header")
        kinds += [_csv_type(flags, i) for i in range(len(group))]
    return texts.select([_convert(col(c), kind).alias(c) for c, kind in zip(names, kinds)])


def _type_flags(value: Column, i: int) -> list[Column]:
    trimmed = F.trim(value)
    whole = value.rlike(INTEGER_TEXT) & trimmed.try_cast("bigint").isNotNull()
    return [
        F.bool_and(F.when(value.isNotNull(), whole)).alias(f"int{i}"),
        F.bool_and(trimmed.rlike(NUMERIC_TEXT)).alias(f"num{i}"),
        F.bool_and(value.isin(*TRUE_TOKENS, *FALSE_TOKENS)).alias(f"bool{i}"),
    ]


def _csv_type(flags, i: int) -> str:
    if flags[f"num{i}"] is None:  # no value at all
        return "double"
    for name, kind in (("int", "bigint"), ("num", "double"), ("bool", "boolean")):
        if flags[f"{name}{i}"]:
            return kind
    return "string"


def _convert(value: Column, kind: str) -> Column:
    if kind == "string":
        return value
    return F.trim(value).try_cast(kind)


def scan_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """One stripped, non-blank line per row: text."""
    lines = spark.read.text(path).select(strip(F.col("value")).alias("text"))
    return lines.filter(F.length("text") > 0)


def scan_text_dir(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """One text file per row, found recursively: path, label (parent folder), text (stripped).

    Blank files are left out. ``limit`` keeps that many files; by default all are read.
    """
    listed = files_below(spark, path)
    if listed is None:
        with few_listing_tasks(spark):
            read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(path, wholetext=True)
        found = gathered(read.select(F.col("_metadata.file_path").alias("path"), "value"))
    else:
        found = contents(listed.filter(F.endswith("path", F.lit(b".txt")))).select("path", F.col("content").cast("string").alias("value"))
    files = (
        found.select("path", strip(F.col("value")).alias("text"))
        .filter(F.length("text") > 0)
        .select("path", _parent(F.col("path")).alias("label"), "text")
    )
    return files if limit is None else files.orderBy("path").limit(limit)


def scan_images(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """One decodable image per row: path, label (parent folder), width, height, n_channels, mode, data.

    Files that cannot be decoded are skipped. ``limit`` keeps that many; by default all are read.
    """
    images = (
        spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", IMAGE_GLOB).load(path)
        .select(F.col("image.origin").alias("path"), _parent(F.col("image.origin")).alias("label"),
                F.col("image.width").alias("width"), F.col("image.height").alias("height"),
                F.col("image.nChannels").alias("n_channels"), F.col("image.mode").alias("mode"),
                F.col("image.data").alias("data"))
    )
    return images if limit is None else images.orderBy("path").limit(limit)


def _parent(path: Column) -> Column:
    return F.url_decode(F.regexp_replace(F.try_element_at(F.split(path, "/"), F.lit(-2)), r"\+", "%2B"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """All files below a path without reading them: path, bytes, kind."""
    listed = files_below(spark, path)
    if listed is None:
        with few_listing_tasks(spark):
            read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        listed = gathered(read.select("path", F.col("length").alias("bytes")))
    else:
        listed = listed.select(F.concat(F.lit("file:"), F.make_valid_utf8(F.col("path").cast("string"))).alias("path"), "bytes")
    return listed.select("path", "bytes", dataset_kind(F.col("path")).alias("kind"))


def directory_kind(files: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row over ``list_files``, or per group of ``by``: n_files, n_images, n_texts, kind.

    image or text if more than half of the files are of that kind, else tabular; NULL without files.
    """
    counted = files.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_files"),
        F.count_if(F.col("kind") == "image").alias("n_images"),
        F.count_if(F.col("kind") == "text").alias("n_texts"),
    )
    half = F.col("n_files") / 2
    kind = F.when(F.col("n_files") > 0, F.when(F.col("n_images") > half, "image").when(
        F.col("n_texts") > half, "text").otherwise("tabular"))
    return counted.withColumn("kind", kind)


def _suffix(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[-1].lower() if "." in name[1:] else ""


def load(spark: SparkSession, path: str, kind: str | None = None, format: str | None = None,
         multiline: bool = False) -> Dataset:
    """Open a file or folder with the reader its suffix, or its files' majority, asks for.

    ``kind`` (tabular, image, text) and ``format`` (csv, json, jsonl, parquet) override the guess; an unknown suffix
    is read as CSV. JSON files are read as lines or documents, whichever each of them is. ``multiline`` allows
    line breaks in the cells of a CSV file.
    """
    suffix = _suffix(path)
    file_type = format or FILE_TYPES.get(suffix)
    if kind is None:
        kind = KINDS.get("json" if file_type == "jsonl" else file_type)
    if kind is None:
        kind, file_type = _guess(spark, path, file_type)
    if kind == "image":
        return Dataset(scan_images(spark, path), kind, path)
    if kind == "text":
        single = suffix == "txt" and not _is_directory(spark, path)
        return Dataset(scan_text_lines(spark, path) if single else scan_text_dir(spark, path), kind, path)
    if file_type == "excel":
        raise ValueError("Excel files are not read; save the sheet as CSV or Parquet")
    if file_type == "parquet":
        return Dataset(scan_parquet(spark, path), "tabular", path)
    if file_type in ("json", "jsonl"):
        return Dataset(scan_json(spark, path, lines=True if format == "jsonl" else None), "tabular", path, columnar=False)
    return Dataset(scan_csv(spark, path, multiline), "tabular", path)


def _guess(spark: SparkSession, path: str, file_type: str | None) -> tuple[str, str | None]:
    files = list_files(spark, path)
    found = directory_kind(files).first()
    if found["kind"] is None:
        raise ValueError(f"no files below {path}")
    if found["kind"] == "tabular" and file_type is None:
        types = files.groupBy(F.lower(F.regexp_extract("path", r"[.]([^./]+)$", 1)).alias("suffix")).count()
        top = types.orderBy(F.desc("count"), "suffix").first()
        file_type = FILE_TYPES.get(top["suffix"], "csv")
    return found["kind"], file_type


def _is_directory(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    file_system = hadoop_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return file_system.getFileStatus(hadoop_path).isDirectory()
