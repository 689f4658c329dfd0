"""The corpus pipeline, stage by stage."""

import collections

import corpus_pipeline
from pyspark.sql import functions as F

from tablevitals.llm.language import identify_language
from tests.llm import edge

STAGES = dict(corpus_pipeline.STAGES)


def test_stages_in_order():
    assert list(STAGES) == ["language", "line_dedup", "near_dedup", "mixing", "encoding"]


def test_stages_keep_their_promises(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    told = STAGES["language"](spark, docs, sf).cache()
    found = identify_language(docs, F.col("lang"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    assert {r.doc_id for r in told.collect()} == {r.doc_id for r in found.where("NOT rejected").collect()}

    clean = STAGES["line_dedup"](spark, told, sf).cache()
    before = [(r.doc_id, r.text) for r in told.collect()]
    assert sorted((r.doc_id, r.text) for r in clean.collect()) == sorted(zip([d for d, _ in before], edge.deduped_lines(before)))
    assert all(r.n_chars == len(r.text) for r in clean.collect())

    single = STAGES["near_dedup"](spark, clean, sf).cache()
    want = edge.components({r.doc_id: edge.shingles(r.text) for r in clean.collect()})
    assert sorted(r.doc_id for r in single.collect()) == sorted({d for d, c in want.items() if d == c})

    mixed = STAGES["mixing"](spark, single, sf).cache()
    copies = collections.Counter((r.doc_id, r.text) for r in mixed.collect())
    assert set(copies) <= {(r.doc_id, r.text) for r in single.collect()} and max(copies.values()) <= 3
    for stage in (told, clean, single, mixed):
        assert stage.columns == columns

    encoded = STAGES["encoding"](spark, mixed, sf)
    assert sorted(r.doc_id for r in encoded.collect()) == sorted(d for d, n in copies.items() for d in [d[0]] * n)


def test_stages_on_odd_documents(spark, sf):
    docs = edge.documents(spark).select(*edge.SCHEMA.replace(" long", "").replace(" string", "").split(", "))
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, sf).collect()
        assert rows, name
        if name == "near_dedup":
            assert sum(r.doc_id == 12 for r in rows) == 1 and sum(r.doc_id is None for r in rows) == 2
        assert stage(spark, docs.limit(0), sf).collect() == []


def test_near_copies_go_row_by_row(spark, sf):
    """Of two texts of one id only the near copy goes; rows without an id are compared and come first."""
    text = {name: " ".join(f"{name}{k}" for k in range(40)) for name in "abcd"}
    rows = [(1, text["a"]), (5, text["a"] + " end"), (5, text["b"]), (5, text["b"]), (None, text["c"]),
            (None, text["c"] + " end"), (7, text["c"]), (8, text["d"]), (9, text["d"] + " end"), (10, None), (11, ""), (12, "")]
    docs = edge.documents(spark, [(d, t, "en", "s", 1) for d, t in rows])
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    kept = collections.Counter((r.doc_id, (r.text or "")[:1]) for r in STAGES["near_dedup"](spark, docs, sf).collect())
    assert kept == {(1, "a"): 1, (5, "b"): 1, (None, "c"): 1, (8, "d"): 1, (10, ""): 1, (11, ""): 1, (12, ""): 1}


def test_run_goes_through_all_stages(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and all(r.n_tokens == len(r.ids) for r in rows)
