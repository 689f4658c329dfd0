"""Sharding and mixing: the laws they promise, on odd documents and on the shared tables."""

import collections
import random
import zlib

import pytest

from tablevitals.llm.catalog import QUERIES
from tablevitals.llm.mixing import WEIGHTS, mix_sources, settle, source_targets
from tablevitals.llm.sharding import shard_by_bytes
from tests.llm import edge


def check_shards(rows, texts, n_shards):
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == collections.Counter(
        (d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in texts)
    slots = collections.defaultdict(list)
    for row in rows:
        assert row.law == "bytes" and row.grown_shard is None and 0 <= row.shard < n_shards
        slots[row.shard].append(row)
    for shard in slots.values():
        assert sorted(r.slot for r in shard) == list(range(len(shard)))
    # Contiguous by id: walking through shards and slots meets the ids in order, and the cuts are where they belong.
    walk = sorted(rows, key=lambda r: (r.shard, r.slot))
    ids = [r.doc_id if r.doc_id is not None else -1 for r in walk]
    assert ids == sorted(ids)
    total, start = sum(r["size"] for r in rows), 0
    for row in walk:
        assert row.shard == min(n_shards - 1, (2 * start + row["size"]) * n_shards // (2 * total))
        start += row["size"]


@pytest.mark.parametrize("n_shards", [1, 3, 24])
def test_shards_of_odd_documents(spark, n_shards):
    check_shards(shard_by_bytes(edge.documents(spark), n_shards).collect(), [r[:2] for r in edge.ROWS], n_shards)


def test_shards_of_rows_alike(spark):
    rows = [(7, "same", None, None, None)] * 300 + [(k, "x" * k, None, None, None) for k in range(50)]
    check_shards(shard_by_bytes(edge.documents(spark, rows), 5).collect(), [r[:2] for r in rows], 5)


def test_shards_of_the_shared_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    check_shards(QUERIES["op4_sharding"](spark, sf).collect(), [(r.doc_id, r.text) for r in docs], 24)


def reshared(sizes):
    """Targets by handing on the excess, round by round. sizes: per source in order."""
    target, fixed, total = [0.0] * len(sizes), set(), float(sum(sizes))
    weight = [WEIGHTS[k % len(WEIGHTS)] for k in range(len(sizes))]
    while total > 1e-9 and len(fixed) < len(sizes):
        free = [k for k in range(len(sizes)) if k not in fixed]
        share = sum(weight[k] for k in free)
        for k in free:
            target[k] += total * weight[k] / share
        total = 0.0
        for k in free:
            if target[k] >= 3 * sizes[k]:
                total += target[k] - 3 * sizes[k]
                target[k] = 3.0 * sizes[k]
                fixed.add(k)
    return target


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 100, 100, 100], [0, 5, 7], [1000, 1, 1, 1, 2, 3], [0, 0], [5]])
def test_targets(spark, sizes):
    frame = spark.createDataFrame([(f"s{k}" if k else None, n, 1) for k, n in enumerate(sizes)],
                                  "source string, source_size long, n_docs long")
    found = {r.source: r.target for r in source_targets(frame).collect()}
    order = [f"s{k}" for k in range(1, len(sizes))] + [None]
    want = reshared([*sizes[1:], sizes[0]])
    assert [found[s] for s in order] == pytest.approx(want)


def test_settling_keeps_the_sum_and_the_means():
    sizes, parts = [50, 40, 30, 7, 7, 3, 0, 1], [0.3, 0.7, 0.55, 0.2, 0.9, 0.5, 0.4, 0.25]
    mean = [0.0] * len(sizes)
    for seed in range(4000):
        done, left = settle(sizes, parts, random.Random(seed))
        assert sum(s * p for s, p in zip(sizes, done)) == pytest.approx(sum(s * p for s, p in zip(sizes, parts)))
        assert all(p in (0.0, 1.0) for k, p in enumerate(done) if k != left)
        mean = [m + p / 4000 for m, p in zip(mean, done)]
    assert mean[:6] == pytest.approx(parts[:6], abs=0.04)


def check_mix(rows, docs):
    """docs: (id, text, source)."""
    assert collections.Counter((r.doc_id, r["size"], r.source) for r in rows) == collections.Counter(
        (d, len(edge.words(t)), s) for d, t, s in docs)
    taken, largest = collections.Counter(), collections.Counter()
    for r in rows:
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 3
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    for r in rows:
        assert abs(taken[r.source] - r.target) <= largest[r.source] / 2 + 1e-6
    targets = {r.source: r.target for r in rows}
    if rows:
        assert sum(targets.values()) == pytest.approx(sum(r["size"] for r in rows))


@pytest.mark.parametrize("block_rows", [2, 3, 1024])
def test_mix_of_odd_documents(spark, block_rows):
    docs = edge.documents(spark)
    mixed = mix_sources(docs, block_rows=block_rows, fan_in=2).collect()
    check_mix(mixed, [(r[0], r[1], r[3]) for r in edge.ROWS])
    again = mix_sources(docs.repartition(5), block_rows=block_rows, fan_in=2).collect()
    assert collections.Counter(mixed) == collections.Counter(again)


def test_mix_of_the_shared_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    check_mix(QUERIES["op6_mixing"](spark, sf).collect(), [(r.doc_id, r.text, r.source) for r in docs])


def test_empty_tables(spark):
    assert shard_by_bytes(edge.documents(spark, []), 24).collect() == []
    assert mix_sources(edge.documents(spark, [])).collect() == []
