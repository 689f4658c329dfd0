"""Keys that hold half of all rows: the largest task holds at most twice the median, results stay right."""

import collections

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from tablevitals.llm import components as cc
from tablevitals.llm import mixing
from tablevitals.llm import near_dedup as near
from tablevitals.llm.common import hot_join
from tablevitals.llm.line_dedup import line_dedup
from tests.llm import edge


def task_sizes(frame):
    return sorted(r["count"] for r in frame.groupBy(F.spark_partition_id()).count().collect())


@pytest.fixture
def as_planned(spark):
    """No adaptive re-planning: what tasks hold is what the plan deals them; joins shuffle."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("known", [False, True])
def test_a_hot_key_is_joined_by_many_tasks(spark, as_planned, known):
    rows = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    facts = rows.select("k").distinct().withColumn("fact", F.col("k") * 10)
    counts = rows.groupBy("k").agg(F.count("*").alias("n")) if known else None
    joined = hot_join(rows, facts, ["k"], ["v"], counts)
    sizes = task_sizes(joined)
    assert len(sizes) == 8 and sizes[-1] <= 2 * sizes[4]
    assert {(r.k, r.v, r.fact) for r in joined.collect()} == {(r.k, r.v, r.k * 10) for r in rows.collect()}
    plain = task_sizes(rows.join(facts, ["k"]))
    assert plain[-1] > 2 * plain[4]


def test_components_of_a_hot_star(spark, monkeypatch):
    """Portions too small for all edges: rounds of joins, with a centre that has half of the edges."""
    monkeypatch.setattr(cc, "EDGES", 300)
    draw = np.random.default_rng(3)
    pairs = [(0, k) for k in range(1, 2000)] + [(5000 + k, 5001 + k) for k in range(0, 900)] + [
        (int(a), int(b)) for a, b in draw.integers(10_000, 12_000, (1100, 2))]
    found = cc.components(spark.createDataFrame(pairs, "a long, b long").repartition(9))
    nodes, root = cc.roots(*np.array([p for p in pairs if p[0] != p[1]]).T)
    assert {r.node: r.component for r in found.collect()} == dict(zip(nodes.tolist(), root.tolist()))
    parent = {n: n for p in pairs for n in p}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    assert {n: r for n, r in zip(nodes.tolist(), root.tolist())} == {n: top(n) for n in nodes.tolist()}


def test_rows_alike_enter_a_block_once(spark, monkeypatch):
    """20,000 rows without an id and with one text among 300 others: no block holds them all, and the mix is met."""
    rows = [(None, "one hot text of seven words here", "en", "s", 1)] * 20_000 + [
        (k, " ".join(["w"] * (k % 40 + 1)), "en", "t" if k % 3 else "u", 1) for k in range(300)]
    docs = edge.documents(spark, rows)
    found = mixing.mix_sources(docs, block_rows=64)
    taken, targets = collections.Counter(), {}
    for r in found.collect():
        taken[r.source] += r.taken
        targets[r.source] = r.target
        assert r.taken <= 3 * r.size
    assert found.count() == len(rows)
    for source, target in targets.items():
        assert abs(taken[source] - target) <= 40


def test_the_mixing_stage_repeats_no_row_too_often(spark, sf):
    stage = dict(corpus_pipeline.STAGES)["mixing"]
    rows = [(1, "same words in all of them", "en", "s", 1)] * 40 + [(2, "other words", "en", "s", 1), (None, None, "en", None, None),
                                                                   (3, "", "en", "t", 0), (4, "last one", "de", "t", 1)]
    docs = edge.documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    wanted = collections.Counter()
    for r in mixing.mix_sources(docs).collect():
        wanted[r.doc_id] += r.copies
    got = collections.Counter(r.doc_id for r in stage(spark, docs, sf).collect())
    assert got == +wanted and 30 <= got[1] <= 50


def test_a_window_on_half_of_all_texts(spark):
    rows = [(k, f"a\nb\nc\nown {k}" if k % 2 else f"own {k}\nand {k}\nmore {k}", "en", "s", 1) for k in range(4000)]
    found = {r.doc_id: r.text for r in line_dedup(edge.documents(spark, rows)).collect()}
    assert found == {k: t if k == 1 or k % 2 == 0 else f"own {k}" for k, t, *_ in rows}


@pytest.mark.parametrize("block, items", [(16_384, 2_000_000), (40, 900)])
def test_mutants_in_small_blocks(spark, monkeypatch, block, items):
    """Grids of many blocks and chunks give the same components as one block."""
    monkeypatch.setattr(near, "BLOCK", block)
    monkeypatch.setattr(near, "BLOCK_ITEMS", items)
    draw = np.random.default_rng(5)
    base = [f"b{k}" for k in range(80)]
    rows = [(d, " ".join(w if draw.random() > d / 1500 else f"m{d}x{k}" for k, w in enumerate(base)), "en", "s", 1) for d in range(150)]
    found = near.near_dedup(edge.documents(spark, rows)).collect()
    want = edge.components({d: edge.shingles(t) for d, t, *_ in rows})
    assert len(set(want.values())) > 5 and {r.doc_id: r.component_id for r in found} == want


def test_overlaps_count_common_and_rare_shingles():
    draw = np.random.default_rng(9)
    common = draw.integers(0, 2**63, 60)
    sets = [np.unique(np.concatenate([draw.choice(common, 40), draw.integers(0, 2**63, draw.integers(0, 30)), draw.choice(99, 3)])) for _ in range(70)]
    for guests, members in ((sets[:30], sets[30:]), (sets[:1], sets[1:2]), ([np.array([1])], [np.array([2])])):
        found = near._Overlaps(guests, members).of(guests)
        assert found.tolist() == [[len(np.intersect1d(a, b)) for b in members] for a in guests]


def test_hot_keys_are_told_without_a_join(spark, as_planned):
    rows = spark.range(9000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3 - 9).otherwise(F.col("id")).alias("k"),
                                    F.lit("x").alias("l"), F.col("id").alias("v"))
    facts = rows.where("k < 6000").select("k", "l").distinct().withColumn("fact", F.col("k") * 10)
    joined = hot_join(rows, facts, ["k", "l"], ["v"])
    assert {(r.k, r.v, r.fact) for r in joined.collect()} == {(r.k, r.v, r.k * 10) for r in rows.where("k < 6000").collect()}
    assert joined.count() == rows.where("k < 6000").count()
    steps = joined._jdf.queryExecution().executedPlan().toString()
    assert steps.count("Join") == 1 and "Outer" not in steps
