"""Exact, line and near dedup against brute force, on odd documents and on the shared tables."""

import collections
import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest

from tablevitals.llm import exact_dedup as exact
from tablevitals.llm import near_dedup as near
from tablevitals.llm.components import components
from tablevitals.llm.line_dedup import line_dedup
from tablevitals.llm.near_dedup import near_dedup
from tablevitals.llm.shingles import MinHash, shingle_sets
from tests.llm import edge


def test_exact_on_odd_documents(spark):
    found = exact.exact_dedup(edge.documents(spark)).collect()
    assert len(found) == len(edge.ROWS)
    groups = collections.defaultdict(list)
    for doc_id, text, *_ in edge.ROWS:
        groups[hashlib.sha256(edge.lower(text).encode()).hexdigest()].append(doc_id)
    for row in found:
        group = groups[row.text_sha256]
        keep = max((d for d in group if d is not None), default=None)
        assert row.doc_id in group and (row.keep_id, row.group_size) == (keep, len(group))
        assert row.kept == (row.doc_id == keep)


@pytest.mark.parametrize("counters", [1, 4, 1000])
def test_heavy_groups_change_nothing(spark, counters):
    rows = [(k, "hot" if k % 3 else ("warm" if k % 2 else f"cold {k}"), None, None, None) for k in range(600)]
    docs = edge.documents(spark, rows)
    found = {r.doc_id: (r.keep_id, r.group_size) for r in exact.exact_dedup(docs, counters=counters).collect()}
    want = collections.defaultdict(list)
    for doc_id, text, *_ in rows:
        want[text].append(doc_id)
    assert found == {d: (max(g), len(g)) for g in want.values() for d in g}


def test_heavy_groups_are_found_exactly(spark):
    frame = spark.createDataFrame([(k, bytes([0 if k % 2 else k % 251])) for k in range(2000)], "doc_id long, digest binary")
    heavy = exact.heavy_groups(frame.repartition(7), 8).collect()
    assert [(r.digest, r.keep_id, r.group_size) for r in heavy] == [
        (b"\0", 1999, 1000 + len([k for k in range(0, 2000, 2) if k % 251 == 0]))]


def test_misra_gries_bound():
    values = [b"a"] * 50 + [b"%d" % k for k in range(100)] + [b"a"] * 30
    batches = [pa.RecordBatch.from_pydict({"d": pa.array(values[at:at + 20], pa.binary())}) for at in range(0, 180, 20)]
    out = {k: v for b in exact.misra_gries(iter(batches), 4) for k, v in zip(*(c.to_pylist() for c in b.columns))}
    assert len(out) <= 4 and 80 - 180 / 5 <= out[b"a"] <= 80


def test_lines_on_odd_documents(spark):
    rows = edge.ROWS + [(20, "x\ny\nz", "en", "s", 5), (21, "x\ny\nz\n", "en", "s", 6), (22, "k\nx\ny\nz\nx\ny\nz", "en", "s", 12)]
    found = line_dedup(edge.documents(spark, rows))
    assert {"with.dot", "keep_id", "n_lines", "n_removed"} <= set(found.columns)
    got = collections.Counter((r.doc_id, r.text) for r in found.collect())
    assert got == collections.Counter(zip([r[0] for r in rows], edge.deduped_lines([r[:2] for r in rows])))
    by_id = {r.doc_id: (r.n_lines, r.n_removed) for r in found.collect()}
    assert by_id[3] == (0, 0) and by_id[4] == (0, 0) and by_id[5] == (2, 0) and by_id[20][1] == 0 and by_id[21] == (4, 3)


def test_passages_inside_long_lines(spark):
    """A passage of 60 words in the middle of one-line texts goes from the later ones if long lines are broken."""
    def own(name, n):
        return " ".join(f"{name}{k}" for k in range(n))

    passage = own("p", 60)
    rows = [(k, f"{own(f'a{k}x', 7 * k + 3)} {passage} {own(f'b{k}x', 30)}", "en", "s", 1) for k in range(4)]
    rows.append((9, f"{own('c', 30)}\nshort line\n{passage}", "en", "s", 1))
    docs = edge.documents(spark, rows)
    assert {r.doc_id: r.text for r in line_dedup(docs).collect()} == {r[0]: r[1] for r in rows}
    found = {r.doc_id: r for r in line_dedup(docs, break_over=20).collect()}
    assert found[0].text == rows[0][1]
    for doc_id, text, *_ in rows[1:]:
        left = found[doc_id].text.split()
        assert sum(w[0] == "p" for w in left) <= 30 and found[doc_id].n_removed == 0
        assert [w for w in text.split() if w[0] != "p"] == [w for w in left if w[0] != "p"]


def test_near_on_odd_documents(spark):
    rows = edge.ROWS + [(30 + k, " ".join(["w%d" % j for j in range(60)][:60 - k]), "en", "s", 9) for k in range(8)]
    found = near_dedup(edge.documents(spark, rows)).collect()
    assert len(found) == len(rows)
    want = edge.components({d: edge.shingles(t) for d, t, *_ in rows if d is not None})
    sizes = collections.Counter((d, len(edge.shingles(t))) for d, t, *_ in rows)
    assert collections.Counter((r.doc_id, r.n_shingles) for r in found) == sizes
    for row in found:
        assert row.component_id == want.get(row.doc_id)
        assert row.kept == (row.doc_id == row.component_id)


def test_near_chain_through_unlike_ends(spark):
    """Neighbours of the chain are linked, its ends share little: one component all the same."""
    rows = [(k, " ".join(f"w{j}" for j in range(2 * k, 2 * k + 40)), "en", "s", 1) for k in range(30)]
    found = near_dedup(edge.documents(spark, rows)).collect()
    assert {r.doc_id: r.component_id for r in found} == edge.components({d: edge.shingles(t) for d, t, *_ in rows})


def test_near_group_of_mutants(spark):
    """Many copies with several words changed, of which some are linked with few others or none."""
    draw = np.random.default_rng(5)
    base = [f"b{k}" for k in range(80)]
    rows = []
    for d in range(150):
        text = [w if draw.random() > d / 1500 else f"m{d}x{k}" for k, w in enumerate(base)]
        rows.append((d, " ".join(text), "en", "s", 1))
    found = near_dedup(edge.documents(spark, rows)).collect()
    want = edge.components({d: edge.shingles(t) for d, t, *_ in rows})
    assert len(set(want.values())) > 5 and {r.doc_id: r.component_id for r in found} == want


def test_near_on_the_shared_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = edge.components({r.doc_id: edge.shingles(r.text) for r in docs.collect()})
    assert {r.doc_id: r.component_id for r in near_dedup(docs).collect()} == want


def test_shingle_sets_match_words():
    texts = [r[1] for r in edge.ROWS] + ["tab\tand\x0bform\x0cfeeds", "A b  C", "a B c", "  x"]
    sets = shingle_sets(pa.array(texts, pa.string()))
    assert [len(s) for s in sets] == [len(edge.shingles(t)) for t in texts]
    assert sets[0].tolist() == sets[1].tolist() and sets[-3].tolist() == sets[-2].tolist()
    sliced = shingle_sets(pa.array(["pad"] + texts, pa.string()).slice(1))
    assert all((a == b).all() for a, b in zip(sets, sliced, strict=True))


def test_long_words_and_texts_hash_alike():
    word = "v" * 2_500_000
    a, b = shingle_sets(pa.array([f"x {word} y z u t " + "p q r s " * 300_000, f"X {word} Y z u t " + "p q r s " * 300_000]))
    assert a.tolist() == b.tolist() and len(a) == 6 + 4


def test_odd_sketches_estimate_similarity():
    law, draw = MinHash(32, 4, 256), np.random.default_rng(1)
    for similarity in (0.6, 0.75, 0.9):
        cells = []
        for _ in range(40):
            items = draw.integers(0, 2**63, 1000, dtype=np.uint64)
            rest = int(round(1000 * (1 - similarity) / (1 + similarity)))
            sets = [np.sort(items), np.sort(np.concatenate([items[rest:], draw.integers(0, 2**63, rest, dtype=np.uint64)]))]
            sketch = law.odd_sketches(law.samples(sets))
            cells.append(np.bitwise_count(sketch[0] ^ sketch[1]).sum())
        assert abs(np.mean(cells) - law.most_different_cells(similarity)) < 4


@pytest.mark.parametrize("similarity", [0.75, 0.76, 0.78, 0.8])
def test_sketches_lose_fewer_pairs_than_bands(similarity):
    """Exact odds: of the samples that differ, either side's falls into a cell and turns its parity."""
    odds, cells = np.eye(1, near.BITS + 1)[0], np.arange(near.BITS + 1) / near.BITS
    lost, samples = 0.0, near.BANDS * near.ROWS
    most = MinHash(near.BANDS, near.ROWS, near.BITS).most_different_cells(near.LEAST_ESTIMATE)
    for differ in range(samples + 1):
        lost += math.comb(samples, differ) * (1 - similarity) ** differ * similarity ** (samples - differ) * odds[most + 1:].sum()
        for _ in range(2):
            up, down = odds * (1 - cells), odds * cells
            odds = np.concatenate([[0], up[:-1]]) + np.concatenate([down[1:], [0]])
    assert lost < (1 - similarity ** near.ROWS) ** near.BANDS


def test_components_of_a_long_path(spark):
    pairs = [(k, k + 1) for k in range(40)] + [(100, 101), (102, 101), (7, 7)]
    found = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r.node: r.component for r in found} == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}


@pytest.mark.parametrize("operator", [exact.exact_dedup, line_dedup, near_dedup])
def test_empty_tables(spark, operator):
    assert operator(edge.documents(spark, [])).collect() == []
