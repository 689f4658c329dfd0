"""Language, toxicity and neighbours: held-out accuracy, recall against brute force, odd rows."""

import collections
import math

import numpy as np
import pyarrow as pa
import pytest
import regex
import zstandard
from pyspark.sql import functions as F

from tablevitals.llm.catalog import QUERIES
from tablevitals.llm.language import LEVEL, PIECE, SOFTNESS, fit_dictionaries, identify_language
from tablevitals.llm.neighbours import cut_graph, nearest, nearest_neighbours
from tablevitals.llm.recurrent import STATE, STEP, WINDOW, Adam, Network, read_words, window_words, windows
from tablevitals.llm.toxicity import labelled_sample, score_toxicity, train
from tests.llm import edge


def every_row():
    return F.lit(True)


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {r.doc_id: r for r in QUERIES["op10_language"](spark, "/root/testdata/sf0.01").collect()}
    rows = docs.collect()
    held = [(r.lang, found[r.doc_id]) for r in rows if found[r.doc_id].held_out]
    assert len(found) == len(rows) and len(held) > 100
    assert np.mean([lang == row.lang_pred for lang, row in held]) > 0.97
    assert np.mean([row.rejected for _, row in held]) < 0.03
    assert all(0 <= r.score <= 1 for r in found.values())


def test_language_of_odd_documents(spark):
    docs = edge.documents(spark)
    found = identify_language(docs, F.col("lang"), every_row())
    assert set(docs.columns) | {"lang_pred", "score", "margin", "rejected"} == set(found.columns)
    rows = found.collect()
    assert collections.Counter(r.doc_id for r in rows) == collections.Counter(r[0] for r in edge.ROWS)
    for row in rows:
        letters = any(c.isalpha() for c in row.text or "")
        assert (row.lang_pred == "und") == (not letters) and row.lang_pred in ("en", "de", "und")
        assert row["score"] == 0 if not letters else 0 < row["score"] <= 1
        assert row.rejected or letters


def test_language_without_labels(spark):
    rows = identify_language(edge.documents(spark), F.col("lang"), F.lit(False)).collect()
    assert {(r.lang_pred, r["score"], r.rejected) for r in rows} == {("und", 0.0, True)}
    assert identify_language(edge.documents(spark, []), F.col("lang"), every_row()).collect() == []


def test_more_languages_than_are_learnt(spark):
    """Free-text labels: the commonest ones are learnt, and every document gets a prediction."""
    rows = [(k, f"odd words {k}", f"note {k}", "s", 1) for k in range(1100)]
    rows += [(2000 + k, " ".join(edge.WORDS[k % 5:k % 5 + 12]), "en", "s", 1) for k in range(30)]
    docs = edge.documents(spark, rows)
    learnt = fit_dictionaries(docs, F.col("lang"), every_row())
    assert len(learnt) == 1000 and next(iter(learnt)) == "en"
    assert set(learnt) == {"en", *sorted(f"note {k}" for k in range(1100))[:999]}
    few = fit_dictionaries(docs, F.col("lang"), every_row(), most_languages=1)
    assert list(few) == ["en"] and few["en"] == fit_dictionaries(docs, F.col("lang"), F.col("lang") == "en")["en"]
    found = identify_language(docs.where("doc_id % 100 = 1 OR doc_id >= 2000"), F.col("lang"), every_row()).collect()
    assert len(found) == 41 and all(r.lang_pred != "und" for r in found)


def labelled(spark):
    """Clean and toxic texts, the toxic ones with a bad word somewhere in the middle."""
    draw = np.random.default_rng(3)
    rows, labels = [], []
    for d in range(300):
        text = [edge.WORDS[k] for k in draw.integers(0, len(edge.WORDS), int(draw.integers(5, 150)))]
        if d % 3 == 0:
            text.insert(int(draw.integers(0, len(text))), str(draw.choice(["vilebad", "vilest", "horrid"])))
        rows.append((d, " ".join(text), "en", "s", 1))
        labels.append((d, int(d % 3 == 0)))
    return rows, spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_learns_from_whole_texts(spark):
    rows, labels = labelled(spark)
    unseen = [(1000, "calm words " * 200 + "so HORRID! " + "calm rain " * 300, None, None, None),
              (1001, "calm words " * 500, None, None, None), (1002, "the mill is vilesome", None, None, None)]
    bare = [(2000 + r[0], *r[1:]) for r in edge.ROWS[2:5]]
    found = {r.doc_id: r for r in score_toxicity(edge.documents(spark, rows + bare + unseen), labels,
                                                 F.col("doc_id") < 240).collect()}
    held = [(d % 3 == 0, found[d]["score"], found[d].predicted) for d in range(240, 300)]
    assert np.mean([toxic == (predicted == 1) for toxic, _, predicted in held]) > 0.95
    assert found[1000].predicted == 1 and found[1001].predicted == 0 and found[1002]["score"] > found[1001]["score"]
    assert found[2003]["score"] == found[2004]["score"] == found[2005]["score"] < 0.5
    assert all(0 <= r["score"] <= 1 and r.predicted == int(r["score"] >= 0.5) for r in found.values())


def test_toxicity_sample_holds_places_for_texts_alone(spark):
    """Labels without a document take no place, and texts over the length are learnt from when there are no others."""
    rows, labels = labelled(spark)
    docs = edge.documents(spark, rows).select("doc_id", "text")
    missing = spark.createDataFrame([(d, d % 2) for d in range(5000, 9000)], "doc_id long, toxic int")
    for chars in (20_000, 40, 10):
        texts, toxic = labelled_sample(docs, labels.unionByName(missing), every_row(), (60, 50), chars)
        assert (toxic.count(0), toxic.count(1)) == (60, 50) and max(map(len, texts)) <= chars
    short = {r[1] for r in rows if len(r[1]) <= 300}
    assert set(labelled_sample(docs, labels, every_row(), (5, 5), 300)[0]) <= short
    found = score_toxicity(edge.documents(spark, rows), labels, every_row(), chars=10).collect()
    assert len({r["score"] for r in found}) > 1


def test_toxicity_without_examples(spark):
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    rows = score_toxicity(edge.documents(spark), labels, every_row()).collect()
    assert len(rows) == len(edge.ROWS) and {r["score"] for r in rows} == {0.0}
    assert score_toxicity(edge.documents(spark, []), labels, every_row()).collect() == []


def test_toxicity_on_the_shared_table(spark, sf):
    rows = QUERIES["op5_toxicity"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_windows_cover_every_word():
    import pyarrow as pa

    texts = ["", "1 2", "one", " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(500)), None, "a b"]
    words = read_words(pa.array(texts, pa.string()))
    text, number = windows(words)
    ids = window_words(words, text, number)
    for k, t in enumerate(texts):
        seen = set(ids[text == k].ravel().tolist()) - {-1}
        assert len(seen) == len({w for w in (t or "").split() if w.isalpha()})
    assert np.diff(np.flatnonzero(number == 0)).min() >= 1 and len(set(text.tolist())) == len(texts)


def test_short_passages_lie_whole_in_a_window():
    import pyarrow as pa

    words = read_words(pa.array([" ".join(chr(97 + k // 26) + chr(97 + k % 26) for k in range(n)) for n in (20, 33, 100, 500)]))
    text, number = windows(words)
    ids = window_words(words, text, number)
    for k in range(4):
        own = words.ids[words.text_start[k]:words.text_start[k + 1]].tolist()
        whole = {tuple(row[at:at + 17]) for row in ids[text == k].tolist() for at in range(16)}
        assert all(tuple(own[at:at + 17]) in whole for at in range(len(own) - 16))


def test_gradients_match_differences():
    import pyarrow as pa

    words = read_words(pa.array(["red green blue tiny words", "some other words in green here now"]))
    network = Network(np.zeros(1 << 15, np.float32), np.zeros(1 << 15, np.float32))
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    text, number = windows(words)
    ids, wanted, ones = window_words(words, text, number), np.array([1.0, 0.0]), np.ones(2)

    class Keep(Adam):
        def step(self, parameters, grad):
            self.grad = grad

        def step_rows(self, table, name, rows, grad):
            self.rows = getattr(self, "rows", {}) | {name: (rows, grad)}

    keep = Keep()
    network.train_step(words, ids, wanted, ones, keep)

    def loss():
        probability = 1 / (1 + np.exp(-network.logits(words, text, number).astype(np.float64)))
        return float(-np.mean(wanted * np.log(probability) + (1 - wanted) * np.log(1 - probability)))

    for name, grad in keep.grad.items():
        flat = network.p[name].reshape(-1)
        for k in (0, len(flat) // 2, len(flat) - 1):
            kept, h = flat[k], 1e-3
            flat[k] = kept + h
            up = loss()
            flat[k] = kept - h
            down = loss()
            flat[k] = kept
            assert (up - down) / (2 * h) == pytest.approx(np.asarray(grad).reshape(-1)[k], rel=0.05, abs=2e-4), name
    rows, grad = keep.rows["word"]
    kept = network.p["word"][rows[0], 3]
    network.p["word"][rows[0], 3] = kept + 1e-3
    up = loss()
    network.p["word"][rows[0], 3] = kept - 1e-3
    assert (up - loss()) / 2e-3 == pytest.approx(grad[0, 3], rel=0.05, abs=2e-4)


VECTORS = "vec_id long, embedding array<float>, label int, rank int, part int, is_query boolean, block int"


def exact(rows, k):
    good = [(i, np.array(v, np.float64)) for i, v in rows
            if i is not None and v and None not in v and len(v) == 4 and all(map(math.isfinite, v)) and any(v)]
    out = {}
    for i, v in good:
        if i % 5 == 0:
            far = sorted({(float(np.sqrt(((w - v) ** 2).sum())), j) for j, w in good if j != i})
            out[i] = [(j, d) for d, j in far[:k]]
    return out


def test_neighbours_of_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0, 0, 0]), (1, [1.0, 0, 0, 0]), (2, [0.0, 1, 0, 0]), (3, None), (4, []), (5, [0.0, 0, 0, 0]),
            (6, [1.0, None, 0, 0]), (7, [nan, 0, 0, 0]), (8, [inf, 0, 0, 0]), (9, [1.0, 2.0]), (10, [0.5, 0.5, 0, 0]),
            (10, [0.5, 0.5, 0, 0]), (11, [-1.0, 0, 0, 0]), (15, [0.0, 0, 0, 2]), (None, [1.0, 1, 1, 1])]
    rows = [(i, v and [x if x is None else float(x) for x in v]) for i, v in rows]
    frame = spark.createDataFrame([(i, v, 1, 2, 3, True, 4) for i, v in rows], VECTORS).repartition(3)
    for k in (2, 10):
        found = nearest_neighbours(frame, F.col("vec_id") % 5 == 0, k).collect()
        got = collections.defaultdict(dict)
        for r in found:
            got[r.query_id][r["rank"]] = (r.vec_id, r["score"])
        want = exact(rows, k)
        assert {q: [v[n] for n in sorted(v)] for q, v in got.items()} == want


def test_neighbours_of_many_alike(spark):
    """A third of all vectors are the same; parts are learnt, blocks and query chunks are small."""
    draw = np.random.default_rng(7)
    centres = draw.standard_normal((12, 4))
    rows = [(i, [1.0, 2.0, 3.0, 4.0] if i % 3 == 0 else (centres[i % 12] + 0.1 * draw.standard_normal(4)).astype(
        np.float32).tolist()) for i in range(3000)]
    frame = spark.createDataFrame([(i, v, 1, 2, 3, True, 4) for i, v in rows], VECTORS)
    found = nearest_neighbours(frame, F.col("vec_id") % 5 == 0, 10, part_rows=128, block=300, asked=50).collect()
    want, got = exact(rows, 10), collections.defaultdict(list)
    for r in sorted(found, key=lambda r: r["rank"]):
        got[r.query_id].append((r.vec_id, r["score"]))
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    hits = sum(len(set(got[q]) & set(want[q])) for q in want)
    assert hits >= 0.95 * 10 * len(want) and all(got[q] == want[q] for q in want if q % 3 == 0)


def test_neighbours_recall_on_the_shared_table(spark):
    sf = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    points, ids = np.array(table.embedding.tolist(), np.float64), table.vec_id.to_numpy()
    found = collections.defaultdict(set)
    for r in QUERIES["op3_neighbours"](spark, sf).collect():
        found[r.query_id].add(r.vec_id)
    hits = 0
    for at in np.flatnonzero(ids % 100 == 0):
        far = np.sqrt(((points - points[at]) ** 2).sum(axis=1))
        far[at] = np.inf
        hits += len(found[ids[at]] & set(ids[np.lexsort((ids, far))[:10]].tolist()))
    assert hits >= 0.9 * 10 * len(found)


def test_parts_are_balanced_and_follow_the_graph():
    draw = np.random.default_rng(1)
    points = np.concatenate([c + draw.standard_normal((100, 8)) * 0.1 for c in draw.standard_normal((8, 8)) * 5])
    label = cut_graph(points, nearest(points, 10), 8)
    sizes = np.bincount(label, minlength=8)
    assert sizes.max() <= 106 and (label[nearest(points, 10)] == label[:, None]).mean() > 0.8


def test_no_vectors(spark):
    assert nearest_neighbours(spark.createDataFrame([], VECTORS), every_row()).collect() == []
    one = spark.createDataFrame([(100, [1.0, 2.0], 1, 2, 3, True, 4)], VECTORS)
    assert nearest_neighbours(one, every_row()).collect() == []



def plain_logit(network, text):
    """The worst window of one text: its words one by one, without batches, masks or shared gates."""
    p = {k: v.astype(np.float64) for k, v in network.p.items()}
    one = read_words(pa.array([text]))
    vectors = []
    for place in one.ids:
        grams = one.grams[one.gram_start[place]:one.gram_start[place + 1]]
        vectors.append(p["word"][one.bucket[place]] + p["gram"][grams].mean(axis=0))

    def states(run, side):
        h, out = np.zeros(STATE), []
        for x in run:
            given, own = x @ p[f"in_{side}"] + p[f"bias_{side}"], h @ p[f"state_{side}"]
            z, r = (1 / (1 + np.exp(-(given + own)[k * STATE:(k + 1) * STATE])) for k in (0, 1))
            new = np.tanh(given[2 * STATE:] + r * own[2 * STATE:])
            h = new + z * (h - new)
            out.append(h)
        return out

    worst = -np.inf
    for at in range(0, max(1, len(vectors) - WINDOW + STEP), STEP):
        run = vectors[at:at + WINDOW]
        if not run:
            return float(p["out_b"][0])
        both = np.concatenate([states(run, "f"), states(run[::-1], "b")[::-1]], axis=1)
        look = np.exp(both @ p["look"] - (both @ p["look"]).max())
        worst = max(worst, float((look / look.sum()) @ both @ p["out"] + p["out_b"][0]))
    return worst


def test_toxicity_equals_a_plain_forward_pass(spark, sf):
    """All scores of the shared table and of odd texts, from the same trained network."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(10**6 + k, r[1]) for k, r in enumerate(edge.ROWS) if len(r[1] or "") < 10_000],
                                                  "doc_id long, text string"))
    labels = spark.createDataFrame([(r.doc_id, r.doc_id % 2) for r in docs.limit(150).collect()], "doc_id long, toxic int")
    network = train(*labelled_sample(docs, labels, every_row(), (60, 60), 20_000))
    assert network is not None
    found = {r.doc_id: r["score"] for r in score_toxicity(docs, labels, every_row(), rows=(60, 60)).collect()}
    for row in docs.where("length(text) < 3000 OR text IS NULL").collect():
        want = 1 / (1 + np.exp(-plain_logit(network, row.text or "")))
        assert found[row.doc_id] == pytest.approx(want, abs=2e-4), row.doc_id


def test_language_equals_a_plain_loop(spark, sf):
    """Every prediction of the shared table: the language whose dictionary makes a text's pieces smallest."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2
    dictionaries = fit_dictionaries(docs, F.col("lang"), learn)
    found = {r.doc_id: r for r in QUERIES["op10_language"](spark, sf).collect()}
    packers = {}
    for name, body in dictionaries.items():
        shared = zstandard.ZstdCompressionDict(body, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        packers[name] = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=False, write_dict_id=False)
    for row in docs.collect():
        plain = regex.sub(r"[^\p{L}]+", " ", (row.text or "").lower()).strip(" ").encode()
        sizes = {name: sum(len(c.compress(plain[at:at + PIECE])) for at in range(0, len(plain), PIECE)) for name, c in packers.items()}
        want = min(sizes, key=lambda name: (sizes[name], [*packers].index(name))) if plain else "und"
        assert found[row.doc_id].lang_pred == want
        if plain:
            share = 1 / sum(np.exp(-(size - sizes[want]) / SOFTNESS) for size in sizes.values())
            assert found[row.doc_id]["score"] == pytest.approx(share)
