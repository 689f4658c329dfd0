"""MinHash near-dedup with odd sketches.

MinHash samples of the word shingles go into bands, which put similar texts into common buckets, and are folded
into odd sketches: bitmaps of parities whose XOR population count estimates how similar two sets are. Candidates
of the buckets are first held against that estimate, then confirmed on the full sets.

A bucket is never expanded into all its pairs. First every text is held against the smallest one of each of its
buckets. What is linked then forms components; only buckets whose texts lie in several components are looked at
again: each text is held against its most similar partner in another component. When these have been linked too,
texts that the sketches still leave near some text of another component are clustered over the buckets in which they
are. Each goes into its cluster once, with its whole set, and there all that lie in different components are compared
exactly. Such comparisons happen inside tasks, in a grid of bounded blocks: what leaves a task is one row for each
text, or links that join two components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablevitals.llm.common import hot_join, ref, slices, small_batches
from tablevitals.llm.components import components
from tablevitals.llm.shingles import MinHash, shingle_sets
from tablevitals.session import materialize

#: 32 bands of 4 samples miss a pair of similarity 0.75 once in 200,000, one of 0.8 once in 10 million.
BANDS, ROWS, BITS = 32, 4, 256
#: A link is confirmed from this many hundredths on.
PERCENT = 75
#: Estimates from 128 samples and 256 cells are off by 0.045; pairs that seem this far below are let go. That
#: loses a pair of similarity 0.75 once in 500,000, less often than the bands.
LEAST_ESTIMATE = 0.46
#: Texts of a bucket, and shingles of a cluster, that a task compares at once with as many outside the main component.
BLOCK, BLOCK_ITEMS = 16_384, 2_000_000
#: Texts whose comparisons with a block are held at once.
STRIP = 256
#: Ids that may be broadcast at once (8 bytes each); more are shuffled.
MOST_BROADCAST = 1_000_000
SKETCH = [f"sketch{k}" for k in range(BITS // 64)]


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_shingles, high, low, sketch words, bands): high and low are a digest of the whole set."""
    law = MinHash(BANDS, ROWS, BITS)
    for batch in batches:
        for cut in slices(batch.column("text")):
            part = batch.slice(cut.start, cut.stop - cut.start)
            sets = shingle_sets(part.column("text"))
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
            filled = [k for k, s in enumerate(sets) if len(s)]
            samples = law.samples([sets[k] for k in filled])
            sketches = np.zeros((len(sets), len(SKETCH)), np.uint64)
            sketches[filled] = law.odd_sketches(samples)
            counts = np.zeros(len(sets), np.int64)
            counts[filled] = BANDS
            bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)),
                                             _signed(law.band_keys(samples).reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests[:, 0]),
                 pa.array(digests[:, 1]), *(_signed(sketches[:, k]) for k in range(len(SKETCH))), bands],
                names=["doc_id", "n_shingles", "high", "low", *SKETCH, "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for cut in slices(batch.column("text")):
            part = batch.slice(cut.start, cut.stop - cut.start)
            sets = shingle_sets(part.column("text"))
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), _signed(np.concatenate(sets)))],
                names=["doc_id", "items"])


def _alike(a: str, b: str) -> Column:
    """Whether the sketches of two rows leave a link possible."""
    different = reduce(add, [F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in SKETCH])
    return different <= MinHash(BANDS, ROWS, BITS).most_different_cells(LEAST_ESTIMATE)


def _sets_of(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, items) of the documents in ``ids``."""
    ids = materialize(ids.distinct())
    few = ids.count() <= MOST_BROADCAST
    return materialize(texts.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").mapInArrow(
        _sets, "doc_id long, items array<long>"))


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Adds ``linked`` to distinct pairs (a, b): whether their full sets share 75 of 100 shingles."""
    sets = _sets_of(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), texts)
    own, other = sets.toDF("a", "items_a"), sets.toDF("b", "items_b")
    shared = F.size(F.array_intersect("items_a", "items_b"))
    return materialize(hot_join(pairs, other, ["b"], ["a"]).join(own, "a").select("a", "b", (
        100 * shared >= PERCENT * (F.size("items_a") + F.size("items_b") - shared)).alias("linked")))


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The groups of a partition that is sorted by ``keys``."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        if held.num_rows == 0:
            continue
        new = np.zeros(held.num_rows - 1, bool)
        for key in keys:
            values = held[key].to_numpy()
            new |= values[1:] != values[:-1]
        cuts = [0, *(np.flatnonzero(new) + 1).tolist()]
        for lo, hi in zip(cuts, cuts[1:]):
            yield held.slice(lo, hi - lo)
        held = held.slice(cuts[-1]).combine_chunks()
    if held is not None and held.num_rows:
        yield held


def _best(rows: pa.Table) -> Iterator[tuple[np.ndarray, ...]]:
    """(a, b): the most similar member of another component for each guest, as far as sketches leave a link possible."""
    for doc, members, cells, most in _cells(rows):
        j = cells.argmin(axis=1)
        near = cells[np.arange(len(doc)), j] <= most
        x, y = doc[near], members[j[near]]
        yield np.maximum(x, y), np.minimum(x, y)


def _open(rows: pa.Table) -> Iterator[tuple[np.ndarray, ...]]:
    """(bucket, doc_id): guests and members that sketches leave near each other across components, each once."""
    near_members = None
    for doc, members, cells, most in _cells(rows):
        near = cells <= most
        near_members = near.any(axis=0) if near_members is None else near_members | near.any(axis=0)
        doc = doc[near.any(axis=1)]
        yield np.repeat(rows["bucket"][0].as_py(), len(doc)), doc
    if near_members is not None:
        doc = members[near_members]
        yield np.repeat(rows["bucket"][0].as_py(), len(doc)), doc


def _cells(rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Strips of guests: their ids, those of all members, and how many cells differ (too many within a component)."""
    most = MinHash(BANDS, ROWS, BITS).most_different_cells(LEAST_ESTIMATE)
    doc, comp, guest = (rows[c].to_numpy() for c in ("doc_id", "comp", "guest"))
    sketch = np.stack([rows[c].to_numpy() for c in SKETCH], axis=1).view(np.uint64)
    x, y = np.flatnonzero(guest), np.flatnonzero(~guest)
    for at in range(0, len(x) if len(y) else 0, STRIP):
        mine = x[at:at + STRIP]
        cells = np.zeros((len(mine), len(y)), np.int32)
        for k in range(sketch.shape[1]):
            cells += np.bitwise_count(sketch[mine, k][:, None] ^ sketch[y, k][None, :])
        cells[comp[mine][:, None] == comp[y][None, :]] = most + 1
        yield doc[mine], doc[y], cells, most


class _Overlaps:
    """How many shingles the guests of a block share with each of its members.

    Shingles that many of both have are columns of 0/1 matrices, whose product counts them; for the others, the
    members that have them are looked up. Both counts are exact.
    """

    def __init__(self, guests: list[np.ndarray], members: list[np.ndarray]):
        self.n = len(members)
        items, self.sizes = np.concatenate(members), np.array([len(s) for s in members])
        owner = np.repeat(np.arange(self.n), self.sizes)
        common = np.intersect1d(np.unique(np.concatenate(guests)), np.unique(items), assume_unique=True)
        self.common = common
        item, inside = self._places(items)
        item, owner = item[inside], owner[inside]
        in_guests = np.bincount(np.concatenate([p[i] for p, i in map(self._places, guests)]), minlength=len(common))
        in_members = np.bincount(item, minlength=len(common))
        dense = in_guests * in_members > len(guests) * self.n / 32
        self.column = np.where(dense, np.cumsum(dense) - 1, -1)
        column = self.column[item]
        self.matrix = np.zeros((int(dense.sum()), self.n), np.float32)
        self.matrix[column[column >= 0], owner[column >= 0]] = 1
        rare, self.owner = item[column < 0], owner[column < 0]
        order = np.argsort(rare, kind="stable")
        self.owner, self.begin = self.owner[order], np.searchsorted(rare[order], np.arange(len(common) + 1))

    def _places(self, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.minimum(np.searchsorted(self.common, items), max(len(self.common) - 1, 0))
        return place, (self.common[place] == items) if len(self.common) else np.zeros(len(items), bool)

    def of(self, guests: list[np.ndarray]) -> np.ndarray:
        item, inside = self._places(np.concatenate(guests))
        row = np.repeat(np.arange(len(guests)), [len(s) for s in guests])[inside]
        item = item[inside]
        column = self.column[item]
        mine = np.zeros((len(guests), len(self.matrix)), np.float32)
        mine[row[column >= 0], column[column >= 0]] = 1
        shared = (mine @ self.matrix).astype(np.int64)
        row, item = row[column < 0], item[column < 0]
        n = self.begin[item + 1] - self.begin[item]
        ends = np.cumsum(n)
        at = 0
        while at < len(n):  # a few million lookups at a time
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 22), "right")))
            many, before = n[at:upto], ends[at:upto] - n[at:upto]
            found = np.repeat(self.begin[item[at:upto]], many) + np.arange(int(many.sum())) - np.repeat(before - before[0], many)
            flat = np.repeat(row[at:upto], many) * self.n + self.owner[found]
            shared += np.bincount(flat, minlength=shared.size).reshape(shared.shape)
            at = upto
        return shared


def _linked(rows: pa.Table) -> Iterator[tuple[np.ndarray, ...]]:
    """(a, b): links between guests and members of different components, enough to join what they join."""
    doc, comp, guest = (rows[c].to_numpy() for c in ("doc_id", "comp", "guest"))
    lists = rows["items"].combine_chunks()
    ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
    sets = np.split(lists.flatten().to_numpy(zero_copy_only=False), ends[:-1])
    x, y = np.flatnonzero(guest), np.flatnonzero(~guest)
    if not len(x) or not len(y):
        return
    _, comp = np.unique(comp, return_inverse=True)
    root = np.arange(comp.max() + 1)
    overlaps = _Overlaps([sets[k] for k in x], [sets[k] for k in y])
    for at in range(0, len(x), STRIP):
        mine = x[at:at + STRIP]
        shared = overlaps.of([sets[k] for k in mine])
        sizes = np.array([len(sets[k]) for k in mine])[:, None] + overlaps.sizes[None, :]
        i, j = np.nonzero(100 * shared >= PERCENT * (sizes - shared))
        while True:  # one link per guest and round, until all that is linked is one
            apart = root[comp[mine[i]]] != root[comp[y[j]]]
            i, j = i[apart], j[apart]
            if not len(i):
                break
            _, first = np.unique(i, return_index=True)
            found = []
            for a, b in zip(mine[i[first]].tolist(), y[j[first]].tolist()):
                one, two = sorted((root[comp[a]], root[comp[b]]))
                if one != two:
                    root[root == two] = one
                    found.append((max(doc[a], doc[b]), min(doc[a], doc[b])))
            yield tuple(np.array(found, np.int64).T)


def _each_group(step: Callable, keys: tuple[str, ...], names: list[str]) -> Callable:
    """``step`` for every group of a sorted partition, as record batches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, keys):
            for columns in step(rows):
                for at in range(0, len(columns[0]), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[at:at + 100_000]) for c in columns], names=names)
    return run


def _grid(placed: DataFrame, key: str, weight: str, most: int) -> DataFrame:
    """Texts (key, doc_id, comp, weight) of keys with several components, dealt to a grid: key, block, chunk, doc_id, comp, guest.

    Members, all texts of the key, lie in blocks of about ``most``; guests, those outside its heaviest component, in
    chunks of about ``most``. Every chunk meets every block: rows are copied once for every ``most`` guests or members.
    """
    def parts(of: str):
        return F.greatest(F.lit(1).cast("long"), F.ceil(F.col(of) / most))

    sizes = placed.groupBy(key, "comp").agg(F.sum(weight).alias("weight"), F.count("*").alias("n"))
    split = (sizes.groupBy(key).agg(F.max(F.struct("weight", "comp")).alias("main"), F.sum("weight").alias("total"),
                                    F.sum("n").alias("n"), F.count("*").alias("comps"))
             .where("comps > 1").withColumn("outside", F.col("total") - F.col("main.weight"))
             .select(key, "n", F.col("main.comp").alias("main"), parts("total").alias("blocks"), parts("outside").alias("chunks")))
    split = materialize(split)
    rows = hot_join(placed, split.drop("n"), [key], ["doc_id"], split)
    members = rows.select(key, F.pmod(F.xxhash64("doc_id"), "blocks").alias("block"),
                          F.explode(F.expr("sequence(0L, chunks - 1)")).alias("chunk"), "doc_id", "comp", F.lit(0).alias("guest"))
    guests = rows.where("comp <> main").select(
        key, F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"),
        F.pmod(F.xxhash64("doc_id", F.lit(1)), "chunks").alias("chunk"), "doc_id", "comp", F.lit(1).alias("guest"))
    return members.unionByName(guests)


def _compared(grid: DataFrame, facts: DataFrame, step: Callable, names: list[str]) -> DataFrame:
    """What ``step`` finds in the cells of a grid whose texts have been given their facts."""
    keys = (grid.columns[0], "block", "chunk")
    rows = grid.join(facts, "doc_id")
    rows = rows.withColumn("guest", F.col("guest") == 1).select(*keys, "doc_id", "comp", "guest", *[
        c for c in facts.columns if c != "doc_id"])
    rows = rows.repartition(*keys).sortWithinPartitions(*keys)
    return materialize(rows.mapInArrow(_each_group(step, keys, names), ", ".join(f"{c} long" for c in names)).distinct())


def _placed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds each text's component to members."""
    return materialize(members.join(labels, members["doc_id"] == labels["node"], "left").select(
        *members.columns, F.coalesce("component", "doc_id").alias("comp")))


def _clusters(rows: DataFrame) -> DataFrame:
    """(doc_id, cluster) of texts that buckets (bucket, doc_id) connect, without their components so far."""
    first = materialize(rows.groupBy("bucket").agg(F.min("doc_id").alias("b"), F.count("*").alias("n")))
    links = hot_join(rows, first.drop("n"), ["bucket"], ["doc_id"], first).select(F.col("doc_id").alias("a"), "b")
    return components(materialize(links)).toDF("doc_id", "cluster")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    The set of a text is its distinct five-word shingles, A-Z lower-cased; fewer words are one shingle, and a missing
    or blank text has an empty set, linked with nothing. Texts with 100 * shared >= 75 * united shingles are linked;
    a component is what links reach, named by its smallest id, and that document is kept. Rows of one id count as
    one document. A document without an id has no component and is kept. Other columns are ignored whatever their
    names; an empty table gives none.
    """
    with small_batches(docs.sparkSession):  # all steps that use Python run in here
        return _near_dedup(docs, id_col, text_col)


def _near_dedup(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    texts = docs.select(ref(id_col).cast("long").alias("doc_id"), ref(text_col).alias("text"))
    words = ", ".join(f"{c} long" for c in SKETCH)
    described = materialize(texts.mapInArrow(
        _described, f"doc_id long, n_shingles long, high long, low long, {words}, bands array<long>"))
    linkable = described.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # Equal sets are one class, named by its smallest id; only classes are compared.
    classes = materialize(linkable.groupBy("high", "low").agg(F.min(F.struct("doc_id", *SKETCH, "bands")).alias("first")).select(
        "high", "low", "first.*"))
    placed = materialize(classes.select("doc_id", F.explode("bands").alias("bucket")))
    marks = classes.select("doc_id", *SKETCH)
    pivots = materialize(placed.groupBy("bucket").agg(F.min("doc_id").alias("pivot"), F.count("*").alias("n")).where("n > 1"))
    members = materialize(hot_join(placed, pivots.drop("n"), ["bucket"], ["doc_id"], pivots).select("bucket", "doc_id", "pivot"))

    a, b = marks.toDF("a", *SKETCH).alias("x"), marks.toDF("b", *SKETCH)
    stars = materialize(members.where("doc_id <> pivot").select(F.col("doc_id").alias("a"), F.col("pivot").alias("b")).distinct())
    near = hot_join(stars, b, ["b"], ["a"]).alias("y").join(a, "a").where(_alike("x", "y"))
    tested = _confirmed(materialize(near.select("a", "b")), texts)
    members = members.select("bucket", "doc_id")
    placed = _placed(members, materialize(components(tested.where("linked")))).withColumn("weight", F.lit(1))
    best = _compared(_grid(placed, "bucket", "weight", BLOCK), marks, _best, ["a", "b"])
    untested = materialize(best.join(tested.select("a", "b"), ["a", "b"], "left_anti"))
    links = tested.unionByName(_confirmed(untested, texts)).where("linked").select("a", "b")
    labels = materialize(components(links))

    placed = _placed(members, labels).withColumn("weight", F.lit(1))
    rest = _compared(_grid(placed, "bucket", "weight", BLOCK), marks, _open, ["bucket", "doc_id"])
    sizes = linkable.groupBy("doc_id").agg(F.max("n_shingles").alias("weight"))
    clusters = _placed(_clusters(rest).join(sizes, "doc_id"), labels)
    found = _compared(_grid(clusters, "cluster", "weight", BLOCK_ITEMS), _sets_of(clusters.select("doc_id"), texts),
                      _linked, ["a", "b"])
    labels = materialize(components(links.unionByName(found)))

    named = classes.join(labels, F.col("doc_id") == F.col("node"), "left").select(
        "high", "low", F.coalesce("component", "doc_id").alias("component"))
    return (described.select("doc_id", "n_shingles", "high", "low").join(named, ["high", "low"], "left")
            .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")))
            .select("doc_id", "n_shingles", "component_id",
                    F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")))
