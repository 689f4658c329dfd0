"""Toxicity of whole texts by a small recurrent network over overlapping windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablevitals.llm import recurrent
from tablevitals.llm.common import ref, slices
from tablevitals.llm.recurrent import Adam, Network, Words, read_words, window_words, windows
from tablevitals.session import materialize

#: Texts by which the odds of a rare word are drawn towards those of all words.
IMAGINED = 8


def labelled_sample(docs: DataFrame, labels: DataFrame, learn: Column, rows: tuple[int, int],
                    chars: int) -> tuple[list[str], list[int]]:
    """``rows`` texts at most of label 0 and 1, chosen by a hash of the id among the documents that have a text.

    labels: doc_id and toxic (0 or 1). A document with several labels counts as toxic if one says so. Texts of more than
    ``chars`` characters come after the others, as only a stretch of so many, at a place given by a hash, is learnt from.
    """
    known = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & learn).groupBy("doc_id")
             .agg(F.max("toxic").alias("toxic")))
    length = F.char_length("text")
    there = docs.where(length.isNotNull()).groupBy("doc_id").agg(F.min(length > chars).alias("long"))
    known = materialize(known.join(there, "doc_id"))
    chosen = [known.where(F.col("toxic") == side).orderBy("long", F.xxhash64("doc_id"), "doc_id").limit(rows[side])
              for side in (0, 1)]
    # At most sum(rows) ids.
    ids = F.broadcast(chosen[0].unionByName(chosen[1]).select("doc_id", "toxic"))
    start = F.pmod(F.xxhash64("text"), F.greatest(F.lit(1), length - chars + 1)).cast("int") + 1
    texts = docs.join(ids, "doc_id").where(length.isNotNull()).select(
        "doc_id", "toxic", F.struct((length > chars).alias("long"), F.substring("text", start, F.lit(chars)).alias("text"))
        .alias("best"))
    found = texts.groupBy("doc_id").agg(F.min("best").alias("best"), F.first("toxic").alias("toxic")).select(
        "doc_id", "best.text", "toxic").collect()
    found.sort(key=lambda row: row["doc_id"])
    return [row["text"] for row in found], [int(row["toxic"]) for row in found]


def _odds(bad: np.ndarray, good: np.ndarray, share: float) -> np.ndarray:
    """Log odds ratio of buckets from the number of toxic and of clean texts that have them.

    A few imagined texts of the common mixture keep rare buckets near 0.
    """
    bad, good = (bad + IMAGINED * share) / share, (good + IMAGINED * (1 - share)) / (1 - share)
    return (np.clip(np.log(bad) - np.log(good), -3, 3) / 2).astype(np.float32)


def _odds_of(words: Words, toxic: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Odds of the word and n-gram buckets, from the texts marked in ``used``."""
    by_word, by_gram = np.zeros((2, recurrent.WORD_BUCKETS)), np.zeros((2, recurrent.GRAM_BUCKETS))
    for text in np.flatnonzero(used):
        ids = np.unique(words.ids[words.text_start[text]:words.text_start[text + 1]])
        counts = words.gram_start[ids + 1] - words.gram_start[ids]
        at = np.repeat(words.gram_start[ids], counts) + np.arange(int(counts.sum())) - np.repeat(
            np.cumsum(counts) - counts, counts)
        by_word[toxic[text], np.unique(words.bucket[ids])] += 1
        by_gram[toxic[text], np.unique(words.grams[at])] += 1
    share = float(toxic[used].mean())
    return _odds(by_word[1], by_word[0], share), _odds(by_gram[1], by_gram[0], share)


def train(texts: list[str], toxic: list[int], epochs: int = 12, batch: int = 256, turns: int = 3,
          seed: int = 9) -> Network | None:
    """Learns from whole texts, of which only some windows are toxic: a text is as bad as its worst window.

    Each epoch takes the toxic texts and every ``turns``-th clean one, and of each the window that the network finds
    worst; of the clean ones a random window, too. Steps shrink from epoch to epoch. At first, word odds stand in for
    the network. A text is learnt from with the odds that the other half of the texts gives, as odds that know its
    label would seem better than they are. None without both labels in either half.
    """
    wanted = np.array(toxic, np.int64)
    half = np.empty(len(wanted), np.int64)
    for side in (0, 1):
        half[wanted == side] = np.arange((wanted == side).sum()) % 2
    if any(len(set(wanted[half == h])) < 2 for h in (0, 1)):
        return None
    words = read_words(pa.array(texts, pa.string()))
    odds = [_odds_of(words, wanted, half != h) for h in (0, 1)]
    network, optimizer, draw = Network(*odds[0]), Adam(), np.random.Generator(np.random.PCG64(seed))
    text, number = windows(words)
    first = np.flatnonzero(number == 0)
    count = np.diff([*first, len(text)])
    for epoch in range(epochs):
        optimizer.shrink = 1 - 0.9 * epoch / epochs
        active = (wanted == 1) | (np.cumsum(wanted == 0) % turns == epoch % turns)
        for h in (0, 1):
            network.set_odds(*odds[h])
            mine = np.flatnonzero((active & (half == h))[text])
            logit = (network.logits if epoch else network.guesses)(words, text[mine], number[mine])
            worst = mine[np.lexsort((-logit, text[mine]))[np.flatnonzero(np.diff(text[mine], prepend=-1))]]
            clean = np.flatnonzero(active & (half == h) & (wanted == 0))
            chosen = np.concatenate([worst, first[clean] + (draw.random(len(clean)) * count[clean]).astype(np.int64)])
            target = wanted[text[chosen]].astype(np.float32)
            share = target.mean()
            weight = np.where(target == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
            order = draw.permutation(len(chosen))
            for at in range(0, len(order), batch):
                part = order[at:at + batch]
                network.train_step(words, window_words(words, text[chosen[part]], number[chosen[part]]), target[part],
                                   weight[part], optimizer)
    network.set_odds(*_odds_of(words, wanted, np.ones(len(wanted), bool)))
    return network


def score_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text",
                   rows: tuple[int, int] = (3000, 1000),
                   chars: int = 20_000) -> DataFrame:
    """One row per document: doc_id, score, predicted (1 from a score of 0.5 on).

    The score of a text is the probability of its worst window. All windows of the whole text count; a missing
    text, or one without words, gets the score of an empty window. Only the text enters a score. ``learn`` marks
    the rows of ``labels`` (doc_id, toxic) to learn from, of which a sample of ``rows`` texts of either label is taken, see
    ``labelled_sample``. Without examples of both labels all scores are 0. Other columns are ignored whatever their
    names; an empty table gives none.
    """
    own = docs.select(ref(id_col).alias("doc_id"), ref(text_col).alias("text"))
    network = train(*labelled_sample(own, labels, learn, rows, chars))

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [np.zeros(0)]
            for cut in slices(texts):
                part = texts.slice(cut.start, cut.stop - cut.start)
                if network is None:
                    parts.append(np.zeros(len(part)))
                else:
                    logit = network.text_logits(read_words(part)).astype(np.float64)
                    parts.append(1 / (1 + np.exp(-np.clip(logit, -700, 700))))
            yield pa.array(np.concatenate(parts))

    return own.select("doc_id", score("text").alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))
