"""A bidirectional gated recurrent network with attention pooling, in numpy.

Inputs are words, each the sum of its own vector and the mean of its character n-grams' vectors. The network reads a
window of words in both directions, weighs the states by attention and gives one logit per window.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tablevitals.llm.shingles import end_to_end, mixed, word_hashes

#: Hash buckets of words and of character n-grams.
WORD_BUCKETS, GRAM_BUCKETS = 1 << 15, 1 << 15
GRAMS = (3, 4)
WIDTH, STATE = 12, 10
#: Words per window, and how far the next window starts: runs of up to 17 words lie whole in some window.
WINDOW, STEP = 32, 16
BATCH = 4096
#: Words whose n-grams' vectors are held at once.
WORDS_AT_ONCE = 1 << 14

_draw = np.random.Generator(np.random.PCG64(55))
_BYTE = _draw.integers(1, 2**63, 256, dtype=np.uint64)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Words:
    """The words of some texts: the distinct ones, and the texts as places among them.

    ``grams`` lists the n-gram buckets of all distinct words end to end, ``gram_start`` where each word's begin.
    """
    bucket: np.ndarray
    grams: np.ndarray
    gram_start: np.ndarray
    ids: np.ndarray
    text_start: np.ndarray


def read_words(texts: pa.Array) -> Words:
    """Words are runs of letters; texts are lower-cased. Every byte outside ASCII counts as a letter."""
    data, edges = end_to_end(pc.utf8_lower(texts))
    hashes, starts, ends = word_hashes(data, edges, ~_LETTER[data])
    distinct, where, ids = np.unique(hashes, return_index=True, return_inverse=True)
    grams, counts = _grams(data, starts[where], ends[where])
    return Words((mixed(distinct) % np.uint64(WORD_BUCKETS)).astype(np.int64), grams,
                 np.concatenate([[0], np.cumsum(counts)]), ids.astype(np.int32), np.searchsorted(starts, edges))


def _grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of words with a mark at either end; at least the word with its marks."""
    length = ends - starts
    marked = length + 2
    place = np.concatenate([[0], np.cumsum(marked)])
    text = np.zeros(place[-1], np.uint8)
    inner = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    text[np.repeat(place[:-1], length) + 1 + inner] = data[np.repeat(starts, length) + inner]
    codes = _BYTE[text]
    found, counts = [], []
    for n in GRAMS:
        count = np.maximum(marked - n + 1, 0) if n > GRAMS[0] else np.maximum(marked - n + 1, 1)
        counts.append(count)
    total = np.sum(counts, axis=0)
    out = np.empty(int(total.sum()), np.int64)
    begin = np.concatenate([[0], np.cumsum(total)])[:-1]
    for n, count in zip(GRAMS, counts, strict=True):
        inner = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        at = np.repeat(place[:-1], count) + inner
        value = np.full(len(at), n, np.uint64)
        for k in range(n):
            value = value * _MULTIPLIER + codes[np.minimum(at + k, len(codes) - 1)]
        out[np.repeat(begin, count) + inner] = (mixed(value) % np.uint64(GRAM_BUCKETS)).astype(np.int64)
        begin = begin + count
    return out, total


def windows(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The overlapping windows of all texts: the text of each, and its number within the text.

    A text without words has one empty window.
    """
    count = np.diff(words.text_start)
    n = 1 + -(-np.maximum(count - WINDOW, 0) // STEP)
    return np.repeat(np.arange(len(count)), n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def window_words(words: Words, text: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Places of the words of these windows among the distinct words: windows x WINDOW, -1 past the text's end."""
    at = (words.text_start[text] + number * STEP)[:, None] + np.arange(WINDOW)
    inside = at < words.text_start[text + 1][:, None]
    if not len(words.ids):
        return np.full(at.shape, -1)
    return np.where(inside, words.ids[np.where(inside, at, 0)], -1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Network:
    """Parameters: word and n-gram vectors; per direction input, state and bias weights; attention; output."""

    def __init__(self, word_odds: np.ndarray, gram_odds: np.ndarray, seed: int = 3):
        draw = np.random.Generator(np.random.PCG64(seed))

        def normal(*shape, scale):
            return (draw.standard_normal(shape) * scale).astype(np.float32)

        self.p = {"word": normal(WORD_BUCKETS, WIDTH, scale=0.02), "gram": normal(GRAM_BUCKETS, WIDTH, scale=0.02),
                  "out": normal(2 * STATE, scale=0.5), "out_b": np.full(1, -1.0, np.float32),
                  "look": normal(2 * STATE, scale=0.5)}
        self.set_odds(word_odds, gram_odds)
        for side in ("f", "b"):
            self.p[f"in_{side}"] = normal(WIDTH, 3 * STATE, scale=WIDTH ** -0.5)
            self.p[f"state_{side}"] = normal(STATE, 3 * STATE, scale=STATE ** -0.5)
            self.p[f"bias_{side}"] = np.zeros(3 * STATE, np.float32)

    def set_odds(self, word_odds: np.ndarray, gram_odds: np.ndarray) -> None:
        """The first component of word vectors and the second of n-gram vectors are given, not learnt."""
        self.p["word"][:, 0], self.p["gram"][:, 1] = word_odds, gram_odds

    def guesses(self, words: Words, text: np.ndarray, number: np.ndarray) -> np.ndarray:
        """What an untrained network makes of windows: the sum of their three worst words' odds."""
        vectors = self.word_vectors(words)
        worth = np.append(vectors[:, 0] + vectors[:, 1], np.float32(-9))
        return np.concatenate([
            np.sort(worth[window_words(words, text[at:at + BATCH], number[at:at + BATCH])], axis=1)[:, -3:].sum(axis=1)
            for at in range(0, len(text), BATCH)] or [np.zeros(0, np.float32)])

    def word_vectors(self, words: Words) -> np.ndarray:
        """The vectors of the distinct words, some words at a time as their n-grams' vectors take much room."""
        counts = np.diff(words.gram_start)
        vectors = self.p["word"][words.bucket]
        for at in range(0, len(counts), WORDS_AT_ONCE):
            block = slice(at, at + WORDS_AT_ONCE)
            starts = words.gram_start[at:at + WORDS_AT_ONCE + 1]
            grams = self.p["gram"][words.grams[starts[0]:starts[-1]]]
            vectors[block] += np.add.reduceat(grams, starts[:-1] - starts[0], axis=0) / counts[block, None].astype(grams.dtype)
        return vectors

    def _read(self, gates: np.ndarray, ids: np.ndarray, mask: np.ndarray, side: str, keep: list | None) -> np.ndarray:
        """States after each word: WINDOW x windows x STATE. keep: gets what the way back needs."""
        weights = self.p[f"state_{side}"]
        h = np.zeros((len(ids), STATE), np.float32)
        states = np.empty((WINDOW, len(ids), STATE), np.float32)
        for t in range(WINDOW) if side == "f" else range(WINDOW - 1, -1, -1):
            given, own = gates[ids[:, t]], h @ weights
            zr = _sigmoid(given[:, :2 * STATE] + own[:, :2 * STATE])
            z, r = zr[:, :STATE], zr[:, STATE:]
            new = np.tanh(given[:, 2 * STATE:] + r * own[:, 2 * STATE:])
            moved = (new + z * (h - new)) * mask[:, t, None]
            if keep is not None:
                keep.append((t, h, z, r, new, own[:, 2 * STATE:]))
            h = states[t] = moved
        return states

    def _gates(self, vectors: np.ndarray) -> dict[str, np.ndarray]:
        """What each word adds to the gates, worked out once per distinct word; the last row is for no word."""
        return {s: np.concatenate([vectors @ self.p[f"in_{s}"] + self.p[f"bias_{s}"], self.p[f"bias_{s}"][None, :]])
                for s in ("f", "b")}

    def logits(self, words: Words, text: np.ndarray, number: np.ndarray) -> np.ndarray:
        """One logit per window."""
        gates = self._gates(self.word_vectors(words))
        return np.concatenate([
            self._forward(gates, window_words(words, text[at:at + BATCH], number[at:at + BATCH]))[0]
            for at in range(0, len(text), BATCH)] or [np.zeros(0, np.float32)])

    def text_logits(self, words: Words) -> np.ndarray:
        """The largest logit of each text's windows."""
        text, number = windows(words)
        if not len(text):
            return np.zeros(0, np.float32)
        return np.maximum.reduceat(self.logits(words, text, number), np.flatnonzero(number == 0))

    def _forward(self, gates, ids, keep=None):
        mask = (ids >= 0).astype(np.float32)
        states = np.concatenate([self._read(gates[s], ids, mask, s, None if keep is None else keep[s])
                                 for s in ("f", "b")], axis=2)
        look = states @ self.p["look"] + (mask.T - 1) * 1e4
        look = np.exp(look - look.max(axis=0))
        weight = look / look.sum(axis=0)
        pooled = np.einsum("tn,tns->ns", weight, states)
        return pooled @ self.p["out"] + self.p["out_b"], (mask, states, weight, pooled)

    def train_step(self, words: Words, ids: np.ndarray, wanted: np.ndarray, importance: np.ndarray,
                   optimizer: Adam) -> float:
        """One step on a batch of windows; returns the mean loss."""
        places, inverse = np.unique(ids, return_inverse=True)
        inverse = inverse.reshape(ids.shape)
        padded = places[0] < 0
        used = places[1:] if padded else places
        ids = inverse - 1 if padded else inverse
        counts = (words.gram_start[used + 1] - words.gram_start[used])
        at = np.repeat(words.gram_start[used], counts) + np.arange(int(counts.sum())) - np.repeat(
            np.cumsum(counts) - counts, counts)
        part = Words(words.bucket[used], words.grams[at], np.concatenate([[0], np.cumsum(counts)]), words.ids, words.text_start)
        vectors = self.word_vectors(part)
        gates = self._gates(vectors)
        keep = {"f": [], "b": []}
        logit, (mask, states, weight, pooled) = self._forward(gates, ids, keep)
        probability = 1 / (1 + np.exp(-logit))
        off = ((probability - wanted) * importance / len(ids)).astype(np.float32)
        grad = {"out": pooled.T @ off, "out_b": off.sum(keepdims=True)}
        to_pooled = off[:, None] * self.p["out"]
        to_weight = np.einsum("ns,tns->tn", to_pooled, states)
        to_look = weight * (to_weight - (weight * to_weight).sum(axis=0))
        grad["look"] = np.einsum("tn,tns->s", to_look, states)
        to_states = weight[:, :, None] * to_pooled + to_look[:, :, None] * self.p["look"]
        to_vectors = np.zeros_like(vectors)
        for s, part_of in (("f", slice(0, STATE)), ("b", slice(STATE, 2 * STATE))):
            recurrent = self.p[f"state_{s}"]
            to_gates = np.zeros((len(vectors) + 1, 3 * STATE), np.float32)
            to_recurrent = np.zeros_like(recurrent)
            back = np.zeros((len(ids), STATE), np.float32)
            for t, h, z, r, new, own in reversed(keep[s]):
                d = (to_states[t, :, part_of] + back) * mask[:, t, None]
                d_new = d * (1 - z) * (1 - new * new)
                d_z = d * (h - new) * z * (1 - z)
                d_r = d_new * own * r * (1 - r)
                d_own = np.concatenate([d_z, d_r, d_new * r], axis=1)
                back = d * z + d_own @ recurrent.T
                to_recurrent += h.T @ d_own
                np.add.at(to_gates, ids[:, t], np.concatenate([d_z, d_r, d_new], axis=1))
            grad[f"state_{s}"], grad[f"bias_{s}"] = to_recurrent, to_gates.sum(axis=0)
            grad[f"in_{s}"] = vectors.T @ to_gates[:-1]
            to_vectors += to_gates[:-1] @ self.p[f"in_{s}"].T
        optimizer.step(self.p, grad)
        per_gram = to_vectors / counts[:, None].astype(np.float32)
        to_vectors[:, 0], per_gram[:, 1] = 0, 0
        optimizer.step_rows(self.p["word"], "word", part.bucket, to_vectors)
        optimizer.step_rows(self.p["gram"], "gram", part.grams, np.repeat(per_gram, counts, axis=0))
        eps = 1e-7
        return float(-np.mean(importance * (wanted * np.log(probability + eps) + (1 - wanted) * np.log(1 - probability + eps))))


class Adam:
    """Adam for the dense parameters, plain scaled steps by row (Adagrad) for the vectors."""

    def __init__(self, rate: float = 0.02, row_rate: float = 0.005):
        self.rate, self.row_rate, self.shrink, self.n = rate, row_rate, 1.0, 0
        self.mean: dict[str, np.ndarray] = {}
        self.square: dict[str, np.ndarray] = {}

    def step(self, parameters: dict[str, np.ndarray], grad: dict[str, np.ndarray]) -> None:
        self.n += 1
        for name, g in grad.items():
            m = self.mean[name] = 0.9 * self.mean.get(name, 0.0) + 0.1 * g
            v = self.square[name] = 0.99 * self.square.get(name, 0.0) + 0.01 * g * g
            parameters[name] -= (self.shrink * self.rate * (m / (1 - 0.9 ** self.n)) / (np.sqrt(v / (1 - 0.99 ** self.n)) + 1e-8)).astype(
                np.float32)

    def step_rows(self, table: np.ndarray, name: str, rows: np.ndarray, grad: np.ndarray) -> None:
        used, inverse = np.unique(rows, return_inverse=True)
        summed = np.zeros((len(used), table.shape[1]), np.float32)
        np.add.at(summed, inverse, grad)
        seen = self.square.setdefault(name, np.zeros(len(table), np.float32))
        seen[used] += (summed * summed).mean(axis=1)
        table[used] -= self.shrink * self.row_rate * summed / (np.sqrt(seen[used]) + 1e-6)[:, None]
