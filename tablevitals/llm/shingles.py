"""Word shingles and MinHash samples of whole texts, computed over Arrow batches in numpy.

A word's hash is a polynomial over its bytes, taken from running sums over a whole stretch of text; a shingle's
hash combines those of its words. No Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tablevitals.llm.common import per_process

SHINGLE_WORDS = 5
#: Bytes hashed in one go.
STRETCH = 1 << 20
#: Shingles per pass over all MinHash functions, so that they stay in the cache.
CACHED = 1 << 16

_draw = np.random.Generator(np.random.PCG64(8_128_256))
_LETTER = _draw.integers(1, 2**63, 256, dtype=np.uint64)
for _upper in range(ord("A"), ord("Z") + 1):
    _LETTER[_upper] = _LETTER[_upper + 32]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_PLACE = _draw.integers(1, 2**63, SHINGLE_WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHORT = _draw.integers(1, 2**63, SHINGLE_WORDS, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def _stretches(space: np.ndarray, edges: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts at text edges or white space, about ``STRETCH`` bytes each; a longer word stays whole."""
    at, end = 0, len(space)
    while at < end:
        upto = min(at + STRETCH, end)
        if upto < end:
            edge = edges[np.searchsorted(edges, upto, "right") - 1]
            gaps = np.flatnonzero(space[at:upto])
            if edge > at:
                upto = int(edge)
            elif len(gaps):
                upto = at + int(gaps[-1]) + 1
            else:
                later = np.flatnonzero(space[upto:])
                upto = upto + int(later[0]) if len(later) else end
        yield at, upto
        at = upto


def word_hashes(data: np.ndarray, edges: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word of texts lying end to end.

    edges: where texts start, and the end of the last; space: marks the bytes that belong to no word. A-Z count as a-z.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    is_edge = np.zeros(len(data) + 1, bool)
    is_edge[edges] = True
    first, last = ~space, ~space
    first[1:] &= space[:-1] | is_edge[1:-1]
    last[:-1] &= space[1:] | is_edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = np.empty(len(starts), np.uint64)
    usual = per_process("powers", lambda: (_powers(_BASE, STRETCH), _powers(_INVERSE, STRETCH)))
    for lo, hi in _stretches(space, edges):
        a, b = np.searchsorted(starts, (lo, hi))
        n = hi - lo
        power, undo = usual if n <= STRETCH else (_powers(_BASE, n), _powers(_INVERSE, n))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_LETTER[data[lo:hi]] * power[:n], out=sums[1:])
        s = starts[a:b] - lo
        hashes[a:b] = (sums[ends[a:b] - lo] - sums[s]) * undo[s]
    return mixed(hashes), starts, ends


def end_to_end(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each starts, with the end of the last; a missing text is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, body = texts.buffers()
    edges = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(body, np.uint8)[edges[0]:edges[-1]] if body else np.zeros(0, np.uint8)
    return data, edges - edges[0]


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted; a missing text counts as empty and has none.

    Words are runs of anything but ASCII white space, with A-Z lower-cased. Fewer than five words are one shingle.
    """
    data, edges = end_to_end(texts)
    words, starts, _ = word_hashes(data, edges, _SPACE[data])
    first = np.searchsorted(starts, edges)
    n = len(words) - SHINGLE_WORDS + 1
    runs = np.zeros(max(n, 0), np.uint64)
    for k in range(SHINGLE_WORDS if n > 0 else 0):
        runs += words[k:k + n] * _PLACE[k]
    runs = mixed(runs)
    sets = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if hi - lo >= SHINGLE_WORDS:
            sets.append(np.unique(runs[lo:hi - SHINGLE_WORDS + 1]))
        elif hi > lo:
            sets.append(mixed((words[lo:hi] * _PLACE[:hi - lo]).sum(keepdims=True) + _SHORT[hi - lo]))
        else:
            sets.append(words[:0])
    return sets


class MinHash:
    """``samples`` MinHash functions over sets of 64-bit hashes, folded into bands and odd sketches."""

    def __init__(self, bands: int, rows: int, bits: int, seed: int = 7):
        draw = np.random.Generator(np.random.PCG64(seed))
        self.bands, self.rows, self.bits = bands, rows, bits
        self.factor = draw.integers(0, 2**31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.shift = draw.integers(0, 2**32, bands * rows, dtype=np.uint32)
        self.in_band = draw.integers(0, 2**63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.of_sample = draw.integers(0, 2**63, bands * rows, dtype=np.uint64)
        self.of_band = draw.integers(0, 2**63, bands, dtype=np.uint64)

    def samples(self, sets: list[np.ndarray]) -> np.ndarray:
        """The smallest hash of each (non-empty) set under each function: sets x samples."""
        out = np.empty((len(sets), len(self.factor)), np.uint32)
        at = 0
        while at < len(sets):
            upto, total = at, 0
            while upto < len(sets) and (upto == at or total + len(sets[upto]) <= CACHED):
                total += len(sets[upto])
                upto += 1
            items = (np.concatenate(sets[at:upto]) >> np.uint64(32)).astype(np.uint32)
            starts = np.cumsum([0, *(len(s) for s in sets[at:upto - 1])])
            for k, (factor, shift) in enumerate(zip(self.factor, self.shift, strict=True)):
                out[at:upto, k] = np.minimum.reduceat(items * factor + shift, starts)
            at = upto
        return out

    def band_keys(self, samples: np.ndarray) -> np.ndarray:
        """One 64-bit key per set and band."""
        parts = samples.reshape(len(samples), self.bands, self.rows).astype(np.uint64)
        return mixed((parts * self.in_band).sum(axis=2, dtype=np.uint64) + self.of_band)

    def odd_sketches(self, samples: np.ndarray) -> np.ndarray:
        """The parity, for each of ``bits`` cells, of how many samples fall into it: sets x 64-bit words."""
        out = np.zeros((len(samples), self.bits // 64), np.uint64)
        rows = np.arange(len(samples))
        for k in range(samples.shape[1]):
            cell = mixed(samples[:, k].astype(np.uint64) + self.of_sample[k])
            cell %= np.uint64(self.bits)
            out[rows, (cell >> np.uint64(6)).astype(np.intp)] ^= np.uint64(1) << (cell & np.uint64(63))
        return out

    def most_different_cells(self, similarity: float) -> int:
        """The XOR population count expected at this similarity.

        The samples of two sets differ in 2 * samples * (1 - similarity) items, thrown into ``bits`` cells.
        """
        thrown = 2 * len(self.factor) * (1 - similarity)
        return int(self.bits / 2 * (1 - (1 - 2 / self.bits) ** thrown))
