"""BPE encoding and decoding by forced-boundary splitting.

A byte pair that stands side by side in no token of the vocabulary can't be joined by any merge. Where the
pre-tokenizer is certain to break between such a pair too, a text may be cut. The pieces are encoded on their own,
new ones of a batch together, and their ids are strung together. A task remembers pieces from batch to batch.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tablevitals.llm.common import per_process, ref, slices

#: Bytes that the pieces of one generation take up, and the length of the longest that is remembered.
REMEMBERED, LONGEST = 64 << 20, 64
#: Bytes of a remembered piece beside its characters: entry, tuple and string headers.
ENTRY = 320
_SPACE = frozenset(b" \t\n\r\x0b\x0c")


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable Latin-1 characters stand for themselves; the remaining bytes, in order, for those from 256 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _kind(byte: int) -> str | None:
    """White space, letter, digit or other; None for bytes that the pre-tokenizer may see as any of them."""
    if byte in _SPACE:
        return "space"
    if byte < 0x20 or byte >= 0x7F:
        return None
    return "letter" if chr(byte).isalpha() else "digit" if chr(byte).isdigit() else "other"


def certain_cuts(path: str) -> np.ndarray:
    """256 x 256 flags: a text may be cut between these two bytes.

    For tokenizers that lower-case, drop white space and break words into runs of letters, single digits and runs
    of other characters, save for fixed endings such as ``'s``; those are tokens, and so are the special strings,
    so that their pairs count as joined. A cut is certain before white space, next to a digit and between a letter
    and another character, as long as the pair is joined in no token.
    """
    spec = json.load(open(path, encoding="utf-8"))
    alphabet, end = byte_alphabet(), spec["model"]["end_of_word_suffix"] or ""
    joined = np.zeros((256, 256), bool)
    for token in spec["model"]["vocab"]:
        body = [alphabet[c] for c in (token.removesuffix(end) if end else token)]
        for a, b in zip(body, body[1:]):
            joined[a, b] = True
    for added in spec["added_tokens"]:
        for a, b in zip(added["content"].encode(), added["content"].encode()[1:]):
            joined[a, b] = True
    cuts = np.zeros((256, 256), bool)
    lower = [b + 32 if 65 <= b <= 90 else b for b in range(256)]
    kinds = [_kind(b) for b in range(256)]
    for a in range(256):
        for b in range(256):
            if kinds[b] == "space":
                cuts[a, b] = kinds[a] != "space"
            elif kinds[a] in ("letter", "digit", "other") and kinds[b] in ("letter", "digit", "other"):
                cuts[a, b] = kinds[a] != kinds[b] or kinds[a] == "digit"
            cuts[a, b] &= not joined[lower[a], lower[b]] and not joined[a, b]
    return cuts


class Codec:
    """Encodes and decodes whole texts piece by piece; equal to the library on every text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks share the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        if self.tokenizer.decoder is not None:
            raise ValueError("only tokenizers whose decoded tokens are parted by blanks can be decoded in pieces")
        self.cuts = certain_cuts(path).reshape(-1)
        self.tokens = {i: token for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        self.numbers = {i: str(i) for i in self.tokens}
        # Two generations: what is met again moves to the younger one, and a full one replaces the elder.
        self.known: dict[bytes, tuple[str, str, int]] = {}
        self.elder: dict[bytes, tuple[str, str, int]] = {}
        self.held = 0

    def forget(self) -> None:
        self.known, self.elder, self.held = {}, {}, 0

    def pieces(self, body: bytes) -> list[bytes]:
        codes = np.frombuffer(body, np.uint8).astype(np.uint16)
        at = np.flatnonzero(self.cuts[(codes[:-1] << 8) | codes[1:]]) + 1
        ends = [*at.tolist(), len(body)]
        return [body[i:j] for i, j in zip([0, *ends], ends)]

    def learn(self, pieces: set[bytes]) -> list[bytes]:
        """Makes all pieces known, new ones in one call of the library; returns those too long to be remembered."""
        known, elder = self.known, self.elder
        new = []
        for piece in pieces.difference(known):
            entry = elder.get(piece)
            if entry is None:
                new.append(piece)
            else:
                known[piece] = entry
                self.held += ENTRY + len(piece) + len(entry[0]) + len(entry[1])
        numbers, tokens = self.numbers, self.tokens
        for piece, encoded in zip(new, self.tokenizer.encode_batch_fast([p.decode() for p in new], add_special_tokens=False)):
            ids = encoded.ids
            known[piece] = entry = " ".join([numbers[i] for i in ids]), " ".join([tokens[i] for i in ids]), len(ids)
            self.held += ENTRY + len(piece) + len(entry[0]) + len(entry[1])
        return [p for p in new if len(p) > LONGEST]

    def run(self, texts: list[str]) -> list[tuple[str, str, int]]:
        """For each text the ids joined by blanks, the decoded text and the number of ids."""
        cut = [self.pieces(t.encode()) if t else [] for t in texts]
        passing = self.learn({piece for pieces in cut for piece in pieces})
        results = []
        for pieces in cut:
            if not pieces:
                results.append(("", "", 0))
                continue
            ids, decoded, counts = zip(*map(self.known.__getitem__, pieces))
            if 0 in counts:  # white space alone
                ids, decoded = [i for i in ids if i], [d for d, c in zip(decoded, counts) if c]
            results.append((" ".join(ids), " ".join(decoded), sum(counts)))
        for piece in passing:
            ids, decoded, _ = self.known.pop(piece)
            self.held -= ENTRY + len(piece) + len(ids) + len(decoded)
        if self.held > REMEMBERED:
            self.elder, self.known, self.held = self.known, {}, 0
        return results


def _tokenizer_path(name: str) -> str:
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_decode(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", id_col: str = "doc_id",
                  text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, and with ``keep_ids`` ids (array).

    ``tokenizer`` is a path, or the name of an installed public tokenizer. Ids are those of the library for the whole
    text without special tokens added, decoded text is what the library decodes from them. A missing text counts as
    empty, with no ids. Rows of one id or text are encoded each; other columns are ignored whatever their names.
    """
    kind = docs.select(ref(id_col)).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = _tokenizer_path(tokenizer)
        codec = per_process(("codec", path), lambda: Codec(path))
        for batch in batches:
            for cut in slices(batch.column("text")):
                part = batch.slice(cut.start, cut.stop - cut.start)
                rows = codec.run([t or "" for t in part.column("text").to_pylist()])
                columns = [part.column("doc_id"), pa.array([r[2] for r in rows], pa.int64()),
                           pa.array([hashlib.sha256(r[0].encode()).hexdigest() for r in rows]),
                           pa.array([hashlib.sha256(r[1].encode()).hexdigest() for r in rows])]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    columns.append(pa.array([[int(i) for i in r[0].split()] for r in rows], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)
        codec.forget()  # an idle worker holds no more than the tokenizer

    return docs.select(ref(id_col).alias("doc_id"), ref(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
        + (", ids array<int>" if keep_ids else ""))
