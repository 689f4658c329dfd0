"""BPE and flat token files against the libraries, text by text."""

import collections
import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tablevitals.llm.bpe import Codec, certain_cuts, encode_decode
from tablevitals.llm.catalog import END_OF_DOCUMENT, QUERIES
from tablevitals.llm.token_counts import _encoding, token_counts, write_token_files
from tests.llm import edge

PATH = public_tokenizers.path("word_bpe_49k.json")
TRICKY = [
    "", " ", "\n\n", "a", "don't'S I'LL we'VE !'s ?'re 'tis 'ra ''s", "x's", "X'S", "1a2b33", "a1!b?c", "!!a!!", "..'s..",
    "<|endoftext|>", "a<|endoftext|>b <|ENDOFTEXT|> <|startoftext|>!", "<|endoftext", "|endoftext|>", "é Éa", "àb",
    " ́x", "1́", "!́", "漢字かな", "　x y z\x85w", "\x00\x01\x1c\x1d\x1e\x1f\x7f", "a\x1cb", "İ İ ſ K", "²³ ½ ١٢ a²b",
    "\U0001f600‍\U0001f4a9!", "ΑΣ ας", "word" * 500, "!" * 900, "9" * 300, "tab\tcr\rvt\x0bff\x0c.", "'", "''''", "'s't're",
]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def want(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def test_codec_on_tricky_texts(library):
    codec = Codec(PATH)
    draw = np.random.default_rng(2)
    alphabet = list("abst'!1 \n.<|>Éé 漢")
    texts = TRICKY + ["".join(draw.choice(alphabet, 40)) for _ in range(3000)] + [t + u for t in TRICKY for u in TRICKY]
    for text in texts:
        ids, decoded = want(library, text)
        assert codec.run([text]) == [(" ".join(map(str, ids)), decoded, len(ids))], text


def test_cuts_are_few_but_there():
    cuts = certain_cuts(PATH)
    assert cuts[ord("a"), ord(" ")] and cuts[ord("7"), ord("7")] and cuts[ord("a"), ord("!")]
    assert not cuts[ord("'"), ord("s")] and not cuts[ord("t"), ord("h")] and not cuts[ord("!"), ord("!")]
    assert not cuts[0xC3, 0xA9] and not cuts[ord("e"), 0xCC]


def test_bpe_on_odd_documents(spark, library):
    found = encode_decode(edge.documents(spark), keep_ids=True).collect()
    expected = collections.Counter()
    for doc_id, text, *_ in edge.ROWS:
        ids, decoded = want(library, text)
        expected[doc_id, len(ids), tuple(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                 hashlib.sha256(decoded.encode()).hexdigest()] += 1
    assert collections.Counter(
        (r.doc_id, r.n_tokens, tuple(r.ids), r.ids_sha256, r.decoded_sha256) for r in found) == expected


def test_bpe_on_the_shared_table(spark, sf, library):
    found = {r.doc_id: r for r in QUERIES["op7_bpe"](spark, sf).collect()}
    for row in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids, decoded = want(library, row.text)
        assert found[row.doc_id].n_tokens == len(ids)
        assert found[row.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert found[row.doc_id].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_token_counts_of_the_shared_table(spark, sf):
    encoding = _encoding("byte_bpe_50k.tiktoken")
    lengths = collections.Counter(
        len(encoding.encode_ordinary(r.text or "")) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    found = QUERIES["op2_token_counts"](spark, sf).collect()
    assert collections.Counter(r.n_tokens for r in found) == lengths and all(r.closed for r in found)
    for shard in {r.shard for r in found}:
        rows = sorted((r for r in found if r.shard == shard), key=lambda r: r.doc_no)
        assert [r.doc_no for r in rows] == list(range(len(rows)))
        assert [r.start for r in rows] == [sum(x.n_tokens + 1 for x in rows[:k]) for k in range(len(rows))]


def test_token_files_of_odd_documents(spark, tmp_path):
    path = f"{tmp_path}/tokens"
    write_token_files(edge.documents(spark), path, END_OF_DOCUMENT)
    encoding = _encoding("byte_bpe_50k.tiktoken")
    found = collections.Counter(r.n_tokens for r in token_counts(spark, path, END_OF_DOCUMENT, block_bytes=64).collect())
    assert found == collections.Counter(len(encoding.encode_ordinary(r[1] or "")) for r in edge.ROWS)


@pytest.mark.parametrize("width,block", [(2, 2), (2, 64), (2, 1 << 20), (4, 4096)])
def test_blocks_are_stitched(spark, tmp_path, width, block):
    ids = np.random.default_rng(1).integers(0, 40, 9001).astype(f"<u{width}")
    ids[1000:4000] = 1
    if block == 2:
        ids = ids[900:1300]
    ids.tofile(f"{tmp_path}/x.bin")
    np.array([7, 7, 3, 7], f"<u{width}").tofile(f"{tmp_path}/y.bin")
    open(f"{tmp_path}/z.bin", "wb").close()
    found = collections.defaultdict(list)
    for r in token_counts(spark, str(tmp_path), 7, width, block).collect():
        found[r.file[-5:]].append((r.doc_no, r.start, r.n_tokens, r.closed))
    ends = np.flatnonzero(ids == 7).tolist()
    starts = [0, *(e + 1 for e in ends)]
    want = [(k, s, e - s, True) for k, (s, e) in enumerate(zip(starts, ends))]
    if starts[-1] < len(ids):
        want.append((len(ends), starts[-1], len(ids) - starts[-1], False))
    assert sorted(found["x.bin"]) == want
    assert sorted(found["y.bin"]) == [(0, 0, 0, True), (1, 1, 0, True), (2, 2, 1, True)] and "z.bin" not in found


def test_a_file_of_more_than_two_gigabytes(spark, tmp_path):
    """A file with holes, which take no disk: its ends lie before, at and after 2 GB."""
    ends, n_ids = [5, 900_000_000, (1 << 30) - 1, 1 << 30, 1_200_000_000], 1_200_000_100
    with open(f"{tmp_path}/huge.bin", "wb") as out:
        for end in ends:
            out.seek(2 * end)
            out.write(np.array([7], "<u2").tobytes())
        out.truncate(2 * n_ids)
    found = sorted((r.doc_no, r.start, r.n_tokens, r.closed) for r in token_counts(spark, str(tmp_path), 7).collect())
    starts = [0, *(e + 1 for e in ends)]
    assert found == [(k, s, e - s, k < len(ends)) for k, (s, e) in enumerate(zip(starts, [*ends, n_ids]))]


def test_stores_that_only_spark_reads(spark, tmp_path, monkeypatch):
    ids = np.array([1, 7, 7, 2, 3, 4, 5, 7, 6], "<u2")
    ids.tofile(f"{tmp_path}/x.bin")
    want = token_counts(spark, str(tmp_path), 7, block_bytes=4).collect()
    monkeypatch.setattr("tablevitals.llm.token_counts._readable", lambda file: False)
    assert sorted(token_counts(spark, str(tmp_path), 7, block_bytes=4).collect()) == sorted(want) and len(want) == 4


def test_empty_tables(spark, tmp_path):
    assert encode_decode(edge.documents(spark, [])).collect() == []
    write_token_files(edge.documents(spark, []), f"{tmp_path}/tokens", END_OF_DOCUMENT)
    assert token_counts(spark, f"{tmp_path}/tokens", END_OF_DOCUMENT).collect() == []


def test_ids_that_do_not_fit_raise(spark, tmp_path):
    docs = edge.documents(spark)
    with pytest.raises(ValueError, match="don't fit"):
        write_token_files(docs, f"{tmp_path}/a", 70_000)
    with pytest.raises(ValueError, match="is a token"):
        write_token_files(docs, f"{tmp_path}/b", 17)
