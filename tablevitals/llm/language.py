"""Language identification by compression.

A text is compressed with each language's dictionary, a stretch of raw text of that language; the language whose
dictionary saves most is the prediction. Narrow margins are rejected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablevitals.llm.common import ref, slices

#: Bytes of text that are compressed at a time; the sizes of a text's pieces add up.
PIECE = 512
#: Compression level; slower ones gain nothing in accuracy.
LEVEL = 6
#: Bytes by which a language must be worse to count e times less likely.
SOFTNESS = 3.0
UNDECIDED = "und"


def letters_only(texts: pa.Array) -> pa.Array:
    """Lower case, each run of anything but letters as one blank."""
    plain = pc.replace_substring_regex(pc.utf8_lower(texts.fill_null("")), pattern=r"[^\p{L}]+", replacement=" ")
    return pc.utf8_trim(plain, " ")


def fit_dictionaries(docs: DataFrame, lang: Column, learn: Column, text_col: str = "text", rows: int = 400,
                     chars: int = 400, most_languages: int = 1000) -> dict[str, bytes]:
    """A raw dictionary per language from ``rows`` rows at most, ``chars`` characters of each, chosen by hash.

    The stretch taken of a text starts at a place given by its hash. Dictionaries hold rows x chars characters
    at most, all of them together most_languages times that. The commonest language comes first; of more than
    most_languages the commonest ones are learnt, of equally common ones the first by name.
    """
    text = ref(text_col)
    counts = (docs.where(learn & lang.isNotNull()).groupBy(lang.alias("lang")).count()
              .orderBy(F.desc("count"), "lang").limit(most_languages + 1).collect())
    common = [(-row["count"], row["lang"]) for row in counts[:most_languages]]
    if len(counts) > most_languages:
        learn = learn & lang.isin([name for _, name in common])
    order = F.xxhash64(text)
    start = F.pmod(order, F.greatest(F.lit(1), F.char_length(text) - chars)).cast("int") + 1
    known = docs.where(learn & lang.isNotNull() & (F.char_length(text) > 0)).select(
        lang.alias("lang"), order.alias("order"), F.substring(text, start, F.lit(chars)).alias("text"))
    # Cut down within each task before the shuffle, so no language's rows meet in one task.
    sample = known.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("order"))).where(
        F.col("k") <= rows)
    found: dict[str, list[tuple[int, str]]] = {}
    for row in sample.toLocalIterator():
        found.setdefault(row["lang"], []).append((row["order"], row["text"]))
    return {name: " ".join(letters_only(pa.array([t for _, t in sorted(found[name])])).to_pylist()).encode()
            for _, name in common if name in found}


class Classifier:
    """Compressed sizes per language; the commonest language comes first."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.names = [*dictionaries]
        self.compressors = []
        for body in dictionaries.values():
            shared = zstandard.ZstdCompressionDict(body, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            shared.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(
                level=LEVEL, dict_data=shared, write_content_size=False, write_dict_id=False))

    def sizes(self, body: bytes) -> np.ndarray:
        pieces = [body[at:at + PIECE] for at in range(0, len(body), PIECE)]
        return np.array([sum(len(c.compress(p)) for p in pieces) for c in self.compressors], np.int64)

    def predict(self, body: bytes) -> tuple[str, float, float]:
        """Language, score and margin per byte of text; ties go to the commonest language."""
        if not body or not self.names:
            return UNDECIDED, 0.0, 0.0
        sizes = self.sizes(body)
        best = int(sizes.argmin())
        behind = np.sort(sizes - sizes[best])
        margin = float(behind[1]) / len(body) if len(behind) > 1 else 1.0
        return self.names[best], 1.0 / sum(math.exp(-d / SOFTNESS) for d in behind), margin


def identify_language(docs: DataFrame, lang: Column, learn: Column, id_col: str = "doc_id", text_col: str = "text",
                      least_margin: float = 0.002) -> DataFrame:
    """The documents, all columns, with lang_pred, score, margin and rejected appended.

    Learns from the rows that ``learn`` marks and whose ``lang`` isn't missing, the 1000 commonest values of it at most:
    a text of any other gets the one of these it is most like. Only the text decides: lower-cased,
    letters alone, whole. A missing text, or one without a letter, is ``und`` with score and margin 0, and so is every
    text when nothing could be learnt. ``score`` is the share of the best language when a language counts e times
    less for every three bytes more; ``margin`` is how many bytes, per byte of text, the next one needs. Rejected
    is what is undecided or has a margin below ``least_margin``. Input columns of these names are replaced.
    """
    dictionaries = fit_dictionaries(docs, lang, learn, text_col)
    added = ("lang_pred", "score", "margin", "rejected")

    @F.arrow_udf("lang_pred string, score double, margin double")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        law = Classifier(dictionaries)
        for texts in batches:
            rows = []
            for cut in slices(texts):
                plain = letters_only(texts.slice(cut.start, cut.stop - cut.start))
                rows += [law.predict(t.as_py().encode()) for t in plain]
            yield pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.string()),
                                              pa.array([r[1] for r in rows], pa.float64()),
                                              pa.array([r[2] for r in rows], pa.float64())],
                                             names=["lang_pred", "score", "margin"])

    names = [c for c in docs.columns if c not in added]
    packed = docs.select(F.struct(*map(ref, names)).alias("row"), predict(ref(text_col)).alias("found"))
    return packed.select(*[F.col("row").getField(c).alias(c) for c in names], "found.*").withColumn(
        "rejected", (F.col("lang_pred") == UNDECIDED) | (F.col("margin") < least_margin))
