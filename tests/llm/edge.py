"""Documents with everything that may go wrong, and brute-force versions of what the operators compute."""

import re

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside or add.
CLASHES = ["keep_id", "kept", "digest", "size", "shard", "part", "row", "rows", "class", "doc", "tie", "rank", "text_hash",
           "component", "bucket", "score", "lang_pred", "margin", "rejected", "n_removed", "covers", "hash", "id", "of",
           "block", "open", "a", "b", "ids", "toxic", "clean", "found", "copies", "with.dot"]

WORDS = "the quick brown fox jumps over one lazy dog while rain falls on grey stones near our old mill".split()
LONG = " ".join(WORDS[(k * k + k // 7) % len(WORDS)] for k in range(60_000))

ROWS = [
    (1, "One two three four five six seven eight nine ten", "en", "s1", 48),
    (2, "one TWO three four five six seven eight nine ten", "en", None, 48),
    (3, None, "en", "s1", None),
    (4, "", None, "s2", 0),
    (5, " \n\t ", "en", "s2", 4),
    (6, LONG, "en", "s1", len(LONG)),
    (7, LONG + " end", None, "s3", len(LONG) + 4),
    (8, "ÀÉ straße 漢字 \U0001f600 é", "de", "s2", 20),
    (9, "a\nb\nc\nd\n\na\nb\nc\nx", "en", "s1", 18),
    (10, "q\na\nb\nc\nd", "en", None, 9),
    (11, "z\nz\nz\nz\nz\nz", "en", "s2", 11),
    (12, "word", "de", "s2", 4),
    (12, "word", "de", "s2", 4),
    (None, "no id at all but some words here", None, "s1", 30),
    (None, "one two three four five six seven eight nine ten", None, "s1", 48),
    (14, "12 34 !! <|endoftext|> don't'S 'ra x1y \x00\x1c.", "en", "s1", 30),
]


def documents(spark, rows=ROWS):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return frame.withColumns({c: F.lit(k) for k, c in enumerate(CLASHES)})


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def shingles(text):
    found = words(text)
    if 0 < len(found) < 5:
        return {tuple(found)}
    return {tuple(found[k:k + 5]) for k in range(len(found) - 4)}


def components(sets, percent=75):
    """Smallest id reachable over links; sets: id -> shingles."""
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j]:
                shared = len(sets[i] & sets[j])
                if 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                    a, b = sorted((root(i), root(j)))
                    parent[b] = a
    return {d: root(d) for d in ids}


def deduped_lines(rows, width=3):
    """rows: (id, text); the cleaned texts, in order."""
    def filled(text):
        return [k for k, line in enumerate(text.split("\n")) if line.strip(" \t\n\r\x0b\x0c")]

    first, gone = {}, [set() for _ in rows]
    for n, (_, text) in sorted(enumerate(rows), key=lambda x: (x[1][0] is not None, x[1][0] or 0)):
        lines, places = (text or "").split("\n"), filled(text or "")
        for start in range(len(places) - width + 1):
            key = tuple(lines[k] for k in places[start:start + width])
            if key not in first:
                first[key] = (n, start)
                continue
            since = max(start, first[key][1] + width) if first[key][0] == n else start
            gone[n] |= set(places[since:start + width])
    return [None if text is None else "\n".join(line for k, line in enumerate(text.split("\n")) if k not in gone[n])
            for n, (_, text) in enumerate(rows)]
