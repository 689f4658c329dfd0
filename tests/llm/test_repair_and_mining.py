"""Hard negatives, conversation repair and quality rules against brute force."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablevitals.llm import conversations as conv
from tablevitals.llm import quality_rules as rules
from tablevitals.llm.hard_negatives import Heaps, hard_negatives, strassen
from tests.llm import edge

VECTORS = "vec_id long, embedding array<float>, label int"
TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("m, k, n", [(1, 1, 1), (40, 64, 70), (33, 65, 129), (100, 37, 41), (200, 64, 300), (0, 64, 5), (5, 0, 70)])
def test_strassen_is_exact(m, k, n):
    draw = np.random.default_rng(3)
    a, b = draw.integers(-(1 << 26), 1 << 26, (m, k)), draw.integers(-(1 << 26), 1 << 26, (k, n))
    assert (strassen(a, b) == a @ b).all()


def test_heaps_keep_the_best_whatever_the_order():
    draw = np.random.default_rng(4)
    rows = np.stack([draw.integers(0, 5, 400), draw.integers(0, 9, 400), np.arange(400)])
    heaps = Heaps(6, 7)
    for part in np.array_split(rows[:, draw.permutation(400)], 9, axis=1):
        heaps.push(*part)
    want = [(o, s, i) for o in range(5) for s, i in sorted(((s, i) for p, s, i in rows.T if p == o), key=lambda x: (-x[0], x[1]))[:7]]
    assert [*zip(heaps.owner, heaps.score, heaps.id)] == want


def mined(rows, k=10, positives=5):
    ready = {}
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        ready[vec_id] = ([math.floor(256 * float(np.float32(x))) for x in vector], label)
    out = []
    for a in (v for v in ready if v % 100 == 0):
        scores = sorted((-sum(x * y for x, y in zip(ready[a][0], v)), i, label) for i, (v, label) in ready.items() if i != a)
        for ps, p, _ in [s for s in scores if s[2] == ready[a][1]][:positives]:
            fit = [(n, -s) for s, n, label in scores if label != ready[a][1] and 30 * -ps <= 100 * -s <= 90 * -ps]
            out += [(a, p, r, n, -ps, s) for r, (n, s) in enumerate(fit[:k], 1)]
    return sorted(out)


def noisy():
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


@pytest.mark.parametrize("block, chunk", [(32768, 4096), (40, 2)])
def test_hard_negatives_on_odd_rows(spark, block, chunk):
    draw = np.random.default_rng(8)
    rows = [(k, [float(x) for x in draw.normal(0.3, 1, 12)], int(draw.integers(0, 4))) for k in range(420)]
    for k in range(120, 180):
        rows[k] = (k, rows[120][1], k % 4)  # ties
    rows[200] = (200, rows[200][1][:5], 1)  # an anchor of fewer components
    for k, bad in enumerate([None, [], [None] * 12, [float("nan")] * 12, [1.0] * 11 + [float("inf")], [0.0] * 12]):
        rows[300 + k] = (300 + k, bad, 2)
    rows += [rows[5], rows[100], (None, rows[3][1], 1), (901, rows[4][1], None)]
    frame = spark.createDataFrame(rows, VECTORS).repartition(5).withColumns({c: F.lit(k) for k, c in enumerate(edge.CLASHES)})
    found = hard_negatives(frame, F.col("vec_id") % 100 == 0, noisy(), block=block, chunk=chunk)
    assert found.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"),
                            ("positive_score", "bigint"), ("negative_score", "bigint")]
    want = mined(rows)
    assert want and sorted(map(tuple, found.collect())) == want


def test_hard_negatives_of_hot_vectors_and_labels(spark):
    """Half of all rows are one vector of one label."""
    draw = np.random.default_rng(2)
    rows = [(k, [1.0, 0.5] + [0.0] * 6 if k % 2 else [float(x) for x in draw.uniform(0, 1, 8)], 1 if k % 2 else k % 10)
            for k in range(900)]
    found = hard_negatives(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 100 == 0, noisy(), block=100, chunk=3)
    assert sorted(map(tuple, found.collect())) == mined(rows)


def test_nothing_to_mine(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert hard_negatives(empty, F.col("vec_id") % 100 == 0, noisy()).collect() == []
    alone = spark.createDataFrame([(100, [1.0], 3)], VECTORS)
    assert hard_negatives(alone, F.col("vec_id") % 100 == 0, noisy()).collect() == []


def cheapest(rows):
    """Cost, edits and repaired turns; rows: (role, text, must_go, truncated)."""
    steps = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    names = {"u": "user", "a": "assistant"}
    after = {0: (0, "", []), 3: (0, "", []), 1: None, 2: None}

    def closed(best):
        for _ in range(4):
            for state in steps:
                for initial in "ua":
                    to = steps[state].get(initial)
                    if to is not None and best[to] is not None:
                        cost, edits, turns = best[to]
                        new = (3 + cost, "I" + edits, [(names[initial], "")] + turns)
                        if best[state] is None or new[:2] < best[state][:2]:
                            best[state] = new
        return best

    after = closed(after)
    for role, text, must_go, truncated in reversed(rows):
        before = {}
        for state in steps:
            options = [(4 + after[state][0], "D" + after[state][1], after[state][2])]
            if not must_go:
                more = 3 if truncated else 0
                if steps[state].get(role[:1]) is not None:
                    cost, edits, turns = after[steps[state][role[:1]]]
                    options.append((more + cost, "K" + edits, [(role, text)] + turns))
                for initial in "ua":
                    if steps[state].get(initial) is not None:
                        cost, edits, turns = after[steps[state][initial]]
                        options.append((3 + more + cost, "R" + edits, [(names[initial], text)] + turns))
            before[state] = min(options, key=lambda o: o[:2])
        after = closed(before)
    return after[0]


def test_tables_find_the_least_of_the_cheapest_edits():
    tables = conv.BlockTables()
    assert len(tables.vectors) < 100
    letters = [chr(65 + k) for k in range(16)]

    def rows_of(symbols):
        return [("suax"[(ord(c) - 65) // 4], "", (ord(c) - 65) % 4 >= 2, (ord(c) - 65) % 4 == 1) for c in symbols]

    for n in range(4):
        for symbols in itertools.product(letters, repeat=n):
            assert tables.audit("".join(symbols)) == cheapest(rows_of(symbols))[1::-1]
    draw = random.Random(5)
    for _ in range(300):
        symbols = draw.choices(letters[:2] + letters[4:6] * 3 + letters[8:10] * 3 + letters, k=draw.randrange(4, 40))
        assert tables.audit("".join(symbols)) == cheapest(rows_of(symbols))[1::-1]


def repaired(rows):
    """The contract on (conv_id, turn, role, text) rows, in Python."""
    groups = collections.defaultdict(list)
    for conv_id, turn, role, text in rows:
        own = groups[conv_id]
        law = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        role = "user" if law == 4 else role
        text = "" if law == 1 else re.sub("[.!?]", "", text) if law == 2 else text
        own += [(turn, role, text)] * (0 if law == 0 else 2 if law == 3 else 1)
    out = {}
    for conv_id, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        seen, flags, counts = set(), [], collections.Counter()
        for _, role, text in own:
            body = text.strip(" \t\n\r\x0b\x0c")
            flaw = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            counts[flaw] += 1
            flags.append((role, text, flaw in ("blank", "duplicate"), flaw == "truncated"))
        turns = [t for t, *_ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, left = cheapest(flags)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()
        out[conv_id] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest)
    return out


def as_found(frame):
    return {r.conv_id: tuple(r)[1:] for r in frame.collect()}


def test_repair_of_odd_conversations(spark, monkeypatch):
    monkeypatch.setattr(conv, "PART", 7)
    draw = random.Random(9)
    texts = ["Yes.", "No!", "Why?", "and then", "", " \n", None, "ends well. \t", "Ünïcode…", "Fin。"]
    rows = [(c, t, draw.choice(["user", "assistant", "system", "tool", "", None, "User", "s"]), draw.choice(texts))
            for c in range(60) for t in range(draw.randrange(9))]
    rows += [(c, draw.choice([None, 1, 2, 2, 9]), draw.choice(["user", "assistant"]), draw.choice(texts)) for c in range(60, 90) for _ in range(5)]
    rows += [(None, t, "user" if t % 2 else "assistant", f"Turn {t // 4}.") for t in range(40)]
    rows += [(7000, t, ("user", "assistant", "assistant")[t % 3], draw.choice(texts)) for t in range(400)]
    rows += [(8000, 5, "user", "Again.")] * 300  # one row over and over
    rows += [(9000, None, "assistant", None)] * 3
    frame = spark.createDataFrame(rows, TURNS).repartition(6)
    clashes = [c for c in edge.CLASHES + ["conv", "turn_no", "law", "said", "times", "part", "place", "edit"] if c != "text"]
    found = conv.repair_damaged(frame.withColumns({c: F.lit(k) for k, c in enumerate(clashes)}))
    assert as_found(found) == repaired(rows)


def test_repair_of_the_shared_table(spark, sf):
    frame = spark.read.parquet(f"{sf}/conversations.parquet")
    want = repaired([tuple(r) for r in frame.select("conv_id", "turn", "role", "text").collect()])
    assert as_found(conv.repair_damaged(frame)) == want
    assert conv.repair_damaged(frame.limit(0)).collect() == []


def test_a_hot_conversation_is_put_in_order_by_many_tasks(spark):
    """Two thirds of all rows are one conversation, half of them one text: no task orders more than twice its share."""
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("conv_id"), F.col("id").alias("turn"), F.when(
            F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.when(F.col("id") % 4 < 2, "ok.").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    turns = conv._turns(rows, "conv_id", "turn", "role", "text")
    sizes = [r["count"] for r in turns.repartitionByRange(8, "conv", "turn", "role", "digest").groupBy(
        F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) <= 2 * sorted(sizes)[4]
    row = conv.audit_conversations(rows).where("conv = 0").first()
    assert row.duplicate > 9000 and len(row.audit) >= 20_000


def judged(text):
    """Counts and verdict of one text, in Python."""
    text = text or ""
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(zip(found, found[1:], found[2:]))
    covered = {k + d for k, w in enumerate(zip(found, found[1:], found[2:])) if windows[w] > 1 for d in range(3)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]

    def fails(line):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in line)
        end = low.rstrip(" \t\n\x0b\x0c\r")[-1]
        wrong = not re.search(rules.ENDS, end) if len(low) < rules.SHORT_LINE else not re.search(rules.MARKS, low)
        menu = len(low) <= rules.MENU_LINE and (re.search(rules.MENU, low) or re.search(rules.PAGES, low))
        return bool(wrong or menu or any(phrase in low for phrase in rules.BOILERPLATE))

    bad = [line for line in lines if fails(line)]
    base = len(found) < 50 or 100 * len(covered) > 50 * len(found)
    size, lost = sum(map(len, lines)), sum(map(len, bad))
    return {"n_words": len(found), "word_chars": sum(map(len, found)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines),
            "n_failed": len(bad), "text_chars": size, "lost_chars": lost, "base_failed": base,
            "kept": not base and 100 * lost <= 40 * size,
            "clean_text": "\n".join(line for line in text.split("\n") if line not in bad)}


def test_quality_rules_on_odd_documents(spark):
    prose = " ".join(f"word{k}" for k in range(60)) + "."
    rows = edge.ROWS + [(30 + k, text, "en", "s", 1) for k, text in enumerate([
        f"Home | About | Contact\n{prose}", f"{prose}\n\n{prose}", "a b c a b c a b", f"Home\nLog in\n{prose}\n© 2020 Someone",
        prose + "\nshort line without an end", f"{'x' * 119}\n{prose}", f"{'x' * 120}\n{prose}", f"{'y' * 300}\n" * 3 + prose,
        f"{prose}\nUses Cookies to track. ", "# $ % & | < > * " * 20, f"{prose} {prose}", "a » b › c.\n" + prose, f"{prose}\r\n{prose}x"])]
    found = rules.quality_rules(edge.documents(spark, rows))
    got = collections.Counter((r.doc_id, *[r[c] for c in sorted(judged(""))]) for r in found.collect())
    want = collections.Counter((d, *[v for _, v in sorted(judged(t).items())]) for d, t, *_ in rows)
    assert got == want
    assert rules.quality_rules(edge.documents(spark, [])).collect() == []


def test_quality_rules_stay_native(spark, sf):
    plan = rules.quality_rules(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange|RDD", plan)
