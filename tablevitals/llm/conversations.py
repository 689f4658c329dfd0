"""Repair of conversation structure with Four-Russians block tables.

The cheapest edits that turn a conversation into a well-formed one come from a small automaton. The costs that remain
from each of its states form a vector; less their minimum, only a few dozen vectors exist. Tables say for each vector
and each block of four rows which vector lies before the block and what it costs, so a conversation is read from its
end block by block. The edits are then traced from the front, expanding each block backward, row by row, so that of
several cheapest edit lists the least in ASCII is found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablevitals.llm.common import per_process, ref
from tablevitals.session import materialize

SPACES = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT = "KRDI"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 3, 4, 3, 3
#: Role initials. States: nothing yet, after s, after u, after a; the first and the last may end a conversation.
INITIALS = "sua"
STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ROLE_NAMES = {"u": "user", "a": "assistant"}
#: The role that a state takes by an insertion or a change of role, and where it leads.
TAKES = tuple(next((r, to) for r, to in step.items() if r in ROLE_NAMES) for step in STEPS)
#: What is left to do at the end.
END_EDITS = ("", INSERT * 2, INSERT, "")
#: Rows as letters from A on, four per initial (the fourth for all other roles): fine, truncated, blank, duplicate.
FINE, TRUNCATED, BLANK, DUPLICATE = range(4)
#: Symbols of the tables: two per initial (fine, truncated), a row that must go, and nothing at all.
GONE, NOTHING, SYMBOLS = 8, 9, 10
BLOCK = 4
#: Symbols that a part of a conversation holds at most; a conversation has any number of parts.
PART = 1 << 20
#: Copies of a repeated text's first turn, so that the turns of a very common one meet in several tasks.
SALTS = 8

_SYMBOL_OF = np.full(256, NOTHING, np.int64)
for _letter in range(16):
    _SYMBOL_OF[65 + _letter] = GONE if _letter % 4 >= BLANK else _letter // 4 * 2 + _letter % 4


def before(costs: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    """The costs from each state before a row, given those after it."""
    if symbol == NOTHING:
        return costs
    found = [DELETE_COST + c for c in costs]
    if symbol != GONE:
        more = TRUNCATED_COST * (symbol % 2)
        for state, step in enumerate(STEPS):
            kept = step.get(INITIALS[symbol // 2]) if symbol // 2 < len(INITIALS) else None
            found[state] = min([found[state], more + REROLE_COST + costs[TAKES[state][1]]]
                               + ([] if kept is None else [more + costs[kept]]))
    for _ in STEPS:
        found = [min(c, INSERT_COST + found[TAKES[state][1]]) for state, c in enumerate(found)]
    return tuple(found)


def edits_of(state: int, symbol: int, costs: tuple[int, ...]) -> tuple[str, int]:
    """The ASCII-least cheapest edits that take a row in, insertions before it included, and the state after it."""
    if symbol == NOTHING:
        return "", state
    left, edits = before(costs, symbol), ""
    more = TRUNCATED_COST * (symbol % 2)
    while True:
        if left[state] == DELETE_COST + costs[state]:
            return edits + DELETE, state
        if left[state] == INSERT_COST + left[TAKES[state][1]]:
            edits, state = edits + INSERT, TAKES[state][1]
            continue
        kept = STEPS[state].get(INITIALS[symbol // 2]) if symbol // 2 < len(INITIALS) else None
        if kept is not None and left[state] == more + costs[kept]:
            return edits + KEEP, kept
        return edits + REROLE, TAKES[state][1]


class BlockTables:
    """Normalised cost vectors and their transitions over single symbols and over all blocks of ``BLOCK`` symbols."""

    def __init__(self) -> None:
        end = tuple(INSERT_COST * len(e) for e in END_EDITS)
        vectors, number = [end], {end: 0}
        to, add = [], []
        for costs in vectors:  # grows while it is read
            for symbol in range(SYMBOLS):
                raw = before(costs, symbol)
                least = min(raw)
                normal = tuple(c - least for c in raw)
                if normal not in number:
                    number[normal] = len(vectors)
                    vectors.append(normal)
                to.append(number[normal])
                add.append(least)
        self.vectors = vectors
        one, cost = np.array(to).reshape(-1, SYMBOLS), np.array(add).reshape(-1, SYMBOLS)
        block = np.arange(SYMBOLS ** BLOCK)
        at, total = np.repeat(np.arange(len(vectors))[:, None], len(block), axis=1), 0
        for place in range(BLOCK):  # the last symbol of the block comes first
            symbol = block // SYMBOLS ** place % SYMBOLS
            total = total + cost[at, symbol]
            at = one[at, symbol]
        self.one = one.tolist()
        self.to, self.add = at.tolist(), total.tolist()
        self.edits = [[[edits_of(s, x, v) for v in vectors] for x in range(SYMBOLS)] for s in range(len(STEPS))]

    def audit(self, rows: str) -> tuple[str, int]:
        """The cheapest edits of a conversation's rows, given as letters, and their cost."""
        codes = np.full(-(-len(rows) // BLOCK) * BLOCK, NOTHING, np.int64)
        codes[:len(rows)] = _SYMBOL_OF[np.frombuffer(rows.encode(), np.uint8)]
        symbols = codes.reshape(-1, BLOCK)
        blocks = symbols @ SYMBOLS ** np.arange(BLOCK - 1, -1, -1)
        vector, cost, after = 0, 0, np.empty(len(blocks), np.int32)
        for k in range(len(blocks) - 1, -1, -1):
            after[k] = vector
            cost += self.add[vector][blocks[k]]
            vector = self.to[vector][blocks[k]]
        cost += self.vectors[vector][0]
        state, found = 0, []
        for k, (a, b, c, d) in enumerate(symbols.tolist()):
            last = int(after[k])
            third = self.one[last][d]
            second = self.one[third][c]
            for symbol, vector in ((a, self.one[second][b]), (b, second), (c, third), (d, last)):
                edits, state = self.edits[state][symbol][vector]
                found.append(edits)
        return "".join(found) + END_EDITS[state], cost


def _turns(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv, turn, role, text, digest; a missing role or text is one space."""
    text = F.coalesce(ref(text_col), F.lit(" "))
    return rows.select(ref(conv_col).alias("conv"), ref(turn_col).alias("turn"),
                       F.coalesce(ref(role_col), F.lit(" ")).alias("role"), text.alias("text"),
                       F.unhex(F.md5(text.cast("binary"))).alias("digest"))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, part, symbols): runs of one conversation within an ordered partition, ``PART`` symbols at most."""
    partition, number, at, letters, size, rows = TaskContext.get().partitionId(), 0, None, [], 0, []
    for batch in batches:
        kinds = [batch.schema.field("conv").type, pa.int64(), pa.string()]
        for conv, first, other, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for letter, times in ((first, 1), (other, n - 1)):
                while times > 0:
                    if size and (at != conv or size >= PART):
                        rows.append((at, partition << 32 | number, "".join(letters)))
                        number, letters, size = number + 1, [], 0
                    now = min(times, PART - size)
                    letters.append(letter * now)
                    at, size, times = conv, size + now, times - now
                    if sum(len(r[2]) for r in rows[-1:]) >= PART:
                        yield _batch(rows, kinds, ["conv", "part", "symbols"])
                        rows = []
        if rows:
            yield _batch(rows, kinds, ["conv", "part", "symbols"])
            rows = []
    if size:
        yield _batch([(at, partition << 32 | number, "".join(letters))], kinds, ["conv", "part", "symbols"])


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds, strict=True)], names=names)


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from its parts, which come one after the other."""
    tables = per_process("conversation tables", BlockTables)
    names = ["conv", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    fair = np.zeros((4, 4), bool)
    fair[[0, 1, 2], [1, 2, 1]] = True  # su, ua, au
    at, symbols, kinds = None, [], []

    def row() -> tuple:
        text = "".join(symbols)
        letters = np.frombuffer(text.encode(), np.uint8) - 65
        counts, roles = np.bincount(letters % 4, minlength=4).tolist(), letters // 4
        audit, cost = tables.audit(text)
        illegal = int((~fair[roles[:-1], roles[1:]]).sum())
        return at, counts[BLANK], counts[DUPLICATE], counts[TRUNCATED], illegal, cost, audit

    for batch in batches:
        kinds, rows = [batch.schema.field("conv").type, *[pa.int64()] * 5, pa.string()], []
        for conv, _, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if symbols and at != conv:
                rows.append(row())
                symbols = []
            at = conv
            symbols.append(own)
        if rows:
            yield _batch(rows, kinds, names)
    if symbols:
        yield _batch([row()], kinds, names)


def audit_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                        text_col: str = "text") -> DataFrame:
    """One row per conversation: conv, gaps, blank, duplicate, truncated, illegal, cost (long), audit.

    Rows stand in order of turn (missing ones first), then of role and of a digest of the text, so that ties have one
    order. A missing role or text is one space. A row is blank without any character but white space, else a duplicate
    if its role and text were there earlier, else truncated if its last such character isn't one of ``.!?``. Blank
    and duplicate rows must go (4); a row that stays costs 3 if truncated, a change of its role to user or assistant
    3, an empty turn put in 3. The role initials must then read ``(s?(ua)+)?``. ``audit`` has an initial (K, R, D,
    I) for each edit, the ASCII-least of the cheapest; ``illegal`` counts neighbours other than su, ua and au;
    ``gaps`` is last turn - first turn + 1 - distinct turns, without missing ones. A missing conversation id is a
    conversation of its own; an empty table gives none; other columns are ignored whatever their names.

    Equal rows are counted before the shuffle, a conversation's rows are put in order over as many tasks as they need
    (range partitions) and come together as one letter each, of which the audit has one or more, too.
    """
    turns = _turns(rows, conv_col, turn_col, role_col, text_col)
    body = F.btrim("text", F.lit(SPACES))
    counted = materialize(turns.withColumn("flaw", F.when(body == "", BLANK).when(
        ~F.right(body, F.lit(1)).isin(*".!?"), TRUNCATED).otherwise(FINE)).groupBy(
        "conv", "turn", "role", "digest", "flaw").agg(F.count("*").alias("n")))
    # What was said in several turns, with the first of these.
    again = (counted.where(F.col("flaw") != BLANK).groupBy("conv", "role", "digest")
             .agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("times")).where("times > 1")
             .select(F.col("conv").alias("of"), F.col("role").alias("said_by"), F.col("digest").alias("said"), "first",
                     F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    marked = counted.join(again, F.col("conv").eqNullSafe(F.col("of")) & (F.col("role") == F.col("said_by")) & (
        F.col("digest") == F.col("said")) & (F.pmod(F.xxhash64("turn"), F.lit(SALTS)) == F.col("salt")), "left")
    first = F.left("role", F.lit(1))
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    repeat = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    flaw = F.when((F.col("flaw") != BLANK) & repeat, DUPLICATE).otherwise(F.col("flaw"))

    def letter(of):
        return F.char((initial * 4 + of + 65).cast("long"))

    order = ["conv", "turn", "role", "digest"]
    parts = marked.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv", letter(flaw).alias("first"), letter(F.when(F.col("flaw") == BLANK, BLANK).otherwise(DUPLICATE)).alias("other"),
        "n")
    kind = turns.schema["conv"].dataType.simpleString()
    parts = parts.mapInArrow(_parts, f"conv {kind}, part long, symbols string")
    audits = parts.repartition("conv").sortWithinPartitions("conv", "part").mapInArrow(
        _audited, f"conv {kind}, blank long, duplicate long, truncated long, illegal long, cost long, audit string")
    gaps = counted.groupBy(F.col("conv").alias("of")).agg(F.coalesce(
        F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    return audits.join(gaps, F.col("conv").eqNullSafe(F.col("of"))).select(
        "conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Takes each conversation's audit, then its rows, and gives the turns that the edits leave."""
    names = ["conv", "place", "edit", "role", "text"]
    audit, at, state, place, conv = "", 0, 0, 0, None

    def turn(edit: str, role: str, text: str) -> tuple:
        nonlocal place
        place += 1
        return conv, place - 1, edit, role, text

    def inserted() -> Iterator[tuple]:
        nonlocal at, state
        while at < len(audit) and audit[at] == INSERT:
            role, state = TAKES[state]
            at += 1
            yield turn(INSERT, ROLE_NAMES[role], "")

    kinds: list[pa.DataType] = []
    for batch in batches:
        kinds, rows = [batch.schema.field("conv").type, pa.int64(), pa.string(), pa.string(), pa.string()], []
        for next_conv, is_row, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not is_row:
                rows.extend(inserted())  # what the conversation before ends with
                conv, audit, at, state, place = next_conv, text, 0, 0, 0
                continue
            rows.extend(inserted())
            edit = audit[at]
            at += 1
            if edit == REROLE:
                to, state = TAKES[state]
                rows.append(turn(REROLE, ROLE_NAMES[to], text))
            elif edit == KEEP:
                state = STEPS[state][role[0]]
                rows.append(turn(KEEP, role, text))
        if rows:
            yield _batch(rows, kinds, names)
    if rows := [*inserted()]:
        yield _batch(rows, kinds, names)


def repaired_turns(rows: DataFrame, audits: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                   role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, place, edit, role, text): the turns of every conversation after its edits, ``audits`` made from the same rows.

    A conversation lies in one partition in order of place; its rows stream through it one by one, after its audit,
    and are never held together. A conversation without turns gives no row.
    """
    turns = _turns(rows, conv_col, turn_col, role_col, text_col).withColumn("is_row", F.lit(True))
    heads = audits.select("conv", F.lit(None).cast(turns.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"),
                          F.col("audit").alias("text"), F.lit(b"").alias("digest"), F.lit(False).alias("is_row"))
    kind = turns.schema["conv"].dataType.simpleString()
    return (turns.unionByName(heads).repartition("conv")
            .sortWithinPartitions("conv", "is_row", "turn", "role", "digest").select("conv", "is_row", "role", "text")
            .mapInArrow(_repaired, f"conv {kind}, place long, edit string, role string, text string"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, digest, kinds = None, None, []
    for batch in batches:
        kinds, rows = [batch.schema.field("conv").type, pa.string()], []
        for conv, place, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if place == 0:
                if digest is not None:
                    rows.append((at, digest.hexdigest()))
                at, digest = conv, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        if rows:
            yield _batch(rows, kinds, ["conv", "repaired_sha256"])
    if digest is not None:
        yield _batch([(at, digest.hexdigest())], kinds, ["conv", "repaired_sha256"])


def turn_digests(turns: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of the turns that ``repaired_turns`` gives: ``role:text``, joined by line feeds."""
    kind = turns.schema["conv"].dataType.simpleString()
    return turns.select("conv", "place", "role", "text").mapInArrow(_digests, f"conv {kind}, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) damaged by the CRC of ``conv_id:turn``; missing values count as one space.

    By the remainder of 20: 0 drops the row, 1 empties its text, 2 takes the marks ``.!?`` out of it, 3 gives the row
    twice, 4 makes it the user's; other rows stay as they are.
    """
    def shown(name: str):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    law = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(law == 1, "").when(law == 2, F.translate(shown("text"), ".!?", "")).otherwise(shown("text"))
    return rows.where(law != 0).select(
        "conv_id", "turn", F.when(law == 4, "user").otherwise(shown("role")).alias("role"), text.alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(law == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def repair_damaged(rows: DataFrame) -> DataFrame:
    """One row per conversation id of ``rows``: what ``damaged`` leaves of it, audited and repaired.

    Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256; see
    ``audit_conversations``. A conversation of which no row is left has zeros, an empty audit and the digest of nothing.
    """
    broken = damaged(rows)
    audits = materialize(audit_conversations(broken))
    digests = turn_digests(repaired_turns(broken, audits)).withColumnRenamed("conv", "digest_of")
    found = rows.select("conv_id").distinct().join(audits, F.col("conv_id").eqNullSafe(F.col("conv")), "left").join(
        digests, F.col("conv_id").eqNullSafe(F.col("digest_of")), "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return found.select(
        "conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
