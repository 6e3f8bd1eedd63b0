"""Repair of the turn structure of conversations by alignment with an alternating grammar.

A repaired conversation is empty, or an optional system turn and pairs of a user's and an assistant's turn. Edits cost:
Keep 0, Rerole (to user or assistant) 2, Delete 3, Insert (an empty turn of user or assistant) 2; blank and duplicate
rows must be deleted, and a truncated row that stays adds 1. The turns are aligned to every feasible length of the
grammar string by Wagner and Fischer's recurrence. The tables of all lengths share their cells when they are filled
from the end, as all grammar strings end alike, so one table over (row, length left) serves them. Its band is Ukkonen's:
cells that can't come below the cost of a repair found beforehand aren't kept, nor cells for which another length in
the same phase of the grammar could stand. So the table grows with the rows only. All cheapest lengths that are left are
traced back, and the audit (the edits' initials) that is least in ASCII order is taken.

Rows travel once, to the task of their conversation, in two forms: without texts, in the order of turns, for faults and
alignment; and then with their texts, which go through the digest one by one. So a task holds some bytes a row of the
conversation it works on, never its texts. The digest over a whole conversation is sequential, so one is not split.

Defined results: nulls in role or text read as one space, in the damaging key likewise; a null turn comes first. Rows
of one turn are ordered by role and the MD5 of their text. Rows with a null conv_id are one conversation. An empty
table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
LEGAL = {"su", "ua", "au"}
ROLES = {"u": b"user", "a": b"assistant"}
#: Alignments of conversations of up to so many rows are remembered by the worker, the last ``MEMO`` of them.
SHORT, MEMO = 64, 20_000

RESULT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)


def damage(rows: DataFrame) -> DataFrame:
    """Conversations with faults: by the CRC-32 of ``conv_id:turn`` modulo 20, rows are dropped (0), emptied (1), lose
    their sentence ends (2), are repeated (3), or become the user's (4). Dropped rows stay, marked as such."""
    def named(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    conv_id, turn = (F.col(c).cast("long") for c in ("conv_id", "turn"))
    key = F.concat(F.coalesce(conv_id.cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(turn.cast("string"), F.lit(" ")))
    kind = F.crc32(key.cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(named("text"), "[.!?]", "")).otherwise(named("text"))
    role = F.when(kind == 4, F.lit("user")).otherwise(named("role"))
    times = F.when(kind == 3, 2).otherwise(1)
    plain = rows.select(conv_id.alias("conv_id"), turn.alias("turn"), role.alias("role"), text.alias("text"), (kind == 0).alias("dropped"), times.alias("times"))
    return plain.select("conv_id", "turn", "role", "text", "dropped", F.explode(F.array_repeat(F.lit(0), F.col("times")))).drop("col")


def _next(state: str, initial: str) -> str | None:
    """The state after a turn, or None. States are the last turn's initial, empty at the start."""
    if initial == "s":
        return "s" if state == "" else None
    return initial if initial == ("a" if state == "u" else "u") else None


def first_repair(initials: str, forced: bytes, truncated: bytes) -> int:
    """The cost of a repair from left to right, an upper bound."""
    cost, state = 0, ""
    for initial, gone, cut in zip(initials, forced, truncated, strict=True):
        if gone:
            cost += DELETE
        elif _next(state, initial):
            state, cost = initial, cost + cut * TRUNCATED
        elif initial in ROLES:
            state, cost = initial, cost + INSERT + cut * TRUNCATED
        else:
            state, cost = "a" if state == "u" else "u", cost + REROLE + cut * TRUNCATED
    return cost + {"": 0, "a": 0, "u": INSERT, "s": 2 * INSERT}[state]


def _phase(j: int) -> int:
    """What may still come where ``j`` turns are left: nothing, an assistant's turn first, or a user's."""
    return 2 if j == 0 else j % 2


def alignment_table(initials: str, forced: bytes, truncated: bytes, limit: int) -> list[dict[int, int]]:
    """table[i][j]: least cost of the rows from ``i`` on, aligned to the last ``j`` turns of the grammar string, for the
    cells in the band. What must be deleted before row ``i`` counts towards ``limit``.

    Rows before ``i`` can be aligned alike to all lengths of a phase. So of a phase the cheapest cell stays, and of equal
    ones that with the least audit. They begin with different edits, so that the edit decides; where two begin
    with the same one, they come from different phases, of which that with nothing left (only D follows) is the least.
    """
    n = len(initials)
    table: list[dict[int, int]] = [{}] * n + [{0: 0, 1: INSERT, 2: 2 * INSERT}]
    before = DELETE * sum(forced)
    for i in range(n - 1, -1, -1):
        before -= DELETE * forced[i]
        best: dict[int, tuple[int, str, int]] = {}
        for j, c in table[i + 1].items():
            found = [(c + DELETE, "D", j)]
            if not forced[i]:
                kept = initials[i] == "ua"[(j + 1) % 2]
                found.append((c + truncated[i] * TRUNCATED + (KEEP if kept else REROLE), "K" if kept else "R", j + 1))
            for cell in found:
                if cell < best.get(_phase(cell[2]), (limit + 1,)):
                    best[_phase(cell[2])] = cell
        for c, _, j in list(best.values()):
            if (c + INSERT, "I") < best.get(_phase(j + 1), (limit + 1,)):
                best[_phase(j + 1)] = (c + INSERT, "I", j + 1)
        table[i] = {j: c for c, _, j in best.values() if c + before <= limit}
    return table


def _traced(initials: str, forced: bytes, truncated: bytes, table: list[dict[int, int]], i: int, j: int) -> str:
    """The least audit of a cheapest alignment of the rows from ``i`` on to ``j`` turns."""
    audit = []
    n = len(initials)
    while i < n or j:
        cost = table[i][j]
        if i < n and table[i + 1].get(j, -9) + DELETE == cost:
            audit.append("D")
            i += 1
        elif j and table[i].get(j - 1, -9) + INSERT == cost:
            audit.append("I")
            j -= 1
        else:
            audit.append("K" if initials[i] == "ua"[j % 2] else "R")
            i, j = i + 1, j - 1
    return "".join(audit)


def repair(initials: str, forced: bytes, truncated: bytes) -> tuple[int, str]:
    """(least cost, its audit) for rows given by their roles' initials, whether they must go, and are truncated."""
    table = alignment_table(initials, forced, truncated, first_repair(initials, forced, truncated))
    # grammar strings of pairs only, and those with the system's turn kept from a row, all rows before deleted
    found = [(c, -1, j) for j, c in table[0].items() if j % 2 == 0]
    for k, initial in enumerate(initials):
        if initial == "s" and not forced[k]:
            found += [(DELETE * k + truncated[k] * TRUNCATED + c, k, j) for j, c in table[k + 1].items() if j and j % 2 == 0]
    least = min(c for c, *_ in found)
    audits = ("D" * max(k, 0) + "K" * (k >= 0) + _traced(initials, forced, truncated, table, k + 1, j) for c, k, j in found if c == least)
    return least, min(audits)


_short_repair = lru_cache(MEMO)(repair)


class _Conversation:
    """One conversation: first its rows without texts, then those with."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.initials: list[str] = []
        self.forced, self.truncated = bytearray(), bytearray()
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.seen: set[bytes] = set()
        self.low = self.high = self.last = None
        self.turns = 0
        self.edits: Iterator[str] | None = None
        self.cost, self.audit, self.state = 0, "", ""
        self.digest, self.empty = hashlib.sha256(), True

    def plain(self, turn: int | None, initial: str, content: bytes, blank: bool, cut: bool) -> None:
        seen = content in self.seen
        self.seen.add(content)
        fault = "blank" if blank else "duplicate" if seen else "truncated" if cut else None
        if fault:
            self.counts[fault] += 1
        self.initials.append(initial)
        self.forced.append(fault in ("blank", "duplicate"))
        self.truncated.append(fault == "truncated")
        if turn is not None and turn != self.last:
            self.low = turn if self.low is None else self.low
            self.high = self.last = turn
            self.turns += 1

    def align(self) -> None:
        """The edits, once all rows are known."""
        self.seen.clear()
        roles = "".join(x if x in ("s", "u", "a") else "x" for x in self.initials)
        f = _short_repair if len(roles) <= SHORT else repair
        self.cost, self.audit = f(roles, bytes(self.forced), bytes(self.truncated))
        self.edits = iter(self.audit)

    def _put(self, role: bytes, text: bytes) -> None:
        self.digest.update(role + b":" if self.empty else b"\n" + role + b":")
        self.digest.update(text)
        self.empty = False

    def _inserted(self) -> str:
        """The next edit of a row, after the turns that are inserted before it."""
        for edit in self.edits:
            if edit != "I":
                return edit
            self.state = "a" if self.state == "u" else "u"
            self._put(ROLES[self.state], b"")
        return ""

    def text(self, role: str, text: str) -> None:
        if self.edits is None:
            self.align()
        edit = self._inserted()
        if edit == "K":
            self.state = role[:1]
            self._put(role.encode(), text.encode())
        elif edit == "R":
            self.state = "a" if self.state == "u" else "u"
            self._put(ROLES[self.state], text.encode())

    def result(self) -> tuple:
        if self.edits is None:
            self.align()
        self._inserted()
        illegal = sum(x + y not in LEGAL for x, y in pairwise(self.initials))
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv_id, gaps, *self.counts.values(), illegal, self.cost, self.audit, self.digest.hexdigest())


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split(" ")[0] for c in RESULT.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    one, done = None, []
    for batch in batches:
        for conv_id, kind, turn, role, content, dropped, initial, blank, cut, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if one is None or conv_id != one.conv_id:
                if one is not None:
                    done.append(one.result())
                one = _Conversation(conv_id)
            if dropped:
                continue
            if kind == 0:
                one.plain(turn, initial, content, blank, cut)
            else:
                one.text(role, text)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)
            done = []
    if one is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(one.result(), kinds, strict=True)], names)


def repaired(rows: DataFrame) -> DataFrame:
    """Repair conversations (conv_id, turn, role, text, dropped), one row each: conv_id, gaps, blank, duplicate,
    truncated, illegal, cost, audit, repaired_sha256. A conversation all of whose rows are dropped is empty."""
    role, text = F.col("role"), F.col("text")
    order = F.md5(text.cast("binary"))
    content = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    last = F.regexp_extract(text, r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    flat = rows.select(
        "conv_id", "turn", "role", "text", "dropped", order.alias("place"), content.alias("content"), F.substring(role, 1, 1).alias("initial"),
        (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"),
        F.explode(F.when(F.col("dropped"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("kind"),
    )
    here = F.col("kind") == 1
    flat = flat.withColumn("text", F.when(here, text)).withColumn("content", F.when(~here, F.col("content")))
    keys = [F.col("conv_id").asc_nulls_first(), "kind", F.col("turn").asc_nulls_first(), "role", "place"]
    placed = flat.repartition("conv_id").sortWithinPartitions(*keys)
    return placed.select("conv_id", "kind", "turn", "role", "content", "dropped", "initial", "blank", "cut", "text").mapInArrow(_repaired, RESULT)
