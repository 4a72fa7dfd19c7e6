"""Repairing the structure of conversations by alignment with the grammar ``(s?(ua)+)?``.

The grammar has one string of roles for every feasible length. A conversation is aligned with all of
them by Wagner and Fischer's table, with Keep, Rerole, Insert and Delete as its edits. The strings end
alike, so one table of suffixes serves all lengths: the cost of row i and later against the last r roles.
A leading system row can only be kept, so it is joined before the table. Only the band of Ukkonen is
filled: cells whose unavoidable cost does not exceed that of an incumbent, a greedy repair. Of all lengths
and beginnings of least cost the edits are traced back, and the ASCII-least audit is taken. Every k-th row
of the table is kept and the rows between are filled again for the trace, so memory stays far
below the table's size.

A conversation's rows come twice in one shuffle: first without texts, which gives the edits, then with
them, so that no conversation's texts are held at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanspark.llm.common import BLANKS, arrow_schema, share_of

DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
# A row's code: the role's initial, plus 4 times the fault.
INITIALS = "sua"
OTHER = 3
FORCED, CUT = 4, 8
NEVER = 1 << 40
# Alignments that a task remembers; short conversations often look alike.
REMEMBERED = 1 << 15
REMEMBERED_ROWS = 64

ENDS = r"[.!?]"
NAMES = {"u": "user", "a": "assistant"}


class Table:
    """Costs of rows i.. against the last r roles of a string, inside the band."""

    def __init__(self, codes: bytes):
        rows = np.frombuffer(codes, dtype=np.uint8)
        self.n = len(rows)
        self.initial, self.forced, self.cut = rows & 3, (rows & FORCED) > 0, (rows & CUT) > 0
        free, cut = np.zeros(self.n + 1, dtype=np.int64), np.zeros(self.n + 1, dtype=np.int64)
        free[:-1] = np.cumsum(~self.forced[::-1])[::-1]
        cut[:-1] = np.cumsum(self.cut[::-1])[::-1]
        least = DELETE * int(self.forced.sum()) + TRUNCATED * int(cut[0])
        self.spare = self.incumbent() - least
        # Deleting a truncated row costs one more than leaving it, any other row four.
        dearer = DELETE - TRUNCATED
        deleted = np.where(self.spare <= dearer * cut, self.spare, cut + (self.spare - dearer * cut) // DELETE)
        self.low = np.maximum(0, free - deleted)
        self.high = free + self.spare // INSERT
        self.width = int(self.high.max()) + 2
        self.block = isqrt(self.n) + 1
        self.kept: dict[int, np.ndarray] = {}
        row = self.last()
        for i in range(self.n, -1, -1):
            row = row if i == self.n else self.above(i, row)
            if i % self.block == 0 or i == self.n:
                self.kept[i] = row
        self.top = row

    def incumbent(self) -> int:
        """The cost of keeping or rerolling every row that may stay, in turn from a user's."""
        cost, turn = 0, 0
        for code in zip(self.initial.tolist(), self.forced.tolist(), self.cut.tolist()):
            if code[1]:
                cost += DELETE
                continue
            cost += (0 if code[0] == 1 + turn else REROLE) + (TRUNCATED if code[2] else 0)
            turn = 1 - turn
        return cost + turn * INSERT

    def last(self) -> np.ndarray:
        row = np.full(self.width, NEVER, dtype=np.int64)
        band = np.arange(self.low[-1], self.high[-1] + 1)
        row[band] = INSERT * band
        return row

    def above(self, i: int, below: np.ndarray) -> np.ndarray:
        """Row i of the table from row i + 1."""
        low, high = int(self.low[i]), int(self.high[i])
        r = np.arange(low, high + 1)
        best = below[low : high + 1] + DELETE
        if not self.forced[i]:
            step = np.full(self.width, NEVER, dtype=np.int64)
            step[1:] = below[:-1]
            best = np.minimum(best, step[low : high + 1] + self.kept_cost(i, r))
        row = np.full(self.width, NEVER, dtype=np.int64)
        row[low : high + 1] = np.minimum.accumulate(best - INSERT * r) + INSERT * r
        return np.minimum(row, NEVER)

    def kept_cost(self, i: int, r):
        """The cost of row i in place of the first of the last r roles; these start with a user's if r is even."""
        same = self.initial[i] == 1 + (r & 1)
        return np.where(same, 0, REROLE) + (TRUNCATED if self.cut[i] else 0)

    def rows(self, start: int) -> dict[int, np.ndarray]:
        """Rows start to start + block of the table."""
        stop = min(start + self.block, self.n)
        found = {stop: self.kept[stop]}
        for i in range(stop - 1, start - 1, -1):
            found[i] = self.above(i, found[i + 1])
        return found

    def begun_by_system(self) -> Iterator[tuple[int, np.ndarray, int]]:
        """(row, costs of the rest, cost so far) of each row that may be kept as the first system row."""
        systems = np.flatnonzero((self.initial == 0) & ~self.forced)
        for start in range(0, self.n, self.block):
            inside = systems[(systems >= start) & (systems < start + self.block)]
            if len(inside):
                table = self.rows(start)
                for i in inside.tolist():
                    yield i, table[i + 1], DELETE * i + (TRUNCATED if self.cut[i] else 0)

    def solved(self) -> tuple[int, str]:
        """(least cost, the least audit of that cost)."""
        best, starts = NEVER, []

        def met(costs: np.ndarray, lengths: np.ndarray, i: int, audit: str) -> None:
            nonlocal best, starts
            least = int(costs.min(initial=NEVER))
            if least > best:
                return
            if least < best:
                best, starts = least, []
            starts += [(i, int(r), audit) for r in lengths[costs == least]]

        even = np.arange(0, self.width, 2)
        met(self.top[even], even, 0, "")
        for i, row, cost in self.begun_by_system():
            met(row[even[1:]] + cost, even[1:], i + 1, "D" * i + "K")
        return best, min(self.traced(starts))

    def traced(self, starts: list[tuple[int, int, str]]) -> list[str]:
        """The least audit from each (row, roles left, audit so far); all walk block by block."""
        walks = [[i, r, [audit]] for i, r, audit in starts]
        for start in range(0, max(self.n, 1), self.block):
            stop = min(start + self.block, self.n)
            table = self.rows(start)
            for walk in walks:
                i, r, edits = walk
                while i < stop or (i == self.n and r):
                    cost = table[i][r]
                    if i < stop and table[i + 1][r] + DELETE == cost:
                        edits.append("D")
                        i += 1
                    elif r and table[i][r - 1] + INSERT == cost:
                        edits.append("I")
                        r -= 1
                    else:
                        edits.append("K" if self.initial[i] == 1 + (r & 1) else "R")
                        i, r = i + 1, r - 1
                walk[:2] = i, r
        return ["".join(edits) for _, _, edits in walks]


def aligned(codes: bytes) -> tuple[int, str]:
    return Table(codes).solved()


def repair(codes: bytes, known: dict[bytes, tuple[int, str]]) -> tuple[int, str, str]:
    """(cost, audit, roles' initials after it) of the rows with these codes; short ones are remembered."""
    if codes not in known:
        if len(codes) > REMEMBERED_ROWS or len(known) >= REMEMBERED:
            known.clear()
        known[codes] = aligned(codes)
    cost, audit = known[codes]
    length = len(audit) - audit.count("D")
    return cost, audit, "s" * (length % 2) + "ua" * (length // 2)


class Conversation:
    """One conversation in its order, first the rows without texts, then those with them."""

    def __init__(self, conv, known: dict[bytes, tuple[int, str]]):
        self.conv, self.known, self.codes, self.seen = conv, known, bytearray(), set()
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first = self.last = self.before = None
        self.turns = 0
        self.audit: str | None = None

    def look(self, turn: int | None, role: str, blank: bool, ended: bool, print_: bytes) -> None:
        if turn is not None and turn != self.last:
            self.first, self.last = turn if self.first is None else self.first, turn
            self.turns += 1
        initial = role[:1]
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        code = INITIALS.find(initial) if initial in ("s", "u", "a") else OTHER
        key = (role, print_)
        if blank:
            self.blank += 1
            code |= FORCED
        elif key in self.seen:
            self.duplicate += 1
            code |= FORCED
        elif not ended:
            self.truncated += 1
            code |= CUT
        self.seen.add(key)
        self.codes.append(code)

    def decide(self) -> None:
        self.cost, self.audit, self.roles = repair(bytes(self.codes), self.known)
        self.sha, self.edit, self.place, self.seen = hashlib.sha256(), 0, 0, set()

    def put(self, role: str, text: str) -> None:
        if self.place:
            self.sha.update(b"\n")
        self.sha.update(f"{role}:{text}".encode())
        self.place += 1

    def insert(self) -> None:
        while self.edit < len(self.audit) and self.audit[self.edit] == "I":
            self.put(NAMES[self.roles[self.place]], "")
            self.edit += 1

    def write(self, role: str, text: str) -> None:
        self.insert()
        edit = self.audit[self.edit]
        self.edit += 1
        if edit != "D":
            self.put(role if edit == "K" else NAMES[self.roles[self.place]], text)

    def result(self) -> tuple:
        if self.audit is None:
            self.decide()
        self.insert()
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return (self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, self.audit,
                self.sha.hexdigest())


def repaired(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows(conv, turn, role, text)``: faults, cost, audit and digest.

    Rows are taken by turn, NULL first; ties by role, then by a digest of the text. A row without a role
    (NULL) only names its conversation: one that has no other rows gets zeros, the empty audit and
    the digest of nothing. NULL is a conversation of its own. Memory grows with the number of rows of a
    conversation (some 200 bytes each), not with its texts; its digest is one stream, so a
    conversation is one task's work.
    """
    own = F.unhex(F.substring(F.sha2("text", 256), 1, 32))
    ended = F.col("text").rlike(rf"{ENDS}{BLANKS}*\z")
    looked = rows.select(
        "conv", "turn", "role", F.col("text").rlike(rf"^{BLANKS}*\z").alias("blank"), ended.alias("ended"),
        own.alias("print"), F.posexplode(F.array(F.lit(None).cast("string"), F.col("text"))).alias("phase", "text"),
    ).filter("phase = 0 OR role IS NOT NULL")
    schema = (
        f"conv {dict(rows.dtypes)['conv']}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, "
        "illegal bigint, cost bigint, audit string, repaired_sha256 string"
    )
    names = ("conv", "phase", "turn", "role", "blank", "ended", "print", "text")

    types = arrow_schema(rows.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(done: list[tuple]) -> pa.RecordBatch:
            columns = zip(*done) if done else [[]] * len(types)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, types)], schema=types)

        now: Conversation | None = None
        known: dict[bytes, tuple[int, str]] = {}
        for batch in batches:
            done = []
            for conv, phase, turn, role, blank, ended, print_, text in zip(
                *(batch.column(n).to_pylist() for n in names)
            ):
                if now is None or now.conv != conv:
                    if now is not None:
                        done.append(now.result())
                    now = Conversation(conv, known)
                if role is None:
                    continue
                if phase == 0:
                    now.look(turn, role, blank, ended, print_)
                else:
                    if now.audit is None:
                        now.decide()
                    now.write(role, text)
            yield table(done)
        if now is not None:
            yield table([now.result()])

    order = ("conv", "phase", "turn", "role", "print")
    return looked.repartition("conv").sortWithinPartitions(*order).mapInArrow(run, schema)


def damaged(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv, turn, role, text) with one kind of damage for a fourth of the turns, by a hash of their name.

    A NULL role or text becomes one blank. Dropped rows stay as the name of their conversation, without
    turn, role and text.
    """
    blank = F.lit(" ")
    name = F.concat(
        F.coalesce(F.col(conv_col).cast("string"), blank), F.lit(":"), F.coalesce(F.col(turn_col).cast("string"), blank)
    )
    kind, text = share_of(name, 20), F.coalesce(F.col(text_col), blank)
    changed = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, ENDS, "")).otherwise(text)
    role = F.when(kind == 4, "user").otherwise(F.coalesce(F.col(role_col), blank))
    stays = kind != 0
    copies = F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1)))
    return rows.select(
        F.col(conv_col).alias("conv"), F.when(stays, F.col(turn_col).cast("bigint")).alias("turn"),
        F.when(stays, role).alias("role"), F.when(stays, changed).alias("text"), copies.alias("copy"),
    ).drop("copy")
