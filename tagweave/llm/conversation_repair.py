"""Repair of conversations: the cheapest edits after which roles alternate, by Knuth's lightest derivations.

An item (i, state) says that the first i turns have been dealt with and that the roles kept so far end in
`state`: none yet, after a system turn, after a user turn, after an assistant turn. Deductions keep, rerole
or delete the next turn, or insert a turn. Each adds its cost to an item's (cost, audit) and its initial to
the audit, which never makes it smaller and keeps the order of any two derivations of an item: functions
superior and monotone, so that the first time that an item is popped from the agenda its derivation is the
lightest, ties by the audit's ASCII order.

Rows of a conversation stream through a task, sorted. The agenda works on SEGMENT turns at once: the items
at a segment's end, once popped, are the axioms of the next one, each with its audit and the running hash
of its repaired text, so that no conversation is held whole. What the items' audits begin with alike is
taken off, once a segment, and put back in the end.
"""

from __future__ import annotations

import hashlib
import heapq
import os.path
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagweave.llm.common import only, ship, utf8

SEGMENT = 256
KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
TRUNCATED = 3
WHITE = " \t\n\x0b\x0c\r"
LEGAL = {"su", "ua", "au"}
#: States: no turn yet, and the initial of the last one kept.
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: state -> (state and role of the turn that may follow by an insertion or a new role).
NEXT = {NONE: (USER, "user"), SYSTEM: (USER, "user"), USER: (ASSISTANT, "assistant"), ASSISTANT: (USER, "user")}
INITIAL = {USER: "u", ASSISTANT: "a"}


def deductions(state: int, turn: tuple[str, bool, bool] | None) -> Iterator[tuple[str, int, int, str | None, bool]]:
    """(letter, cost, next state, role written or None, whether the turn is used) from an item; turn: initial, must go, truncated."""
    then, role = NEXT[state]
    yield "I", INSERT, then, role, False
    if turn is None:
        return
    initial, gone, cut = turn
    yield "D", DELETE, state, None, True
    if gone:
        return
    late = TRUNCATED * cut
    if state == NONE and initial == "s":
        yield "K", KEEP + late, SYSTEM, None, True
    if initial == INITIAL[then]:
        yield "K", KEEP + late, then, None, True
    yield "R", REROLE + late, then, role, True


class Repair:
    """Turns go in one by one; `finish` returns (cost, audit, hash)."""

    def __init__(self, segment: int = SEGMENT):
        self.segment = segment
        self.turns: list[tuple[tuple[str, bool, bool], str, str]] = []
        self.alike: list[str] = []
        #: state -> cost, audit, hash of the repaired text, whether anything is in it.
        self.items = {NONE: (0, "", hashlib.sha256(), False)}

    def add(self, role: str, text: str, gone: bool, cut: bool) -> None:
        if len(self.turns) == self.segment:
            self._close()
        self.turns.append(((role[:1], gone, cut), role, text))

    def _agenda(self, goals: set[tuple[int, int]], enough: int) -> dict[tuple[int, int], tuple[int, str, int, tuple]]:
        """(cost, audit, axiom's state, steps) of the first `enough` goals popped; steps are (role or None, turn or None) in a chain."""
        n = len(self.turns)
        agenda = [(cost, audit, 0, state, state, ()) for state, (cost, audit, _, _) in self.items.items()]
        heapq.heapify(agenda)
        done: set[tuple[int, int]] = set()
        found: dict[tuple[int, int], tuple[int, str, int, tuple]] = {}
        while agenda and len(found) < enough:
            cost, audit, i, state, axiom, steps = heapq.heappop(agenda)
            if (i, state) in done:
                continue
            done.add((i, state))
            if (i, state) in goals:
                found[i, state] = cost, audit, axiom, steps
            turn = self.turns[i][0] if i < n else None
            for letter, more, then, role, used in deductions(state, turn):
                at = i + used
                if (at, then) not in done:
                    wrote = steps if letter == "D" else (steps, role, i if used else None)
                    heapq.heappush(agenda, (cost + more, audit + letter, at, then, axiom, wrote))
        return found

    def _close(self, states: tuple[int, ...] = (NONE, SYSTEM, USER, ASSISTANT), enough: int = 4) -> None:
        """The items at the segment's end; turns go."""
        found = self._agenda({(len(self.turns), state) for state in states}, enough)
        held, self.items = self.items, {}
        for (_, state), (cost, audit, axiom, steps) in found.items():
            _, _, digest, some = held[axiom]
            digest = digest.copy()
            for line in self._lines(steps):
                digest.update(b"\n" + line if some else line)
                some = True
            self.items[state] = cost, audit, digest, some
        shared = os.path.commonprefix([audit for _, audit, _, _ in self.items.values()])
        self.alike.append(shared)
        self.items = {state: (cost, audit[len(shared) :], digest, some) for state, (cost, audit, digest, some) in self.items.items()}
        self.turns = []

    def _lines(self, steps: tuple) -> list[bytes]:
        out = []
        while steps:
            steps, role, at = steps
            _, own, text = self.turns[at] if at is not None else (None, None, "")
            out.append(utf8(f"{own if role is None else role}:{text}"))
        return out[::-1]

    def finish(self) -> tuple[int, str, str]:
        """The first goal that the agenda pops: all turns dealt with, and nothing kept or an assistant's turn last."""
        self._close((NONE, ASSISTANT), 1)
        ((cost, audit, digest, _),) = self.items.values()
        return cost, "".join(self.alike) + audit, digest.hexdigest()


class Report:
    """What is told of one conversation."""

    def __init__(self, conv_id: int | None, segment: int):
        self.conv_id, self.repair = conv_id, Repair(segment)
        self.low = self.high = self.last = None
        self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before: str | None = None

    def add(self, turn: int | None, role: str, text: str, blank: bool, seen: bool, cut: bool) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.distinct += turn != self.last
            self.high = self.last = turn
        gone = blank or seen
        self.blank += blank
        self.duplicate += seen and not blank
        self.truncated += cut and not gone
        if self.before is not None:
            self.illegal += self.before + role[:1] not in LEGAL
        self.before = role[:1]
        self.repair.add(role, text, gone, cut and not gone)

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, *self.repair.finish()


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _repair(segment: int):
    names = [f.split()[0] for f in REPORT.split(", ")]
    types = [pa.string() if f.endswith("string") else pa.int64() for f in REPORT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("conversation_repair")
        open_: Report | None = None
        for batch in batches:
            done = []
            for conv_id, turn, role, text, there, blank, seen, cut in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if open_ is None or open_.conv_id != conv_id:
                    if open_ is not None:
                        done.append(open_.row())
                    open_ = Report(conv_id, segment)
                if there:
                    open_.add(turn, role, text, blank, seen, cut)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)
        if open_ is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(open_.row(), types, strict=True)], names)

    return run


def repair(rows: DataFrame, there: Column | None = None, segment: int = SEGMENT) -> DataFrame:
    """REPORT of every conv_id in rows (conv_id, turn, role, text): faults, and the cheapest repair.

    A conversation's rows are taken by turn, nulls first, then by role and text. Each row's first fault
    counts: blank (no character but white space), duplicate (role and text stood earlier), truncated (its
    last such character isn't one of .!?). Null roles and texts are one space; a null conv_id is one
    conversation. Repeated rows are duplicates. Rows for which `there` is false only name their conversation,
    which without any other row has zeros, an empty audit and the hash of an empty text. Other columns are
    not read. A conversation's rows pass one task, as their hash does, in segments.
    """
    ship(rows.sparkSession)
    held = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
        (F.lit(True) if there is None else there).alias("there"),
    )
    said = F.rtrim("text", F.lit(WHITE))
    held = held.withColumn("blank", said == "").withColumn("cut", ~F.right(said, F.lit(1)).isin(".", "!", "?"))
    # by conversation once; the rows of one role and text are together inside it
    first = Window.partitionBy("conv_id", "there", "role", "text").orderBy(F.asc_nulls_first("turn"))
    held = held.repartition("conv_id").withColumn("seen", F.row_number().over(first) > 1)
    sort = ("conv_id", F.asc_nulls_first("turn"), "role", "text", "seen")
    held = held.sortWithinPartitions(*sort).select("conv_id", "turn", "role", "text", "there", "blank", "seen", "cut")
    return held.mapInArrow(_repair(segment), REPORT)


def damage(rows: DataFrame) -> DataFrame:
    """rows with `there`, dropped, emptied, cut, repeated and given another role by the CRC-32 of conv_id:turn; nulls are one space."""
    space = F.lit(" ")
    rows = rows.select(
        "conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), space).alias(c) for c in ("role", "text")),
        (F.crc32(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")))) % 20).alias("_kind"),
    )
    kind = F.col("_kind")
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (kind != 0).alias("there"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    )
    return rows.drop("_copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damage(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return repair(rows, F.col("there"))
