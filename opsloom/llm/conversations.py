"""Conversation repair: two secondary-sorted streams, the first writes backpointers, the second follows them."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_arrow, stored

BLANKS = r"\x20\x09-\x0D"
#: Costs of the edits, fixed values.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows of a conversation whose backpointers make one stored row.
CHUNK = 1 << 16

# What has been put out so far: nothing, a system row, a user row last, an assistant row last. Nothing and the last may end.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: Role initial -> the states it may follow and the state after it.
FOLLOWS = {"s": ((EMPTY,), SYSTEM), "u": ((EMPTY, SYSTEM, ASSISTANT), USER), "a": ((USER,), ASSISTANT)}
#: For each state, the insertions that can be useful there: how many, and the state after them.
INSERTS = {EMPTY: ((0, EMPTY), (1, USER), (2, ASSISTANT)), SYSTEM: ((0, SYSTEM), (1, USER), (2, ASSISTANT)), USER: ((0, USER), (1, ASSISTANT)),
           ASSISTANT: ((0, ASSISTANT), (1, USER))}
KEEP, REROLE_OP, DELETE_OP = 0, 1, 2
LETTERS = "KRD"
#: What to insert at the end.
ENDING = {EMPTY: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}


def _moves(initial: str, must_go: bool):
    """For each state: (edit letters, cost, insertions, edit, next state), for one kind of row."""
    out = []
    for state in range(4):
        found = []
        for n, at in INSERTS[state]:
            found.append(("I" * n + "D", n * INSERT + DELETE, n, DELETE_OP, at))
            if must_go:
                continue
            for role, (before, after) in FOLLOWS.items():
                if at in before:
                    if role == initial:
                        found.append(("I" * n + "K", n * INSERT, n, KEEP, after))
                    if role != "s":
                        found.append(("I" * n + "R", n * INSERT + REROLE, n, REROLE_OP, after))
        out.append(found)
    return out


MOVES = {(r, g): _moves(r, g) for r in ("s", "u", "a", "") for g in (False, True)}
_steps: dict[tuple, tuple] = {}


def _step(kind: tuple, state: tuple) -> tuple:
    """From the least costs and order of the endings after a row to those before it, and the row's backpointers.

    ``state`` holds for each state the cost above the least one and the rank of the best ending among the four.
    Of equal costs the ending least in ASCII is kept: two edit strings of one row are equal or differ
    within the shorter, so the letters and then the ranks of the endings decide.
    """
    key = (kind, state)
    known = _steps.get(key)
    if known is None:
        initial, must_go, extra = kind
        costs, ranks = state[:4], state[4:]
        best = []
        for found in MOVES[initial, must_go]:
            best.append(min((cost + (0 if op == DELETE_OP else extra) + costs[to], letters, ranks[to], n, op, to) for letters, cost, n, op, to in found))
        order = {e: i for i, e in enumerate(sorted({(b[1], b[2]) for b in best}))}
        least = min(b[0] for b in best)
        packed = 0
        for s, b in enumerate(best):
            packed |= (b[3] | b[4] << 2 | b[5] << 4) << (6 * s)
        known = (tuple(b[0] - least for b in best) + tuple(order[b[1], b[2]] for b in best), least, packed)
        _steps[key] = known
    return known


_LAST = tuple(ENDING[s] * INSERT for s in range(4)) + tuple(sorted({"I" * ENDING[s] for s in range(4)}).index("I" * ENDING[s]) for s in range(4))


class Backward:
    """One conversation, read from its last row to its first."""

    def __init__(self, conv) -> None:
        self.conv, self.state, self.base = conv, _LAST, 0
        self.rows = self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.low = self.high = self.later = None
        self.pointers: list[int] = []
        self.parts = 0

    def add(self, turn, initial: str, fault: int) -> None:
        self.state, least, packed = _step((initial if initial in ("s", "u", "a") else "", fault in (1, 2), TRUNCATED if fault == 3 else 0), self.state)
        self.base += least
        self.pointers.append(packed)
        self.blank, self.duplicate, self.truncated = self.blank + (fault == 1), self.duplicate + (fault == 2), self.truncated + (fault == 3)
        self.illegal += self.later is not None and initial + self.later not in ("su", "ua", "au")
        self.later = initial
        if turn is not None:
            self.distinct += turn != self.low
            self.low, self.high = turn, turn if self.high is None else self.high
        self.rows += 1


_CHUNKS = pa.schema([("conv", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("digest", pa.binary()), ("part", pa.int64()), ("pointers", pa.binary()), ("summary", pa.list_(pa.int64()))])


def _backward(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Backpointers of ``size`` rows at a time, keyed by the row they begin at in order of turns, and a last row
    per conversation with what was counted."""
    now: Backward | None = None
    out: list[tuple] = []

    def chunk(turn, role, digest):
        # Parts count down, so that in rising order of rows they rise.
        now.parts -= 1
        out.append((now.conv, turn, role, digest, now.parts, np.array(now.pointers[::-1], "<u4").tobytes(), None))
        now.pointers = []

    def close(last):
        if now is not None:
            if now.pointers:
                chunk(*last)
            gaps = 0 if now.low is None else now.high - now.low + 1 - now.distinct
            out.append((now.conv, None, None, None, None, None, [gaps, now.blank, now.duplicate, now.truncated, now.illegal, now.base + now.state[EMPTY]]))

    def flush():
        rows = list(zip(*out)) if out else [[]] * len(_CHUNKS)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _CHUNKS)], schema=_CHUNKS)

    last = None
    for batch in batches:
        for conv, turn, role, digest, fault, there in zip(*[batch.column(c).to_pylist() for c in ("conv", "turn", "role", "digest", "fault", "there")]):
            if now is None or conv != now.conv:
                close(last)
                now = Backward(conv)
            if there:
                now.add(turn, role[:1], fault)
                last = (turn, role, digest)
                if len(now.pointers) == size:
                    chunk(turn, role, digest)
        yield flush()
    close(last)
    yield flush()


class Forward:
    """One conversation, read from its first row to its last, with the backpointers in front of their rows."""

    def __init__(self, conv) -> None:
        self.conv, self.state, self.counts, self.chunks, self.at = conv, EMPTY, None, [], 0
        self.letters: list[str] = []
        self.hash, self.first = hashlib.sha256(), True

    def put(self, role: str, text: str) -> None:
        self.hash.update((("" if self.first else "\n") + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.first = False

    def insert(self, n: int) -> None:
        for _ in range(n):
            self.state = ASSISTANT if self.state == USER else USER
            self.put("assistant" if self.state == ASSISTANT else "user", "")
        self.letters.append("I" * n)

    def add(self, role: str, text: str) -> None:
        if self.at == len(self.chunks[0]):
            del self.chunks[0]
            self.at = 0
        move = int(self.chunks[0][self.at]) >> (6 * self.state)
        self.at += 1
        self.insert(move & 3)
        op, self.state = move >> 2 & 3, move >> 4 & 3
        if op != DELETE_OP:
            self.put(role if op == KEEP else "assistant" if self.state == ASSISTANT else "user", text)
        self.letters.append(LETTERS[op])
        if len(self.letters) > CHUNK:
            self.letters = ["".join(self.letters)]

    def row(self) -> tuple:
        self.insert(ENDING[self.state])
        return (self.conv, *self.counts, "".join(self.letters), self.hash.hexdigest())


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_REPAIRED = pa.schema([("conv", pa.int64()), *[(c, pa.int64()) for c in COUNTS], ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: Forward | None = None
    for batch in batches:
        out = []
        for conv, role, text, pointers, summary in zip(*[batch.column(c).to_pylist() for c in ("conv", "role", "text", "pointers", "summary")]):
            if now is None or conv != now.conv:
                if now is not None:
                    out.append(now.row())
                now = Forward(conv)
            if summary is not None:
                now.counts = summary
            elif pointers is not None:
                now.chunks.append(np.frombuffer(pointers, "<u4"))
            else:
                now.add(role, text)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _REPAIRED)], schema=_REPAIRED)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(now.row(), _REPAIRED)], schema=_REPAIRED)


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The given rows with faults set by ``crc32(conv:turn) % 20``: 0 drops the row (``there`` false), 1 empties its
    text, 2 takes out its ``[.!?]``, 3 repeats it, 4 makes it the user's. Nulls are one blank there, and as role and text."""
    kind = F.crc32(F.concat(F.coalesce(F.col(f"`{conv}`").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col(f"`{turn}`").cast("string"), F.lit(" ")))) % 20
    given = rows.select(F.col(f"`{conv}`").cast("long").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"),
                        F.coalesce(F.col(f"`{role}`"), F.lit(" ")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit(" ")).alias("text"), kind.alias("kind"))
    hurt = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return given.select("conv", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), hurt.alias("text"),
                        (F.col("kind") != 0).alias("there"), F.explode(copies).alias("copy")).drop("copy")


def faults(text: Column) -> Column:
    """1 for a blank text, 3 for one whose last character that is no blank is not ``.``, ``!`` or ``?``, else 0."""
    return F.when(~F.regexp_like(text, F.lit(f"[^{BLANKS}]")), F.lit(1)).when(~F.regexp_like(text, F.lit(rf"[.!?][{BLANKS}]*\z")), F.lit(3)).otherwise(F.lit(0))


def repair(rows: DataFrame, conv: str = "conv_id", chunk: int = CHUNK) -> DataFrame:
    """One row per conversation: counts of faults, the least cost of the edits that repair it, their initials
    (``audit``) and the SHA-256 of the repaired rows (``role:text``, joined by line breaks).

    ``rows`` has ``conv``, ``turn``, ``role``, ``text`` and ``there``; a row that is not there only makes its
    conversation appear. A null conversation id is one conversation. Rows are taken by turn, null first, equal turns by role and the
    text's SHA-256; equal rows are told apart by nothing and by nobody. A row that repeats the role and text of an
    earlier row is a duplicate. Roles other than system, user and assistant count by their first letter, an empty one has none.
    Conversations without a row have zeros, an empty audit and the hash of an empty text.

    Rows are dealt by conversation and sorted by falling turn. Each task streams them through the dynamic programme
    over the four states of ``(s?(ua)+)?``, holding costs and the order of the best endings, never the rows; backpointers
    (four bytes a row) are put out ``chunk`` rows at a time as stored rows. A second stream in rising order meets them
    in front of the rows they belong to and hashes texts as they pass. A conversation of any length takes the memory of a few chunks.
    """
    keyed = rows.select("conv", "turn", "role", "text", "there", F.unhex(F.sha2("text", 256)).alias("digest"))
    narrow = keyed.select("conv", "turn", "role", "digest", "there", faults(F.col("text")).alias("fault"))
    dealt = narrow.repartition("conv")
    seen = F.row_number().over(Window.partitionBy("conv", "role", "digest", "there").orderBy(F.col("turn").asc_nulls_first())) > 1
    marked = dealt.withColumn("fault", F.when((F.col("fault") != 1) & F.col("there") & seen, F.lit(2)).otherwise(F.col("fault")))
    down = marked.sortWithinPartitions(F.col("conv").asc_nulls_first(), F.col("turn").desc_nulls_last(), F.col("role").desc(), F.col("digest").desc(), (F.col("fault") == 2).desc())
    chunks = stored(in_arrow(down, partial(_backward, size=chunk), "conv long, turn long, role string, digest binary, part long, pointers binary, summary array<long>"), "pointers")
    # The summary leads, backpointers come before their first row, rows follow.
    kind = F.when(F.col("summary").isNotNull(), F.lit(0)).when(F.col("pointers").isNotNull(), F.lit(1)).otherwise(F.lit(2))
    texts = keyed.filter("there").select("conv", "turn", "role", "digest", "text", F.lit(None).cast("long").alias("part"), F.lit(None).cast("binary").alias("pointers"), F.lit(None).cast("array<long>").alias("summary"))
    met = texts.unionByName(chunks.withColumn("text", F.lit(None).cast("string"))).withColumn("kind", kind)
    up = met.repartition("conv").sortWithinPartitions(
        F.col("conv").asc_nulls_first(), (F.col("kind") > 0), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("digest").asc_nulls_first(), "kind", "part")
    made = in_arrow(up.select("conv", "role", "text", "pointers", "summary"), _forward, "conv long, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string")
    return made.withColumnRenamed("conv", conv)
