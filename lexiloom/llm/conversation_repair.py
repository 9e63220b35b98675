"""Repair of conversation structure by generalised LR parsing with edits.

Roles must read ``(s?(ua)+)?`` by their first letters. The grammar

    S -> (nothing) | B      B -> O u a | B u a      O -> (nothing) | s

has five stacks between two symbols, each known by its top. A conversation's rows
are read in order; all stacks that edits can lead to are advanced together, and
stacks with equal tops become one, which keeps the least (cost, audit):

- K keep (0), R rerole to user or assistant (1), D delete (2; the only edit of a
  blank or repeated row), I insert an empty user or assistant turn anywhere (5);
- a truncated row that is not deleted costs 5 more.

The audit is the edits' letters in order. Letters fix the cost, so two audits of
one cost over the same rows are never one the beginning of the other, and the
least of two stays the least whatever follows. The frozen part of an audit is a
chain of chunks with a rank among the five, so a step takes constant time. Each
stack carries the running SHA-256 of its repaired lines.

Whether a row was seen earlier is found by a count of (conversation, role, text
digest) and a join, so no task holds a set of a conversation's texts. The rows
then go to their conversation's task in order, as a stream: a task holds one
batch and five stacks, whose audits are as long as the result's own. The digest
of a conversation is one sequential hash, so its rows must pass one task.

Defined results: a null role or text is one space, which is no role of the
grammar and a blank text; null turns come first, rows of one turn in the order of
role, then text; a null ``conv_id`` is a conversation of its own; equal rows are
duplicates of the first; an empty role can't be kept; texts of any length are
read whole; a conversation without rows has zeros, an empty audit and the hash of
nothing; an empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

BLANKS = " \t\n\x0b\x0c\r"
ENDINGS = frozenset(".!?")
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
ROLES = {"u": "user", "a": "assistant"}
LEGAL = frozenset({"su", "ua", "au"})
_FREEZE = 256

# The LR table. States: 0 start, 1 after O, 2 after B, 3 after O u, 4 after B u, 5 to 7 complete productions.
_SHIFT = {(0, "s"): 5, (1, "u"): 3, (2, "u"): 4, (3, "a"): 6, (4, "a"): 7}
_REDUCE = {5: ("O", 1), 6: ("B", 3), 7: ("B", 3)}
_GOTO = {(0, "O"): 1, (0, "B"): 2}
_ACCEPT = (0, 2)


@functools.cache
def advance(stack: tuple[int, ...], symbol: str) -> tuple[int, ...] | None:
    """The stack after a symbol and all reductions that need no more; None where the grammar has no move."""
    if stack[-1] == 0 and symbol == "u":  # O -> (nothing)
        stack += (_GOTO[0, "O"],)
    to = _SHIFT.get((stack[-1], symbol))
    if to is None:
        return None
    stack += (to,)
    while stack[-1] in _REDUCE:
        name, size = _REDUCE[stack[-1]]
        stack = stack[:-size]
        stack += (_GOTO[stack[-1], name],)
    return stack


class Repair:
    """The stacks of one conversation, by their tops: cost, rank and tail of the audit, its frozen part, digest, stack."""

    def __init__(self):
        self.tops = self._with_inserts({0: (0, 0, "", None, hashlib.sha256(), 0, (), (0,))})
        self.rows = 0

    @staticmethod
    def _with_inserts(tops: dict) -> dict:
        """Inserts from every stack, then the digests of what is left; an entry's last but one field holds the lines to add."""
        fresh = list(tops.values())
        while fresh:
            found = []
            for cost, rank, tail, link, digest, lines, more, stack in fresh:
                for letter, role in ROLES.items():
                    to = advance(stack, letter)
                    if to is not None:
                        entry = (cost + INSERT, rank, tail + "I", link, digest, lines, (*more, (role, "")), to)
                        if to[-1] not in tops or entry[:3] < tops[to[-1]][:3]:
                            tops[to[-1]] = entry
                            found.append(entry)
            fresh = found
        for top, (cost, rank, tail, link, digest, lines, more, stack) in tops.items():
            if more:
                digest = digest.copy()
                for role, text in more:
                    digest.update((f"\n{role}:{text}" if lines else f"{role}:{text}").encode("utf-8", "replace"))
                    lines += 1
                tops[top] = (cost, rank, tail, link, digest, lines, (), stack)
        return tops

    def read(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        """Advance all stacks over one row."""
        tops: dict[int, tuple] = {}
        extra, letter = TRUNCATED if truncated else 0, role[:1]
        for cost, rank, tail, link, digest, lines, _, stack in self.tops.values():
            moves = [(cost + DELETE, "D", stack, ())]
            if not must_go:
                moves.append((cost + KEEP + extra, "K", advance(stack, letter), ((role, text),)))
                moves += [(cost + REROLE + extra, "R", advance(stack, to), ((name, text),)) for to, name in ROLES.items()]
            for total, edit, to, more in moves:
                if to is not None:
                    entry = (total, rank, tail + edit, link, digest, lines, more, to)
                    if to[-1] not in tops or entry[:3] < tops[to[-1]][:3]:
                        tops[to[-1]] = entry
        self.tops = self._with_inserts(tops)
        self.rows += 1
        if self.rows % _FREEZE == 0:
            self._freeze()

    def _freeze(self) -> None:
        """Chain up the audits to the last row; what was inserted after it stays open, as it may be cut by a smaller letter."""
        shut = {top: (p[1], p[2].rstrip("I")) for top, p in self.tops.items()}
        ranks = {key: i for i, key in enumerate(sorted(set(shut.values())))}
        for top, (cost, _, tail, link, *rest) in self.tops.items():
            chunk = shut[top][1]
            self.tops[top] = (cost, ranks[shut[top]], tail[len(chunk):], (link, chunk), *rest)

    def result(self) -> tuple[int, str, str]:
        """Cost, audit and digest of the cheapest repair."""
        cost, _, tail, link, digest, *_ = min((self.tops[t] for t in _ACCEPT if t in self.tops), key=lambda p: p[:3])
        chunks = [tail]
        while link is not None:
            link, chunk = link
            chunks.append(chunk)
        return cost, "".join(reversed(chunks)), digest.hexdigest()


class Conversation:
    """Counts and stacks of one conversation, fed row by row in order."""

    def __init__(self):
        self.repair = Repair()
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.first = self.turn = self.before = None

    def read(self, turn: int | None, role: str, text: str, later: bool) -> None:
        ending = text.rstrip(BLANKS)[-1:]
        again = later or self.before == (turn, role, text)  # equal rows of one turn stand next to each other
        blank, duplicate = not ending, bool(ending) and again
        truncated = bool(ending) and not again and ending not in ENDINGS
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        if self.before is not None and self.before[1][:1] + role[:1] not in LEGAL:
            self.illegal += 1
        if turn is not None:
            if self.turn is None:
                self.first = turn
            self.distinct += self.turn != turn
            self.turn = turn
        self.before = (turn, role, text)
        self.repair.read(role, text, blank or duplicate, truncated)

    def gaps(self) -> int:
        return 0 if self.turn is None else self.turn - self.first + 1 - self.distinct


def _ordered(turns: DataFrame, present: Column) -> DataFrame:
    """The rows of each conversation in one task and in order, with ``present`` and ``later``: the same role and text stand at an earlier turn."""
    own = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text"), F.lit(" ")).alias("text"), F.coalesce(present, F.lit(False)).alias("present"),
    )
    digest = F.unhex(F.sha2("text", 256))
    # nulls come first, so the first turn is null if any is
    known = own.where("present").groupBy(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), digest.alias("_d")).agg(
        F.count("*").alias("n"), F.min("turn").alias("least"), F.count("turn").alias("turns"),
    ).where("n > 1").select("_c", "_r", "_d", F.when(F.col("n") == F.col("turns"), F.col("least")).alias("_least"), F.lit(True).alias("_again"))
    seen = own.join(known, F.col("present") & own["conv_id"].eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (digest == F.col("_d")), "left")
    later = F.col("_again") & F.col("turn").isNotNull() & (F.col("_least").isNull() | (F.col("turn") > F.col("_least")))
    rows = seen.select("conv_id", "turn", "role", "text", "present", F.coalesce(later, F.lit(False)).alias("later"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "present", F.col("turn").asc_nulls_first(), "role", "text")


def repairs(turns: DataFrame, present: Column | None = None) -> DataFrame:
    """Per conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    From rows ``conv_id, turn, role, text``. Rows for which ``present`` is not
    true only name their conversation.
    """
    ordered = _ordered(turns, F.lit(True) if present is None else present)
    kind = ordered.schema["conv_id"].dataType
    shape = pa.schema([("conv_id", to_arrow_type(kind)), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        now, key, size = None, None, 0

        def close() -> None:
            nonlocal size
            cost, audit, digest = now.repair.result()
            done.append((key, now.gaps(), now.blank, now.duplicate, now.truncated, now.illegal, cost, audit, digest))
            size += len(audit) + 100

        for batch in batches:
            for conv, turn, role, text, there, later in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or conv != key:
                    if now is not None:
                        close()
                    now, key = Conversation(), conv
                if there:
                    now.read(turn, role, text, later)
                if size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), shape)], schema=shape)
                    done, size = [], 0
        if now is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), shape)], schema=shape)

    return ordered.mapInArrow(parse, f"conv_id {kind.simpleString()}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def repaired(turns: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired conversations as rows ``conv_id, place, turn, role, text, edit``, from the rows and their ``repairs``.

    ``place`` counts from 0; inserted rows have a null turn and an empty text. A
    conversation's audit goes before its rows into the same stream.
    """
    kind = turns.schema["conv_id"].dataType
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit(" ")).alias("role"), F.coalesce(F.col("text"), F.lit(" ")).alias("text"), F.lit(None).cast("string").alias("audit"))
    heads = found.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), "audit")
    both = heads.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").desc_nulls_last(), F.col("turn").asc_nulls_first(), "role", "text")
    shape = pa.schema([("conv_id", to_arrow_type(kind)), ("place", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, place, stack, key = "", 0, 0, (0,), None
        for batch in batches:
            out: list[tuple] = []

            def write(turn, role, text, edit):
                nonlocal place, stack, at
                if edit in "RI":  # the only of the two roles that the grammar takes here
                    role = ROLES["u"] if advance(stack, "u") is not None else ROLES["a"]
                stack = advance(stack, role[:1])
                out.append((key, place, turn, role, text, edit))
                place += 1
                at += 1

            def inserts():
                while at < len(audit) and audit[at] == "I":
                    write(None, "", "", "I")

            for conv, turn, role, text, head in zip(*(c.to_pylist() for c in batch.columns)):
                if head is not None:
                    key, audit, at, place, stack = conv, head, 0, 0, (0,)
                    inserts()
                    continue
                if audit[at] == "D":
                    at += 1
                else:
                    write(turn, role, text, audit[at])
                inserts()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), shape)], schema=shape)

    return both.mapInArrow(apply, f"conv_id {kind.simpleString()}, place long, turn long, role string, text string, edit string")


def damaged(turns: DataFrame) -> DataFrame:
    """Rows damaged by the CRC of ``conv_id:turn``, modulo 20, with ``present``.

    0 drops the row, 1 empties its text, 2 takes its ``[.!?]`` away, 3 repeats it, 4 makes its role user.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    way = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(way == 1, "").when(way == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    copies = F.sequence(F.lit(1), F.when(way == 3, 2).otherwise(1))
    out = turns.select("conv_id", "turn", F.when(way == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"), (way != 0).alias("present"), copies.alias("copies"))
    return out.withColumn("copy", F.explode("copies")).drop("copies", "copy")
