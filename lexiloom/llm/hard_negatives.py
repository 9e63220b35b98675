"""Hard-negative mining with exact scores by the method of the Four Russians.

A vector's components are whole numbers (``floor(scale * x)``). The components
of a candidate are kept as bit planes in two's complement: plane k holds bit k
of all components, eight dimensions to a byte. For a block of anchors the sums
of every subset of eight components are tabled (256 rows for each group of eight
dimensions, one column for each anchor). A candidate's byte is then the row
number of its subset, and a score is the sum of the rows found, doubled from
plane to plane; the top plane counts negative. Scores are whole and exact.

Two passes over the stored planes: the anchors of a label against the rows of
that label for the positives, then against the rows of all other labels, whose
scores between the bounds that each positive sets are its negatives. A task
sends on only the best few for each anchor, so what is shuffled is that times
the number of tasks. Anchors come in shards of ``shard_mb`` at most, by hash:
one shard is broadcast at a time, and its results are written before the next
is read, so neither the driver nor a task holds more whatever the table's size.
Rows are dealt by all their columns, so a label or vector that a third of the
rows have stays spread.

Defined results: rows with a null label, a null vector or a null or non-finite
component take no part; equal rows are one row; a row with the anchor's
``vec_id`` is never its positive or negative; rows that differ but share an id
are rows of their own, and such anchors are mined one by one; equal scores go by
``vec_id`` (null last), then label, then planes; vectors of different lengths
are multiplied over the dimensions both have, an empty one scores 0; integers
saturate at 2^53 either way, and scores are exact while they fit 64 bits (they
wrap beyond). Empty tables give empty results. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

GROUP = 8
_PLANES = "vec_id long, label long, bits int, planes binary"
#: Anchors whose tables are held at a time, and candidates scored at a time.
_ANCHORS, _ROWS = 64, 8192


def bit_planes(whole: np.ndarray) -> np.ndarray:
    """``(rows, bits, groups)`` bytes of whole numbers ``(rows, dimensions)``, the top plane being the sign."""
    n, dims = whole.shape
    bits = max(int(whole.max(initial=0)), int((~whole).max(initial=0))).bit_length() + 1
    padded = np.zeros((n, -(-dims // GROUP) * GROUP), np.int64)
    padded[:, :dims] = whole
    each = np.empty((n, bits, padded.shape[1]), np.uint8)
    for k in range(bits):
        each[:, k] = padded >> k & 1
    return np.packbits(each, axis=2, bitorder="little")


def numbers(planes: np.ndarray) -> np.ndarray:
    """The whole numbers of bit planes."""
    n, bits, groups = planes.shape
    out = np.zeros((n, groups * GROUP), np.int64)
    each = np.unpackbits(planes, axis=2, bitorder="little")
    for k in range(bits):
        out += (each[:, k].astype(np.int64) << k) * (-1 if k == bits - 1 else 1)
    return out


def stacked(bits: list[int], planes: list[bytes]) -> np.ndarray:
    """Planes of rows as one array: shorter numbers repeat their sign, shorter vectors end in zeros."""
    groups = [len(p) // b for b, p in zip(bits, planes)]
    deep, wide = max(bits, default=1), max(groups, default=0)
    if set(bits) == {deep} and set(groups) == {wide}:
        return np.frombuffer(b"".join(planes), np.uint8).reshape(len(planes), deep, wide)
    out = np.zeros((len(planes), deep, wide), np.uint8)
    for i, (b, g, p) in enumerate(zip(bits, groups, planes)):
        own = np.frombuffer(p, np.uint8).reshape(b, g)
        out[i, :b, :g] = own
        out[i, b:, :g] = own[-1]
    return out


def subset_tables(anchors: np.ndarray, kind: type) -> np.ndarray:
    """``(groups, 256, anchors)``: for each eight dimensions the sum of every subset of an anchor's components."""
    count, dims = anchors.shape
    groups = dims // GROUP
    by_group = anchors.T.reshape(groups, GROUP, count).astype(kind)
    tables = np.zeros((groups, 1 << GROUP, count), kind)
    for i in range(GROUP):
        tables[:, 1 << i:2 << i] = tables[:, :1 << i] + by_group[:, i, None]
    return tables


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """``(rows, anchors)`` inner products: rows of the tables by plane byte, shifted and added."""
    n, bits, groups = planes.shape
    groups = min(groups, len(tables))
    total = np.zeros((n, tables.shape[2]), tables.dtype)
    part = np.empty((min(n, 1024), tables.shape[2]), tables.dtype)
    for at in range(0, n, 1024):
        sums, own = total[at:at + 1024], planes[at:at + 1024]
        found = part[:len(own)]
        for k in range(bits - 1, -1, -1):
            np.left_shift(sums, 1, out=sums)
            for g in range(groups):
                np.take(tables[g], own[:, k, g], axis=0, out=found, mode="clip")
                (np.subtract if k == bits - 1 else np.add)(sums, found, out=sums)
    return total


def _number_type(anchors: np.ndarray, planes: np.ndarray) -> type:
    """32 bits where no score can leave them."""
    most = int(np.abs(anchors).max(initial=0)) * anchors.shape[1] << (planes.shape[1] - 1)
    return np.int32 if most < 2**31 else np.int64


def _in_order(found: np.ndarray, first: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor the scores from the highest on, equal ones by row number, and the row numbers; the ``first`` only."""
    n = len(found)
    keep = n if first is None else min(first, n)
    shift = max(1, (n - 1).bit_length())
    if found.dtype == np.int32:  # score and row number fit one number
        keys = (~found.astype(np.int64) << shift) | np.arange(n)[:, None]
        if keep < n:
            keys = np.partition(keys, keep - 1, axis=0)[:keep]
        keys = np.sort(keys, axis=0)
        return ~(keys >> shift), keys & ((1 << shift) - 1)
    rows = np.argsort(~found, axis=0, kind="stable")[:keep]
    return np.take_along_axis(found, rows, axis=0), rows


def prepared(rows: DataFrame, scale: int = 256) -> DataFrame:
    """The rows that take part, as bit planes: ``vec_id, label, bits, planes``, from ``vec_id, label, vector``."""
    bound = 2.0**53

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(2)
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls are not-a-number
            sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes)
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
            sound = bad[ends] == bad[ends - sizes]
            with np.errstate(invalid="ignore", over="ignore"):
                whole = np.clip(np.floor(scale * flat), -bound, bound)
            for size in np.unique(sizes[sound]).tolist():
                own = np.flatnonzero(sound & (sizes == size))
                for at in range(0, len(own), _ROWS):
                    part = own[at:at + _ROWS]
                    planes = bit_planes(whole[(ends - sizes)[part, None] + np.arange(size)].astype(np.int64))
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).take(pa.array(part)), batch.column(1).take(pa.array(part)),
                        pa.array(np.full(len(part), planes.shape[1], np.int32)), pa.array([p.tobytes() for p in planes], pa.binary()),
                    ], ["vec_id", "label", "bits", "planes"])

    own = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "vector").where("label IS NOT NULL AND vector IS NOT NULL")
    # what follows costs by rows, not by bytes: a block of rows to a partition
    once = own.repartition(max(1, math.ceil(own.count() / _ROWS)), "vec_id", "label", "vector").dropDuplicates()
    return once.mapInArrow(read, _PLANES)


class _Rows:
    """Rows of a task, sorted by label, then id, then planes; the rows of one label are a slice."""

    def __init__(self, table: pa.Table):
        if len(table):
            table = table.sort_by([("label", "ascending"), ("vec_id", "ascending"), ("planes", "ascending")])
        self.ids = table.column("vec_id").combine_chunks()
        self.known = self.ids.is_valid().to_numpy(zero_copy_only=False)
        self.id_numbers = self.ids.fill_null(0).to_numpy()
        self.labels = table.column("label").to_numpy()
        self.planes = stacked(table.column("bits").to_pylist(), table.column("planes").to_pylist())

    def of(self, label: int, same: bool) -> np.ndarray:
        """Row numbers of a label, or of all others by id."""
        low, high = np.searchsorted(self.labels, [label, label + 1])
        if same:
            return np.arange(low, high)
        rest = np.concatenate((np.arange(low), np.arange(high, len(self.labels))))
        return rest[np.lexsort((self.labels[rest], self.id_numbers[rest], ~self.known[rest]))]

    def is_id(self, rows: np.ndarray, vec_id: int | None) -> np.ndarray:
        return ~self.known[rows] if vec_id is None else self.known[rows] & (self.id_numbers[rows] == vec_id)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Rows]:
    """A task's rows in blocks of ``_ROWS`` at most."""
    held, n = [], 0
    for batch in batches:
        for at in range(0, len(batch), _ROWS):
            part = batch.slice(at, _ROWS)
            if n and n + len(part) > _ROWS:
                yield _Rows(pa.Table.from_batches(held))
                held, n = [], 0
            held.append(part)
            n += len(part)
    if n:
        yield _Rows(pa.Table.from_batches(held))


class _Shard:
    """A shard of anchors, by label: numbers, ids, labels and whole components."""

    def __init__(self, rows: list):
        rows = sorted(rows, key=lambda r: r["label"])
        self.ids = [r["vec_id"] for r in rows]
        self.labels = [r["label"] for r in rows]
        self.planes = stacked([r["bits"] for r in rows], [r["planes"] for r in rows])

    def groups(self) -> Iterator[tuple[int, range]]:
        """Anchors of one label, a few at a time."""
        bounds = [i for i in range(len(self.labels)) if not i or self.labels[i] != self.labels[i - 1]] + [len(self.labels)]
        for low, high in zip(bounds, bounds[1:]):
            for at in range(low, high, _ANCHORS):
                yield self.labels[low], range(at, min(at + _ANCHORS, high))

    def score(self, own: range, planes: np.ndarray) -> np.ndarray:
        anchors = numbers(self.planes[own.start:own.stop])
        return scores(subset_tables(anchors, _number_type(anchors, planes)), planes)


_FOUND = "anchor int, slot int, vec_id long, score long"
_FOUND_SHAPE = pa.schema([("anchor", pa.int32()), ("slot", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])


class _Found:
    """Rows found for the anchors of a group."""

    def __init__(self):
        self.parts: list[tuple[int, int, np.ndarray, np.ndarray]] = []

    def add(self, anchor: int, slot: int, rows: np.ndarray, scored: np.ndarray) -> None:
        if len(rows):
            self.parts.append((anchor, slot, rows, scored))

    def batches(self, block: _Rows) -> Iterator[pa.RecordBatch]:
        if self.parts:
            anchors, slots, rows, scored = zip(*self.parts)
            sizes = [len(r) for r in rows]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(np.array(anchors, np.int32), sizes)), pa.array(np.repeat(np.array(slots, np.int32), sizes)),
                block.ids.take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(scored).astype(np.int64)),
            ], schema=_FOUND_SHAPE)


def _positives(stored: DataFrame, shard, count: int) -> DataFrame:
    """The best rows of the same label for each anchor, by task."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = shard.value
        for block in _blocks(batches):
            for label, own in anchors.groups():
                rows = block.of(label, same=True)
                if not len(rows):
                    continue
                # an anchor's own row may be among the first: one more for each row of its id
                mine = [block.is_id(rows, anchors.ids[a]) for a in own]
                best, at = _in_order(anchors.score(own, block.planes[rows]), count + max(int(m.sum()) for m in mine))
                out = _Found()
                for i, a in enumerate(own):
                    others = np.flatnonzero(~mine[i][at[:, i]])[:count]
                    out.add(a, 0, rows[at[others, i]], best[others, i])
                yield from out.batches(block)

    return stored.mapInArrow(find, _FOUND)


def _negatives(stored: DataFrame, shard, ranges, count: int) -> DataFrame:
    """The best rows of other labels between each positive's bounds, by task; ``ranges``: anchor to (slot, least, most)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, bounds = shard.value, ranges.value
        for block in _blocks(batches):
            for label, own in anchors.groups():
                rows = block.of(label, same=False)
                if not len(rows) or not any(a in bounds for a in own):
                    continue
                best, at = _in_order(anchors.score(own, block.planes[rows]))
                out = _Found()
                for i, a in enumerate(own):
                    falling = ~best[:, i]  # ascending, and no number overflows
                    for slot, lowest, highest in bounds.get(a, ()):
                        low, high = int(np.searchsorted(falling, ~highest, "left")), int(np.searchsorted(falling, ~lowest, "right"))
                        taken = 0
                        while low < high and taken < count:  # rows of the anchor's own id are passed over
                            some = at[low:min(high, low + count - taken), i]
                            fit = ~block.is_id(rows[some], anchors.ids[a])
                            out.add(a, slot, rows[some[fit]], best[low:low + len(some), i][fit])
                            low, taken = low + len(some), taken + int(fit.sum())
                yield from out.batches(block)

    return stored.mapInArrow(find, _FOUND)


def _first(found: DataFrame, count: int) -> DataFrame:
    """The first ``count`` of each anchor and slot over all tasks, with their rank."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def mine(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, scale: int = 256, shard_mb: int = 16,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``, from rows ``vec_id, label, vector``.

    ``is_anchor`` selects the anchors by ``vec_id`` and ``label``. A negative's
    score is ``least`` to ``most`` hundredths of the positive's score.
    """
    spark = rows.sparkSession
    stored = materialize(prepared(rows, scale), "negatives-planes")
    chosen = stored.where(is_anchor)
    size = chosen.agg(F.sum(F.length("planes") + 24)).first()[0] or 0
    shards = max(1, math.ceil(size / (shard_mb * 1_000_000)))
    done = []
    for number in range(shards):
        part = chosen.where(F.pmod(F.xxhash64("vec_id", "label", "planes"), F.lit(shards)) == number).collect()  # shard_mb at most, give or take the hash
        shard = spark.sparkContext.broadcast(_Shard(part))
        best = materialize(_first(_positives(stored, shard, positives), positives), "negatives-positives")
        bounds: dict[int, list[tuple[int, int, int]]] = {}
        for r in best.collect():  # ``positives`` numbers for each anchor of the shard
            bounds.setdefault(r["anchor"], []).append((r["rank"], -(-least * r["score"] // 100), most * r["score"] // 100))
        found = _first(_negatives(stored, shard, spark.sparkContext.broadcast(bounds), negatives), negatives)
        ids = spark.createDataFrame([(i, x) for i, x in enumerate(shard.value.ids)], "anchor int, anchor_id long")
        pairs = best.join(F.broadcast(ids), "anchor").select("anchor", "anchor_id", F.col("rank").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        done.append(materialize(found.join(F.broadcast(pairs), ["anchor", "slot"]).select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
        ), "negatives-found"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
