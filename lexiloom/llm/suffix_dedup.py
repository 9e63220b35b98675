"""Suffix-array dedup by column-wise construction over a collection of pieces.

A byte goes if a ``window``-byte string that covers it starts anywhere else too.

1. Each window is keyed by the smallest hash of its grams of 48 bytes.
   Consecutive windows of a document with the same key form a run; the piece of
   a run is the text under its windows. Equal windows have equal keys, so they
   meet in one hash range; keys that stand in one place only are dropped before
   any text moves.
2. In a range, equal pieces fall together (their windows repeat). Of the others
   the suffixes are sorted column-wise: a window has ``symbols`` symbols, a
   piece gives strings for each byte phase, cut at symbols that stand once, and
   every round inserts one more symbol in front of every string, from the right.
   The new suffixes' places follow from their symbol and the rank of their tail;
   the common prefix with each neighbour is one more than the least common prefix
   between their tails. The collection's columns (symbol with tail rank, common
   prefix, suffix) are read and written in order; beyond ``memory_mb`` they are
   files. A window repeats where its suffix shares all its symbols with a
   neighbour.
3. A key whose pieces exceed ``hot_bytes`` (a phrase shorter than the window in very
   many surroundings) is no collection: equal pieces are counted and repeat as a
   whole; of each distinct piece every window becomes a row with its own hash, and
   hashes counted more than once mark their windows. Only counts and joins are
   dealt, by a hash of the whole piece or window, so no task holds the key.
4. Windows found are merged to spans per text.

Everything works on distinct texts by SHA-256; copies of a text are only
counted, and texts of ``window`` bytes with copies go whole.

Defined results: a null text is an empty one; texts shorter than the window
stay; equal rows and equal texts (ties) are copies of each other and go together;
matches never cross documents; a very long text is cut into runs by one task and
only its wanted pieces move; empty tables give empty results. Columns other than
``doc_id, text``, of whatever name, are kept by ``remove_repeats`` and not read
by ``repeats``.
"""

from __future__ import annotations

import hashlib
import math
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..session import materialize
from .shingles import _BYTE, _STEP, in_parts, mix

WINDOW = 400
PASSAGE = 200
SYMBOLS = 4
GRAM = 48
_RANGE_BYTES = 2_000_000
_HOT_BYTES = 4 * _RANGE_BYTES
#: Bytes hashed at a time: the arrays of a step take a hundred times as many.
_HASHED_BYTES = 1_000_000
_LOW = np.int64(0xFFFFFFFF)


def _gram_hashes(whole: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes from each position on, by doubling; for the last positions of less."""
    done, width = np.zeros(len(whole), np.uint64), 0
    power, length = _BYTE[whole], 1
    factor = _STEP

    def ahead(x: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros_like(x)
        if k < len(x):
            out[:len(x) - k] = x[k:]
        return out

    while size:
        if size & 1:
            done = done * factor + ahead(power, width) if width else power.copy()
            width += length
        size >>= 1
        if size:
            power = power * factor + ahead(power, length)
            length *= 2
            with np.errstate(over="ignore"):
                factor = factor * factor + np.uint64(2)
    return mix(done)


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of ``width`` values from each position on."""
    n = len(x)
    padded = np.full(-(-n // width) * width + width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    rows = padded.reshape(-1, width)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1:width - 1 + n])


def runs(texts: list[bytes], window: int = WINDOW) -> list[tuple[np.ndarray, ...]]:
    """For each text the runs of windows: keys, first and last window, places of the key's gram in the run's piece."""
    gram = min(GRAM, window)
    width = window - gram + 1
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
    whole = np.frombuffer(b"".join(texts), np.uint8)
    if not len(whole):
        return [(np.zeros(0, np.int64),) * 4 for _ in texts]
    grams = _gram_hashes(whole, gram)
    least = _sliding_least(grams, width)
    out = []
    for s, n in zip(starts.tolist(), lengths.tolist()):
        own = least[s:s + max(0, n - window + 1)]
        if not len(own):
            out.append((np.zeros(0, np.int64),) * 4)
            continue
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        last = np.append(first[1:], len(own)) - 1
        if (last - first).max() >= width:  # a repetitive stretch: cut into pieces of bounded length
            cut = [np.arange(a, b + 1, width) for a, b in zip(first.tolist(), last.tolist())]
            ends = [np.append(c[1:] - 1, b) for c, b in zip(cut, last.tolist())]
            first, last = np.concatenate(cut), np.concatenate(ends)
        at = grams[s:s + n]
        times = np.array([np.count_nonzero(at[a:b + width] == k) for a, b, k in zip(first.tolist(), last.tolist(), own[first])])
        out.append((own[first].view(np.int64), first, last, times))
    return out


class _Columns:
    """Columns of the growing collection: arrays, or files read in order where they exceed the memory given."""

    def __init__(self, folder: str, limit: int):
        self.folder, self.limit, self.round = folder, limit, 0

    def keep(self, name: str, column: np.ndarray) -> np.ndarray:
        if column.nbytes <= self.limit:
            return column
        path = f"{self.folder}/{name}-{self.round % 2}"
        column.tofile(path)
        return np.memmap(path, column.dtype, "r")


def _segments(hashes: np.ndarray, inside: np.ndarray, width: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of the strings of ``least`` symbols or more that stand twice or more each.

    A string takes every ``width``-th place. A symbol that stands once is in no
    repeat, so strings end there; a symbol that is not ``inside`` a piece stands nowhere.
    """
    _, which, times = np.unique(hashes[inside], return_inverse=True, return_counts=True)
    rows = -(-len(hashes) // width) + 1
    good = np.zeros(rows * width, bool)
    good[np.flatnonzero(inside)[times[which] > 1]] = True
    table = good.reshape(rows, width)
    at = np.arange(rows)[:, None]
    ends = np.minimum.accumulate(np.where(table, rows, at)[::-1], axis=0)[::-1]
    first = table.copy()
    first[1:] &= ~table[:-1]
    first &= ends - at >= least
    row, phase = np.nonzero(first)
    return row * width + phase, (ends - at)[row, phase]


def repeated_windows(pieces: list[bytes], window: int = WINDOW, symbols: int = SYMBOLS, memory_mb: int = 64) -> np.ndarray:
    """Flags over the bytes of all pieces: windows of ``symbols`` symbols that start there and repeat in the collection."""
    if window % symbols:
        raise ValueError("the number of symbols must divide the window")
    deep, symbol_bytes = symbols, window // symbols
    # a byte between pieces, so that no string goes on from one into the next
    lengths = np.array([len(p) + 1 for p in pieces], np.int64)
    whole = np.frombuffer(b"\0".join([*pieces, b""]), np.uint8)
    flags = np.zeros(len(whole), bool)
    left = np.repeat(np.cumsum(lengths), lengths) - 1 - np.arange(len(whole))
    of_piece, inside = left > 0, left >= symbol_bytes
    if not inside.any():
        return flags[of_piece]
    hashes = _gram_hashes(whole, symbol_bytes)
    first, count = _segments(hashes, inside, symbol_bytes, deep)
    if not len(first):
        return flags[of_piece]
    final = first + symbol_bytes * (count - 1)
    order = np.argsort(-count, kind="stable")
    count, final = count[order], final[order]
    m = len(count)
    used = np.zeros(len(whole), bool)
    used[np.repeat(final, count) - symbol_bytes * (np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count))] = True
    ranked = np.zeros(len(whole), np.int64)
    ranked[used] = np.unique(hashes[used], return_inverse=True)[1] + 1

    with tempfile.TemporaryDirectory() as folder:
        files = _Columns(folder, memory_mb * 1_000_000)
        # the empty suffixes come first, in the order of the strings
        keys, common, suffix = np.arange(m, dtype=np.int64), np.zeros(m, np.uint8 if deep < 255 else np.int32), np.full(m, -1, np.int64)
        rank = np.arange(m, dtype=np.int64)
        for files.round in range(1, int(count[0]) + 1):
            a = int(np.searchsorted(-count, -files.round, side="right"))
            at = final[:a] - symbol_bytes * (files.round - 1)
            fresh = (ranked[at] << 32) | rank[:a]
            order = np.argsort(fresh)
            fresh, n = fresh[order], len(keys)
            before = np.searchsorted(keys, fresh)
            place = before + np.arange(a)
            old = np.ones(n + a, bool)
            old[place] = False

            def merged(column: np.ndarray, new) -> np.ndarray:
                out = np.empty(n + a, column.dtype)
                out[place] = new
                out[old] = column
                return out

            keys2, common2 = merged(keys, fresh), merged(common, 0)
            touched = np.unique(np.concatenate((place, place + 1)))
            touched = touched[touched < n + a]
            left, right = keys2[touched - 1], keys2[touched]
            alike = (left >> 32) == (right >> 32)
            common2[touched] = 0
            if alike.any():
                low, high, target = (left[alike] & _LOW) + 1, (right[alike] & _LOW) + 1, touched[alike]
                by = np.argsort(low)
                bounds = np.column_stack((low[by], high[by])).ravel()
                between = np.minimum.reduceat(np.append(common, common.dtype.type(0)), bounds)[::2]
                common2[target[by]] = np.minimum(between.astype(np.int64) + 1, deep)
            moved = np.cumsum(np.bincount(before, minlength=n + 1))
            keys2[m:] += moved[keys2[m:] & _LOW]
            rank[:a][order] = place
            keys, common = files.keep("keys", keys2), files.keep("common", common2)
            suffix = files.keep("suffix", merged(suffix, at[order]))
        same = np.append(common >= deep, False)
        flags[np.asarray(suffix)[same[:-1] | same[1:]]] = True
    return flags[of_piece]


def _uid(text: bytes) -> bytes:
    return hashlib.sha256(text).digest()[:16]


_RUNS = ("keys", "first", "last", "times")
_RUN_COLUMNS = "keys array<long>, first array<int>, last array<int>, times array<int>"


def _run_columns(found: list[tuple[np.ndarray, ...]]) -> dict[str, pa.Array]:
    kinds = (np.int64, np.int32, np.int32, np.int32)
    return {c: pa.array([f[i].astype(kind) for f in found], pa.list_(pa.from_numpy_dtype(kind))) for i, (c, kind) in enumerate(zip(_RUNS, kinds))}


def _keyed(docs: DataFrame, window: int) -> DataFrame:
    """The runs of each row's text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in in_parts(batches, _HASHED_BYTES):
            digests = [hashlib.sha256(t) for t in texts]
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(ids, pa.int64()), "uid": pa.array([d.digest()[:16] for d in digests], pa.binary()), "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
                "sha256": pa.array([d.hexdigest() for d in digests]), **_run_columns(runs(texts, window)),
            })

    return docs.select("doc_id", "text").mapInArrow(read, f"doc_id long, uid binary, n_bytes long, sha256 string, {_RUN_COLUMNS}")


def _wanted(each: DataFrame, window: int, hot_bytes: int) -> tuple[DataFrame, int, int]:
    """``uid, at, runs`` with the runs whose key stands twice or more, stored, and the bytes of their pieces under usual and hot keys."""
    each = each.select("uid", "at", F.explode(F.arrays_zip(*_RUNS)).alias("r")).select("uid", "at", "r.*")
    n_bytes = F.col("last") - F.col("first") + F.lit(window)
    shared = each.groupBy("keys").agg(F.sum("times").alias("n"), F.sum(n_bytes).alias("bytes")).where("n > 1").select("keys", (F.col("bytes") > hot_bytes).alias("hot"))
    # stored, so that the join can be dealt anew where a key has very many runs
    shared = materialize(shared, "suffix-shared")
    run = F.struct(F.col("keys").alias("key"), "first", "last", "hot")
    wanted = materialize(each.drop("times").join(shared, "keys").groupBy("uid", "at").agg(F.collect_list(run).alias("runs")), "suffix-wanted")
    total = lambda hot: F.sum(F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + F.when(r["hot"] == hot, r["last"] - r["first"] + window).otherwise(0)))
    size, hot_size = (x or 0 for x in wanted.select(total(False), total(True)).collect()[0])
    return wanted, size, hot_size


_PIECES = "range int, uid binary, first int, piece binary"
_PIECES_SHAPE = pa.schema([("range", pa.int32()), ("uid", pa.binary()), ("first", pa.int32()), ("piece", pa.binary())])


def _pieces(texts: DataFrame, ranges: int, window: int, hot: bool = False) -> DataFrame:
    """The pieces of wanted runs whose key is hot or not, from rows of ``uid, at, body, runs``; ``at`` is the body's place in its text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {c: [] for c in _PIECES_SHAPE.names}
            for uid, at, body, wanted in zip(*(batch.column(i).to_pylist() for i in range(4))):
                for r in wanted:
                    if r["hot"] == hot:
                        rows["range"].append(r["key"] % ranges)
                        rows["uid"].append(uid)
                        rows["first"].append(at + r["first"])
                        rows["piece"].append(body[r["first"]:r["last"] + window])
                if len(rows["range"]) >= 4000:
                    yield pa.RecordBatch.from_pydict(rows, schema=_PIECES_SHAPE)
                    rows = {c: [] for c in rows}
            if rows["range"]:
                yield pa.RecordBatch.from_pydict(rows, schema=_PIECES_SHAPE)

    return texts.select("uid", "at", "body", "runs").mapInArrow(cut, _PIECES)


_SPANS = "uid binary, start int, stop int"
_SPANS_SHAPE = pa.schema([("uid", pa.binary()), ("start", pa.int32()), ("stop", pa.int32())])


def _found(pieces: DataFrame, window: int, symbols: int, memory_mb: int) -> DataFrame:
    """Spans ``uid, start, stop`` of repeated bytes, from the collection of each range."""

    def search(table: pa.Table) -> pa.Table:
        places: dict[bytes, set[tuple[bytes, int]]] = {}
        for uid, first, piece in zip(*(table.column(c).to_pylist() for c in ("uid", "first", "piece"))):
            places.setdefault(piece, set()).add((uid, first))
        distinct = list(places)
        flags = repeated_windows(distinct, window, symbols, memory_mb)
        rows, at = {c: [] for c in _SPANS_SHAPE.names}, 0
        for piece in distinct:
            n = len(piece) - window + 1
            own = flags[at:at + n] if len(places[piece]) == 1 else np.ones(n, bool)
            at += len(piece)
            edges = np.flatnonzero(np.diff(np.concatenate(([0], own.view(np.int8), [0]))))
            for start, stop in edges.reshape(-1, 2).tolist():
                for uid, first in places[piece]:
                    rows["uid"].append(uid)
                    rows["start"].append(first + start)
                    rows["stop"].append(first + stop - 1 + window)
        return pa.Table.from_pydict(rows, schema=_SPANS_SHAPE)

    return pieces.groupBy("range").applyInArrow(search, _SPANS)


def _hot_found(texts: DataFrame, window: int) -> DataFrame:
    """Spans ``uid, start, stop`` of repeated bytes under hot keys, by counts of whole pieces and of single windows."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, len(batch), 1000)):
                uids, firsts, pieces, alone = (part.column(i).to_pylist() for i in range(4))
                lengths = np.array([len(p) for p in pieces], np.int64)
                count = lengths - window + 1
                row = np.repeat(np.arange(len(pieces)), count)
                within = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                hashes = _gram_hashes(np.frombuffer(b"".join(pieces), np.uint8), window)[(np.cumsum(lengths) - lengths)[row] + within]
                yield pa.RecordBatch.from_arrays([
                    pa.array(uids, pa.binary()).take(pa.array(row)), pa.array(np.array(firsts, np.int32)[row]), pa.array((np.array(firsts)[row] + within).astype(np.int32)),
                    pa.array(hashes.view(np.int64)), pa.array(np.array(alone, bool)[row]),
                ], ["uid", "first", "at", "hash", "alone"])

    pieces = _pieces(texts, 1, window, hot=True).dropDuplicates(["uid", "first"])
    pieces = materialize(pieces.withColumn("sha", F.unhex(F.sha2("piece", 256))), "suffix-hot")
    place = F.xxhash64("uid", "first")
    groups = pieces.groupBy("sha").agg(F.count("*").alias("n"), F.min(place).alias("one"))
    known = pieces.join(groups, "sha")
    whole = known.where("n > 1").select("uid", F.col("first").alias("start"), (F.col("first") + F.length("piece")).cast("int").alias("stop"))
    distinct = known.where(place == F.col("one")).select("uid", "first", "piece", (F.col("n") == 1).alias("alone"))
    rows = materialize(distinct.mapInArrow(hashed, "uid binary, first int, at int, hash long, alone boolean"), "suffix-windows")
    # stored, so that the join can be dealt anew where a window has very many places
    twice = materialize(rows.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "suffix-twice")
    marked = rows.where("alone").join(twice, "hash").select("uid", "first", "at")
    # neighbours make one span; a piece has at most as many windows as the window has grams
    stretch = F.col("at") - F.row_number().over(Window.partitionBy("uid", "first").orderBy("at"))
    parts = marked.withColumn("stretch", stretch).groupBy("uid", "first", "stretch").agg(F.min("at").alias("start"), (F.max("at") + window).cast("int").alias("stop"))
    return whole.unionByName(parts.select("uid", "start", "stop"))


def _searched(texts: DataFrame, wanted: tuple[DataFrame, int, int], window: int, symbols: int, memory_mb: int) -> DataFrame:
    """Spans ``uid, start, stop`` of the bodies' repeated windows."""
    _, size, hot_size = wanted
    spans = _found(_pieces(texts, max(1, math.ceil(size / _RANGE_BYTES)), window), window, symbols, memory_mb)
    return spans.unionByName(_hot_found(texts, window)) if hot_size else spans


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


def _prepared(docs: DataFrame, window: int, symbols: int, memory_mb: int, hot_bytes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The keyed rows, one text with its wanted runs per distinct text (``uid, at, body, runs``), and the spans found by text."""
    keyed = materialize(_keyed(docs, window), "suffix-texts")
    one = keyed.groupBy("uid").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id")).alias("chosen"))
    chosen = keyed.join(one, "uid").where(F.col("doc_id").eqNullSafe(F.col("chosen.doc_id"))).dropDuplicates(["uid"])
    wanted = _wanted(chosen.withColumn("at", F.lit(0)), window, hot_bytes)
    runs_of = wanted[0].join(one, "uid").select("uid", "at", "runs", F.col("chosen.doc_id").alias("doc_id"))
    own = docs.select(F.col("doc_id").alias("_doc"), F.substring(F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)), 1, 16).alias("_uid"), F.col("text").cast("binary").alias("body"))
    texts = own.join(runs_of, (own["_uid"] == runs_of["uid"]) & own["_doc"].eqNullSafe(runs_of["doc_id"])).select("uid", "at", "body", "runs")
    return keyed, texts, _searched(texts, wanted, window, symbols, memory_mb)


def _within(bodies: DataFrame, window: int, symbols: int, memory_mb: int, hot_bytes: int) -> DataFrame:
    """Spans ``uid, start, stop`` of windows that repeat, all of whose parts are known to: ``uid, body, spans`` has the spans of smaller windows."""

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, int, bytes]] = []

        def emit() -> pa.RecordBatch:
            uids, places, parts = map(list, zip(*held))
            held.clear()
            return pa.RecordBatch.from_pydict({"uid": pa.array(uids, pa.binary()), "at": pa.array(places, pa.int32()), "body": pa.array(parts, pa.binary()), **_run_columns(runs(parts, window))})

        size = 0
        for batch in batches:
            for uid, body, found in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for start, stop in _united([(s["start"], s["stop"]) for s in found]):
                    if stop - start >= window:
                        held.append((uid, start, body[start:stop]))
                        size += stop - start
                if size >= _HASHED_BYTES:
                    yield emit()
                    size = 0
        if held:
            yield emit()

    cut = materialize(bodies.select("uid", "body", "spans").mapInArrow(stretches, f"uid binary, at int, body binary, {_RUN_COLUMNS}").dropDuplicates(["uid", "at"]), "suffix-stretches")
    wanted = _wanted(cut, window, hot_bytes)
    return _searched(cut.select("uid", "at", "body").join(wanted[0], ["uid", "at"]), wanted, window, symbols, memory_mb)


def _by_text(spans: DataFrame) -> DataFrame:
    """One row of sorted spans for each text; a text's spans are at most as many as its runs."""
    return spans.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))


def repeats(
    docs: DataFrame, window: int = WINDOW, symbols: int = SYMBOLS, memory_mb: int = 64, hot_bytes: int = _HOT_BYTES, passage: int | None = None,
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every document.

    With a ``passage`` size also ``n_passage_bytes``: the bytes covered by strings of
    that smaller size that start elsewhere too. They are found first; a repeated
    window can only lie where they cover a window's bytes, so the construction
    for the window works on those stretches alone.
    """
    if passage is not None and passage >= window:
        raise ValueError("a passage is shorter than the window")
    keyed, texts, spans = _prepared(docs, window if passage is None else passage, symbols, memory_mb, hot_bytes)
    bodies = texts.select("uid", "body").join(_by_text(spans), "uid")
    if passage is not None:
        bodies = materialize(bodies.dropDuplicates(["uid"]), "suffix-bodies")
        longer = _by_text(_within(bodies, window, symbols, memory_mb, hot_bytes))
        bodies = bodies.withColumnRenamed("spans", "shorter").join(longer, "uid", "left").select("uid", "body", "spans", "shorter")
    shape = pa.schema([("uid", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("n_passage_bytes", pa.int64())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {c: [] for c in shape.names}
            columns = [c.to_pylist() for c in batch.columns]
            for uid, body, found, shorter in zip(*columns[:3], columns[3] if passage is not None else [None] * len(batch)):
                cut, at = hashlib.sha256(), 0
                gone = _united([(s["start"], s["stop"]) for s in found or ()])
                for start, stop in gone:
                    cut.update(body[at:start])
                    at = stop
                cut.update(body[at:])
                rows["uid"].append(uid)
                rows["n_removed"].append(sum(b - a for a, b in gone))
                rows["n_spans"].append(len(gone))
                rows["kept_sha256"].append(cut.hexdigest())
                rows["n_passage_bytes"].append(sum(b - a for a, b in _united([(s["start"], s["stop"]) for s in shorter or ()])))
            yield pa.RecordBatch.from_pydict(rows, schema=shape)

    partly = bodies.mapInArrow(digest, "uid binary, n_removed long, n_spans long, kept_sha256 string, n_passage_bytes long").dropDuplicates(["uid"])
    copies = keyed.groupBy("uid").agg(F.count("*").alias("copies"))
    rows = keyed.select("doc_id", "uid", "n_bytes", "sha256").join(copies.join(partly, "uid", "left"), "uid")
    whole = lambda size: (F.col("copies") > 1) & (F.col("n_bytes") >= size)
    count = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    out = [
        "doc_id", "n_bytes",
        F.when(whole(window), F.col("n_bytes")).otherwise(count("n_removed")).alias("n_removed"),
        F.when(whole(window), F.lit(1).cast("long")).otherwise(count("n_spans")).alias("n_spans"),
        F.when(whole(window), F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
    ]
    if passage is not None:
        out.append(F.when(whole(passage), F.col("n_bytes")).otherwise(count("n_passage_bytes")).alias("n_passage_bytes"))
    return rows.select(*out)


def remove_repeats(docs: DataFrame, window: int = WINDOW, symbols: int = SYMBOLS, memory_mb: int = 64, hot_bytes: int = _HOT_BYTES) -> DataFrame:
    """The documents, all columns, with the repeated bytes cut from ``text``.

    A character of which a cut leaves only some bytes goes with them.
    """
    keyed, _, spans = _prepared(docs, window, symbols, memory_mb, hot_bytes)
    copies = keyed.groupBy("uid").agg(F.count("*").alias("copies"), F.first("n_bytes").alias("n_bytes"))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_bytes").cast("int").alias("stop")))
    gone = copies.join(_by_text(spans), "uid", "left").select(
        "uid", F.when((F.col("copies") > 1) & (F.col("n_bytes") >= window), whole).otherwise(F.col("spans")).alias("spans")
    ).where(F.col("spans").isNotNull())
    own = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), "text", F.substring(F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)), 1, 16).alias("own"))
    marked = own.join(gone, own["own"] == gone["uid"], "left").select("row", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for k, found in enumerate(batch.column(2).to_pylist()):
                if found:
                    raw, kept, at = texts[k].encode("utf-8", "replace"), [], 0
                    for start, stop in _united([(s["start"], s["stop"]) for s in found]):
                        kept.append(raw[at:start])
                        at = stop
                    texts[k] = b"".join([*kept, raw[at:]]).decode("utf-8", "ignore")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["row", "text"])

    shape = StructType([StructField("row", docs.schema), StructField("text", StringType())])
    return marked.mapInArrow(cut, shape).select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
