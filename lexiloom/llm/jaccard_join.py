"""N-gram Jaccard join with token-combination prefixes.

Documents link where the Jaccard similarity of their sets of five-word shingles
is at least 0.8. Shingles are 64-bit hashes; equal sets form one class, and
everything after works on classes.

1. Shingles are dealt by hash range, packed. A range finds the shingles that two
   or more classes share and their frequency; only those go back to their class.
   A shingle of one class can match nothing, so a class more than a fifth of
   whose shingles are its own is out.
2. The rest orders its shared shingles by frequency. A prefix is extended until
   it covers one shingle more than a partner may lack. Rare shingles are indexed
   singly. Frequent ones form token classes by hash, of which pairs are indexed: a
   class of ``n`` shingles in the prefix then covers ``n - 1``. The number of
   classes doubles with the size (bands), so a class has some 17 shingles in a
   prefix at most and a set some two keys for each of its shingles. Sets with few
   shingles are indexed singly; sizes in between lie in both levels or bands, so
   that every pair of sizes within the threshold meets in one.
3. Classes that share an index key form candidate components (minimum labels,
   no pairs). Each is verified exactly by a search that compares a class with
   those not yet reached; components over ``block`` classes are dealt as pairs
   of blocks, so no task holds a whole one. Verified links, a spanning forest
   of them, give the components. The same tasks count the links of each class,
   every pair of blocks once, in numbers of documents: links are counted, not
   listed.

No cap on partners or candidates exists. Defined results: null and blank texts
have empty sets and are linked with nothing; with fewer than five words the
whole sequence is the one shingle; equal rows fall together; a null ``doc_id``
is a document whose component is the smallest known id, else null; columns other
than ``doc_id, text`` are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import shingles
from .components import components

RARE = 32
#: Token classes of the first band, and its largest set; both double from band to band.
_CLASSES, _BAND_UP_TO = 16, 1280
_SINGLE_UP_TO, _COMBINED_FROM = 30, 24
_RANGE_TOKENS = 2_000_000


def _sets(docs: DataFrame) -> DataFrame:
    """``doc_id, n, uid, key`` (uid null for an empty set; key names the id and the text)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in shingles.in_parts(batches):
            sets = shingles.shingle_sets(texts)
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(keys, pa.int64()), "n": pa.array([len(s) for s in sets], pa.int64()),
                "uid": pa.array([shingles.fingerprint(s) if len(s) else None for s in sets], pa.int64()),
                "key": pa.array([hashlib.sha256((b"n" if i is None else b"%d" % i) + b":" + t).digest()[:16] for i, t in zip(keys, texts)], pa.binary()),
            })

    return docs.select("doc_id", "text").mapInArrow(read, "doc_id long, n long, uid long, key binary")


def _row_key() -> Column:
    """The same key of a row of documents as a column."""
    named = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("n")), F.lit(":"), F.coalesce("text", F.lit("")))
    return F.substring(F.unhex(F.sha2(named, 256)), 1, 16)


def _planes(x: np.ndarray) -> bytes:
    """Bytes of equal rank side by side: sorted values, as differences, pack well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _unplanes(raw: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _deltas(x: np.ndarray) -> bytes:
    return _planes(np.diff(x, prepend=x.dtype.type(0)))


def _sums(raw: bytes, kind) -> np.ndarray:
    return np.cumsum(_unplanes(raw, kind), dtype=kind)


_PACKED = "range int, tokens binary, owners binary, uids binary, sizes binary"


def _packed(docs: DataFrame, bits: int) -> DataFrame:
    """Shingles by hash range; each row holds those of about 4 MB of text."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in shingles.in_parts(batches):
            sets = {}
            for s in shingles.shingle_sets(texts):
                if len(s):
                    sets.setdefault(shingles.fingerprint(s), s)
            if not sets:
                continue
            uids, sizes = np.array(list(sets), np.int64), np.array([len(s) for s in sets.values()], np.int32)
            tokens, owners = np.concatenate(list(sets.values())), np.repeat(np.arange(len(uids), dtype=np.uint16), sizes)
            order = np.argsort(tokens)
            tokens, owners = tokens[order], owners[order]
            edges = np.searchsorted(tokens, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(0, np.int64)
            rows = []
            for r, (lo, hi) in enumerate(zip([0, *edges.tolist()], [*edges.tolist(), len(tokens)])):
                if lo < hi:
                    there, local = np.unique(owners[lo:hi], return_inverse=True)
                    rows.append((r, _deltas(tokens[lo:hi]), _planes(local.astype(np.uint16)), uids[there].tobytes(), sizes[there].tobytes()))
            yield pa.RecordBatch.from_pydict(dict(zip(("range", "tokens", "owners", "uids", "sizes"), map(list, zip(*rows)))), schema=pa.schema([("range", pa.int32()), *[(c, pa.binary()) for c in ("tokens", "owners", "uids", "sizes")]]))

    return docs.select("doc_id", "text").mapInArrow(pack, _PACKED)


_SHARED = "part int, uids binary, sizes binary, tokens binary, counts binary"


def _shared(packed: DataFrame, parts: int) -> DataFrame:
    """Of each range the shingles of two classes or more, with their frequency, dealt by class."""

    def find(table: pa.Table) -> pa.Table:
        tokens, uids, sizes = [], [], []
        for t, o, u, s in zip(*(table.column(c).to_pylist() for c in ("tokens", "owners", "uids", "sizes"))):
            own = _unplanes(o, np.uint16)
            tokens.append(_sums(t, np.uint64))
            uids.append(np.frombuffer(u, np.int64)[own])
            sizes.append(np.frombuffer(s, np.int32)[own])
        tokens, uids, sizes = map(np.concatenate, (tokens, uids, sizes))
        order = np.lexsort((uids, tokens))
        tokens, uids, sizes = tokens[order], uids[order], sizes[order]
        fresh = np.concatenate(([True], (tokens[1:] != tokens[:-1]) | (uids[1:] != uids[:-1])))
        tokens, uids, sizes = tokens[fresh], uids[fresh], sizes[fresh]
        starts = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
        df = np.diff(np.append(starts, len(tokens)))
        counts = np.repeat(df, df)
        keep = counts > 1
        tokens, uids, sizes, counts = tokens[keep], uids[keep], sizes[keep], counts[keep].astype(np.int64)
        part = (shingles.mix(uids.view(np.uint64)) % np.uint64(parts)).astype(np.int32)
        order = np.lexsort((uids, part))
        part, tokens, uids, sizes, counts = (x[order] for x in (part, tokens, uids, sizes, counts))
        rows = {c: [] for c in ("part", "uids", "sizes", "tokens", "counts")}
        for p in np.unique(part).tolist():
            lo, hi = np.searchsorted(part, (p, p + 1))
            for c, v in zip(rows, (p, _deltas(uids[lo:hi]), _planes(sizes[lo:hi]), tokens[lo:hi].tobytes(), _planes(counts[lo:hi]))):
                rows[c].append(v)
        return pa.Table.from_pydict(rows, schema=pa.schema([("part", pa.int32()), *[(c, pa.binary()) for c in ("uids", "sizes", "tokens", "counts")]]))

    return packed.groupBy("range").applyInArrow(find, _SHARED)


def _class_counts(n: int) -> list[int]:
    """Numbers of token classes of the bands in which a set of ``n`` shingles lies.

    A band starts at four fifths of where the one before it ends.
    """
    k = max(0, (n - 1) // _BAND_UP_TO).bit_length()
    return [_CLASSES << k] + ([_CLASSES << k + 1] if 5 * n >= 4 * (_BAND_UP_TO << k) else [])


def index_keys(tokens: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """Index keys of a set of ``n`` shingles, of which ``tokens`` are shared with others.

    A partner may lack ``n // 5`` shingles; those not shared it lacks for sure.
    """
    needed = n // 5 + 1 - (n - len(tokens))
    if needed < 1:
        return np.zeros(0, np.uint64)
    order = np.lexsort((tokens, counts))
    tokens, counts = tokens[order], counts[order]
    keys = []
    if n <= _SINGLE_UP_TO:
        keys.append(shingles.mix(tokens[:needed] + np.uint64(1)))
    if n >= _COMBINED_FROM:
        rare = int(np.searchsorted(counts, RARE, side="right"))
        keys.append(shingles.mix(tokens[:min(rare, needed)] + np.uint64(2)))
        if rare < needed:
            frequent = tokens[rare:]
            for classes in _class_counts(n):
                group = (frequent >> np.uint64(7)) % np.uint64(classes)
                # a class covers one shingle less than it has in the prefix
                first = np.zeros(len(group), bool)
                first[np.unique(group, return_index=True)[1]] = True
                end = int(np.searchsorted(np.cumsum(~first), needed - rare)) + 1
                by = np.argsort(group[:end], kind="stable")
                own = np.split(frequent[:end][by], np.flatnonzero(np.diff(group[:end][by])) + 1)
                pairs = [(x[a], x[b]) for x in own for a, b in [np.triu_indices(len(x), 1)]]
                a, b = map(np.concatenate, zip(*pairs))
                keys.append(shingles.mix(shingles.mix(a) + b + np.uint64(3)))
    return np.unique(np.concatenate(keys))


_CANDIDATES = "uid long, n long, tokens binary, keys array<long>"


def _candidates(shared: DataFrame) -> DataFrame:
    """Classes that may link, with their shared shingles and index keys."""

    def build(table: pa.Table) -> pa.Table:
        cols = [table.column(c).to_pylist() for c in ("uids", "sizes", "tokens", "counts")]
        uids = np.concatenate([_sums(x, np.int64) for x in cols[0]])
        sizes = np.concatenate([_unplanes(x, np.int32) for x in cols[1]])
        tokens = np.concatenate([np.frombuffer(x, np.uint64) for x in cols[2]])
        counts = np.concatenate([_unplanes(x, np.int64) for x in cols[3]])
        order = np.argsort(uids, kind="stable")
        uids, sizes, tokens, counts = uids[order], sizes[order], tokens[order], counts[order]
        starts = np.flatnonzero(np.concatenate(([True], uids[1:] != uids[:-1])))
        rows = {"uid": [], "n": [], "tokens": [], "keys": []}
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(uids)]):
            n = int(sizes[lo])
            if n - (hi - lo) <= n // 5:
                keys = index_keys(tokens[lo:hi], counts[lo:hi], n)
                for c, v in zip(rows, (int(uids[lo]), n, np.sort(tokens[lo:hi]).tobytes(), keys.view(np.int64))):
                    rows[c].append(v)
        return pa.Table.from_pydict(rows, schema=pa.schema([("uid", pa.int64()), ("n", pa.int64()), ("tokens", pa.binary()), ("keys", pa.list_(pa.int64()))]))

    return shared.groupBy("part").applyInArrow(build, _CANDIDATES)


def linked(sizes: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the links among some sets: numbers of linked sets.

    Sizes count all shingles, the sets hold those that more than one class has.
    """
    lengths = np.array([len(s) for s in sets])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    marks = np.zeros(int(flat.max()) + 1, np.int32)
    firsts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    own = [flat[a:a + n] for a, n in zip(firsts.tolist(), lengths.tolist())]
    left, forest = np.arange(len(sets)), []
    pool, pool_first = flat, firsts
    alive = np.ones(len(sets), bool)
    queue: list[int] = []
    while True:
        if not queue:
            rest = np.flatnonzero(alive)
            if not len(rest):
                return forest
            queue.append(int(rest[0]))
            alive[rest[0]] = False
        if alive[left].sum() * 2 < len(left):
            left = left[alive[left]]
            if not len(left):
                return forest
            pool = np.concatenate([own[i] for i in left.tolist()])
            pool_first = np.concatenate(([0], np.cumsum(lengths[left])[:-1]))
        d = queue.pop()
        marks[own[d]] = 1
        both = np.add.reduceat(marks[pool], pool_first)
        marks[own[d]] = 0
        hit = left[(100 * both >= 80 * (sizes[left] + sizes[d] - both)) & alive[left]]
        alive[hit] = False
        forest += [(d, h) for h in hit.tolist()]
        queue += hit.tolist()


def link_counts(sizes: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], own: np.ndarray, within: set[int]) -> np.ndarray:
    """For each set the copies of those it links with in another block, and in its own if that is one of ``within``."""
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    edges = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    tokens = [flat[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
    marks, out = np.zeros(int(flat.max()) + 1, np.int32), np.zeros(len(sets), np.int64)
    blocks = np.unique(own).tolist()
    for y in blocks:
        # by size: only sets within the threshold of each other's size are compared
        right = np.flatnonzero(own == y)
        right = right[np.argsort(sizes[right], kind="stable")]
        pool = np.concatenate([tokens[i] for i in right.tolist()])
        firsts = np.concatenate(([0], np.cumsum([len(tokens[i]) for i in right.tolist()])))
        for x in blocks:
            if x > y or (x == y and x not in within):
                continue
            for d in np.flatnonzero(own == x).tolist():
                lo = int(np.searchsorted(sizes[right], -(-4 * sizes[d] // 5)))
                hi = int(np.searchsorted(sizes[right], 5 * sizes[d] // 4, side="right"))
                if lo == hi:
                    continue
                marks[tokens[d]] = 1
                both = np.add.reduceat(marks[pool[firsts[lo]:firsts[hi]]], firsts[lo:hi] - firsts[lo])
                marks[tokens[d]] = 0
                near = right[lo:hi]
                hit = near[(100 * both >= 80 * (sizes[near] + sizes[d] - both)) & (near != d)]
                out[d] += copies[hit].sum()
                if x != y:
                    out[hit] += copies[d]
    return out


def _verified(placed: DataFrame, block: int, count_links: bool) -> DataFrame:
    """Inside candidate components ``uid, n, copies, tokens, label``: verified links ``a, b``, and ``links`` of ``a`` where ``b`` is null."""
    sizes = placed.groupBy("label").agg(F.count("*").alias("members"))
    dealt = placed.join(sizes, "label").withColumn("blocks", F.ceil(F.col("members") / block).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: (i != F.col("own")) | (F.col("blocks") == 1))
    units = dealt.withColumn("other", F.explode(others)).select(
        "label", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "uid", "n", "copies", "own", "blocks", "tokens"
    )

    def verify(table: pa.Table) -> pa.Table:
        uids = table.column("uid").to_pylist()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("tokens").to_pylist()]
        forest = linked(table.column("n").to_numpy(), sets) if len(uids) > 1 else []
        a, b, links = [uids[x] for x, _ in forest], [uids[y] for _, y in forest], [None] * len(forest)
        if forest and count_links:
            i, j, blocks = (table.column(c)[0].as_py() for c in ("i", "j", "blocks"))
            # the pairs inside a block are counted with the block that follows it
            within = {x for x in (i, j) if {x, (x + 1) % blocks} == {i, j}}
            counts = link_counts(table.column("n").to_numpy(), table.column("copies").to_numpy(), sets, table.column("own").to_numpy(), within)
            a, b, links = a + uids, b + [None] * len(uids), links + counts.tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "links": pa.array(links, pa.int64())})

    return units.groupBy("label", "i", "j").applyInArrow(verify, "a long, b long, links long")


def _grouped(docs: DataFrame, block: int, count_links: bool) -> DataFrame:
    """A row for each document: ``doc_id, n, uid, key, copies, links, _group`` (group null for an empty set)."""
    sets = materialize(_sets(docs), "jaccard-sets")
    total = sets.agg(F.sum("n")).collect()[0][0] or 0
    bits = max(4, math.ceil(math.log2(max(1, total / _RANGE_TOKENS))))
    parts = max(16, math.ceil(total / _RANGE_TOKENS))
    classes = materialize(_candidates(_shared(_packed(docs, bits), parts)), "jaccard-classes")
    keys = classes.select("uid", F.explode("keys").alias("key"))
    least = keys.groupBy("key").agg(F.min("uid").alias("least"), F.max("uid").alias("most")).where("least <> most")
    near = keys.join(least.select("key", "least"), "key").select(F.col("uid").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
    groups = components(near, "jaccard-near")
    copies = sets.where(F.col("uid").isNotNull()).groupBy("uid").agg(F.count("*").alias("copies"))
    placed = classes.select("uid", "n", "tokens").join(groups.select(F.col("node").alias("uid"), "label"), "uid").join(copies, "uid")
    found = materialize(_verified(placed, block, count_links), "jaccard-links")
    merged = components(found.where(F.col("b").isNotNull()).select("a", "b"), "jaccard-links")
    links = found.where(F.col("b").isNull()).groupBy(F.col("a").alias("uid")).agg(F.sum("links").alias("links"))
    # stored, so that the join with the documents can be dealt anew where a class has very many copies
    known = materialize(copies.join(merged.select(F.col("node").alias("uid"), "label"), "uid", "left").join(links, "uid", "left"), "jaccard-known")
    return sets.join(known, "uid", "left").withColumn("_group", F.coalesce("label", "uid"))


def jaccard_components(docs: DataFrame, block: int = 1000, count_links: bool = True) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_members, n_links`` of every document.

    ``n_members`` are the documents of the component, ``n_links`` those among them
    that reach the threshold with this one, copies included; null where
    ``count_links`` is off.
    """
    joined = _grouped(docs, block, count_links)
    named = joined.where(F.col("uid").isNotNull()).groupBy("_group").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n_members"))
    # stored for the same reason: a component may hold a third of all documents
    named = materialize(named.withColumnRenamed("_group", "_of"), "jaccard-components")
    # an empty set stands for itself: its own key keeps such rows apart
    keyed = joined.withColumn("_group", F.coalesce("_group", F.col("doc_id")))
    out = keyed.join(named, (keyed["_group"] == named["_of"]) & keyed["uid"].isNotNull(), "left")
    n_links = F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("links", F.lit(0)) if count_links else F.lit(None)
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_members", F.lit(1).cast("long")).alias("n_members"),
        n_links.cast("long").alias("n_links"),
    )


def one_of_each(docs: DataFrame, block: int = 1000) -> DataFrame:
    """One row, all columns, of each component: the smallest id, of rows with that id the one whose text's key is smallest.

    Rows equal in id and text are one document and leave one row. A null id is
    larger than any other. Texts without words are components of their own.
    """
    rows = _grouped(docs, block, count_links=False)
    alone = F.when(F.col("uid").isNull(), F.col("key"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "key"))
    kept = rows.groupBy("_group", alone.alias("_alone")).agg(first.alias("first")).select(F.col("first.key").alias("_kept"))
    whole = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), _row_key().alias("_key"))
    return whole.join(kept, F.col("_key") == F.col("_kept"), "left_semi").dropDuplicates(["_key"]).select("_row.*")
