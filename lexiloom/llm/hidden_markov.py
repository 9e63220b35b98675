"""LM scoring with a hidden Markov model trained by Baum-Welch over the whole corpus.

Tokens are words (A-Z lower-cased) and one end per text, identified by 64-bit
hashes. Training texts are those whose ``crc32(doc_id) % 10`` is not 0.

1. Texts are read in blocks of about 2.5 MB: local word numbers per text, local
   words with their training counts. Counts meet by hash range, packed, and go
   back to their blocks, so that no row per token is ever shuffled.
2. The ``top_words`` most frequent words emit themselves; all other words share
   ``rest_classes`` classes by their last three bytes. The probability of a text
   is that of its class sequence under the model times that of each word in its
   class (additive smoothing, one place for unseen words).
3. States start from ten rounds of an aggregate Markov fit to the bigram counts of
   257 coarse classes of all training texts. Then Baum-Welch, until a round gains
   less than ``tolerance`` of the training log probability: tasks run the scaled
   forward and backward recursions over their whole texts, in segments that hand
   their messages over every border, and emit expected counts, which Spark sums.
   Moves over borders count, starts only where a text starts. The driver holds
   only the model, whose size is fixed.
4. The scaled forward recursion over whole texts gives the exact likelihood.

Defined results: a null text is an empty one and has one token, its end; a null
``doc_id`` is held out; equal rows are scored and counted each; without training
texts every token has the same probability; words of equal frequency (ties) are
taken by hash; very long texts are scored whole and trained on in segments, so
only their hashes are held at once; columns other than ``doc_id, text``
are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_stored, materialize
from .jaccard_join import _deltas, _planes, _sums, _unplanes
from .shingles import _BYTE, in_parts, mix, word_hashes

SMOOTH = 0.1
SEGMENT = 128
#: Tokens before and after a border that its first messages are taken from, and how far messages may differ at last.
BURN, AGREE = 16, 1e-6
TOLERANCE, MAX_ROUNDS = 2e-3, 20
COARSE = 192
_END = np.uint64(1)  # stands for the end of a text among the word hashes
_GROUP_TOKENS = 2_000_000
_HASHED_BYTES = 500_000
#: Text of a block: a task's arrays take some fifty times as much.
_BLOCK_BYTES = 2_500_000
_SEGMENTS_AT_ONCE = 2048
_RANGE_BYTES = 32_000_000


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def _suffixes(texts: list[bytes]) -> np.ndarray:
    """A hash of the last three bytes of every word, in the order of ``word_hashes``."""
    whole = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    blank = (whole == 32) | ((whole >= 9) & (whole <= 13))
    last = np.flatnonzero(blank & np.concatenate(([False], ~blank[:-1]))) - 1
    low = whole + np.uint8(32) * ((whole >= 65) & (whole <= 90)).astype(np.uint8)
    out, inside = np.zeros(len(last), np.uint64), np.ones(len(last), bool)
    for back in range(3):
        at = last - back
        inside &= (at >= 0) & ~blank[np.maximum(at, 0)]
        out = np.where(inside, mix(out + _BYTE[low[np.maximum(at, 0)]]), out)
    return out


def _hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word and suffix hashes and words per text; some texts at a time, as hashing takes many bytes for each byte read."""
    edges, held = [0], 0
    for i, t in enumerate(texts, 1):
        held += len(t)
        if held >= _HASHED_BYTES or i == len(texts):
            edges.append(i)
            held = 0
    found = [(*word_hashes(texts[a:b]), _suffixes(texts[a:b])) for a, b in zip(edges, edges[1:])]
    hashes, per_text, suffixes = map(np.concatenate, zip(*found))
    return hashes, per_text, suffixes


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of Arrow batches one by one: a block's row is megabytes, a batch of them would be copied whole."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(column[i].as_py() for column in batch.columns)


_BLOCKS = "ids array<long>, lengths array<int>, tokens binary, words binary, counts binary, suffixes binary"
_SCHEMA = pa.schema([("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), *[(c, pa.binary()) for c in ("tokens", "words", "counts", "suffixes")]])


def _blocks(docs: DataFrame, rest_classes: int) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in in_parts(batches, _BLOCK_BYTES):
            hashes, per_text, suffixes = _hashed(texts)
            ends = np.cumsum(per_text)
            all_tokens = np.insert(np.maximum(hashes, np.uint64(2)), ends, _END)
            suffix = np.insert(suffixes % np.uint64(rest_classes), ends, 0).astype(np.uint16)
            words, first, local = np.unique(all_tokens, return_index=True, return_inverse=True)
            trains = np.repeat(np.array([not held_out(i) for i in ids]), per_text + 1)
            counts = np.bincount(local[trains], minlength=len(words)).astype(np.int64)
            # frequent words get small numbers: most of their bytes are zero
            by = np.argsort(-np.bincount(local), kind="stable")
            number = np.empty(len(by), np.int32)
            number[by] = np.arange(len(by), dtype=np.int32)
            yield pa.RecordBatch.from_pydict({
                "ids": [ids], "lengths": [(per_text + 1).astype(np.int32)], "tokens": [_planes(number[local])],
                "words": [words[by].tobytes()], "counts": [_planes(counts[by])], "suffixes": [_planes(suffix[first[by]])],
            }, schema=_SCHEMA)

    return docs.select("doc_id", "text").mapInArrow(read, _BLOCKS)


_RANGED = "range int, block long, words binary, counts binary, suffixes binary"
_RANGED_SCHEMA = pa.schema([("range", pa.int32()), ("block", pa.int64()), *[(c, pa.binary()) for c in ("words", "counts", "suffixes")]])


def _by_range(blocks: DataFrame, ranges: int) -> DataFrame:
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, words, counts, suffixes in _rows(batches):
            words = np.frombuffer(words, np.uint64)
            counts, suffixes = _unplanes(counts, np.int64), _unplanes(suffixes, np.uint16)
            part = (mix(words) % np.uint64(ranges)).astype(np.int32)
            rows = {c: [] for c in _RANGED_SCHEMA.names}
            for r in np.unique(part).tolist():
                own = np.flatnonzero(part == r)
                own = own[np.argsort(words[own])]
                for c, v in zip(rows, (r, block, _deltas(words[own]), _planes(counts[own]), _planes(suffixes[own]))):
                    rows[c].append(v)
            yield pa.RecordBatch.from_pydict(rows, schema=_RANGED_SCHEMA)

    return blocks.select("block", "words", "counts", "suffixes").mapInArrow(deal, _RANGED)


def _counted(ranged: DataFrame) -> DataFrame:
    """Of each range one row of all words with their totals (``block`` null), and each block's totals in its own order."""

    def add(table: pa.Table) -> pa.Table:
        ranges, blocks = table.column("range").to_pylist(), table.column("block").to_pylist()
        own = [_sums(w, np.uint64) for w in table.column("words").to_pylist()]
        flat = np.concatenate(own)
        words, first, local = np.unique(flat, return_index=True, return_inverse=True)
        counts = np.concatenate([_unplanes(c, np.int64) for c in table.column("counts").to_pylist()])
        suffixes = np.concatenate([_unplanes(s, np.uint16) for s in table.column("suffixes").to_pylist()])
        totals = np.zeros(len(words), np.int64)
        np.add.at(totals, local, counts)
        rows = {"range": [ranges[0]], "block": [None], "words": [words.tobytes()], "counts": [_planes(totals)], "suffixes": [_planes(suffixes[first])]}
        at = 0
        for b, w in zip(blocks, own):
            for c, v in zip(rows, (ranges[0], b, None, _planes(totals[local[at:at + len(w)]]), None)):
                rows[c].append(v)
            at += len(w)
        return pa.Table.from_pydict(rows, schema=_RANGED_SCHEMA)

    return ranged.groupBy("range").applyInArrow(add, _RANGED)


class Classes:
    """Word classes: 0 is the end, then the top words, then the rest by suffix."""

    def __init__(self, top: np.ndarray, rest_classes: int):
        self.top, self.rest = np.sort(top), rest_classes
        self.n = 1 + len(top) + rest_classes

    def of(self, words: np.ndarray, suffixes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.top, words)
        listed = np.zeros(len(words), bool)
        if len(self.top):
            listed = self.top[np.minimum(at, len(self.top) - 1)] == words
        out = np.where(listed, 1 + at, 1 + len(self.top) + suffixes.astype(np.int64))
        return np.where(words == _END, 0, out)


def _top_words(totals: DataFrame, top: int) -> list[tuple[int, int]]:
    """The most frequent words over all ranges; each range hands up at most ``top``."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words, counts = np.frombuffer(words, np.uint64), _unplanes(counts, np.int64)
                keep = np.flatnonzero((counts > 0) & (words != _END))
                keep = keep[np.lexsort((words[keep], -counts[keep]))[:top]]
                yield pa.RecordBatch.from_pydict({"word": pa.array(words[keep].view(np.int64)), "n": pa.array(counts[keep])})

    rows = totals.select("words", "counts").mapInArrow(best, "word long, n long").orderBy(F.desc("n"), "word").limit(top).collect()
    return [(r["word"], r["n"]) for r in rows]


def _class_totals(totals: DataFrame, classes: Classes) -> tuple[np.ndarray, np.ndarray]:
    """Training tokens and distinct training words of each class."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(classes.n, np.int64), np.zeros(classes.n, np.int64)
        for batch in batches:
            for words, counts, suffixes in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words, counts = np.frombuffer(words, np.uint64), _unplanes(counts, np.int64)
                own = classes.of(words, _unplanes(suffixes, np.uint16))
                np.add.at(n, own, counts)
                np.add.at(v, own, (counts > 0).astype(np.int64))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"k": pa.array(at), "n": pa.array(n[at]), "v": pa.array(v[at])})

    rows = totals.select("words", "counts", "suffixes").mapInArrow(add, "k long, n long, v long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    n, v = np.zeros(classes.n, np.int64), np.zeros(classes.n, np.int64)
    for r in rows:
        n[r["k"]], v[r["k"]] = r["n"], r["v"]
    return n, v


_CODED = "ids array<long>, lengths array<int>, classes binary, known array<long>, base array<double>, within array<double>"
_CODED_SCHEMA = pa.schema([
    ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("classes", pa.binary()), ("known", pa.list_(pa.int64())), ("base", pa.list_(pa.float64())), ("within", pa.list_(pa.float64())),
])


def _coded(blocks: DataFrame, counted: DataFrame, ranges: int, classes: Classes, n: np.ndarray, v: np.ndarray) -> DataFrame:
    """Class sequences of the blocks' texts, with base scores and the words' probabilities in their classes."""
    back = counted.where(F.col("block").isNotNull()).groupBy("block").agg(F.collect_list(F.struct("range", "counts")).alias("totals"))
    total, distinct = int(n.sum()), int(v.sum())

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, lengths, tokens, words, suffixes, totals in _rows(batches):
            words, suffixes = np.frombuffer(words, np.uint64), _unplanes(suffixes, np.uint16)
            part = mix(words) % np.uint64(ranges)
            counts = np.zeros(len(words), np.int64)
            for t in totals:
                own = np.flatnonzero(part == t["range"])
                counts[own[np.argsort(words[own])]] = _unplanes(t["counts"], np.int64)
            own = classes.of(words, suffixes)
            base = np.log10((counts + SMOOTH) / (total + SMOOTH * (distinct + 1)))
            within = np.where((own > 0) & (own <= len(classes.top)), 0.0, np.log10((counts + SMOOTH) / (n[own] + SMOOTH * (v[own] + 1))))
            within[own == 0] = 0.0
            tokens = _unplanes(tokens, np.int32)
            firsts = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
            yield pa.RecordBatch.from_pydict({
                "ids": [ids], "lengths": [lengths], "classes": [_planes(own[tokens].astype(np.uint16))],
                "known": [np.add.reduceat((counts > 0).astype(np.int64)[tokens], firsts)],
                "base": [np.add.reduceat(base[tokens], firsts)], "within": [np.add.reduceat(within[tokens], firsts)],
            }, schema=_CODED_SCHEMA)

    # as many partitions as ranges, also where small ones would be united: a row takes many times its stored bytes
    joined = blocks.repartition(ranges, "block").join(back, "block").select("ids", "lengths", "tokens", "words", "suffixes", "totals")
    return joined.mapInArrow(code, _CODED)


class Model:
    """Start, transition and emission probabilities of the states."""

    def __init__(self, start: np.ndarray, moves: np.ndarray, emits: np.ndarray):
        self.start, self.moves, self.emits = start, moves, emits


def _coarse_bigrams(coded: DataFrame, coarse: np.ndarray) -> np.ndarray:
    """Counts of neighbouring coarse classes over all training texts."""
    size = int(coarse.max()) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(size * size, np.int64)
        for ids, lengths, classes in _texts(batches):
            seq = coarse[classes]
            trains = np.repeat(np.array([not held_out(i) for i in ids]), lengths)
            ends = np.cumsum(lengths) - 1
            pairs = trains[:-1].copy()
            pairs[ends[:-1]] = False
            cells += np.bincount((seq[:-1] * size + seq[1:])[pairs], minlength=size * size)
        at = np.flatnonzero(cells)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(at), "n": pa.array(cells[at])})

    out = np.zeros(size * size)
    for r in coded.select("ids", "lengths", "classes").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out.reshape(size, size)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    for ids, lengths, classes in _rows(batches):
        yield ids, np.array(lengths, np.int64), _unplanes(classes, np.uint16).astype(np.int64)


def first_model(bigrams: np.ndarray, coarse: np.ndarray, class_counts: np.ndarray, states: int, rounds: int = 10, seed: int = 7) -> Model:
    """An aggregate Markov fit: bigrams as emissions of a pair of neighbouring states."""
    rng = np.random.default_rng(seed)
    size = len(bigrams)
    joint = np.full((states, states), 1.0) + 3 * states * np.eye(states)
    joint /= joint.sum()
    share = bigrams.sum(0) + bigrams.sum(1) + 1e-3
    emits = share * rng.uniform(0.3, 1.7, (states, size))
    emits /= emits.sum(1, keepdims=True)
    for _ in range(rounds if bigrams.sum() else 0):
        expected = emits.T @ joint @ emits + 1e-300
        ratio = bigrams / expected
        new_emits = emits * (joint @ emits @ ratio.T + joint.T @ emits @ ratio)
        joint = joint * (emits @ ratio @ emits.T)
        emits = new_emits + 1e-9 * share
        emits /= emits.sum(1, keepdims=True)
        joint /= joint.sum()
    smooth = class_counts + SMOOTH
    per = np.bincount(coarse, weights=smooth, minlength=size)
    full = emits[:, coarse] * (smooth / per[coarse])
    moves = joint + 1e-6
    return Model(joint.sum(1), moves / moves.sum(1, keepdims=True), full / full.sum(1, keepdims=True))


class _Segments:
    """Stretches of the training texts. All but a text's first begin with the last token of the one before, whose forward message they take over."""

    def __init__(self, lengths: np.ndarray, trains: np.ndarray):
        firsts = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)[trains]
        own = lengths[trains]
        each = -(-own // SEGMENT)
        place = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
        low = np.repeat(firsts, each) + SEGMENT * place
        self.stop = np.minimum(low + SEGMENT, np.repeat(firsts + own, each))
        self.first, self.last = place == 0, np.append(place[1:] == 0, True)[:len(place)]
        self.begin = low - ~self.first
        self.long = self.stop - self.begin
        self.low_of_text, self.end_of_text = np.repeat(firsts, each), np.repeat(firsts + own, each)


def _forward_at(model: Model, table: np.ndarray, classes: np.ndarray, at: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Forward messages at some tokens, from ``BURN`` tokens before them (or their text's start) on."""
    states = len(model.start)
    alpha = np.full((len(at), states), 1.0 / states)
    for back in range(BURN, -1, -1):
        token = at - back
        inside = token >= low
        step = np.where((token == low)[:, None], model.start, alpha @ model.moves) * table[classes[np.maximum(token, low)]]
        alpha = np.where(inside[:, None], step / step.sum(1, keepdims=True), alpha)
    return alpha


def _backward_at(model: Model, table: np.ndarray, classes: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Backward messages at some tokens, from ``BURN`` tokens after them (or their text's end) back."""
    beta = np.ones((len(at), len(model.start)))
    for ahead in range(BURN, 0, -1):
        token = at + ahead
        inside = token < end
        step = (beta * table[classes[np.minimum(token, end - 1)]]) @ model.moves.T
        beta = np.where(inside[:, None], step / step.sum(1, keepdims=True), beta)
    return beta / beta.sum(1, keepdims=True)


def expected_counts(model: Model, lengths: np.ndarray, classes: np.ndarray, trains: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts of starts, moves and emissions over the whole training texts, and their log10 probability.

    The recursions run over segments side by side. Messages at the borders are
    first taken from ``BURN`` tokens around; then every segment's own messages are
    compared with those its neighbours used, and segments whose neighbours
    disagree run again with the better ones, until all agree to ``AGREE``.
    """
    states = len(model.start)
    starts, moves, emits, likelihood = np.zeros(states), np.zeros((states, states)), np.zeros((states, model.emits.shape[1])), 0.0
    seg = _Segments(lengths, trains)
    n = len(seg.begin)
    if not n:
        return starts, moves, emits, likelihood
    table = np.ascontiguousarray(model.emits.T)
    entry, leave = np.zeros((n, states)), np.ones((n, states))
    later, early = np.flatnonzero(~seg.first), np.flatnonzero(~seg.last)
    for a in range(0, len(later), 4 * _SEGMENTS_AT_ONCE):
        some = later[a:a + 4 * _SEGMENTS_AT_ONCE]
        entry[some] = _forward_at(model, table, classes, seg.begin[some], seg.low_of_text[some])
    for a in range(0, len(early), 4 * _SEGMENTS_AT_ONCE):
        some = early[a:a + 4 * _SEGMENTS_AT_ONCE]
        leave[some] = _backward_at(model, table, classes, seg.stop[some] - 1, seg.end_of_text[some])
    groups = [np.arange(a, min(a + _SEGMENTS_AT_ONCE, n)) for a in range(0, n, _SEGMENTS_AT_ONCE)]
    counts: list = [None] * len(groups)
    out, back = np.zeros((n, states)), np.zeros((n, states))
    todo = set(range(len(groups)))
    while todo:
        for g in todo:
            own = groups[g]
            counts[g], out[own], back[own] = _expected(model, table, seg, own, entry[own], leave[own], classes)
        wrong = np.zeros(n, bool)
        wrong[later] = np.abs(out[later - 1] - entry[later]).max(1) > AGREE
        wrong[early] |= np.abs(back[early + 1] - leave[early]).max(1) > AGREE
        entry[later], leave[early] = out[later - 1], back[early + 1]
        todo = {int(g) for g in np.unique(np.flatnonzero(wrong) // _SEGMENTS_AT_ONCE)}
    for a, b, c, x in counts:
        starts, moves, emits, likelihood = starts + a, moves + b, emits + c, likelihood + x
    return starts, moves, emits, likelihood


def _expected(model: Model, table: np.ndarray, seg: _Segments, own: np.ndarray, entry: np.ndarray, leave: np.ndarray, classes: np.ndarray):
    """The counts over some segments, all at the same step at once, and the messages at their ends."""
    states, n = len(model.start), len(own)
    order = np.argsort(-seg.long[own], kind="stable")
    begin, long, first, last = seg.begin[own][order], seg.long[own][order], seg.first[own][order], seg.last[own][order]
    active = [int(np.searchsorted(-long, -t, side="left")) for t in range(int(long[0]) + 1)]
    seen, forward, scales, likelihood = [], [], [], 0.0
    ends, ones = np.zeros((n, states)), np.ones((states, 1))  # a product with ones adds up rows faster than sum()
    for t in range(int(long[0])):
        k = active[t]
        obs = table[classes[begin[:k] + t]]
        alpha = np.where(first[:, None], model.start * obs, entry[order]) if t == 0 else alpha[:k] @ model.moves * obs
        scale = alpha @ ones
        alpha /= scale
        likelihood += float(np.log10(scale[first] if t == 0 else scale).sum())
        seen.append(obs)
        forward.append(alpha)
        scales.append(scale)
        gone = active[t + 1] if t + 1 < len(active) else 0
        ends[gone:k] = alpha[gone:k]
    # a backward message is scaled so that it and the forward one make a distribution
    final = np.where(last[:, None], 1.0, leave[order])
    final = final / (ends * final).sum(1, keepdims=True)
    pairs, back = np.zeros((states, states)), np.ascontiguousarray(model.moves.T)
    gammas, tokens = [], []
    beta = final[:0]
    for t in range(int(long[0]) - 1, -1, -1):
        k = active[t]
        if len(beta) < k:
            beta = np.concatenate((beta, final[len(beta):k]))
        gamma = forward[t] * beta
        if t == 0:
            gammas.append(gamma[first])
            tokens.append(classes[begin[first]])
        else:
            gammas.append(gamma)
            tokens.append(classes[begin[:k] + t])
            ahead = np.multiply(beta, seen[t], out=seen[t])
            ahead /= scales[t]
            pairs += forward[t - 1][:k].T @ ahead
            beta = ahead @ back
    moves = model.moves * pairs
    starts = gammas[-1].sum(0)
    flat, at = np.concatenate(gammas), np.concatenate(tokens)
    emits = np.stack([np.bincount(at, weights=flat[:, s], minlength=model.emits.shape[1]) for s in range(states)])
    undo = np.empty(n, np.int64)
    undo[order] = np.arange(n)
    begins = beta / beta.sum(1, keepdims=True)
    return (starts, moves, emits, likelihood), ends[undo], begins[undo]


def _round(coded: DataFrame, model: Model) -> tuple[Model, float]:
    """One round of Baum-Welch, and the log10 probability of the training texts before it: Spark sums the tasks' expected counts."""
    states, width = model.emits.shape
    size = states + states * states + states * width + 1

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size)
        for ids, lengths, classes in _texts(batches):
            trains = np.array([not held_out(i) for i in ids])
            *counts, likelihood = expected_counts(model, lengths, classes, trains)
            sums += np.concatenate([*(x.ravel() for x in counts), [likelihood]])
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"k": pa.array(at), "x": pa.array(sums[at])})

    sums = np.zeros(size)
    for r in coded.select("ids", "lengths", "classes").mapInArrow(expect, "k long, x double").groupBy("k").agg(F.sum("x").alias("x")).collect():
        sums[r["k"]] = r["x"]
    starts, moves, emits = sums[:states], sums[states:states * (states + 1)].reshape(states, states), sums[states * (states + 1):-1].reshape(states, width)
    whole = emits.sum(0) + SMOOTH
    emits = emits + SMOOTH * whole / whole.sum()  # a class no state has seen keeps some probability
    return Model((starts + SMOOTH) / (starts + SMOOTH).sum(), (moves + SMOOTH) / (moves + SMOOTH).sum(1, keepdims=True), emits / emits.sum(1, keepdims=True)), float(sums[-1])


def train(coded: DataFrame, model: Model, tolerance: float, max_rounds: int) -> Model:
    """Rounds of Baum-Welch until one gains less than ``tolerance`` of the log probability, ``max_rounds`` at most."""
    before = None
    for _ in range(max_rounds):
        better, likelihood = _round(coded, model)
        if before is not None and likelihood - before <= tolerance * abs(before):
            return better
        model, before = better, likelihood
    return model


def log_likelihoods(model: Model, lengths: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """log10 probabilities of whole sequences by the scaled forward recursion, all sequences at once."""
    order = np.argsort(-lengths, kind="stable")
    begin, long = np.concatenate(([0], np.cumsum(lengths)[:-1]))[order], lengths[order]
    table, out = np.ascontiguousarray(model.emits.T), np.zeros(len(lengths))
    active = np.searchsorted(-long, -np.arange(1, int(long[0]) + 1), side="right")
    alpha = np.broadcast_to(model.start, (len(long), len(model.start)))
    for t, k in enumerate(active.tolist()):
        alpha = (alpha if t == 0 else alpha[:k] @ model.moves) * table[classes[begin[:k] + t]]
        scale = alpha.sum(1)
        out[:k] += np.log10(scale)
        alpha = alpha / scale[:, None]
    back = np.empty(len(lengths))
    back[order] = out
    return back


def _scored(coded: DataFrame, model: Model, total: int) -> DataFrame:
    shape = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def emit(held: list) -> pa.RecordBatch:
        ids = [i for h in held for i in h[0]]
        lengths, classes, known, base, within = (np.concatenate([h[i] for h in held]) for i in range(1, 6))
        found = log_likelihoods(model, lengths, classes)
        return pa.RecordBatch.from_pydict({
            "doc_id": pa.array(ids, pa.int64()), "held_out": pa.array([held_out(i) for i in ids]), "n_tokens": pa.array(lengths), "n_known": pa.array(known),
            "train_tokens": pa.array(np.full(len(ids), total)), "base_score": pa.array(base), "score": pa.array(found + within),
        })

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tokens = [], 0
        for ids, lengths, classes, known, base, within in _rows(batches):
            held.append((ids, np.array(lengths, np.int64), _unplanes(classes, np.uint16), np.array(known, np.int64), np.array(base), np.array(within)))
            tokens += sum(lengths)
            if tokens >= _GROUP_TOKENS:  # long texts of several blocks share their steps
                yield emit(held)
                held, tokens = [], 0
        if held:
            yield emit(held)

    return coded.mapInArrow(score, shape)


def score_documents(
    docs: DataFrame, states: int = 8, top_words: int = 1024, rest_classes: int = 1024, tolerance: float = TOLERANCE, max_rounds: int = MAX_ROUNDS, ranges: int | None = None,
) -> DataFrame:
    """Base and model scores of every document.

    ``top_words`` and ``rest_classes`` fix the size of the model; ``tolerance`` and
    ``max_rounds`` end its training. ``ranges`` is the number of hash ranges the
    words are dealt over, by default one for each ``_RANGE_BYTES`` of the blocks'
    words, and as many as shuffle partitions at least.
    """
    spark = docs.sparkSession
    blocks = materialize(_blocks(docs, rest_classes).withColumn("block", F.monotonically_increasing_id()), "markov-blocks")
    if ranges is None:
        held = blocks.agg(F.sum(F.length("words") + F.length("counts"))).first()[0] or 0
        ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held // _RANGE_BYTES))
    counted = materialize(_counted(_by_range(blocks, ranges)), "markov-counts")
    totals = counted.where(F.col("block").isNull())
    top = _top_words(totals, top_words)
    classes = Classes(np.array([w for w, _ in top], np.int64).view(np.uint64), rest_classes)
    n, v = _class_totals(totals, classes)
    coded = materialize(_coded(blocks, counted, ranges, classes, n, v), "markov-coded")
    drop_stored(blocks)
    drop_stored(counted)
    # coarse classes: the end, the most frequent words, the rest by suffix
    often = np.argsort(-n[1:1 + len(top)], kind="stable")[:COARSE] + 1
    coarse = 1 + len(often) + np.arange(classes.n) % 64
    coarse[0] = 0
    coarse[often] = 1 + np.arange(len(often))
    model = first_model(_coarse_bigrams(coded, coarse), coarse, n.astype(float), states)
    return _scored(coded, train(coded, model, tolerance, max_rounds), int(n.sum()))
