"""Benchmark decontamination: BM25 over an inverted index of test items with block-max WAND.

Every document is read in overlapping passages, each of which is a query. An
item's BM25 impacts are divided by the score that the item gives itself, so the
threshold is a share of the item found in a passage. Passages are at least twice
as long as the longest item and overlap by half: an item always lies whole in
one. All items at or above the threshold are retrieved: first, for all passages
of a text at once, the impacts of each item's rarer terms are added up, and what
its most common terms could add at most; where that reaches the threshold, WAND
walks the postings with the maxima of terms and of blocks. Each retrieved pair is verified in the passage: shares of the
question's and of the answer's word trigrams.

The index travels to the tasks. It is built for ``max_index_mb`` of test texts
at a time; a larger test set is read in several shards, each against all
documents, with statistics over the whole set. Documents are never shuffled;
only retrieved pairs are.

Words are lower-cased runs of letters and digits. Defined results: null and
empty texts and items match nothing; repeated rows of a document fall together,
so do passages (the best one counts); equal items are each reported; items
under three words are compared by their words; columns other than ``doc_id,
text`` and ``item_id, text`` are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
K1, B = 0.9, 0.4
BLOCK = 16
GRAM = 3
MIN_PASSAGE = 128
#: Share of an item that its most common terms may make up without being looked up for every passage.
CERTAIN = 0.25
PAIRS = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Split after the last question mark, else at the last line, else at two thirds of the words."""
    for mark in ("?", "\n"):
        head, found, tail = text.strip().rpartition(mark)
        if found and words(head) and words(tail):
            return words(head), words(tail)
    both = words(text)
    cut = max(1, len(both) * 2 // 3)
    return both[:cut], both[cut:] or both


def grams(split: list[str]) -> set[tuple[str, ...]]:
    n = min(GRAM, len(split))
    return {tuple(split[i:i + n]) for i in range(len(split) - n + 1)} if n else set()


def overlap(wanted: list[str], passage: list[str]) -> float:
    sought = grams(wanted)
    if not sought:
        return 0.0
    n = len(next(iter(sought)))
    return len(sought & {tuple(passage[i:i + n]) for i in range(len(passage) - n + 1)}) / len(sought)


class Index:
    """Postings by item number with normalised impacts, their maxima by term and by block."""

    def __init__(self, items: list[tuple[int, str]], df: dict[str, int], n_items: int, mean_length: float, threshold: float = 1.0):
        self.ids = [i for i, _ in items]
        self.parts = [question_and_answer(t) for _, t in items]
        split = [words(t) for _, t in items]
        self.terms = {w: k for k, w in enumerate(sorted({w for s in split for w in s}))}
        postings: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        for item, s in enumerate(split):
            norm = K1 * (1 - B + B * len(s) / max(mean_length, 1e-9))
            impacts = {w: math.log(1 + (n_items - df[w] + 0.5) / (df[w] + 0.5)) * tf / (tf + norm) for w, tf in Counter(s).items()}
            whole = math.fsum(impacts.values())
            for w, x in impacts.items():
                postings[self.terms[w]].append((item, x / whole))
        self.items = [[i for i, _ in p] for p in postings]
        self.impacts = [[x for _, x in p] for p in postings]
        self.most = np.array([max(p) for p in self.impacts]) if postings else np.zeros(0)
        self.block_most = [[max(p[k:k + BLOCK]) for k in range(0, len(p), BLOCK)] for p in self.impacts]
        self.block_last = [[p[min(k + BLOCK, len(p)) - 1] for k in range(0, len(p), BLOCK)] for p in self.items]

        self._split(min(CERTAIN, threshold / 2))

    def _split(self, most: float) -> None:
        """Set apart each item's smallest impacts, up to ``most`` in sum; the essential rest lies flat by term."""
        rows = sorted((item, x, t) for t, (own, xs) in enumerate(zip(self.items, self.impacts)) for item, x in zip(own, xs))
        self.spare, essential, held = np.zeros(len(self.ids)), [], 0.0
        for k, (item, x, t) in enumerate(rows):
            held = (0.0 if not k or rows[k - 1][0] != item else held) + x
            if held <= most:
                self.spare[item] = held
            else:
                essential.append((t, item, x))
        essential.sort()
        self.essential_items = np.array([i for _, i, _ in essential], np.int64)
        self.essential_impacts = np.array([x for _, _, x in essential])
        edges = np.searchsorted(np.array([t for t, _, _ in essential], np.int64), np.arange(len(self.terms) + 1))
        self.essential_first, self.essential_count = edges[:-1], np.diff(edges)

    def reachable(self, cells: np.ndarray, terms: np.ndarray, threshold: float) -> np.ndarray:
        """The cells (passages) some item may reach the threshold in, from their distinct terms.

        An item's score is at most its essential impacts found plus what was set
        apart; items without an essential term in the cell stay below.
        """
        n = self.essential_count[terms]
        if not n.sum():
            return np.zeros(0, np.int64)
        at = np.repeat(self.essential_first[terms] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        pairs, where = np.unique(np.repeat(cells, n) * len(self.ids) + self.essential_items[at], return_inverse=True)
        bound = np.bincount(where, weights=self.essential_impacts[at]) + self.spare[pairs % len(self.ids)]
        return np.unique(pairs[bound >= threshold - 1e-9] // len(self.ids))

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All items whose score over the distinct terms reaches the threshold."""
        at = dict.fromkeys(terms, 0)
        block = dict.fromkeys(terms, 0)
        active, found, slack = list(terms), [], 1e-9
        most, items = self.most, self.items
        while active:
            active.sort(key=lambda t: items[t][at[t]])
            bound, pivot = 0.0, -1
            for k, t in enumerate(active):
                bound += most[t]
                if bound >= threshold - slack:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = items[active[pivot]][at[active[pivot]]]
            while pivot + 1 < len(active) and items[active[pivot + 1]][at[active[pivot + 1]]] == item:
                pivot += 1
            bound, reach = 0.0, None
            for t in active[:pivot + 1]:
                b, last = block[t], self.block_last[t]
                while b < len(last) and last[b] < item:
                    b += 1
                block[t] = b
                if b < len(last):
                    bound += self.block_most[t][b]
                    reach = last[b] if reach is None else min(reach, last[b])
            if bound >= threshold - slack:
                if items[active[0]][at[active[0]]] == item:
                    score = math.fsum(self.impacts[t][at[t]] for t in active[:pivot + 1])
                    if score >= threshold - slack:
                        found.append((item, score))
                    target = item + 1
                else:
                    target = item
            else:
                # no item up to the end of the shortest block, or to the next list, can reach it
                target = (reach if reach is not None else item) + 1
                if pivot + 1 < len(active):
                    target = min(target, items[active[pivot + 1]][at[active[pivot + 1]]])
                target = max(target, item + 1)
            for t in active[:pivot + 1]:
                own, k = items[t], at[t]
                b, last = block[t], self.block_last[t]
                while b < len(last) and last[b] < target:
                    b += 1
                block[t] = b
                k = max(k, b * BLOCK)
                while k < len(own) and own[k] < target:
                    k += 1
                at[t] = k
            active = [t for t in active if at[t] < len(items[t])]
        return found


def _passages(n_words: int, size: int) -> np.ndarray:
    """Starts of passages of ``size`` words, overlapping by half, that cover the text."""
    step = size // 2
    return np.arange(0, max(1, n_words - size + step), step)


def leaks(
    docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, min_overlap: float = 0.5, max_index_mb: int = 32,
) -> DataFrame:
    """``doc_id, item_id`` of verified pairs, with the best score and overlaps of the pair's passages."""
    tests = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    size = tests.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    shards = max(1, math.ceil(size / (max_index_mb * 1_000_000)))
    stats = _statistics(tests)
    out = None
    for shard in range(shards):
        part = tests.where(F.pmod(F.xxhash64("text"), F.lit(shards)) == shard) if shards > 1 else tests
        rows = [(r["item_id"], r["text"]) for r in part.collect() if words(r["text"])]
        found = docs.select("doc_id", "text").mapInPandas(_finder(rows, stats, threshold, min_overlap), PAIRS)
        out = found if out is None else out.unionByName(found)
    return out.groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in ("score", "question_overlap", "answer_overlap")])


def _statistics(tests: DataFrame) -> tuple[dict[str, int], int, float]:
    """Document frequency, number of items and mean length over all items; as large as the items' vocabulary."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n, length = Counter(), 0, 0
        for frame in frames:
            for split in map(words, frame["text"]):
                if split:
                    df.update(set(split))
                    n, length = n + 1, length + len(split)
        keys = list(df)
        yield pd.DataFrame({"word": [None, *keys], "n": [n, *[df[k] for k in keys]], "length": [length, *[0] * len(keys)]})

    rows = tests.select("text").mapInPandas(count, "word string, n long, length long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("length").alias("length")).collect()
    whole = next((r for r in rows if r["word"] is None), None)
    n = whole["n"] if whole else 0
    return {r["word"]: r["n"] for r in rows if r["word"] is not None}, n, (whole["length"] / n if n else 0.0)


def _finder(rows, stats, threshold, min_overlap):
    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Index(rows, *stats, threshold)
        longest = max((len(q) + len(a) for q, a in index.parts), default=0)
        size = max(MIN_PASSAGE, 2 * longest)
        known, n_terms = index.terms, max(1, len(index.terms))
        for frame in frames:
            out = []
            for doc_id, text in zip(frame["doc_id"], frame["text"]):
                if not known or not text:
                    continue
                split = words(text)
                ids = np.fromiter((known.get(w, -1) for w in split), np.int64, len(split))
                at = np.flatnonzero(ids >= 0)
                if not len(at):
                    continue
                terms, step = ids[at], size // 2
                n_passages = len(_passages(len(split), size))
                # a word lies in the passage that starts in its half and in the one before
                half = at // step
                cells = np.concatenate([np.minimum(half, n_passages - 1), half[half > 0] - 1])
                both = np.concatenate([terms, terms[half > 0]])
                fits = cells < n_passages
                distinct = np.unique(cells[fits] * n_terms + both[fits])
                for p in index.reachable(distinct // n_terms, distinct % n_terms, threshold).tolist():
                    lo, hi = np.searchsorted(distinct, (p * n_terms, (p + 1) * n_terms))
                    hits = index.search((distinct[lo:hi] - p * n_terms).tolist(), threshold)
                    if hits:
                        passage = split[p * step:p * step + size] if p < n_passages - 1 else split[p * step:]
                        for item, score in hits:
                            q, a = (overlap(part, passage) for part in index.parts[item])
                            if q >= min_overlap and a >= min_overlap:
                                out.append((doc_id, index.ids[item], score, q, a))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PAIRS.split(", ")]).astype({"doc_id": "Int64", "item_id": "Int64"})

    return find


def decontaminate(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The documents, all columns, that leak no item. Every row is judged by its own text, whatever its id."""
    key = F.xxhash64("text")
    found = leaks(docs.select(key.alias("doc_id"), "text"), benchmark, **settings).select(F.col("doc_id").alias("_leaks")).distinct()
    whole = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), key.alias("_text"))
    return whole.join(found, F.col("_text") == F.col("_leaks"), "left_anti").select("_row.*")
