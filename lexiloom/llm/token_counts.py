"""Edit-aware token counts: a segment tree of pre-tokens per document.

A document's pre-tokens lie in leaves of ``LEAF`` each; every node of the tree
holds the characters and tokens below it. An edit is located by descending the
tree; the leaves it touches are cut anew together with the boundary context (a
pre-token before the edit that could have looked at the changed characters, and
leaves after it until cuts fall together again), only their pre-tokens are
encoded, and the sums on the paths to the root are updated.

The cut of the byte-level BPE is a function of the text from its start on, and
looks at most two characters past its end, hence the context of two characters.

Trees are rows (``leaf_chars``, ``leaf_tokens``) and can be stored between edits.
Both steps are row-local; edits of a separate table are joined once by
``doc_id``. Defined results: a null text is empty; null edits are none and null positions 0; positions
beyond the text are clipped; edits apply in order, each to the text the earlier
ones left; documents without edits keep their counts; repeated rows are counted
alike; extra columns are not returned.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public cutting pattern of the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF = 32
CONTEXT = 2
CACHE_ENTRIES = 500_000
EDITS = "array<struct<start:int,stop:int,replacement:string>>"
TREES = "doc_id long, text string, leaf_chars array<int>, leaf_tokens array<int>, n_pretokens long"


class Encoder:
    """Tokens of pre-tokens, with a bounded cache."""

    def __init__(self, vocabulary: str):
        import regex
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cut = regex.compile(PATTERN)
        self.cache: dict[str, int] = {}

    def counts(self, pieces: list[str]) -> list[int]:
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        known = self.cache
        found = list(map(known.get, pieces))
        if None in found:
            for i, p in enumerate(pieces):
                if found[i] is None:
                    found[i] = known[p] = len(self.encoding.encode_ordinary(p))
        return found


class Tree:
    """Sums over leaves; ``sums[1]`` is the root, a row holds characters and tokens."""

    def __init__(self, text: str, chars: np.ndarray, tokens: np.ndarray):
        self.n = len(chars)
        self.size = 1 << max(0, (self.n - 1).bit_length())
        self.sums = np.zeros((2 * self.size, 2), np.int64)
        self.sums[self.size:self.size + self.n, 0] = chars
        self.sums[self.size:self.size + self.n, 1] = tokens
        level = self.size
        while level > 1:
            self.sums[level // 2:level] = self.sums[level:2 * level].reshape(-1, 2, 2).sum(1)
            level //= 2
        ends = np.cumsum(chars)
        self.texts = [text[e - c:e] for e, c in zip(ends.tolist(), np.asarray(chars).tolist())]

    def locate(self, position: int) -> tuple[int, int]:
        """The leaf that holds a character, and the leaf's first character."""
        node, before = 1, 0
        while node < self.size:
            left = int(self.sums[2 * node, 0])
            if position < before + left:
                node *= 2
            else:
                before += left
                node = 2 * node + 1
        return node - self.size, before

    def put(self, leaf: int, text: str, tokens: int) -> None:
        self.texts[leaf] = text
        node = leaf + self.size
        change = np.array((len(text), tokens)) - self.sums[node]
        while node:
            self.sums[node] += change
            node //= 2

    def edit(self, start: int, stop: int, new: str, encoder: Encoder) -> int:
        """Replace characters; returns the number of pre-tokens encoded anew."""
        total = int(self.sums[1, 0])
        start = min(max(start, 0), total)
        stop = min(max(stop, start), total)
        # the pre-token before may have looked at what changes
        first, before = self.locate(max(0, min(start - CONTEXT - 1, total - 1)))
        first = min(first, self.n - 1)
        last, _ = self.locate(max(stop - 1, start - CONTEXT - 1, 0)) if total else (0, 0)
        last = min(max(last, first), self.n - 1)
        old = "".join(self.texts[first:last + 1])
        fresh = old[:start - before] + new + old[stop - before:]
        while True:
            after, k = "", last + 1
            while k < self.n and len(after) <= CONTEXT:
                after += self.texts[k]
                k += 1
            whole, pieces, at = fresh + after, [], 0
            while at < len(fresh):
                found = encoder.cut.match(whole, at)
                at = found.end()
                pieces.append(found[0])
            if at == len(fresh):
                break
            last += 1  # the cuts don't fall together here yet
            fresh += self.texts[last]
        counts = encoder.counts(pieces)
        room = last - first + 1
        per = -(-len(pieces) // room)
        for i in range(room):
            self.put(first + i, "".join(pieces[i * per:(i + 1) * per]), sum(counts[i * per:(i + 1) * per]))
        return len(pieces)

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def text(self) -> str:
        return "".join(self.texts)


def _leaves(text: str, encoder: Encoder) -> tuple[np.ndarray, np.ndarray, int]:
    pieces = encoder.cut.findall(text)
    if not pieces:
        return np.zeros(1, np.int32), np.zeros(1, np.int32), 0
    at = np.arange(0, len(pieces), LEAF)
    lengths = np.fromiter(map(len, pieces), np.int32, len(pieces))
    return np.add.reduceat(lengths, at), np.add.reduceat(np.array(encoder.counts(pieces), np.int32), at), len(pieces)


def _place(x) -> int:
    return 0 if x is None or x != x else int(x)


def build_trees(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, text`` with the leaves of each document's tree."""

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(vocabulary)
        for frame in frames:
            texts = [t or "" for t in frame["text"]]
            made = [_leaves(t, encoder) for t in texts]
            yield pd.DataFrame({
                "doc_id": frame["doc_id"].astype("Int64"), "text": texts, "leaf_chars": [m[0] for m in made], "leaf_tokens": [m[1] for m in made], "n_pretokens": [m[2] for m in made],
            })

    return docs.select("doc_id", "text").mapInPandas(build, TREES)


def attach_edits(trees: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits ``doc_id, seq, start, stop, replacement`` as a column of the trees; one document's edits form one row."""
    listed = edits.groupBy("doc_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("seq", "start", "stop", "replacement"))), lambda e: F.struct(e["start"].cast("int").alias("start"), e["stop"].cast("int").alias("stop"), e["replacement"].alias("replacement"))).alias("edits")
    )
    return trees.join(listed, "doc_id", "left")


def apply_edits(trees: DataFrame, vocabulary: str = VOCABULARY, keep_trees: bool = False) -> DataFrame:
    """Counts before and after the ``edits`` of each row; ``keep_trees`` also returns the new text and leaves."""
    shape = "doc_id long, n_pretokens long, n_edits long, n_encoded long, tokens_before long, tokens_after long"
    shape += ", text string, leaf_chars array<int>, leaf_tokens array<int>" * keep_trees

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(vocabulary)
        for frame in frames:
            rows = []
            for doc_id, text, chars, tokens, n, edits in frame.itertuples(index=False):
                before = int(np.sum(tokens))
                edits = [] if edits is None else edits
                if not len(edits):
                    rows.append((doc_id, n, 0, 0, before, before) + (text, chars, tokens) * keep_trees)
                    continue
                tree, encoded = Tree(text, np.asarray(chars), np.asarray(tokens)), 0
                for e in edits:
                    encoded += tree.edit(_place(e["start"]), _place(e["stop"]), e["replacement"] or "", encoder)
                kept = tree.sums[tree.size:tree.size + tree.n]
                rows.append((doc_id, n, len(edits), encoded, before, tree.tokens) + (tree.text, kept[:, 0].astype(np.int32), kept[:, 1].astype(np.int32)) * keep_trees)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in shape.split(", ")]).astype({"doc_id": "Int64"})

    return trees.select("doc_id", "text", "leaf_chars", "leaf_tokens", "n_pretokens", F.col("edits").cast(EDITS)).mapInPandas(apply, shape)


def redactions(trees: DataFrame, pattern: str, replacement: str) -> DataFrame:
    """The trees with one edit for each match of a pattern, last match first so that positions hold."""
    from pyspark.sql.types import StructField, StructType

    column = trees.sparkSession.createDataFrame([], f"edits {EDITS}").schema["edits"]
    shape = StructType([*trees.schema.fields, StructField("edits", column.dataType)])

    def mark(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import regex

        found = regex.compile(pattern)
        for frame in frames:
            edits = [[{"start": m.start(), "stop": m.end(), "replacement": replacement} for m in found.finditer(t)][::-1] for t in frame["text"]]
            yield frame.assign(edits=edits)

    return trees.mapInPandas(mark, shape)
