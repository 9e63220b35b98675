"""Packing by power-of-two decomposition.

A document's tokens, an end token after them, are cut into pieces whose lengths
are powers of two: as many of ``max_length`` as it has, then one for each binary
digit of the rest, the largest first. Every piece is a sequence of its own and
pieces of equal length share a bucket, so a batch drawn from one bucket is full:
no sequence crosses documents, and none is padded.

Row-local: no shuffle, nothing gathered, and a hot source or group costs nothing
extra. ``write_buckets`` stores one folder for each length.

Defined results: a null text is an empty one, which is the end token alone; very
long texts are encoded whole, in one task, and only their pieces are rows;
repeated rows and equal texts (ties) are packed once each; a null ``doc_id``
stays null; an empty table gives an empty result; extra columns are not read, of
whatever name. A special token's text counts as that token, as the tokenizer has it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import in_parts
from .token_counts import PATTERN, VOCABULARY

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
END = 1
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long"


class Tokens:
    """Token ids of texts: the rank file's encoder, which gives the same ids in a fifth of the time, and the tokenizer itself for texts that spell a special token."""

    def __init__(self, tokenizer: str, ranks: str):
        import base64

        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks, "rb") as lines:
            known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.plain = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=known, special_tokens={})
        self.whole = Tokenizer.from_file(tokenizer)
        self.special = [t.content.encode() for t in self.whole.get_added_tokens_decoder().values() if t.special]

    def ids(self, raw: bytes) -> list[int]:
        text = raw.decode("utf-8", "replace")
        if any(s in raw for s in self.special):
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.plain.encode_ordinary(text)


def binary_lengths(n: int, max_length: int) -> list[int]:
    """Lengths of the pieces of ``n`` tokens, in order."""
    rest = n % max_length
    return [max_length] * (n // max_length) + [1 << b for b in range(max_length.bit_length() - 2, -1, -1) if rest >> b & 1]


def decompose(docs: DataFrame, max_length: int = 2048, end: int = END, tokenizer: str = TOKENIZER, ranks: str = VOCABULARY) -> DataFrame:
    """``doc_id, start, length, ids, doc_tokens, sequence_id, offset`` for each piece.

    ``ids`` are little-endian unsigned 32-bit numbers. ``sequence_id`` is unique
    within the result; ``offset`` is 0, since a piece is a whole sequence.
    """
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Tokens(tokenizer, ranks)
        shape = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64())])
        for keys, texts in in_parts(batches):
            rows = {c: [] for c in shape.names}
            for key, raw in zip(keys, texts):
                ids = np.array([*encoder.ids(raw), end], "<u4").tobytes()
                n = len(ids) // 4
                lengths = binary_lengths(n, max_length)
                starts = np.cumsum([0, *lengths[:-1]]).tolist()
                rows["doc_id"] += [key] * len(lengths)
                rows["start"] += starts
                rows["length"] += lengths
                rows["ids"] += [ids[4 * s:4 * (s + k)] for s, k in zip(starts, lengths)]
                rows["doc_tokens"] += [n] * len(lengths)
            yield pa.RecordBatch.from_pydict(rows, schema=shape)

    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)
    return pieces.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Store the pieces in one folder for each length, ``bucket=<length>``."""
    pieces.withColumn("bucket", F.col("length")).write.partitionBy("bucket").parquet(path)
