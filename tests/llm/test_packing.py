"""Packing against the tokenizer itself and an exact round trip."""

import zlib

import numpy as np
import pytest

from lexiloom.llm import packing, registered

from .conftest import frame
from .test_registered import FOLDER


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.TOKENIZER)


def documents(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.sequence_id)):
        out.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    return out


def test_every_piece_is_a_full_sequence_of_its_document(spark, corpus, corpus_rows, tokenizer):
    odd = [(70, "a <|endoftext|> b", "s"), (71, "   \r\n\t x  y", "s"), (72, "ａ１² 中文字 🙂" * 30, "s"), (73, "word" * 3000, "s"), (74, "it's we'LL I'm\n\n\n", "s")]
    docs = corpus.unionByName(frame(spark, odd))
    rows = packing.decompose(docs, max_length=64).collect()
    ids = lambda t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
    whole = sorted(repr((i, ids(t))) for i, t, _ in corpus_rows + odd)
    found = []
    for (doc, n), own in documents(rows).items():
        at, text = 0, []
        for r in own:
            if at == n:  # the next row with this id
                found.append(repr((doc, text)))
                at, text = 0, []
            assert r.start == at and r.offset == 0 and len(r.ids) == 4 * r.length <= 4 * 64 and not r.length & (r.length - 1)
            at += r.length
            text += np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert at == n
        found.append(repr((doc, text)))
    assert sorted(found) == whole
    assert len({r.sequence_id for r in rows}) == len(rows)


def test_lengths_are_the_binary_digits():
    assert packing.binary_lengths(2 * 2048 + 7, 2048) == [2048, 2048, 4, 2, 1]
    for n in range(1, 300):
        lengths = packing.binary_lengths(n, 32)
        assert sum(lengths) == n and lengths == sorted(lengths, reverse=True) and len(set(lengths) - {32}) == len([k for k in lengths if k != 32])


def test_query_against_the_tokenizer(spark, tokenizer):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = registered.op13_packing(spark, FOLDER).collect()
    assert {r.doc_id for r in rows} == set(texts) and len({r.sequence_id for r in rows}) == len(rows)
    for r in rows:
        ids = [*tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 1] if r.start == 0 else ids  # noqa: F821
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes())


def test_buckets_on_disk(spark, corpus, tmp_path):
    pieces = packing.decompose(corpus, max_length=128)
    packing.write_buckets(pieces, f"{tmp_path}/buckets")
    read = spark.read.parquet(f"{tmp_path}/buckets")
    assert read.count() == pieces.count() and read.where("bucket <> length").count() == 0


def test_edges(spark, nothing, blank):
    assert packing.decompose(nothing).count() == 0
    assert [(r.length, r.doc_tokens) for r in packing.decompose(blank).collect()] == [(1, 1)] * 3
    with pytest.raises(ValueError):
        packing.decompose(nothing, max_length=100)
