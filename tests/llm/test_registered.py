"""The corpus queries against SQL and plain versions on the smallest given tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from lexiloom.llm import decontaminate, mixing, quality_rules, registered

from . import plain
from .conftest import frame

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


def rows(table):
    table = table[sorted(table.columns)].astype(object)
    return sorted(map(repr, table.where(table.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(registered.SQL))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        duck.sql(f"CREATE VIEW {table} AS FROM '{FOLDER}/{table}.parquet'")
    assert rows(entry_points.queries()[name](spark, FOLDER).toPandas()) == rows(duck.sql(registered.SQL[name]).df())


def test_every_operator_is_registered():
    assert {name.split("_")[0] for name in registered.QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "quality rules" and "pipeline" in entry_points.queries()


@pytest.mark.parametrize("name", ["op1_token_counts", "op8_license_scan"])
def test_row_local_queries_return_every_row(spark, name):
    assert entry_points.queries()[name](spark, FOLDER).count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()


def test_pipeline_equals_a_plain_run(spark, corpus, corpus_rows):
    kept = {r.doc_id for r in quality_rules.kept_documents(corpus).collect()}
    docs = [(i, t) for i, t, _ in corpus_rows if i in kept]
    docs = list(dict.fromkeys(d for d, (_, least, _) in zip(docs, plain.components(docs)) if d[0] == least))
    docs = [(i, raw.decode("utf-8", "ignore")) for (i, _), (raw, _, _) in zip(docs, plain.cut_repeats([t for _, t in docs], corpus_pipeline.PASSAGE_BYTES))]
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()
    docs = [(i, t) for i, t in docs if plain.WORD.search(t) and not any(decontaminate.overlap(decontaminate.words(b.text), decontaminate.words(t)) > 0.5 for b in items)]
    stage = corpus
    for _, function in corpus_pipeline.STAGES:
        before, stage = stage, function(spark, stage, FOLDER).cache()
        if function is not corpus_pipeline.STAGES[-1][1]:
            assert stage.columns == corpus.columns
    assert sorted((r.doc_id, r.text) for r in stage.collect() if r.epoch == 1) == sorted(docs)
    assert len({i for i, _ in docs}) == len(docs) and (65, plain.prose(600, 120)) in docs
    assert stage.count() == mixing.mix(before, gain=0.5, max_repeats=4.0, budget=None).count()


def test_pipeline_of_nothing(spark, tmp_path):
    frame(spark, []).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
