"""What a step costs: how often texts are read, and what is dealt out."""

import math
import re

import pytest
from pyspark.sql import functions as F

from lexiloom import session
from lexiloom.operators import classifier, keywords, search, sections, terms
from lexiloom.plans import queries

TEXTS = [(i, f"alpha beta gamma w{i}a w{i}b. Delta epsilon w{i}c w{i}d.\n\nzeta eta alpha w{i % 3}e beta", "de" if i % 2 else "en", "src1") for i in range(40)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("scaling")
    spark.createDataFrame(TEXTS, "doc_id long, text string, lang string, source string").repartition(2).write.parquet(f"{path}/documents.parquet")
    return str(path)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_clustered_parts_do_not_grow_with_the_input(spark, folder, monkeypatch):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    monkeypatch.setattr(session, "CLUSTER_BYTES", max(1, session.stored_bytes(docs) // 9))
    assert session.stored_bytes(docs) > 0
    assert session.cluster(docs, "doc_id").rdd.getNumPartitions() in (9, 10)
    assert session.cluster(spark.createDataFrame([(1,)], "doc_id long"), "doc_id").rdd.getNumPartitions() == 4


def test_the_share_model_cuts_texts_once(spark, folder, monkeypatch):
    calls, cut = [], classifier._terms
    monkeypatch.setattr(classifier, "_terms", lambda text: calls.append(1) or cut(text))
    queries._share_model(spark, folder)
    assert len(calls) == 1


def test_unknown_terms_go_before_counting(spark):
    terms = spark.createDataFrame([("alpha", 1.0, [1.0, 0.0]), ("beta", 1.0, [0.0, 1.0])], "term string, idf double, coefficients array<double>")
    model = classifier.TopicModel(terms, ["en", "de"], [0.0, 0.0])
    docs = spark.createDataFrame([(1, "alpha alpha unseen words here"), (2, "nothing known in this text"), (2, "beta too"), (3, None)], "doc_id long, text string")
    for scored in (classifier.predict(model, docs), classifier.vectors(model, docs)):
        assert _plan(scored).count("BroadcastHashJoin") == 2
    found = {(r["doc_id"], r["predicted_category"]) for r in classifier.predict(model, docs).collect()}
    assert found == {(1, "en"), (2, "en"), (2, classifier.UNDETERMINED), (3, classifier.UNDETERMINED)}
    assert {(r["doc_id"], r["term"], r["tf"]) for r in classifier.vectors(model, docs).collect()} == {(1, "alpha", 2), (2, "beta", 1)}


def test_local_keywords_cut_texts_once(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ranked = keywords._local_scope_ranked(keywords._cleaned(docs, "text"), 5, (1, 2))
    assert _plan(ranked).count("Generate posexplode") == 1


def test_sections_are_dealt_as_texts(spark, folder, monkeypatch):
    stored, keep = {}, search.materialize
    monkeypatch.setattr(search, "materialize", lambda df, name: stored.setdefault(name, df) and keep(df, name))
    cut = sections.sections(spark.read.parquet(f"{folder}/documents.parquet"))
    asked = spark.createDataFrame([(1, "alpha epsilon")], "query_id long, query string")
    assert search.corpus_postings(cut, asked).count() > 0
    plan = _plan(stored["section-terms"])
    assert plan.count("Exchange") == 1 and plan.index("Generate explode") < plan.index("Exchange")


def test_norms_deal_terms_by_section_only_for_few_candidates(spark, folder, monkeypatch):
    stored, keep = [], search.materialize
    monkeypatch.setattr(search, "materialize", lambda df, name: stored.append(name) or keep(df, name))
    cut = sections.sections(spark.read.parquet(f"{folder}/documents.parquet"))
    found = []
    for word in ("alpha", "w7a"):
        asked = spark.createDataFrame([(1, word)], "query_id long, query string")
        found.append({(r["doc_id"], r["section_id"]): round(r["weight"], 9) for r in search.corpus_postings(cut, asked).collect()})
    assert stored.count("candidate-terms") == 1  # for the rare word only
    whole = search.corpus_tfidf(cut).where("term in ('alpha', 'w7a')").collect()
    for word, rows in zip(("alpha", "w7a"), found):
        assert rows == {(r["doc_id"], r["section_id"]): round(r["weight"], 9) for r in whole if r["term"] == word}


def test_sections_of_documents_are_dealt_as_texts(spark, folder, monkeypatch):
    stored, seen = [], search.weigh_in_large_scope
    monkeypatch.setattr(search, "weigh_in_large_scope", lambda tf, *rest: stored.append(_plan(tf)) or seen(tf, *rest))
    cut = sections.sections(spark.read.parquet(f"{folder}/documents.parquet"))
    assert search.section_tfidf(cut).where("term = 'alpha'").count() == 80
    assert stored[0].count("Exchange") == 1 and stored[0].index("Generate explode") < stored[0].index("Exchange")


def test_asked_postings_are_not_dealt_by_term(spark, folder):
    cut = search.materialize(sections.sections(spark.read.parquet(f"{folder}/documents.parquet")), "cut")
    asked = spark.createDataFrame([(1, 1, "alpha epsilon"), (2, 1, "alpha unseen"), (3, 2, "w2a"), (4, 99, "alpha"), (5, None, "alpha"), (6, 3, None)], "query_id long, doc_id long, query string")
    found = search._asked_postings(cut, asked)
    assert _plan(found).count("Exchange") == 2  # sections and queries, both as texts by document
    whole = search.section_tfidf(session.cluster(cut, "doc_id"), whole_texts=True).where("doc_id = 1 and term in ('alpha', 'epsilon') or doc_id = 2 and term = 'w2a'")
    rows = lambda df: sorted((r["doc_id"], r["section_id"], r["term"], r["tf"], r["df"], round(r["weight"], 9)) for r in df.collect())
    assert rows(found) == rows(whole) and len(rows(found)) == 4


def test_a_fit_counts_known_terms_only(spark, folder, monkeypatch):
    stored, keep = {}, classifier.materialize
    monkeypatch.setattr(classifier, "materialize", lambda df, name, *rest: stored.setdefault(name, df) and keep(df, name, *rest))
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", F.col("lang").alias("category"), "text")
    twice = docs.unionByName(docs.where("doc_id = 7"))  # a key may repeat
    fitted = classifier.fit(twice, vocabulary_size=20, max_iterations=20, test_share=0.1)
    assert "Aggregate" not in _plan(stored["cut-terms"]) and "Exchange" not in _plan(stored["cut-terms"])
    assert _plan(stored["known-terms"]).count("Exchange hash") == 1
    counted = classifier.training_terms(fitted.split.where("split = 'train'"), ["doc_id", "category"])
    totals = counted.groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("df"))
    best = {r["term"]: r["df"] for r in totals.orderBy(F.desc("total"), "term").limit(20).collect()}
    idf = {r["term"]: r["idf"] for r in fitted.model.terms.collect()}
    assert idf.keys() == best.keys()
    for term, df in best.items():
        assert abs(idf[term] - (math.log((1 + fitted.n_train) / (1 + df)) + 1)) < 1e-9


def test_reports_of_pages_are_dealt_by_stored_size(spark, tmp_path, monkeypatch):
    rows = [(i, t, f"Wind report {i} of page {t}.\nTurbines feed the harbour grid {i}a{t}.") for i in range(60) for t in range(3)]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    stored = session.stored_bytes(spark.read.parquet(f"{tmp_path}/conversations.parquet"))
    monkeypatch.setattr(session, "CLUSTER_BYTES", -(-stored // 9))
    made = queries.document_report_paged(spark, str(tmp_path))
    assert re.search(r"hashpartitioning\(doc_id#\w+, (9|10)\), REPARTITION_BY_NUM", _plan(made))
    assert re.search(r"hashpartitioning\(doc_id#\w+, _word#\d+, (\d\d|[5-9])\), REPARTITION_BY_NUM", _plan(made))
    # four words and five, the number of the document, three of pages and three of both
    assert {r["doc_id"]: r["unique_word_count"] for r in made.collect()} == {i: 15 if i < 3 else 16 for i in range(60)}


ODD = [(7, "alpha beta alpha gamma"), (7, "gamma delta alpha"), (8, ""), (9, None), (10, "zeta alpha zeta alpha"), (None, "omega alpha omega"), (None, "omega beta")]


def test_terms_are_dealt_once_for_a_block(spark):
    docs = spark.createDataFrame([r[:2] for r in TEXTS] + ODD, "doc_id long, text string")
    cut = keywords._keyword_terms(F.col("text"))
    index = terms.materialize(terms.term_index(docs, ["doc_id"], cut), "index")
    parts = session.block_parts(index)
    assert index.where("_n is not null").groupBy(session.BLOCK, "term").count().where("count > 1").isEmpty()
    known = terms.index_with_frequency(index)
    plan = _plan(known)
    # texts of terms to the shares and numbers back, nothing else
    assert plan.count("Exchange hash") == 2 and plan.count("BroadcastExchange") == 0
    tf = terms.term_frequency(docs, ["doc_id"], cut)
    df = {r["term"]: r["count"] for r in tf.groupBy("term").count().collect()}
    rows = lambda found: sorted(map(tuple, found), key=str)
    assert rows(known.select("doc_id", "term", "tf", "df").collect()) == rows((r["doc_id"], r["term"], r["tf"], df[r["term"]]) for r in tf.collect())
    assert known.select(session.BLOCK).distinct().count() <= parts


def test_every_block_has_its_own_partition(spark):
    rows = session.cluster(spark.range(2000), "id", parts=7).select("id")
    dealt = rows.select(session.spread(spark, F.hash("id"), 7).alias("at")).distinct()
    assert dealt.count() == 7
    assert dealt.repartition(7, "at").select(F.spark_partition_id().alias("p")).distinct().count() == 7


def test_corpus_keywords_deal_no_terms_by_row(spark, folder):
    found = keywords.keywords_corpus(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))
    dealt = re.findall(r"Exchange (hashpartitioning\([^)]*\)|\w+)", _plan(found))
    assert dealt and not any("term" in x for x in dealt)
    counts = keywords.keyword_term_counts(spark.read.parquet(f"{folder}/documents.parquet")).groupBy("doc_id").count().collect()
    per_doc = {r["doc_id"]: r["count"] for r in found.groupBy("doc_id").count().collect()}
    assert per_doc == {r["doc_id"]: min(15, r["count"]) for r in counts}


def test_corpus_norms_deal_no_terms_by_section(spark, folder, monkeypatch):
    stored, keep = {}, search.materialize
    monkeypatch.setattr(search, "materialize", lambda df, name: stored.setdefault(name, df) and keep(df, name))
    cut = search.materialize(sections.sections(spark.read.parquet(f"{folder}/documents.parquet")), "cut")
    asked = spark.createDataFrame([(1, "alpha zeta")], "query_id long, query string")
    found = search.corpus_postings(cut, asked)
    assert "document-frequency" not in stored and session.BLOCK in stored["section-terms"].columns
    whole = search.corpus_tfidf(cut).where("term in ('alpha', 'zeta')")
    rows = lambda df: sorted((r["doc_id"], r["section_id"], r["term"], r["tf"], r["df"], round(r["weight"], 9)) for r in df.collect())
    assert rows(found) == rows(whole) and len(rows(found)) == 120


def test_dots_out_of_reach_are_not_stored(spark, monkeypatch):
    stored, keep = {}, search.materialize
    monkeypatch.setattr(search, "materialize", lambda df, name: stored.setdefault(name, keep(df, name)))
    postings = keep(spark.createDataFrame(
        [(i, 1, "rare", 1.0 + i) for i in range(3)] + [(i, 1, "usual", 0.5) for i in range(50)] + [(i, 1, "common", 0.01) for i in range(90)],
        "doc_id long, section_id long, term string, weight double"), "postings")
    asked = keep(spark.createDataFrame(
        [(1, "rare", 3, 1.0, 3.0, 1e-8), (1, "usual", 50, 2.5, 1.25, 1e-8), (1, "common", 90, 1.0, 0.01, 1e-8)],
        "query_id long, term string, df long, _query double, _bound double, _margin double"), "asked")
    found = search._within_reach(postings, asked, 2, 1).orderBy(F.desc("_dot")).limit(2).collect()
    assert [(r["doc_id"], round(r["_dot"], 6)) for r in found] == [(2, 4.26), (1, 3.26)]
    assert stored["partial-dots"].count() < 50


def test_fallback_of_the_corpus_moves_no_section_to_its_hits(spark, folder):
    cut = search.materialize(sections.sections(spark.read.parquet(f"{folder}/documents.parquet")), "cut")
    asked = spark.createDataFrame([(1, "lph elt")], "query_id long, query string")
    ranked = search.rank_fallback(cut, asked, asked.select("query_id").limit(0), 3, "corpus")
    assert [r["rank"] for r in ranked.orderBy("rank").collect()] == [1, 2, 3]
    assert "Exchange" not in _plan(ranked)
