import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import classifier, evaluation, keywords, search, sections, splitting, statistics, terms
from lexiloom.plans import report
from lexiloom.sources import labelled as labelled_source
from lexiloom.sources import pages as page_source

from . import plain
from .conftest import ENERGY, KITCHEN


def by_key(df, *keys):
    out = defaultdict(list)
    for row in df.collect():
        out[tuple(row[k] for k in keys) if len(keys) > 1 else row[keys[0]]].append(row)
    return out


# --- statistics ---------------------------------------------------------------

def test_statistics(spark, library):
    rows = {r.doc_id: r for r in statistics.document_statistics(library).collect()}
    energy = rows[1]
    assert energy.paragraph_count == 4 and energy.sentence_count == 8 and energy.word_count == len(plain.words(ENERGY))
    assert energy.unique_word_count == len(set(plain.words(ENERGY))) <= energy.word_count
    assert energy.char_count_with_spaces == len(ENERGY) > energy.char_count_no_spaces == len("".join(ENERGY.split()))
    assert energy.lexical_diversity_percent == round(100 * energy.unique_word_count / energy.word_count, 2)
    assert energy.reading_time_minutes == round(energy.word_count / 200, 1)
    empty = rows[3]
    assert (empty.word_count, empty.sentence_count, empty.lexical_diversity_percent, empty.avg_words_per_sentence) == (0, 0, 0.0, 0.0)
    paged = statistics.document_statistics(library, page_count=F.lit(7)).first()
    assert paged.page_count == 7
    assert statistics.document_statistics(library, page_count=F.lit(0)).first().page_count == 1


def test_rounding_is_half_up(spark):
    docs = spark.createDataFrame([(n, "word " * n) for n in (10, 30, 50, 200, 209, 210)], "doc_id long, text string")
    minutes = {r.doc_id: r.reading_time_minutes for r in statistics.document_statistics(docs).collect()}
    assert minutes == {10: 0.1, 30: 0.2, 50: 0.3, 200: 1.0, 209: 1.0, 210: 1.1}


# --- keywords -----------------------------------------------------------------

def plain_keywords(rows, text, top_n):
    weights = plain.Tfidf([plain.keyword_terms(r) for r in rows]).vector(plain.keyword_terms(text))
    best = sorted(weights.items(), key=lambda kv: (-round(kv[1], 9), kv[0]))[:top_n]
    return [(t, round(w / best[0][1], 4), round(w, 4)) for t, w in best]


def test_keywords_local_by_paragraph_sentence_and_text(spark):
    one_block = KITCHEN.replace("\n\n", ". ")
    crossing = "solar grid solar\n\ngrid solar grid\n\nsolar panel"
    docs = spark.createDataFrame(
        [(1, ENERGY), (2, KITCHEN), (3, one_block), (4, "single block of plain words here"), (5, crossing)], "doc_id long, text string"
    )
    found = by_key(keywords.keywords_local(docs, 10).orderBy("doc_id", "rank"), "doc_id")
    sentences = ["Bread and patience.", *[s for s in one_block.split(". ")[1:]]]
    rows = {1: ENERGY.split("\n\n"), 2: KITCHEN.split("\n\n"), 3: sentences, 4: ["single block of plain words here"] * 2, 5: crossing.split("\n\n")}
    texts = {1: ENERGY, 2: KITCHEN, 3: one_block, 4: "single block of plain words here", 5: crossing}
    for doc in rows:
        got = [(r.keyword, r.score, r.tfidf_raw) for r in found[doc]]
        expected = plain_keywords(rows[doc], texts[doc], 10)
        assert [g[0] for g in got] == [e[0] for e in expected], doc
        assert [g[1:] for g in got] == [pytest.approx(e[1:], abs=1.01e-4) for e in expected]
        assert got[0][1] == 1.0 and [r["rank"] for r in found[doc]] == list(range(1, len(got) + 1))
    scopes = {r.doc_id: (r.scope, r.n) for r in keywords.keyword_scope(docs).collect()}
    assert scopes == {1: ("paragraph", 4), 2: ("paragraph", 3), 3: ("sentence", len(sentences)), 4: ("text", 2), 5: ("paragraph", 3)}


def test_keyword_occurrences_and_types(spark):
    docs = spark.createDataFrame([(1, "wind-farm wind of farms\n\nwind rises, farms wind wind\n\nrises")], "doc_id long, text string")
    found = {r.keyword: r for r in keywords.keywords_local(docs, 50).collect()}
    assert found["wind"].frequency == 5 and found["wind"].ngram_type == "unigram"
    assert found["wind farms"].frequency == 1 and found["wind farms"].ngram_type == "bigram"
    assert "farms wind" in found and found["farms wind"].frequency == 1


def test_no_keywords_for_short_texts_and_counts_for_texts_without_vocabulary(spark):
    docs = spark.createDataFrame(
        [(1, ""), (2, "a the is"), (3, "two words"), (4, "2024 2024 a1b2c 12 x 2025"), (5, "don't don't won't of the isn't")],
        "doc_id long, text string",
    )
    found = by_key(keywords.keywords_local(docs).orderBy("rank"), "doc_id")
    assert {1, 2, 3}.isdisjoint(found)
    assert [(r.keyword, r.score, r.frequency, r["rank"]) for r in found[4]] == [
        ("2024", 1.0, 2, 1), ("a1b2c", 0.5, 1, 2), ("2025", 0.5, 1, 3)
    ]
    assert 5 in found and found[5][0].ngram_type == "unigram"


def test_unigram_and_bigram_ranges(spark, library):
    assert {r.ngram_type for r in keywords.keywords_local(library, 30, (2, 2)).where("doc_id = 1").collect()} == {"bigram"}
    assert {r.ngram_type for r in keywords.keywords_local(library, 30, (1, 1)).where("doc_id = 1").collect()} == {"unigram"}
    assert keywords.keywords_local(library, 0).where("doc_id = 1").count() == 15


def test_keywords_corpus(spark):
    texts = {i: f"{ENERGY if i % 2 else KITCHEN} shared shared item{i} batch" + " extra" * (i % 3) for i in range(8)}
    texts[8] = "of the"
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = by_key(keywords.keywords_corpus(docs, 12).orderBy("doc_id", "rank"), "doc_id")
    assert 8 not in found
    for doc in range(8):
        expected = plain_keywords(list(texts.values()), texts[doc], 12)
        assert [r.keyword for r in found[doc]] == [e[0] for e in expected]
        assert [r.tfidf_raw for r in found[doc]] == pytest.approx([e[2] for e in expected], abs=1.01e-4)
    target = spark.createDataFrame([(1, "shared bread unseen turbines bread")], "doc_id long, text string")
    got = keywords.keywords_corpus(target, 5, background=docs).orderBy("rank").collect()
    assert [r.keyword for r in got] == [e[0] for e in plain_keywords(list(texts.values()), "shared bread unseen turbines bread", 5)]
    alone = keywords.keywords_corpus(docs, 5, background=docs.limit(1))
    assert sorted(map(str, alone.collect())) == sorted(map(str, keywords.keywords_local(docs, 5).collect()))
    digits = spark.createDataFrame([(1, "1234 5678 1234 5678 1234")], "doc_id long, text string")
    assert [(r.keyword, r.frequency) for r in keywords.keywords_corpus(digits).orderBy("rank").collect()] == [("1234", 3), ("5678", 2)]


@pytest.mark.parametrize("head_rows", [1, 3, 1000])
def test_head_and_tail_of_a_frequency_join_are_complete(spark, head_rows):
    junk = "j" * 300
    data = [("hot", i) for i in range(50)] + [(f"k{i}", i) for i in range(20)] + [(junk, i) for i in range(30)]
    rows = spark.createDataFrame(data, "term string, v int")
    lookup = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    joined = terms.attach_by_frequency(rows, lookup, ["term"], "df", head_rows)
    assert sorted((r.term, r.v, r.df) for r in joined.collect()) == sorted(
        (t, v, {"hot": 50, junk: 30}.get(t, 1)) for t, v in data
    )


# --- sections -----------------------------------------------------------------

def test_sections_keep_paragraph_positions(spark):
    docs = spark.createDataFrame([(1, "Short\n\nA paragraph that is long enough\n\nno\n\nAnother paragraph, also long"), (2, "tiny\n\nbits"), (3, " ")],
                                 "doc_id long, text string")
    got = [(r.doc_id, r.section_id, r.page_number, r.text) for r in sections.sections(docs).orderBy("doc_id", "section_id").collect()]
    assert got == [(1, 2, 1, "A paragraph that is long enough"), (1, 4, 1, "Another paragraph, also long"), (2, 1, 1, "tiny\n\nbits")]


def test_paged_sections_are_numbered_without_gaps(spark):
    rows = [(1, 1, "Head\n\nThe first long paragraph."), (1, 2, "  "), (1, 3, "Exactly15 chars\n\nSixteen chars ok"), (1, 301, "A page far behind the others."),
            (2, 2, "b"), (2, 1, "a"), (3, 1, "")]
    pages = spark.createDataFrame(rows, "doc_id long, page_number long, text string")
    got = [(r.doc_id, r.section_id, r.page_number, r.text) for r in sections.sections_paged(pages).orderBy("doc_id", "section_id").collect()]
    assert got == [(1, 1, 1, "The first long paragraph."), (1, 2, 3, "Sixteen chars ok"), (1, 3, 301, "A page far behind the others."), (2, 1, 1, "a\n\nb")]
    assert {r.doc_id: r.section_count for r in sections.section_counts(sections.sections_paged(pages)).collect()} == {1: 3, 2: 1}
    capped = sections.sections_paged(pages, page_cap=300)
    assert capped.where("page_number > 300").count() == 0 and capped.count() == 3


# --- search -------------------------------------------------------------------

QUERIES = ["turbine blades and drone", "harbour grid storage", "bread dough", "of the", "zzz bin", "", "   ", "ird rust", "Steam keeps"]


@pytest.fixture(scope="module")
def cut(spark):
    docs = spark.createDataFrame([(1, ENERGY), (2, KITCHEN), (3, "the of and with"), (4, "crust-free thirds: turbines of bread & ird")], "doc_id long, text string")
    return sections.sections(docs).cache()


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, query string").cache()


@pytest.fixture(scope="module")
def targeted(cut, asked):
    """Every query put to every document of the small fixture."""
    return asked.join(cut.select("doc_id").distinct()).cache()


def plain_search(texts, query, top_k, threshold):
    """texts: {key: text} of one scope; gives [(key, score)]."""
    model = plain.Tfidf([plain.search_terms(t) for t in texts.values()])
    vector = model.vector(plain.search_terms(query))
    if not query.strip():
        return []
    if vector:
        scores = {k: plain.cosine(vector, model.vector(plain.search_terms(t))) for k, t in texts.items()}
        limit = threshold if max(scores.values()) >= threshold else 0.005
        kept = {k: s for k, s in scores.items() if (s >= limit if limit == threshold else s > limit)}
    else:
        tokens = [t for t in plain.words(query) if len(t) > 1]
        kept = {k: m / len(tokens) / 2 for k, t in texts.items() if (m := sum(w in t.lower() for w in tokens))}
    return sorted(kept.items(), key=lambda kv: (-round(kv[1], 7), kv[0]))[:top_k]


@pytest.mark.parametrize("scope,threshold", [("document", 0.05), ("document", 0.3), ("document", 0.0), ("corpus", 0.99), ("corpus", 0.0)])
def test_search_equals_brute_force(cut, asked, targeted, scope, threshold):
    texts = {(r.doc_id, r.section_id): r.text for r in cut.collect()}
    key = (lambda r: (r.query_id, r.doc_id)) if scope == "document" else (lambda r: r.query_id)
    found = defaultdict(list)
    for r in search.search(cut, targeted if scope == "document" else asked, 3, threshold, scope).orderBy("query_id", "doc_id", "rank").collect():
        found[key(r)].append(r)
    docs = {d for d, _ in texts}
    for q, query in enumerate(QUERIES):
        for doc in docs if scope == "document" else [None]:
            own = {k: t for k, t in texts.items() if doc in (None, k[0])}
            expected = plain_search(own, query, 3, threshold)
            got = sorted(found.pop((q, doc) if scope == "document" else q, []), key=lambda r: r["rank"])
            assert [((r.doc_id, r.section_id)) for r in got] == [k for k, _ in expected], (query, doc)
            assert [r.score for r in got] == pytest.approx([s for _, s in expected], abs=6e-5)
    assert not found


def test_queries_without_a_document_need_the_corpus_scope(cut, asked):
    with pytest.raises(ValueError):
        search.search(cut, asked)


def test_targeted_queries_reach_only_their_document(spark, cut):
    queries = spark.createDataFrame([("a", 2, "turbine bread"), ("b", 1, "rust wind"), ("c", 2, "rust zzz")], "query_id string, doc_id long, query string")
    hits = search.search(cut, queries, 2).collect()
    assert {(r.query_id, r.doc_id) for r in hits} == {("a", 2), ("b", 1), ("c", 2)}
    fallback = [r for r in hits if r.query_id == "c"]
    assert fallback[0].score == 0.25 and fallback[0].score_percent == 25.0 and "crust" in fallback[0].raw_text


def test_hits_are_highlighted(cut, spark):
    hit = search.search(cut, spark.createDataFrame([(1, 1, "the TURBINE blades!")], "query_id long, doc_id long, query string"), 1).first()
    assert 'search-match' in hit.highlighted_text and hit.matched_terms == ["blades", "turbine"]
    assert hit.score > 0.1 and hit.score_percent == pytest.approx(hit.score * 100, abs=0.06) and hit["rank"] == 1
    assert "turbine blades" in hit.raw_text and hit.word_count == len(plain.words(hit.raw_text))


def test_stored_index_gives_the_same_hits(spark, cut, asked, targeted):
    search.write_index(search.section_tfidf(cut), "section_index", 4)
    stored = search.search(cut, targeted, 2, postings=spark.table("section_index"))
    assert sorted(map(str, stored.collect())) == sorted(map(str, search.search(cut, targeted, 2).collect()))
    spark.sql("DROP TABLE section_index")
    spark.sql("DROP TABLE section_index_terms")
    whole = search.corpus_tfidf(cut)
    assert sorted(map(str, search.search(cut, asked, 2, scope="corpus", postings=whole).collect())) == sorted(
        map(str, search.search(cut, asked, 2, scope="corpus").collect())
    )


@pytest.mark.parametrize("first_rows", [0, 40, 10_000])
def test_pruned_corpus_search_equals_all_scores(spark, first_rows):
    """Frequent terms beside rare ones: whatever is skipped, the best sections and their scores stay."""
    rng = random.Random(5)
    words = [f"rare{k}" for k in range(60)] + [f"usual{k}" for k in range(6)]
    text = lambda n: " ".join(rng.choices(words, [1] * 60 + [30] * 6, k=n))
    texts = {(d, s): text(rng.randint(3, 12)) for d in range(30) for s in range(1, 5)}
    cut = spark.createDataFrame([(*k, 1, t, 1) for k, t in texts.items()], "doc_id long, section_id long, page_number long, text string, word_count long")
    asked = [f"rare{k} rare{k + 1} usual{k % 6} usual{(k + 1) % 6} usual1" for k in range(12)] + ["usual0 usual1 usual2", "rare1", "unknown"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    postings = search.corpus_postings(cut, queries)
    got = by_key(search.rank_in_corpus(postings, queries, 4, first_rows=first_rows).orderBy("query_id", "rank"), "query_id")
    for q, query in enumerate(asked):
        expected = [(k, s) for k, s in plain_search(texts, query, 200, 0.0) if s > 0][:4] if query != "unknown" else []
        rows = got.get(q, [])
        assert [(r.doc_id, r.section_id) for r in rows] == [k for k, _ in expected], query
        assert [r.score for r in rows] == pytest.approx([s for _, s in expected])


def test_frequent_postings_meet_only_candidate_sections(spark, monkeypatch):
    rows = [(d, 1, f"common shared topic{d % 50} number{d}") for d in range(400)]
    cut = spark.createDataFrame([(d, s, 1, t, 4) for d, s, t in rows], "doc_id long, section_id long, page_number long, text string, word_count long")
    queries = spark.createDataFrame([(1, "common shared topic7 number7")], "query_id long, query string")
    stored = {}
    monkeypatch.setattr(search, "materialize", lambda df, name, keep=search.materialize: stored.setdefault(name, keep(df, name)))
    postings = search.corpus_postings(cut, queries)
    best = search.rank_in_corpus(postings, queries, 3, first_rows=20)
    assert best.orderBy("rank").first().doc_id == 7
    skipped = {r.term for r in stored["later-terms"].where("_skipped").collect()}
    assert {"common", "shared", "common shared"} <= skipped
    assert stored["candidates"].count() < 20 < postings.where("term = 'common'").count()
    assert "LeftSemi" in best._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("first_rows", [0, 5, 10_000])
def test_pruned_fallback_equals_all_matches(spark, first_rows):
    rng = random.Random(6)
    pieces = ["urbi", "arbo", "rust", "hird", "read", "ater", "ough"]
    texts = {(d, s): " ".join(f"{rng.choice('xyz')}{rng.choice(pieces)}{rng.choice('stu')}" for _ in range(rng.randint(1, 5))) for d in range(25) for s in (1, 2)}
    cut = spark.createDataFrame([(*k, 1, t, 1) for k, t in texts.items()], "doc_id long, section_id long, page_number long, text string, word_count long")
    asked = [" ".join(rng.choices(pieces, k=n)) for n in (1, 2, 3, 5, 9)] + ["zzzz", "a b"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    nobody = queries.select("query_id").limit(0)
    got = by_key(search.rank_fallback(cut, queries, nobody, 3, "corpus", first_rows).orderBy("query_id", "rank"), "query_id")
    for q, query in enumerate(asked):
        tokens = [t for t in query.split() if len(t) > 1]
        scores = {k: sum(w in t for w in tokens) / len(tokens) / 2 for k, t in texts.items() if any(w in t for w in tokens)} if tokens else {}
        expected = sorted(scores.items(), key=lambda kv: (-round(kv[1], 4), kv[0]))[:3]
        assert [((r.doc_id, r.section_id)) for r in got.get(q, [])] == [k for k, _ in expected]
        assert [r.score for r in got.get(q, [])] == pytest.approx([s for _, s in expected], abs=6e-5)


# --- paged documents without bound --------------------------------------------------

@pytest.fixture(scope="module")
def many_pages(spark):
    """One document of 100,000 pages among small ones."""
    big = spark.range(100_000).select(F.lit(1).cast("long").alias("doc_id"), (F.col("id") + 1).alias("page_number"), F.concat(F.lit("Common page text with number n"), F.col("id"), F.lit(" inside.")).alias("text"))
    small = spark.createDataFrame([(2, 1, "A small document of one page."), (3, 1, "Tiny"), (3, 2, "bits")], "doc_id long, page_number long, text string")
    return big.unionByName(small).repartition(16).cache()


def test_a_document_of_very_many_pages_is_no_single_task(spark, many_pages):
    conf = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cut = sections.sections_paged(many_pages)
        numbered = cut.withColumn("_task", F.spark_partition_id()).cache()
        ids = numbered.where("doc_id = 1").agg(F.min("section_id"), F.max("section_id"), F.countDistinct("section_id"), F.countDistinct("_task")).first()
        assert tuple(ids)[:3] == (1, 100_000, 100_000) and ids[3] > 8
        assert numbered.where("doc_id = 1 AND section_id <> page_number").count() == 0
        assert {(r.doc_id, r.section_id, r.text) for r in cut.where("doc_id > 1").collect()} == {(2, 1, "A small document of one page."), (3, 1, "Tiny\n\nbits")}
        postings = search.section_tfidf(cut).withColumn("_task", F.spark_partition_id()).cache()
        common = postings.where("doc_id = 1 AND term = 'common'").agg(F.count("*"), F.min("df"), F.max("df"), F.countDistinct("_task")).first()
        assert tuple(common)[:3] == (100_000, 100_000, 100_000) and common[3] > 8
        weight = postings.where("doc_id = 1 AND term = 'n77'").first()
        idf = [math.log(100_001 / 100_001) + 1, math.log(100_001 / 2) + 1]
        # common, page, text, number, inside and 3 pairs of them stand everywhere; n77 and the two pairs with it once
        assert weight.weight == pytest.approx(idf[1] / math.sqrt(8 * idf[0] ** 2 + 3 * idf[1] ** 2))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", conf)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_both_ways_to_an_index_agree(spark, cut):
    key = lambda df: sorted((r.doc_id, r.section_id, r.term, r.tf, r.df, round(r.idf, 9), round(r.weight, 9)) for r in df.collect())
    assert key(search.section_tfidf(cut)) == key(search.section_tfidf(cut, whole_texts=True))


def test_statistics_of_pages_equal_those_of_the_assembled_text(spark):
    rng = random.Random(9)
    bits = ["Ends here.", "goes on", "And then", "two words", "\x07", " ", "\n", "\n\n", "\t", "“Quote”", "a—b", "\u2003", "\r\n", "x\x07", "1. item", "don't", "\u00a0", "Why? No!", "é", "\x85", "word-word"]
    rows = [(d, rng.choice([p, p, p, 3, 1500 + p, None]), rng.choice([None, "", " ", "\x07 \x07", "".join(rng.choices(bits, k=rng.randint(1, 7))), "".join(rng.choices(bits, k=rng.randint(1, 7)))])) for d in range(400) for p in range(1, rng.randint(2, 8))]
    pages = spark.createDataFrame(rows, "doc_id long, page_number long, text string").repartition(3).cache()
    whole = page_source.assemble_pages(pages)
    expected = statistics.document_statistics(whole, "raw_text", F.col("page_count"))
    for block in (1, 3, 1000):
        got = statistics.paged_statistics(pages, block).select(*expected.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))


def test_statistics_of_very_many_pages(many_pages):
    got = statistics.paged_statistics(many_pages).where("doc_id = 1").first()
    assert (got.page_count, got.word_count, got.sentence_count, got.paragraph_count, got.unique_word_count) == (100_000, 700_000, 100_000, 100_000, 100_006)


def test_page_warnings_equal_those_of_assembled_documents(spark, many_pages):
    assembled = page_source.assemble_pages(many_pages, large_pages=5).select("doc_id", "page_count", "char_count", "warnings")
    warned = page_source.page_warnings(many_pages, large_pages=5)
    assert sorted(map(str, warned.collect())) == sorted(map(str, assembled.collect()))
    assert "collect_list" not in warned._jdf.queryExecution().toString()
    capped = page_source.page_warnings(many_pages, 5, 2).where("doc_id = 1").first()
    assert capped.page_count == 100_000 and capped.char_count == 78 and "only pages up to 2" in capped.warnings[0]


# --- evaluation and splitting ---------------------------------------------------

def test_metrics_with_a_class_never_predicted(spark):
    pairs = [("a", "a")] * 4 + [("a", "b")] + [("b", "b")] * 2 + [("c", "a")]
    predictions = spark.createDataFrame(pairs, "label string, prediction string")
    m = evaluation.classification_metrics(predictions).first()
    precision, recall = {"a": 4 / 5, "b": 2 / 3, "c": 0}, {"a": 4 / 5, "b": 1, "c": 0}
    f1 = {"a": 0.8, "b": 0.8, "c": 0}
    assert m.accuracy == 0.75 and m.precision_macro == round(sum(precision.values()) / 3, 4)
    assert m.recall_weighted == 0.75 and m.f1_weighted == round((5 * f1["a"] + 2 * f1["b"]) / 8, 4)
    table = {r.true_class: r for r in evaluation.confusion_matrix(predictions, ["a", "b", "c", "d"]).collect()}
    assert [table[c][x] for c in "abcd" for x in "abcd"] == [4, 1, 0, 0, 0, 2, 0, 0, 1, 0, 0, 0, 0, 0, 0, 0]
    report_rows = {r["class"]: r for r in evaluation.classification_report(predictions).collect()}
    assert set(report_rows) == {"a", "b", "c", "accuracy", "macro avg", "weighted avg"}
    assert report_rows["b"].precision == 0.6667 and report_rows["c"].support == 1 and report_rows["macro avg"].support == 8


@pytest.mark.parametrize("sizes", [{"x": 12, "y": 12, "z": 12, "u": 12, "v": 12, "w": 12}, {"a": 900, "b": 7, "c": 1}, {"a": 3}])
def test_split_fills_the_quota_of_every_class(spark, sizes):
    rows = [(i * 100 + j, c) for j, (c, n) in enumerate(sizes.items()) for i in range(n)]
    labelled = spark.createDataFrame(rows, "doc_id long, category string")
    split = splitting.stratified_split(labelled).collect()
    n = len(rows)
    tests = Counter(r.category for r in split if r.split == "test")
    assert len(split) == n and sum(tests.values()) == math.ceil(round(0.2 * n, 6))
    assert all(abs(tests[c] - sum(tests.values()) * s / n) < 1 for c, s in sizes.items())
    again = splitting.stratified_split(labelled.repartition(3)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, split))
    assert sorted(map(tuple, splitting.stratified_split(labelled, seed=7).collect())) != sorted(map(tuple, split)) or n < 5


# --- classifier -----------------------------------------------------------------

TOPICS = {
    "Weather": "storm rain cloud wind thunder forecast snow hail sunshine humidity front pressure",
    "Music": "violin melody chord rhythm orchestra song choir piano concert tune harmony tempo",
    "Garden": "soil seed flower hedge compost prune blossom tulip lawn shovel watering roots",
}


@pytest.fixture(scope="module")
def labelled(spark):
    rows = []
    for topic, vocabulary in TOPICS.items():
        w = vocabulary.split()
        for i in range(15):
            rows.append((len(rows), topic, " ".join(w[(i * 5 + j * 7) % 12] for j in range(8)) + " the report said today"))
    return spark.createDataFrame(rows, "doc_id long, category string, text string")


@pytest.fixture(scope="module")
def model(spark, labelled, tmp_path_factory):
    return classifier.load_or_train(labelled, str(tmp_path_factory.mktemp("model") / "topics"))


def test_six_classes_of_twelve_rows(spark):
    names = ["ship", "bake", "moon", "coin", "lawn", "drum"]
    rows = [(k * 12 + i, n, " ".join(f"{n}word{(i * 5 + j * 3) % 11}" for j in range(9)) + " seen by all of them") for k, n in enumerate(names) for i in range(12)]
    labelled = spark.createDataFrame(rows, "doc_id long, category string, text string")
    tables = classifier.train_classifier(labelled).tables
    assert tables["metrics"].first().accuracy >= 0.7 and tables["confusion_matrix"].count() == 6


def test_training_results(model):
    metrics = model.tables["metrics"].first()
    assert metrics.accuracy >= 0.7 and 0 < metrics.f1_macro <= 1
    assert model.classes == sorted(TOPICS) and model.tables["confusion_matrix"].count() == 3
    run = model.tables["training_run"].first()
    assert (run.train_samples, run.test_samples, run.total_samples) == (36, 9, 45)
    assert run.vocabulary_size == model.terms.count() and len(run.trained_at) == 19


def test_predictions(spark, model):
    docs = spark.createDataFrame(
        [(1, "Thunder and rain: the storm forecast"), (2, "a choir sings, violin and piano in harmony"), (3, "  "), (4, None),
         (5, " 123456789 "), (6, "1234567890"), (7, "wholly unknown vocabulary")], "doc_id long, text string")
    got = {r.doc_id: r for r in classifier.predict(model, docs).collect()}
    assert got[1].predicted_category == "Weather" and got[1].confidence > 40 and got[2].predicted_category == "Music"
    for i in (3, 4, 5):
        assert got[i].predicted_category == "Undetermined" and got[i].confidence == 0.0 and "brief" in got[i].message
        assert [(p.category, p.probability) for p in got[i].probabilities] == [(c, 0.0) for c in model.classes]
    for i in (1, 2, 6, 7):
        shares = [p.probability for p in got[i].probabilities]
        assert abs(sum(shares) - 100) < 0.05 and shares == sorted(shares, reverse=True) and got[i].message == "Success"
        assert got[i].probabilities[0].category == got[i].predicted_category
        assert got[i].confidence == pytest.approx(100 * got[i].confidence_raw, abs=0.006)
    hard = classifier.predict(model, docs, hard=True).where("doc_id = 1").first()
    assert hard.confidence == 100.0 and [p.probability for p in hard.probabilities] == [100.0, 0.0, 0.0]
    assert classifier.probability_table(classifier.predict(model, docs)).count() == 7 * 3


def test_saved_model_is_used_again(spark, labelled, model, tmp_path):
    model.save(str(tmp_path / "copy"))
    copy = classifier.load_model(spark, str(tmp_path / "copy"))
    again = classifier.load_or_train(labelled.repartition(3), str(tmp_path / "copy"))
    assert again.classes == model.classes and again.signature == model.signature
    assert classifier.training_signature(labelled.limit(9), {}) != model.signature != classifier.training_signature(labelled, {"c": 1.0})
    docs = labelled.select("doc_id", "text")
    assert sorted(map(str, classifier.predict(copy, docs).collect())) == sorted(map(str, classifier.predict(model, docs).collect()))
    classifier.TopicModel(model.terms, model.classes, model.intercepts).save(str(tmp_path / "bare"))
    bare = classifier.load_model(spark, str(tmp_path / "bare"))
    assert bare.tables["metrics"].columns == copy.tables["metrics"].columns and bare.tables["metrics"].count() == 0
    assert bare.tables["confusion_matrix"].columns == copy.tables["confusion_matrix"].columns
    assert tuple(bare.tables["training_run"].first()) == (0, 0, 0, 0, "") and bare.tables["class_report"].columns == copy.tables["class_report"].columns
    with pytest.raises(FileNotFoundError):
        classifier.load_model(spark, str(tmp_path / "nowhere"))


def test_versions_are_numbered_by_claims_and_not_by_clocks(spark, model, tmp_path, monkeypatch):
    import threading
    import time

    path = str(tmp_path / "shared")
    named = lambda signature: classifier.TopicModel(model.terms, model.classes, model.intercepts, signature=signature)
    assert named("first").save(path) == 1
    monkeypatch.setattr(time, "time", lambda: 0.0)  # a writer whose clock is decades late
    assert named("late clock").save(path) == 2 and classifier.load_model(spark, path).signature == "late clock"
    monkeypatch.undo()
    numbers = []
    writers = [threading.Thread(target=lambda k=k: numbers.append((named(f"writer {k}").save(path), f"writer {k}"))) for k in range(2)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert sorted(n for n, _ in numbers) == [3, 4] and classifier.load_model(spark, path).signature == dict(numbers)[4]
    (tmp_path / "shared" / "published" / "000000000005.json").write_text('{"folder": "half wri')  # a writer that died
    assert classifier.load_model(spark, path).signature == dict(numbers)[4]
    assert named("after").save(path) == 6 and classifier.load_model(spark, path).signature == "after"


def test_gradient_vanishes_at_the_fit_and_only_there(spark, labelled):
    fitted = classifier.fit(labelled)
    rows = classifier.training_optimality(fitted).orderBy("class").collect()
    assert [r["class"] for r in rows] == sorted(TOPICS) and all(r.gradient_ok and 0 <= r.gradient < r.gradient_at_zero for r in rows)
    assert {r.n_terms for r in rows} == {fitted.model.terms.count()}
    early = classifier.training_optimality(classifier.fit(labelled, max_iterations=1)).collect()
    assert not any(r.gradient_ok for r in early) and {r["class"]: r.gradient_at_zero for r in early} == {r["class"]: r.gradient_at_zero for r in rows}


@pytest.mark.parametrize("buckets", [3, 40, 1 << 18])
def test_frequent_terms_are_exact_for_any_sketch(spark, buckets):
    rng = random.Random(4)
    rows = [(d, f"t{min(rng.randrange(400), rng.randrange(400))}", 1 + rng.randrange(3)) for d in range(800) for _ in range(4)]
    totals = Counter()
    for _, t, n in rows:
        totals[t] += n
    counted = spark.createDataFrame(rows, "doc_id long, term string, tf long").cache()
    for size in (1, 25, 300, 5000):
        got = [(r.term, r.total) for r in classifier.frequent_terms(counted, size, buckets).orderBy(F.desc("total"), "term").collect()]
        assert got == sorted(totals.items(), key=lambda kv: (-kv[1], kv[0]))[:size]


def test_csv_to_saved_model_to_prediction(spark, labelled, tmp_path):
    labelled.select("category", "text").write.csv(str(tmp_path / "csv"), header=True, quoteAll=True)
    rows = labelled_source.read_labelled_csv(spark, str(tmp_path / "csv")).withColumn("doc_id", F.xxhash64("category", "text"))
    model = classifier.load_or_train(rows, str(tmp_path / "model"))
    docs = spark.createDataFrame([(1, "Thunder and rain: the storm forecast"), (2, " ")], "doc_id long, text string")
    got = {r.doc_id: r.predicted_category for r in classifier.predict(classifier.load_model(spark, str(tmp_path / "model")), docs).collect()}
    assert got == {1: "Weather", 2: "Undetermined"} and classifier.load_or_train(rows, str(tmp_path / "model")).signature == model.signature


def test_scores_equal_the_softmax_of_the_unit_vector(spark, labelled, model):
    rows = {r.term: r for r in model.terms.collect()}
    text = "storm storm rain choir report"
    tokens = text.split()
    counts = Counter(t for t in tokens + [" ".join(p) for p in zip(tokens, tokens[1:])] if t in rows)
    weights = {t: (1 + math.log(n)) * rows[t].idf for t, n in counts.items()}
    norm = math.sqrt(sum(w * w for w in weights.values()))
    margins = [b + sum(w / norm * rows[t].coefficients[i] for t, w in weights.items()) for i, b in enumerate(model.intercepts)]
    shares = [math.exp(m) / sum(map(math.exp, margins)) for m in margins]
    got = classifier.predict(model, spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got.confidence_raw == pytest.approx(max(shares)) and model.classes[shares.index(max(shares))] == got.predicted_category


# --- report ---------------------------------------------------------------------

def test_report_keeps_every_document(spark, library, model):
    rows = {r.doc_id: r for r in report.document_report(library, model=model).collect()}
    assert set(rows) == {1, 2, 3, 4, 5}
    assert rows[1].section_count == 4 and len(rows[1].keywords.split(", ")) == 15 and rows[3].section_count == 0
    assert rows[3].predicted_category == "Undetermined" and rows[4].keywords == "" and rows[5].section_count == 1


def test_report_of_paged_documents(spark):
    rows = [(1, k, f"Page {k} is long enough.\n\nIts second paragraph too.") for k in range(1, 4)]
    pages = spark.createDataFrame(rows, "doc_id long, page_number long, text string")
    docs = spark.createDataFrame([(1, "\n\n".join(r[2] for r in rows), 3), (None, "lost", 1)], "doc_id long, text string, page_count long")
    got = report.document_report(docs, pages=pages).collect()
    assert [(r.doc_id, r.page_count, r.section_count) for r in got] == [(1, 3, 6)]
