"""The registered queries: every operator over the whole given tables.

Arrays and maps are flattened to strings or rows here, so that results compare
by value across engines; the operators themselves return them as they are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import classifier as C
from ..operators import evaluation, keywords, search, splitting, statistics, terms
from ..operators import sections as S
from ..session import cluster, materialize, shared_folder
from ..sources import files, labelled, pages
from ..sources.tables import read_table
from . import report

HIGHLIGHT_QUERY = "the report of la und die, de el que"
WARNING_PAGES = 4
LARGE_FILE = 20_000
WORD_PIECE = "[a-z]([a-z]{4})[a-z]*"


# --- inputs -----------------------------------------------------------------

def _documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    wanted = ["doc_id", "text", *columns]
    return read_table(spark, folder, "documents").select(*wanted)


def _blank_lines(docs: DataFrame) -> DataFrame:
    """The texts have single line breaks only; doubled, each line is a paragraph."""
    return docs.withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))


def _paragraph_documents(spark, folder) -> DataFrame:
    return _blank_lines(_documents(spark, folder))


def _messy(docs: DataFrame) -> DataFrame:
    """Typographic characters, CR, tabs and controls in the places of plain ones."""
    dirty = F.replace("text", F.lit("\n"), F.lit("\r\n\r\n \r\n\r"))
    dirty = F.replace(dirty, F.lit(", "), F.lit("\t—\u0007 “x”\u0085 ‘y’ "))
    return docs.withColumn("text", F.concat(F.lit("  "), dirty, F.lit("  \n")))


def _conversation_pages(spark, folder) -> DataFrame:
    return read_table(spark, folder, "conversations").select(
        F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page_number"), "text"
    )


def _conversation_sections(spark, folder) -> DataFrame:
    return S.sections_paged(_blank_lines(_conversation_pages(spark, folder)))


def _turns(spark, folder) -> DataFrame:
    """Every turn is a question to its own conversation."""
    return read_table(spark, folder, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("query_id"), F.col("conv_id").alias("doc_id"), F.col("text").alias("query")
    )


def _passages(spark, folder) -> DataFrame:
    """Every benchmark text is a query."""
    return read_table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _document_sections(spark, folder) -> DataFrame:
    return S.sections(_blank_lines(cluster(_documents(spark, folder), "doc_id")))


def _files(spark, folder) -> DataFrame:
    """The documents as files: the extension follows the language, some files are blank."""
    suffix = F.create_map(*[F.lit(x) for x in ("en", ".txt", "fr", ".v2.TXT", "de", ".docx", "es", "")])
    text = (
        F.when(F.col("source") == "src1", F.regexp_replace("text", r"[^\n]", " "))
        .when(F.col("source") == "src2", F.regexp_replace("text", r"[^\n]", "\u00a0"))
        .when(F.col("source") == "src3", F.lit(""))
        .otherwise(F.col("text"))
    )
    rows = _documents(spark, folder, "lang", "source").select(
        "doc_id",
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), suffix[F.col("lang")]).alias("path"),
        F.encode(text, "UTF-8").alias("content"),
    )
    return files.with_file_name(rows)


def _language_rows(spark, folder) -> DataFrame:
    docs = _documents(spark, folder, "lang")
    return labelled.labelled_clean(docs.withColumnRenamed("lang", "category"), ["doc_id"])


def _guesses(spark, folder) -> DataFrame:
    """True language and a guess from one frequent word, as a table of predictions."""
    has = lambda w: F.lower("text").contains(f" {w} ")
    guess = F.when(has("the"), "en").when(has("und"), "de").when(has("le"), "fr").otherwise("es")
    return _documents(spark, folder, "lang").select(F.col("lang").alias("label"), guess.alias("prediction"))


_LANGUAGES = ["de", "en", "es", "fr"]


# --- ingestion --------------------------------------------------------------

def ingest_route(spark, folder):
    return files.route(_files(spark, folder)).select("doc_id", "path", "file_name", "extension", "route")


def decode_text(spark, folder):
    docs = _documents(spark, folder, "lang")
    latin = F.col("lang").isin("fr", "es") & ~F.col("text").rlike(r"[^\x00-\xff]")
    content = F.when(latin, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    return docs.select("doc_id", files.decode_text(content).alias("text"))


def ingest_documents(spark, folder):
    docs = files.ingest_documents(_files(spark, folder))
    return docs.select("doc_id", "file_name", "file_type", "raw_text", "page_count", F.col("metadata")["format"].alias("format"))


def ingest_errors(spark, folder):
    return files.ingest_errors(files.without_large(_files(spark, folder), LARGE_FILE))


def assemble_pages(spark, folder):
    about = _documents(spark, folder).select("doc_id").join(
        read_table(spark, folder, "documents").select("doc_id", F.col("source").alias("author"), F.lit("").alias("title")), "doc_id"
    )
    docs = pages.assemble_pages(_conversation_pages(spark, folder), metadata=about)
    return docs.select(
        "doc_id", "raw_text", "page_count", "char_count",
        F.col("metadata")["title"].alias("title"), F.col("metadata")["author"].alias("author"),
    )


def ingest_warnings(spark, folder):
    docs = pages.page_warnings(_conversation_pages(spark, folder), large_pages=WARNING_PAGES)
    return docs.select("doc_id", "page_count", F.array_join("warnings", "|").alias("warnings"))


def page_breakdown(spark, folder):
    return pages.page_breakdown(_conversation_pages(spark, folder))


def labelled_clean(spark, folder):
    return _language_rows(spark, folder)


# --- text -------------------------------------------------------------------

def clean_text(spark, folder):
    return _messy(_documents(spark, folder)).select("doc_id", T.clean_text(F.col("text")).alias("text"))


def _exploded(docs: DataFrame, pieces, name: str) -> DataFrame:
    return docs.select("doc_id", F.posexplode(pieces).alias("_i", name)).select(
        "doc_id", (F.col("_i") + 1).cast("long").alias("position"), name
    )


def paragraphs(spark, folder):
    return _exploded(_messy(_documents(spark, folder)), T.paragraphs(T.clean_text(F.col("text"))), "paragraph")


def sentences(spark, folder):
    return _exploded(_documents(spark, folder), T.sentences(T.clean_text(F.col("text"))), "sentence")


def tokenize_words(spark, folder):
    return _exploded(_documents(spark, folder), T.word_tokens(F.col("text")), "token")


def preprocess_for_ml(spark, folder):
    return _documents(spark, folder).select("doc_id", T.preprocess_for_ml(F.col("text"), ["Report", "ing"]).alias("text"))


def ngrams(spark, folder):
    tokens = T.without_stop_words(T.keyword_tokens(F.col("text")))
    return _exploded(_documents(spark, folder), T.terms(tokens), "ngram")


def highlight(spark, folder):
    marks = T.highlight_tokens(F.lit(HIGHLIGHT_QUERY))
    return _documents(spark, folder).select(
        "doc_id",
        T.highlight(F.col("text"), marks).alias("highlighted_text"),
        F.array_join(T.matched_terms(F.col("text"), marks), "|").alias("matched_terms"),
    )


# --- statistics and terms ----------------------------------------------------

def document_statistics(spark, folder):
    return statistics.document_statistics(_blank_lines(_documents(spark, folder)))


def document_statistics_paged(spark, folder):
    """The conversations as documents of pages, never put together."""
    return statistics.paged_statistics(_blank_lines(_conversation_pages(spark, folder)))


def term_frequency(spark, folder):
    return keywords.keyword_term_counts(_documents(spark, folder))


def inverse_document_frequency(spark, folder):
    docs = _documents(spark, folder)
    df = terms.document_frequency(keywords.keyword_term_counts(docs), [])
    n = docs.agg(F.count(F.lit(1))).scalar()
    return df.select("term", "df", F.round(terms.smooth_idf(n, F.col("df")), 4).alias("idf"))


# --- keywords ---------------------------------------------------------------

def keyword_scope(spark, folder):
    return keywords.keyword_scope(_blank_lines(_documents(spark, folder)))


def keywords_local(spark, folder):
    return keywords.keywords_local(_paragraph_documents(spark, folder))


def keywords_corpus(spark, folder):
    return keywords.keywords_corpus(_documents(spark, folder))


def keywords_background(spark, folder):
    """Keywords of the benchmark texts against the documents as background."""
    items = read_table(spark, folder, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return keywords.keywords_corpus(items, background=_documents(spark, folder))


def keywords_single_background(spark, folder):
    """A background of one text: the documents' own scopes serve."""
    one = read_table(spark, folder, "benchmark").select(F.col("item_id").alias("doc_id"), "text").where(F.col("doc_id") == 0)
    return keywords.keywords_corpus(_paragraph_documents(spark, folder), background=one)


def keywords_fallback(spark, folder):
    return keywords.keywords_fallback(_documents(spark, folder))


def keyword_table(spark, folder):
    return report.keyword_table(keywords.keywords_local(_documents(spark, folder)))


# --- sections and search -----------------------------------------------------

def sections(spark, folder):
    return S.sections(_blank_lines(_documents(spark, folder)))


def sections_paged(spark, folder):
    return _conversation_sections(spark, folder)


def section_counts(spark, folder):
    return S.section_counts(_conversation_sections(spark, folder))


def section_tfidf(spark, folder):
    postings = search.section_tfidf(_document_sections(spark, folder), whole_texts=True)
    return postings.select("doc_id", "section_id", "term", "tf", "df", F.round("weight", 4).alias("weight"))


def query_vector(spark, folder):
    postings = search.section_tfidf(_conversation_sections(spark, folder))
    vector = search.query_vector(postings, _turns(spark, folder))
    return vector.withColumn("weight", F.round("weight", 4))


def _flat(hits: DataFrame) -> DataFrame:
    return hits.withColumn("matched_terms", F.array_join("matched_terms", "|"))


def search_topk(spark, folder):
    return _flat(search.search(_conversation_sections(spark, folder), _turns(spark, folder)))


def search_zero_threshold(spark, folder):
    found = search.search(
        _conversation_sections(spark, folder), _turns(spark, folder), top_k=10, threshold=0.0
    )
    return _flat(found)


def search_every_document(spark, folder):
    """Every document asked with its own first line, best section only, vector search."""
    first = F.get(F.split("text", "\n"), F.lit(0))
    own = _documents(spark, folder).select(F.col("doc_id").alias("query_id"), "doc_id", first.alias("query"))
    return _flat(search.search(_document_sections(spark, folder), own, top_k=1, fallback=False, whole_texts=True))


def search_fallback(spark, folder):
    """Every turn put to the conversation after its own, where they share no term."""
    cut = _conversation_sections(spark, folder)
    turns = _turns(spark, folder).withColumn("doc_id", F.col("doc_id") + 1)
    answered = search.rank_sections(search.section_tfidf(cut), turns, 1).select("query_id", "doc_id")
    ranked = search.rank_fallback(cut, turns, answered, 1)
    return _flat(search.project_hits(ranked, cut, turns, mark_all_words=True))


def search_blank_queries(spark, folder):
    """Every turn put to its own conversation, those of every third conversation blanked."""
    blank = F.when(F.col("doc_id") % 3 == 0, F.lit(" \t\u00a0\n")).when(F.col("doc_id") % 3 == 1, F.col("query"))
    return _flat(search.search(_conversation_sections(spark, folder), _turns(spark, folder).withColumn("query", blank)))


def search_fallback_corpus(spark, folder):
    """The benchmark texts as pieces of words, put to all sections where they share no term."""
    cut = materialize(S.sections(_paragraph_documents(spark, folder)), "document-sections")
    pieces = F.array_join(F.regexp_extract_all("query", F.lit(WORD_PIECE), F.lit(1)), " ")
    asked = _passages(spark, folder).withColumn("query", pieces)
    answered = search.rank_sections(search.corpus_postings(cut, asked), asked, 1, "corpus").select("query_id")
    ranked = search.rank_fallback(cut, asked, answered, 5, "corpus")
    return _flat(search.project_hits(ranked, cut, asked, mark_all_words=True))


def search_corpus(spark, folder):
    return _flat(search.search(S.sections(_paragraph_documents(spark, folder)), _passages(spark, folder), scope="corpus"))


# --- classification -----------------------------------------------------------

def predict_gate(spark, folder):
    return C.predict_gate(_documents(spark, folder))


def stratified_split(spark, folder):
    return splitting.stratified_split(_language_rows(spark, folder)).select("doc_id", "category", "split")


def _training_part(spark, folder):
    split = splitting.stratified_split(_language_rows(spark, folder))
    return split.where(F.col("split") == "train")


def vocabulary_topk(spark, folder):
    return C.vocabulary_topk(_training_part(spark, folder))


def training_summary(spark, folder):
    split = splitting.stratified_split(_language_rows(spark, folder))
    return splitting.training_summary(split, vocabulary_topk(spark, folder))


def confusion_matrix(spark, folder):
    return evaluation.confusion_matrix(
        _guesses(spark, folder), _LANGUAGES, true_prefix="True: ", predicted_prefix="Pred: "
    )


def classification_metrics(spark, folder):
    return evaluation.classification_metrics(_guesses(spark, folder))


def classification_report(spark, folder):
    return evaluation.classification_report(_guesses(spark, folder))


def _model_path(spark) -> str:
    return f"{shared_folder(spark)}/models/{uuid.uuid4().hex}"


def _share_model(spark, folder) -> C.TopicModel:
    """A model in closed form: a term's coefficients are its shares among the languages, times eight.

    It is scored by the same code as a trained one, and every value can be checked.
    """
    rows = _language_rows(spark, folder)
    found = C.training_terms(cluster(rows, "doc_id"), ["doc_id", "category"])
    vocabulary = materialize(C.frequent_terms(found, C.VOCABULARY_CAP), "vocabulary")
    counted = found.join(F.broadcast(vocabulary), "term")
    held = [F.sum(F.when(F.col("category") == c, F.col("tf")).otherwise(0)).alias(f"_c{i}") for i, c in enumerate(_LANGUAGES)]
    per_term = counted.groupBy("term", "total").agg(F.count(F.lit(1)).alias("df"), *held)
    shares = [F.round(8 * F.col(f"_c{i}") / F.col("total"), 4) for i in range(len(_LANGUAGES))]
    idf = terms.smooth_idf(F.lit(rows.count()), F.col("df"))
    table = per_term.select("term", idf.alias("idf"), F.array(*shares).alias("coefficients"))
    return C.TopicModel(materialize(table, "share-model"), list(_LANGUAGES), [0.0] * len(_LANGUAGES))


def train_classifier(spark, folder):
    model = C.train_classifier(_language_rows(spark, folder))
    path = _model_path(spark)
    model.save(path)
    return C.load_model(spark, path).tables["metrics"]


def training_optimality(spark, folder):
    """Is the fitted model the least of its objective? One row per class."""
    return C.training_optimality(C.fit(_language_rows(spark, folder))).select("class", "n_terms", "gradient_ok")


def labelled_csv(spark, folder):
    """The labelled texts written as CSV and read back."""
    path = f"{shared_folder(spark)}/labelled/{uuid.uuid4().hex}"
    rows = _documents(spark, folder, "lang").select(F.col("lang").alias("category"), "text")
    rows.write.csv(path, header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return labelled.read_labelled_csv(spark, path)


def model_roundtrip(spark, folder):
    """The model's terms as they are after saving and loading."""
    path = _model_path(spark)
    _share_model(spark, folder).save(path)
    model = C.load_model(spark, path)
    named = [F.col("coefficients")[i].alias(f"coefficient_{c}") for i, c in enumerate(model.classes)]
    return model.terms.select("term", F.round("idf", 6).alias("idf"), *named)


def _predictions(spark, folder, hard=False):
    return C.predict(_share_model(spark, folder), _documents(spark, folder), hard=hard)


def classifier_predictions(spark, folder, model):
    return C.predict(model, _documents(spark, folder)).select(
        "doc_id", "predicted_category", "confidence", F.round("confidence_raw", 6).alias("confidence_raw"), "message"
    )


def predict(spark, folder):
    return classifier_predictions(spark, folder, _share_model(spark, folder))


def predict_hard(spark, folder):
    return _predictions(spark, folder, hard=True).select("doc_id", "predicted_category", "confidence")


def classifier_vectors(spark, folder):
    vectors = C.vectors(_share_model(spark, folder), _documents(spark, folder))
    return vectors.withColumn("weight", F.round("weight", 4))


def probability_table(spark, folder):
    return C.probability_table(_predictions(spark, folder))


# --- reports ------------------------------------------------------------------

def document_report(spark, folder):
    return report.document_report(_paragraph_documents(spark, folder))


def document_report_paged(spark, folder):
    """The conversations as paged documents."""
    paged = _blank_lines(_conversation_pages(spark, folder))
    docs = pages.assemble_pages(paged).select("doc_id", F.col("raw_text").alias("text"), "page_count")
    return report.document_report(docs, pages=paged)


def blank_documents(spark, folder):
    """Files without text, as documents for the quarantine."""
    docs = _files(spark, folder).select("doc_id", files.decode_text(F.col("content")).alias("raw_text"))
    return files.blank_documents(docs)


def ingest_plain(spark, folder):
    """Every document as a text file, unchanged."""
    rows = _documents(spark, folder, "source").select(
        "doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.encode("text", "UTF-8").alias("content")
    )
    return files.text_pages(files.ingest_documents(files.with_file_name(rows)))


def document_report_with_topic(spark, folder):
    return report.document_report(_paragraph_documents(spark, folder), model=_share_model(spark, folder))


REGISTERED = [
    ingest_route, decode_text, ingest_documents, ingest_errors, assemble_pages, ingest_warnings, page_breakdown,
    labelled_clean, clean_text, paragraphs, sentences, tokenize_words, preprocess_for_ml, ngrams, highlight,
    document_statistics, document_statistics_paged, term_frequency, inverse_document_frequency, keyword_scope, keywords_local, keywords_corpus,
    keywords_background, keywords_single_background, keywords_fallback, keyword_table, sections, sections_paged, section_counts, section_tfidf,
    query_vector, search_topk, search_zero_threshold, search_every_document, search_fallback, search_blank_queries,
    search_fallback_corpus, search_corpus, training_optimality, labelled_csv,
    predict_gate, stratified_split, vocabulary_topk, training_summary, confusion_matrix, classification_metrics,
    classification_report, train_classifier, model_roundtrip, predict, predict_hard, classifier_vectors, probability_table,
    document_report,
    document_report_with_topic, document_report_paged, blank_documents, ingest_plain,
]
