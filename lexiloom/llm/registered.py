"""The corpus queries: each operator over its whole table, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    conversation_repair, decontaminate, hard_negatives, hidden_markov, jaccard_join, license_scan, mixing, packing, quality_rules, suffix_dedup, token_counts,
    url_filter, warc,
)

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
SPAM_HOST = r"(^|\.)(spam-farm|cheap-pills|casino-win|free-bets|ads-track|adult-x)\."


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


# E-mail addresses, IPv4 addresses, digit runs of card or phone length, quoted secrets.
PERSONAL = r"[\w.+-]+@[\w-]+\.[\w.]+|\b\d{1,3}(?:\.\d{1,3}){3}\b|\+?\d[\d ()-]{7,}\d|\b[0-9a-f]{32,}\b"


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts of every document before and after its personal data are edited out."""
    trees = token_counts.build_trees(_table(spark, folder, "documents"))
    return token_counts.apply_edits(token_counts.redactions(trees, PERSONAL, "[removed]"))


def op2_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Pages against the rules and a list of the spam hosts' URLs."""
    pages = _table(spark, folder, "pages").select("page_id", "url")
    listed = pages.where(url_filter.host(F.col("url")).rlike(SPAM_HOST)).select("url")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(pages, listed, rules)


def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality_rules.judge(_table(spark, folder, "documents").select("doc_id", "text", "lang"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("broken_rules", ",").alias("broken_rules")
    )


def op4_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """One and a half times the corpus, sources half way from their own entropy to the largest, none read over four times."""
    mixed = mixing.mix(_table(spark, folder, "documents"), gain=0.5, max_repeats=4.0, budget=1.5)
    return mixed.select("doc_id", "source", "epoch", "block", "block_order")


def op5_warc_derivatives(spark: SparkSession, folder: str) -> DataFrame:
    return warc.derive(warc.responses_of_pages(_table(spark, folder, "pages"))).drop("headers")


def op6_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes under repeated 400-byte strings, and those under repeated strings of a passage's size."""
    return suffix_dedup.repeats(_table(spark, folder, "documents"), passage=suffix_dedup.PASSAGE)


def op7_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, folder, "documents"))


def op8_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, folder, "documents"))


def op9_markov_scores(spark: SparkSession, folder: str) -> DataFrame:
    return hidden_markov.score_documents(_table(spark, folder, "documents"))


def op10_benchmark_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every hundredth vector, with the labels of every seventh moved on."""
    label = F.col("label").cast("long")
    rows = _table(spark, folder, "embeddings").select("vec_id", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), F.col("embedding").alias("vector"))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_repair.repairs(conversation_repair.damaged(_table(spark, folder, "conversations")), F.col("present"))


def op13_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.decompose(_table(spark, folder, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {q.__name__: q for q in (
    op1_token_counts, op2_url_filter, op3_quality_rules, op4_source_mixing, op5_warc_derivatives, op6_suffix_dedup, op7_jaccard_join,
    op8_license_scan, op9_markov_scores, op10_benchmark_leaks, op11_hard_negatives, op12_conversation_repair, op13_packing,
)}

_URL_PARTS = """
    SELECT page_id, url, CASE WHEN regexp_matches(url, '://') THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
           CASE WHEN regexp_matches(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
    FROM pages"""

_STOPS = "CASE lower(lang) " + " ".join(
    f"WHEN '{name}' THEN len(list_filter(words, lambda x: lower(regexp_replace(x, '[.,;:!?\"''()]', '', 'g')) IN ({', '.join(repr(w) for w in words.split())})))" for name, words in quality_rules.STOP_WORDS.items()
) + " END"
_QUALITY = f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
g AS (SELECT rid, unnest(range(1, len(words) - 3)) AS i, words FROM w WHERE len(words) >= 5),
h AS (SELECT rid, i, array_to_string(words[i:i + 4], ' ') AS gram FROM g),
twice AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM h),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, 5)) AS k) WHERE n > 1 GROUP BY rid),
m AS (SELECT w.rid, doc_id, len(words) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, length(regexp_replace(text, '[^!?…]', '', 'g')) AS n_marks,
             {_STOPS} AS n_stop, len(words) - list_sum(list_transform(list_distinct(lines), lambda x: len(list_filter(regexp_split_to_array(x, '[\\x20\\x09-\\x0D]+'), lambda y: y <> '')))) AS n_copied,
             len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
      FROM w LEFT JOIN covered ON covered.rid = w.rid),
r AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
             concat_ws(',', CASE WHEN n_words < 10 THEN 'words' END,
               CASE WHEN n_words = 0 OR word_chars / n_words < 2 OR word_chars / n_words > 14 THEN 'word_length' END,
               CASE WHEN n_words > 0 AND n_symbols / n_words > 0.25 THEN 'symbols' END, CASE WHEN n_words > 0 AND n_marks / n_words > 0.25 THEN 'marks' END,
               CASE WHEN n_words >= 50 AND n_stop / n_words < 0.04 THEN 'stop_words' END, CASE WHEN n_words >= 50 AND n_copied / n_words > 0.3 THEN 'line_copies' END,
               CASE WHEN n_words > 0 AND n_repeat_words / n_words > 0.2 THEN 'repeats' END) AS broken_rules FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND broken_rules = '' AS kept, broken_rules FROM r"""

_NEGATIVES = """
WITH sound AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
               FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id, b.label, list_sum(list_transform(list_zip(a.q, b.q), lambda p: coalesce(p[1] * p[2], 0)))::BIGINT AS score
           FROM sound a JOIN sound b ON a.vec_id % 100 = 0 AND b.vec_id IS DISTINCT FROM a.vec_id),
positives AS (SELECT anchor_id, anchor_label, vec_id AS positive_id, score AS positive_score FROM scored WHERE label = anchor_label
              QUALIFY row_number() OVER (PARTITION BY anchor_id, anchor_label ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, anchor_label, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id, anchor_label)
WHERE label <> anchor_label AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10"""

SQL = {
    "op11_hard_negatives": _NEGATIVES,
    "op3_quality_rules": _QUALITY,
    "op2_url_filter": f"""
WITH parts AS ({_URL_PARTS}),
rules(rhost, rpath, rverdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
named AS (SELECT *, regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/+$', '') AS canonical FROM parts),
listed AS (SELECT DISTINCT canonical FROM named WHERE regexp_matches(host, '(^|\\.)(spam-farm|cheap-pills|casino-win|free-bets|ads-track|adult-x)\\.') AND canonical <> ''),
numbered AS (SELECT *, row_number() OVER () AS rid FROM named),
fits AS (SELECT rid, arg_max(rhost || rpath, length(rhost || rpath) * 1000 + length(rhost)) AS rule, arg_max(rverdict, length(rhost || rpath) * 1000 + length(rhost)) AS rverdict
         FROM numbered JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(rverdict, CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, l.canonical IS NOT NULL AS listed
FROM numbered n LEFT JOIN fits USING (rid) LEFT JOIN listed l ON l.canonical = n.canonical""",
}
