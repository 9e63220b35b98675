"""Corpus pipeline: five stages from raw documents to a mixed training set.

Each stage works on all that its predecessor kept; ``run`` writes every stage's
result below the shared folder and reads it back, so a lost executor or driver
costs one stage. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import decontaminate, jaccard_join, mixing, quality_rules, suffix_dedup
from lexiloom.session import materialize


#: Bytes of a string that counts as a passage.
PASSAGE_BYTES = 200


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no quality rule."""
    return quality_rules.kept_documents(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    return jaccard_join.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that stand elsewhere too; what is left blank goes.

    The window is one that passages of 50 words fill: of the 51-word windows of the
    given documents that stand in two or more, the shortest has 245 bytes.
    """
    cut = suffix_dedup.remove_repeats(docs, window=PASSAGE_BYTES).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else cut


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return decontaminate.decontaminate(docs, benchmark)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at tempered weights, every document at least once, with its place in the training order."""
    return mixing.mix(docs, gain=0.5, max_repeats=4.0, budget=None)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_copies),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("mixing sources", source_mixture),
]

#: Candidate search and suffix sorting have no SQL; tests hold the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents``."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{number}")
    return docs
