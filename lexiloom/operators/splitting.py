"""Deterministic stratified train/test split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed_values import SPLIT_SEED, TEST_SHARE

_BUCKET_DIGITS = 4


def split_hash(row_id: Column, seed: int = SPLIT_SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), row_id.cast("string")))


def test_quotas(labelled: DataFrame, share: float = TEST_SHARE) -> DataFrame:
    """``category, quota``: ceil(share * n) test rows over all classes, by largest remainder.

    One row per class. Remainders are compared as integers.
    """
    sizes = labelled.groupBy("category").agg(F.count(F.lit(1)).alias("size"))
    everything = Window.partitionBy()
    total = F.sum("size").over(everything)
    tests = F.ceil(F.round(total * share, 6)).cast("long")
    exact = F.col("_tests") * F.col("size")
    counted = sizes.select("category", "size", total.alias("_total"), tests.alias("_tests")).select(
        "category", "_tests",
        F.floor(exact / F.col("_total")).alias("_base"),
        (exact % F.col("_total")).alias("_rest"),
    )
    missing = F.col("_tests") - F.sum("_base").over(everything)
    place = F.row_number().over(Window.orderBy(F.desc("_rest"), "category"))
    return counted.select("category", (F.col("_base") + (place <= missing).cast("long")).alias("quota"))


def stratified_split(
    labelled: DataFrame, row_id: str = "doc_id", share: float = TEST_SHARE, seed: int = SPLIT_SEED
) -> DataFrame:
    """Add ``split`` ('train' or 'test'): per class, the rows with the lowest hashes are the test rows.

    No class is ever sorted as a whole. Hash prefixes cut each class into
    65,536 even buckets; their counts tell in which bucket the quota ends, and
    only that bucket is ranked, to find the last test row. The result is one
    threshold per class, so the rows themselves are compared in place. Both
    broadcast tables have one row per class, and classes are few: a model has
    a coefficient per class and the driver holds their names.
    """
    hashed = labelled.withColumn("_hash", split_hash(F.col(row_id), seed)).withColumn(
        "_bucket", F.substring("_hash", 1, _BUCKET_DIGITS)
    )
    slim = hashed.select("category", "_hash", "_bucket", F.col(row_id).alias("_id"))
    buckets = slim.groupBy("category", "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    so_far = Window.partitionBy("category").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    last_bucket = (
        buckets.withColumn("_before", F.coalesce(F.sum("_size").over(so_far), F.lit(0)))
        .join(test_quotas(slim, share), "category")
        .where((F.col("_before") < F.col("quota")) & (F.col("quota") <= F.col("_before") + F.col("_size")))
        .select("category", "_bucket", (F.col("quota") - F.col("_before")).alias("_wanted"))
    )
    place = F.row_number().over(Window.partitionBy("category").orderBy("_hash", "_id"))
    thresholds = (
        slim.join(F.broadcast(last_bucket), ["category", "_bucket"])
        .withColumn("_place", place)
        .where(F.col("_place") == F.col("_wanted"))
        .select("category", F.struct("_hash", "_id").alias("_last"))
    )
    is_test = F.struct(F.col("_hash"), F.col(row_id).alias("_id")) <= F.col("_last")
    return (
        hashed.join(F.broadcast(thresholds), "category", "left")
        .withColumn("split", F.when(is_test, "test").otherwise("train"))
        .drop("_hash", "_bucket", "_last")
    )


def training_summary(split: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Class and split counts and the vocabulary size, in one row."""
    sizes = split.groupBy("category").agg(
        F.count(F.lit(1)).alias("_all"), F.count_if(F.col("split") == "train").alias("_train")
    )
    return sizes.agg(
        F.count(F.lit(1)).alias("class_count"),
        F.sum("_train").alias("train_samples"),
        F.sum(F.col("_all") - F.col("_train")).alias("test_samples"),
        F.sum("_all").alias("total_samples"),
    ).withColumn("vocabulary_size", vocabulary.agg(F.count(F.lit(1))).scalar())
