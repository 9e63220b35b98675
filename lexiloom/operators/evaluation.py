"""Metrics of a table of true and predicted labels.

The rows are counted once per (label, prediction); everything else works on
that small table of counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("accuracy", "precision_macro", "recall_macro", "f1_macro", "precision_weighted", "recall_weighted", "f1_weighted")


def prediction_counts(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return predictions.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def confusion_matrix(
    predictions: DataFrame, classes: list[str], label: str = "label", prediction: str = "prediction",
    true_prefix: str = "", predicted_prefix: str = "",
) -> DataFrame:
    """One row per true class, one column per predicted class; empty cells are 0.

    ``classes`` lists all classes, so those never predicted keep their column.
    """
    counts = prediction_counts(predictions, label, prediction)
    cells = [
        F.coalesce(F.sum(F.when(F.col("prediction") == c, F.col("n"))), F.lit(0)).alias(predicted_prefix + c)
        for c in sorted(classes)
    ]
    all_classes = predictions.sparkSession.createDataFrame([(c,) for c in sorted(classes)], "label string")
    return all_classes.join(counts, "label", "left").groupBy(
        F.concat(F.lit(true_prefix), "label").alias("true_class")
    ).agg(*cells)


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0))


def _per_class(counts: DataFrame) -> DataFrame:
    """``class, precision, recall, f1, support`` unrounded, from the table of counts."""
    sides = counts.select(
        F.explode(
            F.array(
                F.struct(F.col("label").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                         F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hit")),
                F.struct(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"),
                         F.lit(0).cast("long").alias("hit")),
            )
        ).alias("s")
    ).select("s.*")
    totals = sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hit")])
    precision, recall = _share(F.col("hit"), F.col("predicted")), _share(F.col("hit"), F.col("support"))
    f1 = _share(F.col("hit") * 2, F.col("predicted") + F.col("support"))
    return totals.select(
        "class", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support", "hit"
    )


def _averages(per_class: DataFrame) -> DataFrame:
    measures = ("precision", "recall", "f1")
    return per_class.agg(
        (F.sum("hit") / F.sum("support")).alias("accuracy"),
        *[F.avg(m).alias(f"{m}_macro") for m in measures],
        *[(F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(f"{m}_weighted") for m in measures],
        F.sum("support").alias("support"),
    )


def classification_metrics(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy and macro / weighted precision, recall, F1, to 4 decimals, in one row."""
    averages = _averages(_per_class(prediction_counts(predictions, label, prediction)))
    return averages.select(*[F.round(c, 4).alias(c) for c in METRICS])


def classification_report(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Per-class precision, recall, F1 and support, with accuracy and average rows."""
    per_class = _per_class(prediction_counts(predictions, label, prediction))
    averages = _averages(per_class)
    summary = averages.select(
        F.explode(
            F.array(
                F.struct(F.lit("accuracy").alias("class"), F.col("accuracy").alias("precision"),
                         F.col("accuracy").alias("recall"), F.col("accuracy").alias("f1"), "support"),
                *[
                    F.struct(F.lit(f"{kind} avg").alias("class"), F.col(f"precision_{kind}").alias("precision"),
                             F.col(f"recall_{kind}").alias("recall"), F.col(f"f1_{kind}").alias("f1"), "support")
                    for kind in ("macro", "weighted")
                ],
            )
        ).alias("s")
    ).select("s.*")
    rows = per_class.drop("hit").unionByName(summary)
    return rows.select("class", *[F.round(m, 4).alias(m) for m in ("precision", "recall", "f1")], "support")
