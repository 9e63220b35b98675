"""Topic classifier: TF-IDF features and multinomial logistic regression.

Training goes through Spark ML. Scoring is relational: the model is a table of
at most 4000 terms with one coefficient per class, a size fixed by the
vocabulary cap, so it is broadcast and every document is scored where it lies.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StopWordsRemover
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from ..functions import text as T
from ..functions.fixed_values import (
    INVERSE_REGULARISATION, MAX_ITERATIONS, PREDICT_MIN_CHARS, TOO_BRIEF_MESSAGE, UNDETERMINED, VOCABULARY_CAP,
)
from ..session import cluster, cluster_parts, materialize
from .evaluation import METRICS, classification_metrics, classification_report, confusion_matrix
from .splitting import stratified_split
from .terms import normalise, smooth_idf, sublinear, term_frequency

# A sparse vector is stored as a struct; read back with this schema it is a vector.
_FEATURES = StructType([StructField("label", DoubleType()), StructField("features", VectorUDT())])

# The solver stops where a step gains less than this share of the objective.
TOLERANCE = 1e-8
# The driver holds the class names and builds one column for each.
MAX_CLASSES = 1000


def _terms(text: Column) -> Column:
    stops = StopWordsRemover.loadDefaultStopWords("english")
    return T.terms(T.without_stop_words(T.classifier_tokens(text), stops))


def training_terms(texts: DataFrame, row: list[str]) -> DataFrame:
    """``row, term, tf``, stored: everything that training reads of the texts."""
    return materialize(term_frequency(texts, row, _terms(F.col("text"))), "training-terms")


def cut_terms(texts: DataFrame, row: list[str]) -> DataFrame:
    """``row, term`` with all repeats, from the texts cut once and stored.

    Totals need no counts by row, and most terms are rare: only what is known to be
    frequent is counted by row, after it.
    """
    cut = materialize(texts.select(*row, _terms(F.col("text")).alias("_terms")), "cut-terms")
    return cut.select(*row, F.explode("_terms").alias("term"))


def frequent_terms(counted: DataFrame, size: int, buckets: int = 1 << 18) -> DataFrame:
    """The ``size`` terms with the largest totals, ties by term: ``term, total``, from rows ``term, tf``.

    Exact, though the long tail of rare terms is never shuffled. Counts by hash
    bucket (``buckets`` rows a task at most, merged by addition) bound the total of
    every term from above. The terms of the ``size`` heaviest buckets are counted;
    the total of rank ``size`` among them is a lower bound, and only terms of
    buckets that reach it can still enter. ``counted`` is read three times: pass
    a stored table. The bucket numbers are broadcast, ``buckets`` longs at most.
    """
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).alias("_bucket")
    sums = materialize(counted.groupBy(bucket).agg(F.sum("tf").alias("_most")), "term-buckets")
    heavy = sums.orderBy(F.desc("_most"), "_bucket").limit(size).select("_bucket")
    heavy = materialize(heavy, "heavy-buckets")

    def totals(chosen: DataFrame) -> DataFrame:
        held = counted.select("term", "tf", bucket).join(F.broadcast(chosen), "_bucket", "left_semi")
        return held.groupBy("term").agg(F.sum("tf").alias("total"))

    first = materialize(totals(heavy).orderBy(F.desc("total"), "term").limit(size), "frequent-terms")
    least = first.agg(F.when(F.count(F.lit(1)) < size, F.lit(0).cast("long")).otherwise(F.min("total"))).scalar()
    rest = sums.where(F.col("_most") >= least).join(F.broadcast(heavy), "_bucket", "left_anti").select("_bucket")
    return first.unionByName(totals(rest)).orderBy(F.desc("total"), "term").limit(size)


def vocabulary_topk(texts: DataFrame, size: int = VOCABULARY_CAP, row_id: str = "doc_id") -> DataFrame:
    """``term, total, position``: the most frequent terms, ties by term."""
    return _vocabulary(cut_terms(texts, [row_id]), size)


def _vocabulary(found: DataFrame, size: int) -> DataFrame:
    counted = found.select("term", F.lit(1).cast("long").alias("tf"))
    position = F.row_number().over(Window.orderBy(F.desc("total"), "term")).cast("long")  # ``size`` rows
    return frequent_terms(counted, size).withColumn("position", position)


@dataclass
class TopicModel:
    """``terms``: term, idf, coefficients per class (≤ 4000 rows). ``classes``: name, intercept in order."""

    terms: DataFrame
    classes: list[str]
    intercepts: list[float]
    tables: dict[str, DataFrame] = field(default_factory=dict)
    signature: str = ""

    def save(self, path: str) -> int:
        """Write the tables, then publish them under the next free number; returns the number.

        The number is claimed by creating a file that must not exist yet, so of two
        writers one gets it and the other takes the next; no clock is compared. A
        reader sees whole versions only, as the claim names a folder that is complete.
        (The file system has to create files atomically; HDFS does.)
        """
        spark = self.terms.sparkSession
        rows = list(zip(range(len(self.classes)), self.classes, self.intercepts))
        classes = spark.createDataFrame(rows, "position int, name string, intercept double")
        folder = uuid.uuid4().hex
        for name, table in {"terms": self.terms, "classes": classes, **self.tables}.items():
            table.write.parquet(f"{path}/versions/{folder}/{name}")
        entry = json.dumps({"folder": folder, "signature": self.signature, "tables": list(self.tables)})
        number = max(published_versions(spark, path), default=0) + 1
        while not _create(spark, f"{path}/published/{number:012d}.json", entry):
            number += 1
        return number


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def _create(spark: SparkSession, path: str, content: str) -> bool:
    """Create a file with this content; False if it exists."""
    target, system = _file_system(spark, path)
    try:
        stream = system.create(target, False)
    except Exception as error:
        if system.exists(target):
            return False
        raise error
    stream.write(bytearray(content.encode()))
    stream.close()
    return True


def published_versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the published versions, in order."""
    target, system = _file_system(spark, f"{path}/published")
    if not system.exists(target):
        return []
    names = [f.getPath().getName() for f in system.listStatus(target)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())


def load_model(spark: SparkSession, path: str) -> TopicModel:
    """The version with the highest number whose entry is complete.

    Tables that were not saved have their columns and no rows, the run's counts
    are zeros; without any version there is nothing to load, which raises.
    """
    for number in reversed(published_versions(spark, path)):
        raw = "".join(r[0] for r in spark.read.text(f"{path}/published/{number:012d}.json").collect())
        if not raw.endswith("}"):  # its writer has not closed it
            continue
        entry = json.loads(raw)
        folder = f"{path}/versions/{entry['folder']}"
        classes = spark.read.parquet(f"{folder}/classes").orderBy("position").collect()
        names = [r["name"] for r in classes]
        extra = {name: spark.createDataFrame(rows, shape) for name, (shape, rows) in _default_tables(names).items()}
        extra |= {name: spark.read.parquet(f"{folder}/{name}") for name in entry["tables"]}
        return TopicModel(spark.read.parquet(f"{folder}/terms"), names, [r["intercept"] for r in classes], extra, entry["signature"])
    raise FileNotFoundError(f"no model is published in {path}")


def _default_tables(classes: list[str]) -> dict[str, tuple[StructType, list]]:
    """Schema and rows by name of the tables that a model may have been saved without."""
    counts = ("train_samples", "test_samples", "total_samples", "vocabulary_size")
    columns = lambda *pairs: StructType([StructField(c, kind) for kind, names in pairs for c in names])
    return {
        "metrics": (columns((DoubleType(), METRICS)), []),
        "class_report": (columns((StringType(), ["class"]), (DoubleType(), ["precision", "recall", "f1"]), (LongType(), ["support"])), []),
        "confusion_matrix": (columns((StringType(), ["true_class"]), (LongType(), sorted(classes))), []),
        "training_run": (columns((LongType(), counts), (StringType(), ["trained_at"])), [(0, 0, 0, 0, "")]),
    }


def training_signature(labelled: DataFrame, settings: dict) -> str:
    """Names the settings and the content of a training table, whatever the order of its rows."""
    content = labelled.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("category", "text")).alias("h")).first()
    return json.dumps({**settings, "rows": content["n"], "content": content["h"]}, sort_keys=True)


def load_or_train(labelled: DataFrame, path: str, **settings) -> TopicModel:
    """The saved model if it was trained on these rows with these settings, else a new one, trained and saved."""
    spark = labelled.sparkSession
    signature = training_signature(labelled, settings)
    if published_versions(spark, path):
        saved = load_model(spark, path)
        if saved.signature == signature:
            return saved
    model = train_classifier(labelled, **settings)
    model.signature = signature
    model.save(path)
    return load_model(spark, path)


def known_terms(texts: DataFrame, vocabulary: DataFrame, keep: list[str]) -> DataFrame:
    """``keep, tf`` and the vocabulary columns for the known terms of each text.

    Unknown terms, nearly all there are, go before anything is counted.
    """
    found = texts.select(*keep, F.explode(_terms(F.col("text"))).alias("term"))
    known = found.join(F.broadcast(vocabulary.select("term")), "term", "left_semi")
    counts = known.groupBy(*keep, "term").agg(F.count(F.lit(1)).alias("tf"))
    return counts.join(F.broadcast(vocabulary), "term")


@dataclass
class Fit:
    """A fitted model with what it was fitted on: stored unit vectors ``row_id, category, index, value``."""

    model: TopicModel
    split: DataFrame
    rows: DataFrame
    weights: DataFrame
    coefficients: DataFrame
    n_train: int
    penalty: float


def fit(
    labelled: DataFrame, row_id: str = "doc_id", vocabulary_size: int = VOCABULARY_CAP,
    c: float = INVERSE_REGULARISATION, max_iterations: int = MAX_ITERATIONS,
    test_share: float | None = None, seed: int | None = None,
) -> Fit:
    """Split and fit on the training part. The texts are cut into terms once, and stored."""
    spark = labelled.sparkSession
    options = {k: v for k, v in (("share", test_share), ("seed", seed)) if v is not None}
    split = materialize(stratified_split(labelled, row_id, **options), "split")
    train = split.where(F.col("split") == "train").select(row_id, "category", "text")
    classes = [r[0] for r in split.select("category").distinct().orderBy("category").limit(MAX_CLASSES + 1).collect()]
    if len(classes) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    n_train = train.count()

    found = cut_terms(train, [row_id, "category"])
    vocabulary = materialize(_vocabulary(found, vocabulary_size), "vocabulary")
    places = F.broadcast(vocabulary.select("term", (F.col("position") - 1).cast("int").alias("index")))
    parts = cluster_parts(split)
    known = cluster(found.join(places, "term").select(row_id, "category", "index"), row_id, parts=parts)
    known = materialize(known.groupBy(row_id, "category", "index").agg(F.count(F.lit(1)).alias("tf")), "known-terms")
    df = known.groupBy("index").agg(F.count(F.lit(1)).alias("df"))
    idf = materialize(df.join(places, "index").select("term", "index", smooth_idf(F.lit(n_train), F.col("df")).alias("idf")), "idf")
    size = idf.count()

    weighted = known.join(F.broadcast(idf.select("index", "idf")), "index").select(
        row_id, "category", "index", (sublinear(F.col("tf")) * F.col("idf")).alias("value")
    )
    weights = materialize(normalise(cluster(weighted, row_id, parts=parts), [row_id], "value"), "training-weights")
    vectors = weights.groupBy(row_id).agg(F.array_sort(F.collect_list(F.struct("index", "value"))).alias("_p"))
    label = F.array_position(F.array(*[F.lit(x) for x in classes]), F.col("category")) - 1
    empty = F.array().cast("array<double>")
    rows = train.select(row_id, "category")
    features = rows.join(vectors, row_id, "left").select(
        label.cast("double").alias("label"),
        F.struct(
            F.lit(0).cast("tinyint").alias("type"), F.lit(size).cast("int").alias("size"),
            F.coalesce(F.transform("_p", lambda p: p["index"]), empty.cast("array<int>")).alias("indices"),
            F.coalesce(F.transform("_p", lambda p: p["value"]), empty).alias("values"),
        ).alias("features"),
    )
    penalty = 1.0 / (c * n_train)
    regression = LogisticRegression(
        family="multinomial", regParam=penalty, elasticNetParam=0.0,
        standardization=False, maxIter=max_iterations, tol=TOLERANCE,
    ).fit(materialize(features, "features", _FEATURES))

    columns = regression.coefficientMatrix.toArray().T.tolist()
    coefficients = spark.createDataFrame(list(enumerate(columns)), "index int, coefficients array<double>")
    terms = idf.join(coefficients, "index").select("term", "idf", "coefficients")
    model = TopicModel(terms, classes, regression.interceptVector.toArray().tolist())
    return Fit(model, split, rows, weights, coefficients, n_train, penalty)


def training_optimality(fitted: Fit, row_id: str = "doc_id", tolerance: float = 1e-3) -> DataFrame:
    """Per class ``class, n_terms, gradient, gradient_at_zero, gradient_ok``: is the fit the least of its objective?

    The objective is convex, so its gradient (mean loss over the stored vectors
    plus penalty) tells. ``gradient`` is its largest component for the class,
    the intercept's included; ``gradient_ok`` if that is at most ``tolerance``
    times the largest component where all coefficients are zero.
    """
    model, k = fitted.model, len(fitted.model.classes)
    each = range(k)
    table = F.broadcast(fitted.coefficients)
    sums = fitted.weights.join(table, "index").groupBy(row_id).agg(*[F.sum(F.col("value") * F.col("coefficients")[i]).alias(f"_s{i}") for i in each])
    margins = F.array(*[F.coalesce(F.col(f"_s{i}"), F.lit(0.0)) + F.lit(b) for i, b in enumerate(model.intercepts)])
    shifted = fitted.rows.join(sums, row_id, "left").select(row_id, "category", margins.alias("_m")).select(
        row_id, "category", F.transform("_m", lambda m: F.exp(m - F.array_max("_m"))).alias("_e")
    )
    is_class = [F.when(F.col("category") == x, 1.0).otherwise(0.0) for x in model.classes]
    total = F.aggregate("_e", F.lit(0.0), lambda a, b: a + b)
    off = F.array(*[F.col("_e")[i] / total - is_class[i] for i in each])
    start = F.array(*[F.lit(1.0 / k) - is_class[i] for i in each])
    residuals = materialize(shifted.select(row_id, off.alias("_r"), start.alias("_z")), "residuals")
    mean = lambda column, value: [(F.sum(value * F.col(column)[i]) / fitted.n_train).alias(f"{column}{i}") for i in each]
    by_term = fitted.weights.join(residuals, row_id).groupBy("index").agg(*mean("_r", F.col("value")), *mean("_z", F.col("value")))
    slopes = [F.abs(F.col(f"_r{i}") + fitted.penalty * F.col("coefficients")[i]) for i in each]
    largest = by_term.join(table, "index").agg(
        F.count(F.lit(1)).alias("n_terms"), *[F.max(slopes[i]).alias(f"_g{i}") for i in each], *[F.max(F.abs(F.col(f"_z{i}"))).alias(f"_o{i}") for i in each]
    )
    free = residuals.agg(*mean("_r", F.lit(1.0)), *mean("_z", F.lit(1.0)))
    listed = F.array(*[
        F.struct(F.lit(x).alias("class"), F.greatest(f"_g{i}", F.abs(F.col(f"_r{i}"))).alias("gradient"), F.greatest(f"_o{i}", F.abs(F.col(f"_z{i}"))).alias("gradient_at_zero"))
        for i, x in enumerate(model.classes)
    ])
    one = largest.crossJoin(free)  # one row each
    return one.select("n_terms", F.explode(listed).alias("_c")).select(
        F.col("_c.class").alias("class"), "n_terms", F.col("_c.gradient").alias("gradient"), F.col("_c.gradient_at_zero").alias("gradient_at_zero"),
        (F.col("_c.gradient") <= tolerance * F.col("_c.gradient_at_zero")).alias("gradient_ok"),
    )


def train_classifier(labelled: DataFrame, row_id: str = "doc_id", **settings) -> TopicModel:
    """Split, fit on the training part only, evaluate on the held-out part.

    ``labelled`` has ``row_id, category, text``; ``settings`` are those of ``fit``.
    The objective is the mean loss with an L2 penalty of 1/(c * n), on unscaled
    features. The driver holds the class names, the intercepts and at most
    ``vocabulary_size`` terms.
    """
    fitted = fit(labelled, row_id, **settings)
    model, split = fitted.model, fitted.split
    held_out = split.where(F.col("split") == "test").select(row_id, "category", "text")
    predicted = predict(model, held_out, row_id).join(held_out.select(row_id, "category"), row_id).select(
        F.col("category").alias("label"), F.col("predicted_category").alias("prediction")
    )
    predicted = materialize(predicted, "held-out")
    run = split.agg(
        F.count_if(F.col("split") == "train").alias("train_samples"),
        F.count_if(F.col("split") == "test").alias("test_samples"),
        F.count(F.lit(1)).alias("total_samples"),
    ).withColumn("vocabulary_size", F.lit(model.terms.count()).cast("long")).withColumn(
        "trained_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    )
    model.tables = {
        "metrics": classification_metrics(predicted),
        "class_report": classification_report(predicted),
        "confusion_matrix": confusion_matrix(predicted, model.classes),
        "training_run": run,
    }
    return model


def is_too_brief(text: Column) -> Column:
    return F.length(T.strip(F.coalesce(text, F.lit("")))) < PREDICT_MIN_CHARS


def predict_gate(docs: DataFrame, text: str = "text") -> DataFrame:
    """Which texts are long enough to classify."""
    brief = is_too_brief(F.col(text))
    return docs.select(
        "doc_id",
        F.when(brief, UNDETERMINED).otherwise("Classified").alias("outcome"),
        F.when(brief, TOO_BRIEF_MESSAGE).otherwise("Success").alias("message"),
    )


def vectors(model: TopicModel, docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Unit TF-IDF vectors over the model's vocabulary as rows: ``row_id, term, tf, weight``."""
    known = known_terms(cluster(docs.select(row_id, F.col(text).alias("text")), row_id), model.terms.select("term", "idf"), [row_id])
    raw = sublinear(F.col("tf")) * F.col("idf")
    norm = F.sqrt(F.sum(raw * raw).over(Window.partitionBy(row_id)))
    return known.select(row_id, "term", "tf", (raw / norm).alias("weight"))


def predict(model: TopicModel, docs: DataFrame, row_id: str = "doc_id", text: str = "text", hard: bool = False) -> DataFrame:
    """Category, confidence and all class probabilities per text.

    ``hard`` gives the predicted class 100 and the others 0, for a model whose
    probabilities are not meant to be used.
    """
    k = len(model.classes)
    texts = cluster(docs.select(row_id, F.col(text).alias("text")), row_id).select(
        row_id, T.strip(F.coalesce("text", F.lit(""))).alias("text")
    )
    sized = texts.withColumn("_brief", F.length("text") < PREDICT_MIN_CHARS)
    found = sized.select(row_id, "_brief", F.explode_outer(_terms(F.col("text"))).alias("_term"))
    # unknown terms weigh nothing: they share the null, so that a text without known terms keeps its row
    known = F.broadcast(model.terms.select("term"))
    found = found.join(known, found["_term"] == known["term"], "left").select(row_id, "_brief", "term")
    counts = found.groupBy(row_id, "_brief", "term").agg(F.count(F.lit(1)).alias("tf"))
    scored = counts.join(F.broadcast(model.terms), "term", "left").withColumn(
        "_w", sublinear(F.col("tf")) * F.col("idf")
    )
    sums = scored.groupBy(row_id, "_brief").agg(
        F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm"),
        *[F.sum(F.col("_w") * F.col("coefficients")[i]).alias(f"_s{i}") for i in range(k)],
    )
    margins = F.array(*[
        F.lit(b) + F.coalesce(F.col(f"_s{i}") / F.col("_norm"), F.lit(0.0)) for i, b in enumerate(model.intercepts)
    ])
    shifted = sums.select(row_id, "_brief", margins.alias("_m")).select(
        row_id, "_brief", F.transform("_m", lambda m: F.exp(m - F.array_max("_m"))).alias("_e")
    )
    total = F.aggregate("_e", F.lit(0.0), lambda a, b: a + b)
    probable = shifted.select(row_id, "_brief", F.transform("_e", lambda e: e / total).alias("_p"))
    return _describe(probable, model.classes, row_id, hard)


def _describe(probable: DataFrame, classes: list[str], row_id: str, hard: bool) -> DataFrame:
    names = F.array(*[F.lit(c) for c in classes])
    zero = F.lit(0.0)
    best = (F.array_position("_p", F.array_max("_p")) - 1).cast("int")
    chosen = probable.select(row_id, "_brief", "_p", best.alias("_best"))
    raw = F.lit(1.0) if hard else F.get("_p", F.col("_best"))
    share = (
        (lambda p, i: F.when(i == F.col("_best"), F.lit(100.0)).otherwise(zero)) if hard
        else (lambda p, i: F.round(p * 100, 2))
    )
    entries = F.transform("_p", lambda p, i: F.struct(
        (-F.when(F.col("_brief"), zero).otherwise(share(p, i))).alias("_sort"), i.alias("_i")
    ))
    listed = F.transform(F.array_sort(entries), lambda e: F.struct(
        F.get(names, e["_i"]).alias("category"), F.abs(e["_sort"]).alias("probability")
    ))
    brief = F.col("_brief")
    return chosen.select(
        row_id,
        F.when(brief, UNDETERMINED).otherwise(F.get(names, F.col("_best"))).alias("predicted_category"),
        F.when(brief, zero).otherwise(F.round(raw * 100, 2)).alias("confidence"),
        F.when(brief, zero).otherwise(raw).alias("confidence_raw"),
        listed.alias("probabilities"),
        F.when(brief, TOO_BRIEF_MESSAGE).otherwise("Success").alias("message"),
    )


def probability_table(predictions: DataFrame, row_id: str = "doc_id") -> DataFrame:
    """One row per document and class, in the order of the probabilities."""
    return predictions.select(row_id, F.posexplode("probabilities").alias("_i", "_p")).select(
        row_id, (F.col("_i") + 1).cast("long").alias("rank"), F.col("_p.category").alias("category"),
        F.col("_p.probability").alias("probability"),
    )
