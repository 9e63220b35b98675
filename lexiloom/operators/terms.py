"""Term counts and TF-IDF weights as long tables.

A weight is ``(1 + ln tf) * (ln((1 + n) / (1 + df)) + 1)``, divided by the L2
norm of its row. A *row* is what gets a vector (a section or a document), a
*scope* is the collection whose rows are counted in ``n`` and ``df``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import BLOCK, block_parts, cluster, cluster_blocks, materialize, spread

# The head join broadcasts at most this many rows, with keys of at most this
# many characters: a few megabytes, whatever the table size.
HEAD_ROWS = 20_000
HEAD_KEY_CHARS = 256


def sublinear(tf: Column) -> Column:
    return F.lit(1.0) + F.log(tf.cast("double"))


def smooth_idf(n: Column, df: Column) -> Column:
    return F.log((F.lit(1.0) + n) / (F.lit(1.0) + df)) + F.lit(1.0)


def term_frequency(rows: DataFrame, row: list[str], terms: Column) -> DataFrame:
    """``(row, term, tf)`` from one text per row."""
    exploded = rows.select(*row, F.explode(terms).alias("term"))
    return exploded.groupBy(*row, "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(tf: DataFrame, scope: list[str]) -> DataFrame:
    """``(scope, term, df)``; ``tf`` has one row per (row, term), so rows count as documents."""
    return tf.groupBy(*scope, "term").agg(F.count(F.lit(1)).alias("df"))


def attach_by_frequency(
    rows: DataFrame, lookup: DataFrame, keys: list[str], frequency: str, head_rows: int = HEAD_ROWS,
    total: Column | None = None,
) -> DataFrame:
    """Inner join of ``rows`` with a lookup whose ``frequency`` says how many rows carry each key.

    The frequencies add up to the number of rows P, so at most ``head_rows``
    keys can have a frequency of P / head_rows or more. Those few keys hold the
    bulk of the rows; they are broadcast, a size bounded by construction, and
    their rows are never shuffled. What remains has no key with more than
    P / head_rows rows, so the shuffle join of the rest cannot be skewed.
    (Overlong keys, as junk texts have, always go with the rest; should one be
    hot, adaptive execution splits its partition.)
    ``total`` is P, if there is a cheaper way to it than adding up the lookup.
    """
    total = lookup.agg(F.sum(frequency)).scalar() if total is None else total
    is_head = (F.col(frequency) * F.lit(head_rows) >= total) & (F.length(F.concat_ws("", *keys)) <= HEAD_KEY_CHARS)
    head = F.broadcast(lookup.where(is_head))
    tail = lookup.where(~is_head)
    return rows.join(head, keys).unionByName(
        rows.join(head.select(*keys), keys, "left_anti").join(tail, keys)
    )


def _row_window(row: list[str]):
    return Window.partitionBy(*row)


def normalise(weighted: DataFrame, row: list[str], weight: str = "weight") -> DataFrame:
    """Divide by the L2 norm of each row. A window group is one row's terms, so its text bounds it."""
    norm = F.sqrt(F.sum(F.col(weight) * F.col(weight)).over(_row_window(row)))
    return weighted.withColumn(weight, F.col(weight) / norm)


def weigh_in_scope(tf: DataFrame, scope: list[str], row: list[str], n: str = "n", asked: DataFrame | None = None) -> DataFrame:
    """Weights for scopes of bounded size (the sections of one document).

    ``tf`` carries ``n``. Clustered by the scope, all windows run without a shuffle.
    With ``asked`` (``scope, term``, clustered like ``tf``) only the weights of these terms
    are given, with the norms of whole rows. It joins the window that counts, as a join on
    scope and term would deal all weights anew.
    """
    by_term = Window.partitionBy(*scope, "term")
    if asked is None:
        counted = tf.withColumn("df", F.count(F.lit(1)).over(by_term))
    else:
        both = tf.unionByName(asked.select(*scope, "term", F.lit(True).alias("_mark")), allowMissingColumns=True)
        counted = both.select("*", F.count("tf").over(by_term).alias("df"), F.max("_mark").over(by_term).alias("_asked"))
        counted = counted.where(F.col("_mark").isNull()).drop("_mark")
    weighted = counted.withColumn("idf", smooth_idf(F.col(n), F.col("df")))
    weighted = normalise(weighted.withColumn("weight", sublinear(F.col("tf")) * F.col("idf")), row)
    return weighted if asked is None else weighted.where("_asked").drop("_asked")


def with_row_marks(terms: Column) -> Column:
    """The terms with a null at the end: counted like a term, it says how many rows a scope has."""
    return F.concat(terms, F.array(F.lit(None).cast("string")))


def weigh_in_large_scope(tf: DataFrame, scope: list[str], row: list[str]) -> DataFrame:
    """Weights for scopes of any size: ``row, term, tf, df, idf, weight``.

    ``tf`` counts ``with_row_marks``. Frequencies are combined before they are
    dealt by (scope, term), and the scope's size is one number joined to them;
    both tables are stored, so that adaptive execution can split a scope or a
    term that very many rows have. Only the norm needs the terms of a row together.
    """
    tf = materialize(tf, "scope-terms")
    df = materialize(document_frequency(tf, scope), "scope-frequency")
    sizes = df.where(F.col("term").isNull()).select(*scope, F.col("df").alias("_n"))
    known = materialize(df.where(F.col("term").isNotNull()).join(sizes, scope).withColumn("idf", smooth_idf(F.col("_n"), F.col("df"))).drop("_n"), "scope-idf")
    weighted = tf.where(F.col("term").isNotNull()).join(known, [*scope, "term"]).withColumn("weight", sublinear(F.col("tf")) * F.col("idf"))
    return normalise(weighted, row).select(*row, "term", "tf", "df", "idf", "weight")


def term_index(texts: DataFrame, row: list[str], terms: Column) -> DataFrame:
    """``row, term, tf`` by blocks of texts, each with its terms numbered, for ``index_with_frequency``.

    The texts are dealt once; everything else stays in the block. ``_at`` numbers the terms of
    a block by share (``_share``, a hash of the term) and name, ``_n`` says at one row of each
    how many rows of the block have it. Texts of equal ``row`` are counted together.
    """
    found = term_frequency(cluster_blocks(texts, *row), [BLOCK, *row], terms)
    found = found.withColumn("_share", spread(texts.sparkSession, F.xxhash64("term"), block_parts(found)))
    in_order = Window.partitionBy(BLOCK).orderBy("_share", "term")
    same = Window.partitionBy(BLOCK, "_share", "term")
    numbered = found.withColumn("_at", F.dense_rank().over(in_order)).withColumn("_row", F.row_number().over(in_order))
    n = F.when(F.col("_row") == F.min("_row").over(same), F.count(F.lit(1)).over(same))
    return numbered.withColumn("_n", n).drop("_row")


def index_with_frequency(index: DataFrame) -> DataFrame:
    """A stored ``term_index`` with ``df``, still clustered by block.

    A block sends the terms of a share, in order, as one text, with the numbers of their rows; the
    share adds them up and sends back the sums in that order, without the terms. So a term is
    dealt once for a block instead of once for a row, numbers only come back, and the
    rows are never dealt by term: no term is too frequent. (Terms hold no line break.)
    """
    parts = block_parts(index)
    listed = F.sort_array(F.collect_list(F.struct("_at", "term", "_n")))
    asked = index.where(F.col("_n").isNotNull()).groupBy(BLOCK, "_share").agg(listed.alias("_t"))
    asked = asked.select(BLOCK, "_share", F.array_join("_t.term", "\n").alias("_text"), F.col("_t._n").alias("_n"))
    asked = cluster(asked, "_share", parts=parts).select(
        BLOCK, "_share", F.posexplode(F.arrays_zip(F.split("_text", "\n").alias("term"), F.col("_n").alias("n"))).alias("_i", "_t")
    )
    total = F.sum("_t.n").over(Window.partitionBy("_share", "_t.term"))
    told = asked.select(BLOCK, "_share", "_i", total.alias("df")).groupBy("_share", BLOCK).agg(
        F.sort_array(F.collect_list(F.struct("_i", "df"))).alias("_told")
    ).select(BLOCK, "_share", F.col("_told.df").alias("_df"))
    # a block's sums in the order of its terms: the join is by block, as the index lies
    sums = cluster(told, BLOCK, parts=parts).groupBy(BLOCK).agg(F.sort_array(F.collect_list(F.struct("_share", "_df"))).alias("_told"))
    sums = sums.select(BLOCK, F.flatten("_told._df").alias("_sums")).hint("shuffle_hash")
    return index.join(sums, BLOCK).withColumn("df", F.get("_sums", F.col("_at") - 1)).drop("_share", "_at", "_n", "_sums")


def weigh_in_corpus(
    tf: DataFrame, row: list[str], n: Column, normalised: bool = True, rows: DataFrame | None = None, df: DataFrame | None = None
) -> DataFrame:
    """Weights with the whole table as the scope, for all of ``tf`` or only some of its ``rows``.

    ``tf`` is read three times: pass a stored table. Document frequencies are
    counted once and stored, unless the stored table ``df`` has them already.
    """
    df = materialize(document_frequency(tf, []), "document-frequency") if df is None else df
    postings = tf.agg(F.count(F.lit(1))).scalar()
    weighted = (
        attach_by_frequency(tf if rows is None else rows, df, ["term"], "df", total=postings)
        .withColumn("idf", smooth_idf(n, F.col("df")))
        .withColumn("weight", sublinear(F.col("tf")) * F.col("idf"))
    )
    return normalise(weighted, row) if normalised else weighted
