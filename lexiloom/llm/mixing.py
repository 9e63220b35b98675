"""Mixing sources to target weights by temperature, realised as block permutations.

A source's weight is its share of tokens to the power of an exponent, divided by
the sum over sources. The exponent is bisected between 0 (even weights) and 1
(the shares) to meet a target entropy of the weights. The target is ``entropy``,
a share of the largest possible one, or ``gain``: the shares' own entropy plus
that part of what it lacks to the largest, which binds wherever sources are not
exactly even. Shares that have ``entropy`` already stay as they are. Where the
target would repeat a source more than ``max_repeats`` times, the exponent rises
until the limit holds, to 1 at most: weights are never sharper than the shares,
so no small source is pushed out.

Each source gets weight x budget tokens: whole passes over its documents, then a
part of a pass. Documents lie in ``blocks`` blocks by hash; the last pass takes
the blocks in permuted order, and of the block in which the quota ends the
documents in hash order while they fit. Sums by source, sums by block (of one
source at most ``blocks`` rows in a window) and the documents of one block per
source decide on two thresholds per source; the documents themselves are never
sorted or shuffled, so a source with a third of all rows costs nothing extra.

Defined results: a null source is a source of its own; null texts count no
tokens and are emitted with the passes; very long texts are counted whole and
never cut, so a quota may end up to one document short; equal rows of one
document fall together, as do documents with equal hashes (ties); an empty table
gives an empty result; a source without tokens is emitted once; an entropy over 1
gives even weights, as 1 does. Extra columns, of whatever name but the three of
the result, are returned as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[^\x20\x09-\x0D]+"
_PLAN = "_key string, _passes long, _rest double, _weight double"


def mixing_weights(
    tokens: dict[str, int], entropy: float | None = 0.95, max_repeats: float = 4.0, budget: float | None = None, gain: float | None = None,
) -> tuple[float, dict[str, float], float]:
    """Exponent, weights and budget in tokens.

    ``budget`` is a multiple of all tokens; None takes the smallest one under
    which every source is read at least once. A fixed budget over ``max_repeats``
    repeats some source more often under any weights, and raises. ``gain`` is
    used in place of ``entropy`` where it is given.
    """
    total = sum(tokens.values())
    shares = {s: n / total for s, n in tokens.items() if n}

    def weights(a: float) -> dict[str, float]:
        raw = {s: p ** a for s, p in shares.items()}
        norm = math.fsum(raw.values())
        return {s: r / norm for s, r in raw.items()}

    def size(w: dict[str, float]) -> float:
        return total * (max(shares[s] / w[s] for s in w) if budget is None else budget)

    def repeats(a: float) -> float:
        w = weights(a)
        return max(size(w) * w[s] / tokens[s] for s in w)

    def flatness(a: float) -> float:
        return -math.fsum(x * math.log(x) for x in weights(a).values() if x)

    def bisect(low: float, high: float, low_side) -> float:
        for _ in range(80):
            mid = (low + high) / 2
            low, high = (mid, high) if low_side(mid) else (low, mid)
        return high

    exponent, most, natural = 1.0, math.log(len(shares)), flatness(1.0)
    target = natural + gain * (most - natural) if gain is not None else entropy * most if entropy is not None else natural
    # shares that are even to the last bits have nothing to gain
    if target > natural and most - natural > 1e-12:
        exponent = bisect(0.0, 1.0, lambda a: flatness(a) > target)
    # guards a limit that the natural shares meet exactly
    limit = max_repeats * (1 + 1e-9)
    if repeats(exponent) > limit:
        if repeats(1.0) > limit:
            raise ValueError(f"no exponent keeps repetitions within {max_repeats}")
        exponent = bisect(exponent, 1.0, lambda a: repeats(a) > limit)
    w = weights(exponent)
    return exponent, w, size(w)


def source_key(source: str = "source") -> Column:
    return F.when(F.col(source).isNull(), "n").otherwise(F.concat(F.lit("s"), F.col(source)))


def mix(
    docs: DataFrame, entropy: float | None = 0.95, max_repeats: float = 4.0, budget: float | None = 1.0,
    blocks: int = 1024, seed: int = 42, max_sources: int = 100_000, gain: float | None = None,
) -> DataFrame:
    """The documents with ``epoch, block, block_order``, one row for each pass that takes them.

    Sort by ``epoch, block_order`` for the training order. ``max_sources`` bounds
    the per-source table that the driver and the broadcast hold; more raise.
    """
    spark = docs.sparkSession
    n_tokens = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    keyed = docs.select(
        F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), source_key().alias("_key"), F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")).alias("_hash"), n_tokens.alias("_n"),
    )
    keyed = keyed.withColumn("_block", F.pmod(F.col("_hash"), F.lit(blocks)))
    keyed = keyed.withColumn("_order", F.xxhash64(F.lit(seed + 1), F.col("_key"), F.col("_block")))
    sums = keyed.groupBy("_key", "_block", "_order").agg(F.sum("_n").alias("_n"))
    known = sums.groupBy("_key").agg(F.sum("_n").alias("n")).limit(max_sources + 1).collect()
    if len(known) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    tokens = {r["_key"]: r["n"] for r in known}
    rows = [(s, 1, 0.0, 0.0) for s, n in tokens.items() if not n]
    if any(tokens.values()):
        _, weights, size = mixing_weights(tokens, entropy, max_repeats, budget, gain)
        for s, w in weights.items():
            # guards the whole passes against the last bit of the product
            passes = math.floor(size * w / tokens[s] + 1e-9)
            rows.append((s, passes, max(0.0, size * w - passes * tokens[s]), w))
    plan = F.broadcast(spark.createDataFrame(rows, _PLAN))

    # The block in which a source's last pass ends, and what is left of the quota there.
    upto = Window.partitionBy("_key").orderBy("_order", "_block")
    walked = sums.join(plan, "_key").withColumn("_sum", F.sum("_n").over(upto))
    # less than one token is no part of a pass: texts without tokens are not taken once more for it
    last = walked.where(F.col("_rest") >= 1).where((F.col("_sum") > F.col("_rest")) & (F.col("_sum") - F.col("_n") <= F.col("_rest"))).where(F.col("_n") > 0)
    last = last.select("_key", F.col("_order").alias("_last_order"), (F.col("_rest") - (F.col("_sum") - F.col("_n"))).alias("_left"))
    ends = last.collect()  # one row per source

    end_table = F.broadcast(spark.createDataFrame(ends, T.StructType(last.schema.fields)))
    inside = keyed.join(end_table, "_key").where(F.col("_order") == F.col("_last_order"))
    inside = inside.groupBy("_key", "_hash").agg(F.sum("_n").alias("_n"), F.first("_left").alias("_left"))
    fits = inside.withColumn("_sum", F.sum("_n").over(Window.partitionBy("_key").orderBy("_hash")))
    cut = fits.where(F.col("_sum") <= F.col("_left")).groupBy("_key").agg(F.max("_hash").alias("_last_hash"))
    limits = plan.join(end_table, "_key", "left").join(cut, "_key", "left").select("_key", "_passes", "_last_order", "_last_hash")
    stored = spark.createDataFrame(limits.collect(), limits.schema)  # one row per source

    partly = (F.col("_order") < F.col("_last_order")) | ((F.col("_order") == F.col("_last_order")) & (F.col("_hash") <= F.col("_last_hash")))
    passes = F.col("_passes") + F.when(F.coalesce(partly, F.lit(False)), 1).otherwise(0)
    taken = keyed.join(F.broadcast(stored), "_key").withColumn("_taken", passes).where(F.col("_taken") > 0)
    copies = taken.withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_taken"))))
    place = F.xxhash64(F.lit(seed + 2), F.col("epoch"), F.col("_key"), F.col("_block"))
    return copies.withColumn("_place", place).select(
        *[F.col("_row")[c].alias(c) for c in docs.columns if c not in ("epoch", "block", "block_order")], "epoch", F.col("_block").alias("block"), F.col("_place").alias("block_order")
    )
