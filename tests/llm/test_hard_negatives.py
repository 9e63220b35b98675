"""Hard negatives against plain inner products."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from lexiloom.llm import hard_negatives as hn

SCHEMA = "vec_id long, label int, vector array<float>, score string, anchor int"


def frame(spark, rows):
    return spark.createDataFrame([(i, x, v, "s", 1) for i, x, v in rows], SCHEMA)


def plain(rows, is_anchor, positives=5, negatives=10, least=30, most=90):
    sound = {(i, x, None if v is None else tuple(v)) for i, x, v in rows if x is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)}
    whole = [(i, x, [math.floor(256 * float(np.float32(c))) for c in v]) for i, x, v in sound]
    out = []
    last = lambda i: (i is None, i or 0)
    for a, label, q in whole:
        if not is_anchor(a):
            continue
        scored = sorted(((-sum(p * r for p, r in zip(q, w)), last(i), i, x) for i, x, w in whole if i != a), key=lambda s: s[:2])
        for minus, _, positive, _ in [s for s in scored if s[3] == label][:positives]:
            ranked = [(i, -m) for m, _, i, x in scored if x != label and least * -minus <= 100 * -m <= most * -minus][:negatives]
            out += [(a, positive, k, i, -minus, s) for k, (i, s) in enumerate(ranked, 1)]
    return sorted(map(repr, out))


def mined(spark, rows, **more):
    return sorted(repr(tuple(r)) for r in hn.mine(frame(spark, rows), F.col("vec_id") % 10 == 0, **more).collect())


def vectors(n, dims, seed=1, scale=0.3):
    rng = random.Random(seed)
    return [(k, rng.randrange(3), [rng.gauss(0, scale) for _ in range(dims)]) for k in range(n)]


def test_equals_plain_products(spark):
    rows = vectors(300, 19)
    assert mined(spark, rows) == plain(rows, lambda i: i % 10 == 0) != []


def test_ties_copies_nulls_and_odd_lengths(spark):
    rows = vectors(60, 9, 2)
    common = rows[5][2]
    rows += [(100 + k, k % 3, common) for k in range(60)]  # one vector with half of the rows
    rows += [rows[20], rows[20], (20, 2, [0.5] * 9), (None, 1, common), (None, 1, common), (400, 1, []), (410, 2, [1.0] * 3), (411, 2, [1.0] * 20)]
    rows += [(420, None, common), (421, 1, None), (422, 1, [None] * 9), (423, 1, [float("nan")] * 9), (430, 0, [float("inf")] * 9), (440, 1, [-0.5] * 9)]
    expected = plain(rows, lambda i: i is not None and i % 10 == 0)
    assert mined(spark, rows) == expected != []
    assert mined(spark, rows, shard_mb=0.001) == expected  # several shards of anchors


def test_large_components_take_wider_numbers(spark):
    rows = vectors(80, 9, 3, 1e6)
    assert mined(spark, rows) == plain(rows, lambda i: i % 10 == 0) != []


def test_empty_tables(spark):
    assert mined(spark, []) == [] and mined(spark, [(None, None, None)]) == [] and mined(spark, [(10, 1, [1.0])]) == []


def test_tables_and_planes_are_exact():
    rng = np.random.default_rng(5)
    for low, high in ((-3, 4), (-130, 90), (0, 1), (-(2**40), 2**40)):
        a, c = rng.integers(low, high, (7, 24)), rng.integers(low, high, (1500, 24))
        planes = hn.bit_planes(c)
        assert (hn.numbers(planes)[:, :24] == c).all()
        assert (hn.scores(hn.subset_tables(a, np.int64), planes) == c @ a.T).all()


def test_blocks_do_not_change_the_result(spark, monkeypatch):
    rows = vectors(200, 8, 6)
    monkeypatch.setattr(hn, "_ANCHORS", 3)
    assert mined(spark, rows) == plain(rows, lambda i: i % 10 == 0)
