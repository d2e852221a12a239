import math

import numpy as np
from pyspark.sql import functions as F

from loam.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, asks, positives=5, negatives=3):
    good = []
    for i, e, lab in rows:
        if i is None or lab is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        y = [math.floor(256 * x) for x in e]
        if sum(v * v for v in y) <= 1 << 62:
            good.append((i, y, lab))
    out = []
    for i, y, lab in good:
        if not asks(i):
            continue
        scored = sorted(((-sum(a * b for a, b in zip(y, z, strict=False)), j, m == lab) for j, z, m in good if j != i), key=lambda r: r[:2])
        for s, j, _ in [r for r in scored if r[2]][:positives]:
            fits = [(n, k) for n, k, same in scored if not same and 50 * -s <= 100 * -n <= 95 * -s]
            out += [(i, j, r + 1, k, -s, -n) for r, (n, k) in enumerate(fits[:negatives])]
    return sorted(out)


def mined(df, **kw):
    return sorted(tuple(r) for r in H.mine(df, F.col("vec_id") % 10 == 0, **kw).collect())


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    centers = rng.standard_normal((6, 12))
    rows = [(k, (centers[k % 6] + rng.standard_normal(12) * (0.2 + k % 3)).tolist(), int(rng.integers(0, 4))) for k in range(600)]
    rows += [(700 + k, rows[20][1], k % 2) for k in range(90)]  # copies, an anchor among them: ties
    rows += [(800, None, 1), (810, [float("nan")] * 12, 1), (820, [None] + rows[0][1][1:], 1), (830, rows[3][1], None), (840, [1e300] * 12, 1), (850, [], 1), (860, [0.5, 0.5], 2), (870, [0.0] * 12, 3), (None, rows[4][1], 1)]
    rows += [(30, rows[31][1], 0), rows[40], (-10, rows[10][1], 2), (900, [2.0**30] + [0.0] * 11, 0), (901, [2.0**21] * 12, 0), (902, [2.0**20] * 12, 1), (910, [2.0**21] * 12, 0)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as id", "2 as rank", "3 as `e.f`").repartition(5)
    want = brute(rows, lambda i: i % 10 == 0)
    assert len(want) > 400
    assert mined(df) == want
    assert mined(df, part_bytes=12 * 16 * 20, seed=3) == want  # several parts


def test_bounds_keep_all(spark):
    rng = np.random.default_rng(6)
    a, x = rng.integers(-300, 300, (40, 32)), rng.integers(-300, 300, (50, 32)) * np.array([8] * 4 + [1] * 28)
    turn, ends = H.axes((x.T @ x).astype(float)), H.ends_of(32)
    assert np.allclose(turn.T @ turn, np.eye(32))
    true = a @ x.T
    need, most = np.sort(true, 1)[:, -9].astype(float), np.sort(true, 1)[:, -3].astype(float)
    i, j = H.surviving(H.Rotated.of(a, turn, ends), H.Rotated.of(x, turn, ends), ends, need, most)
    kept = set(zip(i.tolist(), j.tolist(), strict=True))
    assert kept == set(zip(*(k.tolist() for k in np.nonzero((true >= need[:, None]) & (true <= most[:, None]))), strict=True))


def test_empty_and_without_anchors(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert mined(none) == [] and H.mine(none, F.col("vec_id") % 10 == 0).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert mined(spark.createDataFrame([(1, [1.0], 1), (2, [1.0], 2)], SCHEMA)) == []
    assert mined(spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 1)], SCHEMA)) == []
    assert mined(spark.createDataFrame([(0, [], 1), (1, [], 1), (2, [], 0)], SCHEMA)) == [(0, 1, 1, 2, 0, 0)]
