import math

import numpy as np

from loam.llm import cap_filters as C


def brute(rows, least=0.98):
    good = []
    for i, e, lab in rows:
        if lab is None or not e or any(x is None or not math.isfinite(x) for x in e) or not any(e):
            continue
        good.append((i, np.array(e, float) / np.linalg.norm(e), lab))
    n, parent = {i: 0 for i, _, _ in rows}, {i: i for i, _, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, x, p) in enumerate(good):
        for b, y, q in good[:k]:
            if p == q and len(x) == len(y) and x @ y >= least:
                n[a] += 1
                n[b] += 1
                u, w = find(a), find(b)
                parent[max(u, w)] = min(u, w)
    return {i: (n[i], find(i)) for i in n}


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows, k = [], 0
    for c in range(25):
        base = rng.standard_normal(24)
        for _ in range(int(rng.integers(1, 14))):
            v = base + rng.standard_normal(24) * rng.choice([0, 0.02, 0.1, 0.17])
            rows.append((1000 - k, np.float32(v).tolist(), c % 3))
            k += 1
    rows += [(2000, None, 1), (2001, [0.0] * 24, 1), (2002, [float("nan")] * 24, 1), (2003, rows[0][1], None), (2004, [None] + rows[0][1][1:], 0), (2005, [], 0), (2006, [1.0, 2.0], 0), (2007, [2.0, 4.0], 0), (2008, [float("inf")] * 24, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as rep", "2 as links").repartition(4)
    want = brute(rows)
    for chunk in (1500, 3):
        got = {r.vec_id: r for r in C.near(df, chunk=chunk).collect()}
        assert len(got) == len(rows)
        links = sum(n for n, _ in want.values())
        assert links > 200
        assert sum(r.n_links for r in got.values()) >= 0.95 * links
        assert all(r.n_links <= want[i][0] and r.kept == (r.component_id == i) for i, r in got.items())
        assert sum(got[i].component_id == c for i, (_, c) in want.items()) >= 0.97 * len(rows)


def test_empty(spark):
    assert C.near(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_few_dimensions_repeated_ids_and_empty(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert C.near(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, [1.0, 0.0, 0.0], 0), (2, [1.0, 0.01, 0.0], 0), (3, [0.0, 1.0, 0.0], 0), (4, [0.0, 0.0], 0), (5, [2.0], 0), (6, [3.0], 0), (7, [-1.0], 0)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in C.near(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4), 5: (1, 5), 6: (1, 5), 7: (0, 7)}
    a, b = [1.0] * 16 + [0.0] * 16, [0.0] * 16 + [1.0] * 16
    rows = [(5, a, 1), (6, a, 1), (5, b, 2), (7, b, 2), (8, b, 2)]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in C.near(spark.createDataFrame(rows, schema)).collect())
    assert got == [(5, 1, 5), (5, 2, 5), (6, 1, 5), (7, 2, 5), (8, 2, 5)]


def test_huge_and_tiny_components(spark):
    rows = [(1, [1e200, 1e200], 0), (2, [1e200, 1e200], 0), (3, [1e-200, 1e-200], 0), (4, [2e-200, 2e-200], 0), (5, [5e-324, 0.0], 0), (6, [1.7e308, 1e300], 0), (7, [1e200, -1e200], 0), (8, [3.0, 3.0], 0), (9, [0.0, 0.0], 0)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in C.near(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (4, 1), 2: (4, 1), 3: (4, 1), 4: (4, 1), 5: (1, 5), 6: (1, 5), 7: (0, 7), 8: (4, 1), 9: (0, 9)}
