import random

from loam.operators import graph


def brute(paths, asked):
    out = {}
    for a in {x for x in asked if x}:
        t = a.replace("\\", "/")
        ranked = [(0 if p == a else 1 if p == t else 2 if p.endswith(t) else 3, p) for p in paths if p and (p == a or t in p or p in t)]
        if ranked:
            out[a] = min(ranked)
    return out


def test_against_brute_force(spark):
    rng = random.Random(2)
    part = lambda: "".join(rng.choice("ab/.x") for _ in range(rng.randint(1, 9)))
    paths = [part() + part() + part() for _ in range(120)] + ["a\\b", "é/\U0001f600.ts", "x" * 300]
    asked = [rng.choice(paths)[rng.randint(0, 3) :][: rng.randint(1, 30)] for _ in range(80)] + [part() for _ in range(30)] + ["a\\b", "b\\a", "zz" + paths[0] + "zz", "", None, "\U0001f600", "nothing like it", "x" * 299, "a", paths[5], paths[5]]
    nodes = spark.createDataFrame([(p,) for p in [*paths, paths[3], None, ""]], "path string")
    got = {r.asked: (r.rank, r.path) for r in graph.fuzzy_paths(nodes, spark.createDataFrame([(a,) for a in asked], "asked string")).collect()}
    assert got == brute(paths, asked) and len(got) > 60


def test_empty(spark):
    one = spark.createDataFrame([("a",)], "path string")
    assert graph.fuzzy_paths(one.where("false"), one.withColumnRenamed("path", "asked")).count() == 0
    assert graph.fuzzy_paths(one, one.withColumnRenamed("path", "asked").where("false")).count() == 0
