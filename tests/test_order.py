import random
import time

from loam.operators import order


def tables(spark, n, edges):
    return spark.createDataFrame([(k,) for k in range(n)], "id int"), spark.createDataFrame(edges, "src int, dst int")


def brute(n, edges):
    out = {k: set() for k in range(n)}
    for a, b in edges:
        if a in out and b in out and a != b:
            out[a].add(b)
    reach = {}
    for k in range(n):
        seen, todo = {k}, [k]
        while todo:
            for x in out[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        reach[k] = seen
    comp = {k: min(x for x in reach[k] if k in reach[x]) for k in range(n)}
    level = {}

    def of(c):
        if c not in level:
            level[c] = max((of(comp[b]) + 1 for a in range(n) if comp[a] == c for b in out[a] if comp[b] != c), default=0)
        return level[c]

    return sorted((k, comp[k], of(comp[k])) for k in range(n))


def test_against_brute_force(spark):
    rng = random.Random(8)
    for n, m in ((14, 12), (25, 45)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(3, 3), (2, 99)]
        got = sorted(tuple(r) for r in order.condensed_levels(*tables(spark, n, edges)).collect())
        assert got == brute(n, edges), (n, edges)


def test_rings_that_hang_together(spark):
    ring = [(k, (k + 1) % 12) for k in range(12)]
    edges = ring + [(20 + k, 20 + (k + 1) % 7) for k in range(7)] + [(5, 15), (15, 16), (16, 22), (30, 3), (31, 30), (24, 35), (35, 36)]
    assert sorted(tuple(r) for r in order.condensed_levels(*tables(spark, 40, edges)).collect()) == brute(40, edges)


def test_a_chain_of_100_000_nodes(spark):
    n = 100_000
    nodes = spark.range(n).selectExpr("cast(id as int) id")
    chain = nodes.where("id > 0").selectExpr("id src", "id - 1 dst")
    status = spark.sparkContext.statusTracker()
    before = max([0, *status.getJobIdsForGroup(None)])
    t = time.time()
    got = order.acyclic_levels(nodes, chain)
    row = got.selectExpr("count(*) n", "max(level) top", "sum(abs(level - id)) off").first()
    assert (row.n, row.top, row.off) == (n, n - 1, 0)
    assert time.time() - t < 120 and max(status.getJobIdsForGroup(None)) - before < 200


def test_empty(spark):
    assert order.condensed_levels(*tables(spark, 0, [])).count() == 0


def test_cycles_within_cycles_and_trees_on_rings(spark):
    rng = random.Random(31)
    for n in (9, 16, 30):
        edges = [(rng.randrange(k), k) for k in range(1, n)] + [(k, rng.randrange(k)) for k in rng.sample(range(1, n), n // 3)]
        edges += [(n + k, n + (k + 1) % 5) for k in range(5)] + [(n + 2, n + 5), (n + 5, n + 6), (n + 7, n + 8), (n + 8, n + 7), (n + 8, rng.randrange(n))]
        edges = [(a, b) if rng.random() < 0.9 else (b, a) for a, b in edges]
        assert sorted(tuple(r) for r in order.condensed_levels(*tables(spark, n + 9, edges)).collect()) == brute(n + 9, edges), edges


def test_many_cycles_along_a_chain_take_few_jobs(spark):
    n, every = 3000, 50
    nodes = spark.range(n).selectExpr("cast(id as int) id")
    edges = nodes.where("id > 0").selectExpr("id src", "id - 1 dst").union(nodes.where(f"id % {every} = 0").selectExpr("id src", "id + 3 dst"))
    status = spark.sparkContext.statusTracker()
    before = max([0, *status.getJobIdsForGroup(None)])
    rows = order.condensed_levels(nodes, edges).collect()
    top = [k - k % every if k % every < 4 else k for k in range(n)]
    level = {c: x for x, c in enumerate(sorted(set(top)))}
    assert sorted(map(tuple, rows)) == [(k, c, level[c]) for k, c in enumerate(top)]
    assert max(status.getJobIdsForGroup(None)) - before < 400
