import random

from pyspark.sql import functions as F

from loam.operators import aliases, graph
from loam.session import Config, Session

IMPORTS = "path string, source string, resolved_path string, is_external boolean, is_dynamic boolean"


def meant(rows, path, source):
    """Brute force: targets of one import by the alias rows."""
    folder = path.rpartition("/")[0] + "/" if "/" in path else ""
    scopes = [s for s in {r[0] for r in rows} if folder.startswith(s)]
    if not scopes or not source:
        return []
    scope = max(scopes, key=len)
    fits = []
    for p in {r[1] for r in rows if r[0] == scope}:
        head, star, tail = p.partition("*")
        if not star and p == source:
            fits.append((1, len(p), 0, p, ""))
        elif star and source.startswith(head) and source.endswith(tail) and len(source) >= len(head) + len(tail):
            fits.append((0, len(head), len(tail), p, source[len(head) : len(source) - len(tail)]))
    if not fits:
        return []
    best = max(fits)
    plain = lambda t: "/".join(x for x in t.split("/") if x)
    return [(k, plain(t.replace("*", best[4], 1)) if "*" in best[3] else t) for s, p, k, t in sorted(rows) if (s, p) == (scope, best[3])]


def test_targets_against_brute_force(spark):
    rng = random.Random(5)
    part = lambda n: "".join(rng.choice("@ab-") for _ in range(rng.randint(0, n)))
    rows = {}
    for scope in ("", "x/", "x/y/", "z/"):
        for _ in range(12):
            p = part(3) + rng.choice(["*", "*", ""]) + part(2)
            for k in range(rng.randint(1, 3)):
                rows[scope, p or "*", k] = rng.choice(["q/*", "r", "s-*.ts"])
    rows = [(*k, t) for k, t in rows.items()]
    paths = ["f.ts", "x/f.ts", "x/y/f.ts", "x/y/w/f.ts", "xy/f.ts", "z/f.ts"]
    asked = [(rng.choice(paths), part(6)) for _ in range(300)] + [(None, "a"), ("f.ts", None), ("x/f.ts", "\U0001f600@a")]
    a, i = spark.createDataFrame(rows, aliases.SCHEMA), spark.createDataFrame(asked, "path string, source string")
    got = {}
    for r in aliases.targets(i, a).collect():
        got.setdefault((r.path, r.source), []).append((r.ord, r.target))
    want = {(p, s): m for p, s in set(asked) if p and s and (m := meant(rows, p, s))}
    assert {k: sorted(v) for k, v in got.items()} == want and len(want) > 50
    assert aliases.targets(i, a.where("false")).count() == 0 and aliases.targets(i.where("false"), a).count() == 0


def test_configs(spark):
    texts = [
        ("tsconfig.json", '{ // ours\n "compilerOptions": {"baseUrl": "./src", "paths": {"@/*": ["*", "../lib/*"], "home": ["index.ts"]}}}'),
        ("web/tsconfig.json", '{"compilerOptions": {"paths": {"~/*": ["./app/*"]}}}'),
        ("bad/jsconfig.json", "{nothing"), ("none/tsconfig.json", '{"compilerOptions": {}}'), ("my-tsconfig.json", '{"compilerOptions": {"paths": {"no": ["x"]}}}'), ("web/app/a.ts", None),
    ]
    a = aliases.from_configs(spark.createDataFrame(texts, "path string, content string"))
    assert sorted(tuple(r) for r in a.collect()) == [("", "@/*", 0, "src/*"), ("", "@/*", 1, "lib/*"), ("", "home", 0, "src/index.ts"), ("web/", "~/*", 0, "web/app/*")]


def test_edges_and_distances(spark):
    files = spark.createDataFrame([(p,) for p in ("src/a.ts", "src/b/index.ts", "lib/c.ts", "src/d.ts")], "path string")
    rows = [
        ("src/a.ts", "@/b", None, True, False), ("src/a.ts", "@/c", None, True, True), ("src/a.ts", "react", None, True, False), ("src/a.ts", "./d.js", "src/d.js", False, True),
        ("src/d.ts", "./a", "src/a", False, True), ("src/d.ts", "@/a", None, True, False), ("src/a.ts", "@/a", None, True, False),
    ]
    i = spark.createDataFrame(rows, IMPORTS)
    a = aliases.table(spark, {"@/*": ["src/*", "lib/*"]})
    e = aliases.edges(i, files, a)
    assert sorted(tuple(r) for r in e.collect()) == [("src/a.ts", "lib/c.ts", True), ("src/a.ts", "src/b/index.ts", False), ("src/a.ts", "src/d.ts", True), ("src/d.ts", "src/a.ts", False)]
    plain = graph.resolve_edges(i, files)
    assert aliases.edges(i, files).drop("lazy").exceptAll(plain.select("src", "dst")).count() == 0 and aliases.edges(i, files).count() == plain.count() == 2
    nodes = files.select(F.col("path").alias("id"))
    start = spark.createDataFrame([("src/b/index.ts",), ("unknown",)], "id string")
    near = lambda most, lazy: {r.id: r.depth for r in aliases.distances(nodes, e, start, most, lazy).collect()}
    assert near(3, 2) == {"src/b/index.ts": 0, "src/a.ts": 1, "src/d.ts": 2, "lib/c.ts": 3}  # d is near by its own import of a
    assert near(2, 2) == {"src/b/index.ts": 0, "src/a.ts": 1, "src/d.ts": 2} and near(2, 1)["lib/c.ts"] == 2


def test_session_resolves_aliases(spark, tmp_path):
    texts = {"src/a.ts": "import { b } from '@/b';\nconst c = await import('#lib/c.js');\nimport x from 'ext';", "src/b.ts": "export const b = 1;", "lib/c.ts": "export const c = 1;", "tsconfig.json": '{"compilerOptions": {"paths": {"@/*": ["src/*"]}}}'}
    s = Session(spark, str(tmp_path), "2024-02-01 00:00:00", Config.merged({"aliases": {"#lib/*": "lib/*"}, "lazy_hops": 2}))
    s.build(spark.createDataFrame([(p, t, len(t)) for p, t in texts.items()], "path string, content string, size long"))
    assert sorted(tuple(r) for r in s._read("lazy_edges").select("src", "dst", "lazy").collect()) == [("src/a.ts", "lib/c.ts", True), ("src/a.ts", "src/b.ts", False)]
    assert sorted(tuple(r) for r in s.blast_radius("lib/c.ts").select("path", "depth").collect()) == [("src/a.ts", 1)]
    assert s.resolve("fix c", ["src/a.ts"]).count() == 1


def test_known_candidates_are_those_of_the_list(spark):
    rng = random.Random(22)
    word = lambda: rng.choice(["a", "b", "index", "a.b", "ts", "x.js", ".ts", "d.mjs"])
    names = lambda n: sorted({"/".join(word() for _ in range(rng.randint(1, 3))) + rng.choice(["", "", *graph.TRIED, "/index.ts", "/index.rb", ".js", ".cjs", "/index", "/"]) for _ in range(n)})
    files, asked = names(500), names(900) + ["a\\b", ".js"]
    f, a = spark.createDataFrame([(x,) for x in files], "path string"), spark.createDataFrame([(x,) for x in asked], "target string")
    got = {}
    for r in graph.known_candidates(a, f).collect():
        got.setdefault(r.target, []).append((r.pos, r.path))
    tried = {r.target: r.c for r in a.select("target", graph.import_candidates(F.col("target")).alias("c")).collect()}
    known = set(files)
    want = {t: [x for x in c if x in known] for t, c in tried.items() if known & set(c)}
    first = lambda xs: list(dict.fromkeys(xs))
    assert {t: first(x for _, x in sorted(c)) for t, c in got.items()} == {t: first(c) for t, c in want.items()} and len(want) > 100


def test_candidates_are_not_shuffled(spark):
    n = 20_000
    files = spark.range(n).selectExpr("concat('src/f', id, '.ts') path")
    i = spark.range(3 * n).selectExpr("concat('src/f', id % 20000, '.ts') path", "concat('@/f', (id * 7) % 20011) source", "cast(null as string) resolved_path", "true is_external", "id % 2 = 0 is_dynamic")
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark.sparkContext._jsc.sc().statusStore()
    def written():
        bus.waitUntilEmpty(30_000)
        return sum(store.executorList(False).apply(k).totalShuffleWrite() for k in range(store.executorList(False).size()))

    before = written()
    rows = aliases.edges(i, files, aliases.table(spark, {"@/*": ["src/*"]})).count()
    want = {(k % n, (k * 7) % 20011) for k in range(3 * n)}
    assert rows == sum(a != b and b < n for a, b in want) and written() - before < 40 * 3 * n
