import pytest
from pyspark.sql import functions as F

from loam.operators import changes, graph, health, overlay, overview, parse, rank, summarise, tags
from loam.session import Config, Session
from loam.sources import files, repository


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_change_detection_and_invalidation(spark):
    s = "path string, hash string, symbol_hash string"
    prev = spark.createDataFrame([("b.ts", "h1", "s1"), ("c.ts", "h1", "s1"), ("d.ts", "h1", "s1"), ("e.ts", "h1", "s1"), ("f.ts", "h1", "s1"), ("g.ts", "x", "x"), ("h.ts", "x", "x"), ("i.ts", "x", "x")], s)
    cur = spark.createDataFrame([("a.ts", "h1", "s1"), ("c.ts", "h1", "s1"), ("d.ts", "h2", "s1"), ("e.ts", "h2", "s2"), ("f.ts", None, None), ("g.ts", "x", "x"), ("h.ts", "x", "x"), ("i.ts", "x", "x")], s)
    c = changes.detect(prev, cur)
    got = {r.path: (r.status, r.signature_changed) for r in c.collect()}
    assert got == {"a.ts": ("added", False), "b.ts": ("deleted", False), "c.ts": ("unchanged", False), "d.ts": ("modified", False), "e.ts": ("modified", True), "f.ts": ("unchanged", False), "g.ts": ("unchanged", False), "h.ts": ("unchanged", False), "i.ts": ("unchanged", False)}
    edges = spark.createDataFrame([("g.ts", "e.ts"), ("h.ts", "g.ts"), ("i.ts", "h.ts")], "src string, dst string")
    stale = changes.invalidated(c, edges)
    assert rows(stale, "path") == [("a.ts",), ("d.ts",), ("e.ts",), ("g.ts",), ("h.ts",)]
    assert rows(changes.carried_forward(prev, stale, c), "path") == [("c.ts",), ("f.ts",), ("i.ts",)]
    assert changes.rebuild_all(False, False) and not changes.rebuild_all(False, True)
    assert changes.rebuild_architecture(True, 4) and not changes.rebuild_architecture(True, 3)
    work = spark.createDataFrame([(f"p{k}", k % 2) for k in range(9)], "path string, level int")
    assert [b for _, b in sorted(((r.path in ("p1", "p3", "p5", "p7"), r.path), r.batch) for r in changes.batches(work, 4).collect())] == [0, 0, 0, 0, 1, 1, 1, 1, 2]


@pytest.mark.parametrize(
    "n, isolated, mutual, large, edges, high, want",
    [(2, 0, 2, 0, 2, 0, (95, "A")), (3, 0, 3, 0, 4, 0, (93, "A")), (10, 1, 0, 1, 10, 1, (82, "B")), (4, 4, 0, 0, 0, 4, (60, "D")), (0, 0, 0, 0, 0, 0, (0, "F"))],
)
def test_health(spark, n, isolated, mutual, large, edges, high, want):
    data = [(f"f{k}.rs", 0 if k < isolated else 1, edges // max(1, n) + (k < edges % max(1, n)), k < mutual, 20001 if k < large else 5, high if k == 0 else 0) for k in range(n)]
    df = spark.createDataFrame(data, "path string, in_degree int, out_degree int, mutual boolean, size int, high_issues int")
    r = health.issues(health.score(df)).first()
    assert (r.score, r.grade) == want
    assert (r.issues == ["No files found"]) == (n == 0)


def test_cost(spark):
    r = health.cost(spark.createDataFrame([(50,)], "n long")).first()
    assert (r.full_in, r.full_out, r.incremental_in, r.incremental_out, r.session_raw, r.reduction_pct) == (48000, 64000, 3400, 3600, 90000, 94)
    assert r.full_cost == pytest.approx(0.0456) and r.break_even == pytest.approx(3.58, abs=0.01)
    assert health.cost(spark.createDataFrame([(0,)], "n long")).first().reduction_pct is None


@pytest.mark.parametrize(
    "arch, want, chunk",
    [(None, ["a", "c", "d"], 10), (80, ["a", "c"], 10), (400, ["a", "d"], 10), (None, ["a", "c", "d"], 1), (400, ["a", "d"], 2)],
)
def test_budget(spark, arch, want, chunk):
    sizes = {"a": 50, "b": 60, "c": 30, "d": 20, "e": 5}
    s = spark.createDataFrame([(k, float(10 - k), i, "x" * (4 * n)) for k, (i, n) in enumerate(sizes.items())], "ord int, score double, id string, content string")
    got = {r.id: r.status for r in rank.fill_budget(s, 100, None if arch is None else "y" * arch, chunk).collect()}
    assert sorted(k for k, v in got.items() if v == "selected") == want
    excluded = {None: {"b"}, 80: {"b"}, 400: {"b", "c"}}[arch]
    assert {k for k, v in got.items() if v == "excluded"} == excluded


def test_budget_against_sequential_scan(spark):
    import random

    r = random.Random(1)
    for _ in range(4):
        items = [(k, r.choice([0.1, 0.5, 0.9]), f"i{k}", "x" * r.choice([0, 3, 40, 100, 400])) for k in range(40)]
        used, want = 0, {}
        for k, s, i, c in sorted(items, key=lambda x: (-x[1], x[0])):
            t = -(-len(c) // 4)
            if used >= 120:
                break
            want[i] = "selected" if used + t <= 120 else "excluded"
            used += t if want[i] == "selected" else 0
        df = spark.createDataFrame(items, "ord int, score double, id string, content string")
        assert {x.id: x.status for x in rank.fill_budget(df, 120, chunk=3).collect()} == want


def artifact_rows(spark, data):
    return spark.createDataFrame(data, "id string, ord int, type string, path string, content string, tags array<string>, generated_at string")


def test_search(spark):
    a = artifact_rows(spark, [("1", 0, "module_summary", "src/payments/delay.ts", "# Backoff\n" + "x" * 1990, ["payments"], None), ("2", 1, "module_summary", "src/retry/index.ts", "y" * 1000 + " retry " + "z" * 993, [], None)])
    got = {r.path: r.score for r in rank.search(a, "retry backoff").collect()}
    assert got["src/payments/delay.ts"] == pytest.approx(0.151082, abs=1e-6)
    assert got["src/retry/index.ts"] == pytest.approx(0.301082, abs=1e-6)
    assert rank.search(a, "  ").count() == 0 and rank.search(a, "retry", "gotcha_entry").count() == 0


def test_relevance(spark):
    a = artifact_rows(spark, [("1", 0, "module_summary", "a/b.ts", "", ["payments", "retry", "x"], "2024-01-31 00:00:00")])
    near = spark.createDataFrame([("a/b.ts", 1)], "path string, depth int")
    degree = spark.createDataFrame([("a/b.ts", 4)], "path string, in_degree int")
    r = rank.relevance(a, "payments", "2024-02-01 00:00:00", "bug_fix", ["other.ts"], near, degree).first()
    assert (r.proximity, r.operation, r.centrality) == (0.7, 0.9, 0.2)
    assert r.score == pytest.approx(0.35 * r.keyword + 0.3 * 0.7 + 0.2 * 0.9 + 0.1 * r.recency + 0.05 * 0.2)
    far = rank.relevance(a, "payments", "2024-02-01 00:00:00", "bug_fix", ["other.ts"], near.where("false"), None).first()
    assert (far.proximity, far.centrality) == (0.05, 0.0)


def test_graph(spark):
    nodes = spark.createDataFrame([(x, f"src/{x}/f.ts") for x in "abcdef"], "id string, path string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "c"), ("e", "d"), ("a", "b"), ("b", "a")], "src string, dst string")
    start = spark.createDataFrame([("a",), ("zz",)], "id string")
    assert rows(graph.distances(nodes, edges, start, 2), "id", "depth") == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    assert rows(graph.blast_radius(nodes, edges, "c"), "id", "depth") == [("a", 2), ("b", 1), ("d", 1), ("e", 2)]
    assert graph.blast_radius(nodes, edges, "nope").count() == 0
    assert rows(graph.dependents(edges, start, 1), "id", "depth") == [("a", 0), ("b", 1), ("c", 1), ("zz", 0)]
    level = {r.id: r.level for r in graph.topological_levels(nodes, edges).collect()}
    assert level["f"] == 0 and len(level) == 6 and len({level[x] for x in "abcde"}) == 1
    dag = edges.where("src in ('d', 'e')")
    order = {r.id: r.level for r in graph.topological_levels(nodes, dag).collect()}
    assert all(order[r.dst] < order[r.src] for r in dag.collect())
    assert graph.mutual_cycles(edges).first()[:] == (2, 1.0)
    assert {r.id: r.in_degree for r in graph.degrees(nodes, edges).collect()} == {"a": 2, "b": 1, "c": 2, "d": 1, "e": 0, "f": 0}
    assert "a: src/a/f.ts" in graph.summary(nodes, edges).first().summary
    assert graph.fuzzy_path(nodes, "a\\f.ts").first().path == "src/a/f.ts"


CODE = [
    ("src/b/c.ts", "import { X as Y, Z } from './a.js';\nimport D, { E } from './m';\nimport * as N from './m'; import './m'; require('./m'); export * from './m';\nconst m = await import('./m');\nimport x from '@/utils';\nimport type T from './t'"),
    ("src/b/a.ts", "export default async function f(\n  a,\n) {"),
    ("pkg/m.py", "from .foo import x\nimport os, sys\n  def inner(a): pass"),
    ("g/x.go", 'import (\n  "fmt"\n)\nfunc Do() {}\n'),
    ("r/x.rs", "use crate::a::b;"),
    ("x/y.c", '#include "foo.h"\n#include <bar.h>'),
    ("p/i.html", '<script src="app.js"></script><script src="https://c/x.js"></script><a href="z.html">'),
    ("docs/a.md", "[t](./b.md#s) ![i](b.png)"),
    ("docs/b.md", ""),
]


def code(spark):
    return spark.createDataFrame([(p, c, len(c)) for p, c in CODE], "path string, content string, size long").withColumn("language", files.scalar.language(F.col("path")))


def test_parsers(spark):
    f = code(spark)
    i = parse.imports(f)
    got = rows(i.select("path", "source", F.coalesce("resolved_path", F.lit("-")).alias("r"), F.array_join("symbols", "+").alias("s"), "is_external"), "path", "source", "r", "s", "is_external")
    assert ("src/b/c.ts", "./a.js", "src/b/a.js", "X+Z", False) in got and ("src/b/c.ts", "./m", "src/b/m", "", False) in got and ("src/b/c.ts", "@/utils", "-", "x", True) in got
    assert sum(g[0] == "src/b/c.ts" for g in got) == 4
    assert ("pkg/m.py", ".foo", "pkg/.foo", "x", False) in got and ("pkg/m.py", "os,", "-", "", True) in got
    assert ("g/x.go", "fmt", "-", "", True) in got and ("r/x.rs", "crate::a::b", "-", "", False) in got
    assert ("x/y.c", "foo.h", "-", "", False) in got and ("x/y.c", "bar.h", "-", "", True) in got
    assert [g[1] for g in got if g[0] == "p/i.html"] == ["app.js"]
    assert rows(graph.resolve_edges(i, f), "src", "dst") == [("docs/a.md", "docs/b.md"), ("src/b/c.ts", "src/b/a.ts")]
    s = {(r.path, r.name): r for r in parse.symbols(f).collect()}
    assert s["src/b/a.ts", "f"].signature == "export default async function f( a, )" and s["pkg/m.py", "inner"].line == 3 and s["g/x.go", "Do"].is_exported
    empty = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert {r.path: r.symbol_hash for r in parse.symbol_hashes(f, parse.symbols(f)).collect()}["docs/b.md"] == empty


def test_globs_and_ignores(spark):
    paths = ["a/node_modules/x.ts", "node_modules/y.ts", "src/a.min.js", "src/a.ts", "yarn.lock", "b/yarn.lock", "log/x.txt", "keep/log/y.txt", "log/keep.txt"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    left = lambda c: [r.path for r in df.where(~c).collect()]
    assert left(files.excluded(F.col("path"), files.DEFAULT_EXCLUDES)) == ["src/a.ts", "log/x.txt", "keep/log/y.txt", "log/keep.txt"]
    assert left(files.ignored(F.col("path"), files.ignore_rules("*.txt\n!keep.txt\n/src\n#c"))) == paths[:2] + ["yarn.lock", "b/yarn.lock", "log/keep.txt"]
    assert "log/keep.txt" not in left(files.ignored(F.col("path"), files.ignore_rules("log/\n!keep.txt")))


def test_overlay(spark):
    s = "module_id string, content string"
    main, own = spark.createDataFrame([("m1", "A"), ("m2", "B")], s), spark.createDataFrame([("m1", "A"), ("m2", "B2"), ("m3", "C")], s)
    assert rows(overlay.classify(main, own), "module_id", "kind") == [("m1", "skipped"), ("m2", "conflict"), ("m3", "branch_new")]
    assert overlay.merge(main, own)[1].first()[:] == (1, 1, 1)
    assert overlay.merge(main, own, lambda m, b: F.concat(m, b))[1].first()[:] == (1, 2, 1)
    assert rows(overlay.merge(main, own)[0], "module_id", "content") == [("m2", "B"), ("m3", "C")]
    assert rows(overlay.read(main, own), "module_id", "content") == [("m1", "A"), ("m2", "B2"), ("m3", "C")]
    notes = spark.createDataFrame([("m1", "n"), ("m9", "n")], "module_id string, note string")
    assert rows(overlay.add_context(main, notes), "content") == [("A" + overlay.MARK + "n",), ("n",)]
    b = overlay.create(spark.createDataFrame([], "name string, created_at timestamp_ntz, parent string, description string, last_updated timestamp_ntz"), "My Branch", "2024-01-01")
    assert b.first().name == "my-branch" and overlay.delete(b, "My Branch").count() == 0


def test_provider_retries():
    calls, slept = [], []

    def flaky(*a):
        calls.append(a)
        if len(calls) < 3:
            raise summarise.LimitError("busy")
        return "ok"

    assert summarise.complete(flaky, "s", "u", 10, 0.1, sleep=slept.append) == "ok" and slept == [1.0, 2.0]

    def too_long(*a):
        calls.append(a)
        raise ValueError("maximum context length")

    calls.clear()
    with pytest.raises(ValueError):
        summarise.complete(too_long, "s", "u", 10, 0.1, sleep=slept.append)
    assert len(calls) == 1


def test_tags(spark):
    t = spark.createDataFrame([(1, "src/core/f.md", "Zeta Alpha Zeta Alpha Once"), (2, "x.md", "")], "id int, path string, content string")
    assert {r.id: r.tags for r in tags.content_tags(t).collect()} == {1: ["src", "core", "zeta", "alpha"], 2: []}


def test_session_builds_incrementally(spark, tmp_path):
    s = Session(spark, str(tmp_path / "ctx"), "2024-02-01 00:00:00", Config.merged({"parallel_workers": 2, "unknown": 1}, {"exclude_paths": ["**/skip/**"]}))
    f = code(spark).where("size > 0").select("path", "content", "size")
    first = s.build(f).first()
    assert (first.total_files, first.rebuilt) == (8, 8)
    again = s.build(f).first()
    assert again.rebuilt == 0
    changed = f.withColumn("content", F.when(F.col("path") == "src/b/a.ts", F.lit("export function g() {")).otherwise(F.col("content")))
    third = s.build(changed).first()
    assert third.rebuilt == 2  # the file and its importer
    assert s.search("import").count() > 0
    assert "PRIMARY" in s.resolve("fix the import", ["src/b/c.ts"]).first().package or "SUPPORTING" in s.resolve("fix the import", ["src/b/c.ts"]).first().package
    assert s.status().first().files == 8 and s.health().first().grade in "ABCDF"
    assert rows(s.blast_radius("b/a.ts"), "path", "depth") == [("src/b/c.ts", 1)]
    assert s.module("b/a.ts").count() == 1 and s.cost().count() == 1 and s.index().count() > 1
    folder = tmp_path / "repo" / "src"
    folder.mkdir(parents=True)
    (folder / "a.ts").write_text("export const x = 1;")
    (folder / ".hidden.ts").write_text("export const y = 1;")
    t = Session(spark, str(tmp_path / "two"), "2024-02-01 00:00:00")
    assert t.build(str(tmp_path / "repo")).first().total_files == 1
    assert t.nodes().first().path == "src/a.ts"


def test_build_follows_imports(spark, tmp_path, monkeypatch):
    def depends(system, user, max_tokens, temperature):
        """The path and what it depends on, as told; other prompts by their kind."""
        if not user.startswith("File: "):
            return "architecture of it" if "architecture" in user[:60] else "flows of it"
        return user.split("\n\n")[0][6:] + ": " + user.split("Depends on:\n")[1].split("\n\n")[0]

    monkeypatch.setitem(summarise.REGISTRY, "depends", depends)
    said = []
    s = Session(spark, str(tmp_path / "ctx"), "2024-02-01 00:00:00", Config(provider="depends"), lambda *a: said.append(a))
    f = spark.createDataFrame([("src/a.ts", 'import { b } from "./b";\nexport const a = 1;'), ("src/b.ts", "export const b = 2;"), ("src/c.ts", "const c = 3;")], "path string, content string")
    s.build(f.withColumn("size", F.length("content").cast("long")))
    told = dict(rows(s._read("artifacts"), "path", "content"))
    assert told["src/b.ts"] == "src/b.ts: none" and told["src/a.ts"] == "src/a.ts: src/b.ts: none"  # a's prompt has b's new summary
    assert ("summaries", 2, 2) in said and ("overviews", 1, 1) in said and said[-1] == ("index", 1, 1)
    assert s.architecture().startswith("architecture") and [r.ok for r in s.doctor().orderBy("ord").collect()] == [True] * 6 + [False]
    assert s.artifacts("task").where("type = 'execution_flow'").count() == 1 and s.artifacts("task").where("type = 'architecture_overview'").count() == 0
    assert s.artifacts().count() == 5 and s._read("primer").first().content.startswith("# repository")
    assert "ARCHITECTURE OVERVIEW" in s.resolve("find a bug").first().package
    plain = Session(spark, str(tmp_path / "plain"), "2024-02-01 00:00:00", Config(provider="depends", flow_extraction=False))
    assert not any(r.ok for r in plain.doctor().where("ord in (3, 4, 5)").collect())  # nothing built yet
    s.config = plain.config
    s._overviews(s._read("edges"), s._read("symbols"), s._read("artifacts"))
    assert s._read("overviews").count() == 1


def test_overview_prompts_are_bounded(spark):
    n = spark.range(3000).select(F.format_string("g%05d/f.ts", "id").alias("id")).select("id", F.col("id").alias("path"), F.lit("typescript").alias("language"))
    e = spark.createDataFrame([], "src string, dst string")
    one = overview.domains(n.select("path", F.lit("text").alias("content"))).first().joined
    assert one.startswith("### Domain: g00000\ntext\n\n---\n\n### Domain: g00001") and 24000 < len(one) < 24100
    assert overview.domains(n.select("path", F.lit(None).cast("string").alias("content"))).first().joined == ""
    x = spark.createDataFrame([("g00000/f.ts", k, f"n{k}") for k in range(9, 0, -1)], "path string, line int, name string")
    text = overview.flows_prompt("r", n, e, x, n.select("path", F.lit("text").alias("content"))).first().prompt
    assert "- g00000/f.ts (n1, n2, n3, n4, n5)\n- g00001/f.ts ()" in text and text.count("\n- ") == 10 and text.count("text") == 15


def test_configuration_files(tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    with pytest.raises(FileNotFoundError):
        repository.load_config(tmp_path)
    repository.save_config(tmp_path, {"provider": {"name": "extract", "api_key": "k-1"}, "exclude_paths": ["x"]})
    assert "k-1" not in (tmp_path / repository.CONFIG).read_text() and repository.find_root(tmp_path / "a" / "b") == tmp_path.resolve()
    assert repository.load_config(tmp_path, {})["provider"] == {"name": "extract", "api_key": "k-1"}
    (tmp_path / repository.LOCAL).write_text("{}")
    assert repository.load_config(tmp_path, {"LOAM_API_KEY": "k-2"})["provider"]["api_key"] == "k-2"
    repository.save_config(tmp_path, {"provider": {}})
    assert repository.load_config(tmp_path, {"GROQ_API_KEY": "g", "OPENAI_API_KEY": "o"})["provider"]["api_key"] == "o"
    assert repository.merged({"a": {"b": 1, "c": [1]}, "d": 1}, {"a": {"c": [2]}, "e": 2}) == {"a": {"b": 1, "c": [2]}, "d": 1, "e": 2}
    assert Config.load(tmp_path).repository == tmp_path.name
    assert repository.git_metadata(tmp_path)["commit"] == "unknown"


def test_shrink_and_fallback():
    def small(system, user, *a):
        if len(user) > 70:
            raise ValueError("maximum context length")
        return f"{len(user)}"

    assert summarise.complete(small, "s", "u" * 100, 10, 0.1, shrink=0.8) == "64"
    assert summarise.complete(small, "s", "u" * 100, 10, 0.1, fallback=lambda *a: "other") == "other"
    assert summarise.validate("extract")[0] and summarise.validate("no such")[0] is False
