"""Context folders: reading, adoption by a session, and the forms of a package."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from loam.operators import rank
from loam.session import Session
from loam.sources import context_tree

AS_OF = "2024-02-01 00:00:00"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def module(path: str, text: str, **more) -> dict[str, str]:
    meta = {"id": sha(text), "type": "module_summary", "path": path, "tags": ["src"], "metadata": {"generatedAt": "2024-01-31T22:00:00.000Z", "generatedBy": "x/y", "sourceHash": sha(path), "tokenCount": 3, "version": 2, "confidence": 0.9}} | more
    at = f"artifacts/modules/{sha(path)}/"
    return {at + "summary.md": text, at + "meta.json": json.dumps({k: v for k, v in meta.items() if v is not None}, indent=2)}


def folder() -> dict[str, str]:
    files = module("src/a.ts", "# A\nParses the lexer tokens.") | module("src/b.ts", "# B\nCalls the parser.", tags=None) | module("src/build/c.ts", "", metadata=None)
    files |= {"artifacts/modules/only/summary.md": "no metadata", "artifacts/modules/bad/summary.md": "x", "artifacts/modules/bad/meta.json": "{", f"artifacts/modules/{sha('src/a.ts')}/gotchas.md": "Mind the lexer."}
    files |= {"artifacts/architecture.md": "Two parts.", "artifacts/flows.md": "a to b", "artifacts/architecture.md.meta.json": "[1]"}
    entry = lambda p, h: {"path": p, "hash": h, "symbolHash": "s", "size": 5, "language": "typescript"}
    files["snapshot/manifest.json"] = json.dumps({"buildId": "b7", "timestamp": "2024-01-31T23:30:00.000Z", "files": {p: entry(p, h) for p, h in (("src/a.ts", "1"), ("src/b.ts", "2"))}, "buildStats": {"totalFiles": 2, "totalModules": 2, "modulesRebuilt": 1, "totalTokensConsumed": 9, "buildDurationMs": 1500}})
    node = lambda p, *to: {"path": p, "imports": list(to)}
    files["snapshot/graph.json"] = json.dumps({"nodes": {sha("src/a.ts"): node("src/a.ts"), sha("src/b.ts"): node("src/b.ts", sha("src/a.ts"), "gone")}})
    files |= {"branches/build/meta.json": json.dumps({"name": "build", "createdAt": "2024-01-01T00:00:00.000Z"}), "branches/build/notes.md": "notes", f"branches/build/modules/{sha('src/a.ts')}/summary.md": "A on a branch", "branches/worse/meta.json": "{]"}
    return files


@pytest.fixture(scope="module")
def files(spark):
    rows = [(p, c, 1) for p, c in folder().items()] + [("artifacts/modules/none/summary.md", None, 2)]
    return spark.createDataFrame(rows, "path string, content string, module_id int")


def test_modules(files):
    got = {r["path"]: r for r in context_tree.modules(files).collect()}
    assert set(got) == {"src/a.ts", "src/b.ts", "src/build/c.ts"}
    assert got["src/b.ts"]["tags"] == [] and got["src/build/c.ts"]["metadata"] is None and got["src/build/c.ts"]["content"] == ""
    assert got["src/a.ts"]["module_id"] == sha("src/a.ts") and str(got["src/a.ts"]["metadata"]["generated_at"]) == "2024-01-31 22:00:00"


def test_overviews_have_defaults(files):
    got = {r["type"]: r for r in context_tree.overviews(files, AS_OF).collect()}
    assert set(got) == {"architecture_overview", "execution_flow"}
    assert got["architecture_overview"]["id"] == "arch" and got["execution_flow"]["id"] == "flows"
    assert all(str(r["metadata"]["generated_at"]) == AS_OF and r["metadata"]["confidence"] == 0.8 and r["tags"] == [] for r in got.values())


def test_architecture_with_metadata(spark):
    meta = json.dumps({"id": "own", "tags": ["t"], "metadata": {"generatedAt": "2024-01-01T00:00:00.000Z", "version": 4}})
    got = context_tree.overviews(spark.createDataFrame([("artifacts/architecture.md", "x"), ("artifacts/architecture.md.meta.json", meta)], "path string, content string"), AS_OF).first()
    assert got["id"] == "own" and got["tags"] == ["t"] and got["metadata"]["version"] == 4


def test_no_files(spark):
    none = spark.createDataFrame([], "path string, content string")
    for f in (context_tree.modules, context_tree.branches, context_tree.overrides, context_tree.manifest, context_tree.edges, context_tree.build_summary):
        assert f(none).isEmpty()
    assert context_tree.overviews(none, AS_OF).isEmpty() and context_tree.gotchas(none, AS_OF).isEmpty()


def test_broken_snapshot(spark):
    bad = spark.createDataFrame([("snapshot/manifest.json", "{"), ("snapshot/graph.json", "nothing")], "path string, content string")
    assert context_tree.manifest(bad).isEmpty() and context_tree.edges(bad).isEmpty() and context_tree.build_summary(bad).isEmpty()


def test_adopted_from_disk(spark, tmp_path):
    for path, content in folder().items():
        at = tmp_path / "context" / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(content)
    s = Session(spark, f"file://{tmp_path}/tables", AS_OF)
    assert s.adopt(str(tmp_path / "context")).count() == 3
    assert s.search("lexer", limit=1).first()["path"] == "src/a.ts"
    assert [(r["name"], r["parent"], r["notes"]) for r in s.branches().collect()] == [("build", "main", "notes")]
    assert {r["content"] for r in s.branch("build").collect()} == {"A on a branch", "# B\nCalls the parser.", ""}
    assert [r["path"] for r in s.blast_radius("src/a.ts").collect()] == ["src/b.ts"]
    assert s.diff().first().asDict() == {"build_id": "b7", "generated": "30m ago", "modules_rebuilt": 1, "total_modules": 2, "total_files": 2, "tokens": 9, "duration": "1.5s"}
    shown = [r["display"] for r in s.diff("src/a.ts").where("display like '%Version 2 | Generated 2h ago%'").collect()]
    assert len(shown) == 1 and shown[0].endswith(f"Source hash: {sha('src/a.ts')[:8]}\n\n# A\nParses the lexer tokens.")
    assert s.architecture() == "Two parts."
    text = s.resolve("explain the lexer", ["src/a.ts"]).first()["package"]
    assert text.startswith("📦 Context Package — ") and "ARCHITECTURE OVERVIEW\n" in text and "### src/a.ts\n# A" in text
    s.build(spark.createDataFrame([("src/a.ts", "export const a = 1;", 19)], "path string, content string, size long"), full=True)
    assert s.diff().first()["total_files"] == 1 and s.diff().first()["generated"] == "just now"


def test_package_forms(spark):
    scored = spark.createDataFrame(
        [("m1", 1, 0.9, "module_summary", "a.ts", "aaaa"), ("m2", 2, 0.3, "module_summary", "b.ts", "bbbbbbbb"), ("f", 3, 0.2, "execution_flow", "", "flow"), ("g", 4, 0.1, "gotcha_entry", "", "care"), ("big", 5, 0.8, "module_summary", "c.ts", "c" * 400)],
        "id string, ord long, score double, type string, path string, content string",
    )
    filled = rank.fill_budget(scored, 20)
    sectioned, contents = rank.sections(filled, scored), scored.select("id", "content")
    rule = "─" * 60
    text = rank.package(sectioned, contents, "text", None, filled, 12).first()["package"]
    assert text == "\n".join(
        ["📦 Context Package — 5 tokens (resolved in 12ms)", "⚠️  1 relevant artifacts excluded due to token budget", "", rule, "📁 PRIMARY MODULES (1)", rule, "\n### a.ts\naaaa", rule, "📎 SUPPORTING CONTEXT (1)", rule, "\n### b.ts\nbbbbbbbb", rule, "🔄 EXECUTION FLOWS", rule, "flow", rule, "⚠️  GOTCHAS", rule, "care"]
    )
    told = json.loads(rank.package(sectioned, contents, "json", "Arch", filled).first()["package"])
    assert told == {"tokenCount": 6, "primary": [{"path": "a.ts", "content": "aaaa"}], "supporting": [{"path": "b.ts", "content": "bbbbbbbb"}], "architecture": "Arch", "flows": ["flow"], "gotchas": ["care"], "excludedCount": 1}
    assert rank.package(sectioned, contents, "compact", "Arch", filled).first()["package"] == "## Architecture Overview\nArch\n\n---\n\n## a.ts\naaaa\n\n---\n\n## b.ts\nbbbbbbbb\n\n---\n\n## Key Flows\nflow"
    none = scored.where(F.lit(False))
    empty = rank.fill_budget(none, 20)
    assert rank.package(rank.sections(empty, none), contents, "text", None, empty).first()["package"] == "📦 Context Package — 0 tokens\n"
