from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from loam.functions import scalar as S


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_keywords_and_overlap(spark):
    k = lambda t: S.keywords(F.lit(t))
    r = one(spark, k("Fix the exponential backoff in payment retry: retry-policy!"), k("src/payments/retry.ts"), k("éclair naïveté"), k(None), S.keyword_overlap(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("b"), F.lit("c"))), S.keyword_overlap(F.array().cast("array<string>"), F.array(F.lit("b"))))
    assert r[0] == ["exponential", "backoff", "payment", "retry", "retry-policy"]
    assert r[1] == ["payments", "retry"] and r[2] == ["clair"] and r[3] == []
    assert r[4] == pytest.approx(1 / 3) and r[5] == 0


def test_operation(spark):
    cases = {"add tests for payment module": "feature_add", "fix payment retry": "bug_fix", "explain how requests flow": "explain", "testing coverage": "test", "rename build target": "feature_add", "hello": "auto", "éfix": "bug_fix", "prefix_fix": "auto"}
    assert list(one(spark, *[S.operation(F.lit(t)) for t in cases])) == list(cases.values())


def test_paths(spark):
    groups = {"src/core/types.ts": "core", "src/index.ts": "index.ts", "lib/x.ts": "x.ts", "foo/bar.ts": "foo", "a.ts": "root", "packages/a/src/b/c.ts": "b"}
    assert list(one(spark, *[S.module_group(F.lit(p)) for p in groups])) == list(groups.values())
    kinds = {"a.d.ts": "typescript", "x.H": "c", "x.hpp": "cpp", "Makefile": "unknown", ".gitignore": "unknown", "d.x/y": "unknown"}
    assert list(one(spark, *[S.language(F.lit(p)) for p in kinds])) == list(kinds.values())
    moves = {("./a.js", "src/b/c.ts"): "src/b/a.js", ("../../../x", "a/b.ts"): "../../x", (".foo", "pkg/m.py"): "pkg/.foo", ("@/utils", "a.ts"): None, ("./b", "a.ts"): "b", ("..", "a/b/c.ts"): "a"}
    assert list(one(spark, *[S.resolve_import(F.lit(s), F.lit(p)) for s, p in moves])) == list(moves.values())


def test_texts(spark):
    assert list(one(spark, *[S.duration(F.lit(x)) for x in (999, 1000, 60000, 61500)])) == ["999ms", "1.0s", "1m 0s", "1m 1s"]
    assert one(spark, S.branch_name(F.lit("feature/Payments v2")))[0] == "feature-payments-v2"
    r = one(spark, S.truncate_to_tokens(F.lit("x" * 41), 10), S.truncate_to_tokens(F.lit("x" * 40), 10))
    assert r[0] == "x" * 40 + S.TRUNCATED and len(S.TRUNCATED) == 39 and r[1] == "x" * 40
    assert list(one(spark, *[S.token_count(F.lit(t)) for t in (None, "", "a", "abcd", "abcde")])) == [0, 0, 1, 1, 2]
    assert list(one(spark, *[S.tokens_text(F.lit(x)) for x in (5, 1500, 2_500_000)])) == ["5 tokens", "1.5K tokens", "2.5M tokens"]
    assert list(one(spark, *[S.cost_text(F.lit(x)) for x in (0.0, 0.001, 1.5)])) == ["$0.00", "< $0.01", "$1.500"]
    assert list(one(spark, *[S.link_target(F.lit(x)) for x in ("a%20b.md#c", "a+b.md", "100%.md")])) == ["a b.md", "a+b.md", "100%.md"]
    assert one(spark, S.title(F.lit("x\n## Head\ny")), S.title(F.lit("first\nsecond")))[:] == ("Head", "first")
    assert one(spark, S.snippet(F.lit("a" * 400), F.lit(200)), S.snippet(F.lit(" b\n\nc "), F.lit(None).cast("int")))[:] == ("…" + "a" * 300 + "…", "b c")
    assert one(spark, S.parsed_json(F.lit('```json\n{"a": 1}\n```'), "a int"))[0].a == 1
    ages = {"2024-01-31 23:59:30": "just now", "2024-01-31 23:01:00": "59m ago", "2024-01-31 01:00:00": "23h ago", "2024-01-29 00:00:00": "3d ago"}
    assert list(one(spark, *[S.age(F.lit(t), F.lit("2024-02-01 00:00:00")) for t in ages])) == list(ages.values())


def test_durations_at_halves(spark):
    got = {r.id: r.took for r in spark.range(1000, 60000, 10).select("id", S.duration(F.col("id")).alias("took")).collect()}
    assert got == {ms: f"{Decimal(ms / 1000).quantize(Decimal('0.1'), ROUND_HALF_UP)}s" for ms in range(1000, 60000, 10)}
    assert [got[ms] for ms in (1050, 1150, 1250, 1750, 59950)] == ["1.1s", "1.1s", "1.3s", "1.8s", "60.0s"]
