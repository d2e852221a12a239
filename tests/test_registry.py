import random
import re
import time

import pytest

from loam.operators import parse, registry
from loam.session import Session

SCHEMA = "path string, language string, content string"


class Lua:
    def imports(self, path, content):
        for m in re.finditer(r'require\s*\(?"([^"]+)"', content):
            if m[1] == "boom":
                raise RuntimeError(f"{path} asks for boom")
            yield registry.Import(m[1], external=not m[1].startswith("./"))

    def symbols(self, path, content):
        for k, line in enumerate(content.split("\n"), 1):
            m = re.match(r"(local )?function (\w+)", line)
            if m:
                yield registry.Symbol(m[2], "function", k, line.strip(), exported=not m[1])


def lua():
    return parse.REGISTRY.copy().register("lua", Lua, extensions={".lua": "lua"})


def test_a_class_reads_its_language(spark):
    rows = [("a/x.lua", "lua", 'require("./y.lua")\nlocal function f()\nfunction g()'), ("a/b.lua", "lua", 'require "boom"\nfunction h()'), ("a/p.py", "python", "import os\ndef q(x): pass"), ("a/n.lua", "lua", None)]
    df, reg = spark.createDataFrame(rows, SCHEMA), lua()
    got = {(r.path, r.source, r.resolved_path, r.is_external) for r in parse.imports(df, reg).collect()}
    assert got == {("a/x.lua", "./y.lua", "a/y.lua", False), ("a/p.py", "os", None, True)}
    assert {(r.path, r.name, r.line, r.is_exported) for r in parse.symbols(df, reg).collect()} == {("a/x.lua", "f", 2, False), ("a/x.lua", "g", 3, True), ("a/b.lua", "h", 2, True), ("a/p.py", "q", 2, True)}
    (e,) = parse.parser_errors(df, reg).collect()
    assert (e.path, e.what, e.error) == ("a/b.lua", "imports", "RuntimeError: a/b.lua asks for boom")
    assert parse.parser_errors(df, parse.REGISTRY).count() == 0


def test_expressions_and_replacing(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a.py", "python", "import os")], SCHEMA)
    own = parse.REGISTRY.copy().register("python", imports=lambda: F.array(parse._import(F.lit(0), F.lit("mine"))))
    assert [r.source for r in parse.imports(df, own).collect()] == ["mine"] and [r.source for r in parse.imports(df).collect()] == ["os"]
    assert parse.symbols(df.where("false"), registry.Registry()).count() == 0
    for bad in ({}, {"by": Lua, "imports": F.array}, {"by": int}, {"by": Lua, "extensions": {"lua": "lua"}}):
        with pytest.raises(ValueError):
            registry.Registry().register("lua", **bad)
    with pytest.raises(ValueError):
        registry.Registry().register([], Lua)


def test_analysis_of_arguments(spark):
    from pyspark.errors import AnalysisException
    from pyspark.sql import functions as F

    f = registry.table_function(Lua)
    for args in ((F.lit("p"), F.lit("c"), F.lit("other")), (F.lit(1), F.lit("c"), F.lit("imports"))):
        with pytest.raises(AnalysisException):
            f(*args).collect()


def test_a_build_with_a_language_of_ones_own(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "x.lua").write_text('require("./y.lua")\nfunction g()')
    (src / "y.lua").write_text('require "boom"')
    (src / "skipped.weird").write_text("x")
    s = Session(spark, str(tmp_path / "tables"), "2024-02-01 00:00:00", parsers=lua())
    assert s.build(str(src)).count() == 1 and s._read("files").count() == 2
    assert [(r.path, r.what) for r in s.errors().collect()] == [("y.lua", "imports")]
    assert [(r.src, r.dst) for r in s._read("edges").collect()] == [("x.lua", "y.lua")]


def go_brute(text):
    out, inside = [], False
    for raw in text.split("\n"):
        t = raw.strip()
        if t in ("import (", ")"):
            inside = t != ")"
            continue
        m = (inside and re.match(r'^\s*(?:\w+\s+)?"([^"]+)"', raw)) or re.match(r'^import\s+"([^"]+)"', raw)
        out += [m[1]] if m else []
    return out


def test_go_imports_against_brute_force(spark):
    rng = random.Random(1)
    parts = ["import (", "  import (  ", ")", "\t)", '"a"', '  x "b/c"', 'import "d"', ' import "e"', "", "func (", '_ "g"', 'import x "h"', 'foo("i")', 'import ("j")', 'import  "k" // "l"', "\r"]
    rows = [(str(k), "go", "\n".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))) for k in range(1500)]
    got = {}
    for r in parse.imports(spark.createDataFrame(rows, SCHEMA)).orderBy("path", "ord").collect():
        got.setdefault(r.path, []).append(r.source)
    assert {p: go_brute(t) for p, _, t in rows if go_brute(t)} == got


def test_symbols_of_a_long_file(spark):
    def took(n):
        text = "".join(f"export function f{k}(\n  a) {{\n" for k in range(n))
        t = time.time()
        rows = parse.symbols(spark.createDataFrame([("a", "typescript", text)], SCHEMA)).collect()
        assert len(rows) == n and rows[n - 1].signature == f"export function f{n - 1}( a)" and rows[n - 1].line == 2 * n - 1
        return time.time() - t

    took(100)
    assert took(32_000) < 30 + 20 * took(2_000)  # 64,000 lines; the square of the lines would take minutes
