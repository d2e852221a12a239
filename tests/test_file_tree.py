import os

import pytest

from loam.sources import file_tree
from loam.sources.file_tree import FileTree, Part, TreeReader

FILES = {"a.ts": b"x", "src/b.py": b"yy", "src/deep/er/c.go": b"zzz\xff", "node_modules/m/x.js": b"no", "src/.hid/q.py": b"h", ".dot.py": b"d", "src/e.py": b"", "src/build/x.py": b"b", "big.py": b"1" * 600_000, "lib/own/z.rs": b"r"}


@pytest.fixture
def root(tmp_path):
    for p, raw in FILES.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(raw)
    os.symlink("/nonexistent", tmp_path / "broken.py")
    os.symlink(tmp_path, tmp_path / "src" / "loop")
    return str(tmp_path)


def names(df):
    return sorted(r.path for r in df.select("path").collect())


def test_lists_and_reads_in_one_pass(spark, root):
    got = {r.path: r for r in file_tree.files(spark, root).collect()}
    assert sorted(got) == ["a.ts", "lib/own/z.rs", "src/b.py", "src/deep/er/c.go"]
    assert got["src/deep/er/c.go"].content == "zzz�" and got["a.ts"].size == 1 and got["a.ts"].absolute_path == f"{root}/a.ts" and len(got["a.ts"].hash) == 64
    assert names(file_tree.files(spark, "file://" + root, exclude=["**/own/**"], include=["**/*.{py,rs}"], max_size=None, min_size=0)) == ["big.py", "src/b.py", "src/e.py"]
    for partitions in (1, 2, 100):
        assert names(file_tree.files(spark, root, hidden=True, partitions=partitions)) == [".dot.py", "a.ts", "lib/own/z.rs", "src/.hid/q.py", "src/b.py", "src/deep/er/c.go"]
    assert [r.content for r in file_tree.files(spark, root, contents=False).collect()] == [None] * 4


def test_filters_are_pushed_down(spark, root, capsys):
    df = file_tree.files(spark, root)
    q = df.where("size > 1 and path like 'src/%' and length(content) > 0")
    assert names(q) == ["src/b.py", "src/deep/er/c.go"]
    capsys.readouterr()
    q.explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThan(size,1)" in plan and "StringStartsWith(path,src/)" in plan
    assert df.count() == 4  # nothing of the last query's filters is left
    assert names(df.where("path in ('a.ts', 'src/b.py', 'no')")) == ["a.ts", "src/b.py"] and names(df.where("path = 'lib/own/z.rs'")) == ["lib/own/z.rs"]
    assert names(df.where("path like '%.go' or size = 2")) == ["src/b.py", "src/deep/er/c.go"] and names(df.where("path like '%.go' and size <= 3")) == []


def test_shut_folders_are_never_opened(root, monkeypatch):
    opened = []
    real = file_tree.Tree.entries
    monkeypatch.setattr(file_tree.Tree, "entries", lambda self, folder: opened.append(folder) or real(self, folder))
    reader = TreeReader({"path": root, "exclude": "**/node_modules/**\n**/build/**", "partitions": "1"})
    found = [p for part in reader.partitions() for b in reader.read(part) for p in b.column("path").to_pylist()]
    assert len(found) == 6 and {"node_modules", "src/build", "src/.hid"}.isdisjoint(opened) and "src/deep/er" in opened
    opened.clear()
    reader.paths = [("StringStartsWith", ("lib/",))]
    assert [p for part in reader.partitions() for b in reader.read(part) for p in b.column("path").to_pylist()] == ["lib/own/z.rs"] and "src" not in opened


def test_errors_are_rows(root):
    reader = TreeReader({"path": root})
    part = Part(("src/deep", "gone"), (("a.ts", 1), ("vanished.py", 9)), (("shut", "PermissionError: no"),))
    rows = [r for b in reader.read(part) for r in b.to_pylist()]
    assert [(r["path"], r["content"], (r["error"] or "").split(":")[0]) for r in rows] == [("shut", None, "PermissionError"), ("a.ts", "x", ""), ("vanished.py", None, "FileNotFoundError"), ("src/deep/er/c.go", "zzz�", ""), ("gone", None, "FileNotFoundError")]
    with pytest.raises(FileNotFoundError):
        TreeReader({"path": root + "/none"}).partitions()
    for bad in ({}, {"path": root, "partitions": "0"}):
        with pytest.raises(ValueError):
            TreeReader(bad)


def test_empty_folder_and_sql(spark, tmp_path):
    assert file_tree.files(spark, str(tmp_path)).count() == 0
    (tmp_path / "f.py").write_text("1")
    spark.dataSource.register(FileTree)
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW tree USING loam_files OPTIONS (path '{tmp_path}')")
    assert [r.size for r in spark.sql("SELECT size FROM tree").collect()] == [1]
