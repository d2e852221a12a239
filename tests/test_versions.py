import json

import pytest
from pyspark.sql import functions as F

from loam.operators import search_index
from loam.session import Session
from loam.sources.versions import ConcurrentBuild, Versions


def values(df):
    return sorted(r[0] for r in df.collect())


def test_tables_change_together(spark, tmp_path):
    v = Versions(spark, str(tmp_path))
    assert v.current() is None and v.read("a") is None
    b = v.begin()
    b.write(spark.range(3), "a")
    b.write(spark.range(2), "b")
    assert v.read("a") is None and values(b.read("a")) == [0, 1, 2]  # nobody else sees it yet
    assert b.commit().number == 1
    b = v.begin()
    b.write(b.read("a").where("id > 0").unionByName(spark.range(7, 8)), "a")  # made from its predecessor
    assert values(v.read("a")) == [0, 1, 2]
    b.commit({"by": "x"})
    assert values(v.read("a")) == [1, 2, 7] and values(v.read("b")) == [0, 1] and values(v.read("a", 1)) == [0, 1, 2]
    assert v.read("c") is None and v.read("a", 99) is None and v.current().about == {"by": "x"}


def test_a_build_that_dies_changes_nothing(spark, tmp_path):
    v = Versions(spark, str(tmp_path))
    b = v.begin()
    b.write(spark.range(3), "a")
    b.commit()
    dead = v.begin()
    dead.write(spark.range(100), "a")  # and no commit
    (tmp_path / "commits" / f"{dead.number:012d}.json").write_text('{"tables": {"a"')  # or half of one
    assert v.current().number == 1 and v.read("a").count() == 3
    b = v.begin()
    assert b.number == dead.number + 1
    b.write(spark.range(5), "a")
    b.commit()
    assert v.read("a").count() == 5
    assert not any(p.name == dead.folder.split("/")[1] for p in (tmp_path / "versions").iterdir())  # cleaned


def test_second_to_commit_fails(spark, tmp_path):
    v = Versions(spark, str(tmp_path))
    one, two = v.begin(), v.begin()
    one.write(spark.range(1), "a")
    two.write(spark.range(2), "a")
    one.commit()
    with pytest.raises(ConcurrentBuild):
        two.commit()
    assert v.read("a").count() == 1


def test_old_versions_go_but_what_is_still_named_stays(spark, tmp_path):
    v = Versions(spark, str(tmp_path))
    b = v.begin()
    b.write(spark.range(4), "never written again")
    b.commit()
    for n in range(5):
        b = v.begin()
        b.write(spark.range(n), "a")
        b.commit()
    assert [x.number for x in v.all()] == [5, 6] and v.read("never written again").count() == 4 and v.read("a").count() == 4
    assert len(list((tmp_path / "versions").iterdir())) == 3


def test_bundle(spark, tmp_path):
    v, w = Versions(spark, str(tmp_path / "v")), Versions(spark, str(tmp_path / "w"))
    with pytest.raises(ValueError):
        v.export(str(tmp_path / "out"))
    b = v.begin()
    rows = spark.range(20000).select("id", F.repeat(F.lit("text "), 40).alias("content"), F.array(F.lit(None).cast("string")).alias("tags"))
    b.write(rows, "a")
    b.write(rows.where("false"), "empty")
    b.commit({"built_at": "then"})
    assert v.export(str(tmp_path / "out"), level=9) == ["a", "empty"]
    assert all(p.name.endswith(".zstd.parquet") for p in (tmp_path / "out" / "a").glob("part-*"))
    with pytest.raises(FileExistsError):
        v.export(str(tmp_path / "out"))
    got = w.load(str(tmp_path / "out"))
    assert got.about == {"built_at": "then", "loaded": "true"} and w.read("empty").count() == 0 and w.read("empty").dtypes == rows.dtypes
    assert w.read("a").exceptAll(rows).count() == 0 and w.read("a").count() == 20000
    (tmp_path / "out" / "bundle.json").unlink()
    with pytest.raises(ValueError):
        w.load(str(tmp_path / "out"))


def test_session_keeps_the_last_whole_build(spark, tmp_path, monkeypatch):
    s = Session(spark, str(tmp_path), "2024-02-01 00:00:00")
    assert s.steps() is None and s.errors() is None
    files = lambda text: spark.createDataFrame([("src/a.ts", text, len(text)), ("src/b.ts", "export const b = 1;", 19)], "path string, content string, size long")
    assert s.build(files("export const first = 1;")).first().rebuilt == 2
    steps = {r.phase: r.rows for r in s.steps().collect()}
    assert steps["files"] == 2 and steps["errors"] == 0 and steps["artifacts"] == 2 and steps["statistics"] == 1 and [r.ord for r in s.steps().orderBy("ord").collect()] == list(range(len(steps)))
    before = json.loads(max((tmp_path / "commits").glob("*.json")).read_text())

    def broken(*a):
        raise OSError("no more room")

    monkeypatch.setattr(search_index, "build", broken)
    with pytest.raises(OSError, match="no more room"):
        s.build(files("export const second = 2;"))  # fails when files, artifacts and manifest are written
    assert json.loads(max((tmp_path / "commits").glob("*.json")).read_text()) == before
    assert s._read("files").where("content like '%second%'").count() == 0 and s.search("first").count() > 0
    monkeypatch.undo()
    assert s.build(files("export const second = 2;")).first().rebuilt == 1  # still told by the manifest of the first
