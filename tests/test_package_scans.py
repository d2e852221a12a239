"""Packages read the documents no more often than needed, and odd rows come out as with whole contents."""

import pytest

from loam.operators import rank
from loam.plans import adopted, catalogue
from loam.sources import scratch

DOCUMENTS = [(1, "fix the worthless parsing of markdown", "en", "src4"), (2, "fix the worthless parsing of markdown", "en", "src4"), (3, "", "en", "src1"), (4, None, "de", "src1"), (7, "worthless", None, "src4"), (8, "a flow of the parsing", "en", "src2"), (9, "beware", "en", "src3"), (16, "", "en", "src4"), (14, "x" * 200, "en", "src4"), (14, "x" * 200, "en", "src4")]


@pytest.fixture
def documents(spark, tmp_path):
    spark.createDataFrame(DOCUMENTS, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


@pytest.fixture
def scans(monkeypatch):
    """Of a query's result: how many scans of the documents it takes, those for stored tables too."""
    written = []

    def stored(df, name="table"):
        written.append(df)
        return scratch.stored(df, name)

    for module in (rank, catalogue, adopted):
        monkeypatch.setattr(module, "stored", stored)

    def count(df):
        plans = [x._jdf.queryExecution().optimizedPlan().collectLeaves() for x in (*written, df)]
        return sum("doc_id#" in leaves.apply(k).toString() for leaves in plans for k in range(leaves.size()))

    count.written = written
    return count


def test_json_scores_documents_once(spark, documents, scans):
    df = catalogue.context_json(spark, documents)
    assert scans(df) == 2  # to score them all, and for the contents of the few that are shown
    assert '"path":"src/src4/en/doc_14.md"' in df.first()["package"]


def test_sections_read_documents_once(spark, documents, scans):
    df = catalogue.context_sections(spark, documents)
    assert scans(df) == 1 and not any("documents" in f for f in df.inputFiles())
    plan = df._jdf.queryExecution().optimizedPlan()
    assert "Aggregate" not in plan.toString() and plan.collectLeaves().size() == 2  # the filled budget and what was picked
    whole = rank.first_of_id(catalogue._scored(spark, documents))  # with contents
    want = rank.sections(rank.fill_budget(whole, 30000), whole).select("ord", "id", "section")
    assert sorted(map(repr, df.collect())) == sorted(map(repr, want.collect()))
    assert {(r.ord, r.section) for r in df.collect()} >= {(1, "flows"), (2, "flows"), (9, "gotchas")}


def test_compact_stores_no_contents_of_the_table(spark, documents, scans):
    df = adopted.context_compact(spark, documents)
    assert scans(df) == 2
    assert not any("content" in x.columns for x in scans.written)
    assert "status#" not in "".join(x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Relation" in x)  # counts of the filled budget are told by other forms only
    assert "## src/src4/en/doc_14.md\n" + "x" * 200 in df.first()["package"]


def test_odd_rows(spark):
    """Repeated ids with contents that differ, rows that come twice, null ids, scores, contents, types and ords."""
    scored = spark.createDataFrame(
        [
            ("a", 5, 0.9, "module_summary", "a5", "aaaa" * 3), ("a", 2, 0.3, "execution_flow", "a2", "a"), ("a", 2, 0.3, "execution_flow", "a2", "a"), ("b", 3, 0.35, "module_summary", "b", "bbbb"), ("b", 6, 0.8, "gotcha_entry", "b6", None),
            (None, 1, 0.99, "module_summary", "none", "nothing"), ("e", 4, 0.1, "module_summary", "e", ""), ("n", 7, 0.2, "module_summary", None, None), ("t", 8, 0.7, None, "t", "tttt"), ("o", None, 0.6, "module_summary", "o", "oooo"),
            ("s", 9, None, "module_summary", "s", ""), ("big", 10, 0.5, "gotcha_entry", "big", "x" * 400), ("g", 11, 0.45, "gotcha_entry", "g", "care"),
        ],
        "id string, ord long, score double, type string, path string, content string",
    )
    whole, small = rank.first_of_id(scored), rank.first_of_id(rank.sized(scored))
    for budget in (20, 3):
        told = []
        for s, contents in ((whole, whole.select("id", "content")), (small, scored.select("id", "ord", "content"))):
            filled = rank.fill_budget(s, budget)
            sectioned = rank.sections(filled, s)
            rows = lambda df: sorted(map(repr, df.collect()))
            told.append([rows(filled.select("ord", "score", "id", "tokens", "status")), rows(sectioned), *[rank.package(sectioned, contents, form, "Arch", filled).first()["package"] for form in ("json", "compact", "text")]])
        assert told[0] == told[1]
    assert {(r.id, r.type, r.path, r.tokens, r.best) for r in small.collect()} >= {("a", "execution_flow", "a2", 1, 0.9), ("b", "module_summary", "b", 1, 0.8), ("o", None, None, None, 0.6), ("t", None, "t", 1, 0.7)}


def test_contents_of_other_ids_are_not_dealt_out(spark):
    contents = spark.createDataFrame([("a", 1, "first"), ("a", 0, "zeroth"), ("b", 2, "other")], "id string, ord long, content string")
    sectioned = spark.createDataFrame([(1, 0.5, "a", "p", "module_summary", "primary")], "ord long, score double, id string, path string, type string, section string")
    df = rank.package(sectioned, contents, "compact")
    assert df.first()["package"] == "## p\nzeroth"
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(df).index("Join LeftSemi") > plan(df).index("min_by(content")  # below the aggregate, so before its shuffle
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:  # where too many are shown, contents are combined by id before they are dealt out
        many = rank.package(sectioned, contents, "compact")
        assert many.first()["package"] == "## p\nzeroth"
        assert plan(many).index("Join LeftSemi") < plan(many).index("min_by(content")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
