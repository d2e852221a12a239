"""Reading a context folder: artifacts, overviews, branches and snapshots kept as Markdown and JSON files.

Every function takes the folder's files as a table (path, content), with paths relative to the folder, as tree() or
file_tree.files() give them. Files without content (unreadable ones) count as absent, other columns are ignored, and
an empty table gives no rows. A JSON file that does not parse counts as malformed, never as an error of the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions import scalar
from loam.sources import file_tree

# Names of files and fields.
MODULE_FILE = r"^artifacts/modules/([^/]+)/(summary\.md|meta\.json|gotchas\.md)$"
ARCHITECTURE, FLOWS, DECISIONS = "artifacts/architecture.md", "artifacts/flows.md", "artifacts/decisions.md"
MANIFEST, GRAPH = "snapshot/manifest.json", "snapshot/graph.json"
BRANCH_FILE = r"^branches/([^/]+)/(meta\.json|notes\.md)$"
OVERRIDE_FILE = r"^branches/([^/]+)/modules/([^/]+)/summary\.md$"
_METADATA = "struct<generatedAt string, generatedBy string, sourceHash string, tokenCount bigint, version int, confidence double>"
_META = f"id string, type string, path string, metadata {_METADATA}, tags array<string>, bad string"
_BRANCH = "name string, createdAt string, parent string, description string, lastUpdated string, bad string"
_STATS = "totalFiles bigint, totalModules bigint, modulesRebuilt bigint, totalTokensConsumed bigint, buildDurationMs bigint, incrementalRebuild boolean"
_ENTRY = "struct<path string, hash string, symbolHash string, size bigint, language string>"


def tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, ...) of all files of a context folder, whatever their names and sizes."""
    return file_tree.files(spark, root, max_size=None, min_size=0, usual=False)


def _parsed(text: Column, schema: str) -> Column:
    """The JSON object of a text; null if it doesn't parse as one."""
    p = F.from_json(text, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"})
    return F.when(p["bad"].isNull(), p)


def _time(text: Column) -> Column:
    return text.try_cast("timestamp_ntz")


def _metadata(m: Column) -> Column:
    """A file's metadata under the names of artifact tables; null if the file has none."""
    named = F.struct(
        _time(m["generatedAt"]).alias("generated_at"), m["generatedBy"].alias("generated_by"), m["sourceHash"].alias("source_hash"),
        m["tokenCount"].alias("token_count"), m["version"].alias("version"), m["confidence"].alias("confidence"),
    )
    return F.when(m.isNotNull(), named)


def _default_metadata(as_of: str) -> Column:
    """Of an overview that has no metadata of its own: as new as the reading."""
    return F.struct(
        F.lit(as_of).cast("timestamp_ntz").alias("generated_at"), F.lit("unknown").alias("generated_by"), F.lit("").alias("source_hash"),
        F.lit(0).cast("long").alias("token_count"), F.lit(1).alias("version"), F.lit(0.8).alias("confidence"),
    )


def _no_tags() -> Column:
    return F.array().cast("array<string>")


def _module_files(files: DataFrame) -> DataFrame:
    """(module_id, summary, meta, gotchas) of each module folder; meta is null where absent or malformed."""
    f = files.where(F.col("path").rlike(MODULE_FILE) & F.col("content").isNotNull())
    f = f.select(F.regexp_extract("path", MODULE_FILE, 1).alias("module_id"), F.regexp_extract("path", MODULE_FILE, 2).alias("name"), "content")
    of = lambda name: F.max(F.when(F.col("name") == name, F.col("content")))  # noqa: E731  a path is there once
    g = f.groupBy("module_id").agg(of("summary.md").alias("summary"), of("meta.json").alias("text"), of("gotchas.md").alias("gotchas"))
    return g.select("module_id", "summary", "gotchas", _parsed(F.col("text"), _META).alias("meta"))


def modules(files: DataFrame) -> DataFrame:
    """(module_id, id, type, path, content, metadata, tags) of each module folder that has a summary and sound metadata; others are left out."""
    m = _module_files(files).where("summary is not null and meta is not null")
    return m.select("module_id", "meta.id", "meta.type", "meta.path", F.col("summary").alias("content"), _metadata(F.col("meta")["metadata"]).alias("metadata"), F.coalesce("meta.tags", _no_tags()).alias("tags"))


def gotchas(files: DataFrame, as_of: str) -> DataFrame:
    """(module_id, id, type, path, content, metadata, tags): an artifact of its own for each gotchas file, under its module's path (empty if the module has no sound metadata)."""
    g = _module_files(files).where("gotchas is not null")
    return g.select(
        "module_id", F.sha2("gotchas", 256).alias("id"), F.lit("gotcha_entry").alias("type"), F.coalesce("meta.path", F.lit("")).alias("path"), F.col("gotchas").alias("content"),
        _default_metadata(as_of).alias("metadata"), F.coalesce("meta.tags", _no_tags()).alias("tags"),
    )


def overviews(files: DataFrame, as_of: str) -> DataFrame:
    """(id, type, path, content, metadata, tags) of the architecture, the flows and the decisions, as far as they are there.

    An architecture without sound metadata has the id `arch` and default metadata; flows always have the id `flows`, no
    tags and default metadata, so they count as new; decisions have the hash of their text as id.
    """
    default = _default_metadata(as_of)
    f = files.where(F.col("path").isin(ARCHITECTURE, ARCHITECTURE + ".meta.json", FLOWS, DECISIONS) & F.col("content").isNotNull())
    of = lambda path: F.max(F.when(F.col("path") == path, F.col("content")))
    one = f.agg(of(ARCHITECTURE).alias("architecture"), of(ARCHITECTURE + ".meta.json").alias("text"), of(FLOWS).alias("flows"), of(DECISIONS).alias("decisions"))
    one = one.withColumn("meta", _parsed(F.col("text"), _META))
    row = lambda id_, kind, content, metadata, tags: F.struct(id_.alias("id"), F.lit(kind).alias("type"), F.lit("").alias("path"), content.alias("content"), metadata.alias("metadata"), tags.alias("tags"))
    rows = F.array(
        row(F.coalesce("meta.id", F.lit("arch")), "architecture_overview", F.col("architecture"), F.coalesce(_metadata(F.col("meta")["metadata"]), default), F.coalesce("meta.tags", _no_tags())),
        row(F.lit("flows"), "execution_flow", F.col("flows"), default, _no_tags()),
        row(F.sha2("decisions", 256), "architectural_decision", F.col("decisions"), default, _no_tags()),
    )
    return one.select(F.inline(F.filter(rows, lambda r: r["content"].isNotNull())))


def branches(files: DataFrame) -> DataFrame:
    """(folder, name, created_at, parent, description, last_updated, notes) of each branch with sound metadata; the parent is main where none is told."""
    f = files.where(F.col("path").rlike(BRANCH_FILE) & F.col("content").isNotNull())
    f = f.select(F.regexp_extract("path", BRANCH_FILE, 1).alias("folder"), F.regexp_extract("path", BRANCH_FILE, 2).alias("file"), "content")
    g = f.groupBy("folder").agg(F.max(F.when(F.col("file") == "meta.json", F.col("content"))).alias("text"), F.max(F.when(F.col("file") == "notes.md", F.col("content"))).alias("notes"))
    b = g.select("folder", "notes", _parsed(F.col("text"), _BRANCH).alias("b")).where("b is not null")
    return b.select("folder", "b.name", _time(F.col("b.createdAt")).alias("created_at"), F.coalesce("b.parent", F.lit("main")).alias("parent"), "b.description", _time(F.col("b.lastUpdated")).alias("last_updated"), "notes")


def overrides(files: DataFrame) -> DataFrame:
    """(folder, module_id, content): what branches have in place of the modules' summaries; folders are branch names made safe."""
    f = files.where(F.col("path").rlike(OVERRIDE_FILE) & F.col("content").isNotNull())
    return f.select(F.regexp_extract("path", OVERRIDE_FILE, 1).alias("folder"), F.regexp_extract("path", OVERRIDE_FILE, 2).alias("module_id"), "content")


def manifest(files: DataFrame) -> DataFrame:
    """(path, language, size, hash, symbol_hash) of the last build's files; none if it is absent or malformed. It is one JSON text, so one task parses it."""
    m = files.where((F.col("path") == MANIFEST) & F.col("content").isNotNull()).select(_parsed(F.col("content"), f"files map<string, {_ENTRY}>, bad string").alias("m"))
    e = m.select(F.explode("m.files").alias("key", "e"))
    return e.select(F.col("key").alias("path"), "e.language", "e.size", F.coalesce("e.hash", F.lit("")).alias("hash"), F.coalesce("e.symbolHash", F.lit("")).alias("symbol_hash"))


def edges(files: DataFrame) -> DataFrame:
    """(src, dst) by path of the last build's graph, without ids that it doesn't hold."""
    g = files.where((F.col("path") == GRAPH) & F.col("content").isNotNull()).select(_parsed(F.col("content"), "nodes map<string, struct<path string, imports array<string>>>, bad string").alias("g"))
    n = g.select(F.explode("g.nodes").alias("id", "n")).select("id", "n.path", "n.imports")
    return n.select(F.col("path").alias("src"), F.explode("imports").alias("id")).join(n.select("id", F.col("path").alias("dst")), "id").select("src", "dst").distinct()


def build_summary(files: DataFrame) -> DataFrame:
    """One row (build_id, built_at, modules_rebuilt, total_modules, total_files, tokens, duration_ms) about the last build; none without a sound manifest."""
    m = files.where((F.col("path") == MANIFEST) & F.col("content").isNotNull()).select(_parsed(F.col("content"), f"buildId string, timestamp string, buildStats struct<{_STATS}>, bad string").alias("m")).where("m is not null")
    s = F.col("m.buildStats")
    return m.select(
        F.col("m.buildId").alias("build_id"), _time(F.col("m.timestamp")).alias("built_at"), s["modulesRebuilt"].alias("modules_rebuilt"), s["totalModules"].alias("total_modules"),
        s["totalFiles"].alias("total_files"), s["totalTokensConsumed"].alias("tokens"), s["buildDurationMs"].alias("duration_ms"),
    )


def build_display(summary: DataFrame, as_of: str) -> DataFrame:
    """build_summary's row as it is shown: the age in words, the duration too (null where it isn't known)."""
    return summary.select("build_id", scalar.age(F.col("built_at"), F.lit(as_of)).alias("generated"), "modules_rebuilt", "total_modules", "total_files", "tokens", scalar.duration(F.col("duration_ms")).alias("duration"))


def module_display(artifacts: DataFrame, as_of: str) -> DataFrame:
    """(path, display): what is shown of each artifact (path, content, metadata): version, age, start of its source's hash, and its text."""
    m = F.col("metadata")
    known = lambda c: F.coalesce(c.cast("string"), F.lit("unknown"))
    head = [F.concat(F.lit("Module: "), "path"), F.concat(F.lit("Version "), known(m["version"]), F.lit(" | Generated "), known(scalar.age(m["generated_at"], F.lit(as_of)))), F.concat(F.lit("Source hash: "), known(scalar.short_id(m["source_hash"])))]
    return artifacts.select("path", F.concat_ws("\n", *head, F.lit(""), "content").alias("display"))
