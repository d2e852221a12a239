"""Change detection between two snapshots, and what follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import graph


def detect(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(path, status, signature_changed) of every path of either snapshot: (path, hash, symbol_hash); an unreadable file has a null hash."""
    j = previous.select("path", F.col("hash").alias("h0"), F.col("symbol_hash").alias("s0"), F.lit(True).alias("was")).join(
        current.select("path", F.col("hash").alias("h1"), F.col("symbol_hash").alias("s1"), F.lit(True).alias("is")), "path", "full_outer"
    )
    status = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "deleted").when(F.col("h1").isNotNull() & (F.col("h0") != F.col("h1")), "modified").otherwise("unchanged")
    return j.select("path", status.alias("status"), F.coalesce((status == "modified") & ~F.col("s0").eqNullSafe(F.col("s1")), F.lit(False)).alias("signature_changed"))


def missing_artifacts(files: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Paths without an artifact: files (path), artifacts (path)."""
    return files.select("path").join(artifacts.select("path"), "path", "left_anti")


def invalidated(changed: DataFrame, edges: DataFrame, missing: DataFrame | None = None, readable: DataFrame | None = None, depth: int = 2) -> DataFrame:
    """(path): added, modified, importers of signature changes within the depth, and files without artifact; of those readable."""
    seeds = changed.where("signature_changed").select(F.col("path").alias("id"))
    out = changed.where("status in ('added', 'modified')").select("path").unionByName(graph.dependents(edges, seeds, depth).select(F.col("id").alias("path")))
    out = (out if missing is None else out.unionByName(missing.select("path"))).distinct()
    return out if readable is None else out.join(readable.select("path"), "path", "left_semi")


def carried_forward(artifacts: DataFrame, stale: DataFrame, changed: DataFrame) -> DataFrame:
    """Artifacts that stay as they are: neither invalidated nor of deleted files."""
    gone = changed.where("status = 'deleted'").select("path").unionByName(stale.select("path")).distinct()
    return artifacts.join(gone, "path", "left_anti")


def without_deleted(artifacts: DataFrame, changed: DataFrame) -> DataFrame:
    return artifacts.join(changed.where("status = 'deleted'").select("path"), "path", "left_anti")


def upsert(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """table with new's rows in place of those of the same key."""
    return table.join(new.select(key).distinct(), key, "left_anti").select(*table.columns).unionByName(new.select(*table.columns))


def differing(table: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """Rows of new that the table has not, or with another content; writing only these leaves equal ones alone."""
    return new.join(table.select(key, F.col(content).alias("now_"), F.lit(True).alias("known_")), key, "left").where(F.col("known_").isNull() | ~F.col(content).eqNullSafe(F.col("now_"))).select(*new.columns)


def batches(work: DataFrame, size: int = 4) -> DataFrame:
    """(path, batch): work (path, level) in order of level and path, cut into batches of a size.

    Ranked within levels and shifted by the sizes of the levels before, so one level at most is in one window.
    """
    rn = F.row_number().over(Window.partitionBy("level").orderBy("path"))
    counts = work.groupBy("level").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("level").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = counts.select("level", before.alias("base"))  # a row for each level
    return work.withColumn("rn", rn).join(base, "level").select("path", F.floor((F.col("base") + F.col("rn") - 1) / size).alias("batch"))


def next_manifest(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """files (path, language, size) with the hashes of those that were parsed; failures have empty ones, so they count as modified next time."""
    return files.select("path", "language", "size").join(parsed.select("path", "hash", "symbol_hash"), "path", "left").fillna("", ["hash", "symbol_hash"])


def rebuild_all(full: bool, has_manifest: bool) -> bool:
    """Whether to build everything anew."""
    return full or not has_manifest


def rebuild_architecture(incremental: bool, n_invalidated: int) -> bool:
    return not incremental or n_invalidated > 3


def retained(history: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Rows of history (mtime, ...) not older than so many days."""
    return history.where(F.col("mtime") >= F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days)))


def build_before(history: DataFrame, back: int) -> str | None:
    """The build_id that lies so many builds before the newest; None if there are not as many. history: (build_id, built_at, ...)."""
    row = history.groupBy("build_id").agg(F.max("built_at").alias("at")).orderBy(F.desc("at"), F.desc("build_id")).limit(back + 1).collect()
    return row[back]["build_id"] if len(row) > back else None


def rollback(history: DataFrame, back: int = 1) -> DataFrame:
    """The rows of the build that lies so many builds before the newest, as they were; none if there is no such build."""
    return history.where(F.col("build_id") == F.lit(build_before(history, back)))


def history_diff(history: DataFrame, old: str, new: str) -> DataFrame:
    """Changes between two builds of a history (build_id, path, hash, symbol_hash)."""
    of = lambda b: history.where(F.col("build_id") == b)
    return detect(of(old), of(new))
