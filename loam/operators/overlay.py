"""Branch overlays: sparse contents over the main ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import summarise

MARK = "\n\n---\n## Branch Override\n"


def read(main: DataFrame, overrides: DataFrame) -> DataFrame:
    """(module_id, content): the branch's content where it has one, main's elsewhere, and modules that only the branch has."""
    j = main.select("module_id", F.col("content").alias("m")).join(overrides.select("module_id", F.col("content").alias("b")), "module_id", "full_outer")
    return j.select("module_id", F.coalesce("b", "m").alias("content"))


def classify(main: DataFrame, overrides: DataFrame) -> DataFrame:
    """(module_id, kind): branch_new, skipped (equal) or conflict, for each override."""
    j = overrides.select("module_id", F.col("content").alias("b")).join(main.select("module_id", F.col("content").alias("m"), F.lit(True).alias("known")), "module_id", "left")
    kind = F.when(F.col("known").isNull(), "branch_new").when(F.col("b").eqNullSafe(F.col("m")), "skipped").otherwise("conflict")
    return j.select("module_id", kind.alias("kind"), "m", "b")


def merge(main: DataFrame, overrides: DataFrame, resolver=None) -> tuple[DataFrame, DataFrame]:
    """(contents to write, one row of counts). A conflict is resolved by resolver(main, branch) -> Column, else stays main's."""
    c = classify(main, overrides)
    merged = resolver(F.col("m"), F.col("b")) if resolver else F.lit(None).cast("string")
    content = F.when(F.col("kind") == "branch_new", F.col("b")).when(F.col("kind") == "conflict", F.coalesce(merged, F.col("m")))
    written = c.where("kind <> 'skipped'").select("module_id", content.alias("content"), "kind")
    settled = F.count_if(F.col("kind").isin("branch_new", "conflict") if resolver else F.col("kind") == "branch_new")
    return written, c.agg(F.count_if(F.col("kind") == "conflict").alias("conflicts"), settled.alias("resolved"), F.count_if(F.col("kind") == "skipped").alias("skipped"))


def conflict_kind(main: DataFrame, overrides: DataFrame) -> DataFrame:
    """(module_id, kind) of each conflict: additive if the branch keeps all of main's text, else contradictory."""
    kind = F.when(F.contains(F.coalesce("b", F.lit("")), F.coalesce("m", F.lit(""))), "additive").otherwise("contradictory")
    return classify(main, overrides).where("kind = 'conflict'").select("module_id", kind.alias("kind"))


def resolved_by(main: DataFrame, overrides: DataFrame, name: str | summarise.Provider = "extract") -> DataFrame:
    """(module_id, content, main_content, branch_content) of each conflict, reconciled by a text provider; what it can't answer stays main's.

    Both versions are kept beside the answer, as a record of where it comes from.
    """
    c = classify(main, overrides).where("kind = 'conflict'")
    parts = [F.lit("Reconcile these two descriptions of one module into one."), F.concat(F.lit("Version A (main):\n"), F.coalesce("m", F.lit(""))), F.lit("Version B (branch):"), F.coalesce("b", F.lit(""))]
    told = summarise.run(c.select(F.col("module_id").alias("path"), F.concat_ws("\n\n", *parts).alias("prompt")), name, "Merge two module summaries.", 1500, 0.1)
    answers = told.select(F.col("path").alias("module_id"), F.col("content").alias("answer"))
    return c.join(answers, "module_id", "left").select("module_id", F.coalesce("answer", "m").alias("content"), F.col("m").alias("main_content"), F.col("b").alias("branch_content"))


def add_context(main: DataFrame, notes: DataFrame) -> DataFrame:
    """(module_id, content): a note (module_id, note) appended to main's content, or alone for an unknown module."""
    j = notes.join(main.select("module_id", "content"), "module_id", "left")
    return j.select("module_id", F.when(F.col("content").isNotNull(), F.concat("content", F.lit(MARK), "note")).otherwise(F.col("note")).alias("content"))


def create(branches: DataFrame, name: str, as_of: str, parent: str = "main", description: str | None = None) -> DataFrame:
    """branches (name, created_at, parent, description, last_updated) with a new one; its name is made safe."""
    from loam.functions.scalar import branch_name

    now = F.lit(as_of).cast("timestamp_ntz")
    row = branches.sparkSession.range(1).select(branch_name(F.lit(name)).alias("name"), now.alias("created_at"), F.lit(parent).alias("parent"), F.lit(description).cast("string").alias("description"), now.alias("last_updated"))
    return branches.join(row.select("name"), "name", "left_anti").select(*branches.columns).unionByName(row)


def delete(branches: DataFrame, name: str) -> DataFrame:
    from loam.functions.scalar import branch_name

    return branches.where(F.col("name") != branch_name(F.lit(name)))
