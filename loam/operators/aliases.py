"""Imports by alias, and imports that are only made when they are needed.

An alias table has rows (scope, pattern, ord, target): in files under the folder scope ('' is the root, others end with a
slash) an import that fits the pattern means the target; both may have one star, which stands for the same text. Of a
file's scopes only the deepest has a say; there a pattern without a star wins, then the one with the longest text before
its star (ties: the longest after it). An alias's targets are tried in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions import scalar
from loam.operators import graph
from loam.sources.scratch import stored

SCHEMA = "scope string, pattern string, ord int, target string"
_CONFIG = "compilerOptions struct<baseUrl: string, paths: map<string, array<string>>>"


def table(spark: SparkSession, aliases: dict[str, list[str] | str], scope: str = "") -> DataFrame:
    """An alias table of what a user's configuration says."""
    rows = [(scope, p, k, t) for p, ts in aliases.items() for k, t in enumerate([ts] if isinstance(ts, str) else ts)]
    return spark.createDataFrame(rows, SCHEMA)


def from_configs(files: DataFrame) -> DataFrame:
    """The alias table of all tsconfig.json and jsconfig.json among files (path, content).

    Comments are allowed; a text that isn't JSON, or has no paths, gives no aliases. Configurations that others extend
    are not followed.
    """
    path = F.col("path")
    c = files.where(path.rlike(r"(^|/)[tj]sconfig\.json$")).select(F.regexp_extract("path", r"^(.*/)?[^/]+$", 1).alias("scope"), F.from_json("content", _CONFIG, {"allowComments": "true"})["compilerOptions"].alias("o"))
    base = F.concat("scope", F.coalesce("o.baseUrl", F.lit(".")), F.lit("/"))
    p = c.select("scope", base.alias("base"), F.explode("o.paths").alias("pattern", "targets"))
    return p.select("scope", "pattern", F.posexplode("targets").alias("ord", "t"), "base").select("scope", "pattern", "ord", scalar.normal_path(F.concat("base", "t")).alias("target")).where("target is not null")


def _scoped(imports: DataFrame, aliases: DataFrame) -> DataFrame:
    """imports (path, ...) with the scope that has a say in their folder, where there is one."""
    folder = F.regexp_extract("path", r"^(.*/)?[^/]+$", 1)
    asked = imports.where("source <> '' and path is not null").withColumn("folder", folder)
    parents = F.expr("transform(sequence(0, size(split(folder, '/')) - 1), k -> if(k = 0, '', concat(substring_index(folder, '/', k), '/')))")
    scopes = asked.select("folder").distinct().select("folder", F.explode(parents).alias("scope")).join(aliases.select("scope").distinct(), "scope")
    scopes = stored(scopes.groupBy("folder").agg(F.max_by("scope", F.length("scope")).alias("scope")), "scopes")  # its size is known then, and few folders are broadcast
    return asked.join(scopes, "folder").drop("folder")


def _meant(asked: DataFrame, aliases: DataFrame) -> DataFrame:
    """(scope, source, ord, target) of distinct asked (scope, source)."""
    star = F.instr("pattern", "*")
    a = aliases.select(
        "scope", "pattern", (star > 0).alias("open"), F.when(star > 0, F.substring_index("pattern", "*", 1)).otherwise(F.col("pattern")).alias("head"),
        F.when(star > 0, F.expr("substr(pattern, instr(pattern, '*') + 1)")).otherwise("").alias("tail"), "ord", "target",
    )
    a = stored(a.groupBy("scope", "pattern", "open", "head", "tail").agg(F.collect_list(F.struct("ord", "target")).alias("targets")), "patterns")
    lengths = a.agg(F.coalesce(F.collect_set(F.length("head")), F.array().cast("array<int>")).alias("lengths"))  # one row
    s = asked.join(F.broadcast(lengths)).select("scope", "source", F.explode(F.filter("lengths", lambda n: n <= F.length("source"))).alias("n"))
    met = s.select("scope", "source", F.expr("left(source, n)").alias("head")).join(a, ["scope", "head"])
    rest = F.length("source") - F.length("head") - F.length("tail")
    met = met.where(F.when(F.col("open"), (rest >= 0) & F.endswith("source", F.col("tail"))).otherwise(rest == 0))
    text = F.expr("substr(source, length(head) + 1, length(source) - length(head) - length(tail))")
    best = F.max_by(F.struct("targets", "open", text.alias("text")), F.struct(~F.col("open"), F.length("head"), F.length("tail")))
    found = met.groupBy("scope", "source").agg(best.alias("b")).select("scope", "source", "b.open", "b.text", F.explode("b.targets").alias("t"))
    target = F.when(F.col("open"), F.expr("replace(t.target, '*', text)")).otherwise(F.col("t.target"))
    return found.select("scope", "source", "t.ord", scalar.normal_path(target).alias("target"))


def targets(imports: DataFrame, aliases: DataFrame) -> DataFrame:
    """(path, source, ord, target): what each import that fits an alias means, best first; imports (path, source).

    Scopes and patterns are found by equality: a folder by all its parents, a source by those of its beginnings that are as
    long as some pattern's. Only distinct folders and distinct sources of a scope are taken apart.
    """
    asked = _scoped(imports.select("path", "source").distinct(), aliases)
    return asked.join(_meant(asked.select("scope", "source").distinct(), aliases), ["scope", "source"]).select("path", "source", "ord", "target")


def edges(imports: DataFrame, files: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Distinct (src, dst, lazy[, ord]) paths: local imports, and those by alias; lazy if every import of dst in src is a dynamic one.

    An import means the first target, and of that the first candidate, which is a known file. Without aliases these are
    the edges of graph.resolve_edges, and with ord they have the least one of theirs too. Files are looked up once for
    each distinct source of a scope, not for each import.
    """
    i = imports.withColumn("ord", F.lit(0)) if "ord" not in imports.columns else imports
    i = i.select("path", "source", "is_dynamic", "ord", "is_external", "resolved_path")
    asked = i.where(~F.col("is_external")).select(F.lit(True).alias("local"), F.col("path").alias("place"), "source", F.lit(0).alias("t"), F.coalesce("resolved_path", "source").alias("target"), F.col("is_dynamic").alias("lazy"), "ord")
    if aliases is not None:
        outer = _scoped(i.where("is_external").select("path", "source", "is_dynamic", "ord"), aliases)
        named = _meant(outer.select("scope", "source").distinct(), aliases)
        asked = asked.unionByName(named.select(F.lit(False).alias("local"), F.col("scope").alias("place"), "source", F.col("ord").alias("t"), "target", F.lit(None).cast("boolean").alias("lazy"), F.lit(None).cast(i.schema["ord"].dataType).alias("ord")))
    found = graph.known_candidates(asked.where("target <> ''"), files)
    place = F.struct("t", "pos")
    found = found.groupBy("local", "place", "source").agg(F.min(place).alias("at"), F.min_by("path", place).alias("dst"), F.bool_and("lazy").alias("lazy"), F.min("ord").alias("ord"))
    told = found.where("local").select(F.col("place").alias("src"), "source", "at", "dst", "lazy", "ord")
    if aliases is not None:
        named = found.where("not local").select(F.col("place").alias("scope"), "source", "at", "dst")
        told = told.unionByName(outer.join(named, ["scope", "source"]).select(F.col("path").alias("src"), "source", "at", "dst", F.col("is_dynamic").alias("lazy"), "ord"))
    told = told.repartition("src")  # both groups below are of one src
    edges = told.groupBy("src", "source").agg(F.min_by("dst", "at").alias("dst"), F.bool_and("lazy").alias("lazy"), F.min("ord").alias("ord")).where("src <> dst")
    edges = edges.groupBy("src", "dst").agg(F.bool_and("lazy").alias("lazy"), F.min("ord").alias("ord"))
    return edges if "ord" in imports.columns else edges.drop("ord")


def distances(nodes: DataFrame, lazy_edges: DataFrame, start: DataFrame, most: int = 3, lazy_hops: int = 2) -> DataFrame:
    """(id, depth) of nodes within so many hops of the start nodes, edges (src, dst, lazy) taken either way; a lazy one counts for lazy_hops.

    As a hop costs one or more, the nodes at a depth are settled when their turn comes: one join and one aggregation a depth.
    """
    both = lazy_edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "lazy").union(lazy_edges.select("dst", "src", "lazy"))
    hops = both.groupBy("a", "b").agg(F.min(F.when(F.col("lazy"), lazy_hops).otherwise(1)).alias("cost"))
    d = start.select("id").distinct().join(nodes.select("id").distinct(), "id", "left_semi").select("id", F.lit(0).alias("depth"))
    for level in range(most):
        j = d.join(hops, (F.col("id") == F.col("a")) & (F.col("depth") == level), "left")
        reached = F.array(F.struct("id", "depth"), F.struct(F.col("b").alias("id"), (F.lit(level) + F.col("cost")).alias("depth")))
        d = j.select(F.explode(reached).alias("x")).select("x.*").where((F.col("id").isNotNull()) & (F.col("depth") <= most)).groupBy("id").agg(F.min("depth").alias("depth"))
    return d
