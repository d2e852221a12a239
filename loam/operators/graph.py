"""Operators on a dependency graph: nodes (id, ...), edges (src, dst), where src imports dst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions import scalar
from loam.sources.scratch import stored

# Extensions tried for an import, in order.
TRIED = [".ts", ".tsx", ".js", ".jsx", ".py", ".go", ".rs", ".java", ".kt", ".cs", ".cpp", ".c", ".php", ".rb", ".swift", ".html", ".md", ".json"]
SCRIPT = [".ts", ".tsx", ".js", ".jsx"]


def import_candidates(target: Column) -> Column:
    """Paths that an import may mean, best first."""
    t = F.translate(target, "\\", "/")
    bare = F.regexp_replace(t, r"\.(js|jsx|mjs|cjs)$", "")
    script = F.when(bare != t, F.array(*[F.concat(bare, F.lit(e)) for e in SCRIPT], *[F.concat(bare, F.lit("/index" + e)) for e in SCRIPT])).otherwise(F.array().cast("array<string>"))
    any_ = F.array(*[F.concat(t, F.lit(x)) for e in TRIED for x in (e, "/index" + e)])
    return F.concat(F.array(t), script, any_)


#: What may follow a key: nothing, or an extension, alone or behind /index.
ENDS = ["", *[x for e in TRIED for x in (e, "/index" + e)]]


def _extension(path: Column) -> tuple[Column, Column]:
    """The place in TRIED, from 1, of a path's extension (0: none of them), and the path without it."""
    last = F.substring_index(path, ".", -1)
    known = F.when(F.contains(path, F.lit(".")), F.array_position(F.array(*[F.lit(e) for e in TRIED]), F.concat(F.lit("."), last))).otherwise(0).cast("int")
    return known, F.left(path, F.length(path) - F.length(last) - 1)


def candidate_keys(target: Column) -> Column:
    """An array (key, kind, only), with nulls, of what known files are asked by: a candidate of import_candidates is a key and one of ENDS, or the only one."""
    t = F.translate(target, "\\", "/")
    bare = F.regexp_replace(t, r"\.(js|jsx|mjs|cjs)$", "")
    known, stem = _extension(t)
    key = lambda c, kind, only=None: F.struct(c.alias("key"), F.lit(kind).alias("kind"), (F.lit(None).cast("int") if only is None else only).alias("only"))
    return F.array(F.when(bare != t, key(t, 1)).otherwise(key(t, 0)), F.when(bare != t, key(bare, 2)), F.when(known > 0, key(stem, 3, 2 * known - 1)))


def path_keys(path: Column) -> Column:
    """An array (key, end), with nulls, of the keys that a file is found by, two at most; end is a place in ENDS."""
    known, stem = _extension(path)
    key = lambda c, end: F.struct(c.alias("key"), end.alias("end"))
    return F.array(F.when(known > 0, key(stem, 2 * known - 1)).otherwise(key(path, F.lit(0))), F.when((known > 0) & F.endswith(stem, F.lit("/index")), key(F.left(stem, F.length(stem) - 6), 2 * known)))


def known_candidates(tried: DataFrame, files: DataFrame) -> DataFrame:
    """tried (target, ...) with (pos, path) for each candidate of import_candidates that is a known file, in their order.

    One to three rows are shuffled for each target, and one or two for each file, not one for each candidate.
    """
    keys = files.select(F.explode(F.array_compact(path_keys(F.col("path")))).alias("x")).select("x.*")
    asked = tried.select("*", F.explode(F.array_compact(candidate_keys(F.col("target")))).alias("x")).select(*tried.columns, "x.*")
    end, kind, extension = F.col("end"), F.col("kind"), F.floor((F.col("end") - 1) / 2).cast("int")
    script = F.when((end > 0) & (extension < len(SCRIPT)), 1 + extension + F.when(end % 2 == 0, len(SCRIPT)).otherwise(0))
    pos = F.when(kind == 3, F.when(end == F.col("only"), 0)).when(kind == 2, script).when((kind == 1) & (end > 0), end + 2 * len(SCRIPT)).otherwise(end)
    found = asked.join(keys, "key").withColumn("pos", pos).where("pos is not null")
    return found.select(*tried.columns, "pos", F.concat("key", F.get(F.array(*[F.lit(e) for e in ENDS]), "end")).alias("path"))


def resolve_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct (src, dst) paths: each local import's first candidate that is a known file, other than the file itself.

    imports: (path, source, resolved_path, is_external[, ord]); with ord, edges have the least one of theirs. An equi-join on path with the position of the candidate, and the
    least position by aggregation; so no nested loop, whatever the number of files.
    """
    ord_ = F.col("ord") if "ord" in imports.columns else F.lit(0)
    asked = imports.where(~F.col("is_external")).select(F.col("path").alias("src"), F.coalesce("resolved_path", "source").alias("target"), ord_.alias("ord")).where("target <> ''")
    asked = asked.groupBy("src", "target").agg(F.min("ord").alias("ord"))
    tried = asked.select("src", "target", "ord", F.posexplode(import_candidates(F.col("target"))).alias("pos", "path"))
    found = tried.join(files.select("path"), "path").groupBy("src", "target").agg(F.min_by("path", "pos").alias("dst"), F.min("ord").alias("ord"))
    edges = found.where("src <> dst").groupBy("src", "dst").agg(F.min("ord").alias("ord"))
    return edges if "ord" in imports.columns else edges.drop("ord")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree) of every node, over distinct edges."""
    e = edges.select("src", "dst").distinct()
    ends = e.select(F.explode(F.array(F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("x")).select("x.*")
    d = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return nodes.select("id").join(d, "id", "left").select("id", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"))


def centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """degrees with weight = in-degree over the largest one (at least 1)."""
    d = degrees(nodes, edges)
    top = d.agg(F.greatest(F.max("in_degree"), F.lit(1)).alias("top"))  # one row
    return d.join(F.broadcast(top)).select("id", "in_degree", "out_degree", (F.col("in_degree") / F.col("top")).alias("weight"))


def top_modules(nodes: DataFrame, edges: DataFrame, k: int = 20) -> DataFrame:
    """The k most imported nodes, ties by id."""
    return centrality(nodes, edges).orderBy(F.desc("weight"), "id").limit(k)


def _spread(start: DataFrame, hops: DataFrame, depth: int) -> DataFrame:
    """Least number of hops to each node within the depth: start (id), hops (a, b).

    One join and one aggregation a level, each level's table used once, so the plan grows with the depth only.
    """
    d = start.select("id", F.lit(0).alias("depth")).distinct()
    for level in range(depth):
        j = d.join(hops, (F.col("id") == F.col("a")) & (F.col("depth") == level), "left")
        both = F.array(F.struct("id", "depth"), F.struct(F.col("b").alias("id"), F.lit(level + 1).alias("depth")))
        d = j.select(F.explode(both).alias("x")).select("x.*").where("id is not null").groupBy("id").agg(F.min("depth").alias("depth"))
    return d


def distances(nodes: DataFrame, edges: DataFrame, start: DataFrame, depth: int = 3) -> DataFrame:
    """(id, depth) of nodes within so many hops of the start nodes, edges taken either way; unknown start nodes count for nothing."""
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src")).distinct()
    return _spread(start.join(nodes.select("id"), "id", "left_semi"), both, depth)


def dependents(edges: DataFrame, start: DataFrame, depth: int = 2) -> DataFrame:
    """(id, depth) of the start nodes, known or not, and of what imports them within so many hops."""
    return _spread(start, edges.select(F.col("dst").alias("a"), F.col("src").alias("b")).distinct(), depth)


def blast_radius(nodes: DataFrame, edges: DataFrame, origin: str, depth: int = 5) -> DataFrame:
    """(id, depth) of all that a change of the origin may reach, without itself; empty if the origin is unknown."""
    start = nodes.where(F.col("id") == origin).select("id")
    return dependents(edges, start, depth).where("depth > 0")


def topological_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, level): each node comes after all it imports; nodes on or behind a cycle get the level after the last one.

    Peels nodes without open imports, level by level, until none is ready; each level ends in a stored table.
    """
    left = nodes.select("id").distinct()
    e = edges.select("src", "dst").where("src <> dst").distinct().join(left.withColumnRenamed("id", "dst"), "dst", "left_semi")
    done, level = None, 0
    while True:
        ready = stored(left.join(e.select(F.col("src").alias("id")).distinct(), "id", "left_anti").withColumn("level", F.lit(level)), "level")
        if ready.isEmpty():
            break
        done = ready if done is None else done.unionByName(ready)
        left = stored(left.join(ready, "id", "left_anti"), "left")
        e = stored(e.join(ready.select(F.col("id").alias("dst")), "dst", "left_anti"), "edges")
        level += 1
    rest = left.withColumn("level", F.lit(level))
    return rest if done is None else done.unionByName(rest)


def mutual_cycles(edges: DataFrame) -> DataFrame:
    """One row: nodes with a mutual import, and half their number as the count of two-cycles."""
    e = edges.select("src", "dst").where("src <> dst").distinct()
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    n = e.join(back, ["src", "dst"], "left_semi").agg(F.countDistinct("src").alias("nodes"))
    return n.select("nodes", (F.col("nodes") / 2).alias("cycles"))


def module_groups(nodes: DataFrame) -> DataFrame:
    """(module_group, paths): paths of each group in order."""
    return nodes.groupBy(scalar.module_group(F.col("path")).alias("module_group")).agg(F.array_sort(F.collect_list("path")).alias("paths"))


def first_dependencies(edges: DataFrame, summaries: DataFrame, k: int = 3) -> DataFrame:
    """(src, context): the first k dependencies' summaries that exist, in edge order; edges (src, dst, ord), summaries (id, content)."""
    j = edges.join(summaries.select(F.col("id").alias("dst"), "content"), "dst")
    r = j.withColumn("rn", F.row_number().over(Window.partitionBy("src").orderBy("ord"))).where(F.col("rn") <= k)
    return r.groupBy("src").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "content"))), lambda x: x["content"]), "\n\n---\n\n").alias("context"))


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of text: number of nodes, groups, the ten most imported of them, and five paths of each group. nodes: (id, path)."""
    groups = nodes.withColumn("g", scalar.module_group(F.col("path")))
    few = groups.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("path"))).groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("rn") <= 5, F.col("path")))).alias("p"))
    line = F.concat(F.lit("  "), "g", F.lit(": "), F.array_join("p", ", "), F.when(F.col("n") > 5, F.concat(F.lit(" (+"), (F.col("n") - 5).cast("string"), F.lit(" more)"))).otherwise(""))
    by_group = few.select("g", line.alias("line")).agg(F.array_sort(F.collect_list(F.struct("g", "line"))).alias("gs"))
    top = centrality(nodes, edges).join(nodes.select("id", "path"), "id").orderBy(F.desc("weight"), "id").limit(10)
    text = F.concat(F.lit("  "), "path", F.lit(" (imported by "), F.col("in_degree").cast("string"), F.lit(" modules)"))
    tops = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "id", text.alias("line")))).alias("ts"))
    total = nodes.agg(F.count(F.lit(1)).alias("n"))
    one = total.join(F.broadcast(by_group)).join(F.broadcast(tops))  # one row each
    part = lambda c, f: F.transform(F.col(c), lambda x: x[f])
    lines = F.concat(
        F.array(F.concat(F.lit("Total modules: "), F.col("n").cast("string")), F.concat(F.lit("Module groups: "), F.array_join(part("gs", "g"), ", ")), F.lit(""), F.lit("Most central modules (by import count):")),
        part("ts", "line"),
        F.array(F.lit(""), F.lit("Module groups:")),
        part("gs", "line"),
    )
    return one.select(F.array_join(lines, "\n").alias("summary"))


def export_links(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with their group, and links between known nodes, for drawing."""
    n = nodes.select("id", "path", scalar.module_group(F.col("path")).alias("module_group"))
    known = nodes.select("id")
    links = edges.select("src", "dst").distinct().join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return n, links.select(F.col("src").alias("source"), F.col("dst").alias("target"))


def node(nodes: DataFrame, key: str) -> DataFrame:
    """The node of that id, else of that path."""
    return nodes.where((F.col("id") == key) | (F.col("path") == key)).orderBy(F.desc(F.col("id") == key)).limit(1)


def fuzzy_path(nodes: DataFrame, asked: str) -> DataFrame:
    """The best node for a path as typed: the same, the same with its separators turned, one ending in it, one of which either contains the other."""
    turned = asked.replace("\\", "/")
    p = F.col("path")
    rank = F.when(p == asked, 0).when(p == turned, 1).when(p.endswith(turned), 2).when(p.contains(turned) | F.contains(F.lit(turned), p), 3)
    return nodes.select("path", rank.alias("rank")).where("rank is not null").orderBy("rank", "path").limit(1)


#: Lengths of the pieces by which texts that hold others are found.
PIECES = (1, 2, 4, 8, 16)


def _pieces(text: Column, sizes: list[int]) -> Column:
    """All distinct pieces of a text of these lengths."""
    of = lambda n: F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda at: F.substring(text, at, F.lit(n)))
    return F.array_distinct(F.concat(*[F.when(F.length(text) >= n, of(n)).otherwise(F.array().cast("array<string>")) for n in sizes]))


def containing(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """Pairs (text, pattern) of a text that holds a pattern, without a nested loop; texts (text), patterns (pattern), none empty.

    Each pattern is looked for by the piece of it that the fewest texts have, of the largest of PIECES' lengths that it has
    itself; a pattern with a piece that no text has is in none.
    """
    length = F.greatest(*[F.when(F.length("pattern") >= n, F.lit(n)) for n in PIECES], F.lit(1))
    asked = patterns.select("pattern").distinct().where("pattern <> ''").withColumn("n", length)
    sizes = sorted(r["n"] for r in asked.select("n").distinct().collect())  # five at most
    if not sizes:
        return texts.select("text", F.col("text").alias("pattern")).where("false")
    own = F.coalesce(*[F.when(F.col("n") == n, _pieces(F.col("pattern"), [n])) for n in sizes])
    held = texts.select("text").distinct().where("text <> ''").select("text", F.explode_outer(_pieces(F.col("text"), sizes)).alias("piece")).where("piece is not null")
    wanted = asked.select("pattern", F.explode(own).alias("piece"))
    many = held.join(wanted.select("piece").distinct(), "piece", "left_semi").groupBy("piece").agg(F.count(F.lit(1)).alias("texts"))
    rarest = wanted.join(many, "piece", "left").groupBy("pattern").agg(F.min_by("piece", F.coalesce("texts", F.lit(0))).alias("piece"), F.min(F.coalesce("texts", F.lit(0))).alias("texts"))
    found = held.join(rarest.where("texts > 0").select("pattern", "piece"), "piece")
    return found.where(F.contains("text", F.col("pattern"))).select("text", "pattern")


def fuzzy_paths(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked, path, rank) for each distinct asked path that some node matches, its best one as fuzzy_path has it; nodes (path), asked (asked).

    rank: 0 the same, 1 the same with its separators turned, 2 the node's path ends in it, 3 one holds the other; of equal
    ranks the least path. An empty or null path is asked for nothing, and matches nothing.
    """
    a = asked.select("asked").where("asked <> ''").distinct().withColumn("turned", F.translate("asked", "\\", "/"))
    paths = nodes.select(F.col("path").alias("text")).where("text <> ''").distinct()
    turned = a.select(F.col("turned").alias("text")).distinct()
    held = containing(paths, turned.withColumnRenamed("text", "pattern")).select(F.col("pattern").alias("turned"), F.col("text").alias("path"))
    holding = containing(turned, paths.withColumnRenamed("text", "pattern")).select(F.col("text").alias("turned"), F.col("pattern").alias("path"))
    p = F.col("path")
    rank = F.when(p == F.col("turned"), 1).when(p.endswith(F.col("turned")), 2).otherwise(3)
    best = held.unionByName(holding).withColumn("rank", rank).groupBy("turned").agg(F.min(F.struct("rank", "path")).alias("m"))
    same = paths.select(F.col("text").alias("path"), F.col("text").alias("asked"))
    out = a.join(same, "asked", "left").join(best, "turned", "left")
    return out.select("asked", F.coalesce("path", "m.path").alias("path"), F.when(F.col("path").isNotNull(), 0).otherwise(F.col("m.rank")).alias("rank")).where("path is not null")
