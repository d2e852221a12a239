"""Tables of the engine's own shapes, derived from the test tables by rules that SQL can state too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-02-01 00:00:00"
TYPES = ["module_summary", "execution_flow", "gotcha_entry", "architecture_overview", "architectural_decision", "feature_domain", "symbol_description"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    kind = F.get(F.array(*[F.lit(t) for t in TYPES]), (F.col("doc_id") % 7).cast("int"))
    path = F.concat(F.lit("src/"), "source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".md"))
    at = F.lit(AS_OF).cast("timestamp_ntz") - F.make_dt_interval(hours=(F.col("doc_id") % 720).cast("int"))
    return d.select(F.sha2("text", 256).alias("id"), F.col("doc_id").alias("ord"), kind.alias("type"), path.alias("path"), F.col("text").alias("content"), F.array("source", "lang").alias("tags"), at.alias("generated_at"))


ARTIFACTS = """artifacts AS (SELECT sha256(text) AS id, doc_id AS ord,
  ['module_summary', 'execution_flow', 'gotcha_entry', 'architecture_overview', 'architectural_decision', 'feature_domain', 'symbol_description'][CAST(doc_id % 7 AS INT) + 1] AS type,
  'src/' || source || '/' || lang || '/doc_' || doc_id || '.md' AS path, text AS content, [source, lang] AS tags, source, lang,
  TIMESTAMP '2024-02-01 00:00:00' - to_hours(CAST(doc_id % 720 AS INT)) AS generated_at FROM documents)"""


def hierarchy(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """nodes (id, path), edges (src, dst): order -> customer -> nation -> region."""
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    name = lambda p, col: F.concat(F.lit(p), F.col(col).cast("string"))
    edges = (
        o.select(name("o", "o_orderkey").alias("src"), name("c", "o_custkey").alias("dst"))
        .unionByName(c.select(name("c", "c_custkey").alias("src"), name("n", "c_nationkey").alias("dst")))
        .unionByName(n.select(name("n", "n_nationkey").alias("src"), name("r", "n_regionkey").alias("dst")))
    )
    nodes = o.select(name("o", "o_orderkey").alias("id")).union(c.select(name("c", "c_custkey"))).union(n.select(name("n", "n_nationkey"))).union(r.select(name("r", "r_regionkey")))
    return nodes.select("id", F.concat(F.lit("src/"), F.substring("id", 1, 1), F.lit("/"), "id", F.lit(".ts")).alias("path")), edges


HIERARCHY = """edges AS (SELECT 'o' || o_orderkey AS src, 'c' || o_custkey AS dst FROM orders UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
nodes AS (SELECT id, 'src/' || id[1] || '/' || id || '.ts' AS path FROM (SELECT 'o' || o_orderkey AS id FROM orders UNION ALL SELECT 'c' || c_custkey FROM customer
  UNION ALL SELECT 'n' || n_nationkey FROM nation UNION ALL SELECT 'r' || r_regionkey FROM region))"""


def supply(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """nodes (id), edges (src, dst): supplier -> part, as lineitem has them."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey")
    edges = li.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst")).distinct()
    nodes = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id")).union(table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string"))))
    return nodes, edges


SUPPLY = """edges AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem),
nodes AS (SELECT 's' || s_suppkey AS id FROM supplier UNION ALL SELECT 'p' || p_partkey FROM part)"""


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edges (src, dst): types of a user's events that follow each other; dense and with cycles."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    nxt = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.concat("event_type", (F.col("user_id") % 7).cast("string")).alias("src"), F.concat(nxt, ((F.col("user_id") * 3) % 7).cast("string")).alias("dst")).where("dst is not null").distinct()


TRANSITIONS = """edges AS (SELECT DISTINCT event_type || (user_id % 7) AS src, nxt || ((user_id * 3) % 7) AS dst FROM
  (SELECT user_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NOT NULL)"""


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """previous and current (path, hash, symbol_hash): rows gone and new, texts and signatures changed."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    path = F.concat(F.lit("src/"), "source", F.lit("/doc_"), F.col("doc_id").cast("string"))
    sig = F.substring("text", 1, 40)
    k = F.col("doc_id")
    previous = d.where(k % 10 != 0).select(path.alias("path"), F.sha2("text", 256).alias("hash"), F.sha2(sig, 256).alias("symbol_hash"))
    text = F.when(k % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    signature = F.when(k % 21 == 0, F.concat(sig, F.lit("!"))).otherwise(sig)
    current = d.where(k % 13 != 0).select(path.alias("path"), F.when(k % 17 != 0, F.sha2(text, 256)).alias("hash"), F.when(k % 17 != 0, F.sha2(signature, 256)).alias("symbol_hash"))
    return previous, current


SNAPSHOTS = """previous AS (SELECT 'src/' || source || '/doc_' || doc_id AS path, sha256(text) AS hash, sha256(text[1:40]) AS symbol_hash FROM documents WHERE doc_id % 10 <> 0),
current_ AS (SELECT 'src/' || source || '/doc_' || doc_id AS path, CASE WHEN doc_id % 17 <> 0 THEN sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) END AS hash,
  CASE WHEN doc_id % 17 <> 0 THEN sha256(CASE WHEN doc_id % 21 = 0 THEN text[1:40] || '!' ELSE text[1:40] END) END AS symbol_hash FROM documents WHERE doc_id % 13 <> 0),
changed AS (SELECT coalesce(p.path, c.path) AS path,
  CASE WHEN p.path IS NULL THEN 'added' WHEN c.path IS NULL THEN 'deleted' WHEN c.hash IS NOT NULL AND p.hash <> c.hash THEN 'modified' ELSE 'unchanged' END AS status,
  coalesce(p.path IS NOT NULL AND c.hash IS NOT NULL AND p.hash <> c.hash AND p.symbol_hash <> c.symbol_hash, FALSE) AS signature_changed
  FROM previous p FULL JOIN current_ c ON p.path = c.path)"""


def import_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edges (src, dst): document n+1 imports document n of its source."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    path = F.concat(F.lit("src/"), "source", F.lit("/doc_"), F.col("doc_id").cast("string"))
    a = d.select(path.alias("dst"), (F.col("doc_id") + 1).alias("next"))
    return a.join(d.select(path.alias("src"), F.col("doc_id").alias("next")), "next").select("src", "dst")


CHAIN = """chain AS (SELECT 'src/' || b.source || '/doc_' || b.doc_id AS src, 'src/' || a.source || '/doc_' || a.doc_id AS dst FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)"""


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files (k, path, language, content): a generated source file for each part, its language by the key modulo 12."""
    k = F.col("p_partkey")
    s = lambda c: c.cast("string")
    ks = s(k)
    g = lambda c: s(c % 7)
    cat = lambda *xs: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in xs])
    line = lambda *xs: F.array_join(F.array(*[x if not isinstance(x, str) else F.lit(x) for x in xs]), "\n")
    ts = line(
        cat("import { A", ks, ", B as C } from '../g", g(k + 12), "/f", s(k + 12), ".js';"), cat("import type D", ks, " from 'ext-", s(k % 5), "';"), cat("const m = await import('../g", g(k + 24), "/f", s(k + 24), "');"),
        cat("export async function fn", ks, "("), "  a: string,", "): Promise<void> {", "}", cat("export const arrow", ks, " = async (x) => x;"), cat("export class Cls", ks, " {"),
        F.when(k % 24 == 0, "  static getInstance() {}").otherwise("  run() {}"), "}", cat("function helper", ks, "() {"),
        F.when(k % 36 == 0, cat("  const password = \"hunter", ks, "\";")).when(k % 36 == 12, "  return eval(\"1\")").otherwise("  el.innerHTML = x"), "}",
        cat("export interface I", ks, " {"), "}", cat("export type T", ks, " = string;"), cat("export enum E", ks, " { A }"), cat("export const val", ks, " = 1;"),
        F.when(k % 60 == 0, cat("db.query(\"SELECT x + ", ks, "\")")).otherwise(""),
    )
    py = line(cat("import os", ks), cat("from .mod", ks, " import a, (b)"), "import sys, re", cat("from .mod", ks, " import c"), cat("class C", ks, "(Base):"), cat("    def _hidden", ks, "(self):"), "        pass", cat("    async def run", ks, "(self, x):"), "        pass")
    go = line("package main", "import (", cat("  \"fmt", ks, "\""), "  alias \"net/http\"", ")", cat("import \"os", ks, "\""), cat("func (r *R) Do", ks, "(x int) {"), "}", cat("func helper", ks, "() {"), "}", cat("type Shape", ks, " struct {"), "}")
    rs = line(cat("use crate::a", ks, "::b;"), "use std::io::*;", cat("pub(crate) async fn go", ks, "() {"), "}", cat("fn inner", ks, "() {"), "}", cat("pub struct S", ks, ";"), cat("pub trait T", ks, " {}"))
    html = line(cat("<script src=\"app", ks, ".js\"></script>"), "<link rel=x href='style.css'>", "<img alt=\"\" src=\"https://cdn/x.png\">", cat("<a href=\"page", ks, ".html\">x</a>"), "<img class=y src=\"pic.png\"><img class=y src=\"pic.png\">")
    md = line(cat("# Title ", ks), cat("See [next](../g", g(k + 12), "/f", s(k + 12), ".md#part) and [site](https://x/y)."), "[self](#here) [mail](mailto:a@b) [sp](./a%20b.md)", cat("[again](../g", g(k + 12), "/f", s(k + 12), ".md)"))
    java = line(cat("import java.util.List", ks, ";"), cat("import java.util.List", ks, ";"), "import static org.x;")
    cs = line(cat("using System.X", ks, ";"), "using (var y = 1)")
    c = line(cat("#include <std", ks, ".h>"), cat("#include \"f", s(k + 12), ".h\""))
    php = line(cat("use App\\Models", ks, ";"), cat("require_once 'lib/f", ks, ".php';"))
    rb = line(cat("require 'json", ks, "'"), cat("require_relative 'f", s(k + 12), "'"), "require './x'")
    mdx = line(cat("import Z", ks, " from './z.js'"), "[a](b.md)")
    names = ["typescript", "python", "go", "rust", "html", "markdown", "java", "csharp", "c", "php", "ruby", "mdx"]
    folders = ["src", "lib", "pkg", "crates", "web", "docs", "jv", "cs", "native", "www", "rb", "mx"]
    ends = ["ts", "py", "go", "rs", "html", "md", "java", "cs", "c", "php", "rb", "mdx"]
    pick = lambda xs: F.get(F.array(*[F.lit(x) for x in xs]), (k % 12).cast("int"))
    text = None
    for i, body in enumerate((ts, py, go, rs, html, md, java, cs, c, php, rb, mdx)):
        text = F.when(k % 12 == i, body) if text is None else text.when(k % 12 == i, body)
    return table(spark, sf_dir, "part").select(k.alias("k"), cat(pick(folders), "/g", g(k), "/f", ks, ".", pick(ends)).alias("path"), pick(names).alias("language"), text.alias("content"))


#: Paths of the generated files, for SQL.
CODE = """code AS (SELECT p_partkey AS k, ['src', 'lib', 'pkg', 'crates', 'web', 'docs', 'jv', 'cs', 'native', 'www', 'rb', 'mx'][CAST(p_partkey % 12 AS INT) + 1]
  || '/g' || (p_partkey % 7) || '/f' || p_partkey || '.' || ['ts', 'py', 'go', 'rs', 'html', 'md', 'java', 'cs', 'c', 'php', 'rb', 'mdx'][CAST(p_partkey % 12 AS INT) + 1] AS path FROM part)"""


def branch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """main and overrides (module_id, content): some equal, some changed, some new."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    b = table(spark, sf_dir, "benchmark").select("item_id", "text")
    main = d.select(F.concat(F.lit("m"), F.col("doc_id").cast("string")).alias("module_id"), F.col("text").alias("content"))
    own = d.where("doc_id % 5 = 0").select(F.concat(F.lit("m"), F.col("doc_id").cast("string")).alias("module_id"), F.when(F.col("doc_id") % 15 == 0, F.concat("text", F.lit(" changed"))).otherwise(F.col("text")).alias("content"))
    return main, own.unionByName(b.select(F.concat(F.lit("new"), F.col("item_id").cast("string")).alias("module_id"), F.col("text").alias("content")))


BRANCH = """main_ AS (SELECT 'm' || doc_id AS module_id, text AS content FROM documents),
overrides AS (SELECT 'm' || doc_id AS module_id, CASE WHEN doc_id % 15 = 0 THEN text || ' changed' ELSE text END AS content FROM documents WHERE doc_id % 5 = 0
  UNION ALL SELECT 'new' || item_id, text FROM benchmark)"""
