"""More registered queries and their SQL; the catalogue imports this module at its end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.operators import aliases, graph, order, parse, registry, search_index
from loam.plans import views as V
from loam.plans.catalogue import TERMS, query, r6, search_sql
from loam.sources import file_tree, scratch

# A language of a user's own


class Proto:
    """A user's parser of protocol buffer definitions; one file in ten is told as broken, to show what errors become."""

    def imports(self, path: str, content: str):
        for line in content.splitlines():
            if line.startswith("syntax") and "broken" in line:
                raise ValueError(line.strip())
            if line.startswith("import "):
                public = line.split()[1] == "public"
                yield registry.Import(line.split('"')[1], ("*",) if public else (), external=False)

    def symbols(self, path: str, content: str):
        for k, line in enumerate(content.splitlines(), 1):
            words = line.split()
            if words[:1] in (["message"], ["service"], ["enum"]):
                yield registry.Symbol(words[1], "interface" if words[0] == "service" else "enum" if words[0] == "enum" else "class", k, line.strip(), not words[1].startswith("Internal"))


def protos() -> registry.Registry:
    return parse.REGISTRY.copy().register("protobuf", Proto, extensions={".proto": "protobuf"})


def _protos(spark, sf_dir) -> DataFrame:
    """files (path, language, content): a definition for each supplier, beside the generated code."""
    k = F.col("s_suppkey")
    s = k.cast("string")
    cat = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    body = F.array_join(
        F.array(
            F.when(k % 10 == 3, 'syntax = "broken";').otherwise('syntax = "proto3";'), cat('import "common/base', (k % 4).cast("string"), '.proto";'), cat('import public "api/f', (k + 1).cast("string"), '.proto";'), cat("message Order", s, " {"), F.lit("}"),
            cat("  enum Kind", s, " { A = 0; }"), cat("service InternalShop", s, " {"), F.lit("}"),
        ),
        "\n",
    )
    own = V.table(spark, sf_dir, "supplier").select(cat("api/f", s, ".proto").alias("path"), body.alias("content"))
    own = own.withColumn("language", protos().language(F.col("path")))
    return own.unionByName(V.code(spark, sf_dir).where("language = 'go'").select("path", "content", "language"))


PROTO = "p AS (SELECT s_suppkey AS k, 'api/f' || s_suppkey || '.proto' AS path FROM supplier)"
GO_CODE = "g AS (SELECT * FROM code WHERE k % 12 = 2)"


@query(f"""WITH {V.CODE}, {GO_CODE}, {PROTO} SELECT path, 0 AS ord, 'common/base' || (k % 4) || '.proto' AS source, '' AS symbols, FALSE AS is_external FROM p WHERE k % 10 <> 3
UNION ALL SELECT path, 1, 'api/f' || (k + 1) || '.proto', '*', FALSE FROM p WHERE k % 10 <> 3
UNION ALL SELECT path, 0, 'fmt' || k, '', TRUE FROM g UNION ALL SELECT path, 1, 'net/http', '', TRUE FROM g UNION ALL SELECT path, 2, 'os' || k, '', TRUE FROM g""")
def parse_registered_imports(spark, sf_dir):
    i = parse.imports(_protos(spark, sf_dir), protos())
    return i.select("path", "ord", "source", F.array_join("symbols", "+").alias("symbols"), "is_external")


@query(f"""WITH {V.CODE}, {GO_CODE}, {PROTO}, x AS (SELECT path, 4 AS line, 'Order' || k AS name, 'class' AS kind, 'message Order' || k || ' {{' AS signature, TRUE AS is_exported FROM p
UNION ALL SELECT path, 6, 'Kind' || k, 'enum', 'enum Kind' || k || ' {{ A = 0; }}', TRUE FROM p UNION ALL SELECT path, 7, 'InternalShop' || k, 'interface', 'service InternalShop' || k || ' {{', FALSE FROM p
UNION ALL SELECT path, 7, 'Do' || k, 'function', 'func (r *R) Do' || k || '(x int) {{', TRUE FROM g UNION ALL SELECT path, 9, 'helper' || k, 'function', 'func helper' || k || '() {{', FALSE FROM g
UNION ALL SELECT path, 11, 'Shape' || k, 'type', 'type Shape' || k || ' struct {{', TRUE FROM g) SELECT *, sha256(signature) AS signature_hash FROM x""")
def parse_registered_symbols(spark, sf_dir):
    return parse.symbols(_protos(spark, sf_dir), protos())


@query(f"WITH {PROTO} SELECT path, 'imports' AS what, 'ValueError: syntax = \"broken\";' AS error FROM p WHERE k % 10 = 3")
def parser_errors(spark, sf_dir):
    return parse.parser_errors(_protos(spark, sf_dir), protos())


# Files


@query("""WITH d AS (SELECT source, lang, count(*) AS lines, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents WHERE source <> 'src1' AND lang <> 'de' GROUP BY ALL) SELECT 'docs/source=' || source || '/lang=' || lang AS folder, lines, chars FROM d""")
def tree_contents(spark, sf_dir):
    """Documents written out as text files, a JSON string a line, and read back as a tree: some folders shut by a glob, some files left out by a filter on path."""
    root = scratch.folder(spark, "written")
    d = V.table(spark, sf_dir, "documents").select("source", "lang", F.to_json(F.struct("text")).alias("line"))
    d.write.partitionBy("source", "lang").text(f"{root}/docs")
    read = file_tree.files(spark, root, exclude=["**/source=src1/**"], max_size=None).where("path like 'docs/source=%' and size > 0 and error is null")
    read = read.where(~F.col("path").contains("/lang=de/")).select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"), F.explode(F.split(F.regexp_replace("content", "\n$", ""), "\n")).alias("line"))
    return read.groupBy("folder").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length(F.get_json_object("line", "$.text"))).alias("chars"))


# Search on an index


_indexes: dict[tuple[str, str], search_index.Index] = {}


def _index(spark, sf_dir) -> search_index.Index:
    """The index of a table's artifacts, built once in a program."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes:
        _indexes[key] = search_index.indexed(V.artifacts(spark, sf_dir), lambda: scratch.folder(spark, "index"))
    return _indexes[key]


@query(search_sql(TERMS, None, 50, False))
def search_indexed(spark, sf_dir):
    return _index(spark, sf_dir).search(" ".join(TERMS), limit=50, snippets=False).withColumn("score", r6(F.col("score"), "score"))


@query(search_sql(["worthless", "src5"], None, 10, True))
def search_indexed_snippets(spark, sf_dir):
    return _index(spark, sf_dir).search("Worthless  src5").withColumn("score", r6(F.col("score"), "score"))


@query(search_sql(["doc_7", "stupid"], "gotcha_entry", 20, False))
def search_indexed_by_kind(spark, sf_dir):
    return _index(spark, sf_dir).search("doc_7 stupid", "gotcha_entry", 20, snippets=False).withColumn("score", r6(F.col("score"), "score"))


# Graphs


def _looped(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """nodes (id), edges (src, dst): the chain of documents, with a way back over three links at every thousandth."""
    d = V.table(spark, sf_dir, "documents").select("doc_id", "source")
    path = F.concat(F.lit("src/"), "source", F.lit("/doc_"), F.col("doc_id").cast("string"))
    to = d.select(path.alias("dst"), (F.col("doc_id") - 3).alias("doc_id"))
    back = d.where("doc_id % 1000 = 0").join(to, "doc_id").select(path.alias("src"), "dst")
    return d.select(path.alias("id")), V.import_chain(spark, sf_dir).unionByName(back)


@query("""WITH d AS (SELECT doc_id, 'src/' || source || '/doc_' || doc_id AS id FROM documents), top AS (SELECT max(doc_id) AS m FROM d),
c AS (SELECT id, doc_id, CASE WHEN doc_id % 1000 <= 3 AND doc_id - doc_id % 1000 + 3 <= m THEN doc_id - doc_id % 1000 ELSE doc_id END AS k FROM d, top)
SELECT id, min(id) OVER (PARTITION BY k) AS component, CAST(dense_rank() OVER (ORDER BY k) - 1 AS INT) AS level FROM c""")
def condensed_order(spark, sf_dir):
    return order.condensed_levels(*_looped(spark, sf_dir))


@query("""SELECT 'src/' || source || '/doc_' || doc_id AS id, CAST(doc_id AS INT) AS level FROM documents""")
def deep_levels(spark, sf_dir):
    nodes, _ = _looped(spark, sf_dir)
    return order.acyclic_levels(nodes, V.import_chain(spark, sf_dir))


ASKED = """asked AS (SELECT CASE s_suppkey % 7 WHEN 0 THEN 'src/c/c' || s_suppkey || '.ts' WHEN 1 THEN 'src' || chr(92) || 'o' || chr(92) || 'o' || (s_suppkey * 4) || '.ts' WHEN 2 THEN 'c' || s_suppkey || '.ts' WHEN 3 THEN 'o/o' || s_suppkey
  WHEN 4 THEN '/repo/src/n/n' || (s_suppkey % 25) || '.ts.bak' WHEN 5 THEN 'nothing' || s_suppkey ELSE chr(92) || 'r' || (s_suppkey % 9) END AS asked FROM supplier)"""


def _asked(spark, sf_dir) -> DataFrame:
    """asked (asked): paths as typed; whole, with separators turned, ends, parts, longer ones and unknown ones."""
    k = F.col("s_suppkey")
    s = lambda c: c.cast("string")
    cat = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    kinds = [cat("src/c/c", s(k), ".ts"), cat("src\\o\\o", s(k * 4), ".ts"), cat("c", s(k), ".ts"), cat("o/o", s(k)), cat("/repo/src/n/n", s(k % 25), ".ts.bak"), cat("nothing", s(k)), cat("\\r", s(k % 9))]
    return V.table(spark, sf_dir, "supplier").select(F.get(F.array(*kinds), (k % 7).cast("int")).alias("asked"))


@query(f"""WITH {V.HIERARCHY}, {ASKED}, a AS (SELECT DISTINCT asked, replace(asked, chr(92), '/') AS turned FROM asked),
j AS (SELECT asked, path, CASE WHEN path = asked THEN 0 WHEN path = turned THEN 1 WHEN ends_with(path, turned) THEN 2 ELSE 3 END AS rank FROM a JOIN nodes ON contains(path, turned) OR contains(turned, path))
SELECT asked, path, rank FROM j QUALIFY row_number() OVER (PARTITION BY asked ORDER BY rank, path) = 1""")
def fuzzy_paths(spark, sf_dir):
    nodes, _ = V.hierarchy(spark, sf_dir)
    return graph.fuzzy_paths(nodes, _asked(spark, sf_dir))


# Imports by alias, and imports made when needed

ALIASES = [
    ("", "@/*", 0, "src/*"), ("", "@/n/*", 0, "gone/*"), ("", "@/n/*", 1, "src/n/*"), ("", "@c/*.page", 0, "src/c/*"), ("", "home", 0, "src/r/r0.ts"), ("", "h*", 0, "src/r/r1.ts"),
    ("web/", "@/*", 0, "web/*"), ("web/", "@/*", 1, "src/*"), ("web/", "@/c/*", 0, "src/./c/../c/*.js"),
]


def _aliased(spark, sf_dir) -> DataFrame:
    """imports (path, source, resolved_path, is_external, is_dynamic): orders by alias, a quarter of them under web; customers by path."""
    cat = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs])
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    source = F.get(F.array(cat("@/c/c", c), cat("@/n/n", c % 25), cat("@c/c", c, ".page"), F.lit("home"), cat("react", k), cat("@/nothing/x", k)), (k % 6).cast("int"))
    path = F.when(k % 4 == 0, cat("web/o", k, ".ts")).otherwise(cat("src/o/o", k, ".ts"))
    orders = V.table(spark, sf_dir, "orders").select(path.alias("path"), source.alias("source"), F.lit(None).cast("string").alias("resolved_path"), F.lit(True).alias("is_external"), (c % 2 == 0).alias("is_dynamic"))
    u, n = F.col("c_custkey"), F.col("c_nationkey")
    customers = V.table(spark, sf_dir, "customer").select(cat("src/c/c", u, ".ts").alias("path"), cat("../n/n", n).alias("source"), cat("src/n/n", n).alias("resolved_path"), F.lit(False).alias("is_external"), (u % 3 == 0).alias("is_dynamic"))
    return orders.unionByName(customers)


@query(rf"""WITH {V.HIERARCHY}, al(scope, pattern, ord, target) AS (VALUES {", ".join(str(r) for r in ALIASES)}),
a AS (SELECT *, split_part(pattern, '*', 1) AS head, split_part(pattern, '*', 2) AS tail, contains(pattern, '*') AS open FROM al),
i AS (SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'web/o' || o_orderkey ELSE 'src/o/o' || o_orderkey END || '.ts' AS src, CASE o_orderkey % 6 WHEN 0 THEN '@/c/c' || o_custkey WHEN 1 THEN '@/n/n' || (o_custkey % 25)
  WHEN 2 THEN '@c/c' || o_custkey || '.page' WHEN 3 THEN 'home' WHEN 4 THEN 'react' || o_orderkey ELSE '@/nothing/x' || o_orderkey END AS source, o_custkey % 2 = 0 AS dynamic FROM orders),
m AS (SELECT src, source, dynamic, ord, replace(replace(CASE WHEN open THEN replace(target, '*', substr(source, length(head) + 1, length(source) - length(head) - length(tail))) ELSE target END, './c/../', ''), '.js', '') AS t
  FROM i JOIN a ON scope = CASE WHEN src LIKE 'web/%' THEN 'web/' ELSE '' END AND (source = pattern OR (open AND starts_with(source, head) AND ends_with(source, tail) AND length(source) >= length(head) + length(tail)))
  QUALIFY rank() OVER (PARTITION BY src, source ORDER BY open, length(head) DESC, length(tail) DESC) = 1),
c AS (SELECT src, source, dynamic, ord, t AS path FROM m UNION ALL SELECT src, source, dynamic, ord, t || '.ts' FROM m),
f AS (SELECT src, path AS dst, dynamic FROM c JOIN nodes USING (path) QUALIFY row_number() OVER (PARTITION BY src, source ORDER BY ord) = 1
  UNION ALL SELECT 'src/c/c' || c_custkey || '.ts', 'src/n/n' || c_nationkey || '.ts', c_custkey % 3 = 0 FROM customer)
SELECT src, dst, bool_and(dynamic) AS lazy FROM f WHERE src <> dst GROUP BY src, dst""")
def alias_edges(spark, sf_dir):
    nodes, _ = V.hierarchy(spark, sf_dir)
    return aliases.edges(_aliased(spark, sf_dir), nodes, spark.createDataFrame(ALIASES, aliases.SCHEMA))


@query(rf"""WITH RECURSIVE {V.HIERARCHY}, hops AS (SELECT src AS a, dst AS b, CASE WHEN CAST(src[2:] AS BIGINT) % 3 = 0 THEN 2 ELSE 1 END AS cost FROM edges UNION ALL SELECT dst, src, CASE WHEN CAST(src[2:] AS BIGINT) % 3 = 0 THEN 2 ELSE 1 END FROM edges),
d AS (SELECT id, 0 AS depth FROM nodes WHERE id[1] = 'c' AND CAST(id[2:] AS BIGINT) % 50 = 0 UNION SELECT b, depth + cost FROM d JOIN hops ON a = id WHERE depth + cost <= 3)
SELECT id, CAST(min(depth) AS INT) AS depth FROM d GROUP BY id""")
def lazy_distances(spark, sf_dir):
    nodes, edges = V.hierarchy(spark, sf_dir)
    number = F.expr("cast(substr(src, 2) as bigint)")
    start = nodes.where("id like 'c%' and cast(substr(id, 2) as bigint) % 50 = 0")
    return aliases.distances(nodes, edges.select("src", "dst", (number % 3 == 0).alias("lazy")), start, 3)
