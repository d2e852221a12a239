"""Registered queries and their SQL: each applies an operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.functions import scalar
from loam.operators import changes, graph, health, overlay, overview, parse, rank, summarise, tags
from loam.plans import views as V
from loam.sources import files
from loam.sources.scratch import stored
from loam.streaming import watch

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c, name: str):
    return F.round(c, 6).alias(name)


STOP = "[" + ", ".join(f"'{w}'" for w in scalar.STOP_WORDS) + "]"


def words_sql(e: str) -> str:
    return rf"list_filter(regexp_split_to_array(regexp_replace(lower({e}), '[^a-z0-9\s_-]', ' ', 'g'), '\s+'), lambda w: len(w) > 3 AND NOT list_contains({STOP}, w))"


# Search

TITLE = r"lower(coalesce(nullif(regexp_extract(content, '(?m)^#+ (.+)', 1), ''), split_part(content, chr(10), 1)))"
TERMS = ["idiot", "the", "src3"]


def search_sql(words: list[str], kind: str | None, limit: int, with_snippet: bool) -> str:
    df = ", ".join(f"count(*) FILTER (contains(lower(content || ' ' || path || ' ' || array_to_string(tags, ' ')), '{w}')) AS df{k}" for k, w in enumerate(words))
    parts, first = [], []
    for k, w in enumerate(words):
        hits = f"((length(lc) - length(replace(lc, '{w}', ''))) / {len(w)}.0)"
        parts.append(
            f"(CASE WHEN NOT contains(lp, '{w}') THEN 0.0::DOUBLE WHEN contains(split_part(lp, '/', -1), '{w}') THEN 2.5 ELSE 1.5 END + least(len(list_filter(tags, lambda t: contains(lower(t), '{w}') OR contains('{w}', lower(t)))) * 1.5, 3.0)"
            f" + CASE WHEN contains(ti, '{w}') THEN 1.3 ELSE 0.0 END + CASE WHEN {hits} > 0 THEN least({hits}::DOUBLE / (greatest(length(lc), 1)::DOUBLE / 1000) * (ln((n + 1)::DOUBLE / (df{k} + 1)) + 1) * 0.3, 2.0) ELSE 0.0 END)"
        )
        first.append(f"CASE WHEN {hits} > 0 THEN instr(lc, '{w}') - 1 END")
    flat = lambda e: rf"regexp_replace(regexp_replace({e}, '\n+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
    s, e = "greatest(f - 150, 0)", "least(length(content), f + 150)"
    snip = f"CASE WHEN f >= 0 THEN (CASE WHEN {s} > 0 THEN '…' ELSE '' END) || {flat(f'substr(content, {s} + 1, {e} - {s})')} || (CASE WHEN {e} < length(content) THEN '…' ELSE '' END) ELSE {flat('substr(content, 1, 250)')} || (CASE WHEN length(content) > 250 THEN '…' ELSE '' END) END"
    return f"""WITH {V.ARTIFACTS}, stats AS (SELECT count(*) AS n, {df} FROM artifacts),
prepared AS (SELECT *, lower(content) AS lc, lower(path) AS lp, {TITLE} AS ti FROM artifacts, stats {f"WHERE type = '{kind}'" if kind else ""}),
scored AS (SELECT *, ({" + ".join(parts)}) / {len(words)} AS raw, coalesce({", ".join(first)}) AS f FROM prepared)
SELECT ord, path, type, round(least(raw / 5, 1.0), 6) AS score{", " + snip + " AS snippet" if with_snippet else ""} FROM scored WHERE raw >= 0.1 ORDER BY least(raw / 5, 1.0) DESC, ord LIMIT {limit}"""


@query(search_sql(TERMS, None, 50, False))
def search_ranked(spark, sf_dir):
    return rank.search(V.artifacts(spark, sf_dir), " ".join(TERMS), limit=50).select("ord", "path", "type", r6(F.col("score"), "score"))


@query(search_sql(TERMS, "gotcha_entry", 20, False))
def search_type_filtered(spark, sf_dir):
    return rank.search(V.artifacts(spark, sf_dir), " ".join(TERMS), "gotcha_entry", 20).select("ord", "path", "type", r6(F.col("score"), "score"))


@query(search_sql(["worthless", "src5"], None, 10, True))
def search_snippets(spark, sf_dir):
    return rank.search(V.artifacts(spark, sf_dir), "Worthless  src5").select("ord", "path", "type", r6(F.col("score"), "score"), "snippet")


@query(f"WITH {V.ARTIFACTS}, w AS (SELECT unnest(['idiot', 'the', 'src3', 'nowhere']) AS keyword), c AS (SELECT keyword, count(*) FILTER (contains(lower(content || ' ' || path || ' ' || array_to_string(tags, ' ')), keyword)) AS df, count(*) AS n FROM artifacts, w GROUP BY keyword) SELECT keyword, df, round(ln((n + 1)::DOUBLE / (df + 1)) + 1, 6) AS idf FROM c")
def idf_table(spark, sf_dir):
    return rank.idf_table(V.artifacts(spark, sf_dir), [*TERMS, "nowhere"]).select("keyword", "df", r6(F.col("idf"), "idf"))


# Scalars

@query(f"""WITH w AS (SELECT doc_id, unnest({words_sql('text')}) AS word, generate_subscripts({words_sql('text')}, 1) AS pos FROM documents), u AS (SELECT doc_id, word, min(pos) AS pos FROM w GROUP BY ALL),
k AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS words FROM u GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_keywords, sha256(coalesce(words, '')) AS keywords_hash FROM documents d LEFT JOIN k USING (doc_id)""")
def keywords_per_doc(spark, sf_dir):
    k = scalar.keywords(F.col("text"))
    return V.table(spark, sf_dir, "documents").select("doc_id", k.alias("k")).select("doc_id", F.size("k").cast("long").alias("n_keywords"), F.sha2(F.array_join("k", " "), 256).alias("keywords_hash"))


@query(f"""WITH d AS (SELECT doc_id, list_distinct({words_sql("text")}) AS a, list_concat([source, lang], {words_sql("text")}) AS b FROM documents)
SELECT doc_id, round(CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b))::DOUBLE / greatest(len(a), len(b)) ELSE 0 END, 6) AS overlap FROM d""")
def keyword_overlap(spark, sf_dir):
    text = F.col("text")
    raw = F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9\s_-]", " "), r"\s+")
    stop = F.array(*[F.lit(w) for w in scalar.STOP_WORDS])
    b = F.concat(F.array("source", "lang"), F.filter(raw, lambda w: (F.length(w) > 3) & ~F.array_contains(stop, w)))
    return V.table(spark, sf_dir, "documents").select("doc_id", scalar.keywords(text).alias("a"), b.alias("b")).select("doc_id", r6(scalar.keyword_overlap(F.col("a"), F.col("b")), "overlap"))


TASKS = ["please fix it", "we add tests", "rename this", "unit coverage", "tell me why", "prefixed buggy", "New thing", "nothing here"]


@query("WITH t AS (SELECT conv_id, turn, lower(['" + "', '".join(TASKS) + r"""'][CAST((conv_id + turn) % 8 AS INT) + 1] || ' ' || text) AS t FROM conversations) SELECT conv_id, turn, CASE WHEN regexp_matches(t, '\b(fix|bug|error|crash|broken|wrong|incorrect|fail)\b') THEN 'bug_fix'
WHEN regexp_matches(t, '\b(add|implement|create|build|feature|new)\b') THEN 'feature_add' WHEN regexp_matches(t, '\b(refactor|rename|move|restructure|reorganize|clean)\b') THEN 'refactor'
WHEN regexp_matches(t, '\b(test|spec|coverage|unit|integration)\b') THEN 'test' WHEN regexp_matches(t, '\b(explain|understand|what|how|why|describe)\b') THEN 'explain' ELSE 'auto' END AS operation FROM t""")
def operation_detect(spark, sf_dir):
    c = V.table(spark, sf_dir, "conversations")
    task = F.concat(F.get(F.array(*[F.lit(t) for t in TASKS]), ((F.col("conv_id") + F.col("turn")) % 8).cast("int")), F.lit(" "), "text")
    return c.select("conv_id", "turn", scalar.operation(task).alias("operation"))


NAMES = ["a.d.ts", "x.H", "y.hpp", "Makefile", ".gitignore", "z.tar.gz", "p.PY", "q.yml", "r.", "s.mdx"]


@query("WITH n AS (SELECT p_partkey, 'dir.x/' || ['" + "', '".join(NAMES) + "'][CAST(p_partkey % 10 AS INT) + 1] AS path FROM part) SELECT p_partkey, path, ['typescript', 'c', 'cpp', 'unknown', 'unknown', 'unknown', 'python', 'yaml', 'unknown', 'mdx'][CAST(p_partkey % 10 AS INT) + 1] AS language, [TRUE, TRUE, TRUE, FALSE, FALSE, FALSE, TRUE, FALSE, FALSE, TRUE][CAST(p_partkey % 10 AS INT) + 1] AS is_source FROM n")
def language_detect(spark, sf_dir):
    path = F.concat(F.lit("dir.x/"), F.get(F.array(*[F.lit(n) for n in NAMES]), (F.col("p_partkey") % 10).cast("int")))
    return V.table(spark, sf_dir, "part").select("p_partkey", path.alias("path")).select("*", scalar.language(F.col("path")).alias("language")).select("*", scalar.is_source(F.col("language")).alias("is_source"))


SHAPES = ["src/core/f.ts", "src/f.ts", "lib/f.ts", "lib/a/f.ts", "foo/bar.ts", "f.ts", "packages/a/src/b/c.ts", "api", "src"]


@query("SELECT p_partkey, ['core', 'f.ts', 'f.ts', 'a', 'foo', 'root', 'b', 'api', 'root'][CAST(p_partkey % 9 AS INT) + 1] AS module_group FROM part")
def module_group(spark, sf_dir):
    path = F.get(F.array(*[F.lit(s) for s in SHAPES]), (F.col("p_partkey") % 9).cast("int"))
    return V.table(spark, sf_dir, "part").select("p_partkey", scalar.module_group(path).alias("module_group"))


@query("SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def token_counts(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select("doc_id", scalar.token_count(F.col("text")).alias("tokens"))


@query("SELECT doc_id, sha256(CASE WHEN length(text) <= 400 THEN text ELSE text[1:400] || chr(10) || chr(10) || '[...truncated to fit token budget...]' END) AS truncated_hash FROM documents")
def truncate_tokens(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select("doc_id", F.sha2(scalar.truncate_to_tokens(F.col("text"), 100), 256).alias("truncated_hash"))


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '\b[A-Z][a-zA-Z]{3,}\b') AS ws FROM documents), x AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
c AS (SELECT doc_id, word, count(*) AS n, min(pos) AS first FROM x GROUP BY ALL HAVING count(*) >= 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rn FROM c),
t AS (SELECT doc_id, lower(word) AS tag, min(rn) AS rn FROM r WHERE rn <= 10 GROUP BY ALL), f AS (SELECT t.*, d.source, d.lang FROM t JOIN documents d USING (doc_id)),
a AS (SELECT doc_id, string_agg(tag, ',' ORDER BY rn) AS ws FROM f WHERE tag NOT IN ('src', lower(source)) GROUP BY doc_id)
SELECT doc_id, 'src' || CASE WHEN length(source) > 2 AND source <> 'src' THEN ',' || lower(source) ELSE '' END || coalesce(',' || ws, '') AS tags FROM documents LEFT JOIN a USING (doc_id)""")
def content_tags(spark, sf_dir):
    a = V.artifacts(spark, sf_dir).select(F.col("ord").alias("id"), "path", "content")
    return tags.content_tags(a).select(F.col("id").alias("doc_id"), F.array_join("tags", ",").alias("tags"))


@query(f"WITH {V.ARTIFACTS} SELECT ord AS doc_id, sha256(path) AS path_id, id AS content_id, sha256(path)[1:8] AS short FROM artifacts")
def path_ids(spark, sf_dir):
    p = F.col("path")
    return V.artifacts(spark, sf_dir).select(F.col("ord").alias("doc_id"), scalar.path_id(F.translate(p, "/", "\\")).alias("path_id"), F.col("id").alias("content_id"), scalar.short_id(scalar.path_id(p)).alias("short"))


@query("WITH m AS (SELECT o_orderkey, CAST(o_orderkey * 137 % 400000 AS BIGINT) AS ms FROM orders) SELECT o_orderkey, CASE WHEN ms < 1000 THEN ms || 'ms' WHEN ms < 60000 AND ms % 500 = 250 THEN (ms + 50) // 1000 || '.' || (ms + 50) % 1000 // 100 || 's' WHEN ms < 60000 THEN printf('%.1f', CAST(ms AS DOUBLE) / 1000) || 's' ELSE (ms // 60000) || 'm ' || (ms % 60000 // 1000) || 's' END AS took FROM m")
def durations_fmt(spark, sf_dir):
    ms = F.col("o_orderkey") * 137 % 400000
    return V.table(spark, sf_dir, "orders").select("o_orderkey", scalar.duration(ms).alias("took"))


@query("WITH m AS (SELECT event_id, CAST(floor((epoch(TIMESTAMP '2024-02-01 00:00:00') - epoch(TIMESTAMP '2024-02-01 00:00:00' - to_seconds(CAST(event_id * 61 AS BIGINT)))) / 60) AS BIGINT) AS mi FROM events) SELECT event_id, CASE WHEN mi < 1 THEN 'just now' WHEN mi < 60 THEN mi || 'm ago' WHEN mi < 1440 THEN (mi // 60) || 'h ago' ELSE (mi // 1440) || 'd ago' END AS age FROM m")
def age_fmt(spark, sf_dir):
    as_of = F.lit(V.AS_OF).cast("timestamp")
    ts = F.timestamp_seconds(F.unix_timestamp(as_of) - F.col("event_id") * 61)
    return V.table(spark, sf_dir, "events").select("event_id", scalar.age(ts, as_of).alias("age"))


@query(f"WITH {V.ARTIFACTS} SELECT ord AS doc_id, round(exp(-(ord % 720) / 168.0), 6) AS recency FROM artifacts")
def recency_decay(spark, sf_dir):
    return V.artifacts(spark, sf_dir).select(F.col("ord").alias("doc_id"), r6(scalar.recency(F.col("generated_at"), F.lit(V.AS_OF)), "recency"))


# Scan

def _listing(spark, sf_dir) -> DataFrame:
    c = V.code(spark, sf_dir)
    k = F.col("k")
    path = F.when(k % 11 == 0, F.concat(F.lit("a/node_modules/"), "path")).when(k % 13 == 0, F.concat("path", F.lit(".min.js"))).when(k % 17 == 0, F.lit("x/package-lock.json")).when(k % 19 == 0, F.concat("path", F.lit(".sh"))).when(k % 23 == 0, F.concat(F.lit("tmp/"), "path")).otherwise(F.col("path"))
    size = F.when(k % 29 == 0, F.lit(0)).when(k % 31 == 0, F.lit(512001)).when(k % 37 == 0, F.lit(512000)).otherwise(F.lit(100)).cast("long")
    return c.select("k", path.alias("path"), size.alias("size"))


SCAN = f"""WITH {V.CODE}, l AS (SELECT k, CASE WHEN k % 11 = 0 THEN 'a/node_modules/' || path WHEN k % 13 = 0 THEN path || '.min.js' WHEN k % 17 = 0 THEN 'x/package-lock.json' WHEN k % 19 = 0 THEN path || '.sh' WHEN k % 23 = 0 THEN 'tmp/' || path ELSE path END AS path FROM code)
SELECT k, path FROM l WHERE k % 11 <> 0 AND k % 13 <> 0 AND k % 17 <> 0 AND k % 19 <> 0 AND k % 29 <> 0 AND k % 31 <> 0"""


@query(SCAN)
def scan_filter(spark, sf_dir):
    return files.scan(_listing(spark, sf_dir)).select("k", "path")


@query(SCAN + " AND NOT (starts_with(path, 'tmp/') AND NOT ends_with(path, '.go')) AND NOT (starts_with(path, 'docs/') OR contains(path, '/docs/')) AND NOT (starts_with(path, 'web/g1/'))")
def gitignore_filter(spark, sf_dir):
    rules = "# comment\n/tmp/**\n!*.go\n\ndocs/\n/web/g1\n"
    return files.scan(_listing(spark, sf_dir), ignore_text=rules).select("k", "path")


@query("WITH l AS (SELECT ['typescript', 'python', 'go', 'rust', 'html', 'markdown', 'java', 'csharp', 'c', 'php', 'ruby', 'mdx'][CAST(p_partkey % 12 AS INT) + 1] AS language FROM part) SELECT language, count(*) AS files FROM l GROUP BY language")
def lang_histogram(spark, sf_dir):
    c = V.code(spark, sf_dir).select("path")
    return files.language_counts(c.select(scalar.language(F.col("path")).alias("language")))


# Changes

@query(f"WITH {V.SNAPSHOTS} SELECT * FROM changed")
def change_set(spark, sf_dir):
    return changes.detect(*V.snapshots(spark, sf_dir))


@query(f"WITH {V.SNAPSHOTS} SELECT path FROM current_ EXCEPT SELECT path FROM previous")
def missing_artifacts(spark, sf_dir):
    previous, current = V.snapshots(spark, sf_dir)
    return changes.missing_artifacts(current, previous)


INVALID = f"""{V.SNAPSHOTS}, {V.CHAIN}, seeds AS (SELECT path FROM changed WHERE signature_changed), one AS (SELECT src FROM chain JOIN seeds ON dst = path), two AS (SELECT c.src FROM chain c JOIN one ON c.dst = one.src),
invalid AS (SELECT path FROM changed WHERE status IN ('added', 'modified') UNION SELECT path FROM seeds UNION SELECT src FROM one UNION SELECT src FROM two)"""


@query(f"WITH {INVALID} SELECT path FROM invalid WHERE path IN (SELECT path FROM current_)")
def invalidation(spark, sf_dir):
    previous, current = V.snapshots(spark, sf_dir)
    return changes.invalidated(changes.detect(previous, current), V.import_chain(spark, sf_dir), readable=current)


@query(f"WITH {INVALID} SELECT path, hash FROM previous WHERE path NOT IN (SELECT path FROM invalid) AND path NOT IN (SELECT path FROM changed WHERE status = 'deleted')")
def carry_forward(spark, sf_dir):
    previous, current = V.snapshots(spark, sf_dir)
    changed = changes.detect(previous, current)
    return changes.carried_forward(previous.select("path", "hash"), changes.invalidated(changed, V.import_chain(spark, sf_dir)), changed)


@query("WITH w AS (SELECT 'f' || p_partkey AS path, p_size % 5 AS level FROM part) SELECT path, CAST((row_number() OVER (ORDER BY level, path) - 1) // 4 AS BIGINT) AS batch FROM w")
def batches(spark, sf_dir):
    w = V.table(spark, sf_dir, "part").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("path"), (F.col("p_size") % 5).alias("level"))
    return changes.batches(w, 4).select("path", F.col("batch").cast("long").alias("batch"))


@query(f"WITH {V.SNAPSHOTS} SELECT c.path, 'markdown' AS language, CAST(length(c.path) AS BIGINT) AS size, coalesce(hash, '') AS hash, coalesce(symbol_hash, '') AS symbol_hash FROM current_ c")
def manifest_next(spark, sf_dir):
    _, current = V.snapshots(spark, sf_dir)
    return changes.next_manifest(current.select("path", F.lit("markdown").alias("language"), F.length("path").cast("long").alias("size")), current.where("hash is not null"))


@query(f"WITH {V.SNAPSHOTS} SELECT path, hash FROM previous WHERE path NOT IN (SELECT path FROM current_) UNION ALL SELECT path, coalesce(hash, 'none') FROM current_")
def artifact_upsert(spark, sf_dir):
    previous, current = V.snapshots(spark, sf_dir)
    return changes.upsert(previous.select("path", "hash"), current.select("path", F.coalesce("hash", F.lit("none")).alias("hash")), "path")


@query(f"WITH {V.SNAPSHOTS} SELECT p.path, p.hash FROM previous p WHERE EXISTS (SELECT 1 FROM current_ c WHERE c.path = p.path)")
def delete_removed(spark, sf_dir):
    previous, current = V.snapshots(spark, sf_dir)
    return changes.without_deleted(previous.select("path", "hash"), changes.detect(previous, current))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 0 DAY OR o_orderdate >= TIMESTAMP '1998-06-01' - INTERVAL 30 DAY")
def retention(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders").withColumn("mtime", F.col("o_orderdate"))
    kept = changes.retained(o, "1998-06-01 00:00:00")
    last = o.agg(F.max("o_orderdate").alias("last"))  # one row
    return kept.select("o_orderkey").union(o.join(F.broadcast(last), F.col("o_orderdate") == F.col("last")).select("o_orderkey")).distinct()


@query(f"WITH {V.ARTIFACTS} SELECT ord AS doc_id, (ord % 720) * 60 > 120 AS stale FROM artifacts")
def staleness(spark, sf_dir):
    minutes = F.floor(scalar.age_hours(F.col("generated_at"), F.lit(V.AS_OF)) * 60)
    return V.artifacts(spark, sf_dir).select(F.col("ord").alias("doc_id"), (minutes > 120).alias("stale"))


@query(f"WITH {V.SNAPSHOTS} SELECT status, signature_changed, count(*) AS n FROM changed GROUP BY ALL")
def history_diff(spark, sf_dir):
    previous, current = V.snapshots(spark, sf_dir)
    history = previous.withColumn("build_id", F.lit("b1")).unionByName(current.withColumn("build_id", F.lit("b2")))
    return changes.history_diff(history, "b1", "b2").groupBy("status", "signature_changed").agg(F.count(F.lit(1)).alias("n"))


# Graph

@query(f"WITH {V.SUPPLY}, i AS (SELECT dst AS id, count(*) AS n FROM edges GROUP BY 1), o AS (SELECT src AS id, count(*) AS n FROM edges GROUP BY 1) SELECT n.id, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree FROM nodes n LEFT JOIN i USING (id) LEFT JOIN o USING (id)")
def in_out_degree(spark, sf_dir):
    d = graph.degrees(*V.supply(spark, sf_dir))
    return d.select("id", F.col("in_degree").cast("long").alias("in_degree"), F.col("out_degree").cast("long").alias("out_degree"))


@query(f"WITH {V.SUPPLY}, i AS (SELECT dst AS id, count(*) AS n FROM edges GROUP BY 1) SELECT id, round(n::DOUBLE / max(n) OVER (), 6) AS weight FROM i ORDER BY n DESC, id LIMIT 20")
def centrality_topk(spark, sf_dir):
    return graph.top_modules(*V.supply(spark, sf_dir)).select("id", r6(F.col("weight"), "weight"))


def walk_sql(edges: str, start: str, depth: int, extra: str = "") -> str:
    return f"w AS (SELECT {start} AS id, 0 AS depth UNION SELECT e.b, w.depth + 1 FROM w JOIN ({edges}) e ON e.a = w.id WHERE w.depth < {depth}), d AS (SELECT id, min(depth) AS depth FROM w GROUP BY id) SELECT id, depth FROM d {extra}"


@query(f"WITH RECURSIVE {V.HIERARCHY}, " + walk_sql("SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges", "'n3'", 2))
def bfs_undirected(spark, sf_dir):
    nodes, edges = V.hierarchy(spark, sf_dir)
    return graph.distances(nodes, edges, spark.createDataFrame([("n3",), ("nowhere",)], "id string"), 2)


@query(f"WITH RECURSIVE {V.TRANSITIONS}, " + walk_sql("SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges", "(SELECT min(src) FROM edges)", 3))
def bfs_cyclic(spark, sf_dir):
    e = V.transitions(spark, sf_dir)
    start = e.agg(F.min("src").alias("id"))
    nodes = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    return graph.distances(nodes, e, start, 3)


@query(f"WITH RECURSIVE {V.HIERARCHY}, " + walk_sql("SELECT dst AS a, src AS b FROM edges", "'r0'", 5, "WHERE depth > 0"))
def blast_radius(spark, sf_dir):
    return graph.blast_radius(*V.hierarchy(spark, sf_dir), "r0")


@query(f"""WITH RECURSIVE {V.HIERARCHY}, w AS (SELECT id, 0 AS level FROM nodes WHERE id NOT IN (SELECT src FROM edges) UNION SELECT e.src, w.level + 1 FROM w JOIN edges e ON e.dst = w.id) SELECT id, max(level) AS level FROM w GROUP BY id""")
def topo_levels(spark, sf_dir):
    return graph.topological_levels(*V.hierarchy(spark, sf_dir))


@query(f"WITH {V.TRANSITIONS}, m AS (SELECT DISTINCT a.src FROM edges a JOIN edges b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst) SELECT count(*) AS nodes, count(*) / 2.0::DOUBLE AS cycles FROM m")
def mutual_cycles(spark, sf_dir):
    return graph.mutual_cycles(V.transitions(spark, sf_dir))


@query(f"WITH {V.HIERARCHY} SELECT id[1] AS module_group, count(*) AS n, min(path) AS first FROM nodes GROUP BY 1")
def module_groups(spark, sf_dir):
    return graph.module_groups(V.hierarchy(spark, sf_dir)[0]).select("module_group", F.size("paths").cast("long").alias("n"), F.get("paths", F.lit(0)).alias("first"))


@query(f"""WITH {V.HIERARCHY}, d AS (SELECT dst AS id, count(*) AS n FROM (SELECT DISTINCT src, dst FROM edges) GROUP BY 1), top AS (SELECT path, id, n FROM nodes JOIN d USING (id) ORDER BY n DESC, id LIMIT 10),
g AS (SELECT id[1] AS g, path, row_number() OVER (PARTITION BY id[1] ORDER BY path) AS rn, count(*) OVER (PARTITION BY id[1]) AS n FROM nodes), gl AS (SELECT g, '  ' || g || ': ' || string_agg(path, ', ' ORDER BY path) || CASE WHEN any_value(n) > 5 THEN ' (+' || (any_value(n) - 5) || ' more)' ELSE '' END AS line FROM g WHERE rn <= 5 GROUP BY g)
SELECT 'Total modules: ' || (SELECT count(*) FROM nodes) || chr(10) || 'Module groups: ' || (SELECT string_agg(g, ', ' ORDER BY g) FROM gl) || chr(10) || chr(10) || 'Most central modules (by import count):' || chr(10)
|| (SELECT string_agg('  ' || path || ' (imported by ' || n || ' modules)', chr(10) ORDER BY n DESC, id) FROM top) || chr(10) || chr(10) || 'Module groups:' || chr(10) || (SELECT string_agg(line, chr(10) ORDER BY g) FROM gl) AS summary""")
def graph_summary(spark, sf_dir):
    return graph.summary(*V.hierarchy(spark, sf_dir))


@query(f"WITH {V.HIERARCHY} SELECT DISTINCT src AS source, dst AS target FROM edges WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes)")
def graph_links(spark, sf_dir):
    return graph.export_links(*V.hierarchy(spark, sf_dir))[1]


@query(f"WITH {V.HIERARCHY} SELECT id, path FROM nodes WHERE id = 'c7' OR path = 'c7'")
def node_lookup(spark, sf_dir):
    return graph.node(V.hierarchy(spark, sf_dir)[0], "c7")


@query(f"WITH {V.HIERARCHY}, r AS (SELECT path, CASE WHEN ends_with(path, 'n/n3.ts') THEN 2 WHEN contains(path, 'n/n3.ts') OR contains('n/n3.ts', path) THEN 3 END AS rank FROM nodes) SELECT path, rank FROM r WHERE rank IS NOT NULL ORDER BY rank, path LIMIT 1")
def fuzzy_path(spark, sf_dir):
    return graph.fuzzy_path(V.hierarchy(spark, sf_dir)[0], "n\\n3.ts")


@query(f"""WITH {V.SUPPLY}, x AS (SELECT src, dst, CAST(dst[2:] AS INT) AS ord FROM edges WHERE CAST(dst[2:] AS INT) % 3 <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY ord) AS rn FROM x)
SELECT src, string_agg('summary of ' || dst, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY ord) AS context FROM r WHERE rn <= 3 GROUP BY src""")
def dep_top3(spark, sf_dir):
    nodes, edges = V.supply(spark, sf_dir)
    ord_ = F.substring("dst", 2, 20).cast("int")
    known = nodes.where("startswith(id, 'p')").where(F.substring("id", 2, 20).cast("int") % 3 != 0).select("id", F.concat(F.lit("summary of "), "id").alias("content"))
    return graph.first_dependencies(edges.withColumn("ord", ord_), known)


@query("""WITH m AS (SELECT 'src/' || source || '/doc_' || doc_id AS path, source AS g, CASE WHEN doc_id % 3 <> 0 THEN text END AS content FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY path) AS rn FROM m)
SELECT g AS module_group, coalesce(string_agg(content, chr(10) || chr(10) ORDER BY rn), '') AS context FROM r WHERE rn <= 5 GROUP BY g""")
def group_top5(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents")
    m = d.select(F.concat(F.lit("src/"), "source", F.lit("/doc_"), F.col("doc_id").cast("string")).alias("path"), F.when(F.col("doc_id") % 3 != 0, F.col("text")).alias("content"))
    return rank.first_summaries(m)


def _health_nodes(spark, sf_dir) -> DataFrame:
    d = V.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    t = V.table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    k = F.col("doc_id")
    return d.join(t, "doc_id", "left").select(
        F.concat(F.lit("src/"), "source", F.when(k % 5 == 0, "/domain.ts").otherwise("/x.rs")).alias("path"), (k % 4).alias("in_degree"), (k % 9).alias("out_degree"), (k % 500 == 1).alias("mutual"), F.length("text").alias("size"),
        F.coalesce("toxic", F.lit(0)).alias("high_issues"),
    )


@query("""WITH n AS (SELECT doc_id % 4 AS i, doc_id % 9 AS o, doc_id % 500 = 1 AS m, doc_id % 5 = 0 AS entry, length(text) AS size, coalesce(toxic, 0) AS hi FROM documents LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1) USING (doc_id)),
a AS (SELECT count(*) AS n, count(*) FILTER (i = 0 AND NOT entry) AS isolated, count(*) FILTER (m) / 2.0 AS cycles, count(*) FILTER (size > 20000) AS large, sum(o)::DOUBLE / count(*) AS coupling, sum(hi) AS high FROM n),
s AS (SELECT *, greatest(0, floor(100 - least(20, isolated * 100.0 / n) - least(20, cycles * 5) - least(15, large * 3) - least(15, greatest(0, coupling - 3) * 2) - least(20, high * 5) + 0.5)) AS score FROM a)
SELECT isolated, large, CAST(high AS BIGINT) AS high, CAST(score AS BIGINT) AS score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade FROM s""")
def health_score(spark, sf_dir):
    return health.score(_health_nodes(spark, sf_dir)).select("isolated", "large", F.col("high").cast("long").alias("high"), "score", "grade")


@query("""WITH f AS (SELECT p_size AS n FROM part) SELECT n, count(*) AS files, round(any_value((n * 800 + 8000) / 1000.0 * 0.00015 + (n * 1200 + 4000) / 1000.0 * 0.0006), 6) AS full_cost, any_value(CAST(ceil(n * 0.05) AS BIGINT)) AS changed,
round(any_value((ceil(n * 0.05) * 800 + 1000) / 1000.0 * 0.00015 + ceil(n * 0.05) * 1200 / 1000.0 * 0.0006), 6) AS incremental_cost, any_value(CAST(floor((1 - 5000.0 / (n * 1800)) * 100 + 0.5) AS BIGINT)) AS reduction_pct,
any_value(CAST(ceil(n / 8.0) * 2500 AS BIGINT)) AS full_ms FROM f GROUP BY n""")
def cost_model(spark, sf_dir):
    n = V.table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("n")).agg(F.count(F.lit(1)).alias("files"))
    return health.cost(n.select("n")).join(n, "n").select("n", "files", r6(F.col("full_cost"), "full_cost"), "changed", r6(F.col("incremental_cost"), "incremental_cost"), F.col("reduction_pct").cast("long").alias("reduction_pct"), F.col("full_ms").cast("long").alias("full_ms"))


@query("SELECT count(*) AS total_files, count(DISTINCT lang) AS languages, CAST(sum(ceil(length(text) / 4.0)) AS BIGINT) AS tokens, count(*) FILTER (doc_id % 7 = 0) AS rebuilt, CAST(sum(doc_id % 4) AS BIGINT) AS security_issues, CAST(sum(doc_id % 3) AS BIGINT) AS patterns, CAST(floor(count(*) * 1800 * 0.75 + 0.5) AS BIGINT) AS saved FROM documents")
def build_statistics(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("language"), scalar.token_count(F.col("text")).alias("tokens"), (F.col("doc_id") % 7 == 0).alias("rebuilt"), (F.col("doc_id") % 4).alias("issues"), (F.col("doc_id") % 3).alias("patterns"))
    return health.build_stats(d).select("total_files", "languages", "tokens", "rebuilt", "security_issues", "patterns", health.estimated_savings(F.col("total_files")).cast("long").alias("saved"))


# Relevance and packing

TASK = "fix the worthless onther parsing of src4 markdown"


def relevance_sql(targets: bool) -> str:
    weights = "CASE type WHEN 'module_summary' THEN 0.9 WHEN 'execution_flow' THEN 0.8 WHEN 'gotcha_entry' THEN 1.0 WHEN 'architecture_overview' THEN 0.3 WHEN 'architectural_decision' THEN 0.4 WHEN 'feature_domain' THEN 0.3 ELSE 0.7 END"
    b = f"list_concat(tags, list_concat(list_distinct({words_sql('path')}), list_distinct({words_sql('content[1:500]')})))"
    proximity = "CASE WHEN contains(path, 'src/src4/en') OR contains('src/src4/en', path) THEN 1.0 WHEN ord % 5 < 4 AND ord % 3 = 0 THEN greatest(0, 1 - (ord % 5) * 0.3::DOUBLE) ELSE 0.05 END" if targets else "0.3"
    central = "least((ord % 11) / 20.0::DOUBLE, 0.3)" if targets else "0"
    return f"""{V.ARTIFACTS}, task AS (SELECT list_distinct({words_sql("'" + TASK + "'")}) AS a), kw AS (SELECT *, {b} AS b FROM artifacts, task),
scored AS (SELECT id, ord, type, path, content, round(0.35 * (CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_filter(a, lambda x: list_contains(b, x)))::DOUBLE / greatest(len(a), len(b)) ELSE 0 END) + 0.30 * ({proximity})::DOUBLE + 0.20 * ({weights})::DOUBLE + 0.10 * exp(-(ord % 720) / 168.0::DOUBLE) + 0.05 * ({central})::DOUBLE, 6) AS score FROM kw)"""


def _scored(spark, sf_dir, targets: bool = False) -> DataFrame:
    a = V.artifacts(spark, sf_dir)
    if not targets:
        s = rank.relevance(a, TASK, V.AS_OF)
    else:
        near = a.where("ord % 5 < 4 and ord % 3 = 0").select("path", (F.col("ord") % 5).alias("depth"))
        s = rank.relevance(a, TASK, V.AS_OF, targets=["src/src4/en"], near=near, degree=a.select("path", (F.col("ord") % 11).alias("in_degree")))
    return s.withColumn("score", F.round("score", 6))


@query(f"WITH {relevance_sql(False)} SELECT ord, score FROM scored")
def relevance_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select("ord", "score")


@query(f"WITH {relevance_sql(True)} SELECT ord, score FROM scored")
def relevance_with_targets(spark, sf_dir):
    return _scored(spark, sf_dir, True).select("ord", "score")


def fill_sql(budget: int, used: int = 0, limit: int | None = None) -> str:
    limit = budget if limit is None else limit
    return f"""WITH RECURSIVE {relevance_sql(False)}, firsts AS (SELECT id, min_by(content, ord) AS c, min_by(type, ord) AS ty FROM scored GROUP BY id),
s AS (SELECT row_number() OVER (ORDER BY score DESC, ord) AS rn, ord, id, CAST(ceil(length(c) / 4.0) AS BIGINT) AS t, ty, score FROM scored JOIN firsts USING (id)),
f AS (SELECT CAST(0 AS BIGINT) AS rn, CAST({used} AS BIGINT) AS used, 'start' AS status UNION ALL SELECT s.rn, CASE WHEN f.used < {budget} AND f.used + s.t <= {limit} THEN f.used + s.t ELSE f.used END, CASE WHEN f.used >= {budget} THEN 'unreached' WHEN f.used + s.t <= {limit} THEN 'selected' ELSE 'excluded' END FROM f JOIN s ON s.rn = f.rn + 1)"""


@query(fill_sql(30000) + " SELECT ord, id, t AS tokens, status FROM f JOIN s USING (rn) WHERE status <> 'unreached'")
def budget_fill(spark, sf_dir):
    return rank.fill_budget(rank.first_of_id(_scored(spark, sf_dir)), 30000).select("ord", "id", "tokens", "status")


ARCHITECTURE = "a wide view " * 4000  # of 12,000 tokens; a package has 7500 of them and the mark of the cut
SHARE = -(-(30000 + len(scalar.TRUNCATED)) // 4)


@query(fill_sql(30000, SHARE, 22500 + SHARE) + " SELECT ord, id, t AS tokens, status FROM f JOIN s USING (rn) WHERE status <> 'unreached'")
def budget_fill_architecture(spark, sf_dir):
    return rank.fill_budget(rank.first_of_id(_scored(spark, sf_dir)), 30000, ARCHITECTURE).select("ord", "id", "tokens", "status")


@query(fill_sql(30000) + ", best AS (SELECT id, max(score) AS score FROM s GROUP BY id) SELECT ord, s.id, CASE WHEN ty = 'module_summary' AND best.score > 0.4 THEN 'primary' WHEN ty = 'module_summary' THEN 'supporting' WHEN ty = 'execution_flow' THEN 'flows' WHEN ty = 'gotcha_entry' THEN 'gotchas' END AS section FROM f JOIN s USING (rn) JOIN best ON best.id = s.id WHERE status = 'selected'")
def context_sections(spark, sf_dir):
    s = rank.first_of_id(stored(rank.sized(_scored(spark, sf_dir)), "sized"))  # scored once, read twice
    return rank.sections(rank.fill_budget(s, 30000), s).select("ord", "id", "section")


@query(fill_sql(4000) + """, told AS (SELECT id, max(score) AS best, min_by(path, ord) AS path FROM scored GROUP BY id),
p AS (SELECT s.score, ord, told.path, json_object('path', told.path, 'content', c) AS whole, to_json(c) AS c,
  CASE WHEN s.ty = 'module_summary' AND best > 0.4 THEN 'primary' WHEN s.ty = 'module_summary' THEN 'supporting' WHEN s.ty = 'execution_flow' THEN 'flows' WHEN s.ty = 'gotcha_entry' THEN 'gotchas' END AS section
  FROM f JOIN s USING (rn) JOIN told ON told.id = s.id JOIN firsts ON firsts.id = s.id WHERE status = 'selected')
SELECT CAST(json_object(""" + ", ".join(f"'{k}', " + (f"coalesce(list({c} ORDER BY score DESC, ord) FILTER (section = '{k}'), CAST([] AS JSON[]))" if c else "'Overview.'") for k, c in (("primary", "whole"), ("supporting", "whole"), ("architecture", None), ("flows", "c"), ("gotchas", "c"))) + ") AS VARCHAR) AS package FROM p")
def context_json(spark, sf_dir):
    scored = _scored(spark, sf_dir)
    s = rank.first_of_id(stored(rank.sized(scored), "sized"))  # scored once, read twice
    return rank.package(rank.sections(rank.fill_budget(s, 4000), s), scored.select("id", "ord", "content"), "json", "Overview.")


# Parsers, on generated code

def code_sql(rows: str) -> str:
    return f"WITH {V.CODE}, r AS ({rows}) SELECT * FROM r"


def imp(mod: int, *rows: tuple[str, str, str, str, str]) -> str:
    """SQL rows (path, source, resolved_path, symbols, is_external) of the files of one language."""
    return " UNION ALL ".join(f"SELECT path, {s} AS source, {r} AS resolved_path, {y} AS symbols, {e} AS is_external FROM code WHERE k % 12 = {mod}{w}" for s, r, y, e, w in [(*x, "") if len(x) == 4 else x for x in rows])


def _imports(spark, sf_dir, *languages: str) -> DataFrame:
    i = parse.imports(V.code(spark, sf_dir).where(F.col("language").isin(*languages)))
    return i.select("path", "source", "resolved_path", F.array_join("symbols", "+").alias("symbols"), "is_external")


NEXT = "'../g' || ((k + 12) % 7) || '/f' || (k + 12)"
TS_IMPORTS = imp(
    0, (f"{NEXT} || '.js'", "'src/g' || ((k + 12) % 7) || '/f' || (k + 12) || '.js'", "'A' || k || '+B'", "FALSE"), ("'ext-' || (k % 5)", "NULL", "'D' || k", "TRUE"), ("'../g' || ((k + 24) % 7) || '/f' || (k + 24)", "'src/g' || ((k + 24) % 7) || '/f' || (k + 24)", "''", "FALSE")
)
MD_IMPORTS = imp(5, (f"{NEXT} || '.md'", "'docs/g' || ((k + 12) % 7) || '/f' || (k + 12) || '.md'", "''", "FALSE"), ("'./a b.md'", "'docs/g' || (k % 7) || '/a b.md'", "''", "FALSE"))
HTML_IMPORTS = imp(4, ("'app' || k || '.js'", "NULL", "''", "FALSE"), ("'style.css'", "NULL", "''", "FALSE"), ("'pic.png'", "NULL", "''", "FALSE"))
PY_IMPORTS = imp(1, ("'os' || k", "NULL", "''", "TRUE"), ("'.mod' || k", "'lib/g' || (k % 7) || '/.mod' || k", "'a+b'", "FALSE"), ("'sys,'", "NULL", "''", "TRUE"))
GO_IMPORTS = imp(2, ("'fmt' || k", "NULL", "''", "TRUE"), ("'net/http'", "NULL", "''", "TRUE"), ("'os' || k", "NULL", "''", "TRUE"))
RUST_IMPORTS = imp(3, ("'crate::a' || k || '::b'", "NULL", "''", "FALSE"), ("'std::io::'", "NULL", "''", "TRUE"))
C_IMPORTS = imp(8, ("'std' || k || '.h'", "NULL", "''", "TRUE"), ("'f' || (k + 12) || '.h'", "NULL", "''", "FALSE"))


@query(code_sql(TS_IMPORTS))
def parse_ts_imports(spark, sf_dir):
    return _imports(spark, sf_dir, "typescript")


@query(code_sql(PY_IMPORTS))
def parse_python_imports(spark, sf_dir):
    return _imports(spark, sf_dir, "python")


@query(code_sql(GO_IMPORTS))
def parse_go_imports(spark, sf_dir):
    return _imports(spark, sf_dir, "go")


@query(code_sql(RUST_IMPORTS))
def parse_rust_imports(spark, sf_dir):
    return _imports(spark, sf_dir, "rust")


@query(code_sql(imp(6, ("'java.util.List' || k", "NULL", "''", "TRUE"), ("'static'", "NULL", "''", "TRUE")) + " UNION ALL " + imp(7, ("'System.X' || k", "NULL", "''", "TRUE"))))
def parse_java_csharp(spark, sf_dir):
    return _imports(spark, sf_dir, "java", "csharp")


@query(code_sql(C_IMPORTS + " UNION ALL " + imp(9, ("'App\\Models' || k", "NULL", "''", "TRUE"), ("'lib/f' || k || '.php'", "NULL", "''", "FALSE")) + " UNION ALL " + imp(10, ("'json' || k", "NULL", "''", "TRUE"), ("'f' || (k + 12)", "NULL", "''", "FALSE"), ("'./x'", "NULL", "''", "FALSE"))))
def parse_c_php_ruby(spark, sf_dir):
    return _imports(spark, sf_dir, "c", "php", "ruby")


@query(code_sql(HTML_IMPORTS))
def parse_html(spark, sf_dir):
    return _imports(spark, sf_dir, "html")


@query(code_sql(MD_IMPORTS))
def parse_markdown(spark, sf_dir):
    return _imports(spark, sf_dir, "markdown")


@query(code_sql(imp(11, ("'./z.js'", "'mx/g' || (k % 7) || '/z.js'", "'Z' || k", "FALSE"), ("'b.md'", "NULL", "''", "FALSE"))))
def parse_mdx(spark, sf_dir):
    return _imports(spark, sf_dir, "mdx")


def sym(mod: int, *rows: tuple[str, str, int, str, str]) -> str:
    return " UNION ALL ".join(f"SELECT path, {n} AS name, '{kind}' AS kind, {line} AS line, {s} AS signature, {e} AS is_exported FROM code WHERE k % 12 = {mod}" for n, kind, line, s, e in rows)


def _symbols(spark, sf_dir, *languages: str) -> DataFrame:
    return parse.symbols(V.code(spark, sf_dir).where(F.col("language").isin(*languages))).select("path", "name", "kind", "line", "signature", "is_exported")


TS_SYMBOLS = sym(
    0, ("'fn' || k", "function", 4, "'export async function fn' || k || '( a: string, ): Promise<void>'", "TRUE"), ("'arrow' || k", "function", 8, "'export const arrow' || k || ' = async (x) => x;'", "TRUE"), ("'Cls' || k", "class", 9, "'export class Cls' || k || ' {'", "TRUE"),
    ("'I' || k", "interface", 15, "'export interface I' || k || ' {' || chr(10) || '}' || chr(10) || 'export type T' || k || ' = string;' || chr(10) || 'export enum E' || k || ' { A }' || chr(10) || 'export const val' || k || ' = 1;'", "TRUE"),
    ("'T' || k", "type", 17, "'export type T' || k || ' = string;'", "TRUE"), ("'E' || k", "enum", 18, "'export enum E' || k || ' { A }' || chr(10) || 'export const val' || k || ' = 1;' || chr(10) || CASE WHEN k % 60 = 0 THEN 'db.query(\"SELECT x + ' || k || '\")' ELSE '' END", "TRUE"),
    ("'val' || k", "const", 19, "'export const val' || k || ' = 1;'", "TRUE"), ("'helper' || k", "function", 12, "'function helper' || k || '() {'", "FALSE"),
)
PY_SYMBOLS = sym(1, ("'C' || k", "class", 5, "'class C' || k || '(Base):'", "TRUE"), ("'_hidden' || k", "function", 6, "'def _hidden' || k || '(self):'", "FALSE"), ("'run' || k", "function", 8, "'async def run' || k || '(self, x):'", "TRUE"))
GO_SYMBOLS = sym(2, ("'Do' || k", "function", 7, "'func (r *R) Do' || k || '(x int) {'", "TRUE"), ("'helper' || k", "function", 9, "'func helper' || k || '() {'", "FALSE"), ("'Shape' || k", "type", 11, "'type Shape' || k || ' struct {'", "TRUE"))
RUST_SYMBOLS = sym(3, ("'go' || k", "function", 3, "'pub(crate) async fn go' || k || '() {'", "TRUE"), ("'inner' || k", "function", 5, "'fn inner' || k || '() {'", "FALSE"), ("'S' || k", "class", 7, "'pub struct S' || k || ';'", "TRUE"), ("'T' || k", "interface", 8, "'pub trait T' || k || ' {}'", "TRUE"))


@query(f"WITH {V.CODE}, r AS ({TS_SYMBOLS}) SELECT * FROM r WHERE is_exported")
def parse_ts_exports(spark, sf_dir):
    return _symbols(spark, sf_dir, "typescript").where("is_exported")


@query(f"WITH {V.CODE}, r AS ({TS_SYMBOLS}) SELECT * FROM r WHERE NOT is_exported")
def parse_ts_internals(spark, sf_dir):
    return _symbols(spark, sf_dir, "typescript").where("not is_exported")


@query(code_sql(PY_SYMBOLS))
def parse_python_symbols(spark, sf_dir):
    return _symbols(spark, sf_dir, "python")


@query(code_sql(GO_SYMBOLS))
def parse_go_symbols(spark, sf_dir):
    return _symbols(spark, sf_dir, "go")


@query(code_sql(RUST_SYMBOLS))
def parse_rust_symbols(spark, sf_dir):
    return _symbols(spark, sf_dir, "rust")


ALL_SYMBOLS = " UNION ALL ".join((TS_SYMBOLS, PY_SYMBOLS, GO_SYMBOLS, RUST_SYMBOLS))


@query(f"WITH {V.CODE}, r AS ({ALL_SYMBOLS}), s AS (SELECT path, string_agg(signature, chr(10) ORDER BY signature) AS t FROM r WHERE is_exported GROUP BY path) SELECT c.path, sha256(coalesce(t, '')) AS symbol_hash FROM code c LEFT JOIN s USING (path)")
def signature_hash(spark, sf_dir):
    c = V.code(spark, sf_dir)
    return parse.symbol_hashes(c, parse.symbols(c))


@query(f"WITH {V.CODE}, r AS ({ALL_SYMBOLS}) SELECT name, kind, count(*) AS n, min(path) AS first FROM r WHERE is_exported GROUP BY name, kind")
def symbol_index(spark, sf_dir):
    return parse.symbol_index(parse.symbols(V.code(spark, sf_dir))).select("name", "kind", F.size("places").cast("long").alias("n"), F.get("places", F.lit(0))["path"].alias("first"))


@query(f"""WITH {V.CODE}, r AS ({ALL_SYMBOLS}), x AS (SELECT path, name, row_number() OVER (PARTITION BY path ORDER BY line, name) AS rn FROM r WHERE is_exported), n AS (SELECT path, string_agg(name, ', ' ORDER BY rn) AS names FROM x WHERE rn <= 4 GROUP BY path),
g AS (SELECT c.path, CASE WHEN c.path LIKE 'src/%' THEN split_part(c.path, '/', 2) WHEN c.path LIKE 'lib/%' OR c.path LIKE 'pkg/%' THEN split_part(c.path, '/', 2) ELSE split_part(c.path, '/', 1) END AS module_group, '- `' || c.path || '`' || coalesce(' — ' || names, '') AS line FROM code c LEFT JOIN n USING (path))
SELECT module_group, sha256(string_agg(line, chr(10) ORDER BY line)) AS entry_hash FROM g GROUP BY module_group""")
def knowledge_index(spark, sf_dir):
    c = V.code(spark, sf_dir)
    return parse.knowledge_index(c, parse.symbols(c)).select("module_group", F.sha2("entry", 256).alias("entry_hash"))


#: Lines put after each text: credentials, values that are looked up, and one that begins on the line before.
PLANTED = ['password = "hunter22"', "const token = 'abcdef' || process.env.TOKEN", "\t API_KEY :'k-12345' ", 'secret="abcd" + config.tail', "pwd =\n'abcdef'", "auth: 'abc'"]


@query(r"""WITH p AS (SELECT doc_id, coalesce(text, '') || chr(10) || [""" + ", ".join("'" + x.replace("'", "''").replace("\t", "' || chr(9) || '").replace("\n", "' || chr(10) || '") + "'" for x in PLANTED) + r"""][CAST(doc_id % 6 AS INT) + 1] AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM p)
SELECT 'd' || doc_id AS path, CAST(n AS INT) AS line, regexp_replace(line, '^\s+|\s+$', '', 'g')[1:80] AS code FROM l WHERE regexp_matches(line, '(?i)(?:password|passwd|pwd|secret|api_key|apikey|token|auth)\s*[=:]\s*[''"][^''"]{4,}[''"]') AND NOT contains(line, 'process.env') AND NOT contains(line, 'config.')""")
def secrets(spark, sf_dir):
    planted = F.get(F.array(*[F.lit(x) for x in PLANTED]), (F.col("doc_id") % 6).cast("int"))
    d = V.table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.lit("markdown").alias("language"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), planted).alias("content"))
    return parse.secrets(d)


@query(f"""WITH {V.CODE} SELECT path, 'high' AS severity, 'Hardcoded Secret' AS title, '{parse.FINDINGS["Hardcoded Secret"][1]}' AS "desc", 13 AS line, 'const password = "hunter' || k || '";' AS code FROM code WHERE k % 36 = 0
UNION ALL SELECT path, 'high', 'Dangerous eval()', '{parse.FINDINGS["Dangerous eval()"][1]}', 0, NULL FROM code WHERE k % 36 = 12 UNION ALL SELECT path, 'medium', 'Dangerous HTML Render', '{parse.FINDINGS["Dangerous HTML Render"][1]}', 0, NULL FROM code WHERE k % 36 = 24
UNION ALL SELECT path, 'high', 'SQL Injection Risk', '{parse.FINDINGS["SQL Injection Risk"][1]}', 0, 'db.query("SELECT x + ' || k || '")' FROM code WHERE k % 60 = 0""")
def unsafe_code(spark, sf_dir):
    return parse.findings(V.code(spark, sf_dir)).fillna(0, ["line"])


#: (path, content, names of its patterns).
SHOWN = [
    ("a.ts", "x.getInstance()", ["Singleton"]), ("b.ts", "const x = createThing (1);", ["Factory"]), ("c.ts", "bus.on('x', f)", ["Observer/Event"]), ("d.ts", "export const useCart = 1", ["Custom Hook"]),
    ("e.ts", "const C = createContext(0)", ["Factory", "Context Provider"]), ("WidgetFactory.ts", "", ["Factory"]), ("f.ts", "let  instance = 0; emit(1)", ["Singleton", "Observer/Event"]), ("g.ts", "recreate(1); create (2); export use", []),
    ("h.ts", "export function useX() { return useContext(C) }", ["Custom Hook", "Context Provider"]), ("i.java", "private  static\tinstance", ["Singleton"]), ("j.ts", "createÄ(1); create9(2); createA_9\n(3)", ["Factory"]),
]


@query("WITH t AS (" + " UNION ALL ".join(f"SELECT {k} AS k, '{p}' AS file, '{n}' AS name, '{parse.PATTERNS[n][0]}' AS icon, '{parse.PATTERNS[n][1]}' AS \"desc\"" for k, (p, _, names) in enumerate(SHOWN) for n in names) + f") SELECT 'p' || p_partkey || '/' || file AS path, name, icon, \"desc\", 'info' AS severity FROM part JOIN t ON k = p_partkey % {len(SHOWN)}")
def patterns(spark, sf_dir):
    shown = F.get(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(c).alias("c")) for p, c, _ in SHOWN]), (F.col("p_partkey") % len(SHOWN)).cast("int"))
    part = V.table(spark, sf_dir, "part").select("p_partkey", shown.alias("x"))
    return parse.patterns(part.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit("/"), "x.p").alias("path"), F.lit("typescript").alias("language"), F.col("x.c").alias("content")))


@query(f"""WITH {V.CODE}, t AS (SELECT path AS src, 'src/g' || ((k + d) % 7) || '/f' || (k + d) || '.ts' AS dst FROM code, (SELECT unnest([12, 24]) AS d) WHERE k % 12 = 0 UNION ALL SELECT path, 'docs/g' || ((k + 12) % 7) || '/f' || (k + 12) || '.md' FROM code WHERE k % 12 = 5)
SELECT src, dst FROM t WHERE dst IN (SELECT path FROM code)""")
def import_edges(spark, sf_dir):
    c = V.code(spark, sf_dir)
    return graph.resolve_edges(parse.imports(c), c).select("src", "dst")


@query(f"""WITH {V.CODE} SELECT path, 'ext-' || (k % 5) AS deps FROM code WHERE k % 12 = 0 UNION ALL SELECT path, 'os' || k || ',sys,' FROM code WHERE k % 12 = 1 UNION ALL SELECT path, 'fmt' || k || ',net/http,os' || k FROM code WHERE k % 12 = 2 UNION ALL SELECT path, 'std::io::' FROM code WHERE k % 12 = 3
UNION ALL SELECT path, 'java.util.List' || k || ',static' FROM code WHERE k % 12 = 6 UNION ALL SELECT path, 'System.X' || k FROM code WHERE k % 12 = 7 UNION ALL SELECT path, 'std' || k || '.h' FROM code WHERE k % 12 = 8 UNION ALL SELECT path, 'App\\Models' || k FROM code WHERE k % 12 = 9 UNION ALL SELECT path, 'json' || k FROM code WHERE k % 12 = 10""".replace("\\\\", "\\"))
def external_deps(spark, sf_dir):
    return parse.external_dependencies(parse.imports(V.code(spark, sf_dir))).select("path", F.array_join("deps", ",").alias("deps"))


# Branches

@query(f"WITH {V.BRANCH} SELECT coalesce(m.module_id, o.module_id) AS module_id, sha256(coalesce(o.content, m.content)) AS content_hash FROM main_ m FULL JOIN overrides o ON m.module_id = o.module_id")
def branch_overlay(spark, sf_dir):
    return overlay.read(*V.branch(spark, sf_dir)).select("module_id", F.sha2("content", 256).alias("content_hash"))


@query(f"WITH {V.BRANCH} SELECT o.module_id, CASE WHEN m.module_id IS NULL THEN 'branch_new' WHEN m.content = o.content THEN 'skipped' ELSE 'conflict' END AS kind FROM overrides o LEFT JOIN main_ m USING (module_id)")
def merge_classify(spark, sf_dir):
    return overlay.classify(*V.branch(spark, sf_dir)).select("module_id", "kind")


@query(f"WITH {V.BRANCH}, c AS (SELECT m.module_id IS NULL AS new, m.content = o.content AS same FROM overrides o LEFT JOIN main_ m USING (module_id)) SELECT count(*) FILTER (NOT new AND NOT same) AS conflicts, count(*) FILTER (new) AS resolved, count(*) FILTER (same) AS skipped FROM c")
def merge_counts(spark, sf_dir):
    return overlay.merge(*V.branch(spark, sf_dir))[1]


@query(f"WITH {V.BRANCH}, n AS (SELECT module_id, 'note on ' || module_id AS note FROM overrides) SELECT n.module_id, sha256(CASE WHEN m.content IS NOT NULL THEN m.content || chr(10) || chr(10) || '---' || chr(10) || '## Branch Override' || chr(10) || note ELSE note END) AS content_hash FROM n LEFT JOIN main_ m USING (module_id)")
def branch_context_append(spark, sf_dir):
    main, own = V.branch(spark, sf_dir)
    return overlay.add_context(main, own.select("module_id", F.concat(F.lit("note on "), "module_id").alias("note"))).select("module_id", F.sha2("content", 256).alias("content_hash"))


@query(r"SELECT s_suppkey, lower(regexp_replace('Feature/' || s_name || ' v2', '[^a-zA-Z0-9_-]', '-', 'g')) AS branch FROM supplier")
def branch_names(spark, sf_dir):
    return V.table(spark, sf_dir, "supplier").select("s_suppkey", scalar.branch_name(F.concat(F.lit("Feature/"), "s_name", F.lit(" v2"))).alias("branch"))


# Summaries

@query(r"""WITH c AS (SELECT 'src/' || source || '/doc_' || doc_id || '.md' AS path, CASE WHEN length(text) <= 5600 THEN text ELSE text[1:5600] || chr(10) || chr(10) || '[...truncated to fit token budget...]' END AS t FROM documents)
SELECT path, CAST(ceil(length('File: ' || path || chr(10) || chr(10) || 'Language: markdown' || chr(10) || chr(10) || 'Exports: none' || chr(10) || chr(10) || 'Depends on:' || chr(10) || 'none' || chr(10) || chr(10) || t) / 4.0) AS BIGINT) AS prompt_tokens FROM c""")
def summary_prompts(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents")
    f = d.select(F.concat(F.lit("src/"), "source", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.lit("markdown").alias("language"), F.col("text").alias("content"), F.lit(None).cast("string").alias("exports"), F.lit(None).cast("string").alias("dependencies"))
    return summarise.module_prompt(f).select("path", scalar.token_count(F.col("prompt")).alias("prompt_tokens"))


@query(rf"""WITH p AS (SELECT doc_id, source, 'src/' || source || '/doc_' || doc_id || '.md' AS path, CASE WHEN text IS NULL THEN 'Depends on:' || chr(10) || 'none' WHEN length(text) > 5600 THEN text[1:5600] || '{scalar.TRUNCATED}' ELSE text END AS prompt FROM documents),
l AS (SELECT doc_id, source, path, [x FOR x IN string_split(string_split(prompt, chr(10) || chr(10))[-1], chr(10)) IF trim(x, ' ' || chr(9) || chr(13)) <> ''] AS lines FROM p),
e AS (SELECT doc_id, source, path, trim(array_to_string(lines, chr(10))[1:8000], ' ' || chr(9) || chr(13) || chr(10)) AS c FROM l),
w AS (SELECT doc_id, regexp_extract_all(c, '\b[A-Z][a-zA-Z]{{3,}}\b') AS ws FROM e), x AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
n AS (SELECT doc_id, word, count(*) AS n, min(pos) AS first FROM x GROUP BY ALL HAVING count(*) >= 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rn FROM n),
t AS (SELECT doc_id, lower(word) AS tag, min(rn) AS rn FROM r WHERE rn <= 10 GROUP BY ALL), a AS (SELECT doc_id, string_agg(tag, ',' ORDER BY rn) AS ws FROM t JOIN e USING (doc_id) WHERE tag NOT IN ('src', lower(source)) GROUP BY doc_id)
SELECT sha256(c) AS id, path, CAST(ceil(length(c) / 4.0) AS BIGINT) AS token_count, 'src' || CASE WHEN length(source) > 2 AND source <> 'src' THEN ',' || lower(source) ELSE '' END || coalesce(',' || ws, '') AS tags FROM e LEFT JOIN a USING (doc_id)""")
def compile_stub(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents")
    f = d.select(F.concat(F.lit("src/"), "source", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.lit("markdown").alias("language"), F.col("text").alias("content"), F.lit(None).cast("string").alias("exports"), F.lit(None).cast("string").alias("dependencies"))
    return summarise.artifacts(summarise.run(summarise.module_prompt(f)), "module_summary", V.AS_OF).select("id", "path", "metadata.token_count", F.array_join("tags", ",").alias("tags"))


@query(rf"""WITH {V.BRANCH}, c AS (SELECT o.module_id, m.content AS m, o.content AS b FROM overrides o JOIN main_ m USING (module_id) WHERE o.content IS DISTINCT FROM m.content)
SELECT module_id, CASE WHEN contains(coalesce(b, ''), coalesce(m, '')) THEN 'additive' ELSE 'contradictory' END AS kind FROM c""")
def merge_conflict_kinds(spark, sf_dir):
    return overlay.conflict_kind(*V.branch(spark, sf_dir))


@query(rf"""WITH {V.BRANCH}, c AS (SELECT o.module_id, m.content AS m, o.content AS b FROM overrides o JOIN main_ m USING (module_id) WHERE o.content IS DISTINCT FROM m.content),
a AS (SELECT *, array_to_string(list_filter(string_split(string_split(b, chr(10) || chr(10))[-1], chr(10)), lambda x: regexp_matches(x, '\S')), chr(10))[1:6000] AS t FROM c)
SELECT module_id, sha256(regexp_replace(t, '^\s+|\s+$', '', 'g')) AS content, sha256(m) AS main_content, sha256(b) AS branch_content FROM a""")
def merge_by_provider(spark, sf_dir):
    return overlay.resolved_by(*V.branch(spark, sf_dir)).select("module_id", *[F.sha2(c, 256).alias(c) for c in ("content", "main_content", "branch_content")])


# Overviews

@query(f"WITH g AS ({ORACLES['group_top5']}), t AS (SELECT string_agg('### Domain: ' || module_group || chr(10) || context, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY module_group) AS t FROM g WHERE context <> '') SELECT sha256(CASE WHEN length(t) > 24000 THEN t[1:24000] || '{scalar.TRUNCATED}' ELSE t END) AS joined FROM t")
def overview_domains(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents")
    m = d.select(F.concat(F.lit("src/"), "source", F.lit("/doc_"), F.col("doc_id").cast("string")).alias("path"), F.when(F.col("doc_id") % 3 != 0, F.col("text")).alias("content"))
    return overview.domains(m).select(F.sha2("joined", 256).alias("joined"))


def _overview_input(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes, edges = V.hierarchy(spark, sf_dir)
    return nodes.withColumn("language", F.when(F.startswith("id", F.lit("o")), "go").otherwise("rust")), edges, nodes.select("path", F.concat(F.lit("summary of "), "id").alias("content"))


@query(f"""WITH s AS ({ORACLES['graph_summary']}), {V.HIERARCHY}, r AS (SELECT id, id[1] AS g, row_number() OVER (PARTITION BY id[1] ORDER BY path) AS rn FROM nodes),
x AS (SELECT g, string_agg('summary of ' || id, chr(10) || chr(10) ORDER BY rn) AS t FROM r WHERE rn <= 5 GROUP BY g)
SELECT '' AS path, 'Describe the architecture of this repository: purpose, subsystems, data flow, technology, decisions, points of extension.' || chr(10) || chr(10) || 'Repository: demo' || chr(10) || 'Languages: go, rust' || chr(10) || 'Modules: ' || (SELECT count(*) FROM nodes)
|| chr(10) || chr(10) || (SELECT summary FROM s) || chr(10) || chr(10) || (SELECT string_agg('### Domain: ' || g || chr(10) || t, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY g) FROM x) AS prompt""")
def architecture_prompt(spark, sf_dir):
    return overview.architecture_prompt("demo", *_overview_input(spark, sf_dir))


@query(f"""WITH {V.HIERARCHY}, d AS (SELECT dst AS id, count(DISTINCT src) AS n FROM edges GROUP BY 1), top AS (SELECT id, path, row_number() OVER (ORDER BY coalesce(n, 0) DESC, id) AS rn FROM nodes LEFT JOIN d USING (id)),
x AS (SELECT * FROM top WHERE rn <= 15)
SELECT '' AS path, 'Describe the three to five main execution flows: trigger, steps from module to module, key functions, notes.' || chr(10) || chr(10) || 'Repository: demo' || chr(10)
|| (SELECT string_agg('- ' || path || ' (' || CASE WHEN id[1] = 'n' THEN 'b' || id || ', a' || id ELSE '' END || ')', chr(10) ORDER BY rn) FROM x WHERE rn <= 10)
|| chr(10) || chr(10) || (SELECT string_agg('summary of ' || id, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rn) FROM x) AS prompt""")
def flows_prompt(spark, sf_dir):
    nodes, edges, modules = _overview_input(spark, sf_dir)
    exports = nodes.where("startswith(id, 'n')").select("path", F.explode(F.array(F.struct(F.lit(2).alias("line"), F.concat(F.lit("a"), "id").alias("name")), F.struct(F.lit(1).alias("line"), F.concat(F.lit("b"), "id").alias("name")))).alias("x")).select("path", "x.*")
    return overview.flows_prompt("demo", nodes, edges, exports, modules)


@query(f"""WITH {V.ARTIFACTS} SELECT use, type, count(*) AS n FROM artifacts, (VALUES ('search'), ('task')) u(use)
WHERE type IN ('module_summary', 'execution_flow') OR (type = 'architecture_overview' AND use = 'search') GROUP BY ALL""")
def candidate_union(spark, sf_dir):
    a = V.artifacts(spark, sf_dir)
    modules, others = a.where("type = 'module_summary'"), a.where("type <> 'module_summary'")
    n = [rank.candidates(modules, others, use).groupBy("type").agg(F.count(F.lit(1)).alias("n")).withColumn("use", F.lit(use)) for use in ("search", "task")]
    return n[0].unionByName(n[1])


@query(f"""WITH {V.ARTIFACTS} SELECT ord, sha256(array_to_string(string_split(content, chr(10))[1:3], chr(10))) AS lines, sha256(content[1:800]) AS long, sha256(CASE WHEN ord % 2 = 0 THEN 'found' ELSE content[1:300] END) AS short FROM artifacts""")
def result_previews(spark, sf_dir):
    c = F.col("content")
    snippet = F.when(F.col("ord") % 2 == 0, "found").otherwise("")
    shown = {"lines": rank.preview(c), "long": rank.preview(c, "long"), "short": rank.preview(c, "short", snippet)}
    return V.artifacts(spark, sf_dir).select("ord", *[F.sha2(e, 256).alias(k) for k, e in shown.items()])


@query(f"""WITH {V.ARTIFACTS}, a AS (SELECT count(*) FILTER (type = 'module_summary') AS m, max(CASE WHEN type = 'architecture_overview' THEN CAST(ceil(length(content) / 4.0) AS BIGINT) END) AS t FROM artifacts)
SELECT ord, label, ok, message FROM a, LATERAL (VALUES (0, 'root', TRUE, '/srv'), (1, 'configuration', TRUE, 'readable'), (2, 'provider', FALSE, 'no answer'), (3, 'modules', m > 0, CASE WHEN m > 0 THEN m || ' modules' ELSE 'build first' END),
(4, 'architecture', t IS NOT NULL, coalesce(t || ' tokens', 'build first')), (5, 'primer', FALSE, 'build first'), (6, 'key', TRUE, 'set')) v(ord, label, ok, message)""")
def doctor(spark, sf_dir):
    return health.doctor(V.artifacts(spark, sf_dir), "/srv", True, (False, "no answer"), False, True)


@query(f"WITH {V.SNAPSHOTS} SELECT c.path, c.hash FROM current_ c LEFT JOIN previous p ON p.path = c.path WHERE p.path IS NULL OR p.hash IS DISTINCT FROM c.hash")
def artifact_noop(spark, sf_dir):
    previous, current = V.snapshots(spark, sf_dir)
    return changes.differing(previous.select("path", "hash"), current.select("path", "hash"), "path", "hash")


@query(f"WITH {V.SNAPSHOTS} SELECT path, hash, symbol_hash FROM previous")
def history_rollback(spark, sf_dir):
    previous, current = V.snapshots(spark, sf_dir)
    at = lambda d, b: d.select("*", F.lit(b).alias("build_id"), F.lit(f"2024-01-0{b[1]}").alias("built_at"))
    return changes.rollback(at(previous, "b1").unionByName(at(current, "b2"))).select("path", "hash", "symbol_hash")


# Change events

SESSIONS = """WITH e AS (SELECT ts, CASE WHEN ts - lag(ts) OVER (ORDER BY ts) > INTERVAL 300 SECOND THEN 1 ELSE 0 END AS fresh FROM events{where}), s AS (SELECT ts, sum(fresh) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e),
b AS (SELECT epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 300000000 AS end_us, count(*) AS events FROM s GROUP BY g) SELECT * FROM b{closed}"""


def _events(spark, sf_dir) -> DataFrame:
    return V.table(spark, sf_dir, "events").select("ts", F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("a/node_modules/"), "event_type")).when(F.col("event_id") % 7 == 0, F.lit(".ctx/x")).otherwise(F.col("event_type")).alias("filename"))


def _bursts(b: DataFrame) -> DataFrame:
    return b.select(F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "events")


@query(SESSIONS.format(where="", closed=""))
def debounce_sessions(spark, sf_dir):
    return _bursts(watch.bursts(_events(spark, sf_dir), "300 seconds"))


@query(SESSIONS.format(where=" WHERE event_id % 5 <> 0 AND event_id % 7 <> 0", closed=""))
def watch_filtered(spark, sf_dir):
    return _bursts(watch.bursts(watch.relevant(_events(spark, sf_dir)), "300 seconds"))


@query(SESSIONS.format(where="", closed=" WHERE end_us <= (SELECT epoch_us(max(ts)) FROM events)"))
def stream_incremental(spark, sf_dir):
    """A stream of events, debounced and given to a build by micro-batch; bursts that the watermark has passed come out."""
    schema = V.table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).select("ts", F.col("event_type").alias("filename"))
    root = stored(spark.range(1), "stream").inputFiles()[0].rpartition("/")[0]  # a fresh folder, shared by all
    out, kind = root + "/bursts", "start_us bigint, end_us bigint, events bigint"
    spark.createDataFrame([], kind).write.mode("append").parquet(out)

    def build(df: DataFrame, batch: int) -> None:
        _bursts(df).write.mode("append").parquet(out)

    watch.rebuild_on_change(stream, build, root + "/state", "300 seconds").awaitTermination()
    return spark.read.schema(kind).parquet(out)


from loam.plans import adopted, extended  # noqa: E402, F401  they register their queries here
