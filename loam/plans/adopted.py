"""Queries on context folders, branches and whole packages, and their SQL; the catalogue imports this module at its end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.functions import scalar
from loam.operators import overlay, rank
from loam.plans import views as V
from loam.plans.catalogue import ARCHITECTURE, _scored, fill_sql, query
from loam.sources import context_tree
from loam.sources.scratch import stored

# A context folder


def _cat(*xs) -> F.Column:
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])


def _tree(spark, sf_dir) -> DataFrame:
    """files (path, content) of a context folder: a module for each document, some without summary or metadata, some with broken or partial ones; a branch for each supplier."""
    k = F.col("doc_id")
    d = V.table(spark, sf_dir, "documents").select("doc_id", "text", _cat("src/", F.col("source"), "/doc_", k.cast("string"), ".md").alias("of"))
    at = F.lit(V.AS_OF).cast("timestamp_ntz") - F.make_dt_interval(hours=(k % 720).cast("int"))
    metadata = F.struct(_cat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), ".000Z").alias("generatedAt"), F.lit("made/up").alias("generatedBy"), F.sha2("of", 256).alias("sourceHash"), F.lit(7).alias("tokenCount"), (k % 4 + 1).cast("int").alias("version"), F.lit(0.5).alias("confidence"))
    known = F.struct(F.sha2("text", 256).alias("id"), F.lit("module_summary").alias("type"), F.col("of").alias("path"), F.when(k % 19 != 0, metadata).alias("metadata"), F.when(k % 5 != 0, F.array(F.lit("a"), _cat("b", (k % 3).cast("string")))).alias("tags"))
    meta = F.when(k % 17 == 0, '{"id": "cut off').when(k % 23 == 0, "null").otherwise(F.to_json(known))
    folder = _cat("artifacts/modules/", scalar.path_id(F.col("of")), "/")
    some = F.array(
        F.when(k % 11 != 0, F.struct(_cat(folder, "summary.md").alias("path"), F.col("text").alias("content"))), F.when(k % 13 != 0, F.struct(_cat(folder, "meta.json").alias("path"), meta.alias("content"))),
        F.when(k % 6 == 0, F.struct(_cat(folder, "gotchas.md").alias("path"), _cat("Beware: ", F.col("text")).alias("content"))),
        F.when(k % 4 == 0, F.struct(_cat("branches/b", (k % 3).cast("string"), "/modules/", scalar.path_id(F.col("of")), "/summary.md").alias("path"), _cat(F.col("text"), " on a branch").alias("content"))),
    )
    modules = d.select(F.inline(F.filter(some, lambda x: x.isNotNull())))
    r = V.table(spark, sf_dir, "region")
    names = F.get(F.array(*[F.lit(x) for x in (context_tree.ARCHITECTURE, context_tree.FLOWS, context_tree.DECISIONS, "artifacts/index.md", "CONTEXT_PRIMER.md")]), F.col("r_regionkey").cast("int"))
    shared = r.where("r_regionkey < 5").select(names.alias("path"), _cat("# ", F.col("r_name")).alias("content"))
    u, name = F.col("s_suppkey"), _cat("Feature/", F.col("s_name"))
    told = F.struct(name.alias("name"), F.lit("2024-01-02T03:04:05.000Z").alias("createdAt"), F.when(u % 2 == 0, "dev").alias("parent"), F.when(u % 3 == 0, _cat("Of nation ", F.col("s_nationkey").cast("string"))).alias("description"), F.array().cast("array<string>").alias("overrides"))
    home = _cat("branches/", scalar.branch_name(name), "/")
    of_branch = F.array(F.struct(_cat(home, "meta.json").alias("path"), F.when(u % 9 == 0, "{").otherwise(F.to_json(told)).alias("content")), F.when(u % 4 == 0, F.struct(_cat(home, "notes.md").alias("path"), _cat("Of nation ", F.col("s_nationkey").cast("string")).alias("content"))))
    own = V.table(spark, sf_dir, "supplier").select(F.inline(F.filter(of_branch, lambda x: x.isNotNull())))
    return modules.unionByName(shared).unionByName(own)


DOCS = "d AS (SELECT doc_id AS k, text, 'src/' || source || '/doc_' || doc_id || '.md' AS path FROM documents), sound AS (SELECT *, k % 13 <> 0 AND k % 17 <> 0 AND k % 23 <> 0 AS ok FROM d)"
TAGS = "CASE WHEN ok AND k % 5 <> 0 THEN 'a,b' || (k % 3) ELSE '' END"


@query(f"""WITH {DOCS}, r AS (SELECT r_regionkey AS n, '# ' || r_name AS c FROM region)
SELECT sha256(text) AS id, 'module_summary' AS type, path, sha256(text) AS content, CASE WHEN k % 19 <> 0 THEN strftime(TIMESTAMP '{V.AS_OF}' - to_hours(CAST(k % 720 AS INT)), '%Y-%m-%d %H:%M:%S') END AS at, CASE WHEN k % 19 <> 0 THEN CAST(k % 4 + 1 AS VARCHAR) ELSE 'none' END AS version, {TAGS} AS tags
FROM sound WHERE ok AND k % 11 <> 0 AND text IS NOT NULL
UNION ALL SELECT sha256('Beware: ' || text), 'gotcha_entry', CASE WHEN ok THEN path ELSE '' END, sha256('Beware: ' || text), '{V.AS_OF}', '1', {TAGS} FROM sound WHERE k % 6 = 0 AND text IS NOT NULL
UNION ALL SELECT CASE n WHEN 0 THEN 'arch' WHEN 1 THEN 'flows' ELSE sha256(c) END, CASE n WHEN 0 THEN 'architecture_overview' WHEN 1 THEN 'execution_flow' ELSE 'architectural_decision' END, '', sha256(c), '{V.AS_OF}', '1', '' FROM r WHERE n <= 2""")
def tree_artifacts(spark, sf_dir):
    """Every artifact of a context folder: modules, their gotchas, architecture, flows and decisions."""
    t = _tree(spark, sf_dir)
    a = context_tree.modules(t).unionByName(context_tree.gotchas(t, V.AS_OF)).drop("module_id").unionByName(context_tree.overviews(t, V.AS_OF))
    return a.select("id", "type", "path", F.sha2("content", 256).alias("content"), F.date_format("metadata.generated_at", "yyyy-MM-dd HH:mm:ss").alias("at"), F.coalesce(F.col("metadata.version").cast("string"), F.lit("none")).alias("version"), F.array_join("tags", ",").alias("tags"))


@query(r"""WITH s AS (SELECT s_suppkey AS k, 'Feature/' || s_name AS name, 'Of nation ' || s_nationkey AS a FROM supplier)
SELECT lower(regexp_replace(name, '[^a-zA-Z0-9_-]', '-', 'g')) AS folder, name, '2024-01-02 03:04:05' AS created_at, CASE WHEN k % 2 = 0 THEN 'dev' ELSE 'main' END AS parent, CASE WHEN k % 3 = 0 THEN a END AS description, CASE WHEN k % 4 = 0 THEN a END AS notes FROM s WHERE k % 9 <> 0""")
def tree_branches(spark, sf_dir):
    b = context_tree.branches(_tree(spark, sf_dir))
    return b.select("folder", "name", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"), "parent", "description", "notes")


@query(f"""WITH {DOCS}, m AS (SELECT sha256(path) AS id, text FROM sound WHERE ok AND k % 11 <> 0 AND text IS NOT NULL), o AS (SELECT sha256(path) AS id, text || ' on a branch' AS text FROM d WHERE k % 4 = 0 AND k % 3 = 1 AND text IS NOT NULL)
SELECT id AS module_id, sha256(coalesce(o.text, m.text)) AS content FROM m FULL JOIN o USING (id)""")
def tree_branch_view(spark, sf_dir):
    """The modules as one branch of a context folder sees them."""
    t = _tree(spark, sf_dir)
    seen = overlay.read(context_tree.modules(t), context_tree.overrides(t).where("folder = 'b1'"))
    return seen.select("module_id", F.sha2("content", 256).alias("content"))


@query(f"""WITH {DOCS}, m AS (SELECT path, text, k % 19 <> 0 AS told, k % 4 + 1 AS version, (k % 720) AS h FROM sound WHERE ok AND k % 11 <> 0 AND text IS NOT NULL)
SELECT path, sha256('Module: ' || path || chr(10) || CASE WHEN told THEN 'Version ' || version || ' | Generated ' || CASE WHEN h = 0 THEN 'just now' WHEN h < 24 THEN h || 'h ago' ELSE (h // 24) || 'd ago' END || chr(10) || 'Source hash: ' || substr(sha256(path), 1, 8)
  ELSE 'Version unknown | Generated unknown' || chr(10) || 'Source hash: unknown' END || chr(10) || chr(10) || text) AS display FROM m""")
def module_display(spark, sf_dir):
    return context_tree.module_display(context_tree.modules(_tree(spark, sf_dir)), V.AS_OF).withColumn("display", F.sha2("display", 256))


# Packages, with an architecture that is cut to its share

BUDGET = 4000
CUT = (BUDGET // 4 * 4 + len(scalar.TRUNCATED) + 3) // 4
PACKED = f"""{fill_sql(BUDGET, CUT, BUDGET - BUDGET // 4 + CUT)}, told AS (SELECT id, max(score) AS best, min_by(path, ord) AS path FROM scored GROUP BY id),
arch AS (SELECT repeat('a wide view ', 4000)[1:{BUDGET // 4 * 4}] || '{scalar.TRUNCATED}' AS a),
p AS (SELECT s.score, ord, told.path, c, CASE WHEN s.ty = 'module_summary' AND best > 0.4 THEN 'primary' WHEN s.ty = 'module_summary' THEN 'supporting' WHEN s.ty = 'execution_flow' THEN 'flows' WHEN s.ty = 'gotcha_entry' THEN 'gotchas' END AS section
  FROM f JOIN s USING (rn) JOIN told ON told.id = s.id JOIN firsts ON firsts.id = s.id WHERE status = 'selected'),
n AS (SELECT CAST({CUT} + coalesce(sum(t) FILTER (status = 'selected'), 0) AS BIGINT) AS tokens, count(*) FILTER (status = 'excluded') AS gone FROM f JOIN s USING (rn))"""


def _package(spark, sf_dir, form: str) -> DataFrame:
    scored = _scored(spark, sf_dir)
    s = rank.first_of_id(stored(rank.sized(scored), "sized"))  # scored once, read twice
    filled = stored(rank.fill_budget(s, BUDGET, ARCHITECTURE), "filled")
    return rank.package(rank.sections(filled, s), scored.select("id", "ord", "content"), form, rank.architecture_share(ARCHITECTURE, BUDGET), filled)


def _section_sql(section: str, title: str, counted: bool) -> str:
    rule = "repeat('─', 60)"
    head = f"'{title}' || ' (' || count(*) || ')'" if counted else f"'{title}'"
    row = "chr(10) || '### ' || path || chr(10) || c" if counted else "c"
    return f"(SELECT CASE WHEN count(*) > 0 THEN chr(10) || {rule} || chr(10) || {head} || chr(10) || {rule} || chr(10) || string_agg({row}, chr(10) ORDER BY score DESC, ord) ELSE '' END FROM p WHERE section = '{section}')"


@query(f"""{PACKED} SELECT '📦 Context Package — ' || tokens || ' tokens' || CASE WHEN gone > 0 THEN chr(10) || '⚠️  ' || gone || ' relevant artifacts excluded due to token budget' ELSE '' END || chr(10)
|| chr(10) || repeat('─', 60) || chr(10) || '🏛️  ARCHITECTURE OVERVIEW' || chr(10) || repeat('─', 60) || chr(10) || a || {_section_sql("primary", "📁 PRIMARY MODULES", True)} || {_section_sql("supporting", "📎 SUPPORTING CONTEXT", True)}
|| {_section_sql("flows", "🔄 EXECUTION FLOWS", False)} || {_section_sql("gotchas", "⚠️  GOTCHAS", False)} AS package FROM n, arch""")
def context_text(spark, sf_dir):
    return _package(spark, sf_dir, "text")


@query(f"""{PACKED}, q AS (SELECT 0 AS part, 0 AS score, 0 AS ord, '## Architecture Overview' || chr(10) || a AS x FROM arch UNION ALL SELECT 1, -score, ord, '## ' || path || chr(10) || c FROM p WHERE section = 'primary'
UNION ALL SELECT 2, -score, ord, '## ' || path || chr(10) || c FROM p WHERE section = 'supporting' UNION ALL SELECT 3, -score, ord, '## Key Flows' || chr(10) || c FROM p WHERE section = 'flows')
SELECT string_agg(x, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY part, score, ord) AS package FROM q""")
def context_compact(spark, sf_dir):
    return _package(spark, sf_dir, "compact")


def _list_sql(section: str, whole: bool) -> str:
    e = "json_object('path', path, 'content', c)" if whole else "to_json(c)"
    return f"(SELECT coalesce(list({e} ORDER BY score DESC, ord) FILTER (section = '{section}'), CAST([] AS JSON[])) FROM p)"


@query(f"""{PACKED} SELECT CAST(json_object('tokenCount', tokens, 'primary', {_list_sql("primary", True)}, 'supporting', {_list_sql("supporting", True)}, 'architecture', a, 'flows', {_list_sql("flows", False)}, 'gotchas', {_list_sql("gotchas", False)}, 'excludedCount', gone) AS VARCHAR) AS package FROM n, arch""")
def context_full_json(spark, sf_dir):
    return _package(spark, sf_dir, "json")
