"""Search and relevance ranking of artifacts, and packing of the best into a token budget.

artifacts: (id, ord, type, path, content, tags array<string>, generated_at).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions import scalar
from loam.sources.scratch import stored

# Weight of each type of artifact for each operation.
TYPES = ["module_summary", "execution_flow", "gotcha_entry", "architecture_overview", "architectural_decision", "feature_domain", "symbol_description"]
WEIGHTS = {
    "bug_fix": [0.9, 0.8, 1.0, 0.3, 0.4, 0.3, 0.7],
    "feature_add": [0.8, 0.6, 0.5, 0.9, 0.8, 0.7, 0.5],
    "refactor": [0.9, 0.7, 0.7, 0.7, 0.9, 0.6, 0.8],
    "test": [1.0, 0.7, 0.8, 0.3, 0.2, 0.4, 0.9],
    "explain": [0.8, 0.9, 0.7, 1.0, 0.8, 0.7, 0.6],
    "auto": [0.8, 0.6, 0.6, 0.5, 0.5, 0.5, 0.6],
}


def query_words(query: str) -> list[str]:
    return query.lower().split()


def _occurrences(text: Column, word: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return (F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)


def _either_way(word: str):
    return lambda tag: F.contains(tag, F.lit(word)) | F.contains(F.lit(word), tag)


def document_frequency(artifacts: DataFrame, words: list[str]) -> DataFrame:
    """One row (n, df0, df1, ...): how many artifacts there are and how many hold each word, in one aggregation."""
    text = F.lower(F.concat_ws(" ", F.coalesce("content", F.lit("")), F.coalesce("path", F.lit("")), F.array_join("tags", " ")))
    return artifacts.select(text.alias("t")).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.contains("t", F.lit(w))).alias(f"df{k}") for k, w in enumerate(words)])


def idf_table(artifacts: DataFrame, words: list[str]) -> DataFrame:
    """(keyword, df, idf) with idf = ln((n + 1) / (df + 1)) + 1."""
    one = document_frequency(artifacts, words)
    rows = F.explode(F.array(*[F.struct(F.lit(w).alias("keyword"), F.col(f"df{k}").alias("df")) for k, w in enumerate(words)])).alias("x")
    return one.select("n", rows).select(F.col("x.keyword").alias("keyword"), F.col("x.df").alias("df"), (F.log((F.col("n") + 1) / (F.col("x.df") + 1)) + 1).alias("idf"))


def search(artifacts: DataFrame, query: str, kind: str | None = None, limit: int | None = 10) -> DataFrame:
    """(ord, path, type, score, snippet) of the best artifacts. Word statistics are over all of them, whatever kind is asked for.

    The words are literals of the plan, so there is one scan for the statistics and one for the scores, and no join but
    that with the single row of statistics.
    """
    words = query_words(query)
    out = artifacts.where(F.lit(bool(words)))
    if kind and kind != "all":
        out = out.where(F.col("type") == kind)
    content, path = F.lower(F.coalesce("content", F.lit(""))), F.lower(F.coalesce("path", F.lit("")))
    out = out.select("*", content.alias("lc_"), path.alias("lp_"), F.transform("tags", F.lower).alias("lt_"), F.lower(scalar.title(F.coalesce("content", F.lit("")))).alias("title_"))
    out = out.join(F.broadcast(document_frequency(artifacts, words))) if words else out
    total, first = F.lit(0.0), F.lit(None).cast("int")
    for k, w in enumerate(words):
        idf = F.log((F.col("n") + 1) / (F.col(f"df{k}") + 1)) + 1
        hits = _occurrences(F.col("lc_"), w)
        name = F.when(~F.contains("lp_", F.lit(w)), 0.0).when(F.contains(scalar.base_name(F.col("lp_")), F.lit(w)), 2.5).otherwise(1.5)
        tags = F.least(F.size(F.filter("lt_", _either_way(w))) * 1.5, F.lit(3.0))
        head = F.when(F.contains("title_", F.lit(w)), 1.3).otherwise(0.0)
        tf = hits / (F.greatest(F.length("lc_"), F.lit(1)) / 1000.0)
        total = total + name + tags + head + F.when(hits > 0, F.least(tf * idf * 0.3, F.lit(2.0))).otherwise(0.0)
        first = F.coalesce(first, F.when(hits > 0, F.instr("lc_", w) - 1))
    raw = total / max(1, len(words))
    out = out.withColumn("raw_", raw).where("raw_ >= 0.1").select("ord", "path", "type", F.least(F.col("raw_") / 5, F.lit(1.0)).alias("score"), scalar.snippet(F.col("content"), first).alias("snippet"))
    return out if limit is None else out.orderBy(F.desc("score"), "ord").limit(limit)


def candidates(modules: DataFrame, overviews: DataFrame | None, use: str = "search") -> DataFrame:
    """What is ranked: modules and flows for a task, and for a search the architecture too. An architecture's text has a share of a task's budget of its own."""
    if overviews is None:
        return modules
    kinds = ["execution_flow"] if use == "task" else ["architecture_overview", "execution_flow"]
    return modules.unionByName(overviews.where(F.col("type").isin(kinds)).select(*modules.columns))


def preview(content: Column, form: str = "lines", snippet: Column | None = None) -> Column:
    """What is shown of a result: its first three lines, its first 800 characters (long), or the snippet, else 300 characters (short)."""
    if form == "lines":
        return F.array_join(F.slice(F.split(content, "\n", -1), 1, 3), "\n")
    if form == "long":
        return F.substring(content, 1, 800)
    start = F.substring(content, 1, 300)
    return start if snippet is None else F.when(snippet != "", snippet).otherwise(start)


def operation_weight(operation: Column, kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for op, row in WEIGHTS.items() for t, w in zip(TYPES, row, strict=True) for x in (f"{op}/{t}", w)])
    return F.coalesce(F.try_element_at(table, F.concat(operation, F.lit("/"), kind)), F.lit(0.5))


def relevance(artifacts: DataFrame, task: str, as_of: str, operation: str = "auto", targets: list[str] | None = None, near: DataFrame | None = None, degree: DataFrame | None = None) -> DataFrame:
    """(id, ord, type, path, score and its five factors) of every artifact.

    near (path, depth): hops from the target files; degree (path, in_degree). Both join by path.
    """
    op = scalar.operation(F.lit(task)) if operation == "auto" else F.lit(operation)
    a = artifacts
    a = a.join(near.select("path", "depth"), "path", "left") if near is not None else a.withColumn("depth", F.lit(None).cast("int"))
    a = a.join(degree.select("path", "in_degree"), "path", "left") if degree is not None else a.withColumn("in_degree", F.lit(None).cast("int"))
    words = F.concat("tags", scalar.keywords(F.col("path")), scalar.keywords(F.substring("content", 1, 500)))
    a = a.select("*", words.alias("words_"), scalar.keywords(F.lit(task)).alias("asked_"))  # columns of their own, as each is used more than once
    found, of = F.size(F.array_intersect("asked_", "words_")), F.greatest(F.size("asked_"), F.size("words_"))  # the task's words are distinct
    keyword = F.when((F.size("asked_") > 0) & (F.size("words_") > 0), found / of).otherwise(F.lit(0.0))
    if not targets:
        proximity = F.lit(0.3)
    else:
        proximity = F.when(F.coalesce("path", F.lit("")) == "", 0.3).when(F.col("depth").isNotNull(), F.greatest(F.lit(0.0), 1 - F.col("depth") * 0.3)).otherwise(0.05)
        about = F.lit(False)
        for t in targets:
            about = about | F.contains("path", F.lit(t)) | F.contains(F.lit(t), F.col("path"))
        proximity = F.when((F.coalesce("path", F.lit("")) != "") & about, 1.0).otherwise(proximity)
    central = F.when(F.col("in_degree").isNull(), 0.0).otherwise(F.least(F.col("in_degree") / 20, F.lit(0.3)))  # least() would pass over a null
    f = a.select("id", "ord", "type", "path", "content", keyword.alias("keyword"), proximity.alias("proximity"), operation_weight(op, F.col("type")).alias("operation"), scalar.recency(F.col("generated_at"), F.lit(as_of)).alias("recency"), central.alias("centrality"))
    return f.withColumn("score", 0.35 * F.col("keyword") + 0.30 * F.col("proximity") + 0.20 * F.col("operation") + 0.10 * F.col("recency") + 0.05 * F.col("centrality"))


def sized(scored: DataFrame) -> DataFrame:
    """(id, ord, type, path, score, tokens): all that a budget and its sections look at, without the contents."""
    return scored.select("id", "ord", "type", "path", "score", scalar.token_count(F.col("content")).alias("tokens"))


def first_of_id(scored: DataFrame) -> DataFrame:
    """Each row with type, path and content of the first artifact (by ord) of its id, as equal contents share an id.

    Of sized rows it tells the tokens in place of the content, and best, the highest score of the id.
    """
    small = "tokens" in scored.columns
    own, best = ["type", "path", "tokens" if small else "content"], [F.max("score").alias("best")] if small else []
    first = scored.groupBy("id").agg(F.min_by(F.struct(*own), "ord").alias("a_"), *best)
    return scored.drop(*own).join(first, "id").select("*", *[f"a_.{c}" for c in own]).drop("a_")


def architecture_share(text: str | None, budget: int) -> str | None:
    """An architecture's text as a package has it: cut to a quarter of the budget."""
    most = budget // 4 * 4
    return text if text is None or len(text) <= most else text[:most] + scalar.TRUNCATED


def fill_budget(scored: DataFrame, budget: int, architecture: str | None = None, chunk: int = 10_000) -> DataFrame:
    """(ord, score, id, tokens, status): selected or excluded, in order of score and ord; what comes after the budget is used up is neither. With type, path and best too, if first_of_id told them of sized rows.

    An architecture text comes first, cut to a quarter of the budget. The scan is sequential, but it looks only at rows
    that still fit: a chunk of the best of them at a time is taken to the driver, and what is selected there (one row for
    each token of the budget at most) tells all other rows apart by comparison, where they are.
    """
    used, limit = 0, budget
    if architecture is not None:
        used, quarter = -(-len(architecture_share(architecture, budget)) // 4), budget // 4
        if used > quarter:  # it was cut, and the mark of the cut is longer than what it replaces
            limit = budget - quarter + used
    told = ["type", "path", "best"] if "best" in scored.columns else []
    tokens = F.coalesce("tokens", F.lit(0)) if "tokens" in scored.columns else scalar.token_count(F.col("content"))
    rows = stored(scored.select("ord", "score", "id", tokens.alias("tokens"), *told), "scores")  # scored once, scanned often
    after = lambda score, ord_: (F.col("score") < score) | ((F.col("score") == score) & (F.col("ord") > ord_))
    chosen, last, stop = [], None, None
    if used >= budget:
        return rows.limit(0).withColumn("status", F.lit("excluded"))
    while stop is None:
        fit = rows.where((F.col("tokens") > 0) & (F.col("tokens") <= limit - used))
        best = (fit if last is None else fit.where(after(*last))).select("ord", "score", "tokens").orderBy(F.desc("score"), "ord").limit(chunk).collect()
        for r in best:
            last = (r["score"], r["ord"])
            if used + r["tokens"] <= limit:
                used += r["tokens"]
                chosen.append(last)
                if used >= budget:
                    stop = last
                    break
        if len(best) < chunk:
            break
    reached = rows if stop is None else rows.where(~after(*stop))
    picked = scored.sparkSession.createDataFrame(chosen, scored.select("score", "ord").schema).withColumn("took", F.lit(True))
    status = F.when(F.coalesce("took", F.col("tokens") == 0), "selected").otherwise("excluded")
    return reached.join(F.broadcast(picked), ["score", "ord"], "left").select("ord", "score", "id", "tokens", *told, status.alias("status"))


def sections(filled: DataFrame, scored: DataFrame) -> DataFrame:
    """Selected rows with their section; types that no section shows have none. An id counts by its best score."""
    chosen, s = filled.where("status = 'selected'"), F.col("type")
    if "best" not in filled.columns:
        chosen = chosen.join(scored.groupBy("id").agg(F.max("score").alias("best"), F.min_by("type", "ord").alias("type"), F.min_by("path", "ord").alias("path")), "id")
    section = F.when((s == "module_summary") & (F.col("best") > 0.4), "primary").when(s == "module_summary", "supporting").when(s == "execution_flow", "flows").when(s == "gotcha_entry", "gotchas")
    return chosen.select("ord", "score", "id", "path", "type", section.alias("section"))


# Headings of a package's text form.
RULE = "─" * 60
HEADINGS = {"architecture": "🏛️  ARCHITECTURE OVERVIEW", "primary": "📁 PRIMARY MODULES", "supporting": "📎 SUPPORTING CONTEXT", "flows": "🔄 EXECUTION FLOWS", "gotchas": "⚠️  GOTCHAS"}


def package_counts(filled: DataFrame, architecture: str | None = None) -> DataFrame:
    """One row (token_count, excluded) of a filled budget: tokens of what was selected and of the architecture's share, and how many rows didn't fit."""
    own = 0 if architecture is None else -(-len(architecture) // 4)
    chosen = F.sum(F.when(F.col("status") == "selected", F.col("tokens")))
    return filled.agg((F.coalesce(chosen, F.lit(0)) + own).cast("long").alias("token_count"), F.count_if(F.col("status") == "excluded").alias("excluded"))


def package(sectioned: DataFrame, contents: DataFrame, form: str = "json", architecture: str | None = None, filled: DataFrame | None = None, resolved_ms: int | None = None) -> DataFrame:
    """One row of text of the whole package: json, compact or text. contents: (id, content), and ord where the first of an id by it counts; architecture: its share.

    With filled (what fill_budget returned) json and text also tell the tokens and how many artifacts were left out; which
    ones is in filled, as their list can be as long as the table. resolved_ms, how long it took, is told if given. The
    compact form has no gotchas. An empty selection gives a row too.
    """
    rows = stored(sectioned.where("section is not null"), "sectioned")  # its size is known then: few rows are broadcast below the aggregate, so other contents are not dealt out
    content = F.min_by("content", "ord") if "ord" in contents.columns else F.first("content")
    shown = contents.groupBy("id").agg(content.alias("content")).join(rows.select("id"), "id", "left_semi")
    rows = rows.join(shown, "id")
    of = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col("section") == s, F.struct((-F.col("score")).alias("s"), "ord", "path", "content")))), lambda x: F.struct(x["path"].alias("path"), x["content"].alias("content")))
    one = rows.agg(*[of(s).alias(s) for s in ("primary", "supporting", "flows", "gotchas")])
    if filled is not None and form != "compact":
        one = one.crossJoin(F.broadcast(package_counts(filled, architecture)))  # one row each
    no_text = F.array().cast("array<string>")
    if form == "json":
        only = lambda c: F.transform(c, lambda x: x["content"]).alias(c)
        told = [] if filled is None else [F.col("token_count").alias("tokenCount"), *([] if resolved_ms is None else [F.lit(resolved_ms).alias("resolvedIn")])]
        left = [] if filled is None else [F.col("excluded").alias("excludedCount")]
        return one.select(F.to_json(F.struct(*told, "primary", "supporting", F.lit(architecture).alias("architecture"), only("flows"), only("gotchas"), *left)).alias("package"))
    if form == "compact":
        parts = F.concat(
            F.array(F.lit("## Architecture Overview\n" + architecture)) if architecture else no_text,
            F.transform(F.concat("primary", "supporting"), lambda x: F.concat(F.lit("## "), x["path"], F.lit("\n"), x["content"])),
            F.transform("flows", lambda x: F.concat(F.lit("## Key Flows\n"), x["content"])),
        )
        return one.select(F.array_join(parts, "\n\n---\n\n").alias("package"))
    rule = F.lit(RULE)

    def titled(c: str, counted: bool) -> Column:
        head = F.concat(F.lit(f"{HEADINGS[c]} ("), F.size(c).cast("string"), F.lit(")")) if counted else F.lit(HEADINGS[c])
        body = F.transform(c, lambda x: F.concat(F.lit("\n### "), x["path"], F.lit("\n"), x["content"]) if counted else x["content"])
        return F.when(F.size(c) > 0, F.concat(F.array(rule, head, rule), body)).otherwise(no_text)

    top = no_text
    if filled is not None:
        took = "" if resolved_ms is None else f" (resolved in {resolved_ms}ms)"
        first = F.array(F.concat(F.lit("📦 Context Package — "), F.col("token_count").cast("string"), F.lit(" tokens" + took)))
        left = F.when(F.col("excluded") > 0, F.array(F.concat(F.lit("⚠️  "), F.col("excluded").cast("string"), F.lit(" relevant artifacts excluded due to token budget")))).otherwise(no_text)
        top = F.concat(first, left, F.array(F.lit("")))
    overview = F.array(rule, F.lit(HEADINGS["architecture"]), rule, F.lit(architecture)) if architecture else no_text
    return one.select(F.array_join(F.concat(top, overview, titled("primary", True), titled("supporting", True), titled("flows", False), titled("gotchas", False)), "\n").alias("package"))


def first_summaries(modules: DataFrame, k: int = 5) -> DataFrame:
    """(module_group, context): of each group's first k paths the summaries that exist; modules (path, content, null if none)."""
    g = modules.withColumn("g", scalar.module_group(F.col("path")))
    r = g.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("path"))).where(F.col("rn") <= k)
    texts = F.transform(F.array_sort(F.collect_list(F.when(F.col("content").isNotNull(), F.struct("rn", "content")))), lambda x: x["content"])
    return r.groupBy(F.col("g").alias("module_group")).agg(F.array_join(texts, "\n\n").alias("context"))
