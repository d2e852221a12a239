"""Texts about a whole repository: architecture, execution flows and a short primer.

Each prompt is a one-row table. What goes into it is bounded: texts of groups are taken in order only as far as the
prompt has room for them, so a repository of any size makes a prompt of the same size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.functions import scalar

from . import graph, rank

# Tokens of the answer, temperature, tokens of the summaries in the prompt.
ARCHITECTURE = (2500, 0.2, 6000)
FLOWS = (2000, 0.2, 5000)
PRIMER = (700, 0.1, 2000)
TOP_MODULES = 15
LISTED_MODULES = 10
RULE = "\n\n---\n\n"


def _joined(rows: DataFrame, order: str, text: str, sep: str = RULE) -> DataFrame:
    """One row (joined): texts in order. rows is bounded by its caller; no rows give an empty text."""
    told = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return rows.agg(F.array_join(F.transform(told, lambda x: x["t"]), sep).alias("joined"))


def domains(modules: DataFrame, tokens: int = ARCHITECTURE[2]) -> DataFrame:
    """One row (joined): the summaries of each module group, in order of their names, cut to so many tokens.

    modules: (path, content, null if it has no summary). A group without summaries is left out. A section is longer
    than 20 characters, so of tokens / 5 groups more are left than fit.
    """
    room = tokens * 4
    g = rank.first_summaries(modules).where("context <> ''").orderBy("module_group").limit(room // 20 + 1)
    section = F.concat(F.lit("### Domain: "), "module_group", F.lit("\n"), F.substring("context", 1, room + 1))
    return _joined(g.select("module_group", section.alias("section")), "module_group", "section").select(scalar.truncate_to_tokens(F.col("joined"), tokens).alias("joined"))


def architecture_prompt(repository: str, nodes: DataFrame, edges: DataFrame, modules: DataFrame) -> DataFrame:
    """One row (path = '', prompt). nodes: (id, path, language); modules as in domains()."""
    facts = nodes.agg(F.array_join(F.array_sort(F.collect_set("language")), ", ").alias("languages"), F.count(F.lit(1)).alias("n"))
    one = facts.join(F.broadcast(domains(modules))).join(F.broadcast(graph.summary(nodes, edges)))  # one row each
    parts = [
        F.lit("Describe the architecture of this repository: purpose, subsystems, data flow, technology, decisions, points of extension."),
        F.concat(F.lit(f"Repository: {repository}\nLanguages: "), "languages", F.lit("\nModules: "), F.col("n").cast("string")),
        F.col("summary"), F.col("joined"),
    ]
    return one.select(F.lit("").alias("path"), F.concat_ws("\n\n", *parts).alias("prompt"))


def top_modules(nodes: DataFrame, edges: DataFrame, exports: DataFrame, k: int = TOP_MODULES) -> DataFrame:
    """(rank, path, line): the k most imported modules, each with its first five exported names; exports: (path, line, name)."""
    top = graph.top_modules(nodes, edges, k).join(nodes.select("id", "path"), "id")
    near = exports.join(F.broadcast(top.select("path")), "path", "left_semi").groupBy("path").agg(F.slice(F.array_sort(F.collect_list(F.struct("line", "name"))), 1, 5).alias("five"))
    line = F.concat(F.lit("- "), "path", F.lit(" ("), F.coalesce(F.array_join(F.transform("five", lambda x: x["name"]), ", "), F.lit("")), F.lit(")"))
    order = F.struct((-F.col("weight")).alias("w"), "id")
    return top.join(near, "path", "left").select(order.alias("rank"), "path", line.alias("line"))


def flows_prompt(repository: str, nodes: DataFrame, edges: DataFrame, exports: DataFrame, modules: DataFrame) -> DataFrame:
    """One row (path = '', prompt): the most central modules and the summaries that they have."""
    top = top_modules(nodes, edges, exports)
    listed = _joined(top.orderBy("rank").limit(LISTED_MODULES), "rank", "line", "\n").select(F.col("joined").alias("listed"))
    told = modules.where("content <> ''").join(F.broadcast(top), "path")
    one = _joined(told, "rank", "content").join(F.broadcast(listed))  # one row each
    parts = [F.lit("Describe the three to five main execution flows: trigger, steps from module to module, key functions, notes."), F.concat(F.lit(f"Repository: {repository}\n"), "listed"), scalar.truncate_to_tokens(F.col("joined"), FLOWS[2])]
    return one.select(F.lit("").alias("path"), F.concat_ws("\n\n", *parts).alias("prompt"))


def primer_prompt(repository: str, nodes: DataFrame, architecture: DataFrame, most: int = PRIMER[2] * 4) -> DataFrame:
    """One row (path = '', prompt): names of the module groups and the architecture's text (content), cut."""
    names = nodes.select(scalar.module_group(F.col("path")).alias("g")).distinct().orderBy("g").limit(most)
    one = architecture.select(scalar.truncate_to_tokens(F.col("content"), PRIMER[2]).alias("text")).join(F.broadcast(_joined(names, "g", "g", ", ")))  # one row each
    parts = [F.lit("Introduce this repository in under 500 tokens: what it is, its subsystems in a line each, what to watch out for."), F.concat(F.lit(f"Repository: {repository}\nModule groups: "), "joined"), F.col("text")]
    return one.select(F.lit("").alias("path"), F.concat_ws("\n\n", *parts).alias("prompt"))


def primer(repository: str, answer: DataFrame, as_of: str) -> DataFrame:
    """One row (content): a primer with its heading and time of building."""
    head, foot = f"# {repository}: context primer\n\n", f"\n\n---\n*Built: {as_of}*\n"
    return answer.select(F.concat(F.lit(head), F.coalesce("content", F.lit("")), F.lit(foot)).alias("content"))
