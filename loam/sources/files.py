"""Scanning source files: listing, exclusion, content; and artifact tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions import scalar

# Fixed values.
EXCLUDED_FOLDERS = "node_modules .git dist build out target .next .nuxt __pycache__ .venv venv .ctx coverage".split()
EXCLUDED_FILES = ["*.pyc", "*.min.js", "*.min.css", "*.bundle.js", "package-lock.json", "yarn.lock", "pnpm-lock.yaml"]
DEFAULT_EXCLUDES = [f"**/{d}/**" for d in EXCLUDED_FOLDERS] + [f"**/{f}" for f in EXCLUDED_FILES]
MAX_SIZE = 500 * 1024


def glob_regex(pattern: str) -> str:
    """A regular expression for a whole path: ** over folders, * and ? within one, {a,b} and [..] as in shells."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            body = pattern[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[:1] in "!^" else body).replace("\\", "\\\\") + "]", end + 1
        elif c == "{" and "}" in pattern[i:]:
            end = pattern.index("}", i)
            out, i = out + "(?:" + "|".join(glob_regex(x)[1:-1] for x in pattern[i + 1 : end].split(",")) + ")", end + 1
        else:
            out, i = out + re.escape(c), i + 1
    return f"^{out}$"


def excluded(path: Column, patterns: list[str]) -> Column:
    """Whether any glob takes the path; one expression for all."""
    return path.rlike("|".join(f"(?:{glob_regex(p)})" for p in patterns)) if patterns else F.lit(False)


def ignore_rules(text: str) -> list[tuple[bool, str]]:
    """(is ignored, regex) of each line of an ignore file, in order; a pattern without an inner slash matches at any depth."""
    rules = []
    for raw in text.splitlines():
        line = raw.rstrip()
        if not line or line.startswith("#"):
            continue
        keep = line.startswith("!")
        line = line[1:] if keep else line[1:] if line.startswith("\\") else line
        folder = line.endswith("/")
        line = line.rstrip("/")
        anchored = "/" in line
        body = glob_regex(line.lstrip("/"))[1:-1]
        rules.append((not keep, "^" + ("" if anchored else "(?:.*/)?") + body + ("/.*$" if folder else "(?:/.*)?$")))
    return rules


def ignored(path: Column, rules: list[tuple[bool, str]]) -> Column:
    """The last rule that matches decides; what lies in an ignored folder can't be taken back in."""
    out = F.lit(False)
    for is_ignored, rx in rules:
        if is_ignored:
            out = out | path.rlike(rx)
        else:
            parents = [r for i, r in rules if i and r.endswith("/.*$")]
            stuck = F.lit(False)
            for r in parents:
                stuck = stuck | path.rlike(r)
            out = out & ~(path.rlike(rx) & ~stuck)
    return out


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, absolute_path, size) of all files under a folder, hidden ones left out; contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.col("path").alias("absolute_path"), F.col("length").alias("size"))
    cut = len(re.sub(r"^\w+:/*", "/", root).rstrip("/")) + 2
    f = f.select(F.substring(F.regexp_replace("absolute_path", r"^\w+:/*", "/"), cut, 1_000_000).alias("path"), "absolute_path", "size")
    return f.where(~F.col("path").rlike(r"(^|/)\."))


def scan(found: DataFrame, extra_excludes: list[str] | None = None, ignore_text: str = "", languages=scalar) -> DataFrame:
    """(path, ..., language) of the source files of a listing (path, size, ...): not excluded or ignored, of a known language, not empty or too large.

    languages: what tells a path's language and whether it is source (language, is_source), such as a registry of parsers.
    """
    p = F.col("path")
    f = found.where((F.col("size") > 0) & (F.col("size") <= MAX_SIZE) & ~excluded(p, DEFAULT_EXCLUDES + (extra_excludes or [])))
    if ignore_text:
        f = f.where(~ignored(p, ignore_rules(ignore_text)))
    return f.withColumn("language", languages.language(p)).where(languages.is_source(F.col("language")))


def contents(spark: SparkSession, root: str, scanned: DataFrame) -> DataFrame:
    """scanned with content and hash; a file that can't be read gets null ones. Files that no scan takes, by size, are not opened."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where((F.col("length") > 0) & (F.col("length") <= MAX_SIZE))
    raw = raw.select(F.col("path").alias("absolute_path"), "content")
    text = F.decode("content", "UTF-8")
    return scanned.join(raw, "absolute_path", "left").withColumn("hash", F.sha2("content", 256)).withColumn("content", text)


def language_counts(scanned: DataFrame) -> DataFrame:
    return scanned.groupBy("language").agg(F.count(F.lit(1)).alias("files"))


def write_artifacts(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """Artifacts in order of their module id; rows without content or metadata are left out."""
    return spark.read.parquet(path).where("content is not null and id is not null")
