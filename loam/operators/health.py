"""Health score of a graph, and the cost model of building summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions import scalar

# Price of 1000 tokens in and out.
PRICES = {"openai": (0.00015, 0.00060), "groq": (0.00006, 0.00008), "nvidia_nim": (0.0, 0.0), "ollama": (0.0, 0.0), "custom": (0.0, 0.0)}
ENTRY_POINT = r"(index|main|app|cli)\.(ts|js|go|py)$"
LARGE = 20000


def half_up(x: Column) -> Column:
    """Rounded to a whole number, halves upwards."""
    return F.floor(x + 0.5)


def score(nodes: DataFrame) -> DataFrame:
    """One row (score, grade, isolated, cycles, large, coupling, high); nodes: (path, in_degree, out_degree, mutual, size, high_issues)."""
    n = F.count(F.lit(1))
    isolated = F.count_if((F.col("in_degree") == 0) & ~F.col("path").rlike(ENTRY_POINT))
    a = nodes.agg(
        n.alias("n"), isolated.alias("isolated"), (F.count_if("mutual") / 2).alias("cycles"), F.count_if(F.col("size") > LARGE).alias("large"),
        F.coalesce(F.sum("out_degree") / n, F.lit(0.0)).alias("coupling"), F.coalesce(F.sum("high_issues"), F.lit(0)).alias("high"),
    )
    dead = F.coalesce(F.try_divide(F.col("isolated") * 100.0, F.col("n")), F.lit(0.0))
    least = lambda cap, x: F.least(F.lit(float(cap)), x.cast("double"))
    total = 100 - least(20, dead) - least(20, F.col("cycles") * 5) - least(15, F.col("large") * 3) - least(15, F.greatest(F.lit(0.0), F.col("coupling") - 3) * 2) - least(20, F.col("high") * 5)
    s = F.when(F.col("n") == 0, F.lit(0)).otherwise(F.greatest(F.lit(0), half_up(total))).cast("long")
    grade = F.when(F.col("score") >= 90, "A").when(F.col("score") >= 80, "B").when(F.col("score") >= 70, "C").when(F.col("score") >= 60, "D").otherwise("F")
    return a.withColumn("score", s).withColumn("grade", grade)


def issues(scored: DataFrame) -> DataFrame:
    """The score's row with the texts of what it found."""
    dead = F.coalesce(F.try_divide(F.col("isolated") * 100.0, F.col("n")), F.lit(0.0))
    one = lambda x: F.format_string("%.1f", x)
    half = F.when(F.col("cycles") == F.floor("cycles"), F.col("cycles").cast("long").cast("string")).otherwise(one(F.col("cycles")))
    texts = F.array(
        F.when(F.col("n") == 0, "No files found"),
        F.when(dead >= 5, F.concat(F.lit("High amount of isolated files ("), one(dead), F.lit("%)"))),
        F.when(F.col("cycles") > 0, F.concat(half, F.lit(" circular dependencies detected"))),
        F.when(F.col("large") > 0, F.concat(F.col("large").cast("string"), F.lit(" excessively large files (God objects)"))),
        F.when(F.col("coupling") > 3, F.concat(F.lit("High average coupling ("), one(F.col("coupling")), F.lit(" imports per file)"))),
        F.when(F.col("high") > 0, F.concat(F.col("high").cast("string"), F.lit(" high-severity security issues"))),
    )
    return scored.withColumn("issues", F.array_compact(texts))


def cost(files: DataFrame, tokens_per_module: int = 2000, provider: str = "openai") -> DataFrame:
    """files (n): token and price estimates of a full and an incremental build, and of what a session saves."""
    p_in, p_out = PRICES[provider]
    n = F.col("n")
    out = tokens_per_module * 0.6
    f = files.select(
        "n", (n * 800 + 8000).cast("double").alias("full_in"), (n * out + 4000).alias("full_out"), F.ceil(n * 0.05).alias("changed"), (n * 1800).cast("double").alias("session_raw")
    )
    f = f.withColumn("incremental_in", (F.col("changed") * 800 + 1000).cast("double")).withColumn("incremental_out", F.col("changed") * out)
    price = lambda kind: F.col(f"{kind}_in") / 1000 * p_in + F.col(f"{kind}_out") / 1000 * p_out
    f = f.withColumn("full_cost", price("full")).withColumn("incremental_cost", price("incremental"))
    f = f.withColumn("reduction_pct", half_up((1 - F.try_divide(F.lit(5000.0), F.col("session_raw"))) * 100))
    saved = (F.col("session_raw") - 5000) / 1000 * p_in
    even = F.when((n > 10) & (saved > 0), F.col("full_cost") / F.nullif(saved, F.lit(0.0)))
    return f.withColumn("break_even", even).withColumn("full_ms", F.ceil(n / 8) * 2500)


def build_stats(files: DataFrame) -> DataFrame:
    """One row of build statistics; files: (path, language, tokens, rebuilt, issues, patterns)."""
    return files.agg(
        F.count(F.lit(1)).alias("total_files"), F.countDistinct("language").alias("languages"), F.sum("tokens").alias("tokens"), F.count_if("rebuilt").alias("rebuilt"),
        F.sum("issues").alias("security_issues"), F.sum("patterns").alias("patterns"),
    )


def estimated_savings(total_files: Column) -> Column:
    return half_up(total_files * 1800 * 0.75)


def doctor(artifacts: DataFrame, root: str, has_config: bool, provider: tuple[bool, str], has_primer: bool, has_key: bool) -> DataFrame:
    """(ord, label, ok, message): seven checks of an installation. artifacts: (type, content), read once for all checks."""
    of = lambda kind, c: F.max(F.when(F.col("type") == kind, c))
    a = artifacts.agg(F.count_if(F.col("type") == "module_summary").alias("modules"), of("architecture_overview", scalar.token_count(F.col("content"))).alias("arch"))
    rebuild = F.lit("build first")
    checks = [
        ("root", F.lit(True), F.lit(root)),
        ("configuration", F.lit(has_config), F.lit("readable" if has_config else "missing")),
        ("provider", F.lit(provider[0]), F.lit(provider[1])),
        ("modules", F.col("modules") > 0, F.when(F.col("modules") > 0, F.concat(F.col("modules").cast("string"), F.lit(" modules"))).otherwise(rebuild)),
        ("architecture", F.col("arch").isNotNull(), F.coalesce(F.concat(F.col("arch").cast("string"), F.lit(" tokens")), rebuild)),
        ("primer", F.lit(has_primer), F.lit("present") if has_primer else rebuild),
        ("key", F.lit(has_key), F.lit("set" if has_key else "missing")),
    ]
    rows = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(label).alias("label"), ok.alias("ok"), message.alias("message")) for k, (label, ok, message) in enumerate(checks)])
    return a.select(F.explode(rows).alias("x")).select("x.*")
