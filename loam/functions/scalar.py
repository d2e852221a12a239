"""Column functions on paths, texts and times; all of built-in expressions.

Word boundaries are spelled with ASCII look-around and trimming with a character class, because Java's own `\\b` and
trim() treat non-ASCII letters and tabs differently from the patterns' origin.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
LANGUAGE_OF = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "rs": "rust", "go": "go",
    "java": "java", "rb": "ruby", "kt": "kotlin", "swift": "swift", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "c": "c", "h": "c", "cs": "csharp", "php": "php",
    "sh": "shell", "md": "markdown", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "html": "html", "htm": "html", "mdx": "mdx",
}
NOT_SOURCE = ("shell", "yaml", "toml", "unknown")
STOP_WORDS = "the and for this that with from have are was were been will would could should what when where which who how into onto then than them they their there here".split()
OPERATION_WORDS = [
    ("bug_fix", "fix bug error crash broken wrong incorrect fail".split()),
    ("feature_add", "add implement create build feature new".split()),
    ("refactor", "refactor rename move restructure reorganize clean".split()),
    ("test", "test spec coverage unit integration".split()),
    ("explain", "explain understand what how why describe".split()),
]
GROUP_ROOTS = ("lib", "pkg", "internal", "api", "core", "utils", "services", "components", "modules")
TRUNCATED = "\n\n[...truncated to fit token budget...]"
SPACE = r"[\s\x{00a0}\x{feff}\x{2028}\x{2029}]"


def trim_space(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def path_id(path: Column) -> Column:
    """Hash id of a path, whichever way its separators lean."""
    return F.sha2(F.translate(path, "\\", "/"), 256)


def token_count(text: Column) -> Column:
    """Tokens by the rule of four characters each; null counts as none."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def truncate_to_tokens(text: Column, tokens: int | Column) -> Column:
    """The text if it fits, else its start and a note (which comes on top of the limit)."""
    limit = (F.lit(tokens) if isinstance(tokens, int) else tokens) * 4
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, F.lit(1), limit.cast("int")), F.lit(TRUNCATED)))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-cased extension without its dot; a leading dot begins a name, not an extension."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+\.([^.]*)$", 1))


def language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LANGUAGE_OF.items() for x in pair])
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit("unknown"))


def is_source(lang: Column) -> Column:
    return ~lang.isin(*NOT_SOURCE)


def keywords(text: Column) -> Column:
    """Distinct words of four characters or more that are no stop words, in order of first use."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\s_-]", " "), r"\s+")
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 3) & ~F.array_contains(stop, w)))


def keyword_overlap(a: Column, b: Column) -> Column:
    """Share of a found in b, of the larger size; b's repeats count in its size. 0 if either is empty."""
    both = F.when(F.size(F.array_distinct(a)) == F.size(a), F.size(F.array_intersect(a, b))).otherwise(F.size(F.filter(a, lambda x: F.array_contains(b, x))))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / F.greatest(F.size(a), F.size(b))).otherwise(F.lit(0.0))


def operation(task: Column) -> Column:
    """What kind of work a task's words name; the first kind in precedence wins, else auto."""
    text = F.lower(F.coalesce(task, F.lit("")))
    out = F.lit("auto")
    for name, words in reversed(OPERATION_WORDS):
        out = F.when(text.rlike(r"(?<![A-Za-z0-9_])(" + "|".join(words) + r")(?![A-Za-z0-9_])"), name).otherwise(out)
    return out


def module_group(path: Column) -> Column:
    """The segment after the first `src`, else the first directory (of well-known roots, what follows), else root."""
    parts = F.split(path, "/")
    at = F.array_position(parts, "src").cast("int")
    after = F.get(parts, at)
    top = F.get(parts, F.lit(0))
    return (
        F.when((at > 0) & (F.coalesce(after, F.lit("")) != ""), after)
        .when(top.isin(*GROUP_ROOTS), F.coalesce(F.get(parts, F.lit(1)), top))
        .when(F.size(parts) >= 2, top)
        .otherwise(F.lit("root"))
    )


def normal_path(path: Column) -> Column:
    """A relative path without `.` and with `..` resolved; what would climb above the root stays there as `..`."""
    empty = F.array().cast("array<string>")

    def step(acc: Column, part: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        return (
            F.when((part == "") | (part == "."), acc)
            .when((part == "..") & (F.size(acc) > 0) & (last != ".."), F.slice(acc, F.lit(1), F.size(acc) - 1))
            .otherwise(F.concat(acc, F.array(part)))
        )

    return F.array_join(F.aggregate(F.split(path, "/"), empty, step), "/")


def resolve_import(source: Column, path: Column) -> Column:
    """Path an import names, relative to the root; null unless it begins with a dot or a slash.

    One that begins with a slash is absolute on the file system, so it lies outside: relative to the root it is reached by
    parent steps, which match no file.
    """
    folder = F.regexp_replace(path, r"[^/]*$", "")
    return F.when(source.startswith("."), normal_path(F.concat(folder, source))).when(source.startswith("/"), F.concat(F.lit(".."), normal_path(source)))


def duration(ms: Column) -> Column:
    """Seconds as toFixed(1) has them: the tenth nearest to the double's exact value, the larger one of two."""
    ms = ms.cast("long")
    d = ms / 1000
    above = (d * 16 - ms / 50) + d * 4 >= 0  # on a decimal half each step is exact, so this is the sign of d - ms / 1000
    tenths = F.floor(ms / 100) + F.when((ms % 100 > 50) | ((ms % 100 == 50) & above), 1).otherwise(0)
    return (
        F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms")))
        .when(ms < 60000, F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("s")))
        .otherwise(F.concat(F.floor(ms / 60000).cast("string"), F.lit("m "), F.floor((ms % 60000) / 1000).cast("string"), F.lit("s")))
    )


def age(ts: Column, as_of: Column) -> Column:
    minutes = F.floor((F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(ts.cast("timestamp"))) / 60)
    return (
        F.when(minutes < 1, F.lit("just now"))
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago")))
        .when(minutes < 1440, F.concat(F.floor(minutes / 60).cast("string"), F.lit("h ago")))
        .otherwise(F.concat(F.floor(minutes / 1440).cast("string"), F.lit("d ago")))
    )


def age_hours(ts: Column, as_of: Column) -> Column:
    return (F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(ts.cast("timestamp"))) / 3600.0


def recency(ts: Column, as_of: Column) -> Column:
    """Decays to 1/e within a week."""
    return F.exp(-age_hours(ts, as_of) / 168.0)


def tokens_text(n: Column) -> Column:
    return (
        F.when(n >= 1_000_000, F.concat(F.format_string("%.1f", n / 1_000_000.0), F.lit("M tokens")))
        .when(n >= 1000, F.concat(F.format_string("%.1f", n / 1000.0), F.lit("K tokens")))
        .otherwise(F.concat(n.cast("string"), F.lit(" tokens")))
    )


def cost_text(usd: Column, provider: str = "openai") -> Column:
    if provider in ("ollama", "nvidia_nim"):
        return F.lit("Free (local)")
    return F.when(usd == 0, F.lit("$0.00")).when(usd < 0.01, F.lit("< $0.01")).otherwise(F.concat(F.lit("$"), F.format_string("%.3f", usd)))


def branch_name(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"[^a-zA-Z0-9_-]", "-"))


def title(content: Column) -> Column:
    """The first heading, else the first line."""
    heading = F.regexp_extract(content, r"(?m)^#+ (.+)", 1)
    return F.when(heading != "", heading).otherwise(F.get(F.split(content, "\n"), F.lit(0)))


def snippet(content: Column, at: Column, radius: int = 150, opening: int = 250) -> Column:
    """Text around a 0-based position, or the opening where there is none (null or negative)."""
    start = F.greatest(at - radius, F.lit(0))
    end = F.least(F.length(content), at + radius)
    flat = lambda c: trim_space(F.regexp_replace(c, r"\n+", " "))
    around = F.concat(F.when(start > 0, "…").otherwise(""), flat(F.substring(content, start + 1, end - start)), F.when(end < F.length(content), "…").otherwise(""))
    front = F.concat(flat(F.substring(content, 1, opening)), F.when(F.length(content) > opening, "…").otherwise(""))
    return F.when(at >= 0, around).otherwise(front)


def build_ms(files: Column) -> Column:
    return F.ceil(files / 8) * 2500


def link_target(raw: Column) -> Column:
    """A link without its fragment, percent-decoded where that is possible."""
    bare = F.get(F.split(raw, "#"), F.lit(0))
    return F.coalesce(F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))), bare)


def parsed_json(text: Column, schema: str) -> Column:
    """A JSON document, bare or within code fences."""
    return F.from_json(F.regexp_replace(text, r"^\s*```(?:json)?\s*|\s*```\s*$", ""), schema)


def short_id(h: Column) -> Column:
    return F.substring(h, 1, 8)
