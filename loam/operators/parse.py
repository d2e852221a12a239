"""Imports, symbols, findings and patterns of source files: files (path, language, content).

Each language is a set of built-in expressions on lines or whole texts, chosen by a file's language where the file is read,
so contents are scanned once and never by Python.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.scalar import SPACE, link_target, resolve_import, trim_space
from loam.operators.registry import Registry

Q = "['\"]"
W = r"\w+"


def lines(files: DataFrame) -> DataFrame:
    """(path, language, line, raw, text): numbered lines, raw and trimmed."""
    x = files.select("path", "language", F.posexplode(F.split("content", "\n")).alias("pos", "raw"))
    return x.select("path", "language", (F.col("pos") + 1).alias("line"), "raw", trim_space(F.col("raw")).alias("text"))


def _import(pos: Column, source: Column, symbols: Column | None = None, type_only: Column | None = None, dynamic: bool = False, external: Column | None = None, here: bool = False, flavour: int = 0, once: bool = True) -> Column:
    """One import; flavour: its place among the passes over a file; once: only the first of a source counts in a pass; here: it may name a file."""
    return F.struct(
        F.lit(flavour).alias("flavour"), pos.cast("int").alias("pos"), source.alias("source"), F.lit(once).alias("once"), (symbols if symbols is not None else F.array().cast("array<string>")).alias("symbols"),
        (type_only if type_only is not None else F.lit(False)).alias("is_type_only"), F.lit(dynamic).alias("is_dynamic"), (external if external is not None else F.lit(True)).alias("is_external"),
        F.lit(here).alias("here"),
    )


IMPORT_FIELDS = ["flavour", "pos", "source", "once", "symbols", "is_type_only", "is_dynamic", "is_external", "here"]
SYMBOL_FIELDS = ["line", "name", "kind", "signature", "is_exported"]


def _local(s: Column) -> Column:
    return s.startswith(".") | s.startswith("/")


def _names(raw: Column) -> Column:
    """Names of a comma-separated list, renamed ones by their own."""
    return F.filter(F.transform(F.split(raw, ","), lambda n: trim_space(F.regexp_replace(trim_space(n), r"\s+as\s+[\s\S]*$", ""))), lambda n: n != "")


def _matches(pattern: str, build) -> Column:
    """build(match, its number) of all matches of a pattern in the content; those for which it gives null are left out."""
    return F.filter(F.transform(F.regexp_extract_all("content", F.lit("(" + pattern + ")"), 1), build), lambda x: x.isNotNull())


def _lines(build) -> Column:
    """build(trimmed line, its number from 0) of all lines of the content; those for which it gives null are left out."""
    return F.filter(F.transform(F.transform(F.split("content", "\n"), trim_space), build), lambda x: x.isNotNull())


def _each(files: DataFrame, found: Column) -> DataFrame:
    """(path, x): the elements of an array. An outer explode, as a plain one has the array computed again for a filter on its size."""
    return files.select("path", F.explode_outer(found).alias("x")).where("x is not null")


def script_imports() -> Column:
    """Named, default and dynamic imports, in this order of passes; other forms are not seen."""
    src = lambda m: F.regexp_extract(m, rf"{Q}([^'\"]+){Q}\s*\)?$", 1)
    typed = lambda m: m.rlike(r"^import\s+type\s")
    name = lambda m: F.array(F.regexp_extract(m, rf"^import\s+(?:type\s+)?({W})\s+from", 1))
    return F.concat(
        _matches(rf"import\s+(?:type\s+)?\{{[^}}]*\}}\s+from\s+{Q}[^'\"]+{Q}", lambda m, i: _import(i, src(m), _names(F.regexp_extract(m, r"\{([^}]*)\}", 1)), typed(m), external=~_local(src(m)), here=True)),
        _matches(rf"import\s+(?:type\s+)?{W}\s+from\s+{Q}[^'\"]+{Q}", lambda m, i: _import(i, src(m), name(m), typed(m) & ~m.rlike(r"^import\s+type\s+from\s"), external=~_local(src(m)), here=True, flavour=1)),
        _matches(rf"import\s*\(\s*{Q}[^'\"]+{Q}\s*\)", lambda m, i: _import(i, src(m), dynamic=True, external=~_local(src(m)), here=True, flavour=2)),
    )


def python_imports() -> Column:
    def one(t: Column, i: Column) -> Column:
        source, plain = F.regexp_extract(t, r"^from\s+(\S+)\s+import\s+", 1), F.regexp_extract(t, r"^import\s+(\S+)", 1)
        names = F.filter(F.transform(F.split(F.regexp_replace(F.regexp_extract(t, r"^from\s+\S+\s+import\s+(.*)", 1), r"[()\\]", ""), ","), trim_space), lambda n: n != "")
        return F.when(source != "", _import(i, source, names, external=~source.startswith("."), here=True)).when(plain != "", _import(i, plain, external=~plain.startswith(".")))

    return _lines(one)


def go_imports() -> Column:
    """Single imports and those in import blocks, repeats too; a block ends with the next line that is but a closing bracket."""
    block = rf"^{SPACE}*import \({SPACE}*$[\s\S]*?(?:^{SPACE}*\){SPACE}*$|\z)"
    item, single = r'^\s*(?:\w+\s+)?"([^"]+)"', r'^import\s+"([^"]+)"'
    in_block = lambda m: F.transform(F.split(m, "\n"), lambda raw: F.regexp_extract(raw, item, 1))
    sources = lambda m: F.when(m.rlike(rf"^{SPACE}*import \("), in_block(m)).otherwise(F.array(F.regexp_extract(m, single, 1)))
    found = F.flatten(F.transform(F.regexp_extract_all("content", F.lit(rf'(?md)({block}|^import\s+"[^"]+")'), 1), sources))
    return F.transform(F.filter(found, lambda x: x != ""), lambda x, i: _import(i, x, external=~x.startswith("."), once=False))


def _line_imports(pattern: str, group: int, external, once: bool = True) -> Column:
    """Imports of lines that a pattern fits; external(line, source)."""
    return _lines(lambda t, i: F.when(t.rlike(pattern), _import(i, F.regexp_extract(t, pattern, group), external=external(t, F.regexp_extract(t, pattern, group)), once=once)))


def markup_imports() -> Column:
    """Scripts, links and images of HTML, in this order; not the pages linked to, nothing from other sites."""
    def told(k: int, attribute: str):
        def one(m: Column, i: Column) -> Column:
            s = F.regexp_extract(m, rf"(?i){attribute}={Q}([^'\"]+){Q}$", 1)
            return F.when(~(s.startswith("http") | s.startswith("//") | s.startswith("data:")), _import(i + k * 1_000_000, s, external=F.lit(False), here=True))

        return one

    tags = enumerate((("script", "src"), ("link", "href"), ("img", "src")))
    return F.concat(*[_matches(rf"(?i)<{tag}[^>]+{attribute}={Q}[^'\"]+{Q}", told(k, attribute)) for k, (tag, attribute) in tags])


def link_imports(flavour: int = 0) -> Column:
    """Markdown links to other files, decoded and without fragments."""
    def one(m: Column, i: Column) -> Column:
        bare = F.get(F.split(F.regexp_extract(m, r"\]\(([^)]+)\)$", 1), "#"), F.lit(0))
        return F.when((bare != "") & ~bare.startswith("http") & ~bare.startswith("mailto:"), _import(i, link_target(bare), external=F.lit(False), here=True, flavour=flavour))

    return _matches(r"\[[^\]]*\]\([^)]+\)", one)


def rust_imports() -> Column:
    return _line_imports(r"^use\s+([\w:]+(?:::\{[^}]*\})?(?:::\*)?)", 1, lambda t, s: ~(s.startswith("crate") | s.startswith("super") | s.startswith("self")), once=False)


def _each_of(files: DataFrame, what: str, registry: Registry) -> DataFrame:
    """(path, x): what expressions find in files of their languages, contents read once."""
    found = registry.expression(what)
    return _each(files.where("false") if found is None else files, found if found is not None else F.array())


def imports(files: DataFrame, registry: Registry | None = None) -> DataFrame:
    """(path, ord, source, resolved_path, symbols, is_type_only, is_dynamic, is_external) of all files.

    Where an expression reads a language, a file's imports are one array, built where the file is read, so only imports
    are dealt out by path. What parser classes find comes with it; a file that one of them fails on has none (parser_errors).
    """
    registry = registry or REGISTRY
    tables = [_each_of(files, "imports", registry).select("path", "x.*")] if registry.expression("imports") is not None else []
    for t in registry.rows(files, "imports"):
        told = {"flavour": F.lit(0), "once": F.lit(False), "here": ~F.col("is_external")}
        tables.append(t.where("error is null").select("path", *[told.get(c, F.col(c)).alias(c) for c in IMPORT_FIELDS]))
    x = reduce(DataFrame.unionByName, tables).repartition("path")
    x = x.withColumn("resolved_path", F.when(F.col("here"), resolve_import(F.col("source"), F.col("path"))))
    rest = F.struct("pos", "symbols", "is_type_only", "is_dynamic", "is_external", "resolved_path")
    x = x.groupBy("path", "flavour", "source", F.when(~F.col("once"), F.col("pos")).alias("each")).agg(F.min_by(rest, "pos").alias("x")).select("path", "flavour", "source", "x.*")
    n = F.row_number().over(Window.partitionBy("path").orderBy("flavour", "pos")) - 1
    return x.select("path", n.alias("ord"), "source", "resolved_path", "symbols", "is_type_only", "is_dynamic", "is_external")


def _signature(following: Column) -> Column:
    """Lines joined until one has `{` or `=>`, and cut there."""
    start = F.struct(F.lit("").alias("s"), F.lit(False).alias("done"))
    ended = lambda s: F.contains(s, F.lit("{")) | F.contains(s, F.lit("=>"))

    def step(acc: Column, line: Column) -> Column:
        return F.struct(F.when(acc["done"], acc["s"]).otherwise(F.concat(acc["s"], F.lit(" "), line["text"])).alias("s"), (acc["done"] | ended(line["text"])).alias("done"))

    joined = F.substring(F.aggregate(following, start, step)["s"], F.lit(2), F.lit(10_000_000))
    return F.substring(trim_space(F.regexp_replace(joined, r"(?s)(\{|=>).*$", "")), 1, 150)


def _line_symbols(rules) -> Column:
    """What the first of the rules that fits makes of each line of the content.

    rules(line, following): [(fits, name, kind, signature, exported)]; line: struct(raw, text); following(n): the n lines
    from this one on, a slice of the file's one array of lines, so the work is in proportion to the lines.
    """

    def of(lines_: Column) -> Column:
        def one(line: Column, i: Column) -> Column:
            chosen = F.lit(None)
            for fits, name, kind, signature, exported in reversed(rules(line, lambda n: F.slice(lines_, i + 1, F.lit(n)))):
                x = F.struct((i + 1).alias("line"), name.alias("name"), F.lit(kind).alias("kind"), signature.alias("signature"), exported.alias("is_exported"))
                chosen = F.when(fits, x).otherwise(chosen)
            return chosen

        return F.filter(F.transform(lines_, one), lambda x: x.isNotNull())

    split_ = F.transform(F.split("content", "\n"), lambda raw: F.struct(raw.alias("raw"), trim_space(raw).alias("text")))
    return F.get(F.transform(F.array(split_), of), F.lit(0))  # an array of one, so that the lines are made once and named in the inner expression


def script_symbols() -> Column:
    def rules(line: Column, following) -> list:
        t = line["text"]
        short = F.substring(t, 1, 120)
        block = lambda n: F.substring(F.array_join(F.transform(following(n), lambda x: x["raw"]), "\n"), 1, 300)
        of = [
            (rf"^export\s+(?:default\s+)?(?:async\s+)?function\s+({W})", "function", _signature(following(6))),
            (rf"^export\s+const\s+({W})\s*(?::\s*[^=]+)?\s*=\s*(?:async\s+)?\(", "function", short),
            (rf"^export\s+(?:default\s+)?(?:abstract\s+)?class\s+({W})", "class", short),
            (rf"^export\s+(?:default\s+)?interface\s+({W})", "interface", block(5)),
            (rf"^export\s+type\s+({W})", "type", short),
            (rf"^export\s+(?:const\s+)?enum\s+({W})", "enum", block(3)),
            (rf"^export\s+(?:readonly\s+)?const\s+({W})\s*(?::\s*{W})?\s*=", "const", short),
            (rf"^(?:async\s+)?function\s+({W})\s*\(", "function", F.substring(t, 1, 80)),
        ]
        return [(t.rlike(p), F.regexp_extract(t, p, 1), kind, s, F.lit(not p.startswith("^(?:async"))) for p, kind, s in of]

    return _line_symbols(rules)


def _plain_symbols(patterns: list[tuple[str, str]], exported, field: str = "text") -> Column:
    """Symbols told by a line alone; exported(name, number of the pattern)."""

    def rules(line: Column, following) -> list:
        t = line[field]
        name = lambda p: F.regexp_extract(t, p, 1)
        return [(t.rlike(p), name(p), kind, F.substring(line["text"], 1, 120), exported(name(p), k)) for k, (p, kind) in enumerate(patterns)]

    return _line_symbols(rules)


def python_symbols() -> Column:
    return _plain_symbols([(rf"^(?:async\s+)?def\s+({W})\s*\([^)]*\)", "function"), (rf"^class\s+({W})(?:\([^)]*\))?:", "class")], lambda n, k: ~n.startswith("_"))


def go_symbols() -> Column:
    return _plain_symbols([(rf"^func\s+(?:\([^)]+\)\s+)?({W})\s*\(", "function"), (rf"^type\s+({W})\s+", "type")], lambda n, k: F.substring(n, 1, 1).rlike("^[A-Z]"), "raw")


def rust_symbols() -> Column:
    pub = r"^pub(?:\([^)]*\))?\s+"
    kinds = [(pub + rf"{a}\s+({W})", b) for a, b in (("struct", "class"), ("enum", "enum"), ("trait", "interface"), ("type", "type"))]
    return _plain_symbols([(pub + rf"(?:async\s+)?fn\s+({W})", "function"), (rf"^(?:async\s+)?fn\s+({W})", "function"), *kinds], lambda n, k: F.lit(k != 1))


#: The built-in parsers.
REGISTRY = Registry()
for _names_, _imports_of, _symbols_of in (
    (("typescript", "javascript"), script_imports, script_symbols),
    (("mdx",), lambda: F.concat(script_imports(), link_imports(3)), script_symbols),
    (("python",), python_imports, python_symbols),
    (("go",), go_imports, go_symbols),
    (("rust",), rust_imports, rust_symbols),
    (("java", "kotlin", "swift"), lambda: _line_imports(r"^import\s+([\w.]+);?", 1, lambda t, s: F.lit(True)), None),
    (("csharp",), lambda: _line_imports(r"^using\s+([\w.]+);?", 1, lambda t, s: F.lit(True)), None),
    (("c", "cpp"), lambda: _line_imports(r'^#include\s+[<"]([^>"]+)[>"]', 1, lambda t, s: t.rlike(r"^#include\s+<")), None),
    (("php",), lambda: _line_imports(rf"^(use|require|require_once|include|include_once)\s+{Q}?([^'\";]+){Q}?;?", 2, lambda t, s: ~F.contains(s, F.lit("/"))), None),
    (("ruby",), lambda: _line_imports(rf"^require(?:_relative)?\s+{Q}([^'\"]+){Q}", 1, lambda t, s: ~(t.startswith("require_relative") | _local(s))), None),
    (("html",), markup_imports, None),
    (("markdown",), link_imports, None),
):
    REGISTRY.register(_names_, imports=_imports_of, symbols=_symbols_of)


def symbols(files: DataFrame, registry: Registry | None = None) -> DataFrame:
    """(path, line, name, kind, signature, signature_hash, is_exported) of all files.

    A file's lines are one array, judged by its language's rules where the file is read; what parser classes find comes
    with it.
    """
    registry = registry or REGISTRY
    tables = [_each_of(files, "symbols", registry).select("path", "x.*")] if registry.expression("symbols") is not None else []
    tables += [t.where("error is null").select("path", *SYMBOL_FIELDS) for t in registry.rows(files, "symbols")]
    x = reduce(DataFrame.unionByName, tables) if tables else files.sparkSession.createDataFrame([], "path string, line int, name string, kind string, signature string, is_exported boolean")
    return x.withColumn("signature_hash", F.sha2("signature", 256))


def parser_errors(files: DataFrame, registry: Registry) -> DataFrame:
    """(path, what, error): files that a registered class fails on, whose rows imports and symbols leave out."""
    tables = [t.where("error is not null").select("path", F.lit(what).alias("what"), "error") for what in ("imports", "symbols") for t in registry.rows(files, what)]
    return reduce(DataFrame.unionByName, tables) if tables else files.sparkSession.createDataFrame([], "path string, what string, error string")


def symbol_hashes(files: DataFrame, found: DataFrame) -> DataFrame:
    """(path, symbol_hash): hash of a file's exported signatures in order; of nothing, if it has none."""
    e = found.where("is_exported").groupBy("path").agg(F.array_join(F.array_sort(F.collect_list("signature")), "\n").alias("s"))
    return files.select("path").join(e, "path", "left").select("path", F.sha2(F.coalesce("s", F.lit("")), 256).alias("symbol_hash"))


SECRET = rf"(?i)(?:password|passwd|pwd|secret|api_key|apikey|token|auth)\s*[=:]\s*{Q}[^'\"]{{4,}}{Q}"
SQL_RISK = r"query\s*\(\s*['\"`][^'\"`]*\s*\+", r"execute\s*\(\s*['\"`][^'\"`]*\$\{", r"\$\{.*\}.*(?i:SELECT|INSERT|UPDATE|DELETE)"


# What each finding and pattern is told as.
FINDINGS = {
    "Hardcoded Secret": ("high", "Credentials should never be hardcoded. Use environment variables or a secrets manager."),
    "SQL Injection Risk": ("high", "String concatenation in SQL queries. Use parameterized queries instead."),
    "Dangerous HTML Render": ("medium", "Direct HTML assignment can lead to XSS vulnerabilities."),
    "Dangerous eval()": ("high", "Use of eval() is a severe security risk."),
}
PATTERNS = {
    "Singleton": ("lock", "Ensures a class has only one instance."),
    "Factory": ("factory", "Creates objects without specifying exact class."),
    "Observer/Event": ("eye", "Subscription mechanism for event-driven architecture."),
    "Custom Hook": ("hook", "React hook for reusable stateful logic."),
    "Context Provider": ("globe", "React Context for global state."),
}


def secrets(files: DataFrame) -> DataFrame:
    """(path, line, code) of lines with a literal credential; files without such words are not taken apart."""
    ln = lines(files.where(F.col("content").rlike(SECRET)))
    return ln.where(F.col("raw").rlike(SECRET) & ~F.contains("raw", F.lit("process.env")) & ~F.contains("raw", F.lit("config."))).select("path", "line", F.substring("text", 1, 80).alias("code"))


def findings(files: DataFrame) -> DataFrame:
    """(path, severity, title, desc, line, code) of all security findings."""
    def found(title: str, line: Column | None = None, code: Column | None = None) -> Column:
        severity, desc = FINDINGS[title]
        line, code = (F.lit(None) if x is None else x for x in (line, code))
        return F.struct(F.lit(severity).alias("severity"), F.lit(title).alias("title"), F.lit(desc).alias("desc"), line.cast("int").alias("line"), code.cast("string").alias("code"))

    s = secrets(files).select("path", found("Hardcoded Secret", F.col("line"), F.col("code")).alias("x"))
    c = F.col("content")
    sql = c.rlike(SQL_RISK[0]) | c.rlike(SQL_RISK[1]) | c.rlike(SQL_RISK[2])
    first = F.substring(trim_space(F.regexp_extract("content", r"(?i)(.*(?:query|execute|SELECT|INSERT|UPDATE|DELETE).*(?:\+|\$\{).*)", 1)), 1, 80)
    html = c.rlike(r"innerHTML\s*=") | F.contains(c, F.lit("dangerouslySetInnerHTML"))
    kinds = F.array_compact(F.array(F.when(sql, found("SQL Injection Risk", code=first)), F.when(html, found("Dangerous HTML Render")), F.when(c.rlike(r"eval\s*\("), found("Dangerous eval()"))))
    return s.unionByName(_each(files, kinds)).select("path", "x.*")


def patterns(files: DataFrame) -> DataFrame:
    """(path, name, icon, desc, severity) of the design patterns that a text shows."""
    c = F.col("content")
    has = lambda *words: [F.contains(c, F.lit(w)) for w in words]
    either = lambda a, *b: either(a | b[0], *b[1:]) if b else a
    tests = [
        ("Singleton", either(*has("getInstance"), c.rlike(r"let\s+instance\s*="), c.rlike(r"private\s+static\s+instance"))),
        ("Factory", F.lower("path").contains("factory") | c.rlike(r"create[A-Z]\w*\s*\(")),
        ("Observer/Event", either(*has("subscribe", "addEventListener", ".on(", "emit("))),
        ("Custom Hook", c.rlike(r"export\s+(?:const|function)\s+use[A-Z]")),
        ("Context Provider", either(*has("createContext", "Provider", "useContext"))),
    ]
    told = lambda n: F.struct(F.lit(n).alias("name"), F.lit(PATTERNS[n][0]).alias("icon"), F.lit(PATTERNS[n][1]).alias("desc"), F.lit("info").alias("severity"))
    return _each(files, F.array_compact(F.array(*[F.when(t, told(n)) for n, t in tests]))).select("path", "x.*")


def external_dependencies(found: DataFrame) -> DataFrame:
    """(path, deps): each file's distinct external sources in order of first use."""
    x = found.where("is_external").groupBy("path", "source").agg(F.min("ord").alias("o"))
    return x.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "source"))), lambda s: s["source"]).alias("deps"))


def symbol_index(found: DataFrame) -> DataFrame:
    """(name, kind, places): where each exported symbol is."""
    return found.where("is_exported").groupBy("name", "kind").agg(F.array_sort(F.collect_list(F.struct("path", "line"))).alias("places"))


def knowledge_index(files: DataFrame, found: DataFrame) -> DataFrame:
    """(module_group, entry): a line for each group, with each path's first four exported names."""
    from loam.functions.scalar import module_group

    names = found.where("is_exported").groupBy("path").agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("line", "name"))), 1, 4), lambda s: s["name"]), ", ").alias("names"))
    x = files.select("path", module_group(F.col("path")).alias("module_group")).join(names, "path", "left")
    line = F.concat(F.lit("- `"), "path", F.lit("`"), F.when(F.col("names").isNotNull(), F.concat(F.lit(" — "), "names")).otherwise(""))
    return x.groupBy("module_group").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("entry"))
