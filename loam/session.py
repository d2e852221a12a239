"""One object for what a user of the engine asks for: build, resolve, search, status, and the rest.

Everything lives in Parquet tables under one root that all executors reach, in versions that change as a whole; results are DataFrames.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from loam.functions import scalar
from loam.operators import aliases, changes, graph, health, overlay, overview, parse, rank, search_index, summarise
from loam.operators.registry import Registry
from loam.sources import context_tree, file_tree, files, repository
from loam.sources.scratch import stored
from loam.sources.versions import Versions


@dataclass(frozen=True)
class Config:
    """What a build does; unknown keys of a configuration are ignored."""

    provider: str = "extract"
    exclude_paths: tuple[str, ...] = ()
    max_tokens_per_module: int = 2000
    parallel_workers: int = 4
    ignore_text: str = ""
    repository: str = "repository"
    flow_extraction: bool = True
    aliases: dict = field(default_factory=dict)  # pattern -> targets, for imports in the whole repository
    lazy_hops: int = 1  # how many hops an import counts for that is only made when needed
    api_key: str = field(default="", repr=False)

    @classmethod
    def merged(cls, *layers: dict) -> Config:
        """Later layers win, at every depth; lists are replaced, not joined."""
        both: dict = {}
        for layer in layers:
            both = repository.merged(both, layer)
        known = {k: v for k, v in both.items() if k in cls.__dataclass_fields__}
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in known.items()})

    @classmethod
    def load(cls, root: str | None = None) -> Config:
        """The configuration of the repository around a folder; its provider's name and key are provider.name and provider.api_key."""
        at = repository.find_root(root)
        values = repository.load_config(at)
        told = values.pop("provider")
        return cls.merged({"repository": repository.git_metadata(at)["name"]}, values, {"api_key": told["api_key"]}, {"provider": told["name"]} if told.get("name") else {})


@dataclass
class Session:
    """A repository's tables. as_of is the time of every stamp and age, as results must not depend on the clock.

    progress is told of each phase of a build: (phase, steps done, steps in all).
    """

    spark: SparkSession
    root: str
    as_of: str
    config: Config = field(default_factory=Config)
    progress: Callable[[str, int, int], None] = lambda phase, done, of: None
    parsers: Registry = field(default_factory=lambda: parse.REGISTRY)

    def __post_init__(self) -> None:
        self.versions, self._build, self._steps = Versions(self.spark, self.root), None, []

    def _read(self, name: str) -> DataFrame | None:
        """A table of the build under way, else of the last one that was committed; None if never built."""
        return (self._build or self.versions).read(name)

    def _write(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table of the build under way (else as a version of its own); its rows are counted as they are written."""
        build, seen = self._build or self.versions.begin(), Observation()
        build.write(df.observe(seen, F.count(F.lit(1)).alias("rows")), name)
        if self._build is None:
            build.commit()
        else:
            self._steps.append((len(self._steps), name, seen.get["rows"]))
        return self._read(name)

    def build(self, source: str | DataFrame, full: bool = False) -> DataFrame:
        """Scan, parse, detect changes, summarise what they invalidate, and store; returns one row of statistics.

        source: a folder, or a table (path, content, size). What can't be read or parsed is told by errors(). All tables
        change at once, at the end; if a build fails or is killed, those of the one before stay.
        """
        self._build, self._steps = self.versions.begin(), []
        try:
            self._make(source, full)
            self._build.write(self.spark.createDataFrame(self._steps, "ord int, phase string, rows long"), "steps")
            self._build.commit({"built_at": self.as_of})
        finally:
            self._build = None
        return self._read("statistics")

    def _make(self, source: str | DataFrame, full: bool) -> None:
        self.progress("scan", 0, 1)
        if isinstance(source, str):
            read = stored(file_tree.files(self.spark, source, list(self.config.exclude_paths)), "tree")
        else:
            read = source.withColumn("hash", F.sha2("content", 256)).withColumn("error", F.lit(None).cast("string"))
        scanned = files.scan(read, list(self.config.exclude_paths), self.config.ignore_text, self.parsers)
        scanned = self._write(scanned.select("path", "language", "size", "content", "hash"), "files")
        readable = scanned.where("content is not null")
        imports, symbols = self._write(parse.imports(readable, self.parsers), "imports"), self._write(parse.symbols(readable, self.parsers), "symbols")
        unread = read.where("error is not null").select("path", F.lit("read").alias("what"), "error")
        self._write(unread.unionByName(parse.parser_errors(readable, self.parsers)), "errors")
        hashes = parse.symbol_hashes(readable, symbols)
        current = scanned.join(hashes, "path", "left").select("path", "hash", "symbol_hash")
        named = aliases.from_configs(read.where("content is not null").select("path", "content"))
        if self.config.aliases:
            named = named.unionByName(aliases.table(self.spark, self.config.aliases))
        weighed = self._write(aliases.edges(imports, scanned, stored(named.distinct(), "aliases")), "lazy_edges")
        edges = self._write(weighed.drop("lazy"), "edges")
        before, artifacts = self._read("manifest"), self._read("artifacts")
        anew = changes.rebuild_all(full, before is not None and artifacts is not None)
        if anew:
            stale, kept = readable.select("path"), None
        else:
            changed = changes.detect(before, current)
            stale = changes.invalidated(changed, edges, changes.missing_artifacts(scanned, artifacts.where("type = 'module_summary'")), readable)
            kept = changes.carried_forward(artifacts, stale, changed)
        todo = readable.join(stale.distinct(), "path", "left_semi")
        names = symbols.where("is_exported").groupBy("path").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("exports"))
        answers = self._summaries(todo.join(names, "path", "left"), edges, kept)
        new = self._write(summarise.artifacts(answers, "module_summary", self.as_of, self.config.provider), "rebuilt")
        modules = self._write(new if kept is None else kept.unionByName(new), "artifacts")
        if changes.rebuild_architecture(not anew, 0 if anew else new.count()) and not modules.isEmpty():
            self._overviews(edges, symbols, modules)
        self._write(changes.next_manifest(scanned, current.where("hash is not null")), "manifest")
        self.progress("index", 0, 1)
        search_index.build(self.artifacts(), self._build.path("index"))
        self.progress("index", 1, 1)
        tokens = new.select("path", F.col("metadata.token_count").alias("tokens"))
        counts = scanned.join(tokens, "path", "left").select("path", "language", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.col("tokens").isNotNull().alias("rebuilt"))
        found = parse.findings(readable).groupBy("path").agg(F.count(F.lit(1)).alias("issues"))
        shown = parse.patterns(readable).groupBy("path").agg(F.count(F.lit(1)).alias("patterns"))
        stats = health.build_stats(counts.join(found, "path", "left").join(shown, "path", "left").fillna(0, ["issues", "patterns"]))
        told = self._write(stats, "statistics")
        of = modules.where("type = 'module_summary'").agg(F.count(F.lit(1)).alias("total_modules"))
        summary = told.crossJoin(F.broadcast(of)).select(  # one row each
            F.lit(str(self._build.number)).alias("build_id"), F.lit(self.as_of).cast("timestamp_ntz").alias("built_at"), F.col("rebuilt").alias("modules_rebuilt"), "total_modules", "total_files", "tokens",
            F.lit(None).cast("long").alias("duration_ms"),
        )
        self._write(summary, "build_summary")

    def _summaries(self, todo: DataFrame, edges: DataFrame, kept: DataFrame | None) -> DataFrame:
        """(path, content): summaries of todo (path, language, content, exports), level by level of imports, so each sees those of what it imports."""
        levels = stored(graph.topological_levels(self.nodes(), edges), "levels")
        work = stored(todo.join(levels.withColumnRenamed("id", "path"), "path"), "todo")
        known = None if kept is None else kept.where("type = 'module_summary'").select(F.col("path").alias("id"), "content")
        answers = None
        in_order = [r["level"] for r in work.select("level").distinct().orderBy("level").collect()]  # a row for each level
        for k, level in enumerate(in_order):
            self.progress("summaries", k, len(in_order))
            now = work.where(F.col("level") == level).drop("level")
            if known is None:
                told = now.withColumn("dependencies", F.lit(None).cast("string"))
            else:
                context = graph.first_dependencies(edges.join(now.select(F.col("path").alias("src")), "src", "left_semi"), known)
                told = now.join(context.select(F.col("src").alias("path"), F.col("context").alias("dependencies")), "path", "left")
            prompts = summarise.module_prompt(told, self.config.max_tokens_per_module)
            fresh = stored(summarise.run(prompts, self.config.provider, max_tokens=self.config.max_tokens_per_module), "answers")
            answers = fresh if answers is None else answers.unionByName(fresh)
            done = fresh.where("content is not null").select(F.col("path").alias("id"), "content")
            known = done if known is None else known.unionByName(done)
        self.progress("summaries", len(in_order), len(in_order))
        return answers if answers is not None else todo.select("path", F.lit(None).cast("string").alias("content"))

    def _overviews(self, edges: DataFrame, symbols: DataFrame, modules: DataFrame) -> None:
        """Stores the architecture, the flows and the primer: one answer each."""
        self.progress("overviews", 0, 1)
        name, by = self.config.repository, self.config.provider
        n = self.nodes()
        told = n.select("path").join(modules.where("type = 'module_summary'").select("path", "content"), "path", "left")

        def ask(prompt: DataFrame, fixed: tuple[int, float, int]) -> DataFrame:
            return stored(summarise.run(prompt, by, "Write Markdown only.", fixed[0], fixed[1]), "overview")

        answer = ask(overview.architecture_prompt(name, n, edges, told), overview.ARCHITECTURE)
        made = summarise.artifacts(answer, "architecture_overview", self.as_of, by)
        if self.config.flow_extraction:
            exports = symbols.where("is_exported").select("path", "line", "name")
            flows = ask(overview.flows_prompt(name, n, edges, exports, told), overview.FLOWS)
            made = made.unionByName(summarise.artifacts(flows, "execution_flow", self.as_of, by))
        self._write(made, "overviews")
        self._write(overview.primer(name, ask(overview.primer_prompt(name, n, answer.fillna("", ["content"])), overview.PRIMER), self.as_of), "primer")
        self.progress("overviews", 1, 1)

    def adopt(self, folder: str | DataFrame) -> DataFrame:
        """Take over a context folder of Markdown and JSON files as a version of the tables; returns its modules.

        folder: where it lies, or its files as a table (path, content). Searches, tasks and graph queries answer from it as
        from a build; contents of source files aren't in such a folder, so a full build is due before an incremental one.
        """
        read = stored(context_tree.tree(self.spark, folder) if isinstance(folder, str) else folder.select("path", "content"), "adopted")
        self._build, self._steps = self.versions.begin(), []
        try:
            kept = context_tree.modules(read).unionByName(context_tree.gotchas(read, self.as_of)).drop("module_id")
            self._write(kept, "artifacts")
            self._write(context_tree.overviews(read, self.as_of), "overviews")
            known = self._write(context_tree.manifest(read), "manifest")
            self._write(known.select("path", "language", "size", F.lit(None).cast("string").alias("content"), "hash"), "files")
            edges = self._write(context_tree.edges(read), "edges")
            self._write(edges.withColumn("lazy", F.lit(False)), "lazy_edges")
            self._write(context_tree.branches(read), "branches")
            self._write(context_tree.overrides(read), "overrides")
            self._write(context_tree.build_summary(read), "build_summary")
            search_index.build(self.artifacts(), self._build.path("index"))
            self._build.commit({"built_at": self.as_of})
        finally:
            self._build = None
        return self._read("artifacts").where("type = 'module_summary'")

    def branches(self) -> DataFrame | None:
        """The branches of an adopted folder, by name; None where none was adopted."""
        b = self._read("branches")
        return None if b is None else b.orderBy("name", "folder")

    def branch(self, name: str) -> DataFrame:
        """(module_id, content) as a branch of an adopted folder sees the modules: its own summaries over the main ones."""
        main = self._read("artifacts").where("type = 'module_summary'").select(scalar.path_id(F.col("path")).alias("module_id"), "content")
        own = self._read("overrides").where(F.col("folder") == scalar.branch_name(F.lit(name)))
        return overlay.read(main, own)

    def diff(self, module: str | None = None) -> DataFrame:
        """What the last build is: one row about the whole, or the display of one module's artifact (none if there is no such module)."""
        if module is not None:
            return context_tree.module_display(self._read("artifacts").where(F.col("path") == module), self.as_of)
        return context_tree.build_display(self._read("build_summary"), self.as_of)

    def errors(self) -> DataFrame | None:
        """(path, what, error) of the last build: files and folders that could not be read, files that a parser failed on; None before a build."""
        return self._read("errors")

    def steps(self) -> DataFrame | None:
        """(ord, phase, rows) of the last build: the tables it wrote, in order, and how many rows each got; None before a build."""
        return self._read("steps")

    def architecture(self) -> str | None:
        """The architecture's text; None if there is none yet."""
        o = self._read("overviews")
        row = None if o is None else o.where("type = 'architecture_overview'").select("content").first()
        return row and row["content"]

    def doctor(self) -> DataFrame:
        """Seven checks of what a session needs."""
        a, o = self._read("artifacts"), self._read("overviews")
        kinds = [x.select("type", "content") for x in (a, o) if x is not None]
        told = self.spark.createDataFrame([], "type string, content string") if not kinds else kinds[0] if len(kinds) == 1 else kinds[0].unionByName(kinds[1])
        ok, error = summarise.validate(self.config.provider)
        local = self.config.provider == "extract"
        return health.doctor(told, self.root, True, (ok, error or self.config.provider), self._read("primer") is not None, local or bool(self.config.api_key))

    def artifacts(self, use: str = "search") -> DataFrame:
        """Artifacts as ranking wants them, for a search or a task; ord is a hash of path and type, a total order that needs no sort."""
        a = rank.candidates(self._read("artifacts"), self._read("overviews"), use)
        return a.select("id", F.xxhash64("path", "type").alias("ord"), "type", "path", "content", "tags", F.col("metadata.generated_at").alias("generated_at"))

    def search(self, query: str, kind: str | None = None, limit: int = 8) -> DataFrame:
        """The best artifacts for a query, from the index of the last build."""
        index = self.versions.path(self.versions.current(), "index")
        if index is None:
            return rank.search(self.artifacts(), query, kind, limit)
        return search_index.Index(self.spark, index).search(query, kind, limit)

    def resolve(self, task: str, targets: list[str] | None = None, budget: int = 8000, operation: str = "auto", form: str = "text") -> DataFrame:
        """One row of text: the best artifacts for a task that fit the budget."""
        nodes, edges = self.nodes(), self._read("edges")
        near = degree = None
        if targets:
            start = self.spark.createDataFrame([(t,) for t in targets], "id string")
            near = aliases.distances(nodes, self._read("lazy_edges"), start, 4, self.config.lazy_hops).select(F.col("id").alias("path"), "depth")
        degree = graph.degrees(nodes, edges).select(F.col("id").alias("path"), "in_degree")
        scored = stored(rank.first_of_id(rank.relevance(self.artifacts("task"), task, self.as_of, operation, targets, near, degree)), "scored")
        text = self.architecture()
        filled = stored(rank.fill_budget(scored, budget, text), "filled")
        return rank.package(rank.sections(filled, scored), scored.select("id", "content"), form, rank.architecture_share(text, budget), filled)

    def nodes(self) -> DataFrame:
        return self._read("files").select(F.col("path").alias("id"), "path", "language")

    def module(self, path: str) -> DataFrame:
        """The artifact of the best match for a path."""
        return self.artifacts().join(F.broadcast(graph.fuzzy_path(self.nodes(), path).select("path")), "path")

    def blast_radius(self, path: str) -> DataFrame:
        best = graph.fuzzy_path(self.nodes(), path).first()
        origin = best["path"] if best else path
        reached = graph.blast_radius(self.nodes(), self._read("edges"), origin)
        return reached.select(F.col("id").alias("path"), "depth", scalar.module_group(F.col("id")).alias("module_group"))

    def health(self) -> DataFrame:
        f, e = self._read("files"), self._read("edges")
        mutual = e.join(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi").select(F.col("src").alias("path"), F.lit(True).alias("mutual")).distinct()
        high = parse.findings(f.where("content is not null")).where("severity = 'high'").groupBy("path").agg(F.count(F.lit(1)).alias("high_issues"))
        n = f.select("path", F.length("content").alias("size")).join(graph.degrees(self.nodes(), e).withColumnRenamed("id", "path"), "path").join(mutual, "path", "left").join(high, "path", "left")
        return health.issues(health.score(n.fillna(0, ["high_issues", "size"]).fillna(False, ["mutual"])))

    def status(self) -> DataFrame:
        """One row: files, artifacts, age of the newest of them and whether that is stale (over two hours)."""
        a = self.artifacts().agg(F.count(F.lit(1)).alias("artifacts"), F.max("generated_at").alias("generated_at"))
        minutes = F.floor(scalar.age_hours(F.col("generated_at"), F.lit(self.as_of)) * 60)
        return self._read("files").agg(F.count(F.lit(1)).alias("files")).join(F.broadcast(a)).select("files", "artifacts", scalar.age(F.col("generated_at"), F.lit(self.as_of)).alias("age"), (minutes > 120).alias("stale"))

    def cost(self, provider: str = "openai") -> DataFrame:
        return health.cost(self._read("files").agg(F.count(F.lit(1)).alias("n")), self.config.max_tokens_per_module, provider)

    def index(self) -> DataFrame:
        return parse.knowledge_index(self._read("files"), self._read("symbols"))

    def graph_summary(self) -> DataFrame:
        return graph.summary(self.nodes(), self._read("edges"))

    def merge(self, overrides: DataFrame, resolver=None) -> tuple[DataFrame, DataFrame]:
        """A branch's overrides (module_id = path, content) merged into the module summaries."""
        main = self.artifacts().where("type = 'module_summary'").select(F.col("path").alias("module_id"), "content")
        return overlay.merge(main, overrides, resolver)
