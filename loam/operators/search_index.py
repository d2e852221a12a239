"""Search on an inverted index: the ranking of loam.operators.rank.search without a scan of contents for each query.

A query word is a literal that may stand anywhere in a text, and holds no white space. So all its occurrences lie within terms (what
white space parts), and those of a text are the sum over its terms. Tables of an index, in one folder:

    terms     (term, rows, fixed, level)   how many artifacts have a term, and the most that one of them has of fixed and of level
    postings  (term, fixed, level, ...)    a row for each term of an artifact, in segments of the artifacts that one task read
    tags      (tag, ord, type, n)          tags by their lower-case value
    documents (ord, path, type, content)   in order of ord within a task's rows, read for the results alone
    about     (artifacts)

fixed is what path and title give, level the density of hits on a scale of logarithms, rounded up. Both bound a score without
statistics of words, so a segment is written where its artifacts are read and no row of a posting is ever shuffled. A segment is
in order of term, the best rows of a term first, so filters on term, fixed and level, which Parquet takes, leave out the rest.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions import scalar
from loam.operators.rank import query_words

#: Rows of a file of postings; a segment of more has several files.
SHARE = 20_000_000
#: Levels for each doubling of the hits among a thousand characters.
LEVELS = 8
_GAP = r"[ \t\n\x0B\f\r]+"
#: The most that a word's tags can add.
TAGS = 3.0
_SCHEMAS = {
    "about": "artifacts long",
    "documents": "ord long, path string, type string, content string",
    "postings": "term string, fixed double, level int, ord long, type string, chars int, hits long, title int, base int, path int",
    "terms": "term string, rows long, fixed double, level int",
    "tags": "tag string, ord long, type string, n long",
}


def _terms(text: Column) -> Column:
    return F.array_remove(F.split(text, _GAP), "")


def _content_score(hits: Column, chars: Column, idf: Column) -> Column:
    tf = hits / (F.greatest(chars, F.lit(1)) / 1000.0)
    return F.when(hits > 0, F.least(tf * idf * 0.3, F.lit(2.0))).otherwise(0.0)


def _idf(n: Column, df: Column) -> Column:
    return F.log((n + 1) / (df + 1)) + 1


def _title_score(in_title: Column) -> Column:
    return F.when(in_title > 0, 1.3).otherwise(0.0)


def _name_score(in_base: Column, in_path: Column) -> Column:
    return F.when(in_base > 0, 2.5).when(in_path > 0, 1.5).otherwise(0.0)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """What then() makes of a value, which is computed once; unlike transform(), aggregate() doesn't copy what it returns."""
    return F.aggregate(F.array(F.lit(0)), value, lambda v, _: v, then)


def _counted(content: Column, title: Column, path: Column, tags: Column) -> Column:
    """An array (term, hits, where) of the distinct terms of an artifact, with nulls; where sums 1: in its title, 2: in its path, 4: in its base name, 8: in its tags.

    A term of each place but the content gets that number as its end, behind a tab, which no term holds. In order, equal
    ones follow each other, and what begins with the same term follows it; where some character comes before a tab, only
    if the content's terms have an end too.
    """
    ended = lambda text, k: F.transform(_terms(text), lambda t: F.concat(t, F.lit(f"\t{k}")))
    joined = F.array_join(tags, " ")
    low = F.lit("[\\x00-\\x08]")
    contents = F.when(F.rlike(content, low) | F.rlike(title, low) | F.rlike(path, low) | F.rlike(joined, low), ended(content, 0)).otherwise(_terms(content))
    places = ((title, 1), (path, 2), (scalar.base_name(path), 4), (joined, 8))
    together = F.sort_array(F.concat(contents, *[F.array_distinct(ended(text, k)) for text, k in places]))
    term = lambda c: F.substring_index(c, "\t", 1)
    has_end = lambda c: F.contains(c, F.lit("\t"))

    def one(s: Column, at: Column, n: Column) -> Column:
        """The term whose first run of n equal ones ends at a place, or null where another run of the term comes before."""
        own = F.get(s, at)

        def where(j: int) -> Column:
            next_ = F.get(s, at + j)
            return F.when(has_end(next_) & (term(next_) == term(own)), F.right(next_, F.lit(1)).cast("int") + (where(j + 1) if j < 4 else 0)).otherwise(0)

        told = lambda t, hits, places: F.struct(t.alias("term"), hits.cast("long").alias("hits"), places.alias("where"))
        first = F.coalesce(term(F.get(s, at - n)) != term(own), F.lit(True))
        hits = F.when(F.endswith(own, F.lit("\t0")), n).otherwise(0)
        return F.when(~has_end(own), told(own, n, where(1))).when(first, told(term(own), hits, F.right(own, F.lit(1)).cast("int") + where(1)))

    def runs(s: Column) -> Column:
        ends = F.filter(F.transform(s, lambda t, k: F.when(~t.eqNullSafe(F.get(s, k + 1)), k)), lambda k: k.isNotNull())
        return _let(ends, lambda e: F.transform(e, lambda at, k: one(s, at, at - F.coalesce(F.get(e, k - 1), F.lit(-1)))))

    return _let(together, runs)


def build(artifacts: DataFrame, folder: str, share: int = SHARE) -> None:
    """Writes the index of artifacts (ord, path, type, content, tags) into a folder. ord names an artifact."""
    spark = artifacts.sparkSession
    a = artifacts.select("ord", "path", "type", "content", "tags")
    a.sortWithinPartitions("ord").select("ord", "path", "type", "content").write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/documents")
    a.agg(F.count(F.lit(1)).alias("artifacts")).write.mode("overwrite").parquet(f"{folder}/about")
    lower = lambda c: F.lower(F.coalesce(c, F.lit("")))
    x = a.select("ord", "type", lower(F.col("content")).alias("lc"), lower(F.col("path")).alias("lp"), F.transform(F.coalesce("tags", F.array().cast("array<string>")), F.lower).alias("lt"), F.lower(scalar.title(F.coalesce("content", F.lit("")))).alias("title"))
    counted = x.select("ord", "type", F.length("lc").alias("chars"), _counted(F.col("lc"), F.col("title"), F.col("lp"), F.col("lt")).alias("terms"))
    rows = counted.select("ord", "type", "chars", F.explode_outer("terms").alias("f")).where("f is not null").select("ord", "type", "chars", "f.*")
    is_in = lambda k: (F.col("where").bitwiseAND(F.lit(k)) > 0).cast("int")
    fixed = _name_score(is_in(4), is_in(2 + 4)) + _title_score(is_in(1))
    level = F.when(F.col("hits") > 0, F.ceil(F.log2(F.col("hits") * 1000.0 / F.greatest("chars", F.lit(1))) * LEVELS)).cast("int")
    placed = rows.select("term", fixed.alias("fixed"), level.alias("level"), "ord", "type", "chars", "hits", "where").sortWithinPartitions("term", F.desc("fixed"), F.desc("level"))
    placed = placed.select("term", "fixed", "level", "ord", "type", "chars", "hits", is_in(1).alias("title"), is_in(4).alias("base"), is_in(2 + 4).alias("path"))  # after sorting, as fewer bytes are sorted so
    placed.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", share).parquet(f"{folder}/postings")
    terms = spark.read.schema(_SCHEMAS["postings"]).parquet(f"{folder}/postings").groupBy("term").agg(F.count(F.lit(1)).alias("rows"), F.max("fixed").alias("fixed"), F.max("level").alias("level"))
    terms.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/terms")
    tags = x.select("ord", "type", "lt", F.explode(F.array_distinct("lt")).alias("tag"))
    n = F.size(F.filter("lt", lambda t: t.eqNullSafe(F.col("tag")))).cast("long")
    tags.select("tag", "ord", "type", n.alias("n")).sortWithinPartitions("tag").write.mode("overwrite").parquet(f"{folder}/tags")


def _occurrences(term: Column, word: str) -> Column:
    return ((F.length(term) - F.length(F.replace(term, F.lit(word), F.lit("")))) / len(word)).cast("long")


def _either(a: Column, word: str) -> Column:
    return F.contains(a, F.lit(word)) | F.contains(F.lit(word), a)


class Index:
    """A stored index. A query reads terms, the postings of those that hold its words, and the few documents it returns."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self.artifacts = self._read("about").first()["artifacts"]

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(_SCHEMAS[name]).parquet(f"{self.folder}/{name}")

    def words(self, words: list[str]) -> list[dict]:
        """For each word: how many terms hold it, one of them, its rows, the most that one term gives, and the most that tags give; a row a word."""
        held = F.array(*[F.struct(F.lit(k).alias("k"), F.contains("term", F.lit(w)).alias("has")) for k, w in enumerate(words)])
        found = self._read("terms").select("term", "rows", "fixed", "level", F.explode(F.filter(held, lambda h: h["has"])).alias("h")).groupBy("h.k")
        rows = {r["k"]: r.asDict() for r in found.agg(F.count(F.lit(1)).alias("terms"), *[F.first(c).alias(c) for c in ("term", "rows", "fixed", "level")]).collect()}
        tagged = self._read("tags").agg(*[F.coalesce(F.bool_or(_either(F.col("tag"), w)), F.lit(False)).alias(f"t{k}") for k, w in enumerate(words)]).first()
        none = {"terms": 0, "term": None, "rows": 0, "fixed": 0.0, "level": None}
        told = [{**rows.get(k, none), "tags": TAGS if tagged[k] else 0.0} for k in range(len(words))]
        return [{**t, "top": self._most(w, t, t["fixed"], t["level"])} for w, t in zip(words, told, strict=True)]

    def _density(self, word: str, told: dict) -> float:
        """What a thousand characters with one hit of the only term that holds a word give."""
        return (math.log((self.artifacts + 1) / (told["rows"] + 1)) + 1) * 0.3 * (told["term"] or "").count(word)

    def _most(self, word: str, told: dict, fixed: float, level: int | None) -> float:
        """The most that an artifact of this fixed score and level gets by a word that one term alone holds."""
        return fixed + (0.0 if level is None else min(2 ** (level / LEVELS) * self._density(word, told), 2.0))

    def _at_least(self, word: str, told: dict, least: float) -> Column:
        """Whether a row can give so much; comparisons of columns with literals alone, which Parquet takes."""
        fits = F.col("fixed") >= least
        for fixed in sorted({name + title for name in (0.0, 1.5, 2.5) for title in (0.0, 1.3)}):
            if 0 < least - fixed <= 2 + 1e-6:
                level = math.ceil(math.log2((least - fixed) / self._density(word, told)) * LEVELS - 1e-6)
                fits = fits | (F.col("fixed").between(fixed - 0.01, fixed + 0.01) & (F.col("level") >= level))
        return fits

    def _postings(self, words: list[str], told: list[dict], least: dict[int, float]) -> DataFrame:
        """Rows (ord, type, chars, word, hits, title, base, path) of the terms that hold a word; least: rows that can't give so much are left out."""
        tests = []
        for k, (w, t) in enumerate(zip(words, told, strict=True)):
            if t["terms"]:
                fits = (F.col("term") == t["term"]) if t["terms"] == 1 else F.contains("term", F.lit(w))
                tests.append((k, w, fits & self._at_least(w, t, least[k]) if k in least else fits))
        p = self._read("postings")
        if not tests:
            return p.where("false").selectExpr("ord", "type", "chars", "0 as word", "hits", "title", "base", "path")
        any_ = tests[0][2]
        for _, _, fits in tests[1:]:
            any_ = any_ | fits
        of = F.array(*[F.when(fits, F.struct(F.lit(k).alias("word"), _occurrences(F.col("term"), w).alias("times"))) for k, w, fits in tests])
        x = p.where(any_).select("*", F.explode(F.array_compact(of)).alias("w"))
        return x.select("ord", "type", "chars", "w.word", (F.col("hits") * F.col("w.times")).alias("hits"), "title", "base", "path")

    def search(self, query: str, kind: str | None = None, limit: int = 10, snippets: bool = True) -> DataFrame:
        """(ord, path, type, score[, snippet]) of the best artifacts, as rank.search gives them.

        Word statistics are over all artifacts, whatever kind is asked for. Where a single term holds a word, its rows of
        low bounds are left out as soon as the best ones tell that they can't be among the results.
        """
        words = query_words(query)
        if not words:
            schema = self._read("documents").schema
            none = self.spark.createDataFrame([], schema).select("ord", "path", "type", F.lit(0.0).alias("score"), F.lit("").alias("snippet"))
            return none if snippets else none.drop("snippet")
        told = self.words(words)
        df = self._frequencies(words, told)
        best = self._scored(words, told, df, kind, self._bounds(words, told, df, kind, limit)).orderBy(F.desc("score"), "ord").limit(limit)
        rows = best.collect()  # limit rows
        top = self.spark.createDataFrame([(r["ord"], r["score"]) for r in rows], "ord long, score double")
        documents = self._read("documents").where(F.col("ord").isin(*[r["ord"] for r in rows]))  # few pages, as each file is in order of ord
        out = documents.join(F.broadcast(top), "ord")
        first = F.lit(None).cast("int")
        for w in words:
            at = F.instr(F.lower(F.coalesce("content", F.lit(""))), w) - 1
            first = F.coalesce(first, F.when(at >= 0, at))
        columns = ["ord", "path", "type", "score"] + [scalar.snippet(F.col("content"), first).alias("snippet")] * snippets
        return out.select(*columns).orderBy(F.desc("score"), "ord")

    def _frequencies(self, words: list[str], told: list[dict]) -> list[int]:
        """How many artifacts hold each word; that of a word that several terms hold is counted over their postings."""
        several = [k for k, t in enumerate(told) if t["terms"] > 1]
        counted = {}
        if several:
            only = [t if k in several else {**t, "terms": 0} for k, t in enumerate(told)]
            counted = {r["word"]: r["n"] for r in self._postings(words, only, {}).select("word", "ord").distinct().groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
        return [counted.get(k, t["rows"]) for k, t in enumerate(told)]

    def _scored(self, words: list[str], told: list[dict], df: list[int], kind: str | None, least: dict[int, float]) -> DataFrame:
        """(ord, type, score) of all artifacts of a row that is read, or of a tag that a word goes with."""
        p = self._postings(words, told, least).withColumn("tags", F.lit(0).cast("long"))
        tag = F.array(*[F.when(_either(F.col("tag"), w), F.lit(k)) for k, w in enumerate(words)])
        zero = lambda c: F.lit(0).cast("long").alias(c)
        t = self._read("tags").select("ord", "type", "n", F.explode(F.array_compact(tag)).alias("word"))
        both = p.unionByName(t.select("ord", "type", zero("chars"), "word", zero("hits"), zero("title"), zero("base"), zero("path"), F.col("n").alias("tags")))
        if kind and kind != "all":
            both = both.where(F.col("type") == kind)
        x = both.groupBy("ord", "word").agg(F.first("type").alias("type"), F.max("chars").alias("chars"), F.sum("hits").alias("hits"), *[F.max(c).alias(c) for c in ("title", "base", "path")], F.sum("tags").alias("tags"))
        idf = F.get(F.array(*[_idf(F.lit(float(self.artifacts)), F.lit(float(d))) for d in df]), F.col("word"))
        one = _name_score(F.col("base"), F.col("path")) + F.least(F.col("tags") * 1.5, F.lit(TAGS)) + _title_score(F.col("title")) + _content_score(F.col("hits"), F.col("chars"), idf)
        ordered = x.withColumn("one", one).groupBy("ord").agg(F.first("type").alias("type"), F.array_sort(F.collect_list(F.struct("word", "one"))).alias("parts"))  # one entry a word
        raw = F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["one"]) / len(words)
        return ordered.select("ord", "type", raw.alias("raw")).where("raw >= 0.1").select("ord", "type", F.least(F.col("raw") / 5, F.lit(1.0)).alias("score"))

    def _bounds(self, words: list[str], told: list[dict], df: list[int], kind: str | None, limit: int) -> dict[int, float]:
        """By word, the bound under which its rows can hold none of the results.

        An artifact in such a row gets less by this word than what, with the most that all other words and tags can give,
        the limit-th best of the best rows has already.
        """
        single = {k: t for k, t in enumerate(told) if t["terms"] == 1}
        if not single:
            return {}
        most = [t["top"] if t["terms"] == 1 else 0.0 if not t["terms"] else 2.5 + 1.3 + 2.0 for t in told]
        p = self._read("postings").where(F.col("term").isin(*{t["term"] for t in single.values()}))
        if kind and kind != "all":
            p = p.where(F.col("type") == kind)
        places = p.groupBy("term", "fixed", "level").agg(F.count(F.lit(1)).alias("n")).collect()  # six fixed scores, some hundred levels
        first = {}
        for k, t in single.items():
            held, least = 0, 0.0
            for bound, n in sorted(((self._most(words[k], t, r["fixed"], r["level"]), r["n"]) for r in places if r["term"] == t["term"]), reverse=True):
                if held < limit:
                    held, least = held + n, bound - 1e-6
            first[k] = least
        known = self._scored(words, told, df, kind, first).orderBy(F.desc("score"), "ord").limit(limit).collect()
        if len(known) < limit:
            return {}
        needed = known[-1]["score"] * 5 * len(words)  # capped at 5 a word, so never more than what it takes
        return {k: needed - sum(m for j, m in enumerate(most) if j != k) - sum(t["tags"] for t in told) - 1e-6 for k in single}


def indexed(artifacts: DataFrame, new_folder: Callable[[], str]) -> Index:
    """Builds an index in a new folder and opens it."""
    at = new_folder()
    build(artifacts, at)
    return Index(artifacts.sparkSession, at)
