"""Parsers by language: built-in ones are column expressions, and a user's are either such expressions or Python classes.

A class becomes a table function that is called laterally for the files of its languages alone, so their contents reach
Python in batches and no other file does.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from loam.functions import scalar
from loam.sources.ship import ship


@dataclass(frozen=True)
class Import:
    """What one import statement names. external: None means that it is unless it begins with a dot or a slash."""

    source: str
    symbols: tuple[str, ...] = ()
    type_only: bool = False
    dynamic: bool = False
    external: bool | None = None


@dataclass(frozen=True)
class Symbol:
    """A definition in a line, counted from 1."""

    name: str
    kind: str
    line: int
    signature: str = ""
    exported: bool = True


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, t) for k, t in fields.items()])


# What a table function returns for each thing that is asked for; error is that of the whole file, which then has no other row.
_ROWS = {
    "imports": _struct(pos=T.IntegerType(), source=T.StringType(), symbols=T.ArrayType(T.StringType()), is_type_only=T.BooleanType(), is_dynamic=T.BooleanType(), is_external=T.BooleanType(), error=T.StringType()),
    "symbols": _struct(line=T.IntegerType(), name=T.StringType(), kind=T.StringType(), signature=T.StringType(), is_exported=T.BooleanType(), error=T.StringType()),
}


def _import_row(pos: int, x: Import) -> tuple:
    external = not x.source.startswith((".", "/")) if x.external is None else x.external
    return pos, x.source, list(x.symbols), x.type_only, x.dynamic, external, None


def _symbol_row(pos: int, x: Symbol) -> tuple:
    return x.line, x.name, x.kind, x.signature[:300], x.exported, None


_AS_ROW = {"imports": _import_row, "symbols": _symbol_row}


def table_function(parser: type) -> Callable:
    """The table function of a parser class: (path, content, what) -> rows; what is 'imports' or 'symbols' and decides the schema."""
    rows, as_row = _ROWS, _AS_ROW
    module = sys.modules.get(parser.__module__)
    if module is not None and parser.__module__.partition(".")[0] not in ("loam", "__main__"):
        cloudpickle.register_pickle_by_value(module)  # executors need not have the user's module

    class Parse:
        @staticmethod
        def analyze(path: AnalyzeArgument, content: AnalyzeArgument, what: AnalyzeArgument) -> AnalyzeResult:
            for name, a in (("path", path), ("content", content)):
                if a.dataType != T.StringType():
                    raise ValueError(f"{name} must be a string, not {a.dataType.simpleString()}")
            if not what.isConstantExpression or what.value not in rows:
                raise ValueError(f"what must be one of {', '.join(rows)}")
            return AnalyzeResult(schema=rows[what.value])

        def __init__(self) -> None:
            self.parser = parser()

        def eval(self, path: str, content: str, what: str):
            if content is None:
                return
            try:
                found = [as_row[what](k, x) for k, x in enumerate(getattr(self.parser, what)(path, content) or ())]
            except Exception as e:  # one odd file must not end the build; its error is told
                found = [(*[None] * (len(rows[what]) - 1), f"{type(e).__name__}: {e}")]
            yield from found

    return F.udtf(Parse, useArrow=True)


@dataclass(frozen=True)
class Parser:
    """How the files of some languages are read: expressions over path and content, or a class.

    imports and symbols build an array of structs as those of loam.operators.parse; a class has methods imports(path, content)
    and symbols(path, content) that give Import and Symbol objects.
    """

    languages: tuple[str, ...]
    imports: Callable[[], Column] | None = None
    symbols: Callable[[], Column] | None = None
    by: type | None = None
    extensions: tuple[tuple[str, str], ...] = ()


@dataclass
class Registry:
    """Parsers in order of registration; for a language that several name, the last one counts."""

    parsers: list[Parser] = field(default_factory=list)

    def copy(self) -> Registry:
        return Registry(list(self.parsers))

    def register(self, languages: str | Iterable[str], by: type | None = None, imports: Callable[[], Column] | None = None, symbols: Callable[[], Column] | None = None, extensions: dict[str, str] | None = None) -> Registry:
        """Adds a parser. extensions (such as {".proto": "protobuf"}) make files of that ending sources of a language."""
        names = (languages,) if isinstance(languages, str) else tuple(languages)
        if not names:
            raise ValueError("a parser has a language at least")
        if (by is None) == (imports is None and symbols is None):
            raise ValueError("a parser is either a class or expressions")
        if by is not None and not any(callable(getattr(by, what, None)) for what in _ROWS):
            raise ValueError(f"{by.__name__} has neither imports nor symbols")
        ends = tuple(sorted((e.lower(), n) for e, n in (extensions or {}).items()))
        if any(n not in names or not e.startswith(".") for e, n in ends):
            raise ValueError("an extension begins with a dot and names one of the parser's languages")
        self.parsers.append(Parser(names, imports, symbols, by, ends))
        return self

    def _of(self) -> dict[str, Parser]:
        return {name: p for p in self.parsers for name in p.languages}

    def languages(self) -> list[str]:
        return list(self._of())

    def language(self, path: Column) -> Column:
        """The language of a path: by registered endings first."""
        found = scalar.language(path)
        for p in self.parsers:
            for end, name in p.extensions:
                found = F.when(F.lower(path).endswith(end), F.lit(name)).otherwise(found)
        return found

    def is_source(self, language: Column) -> Column:
        own = [name for p in self.parsers for _, name in p.extensions]
        return scalar.is_source(language) | language.isin(*own) if own else scalar.is_source(language)

    def expression(self, what: str) -> Column | None:
        """One case for all languages that have an expression."""
        groups: dict[int, tuple[Callable[[], Column], list[str]]] = {}
        for name, p in self._of().items():
            build = getattr(p, what)
            if p.by is None and build is not None:
                groups.setdefault(id(build), (build, []))[1].append(name)
        out = None
        for build, names in groups.values():
            mine = F.col("language").isin(*names)
            out = F.when(mine, build()) if out is None else out.when(mine, build())
        return out

    def rows(self, files: DataFrame, what: str) -> list[DataFrame]:
        """What classes find, a table (path, ...) for each class; errors among it."""
        ship(files.sparkSession)
        groups: dict[type, list[str]] = {}
        for name, p in self._of().items():
            if p.by is not None and callable(getattr(p.by, what, None)):
                groups.setdefault(p.by, []).append(name)
        out = []
        for by, names in groups.items():
            mine = files.where(F.col("language").isin(*names)).select("path", "content")
            call = table_function(by)(F.col("path").outer(), F.col("content").outer(), F.lit(what))
            out.append(mine.lateralJoin(call).drop("content"))
        return out
