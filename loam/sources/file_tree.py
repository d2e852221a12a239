"""A data source for source trees: lists and reads files in one pass, in parallel, and tells what could not be read as rows.

    spark.dataSource.register(FileTree)
    spark.read.format("loam_files").option("exclude", "**/build/**").load("/code")

Executors open the files themselves, so the folder must be reachable from all of them: a mounted folder, or a store that
pyarrow has a file system for (s3://, gs://, hdfs://).
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

from loam.sources.files import DEFAULT_EXCLUDES, MAX_SIZE, glob_regex

_SCHEMA = pa.schema([("path", pa.string()), ("absolute_path", pa.string()), ("size", pa.int64()), ("content", pa.string()), ("hash", pa.string()), ("error", pa.string())])
#: Rows and bytes of a batch of results.
_ROWS, _BYTES = 500, 4 << 20
#: Tests of a size that are pushed down, by kind of filter.
_TESTS = {GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, EqualTo: lambda a, b: a == b}


@dataclass(frozen=True)
class Part(InputPartition):
    """Folders to walk and files to read, relative to the root."""

    folders: tuple[str, ...]
    files: tuple[tuple[str, int], ...]
    errors: tuple[tuple[str, str], ...] = ()


class Tree:
    """Folder contents and file bytes below a root, in a local folder or a remote store."""

    def __init__(self, root: str) -> None:
        scheme = re.match(r"(\w+):", root)
        if scheme and scheme[1] != "file":
            from pyarrow import fs

            self.store, self.root = fs.FileSystem.from_uri(root)
        else:
            self.store, self.root = None, re.sub(r"^file:/*", "/", root)
        self.root = self.root.rstrip("/") or "/"

    def at(self, path: str) -> str:
        return os.path.join(self.root, path) if path else self.root

    def entries(self, folder: str) -> tuple[list[str], list[tuple[str, int]]]:
        """Folders and (file, size) directly in a folder; links to folders are not followed."""
        folders, files = [], []
        if self.store is None:
            with os.scandir(self.at(folder)) as found:
                for e in found:
                    path = f"{folder}/{e.name}" if folder else e.name
                    if e.is_dir(follow_symlinks=False):
                        folders.append(path)
                    elif e.is_file():
                        files.append((path, e.stat().st_size))
        else:
            from pyarrow import fs

            for e in self.store.get_file_info(fs.FileSelector(self.at(folder))):
                path = f"{folder}/{e.base_name}" if folder else e.base_name
                if e.type == fs.FileType.Directory:
                    folders.append(path)
                elif e.type == fs.FileType.File:
                    files.append((path, e.size))
        return sorted(folders), sorted(files)

    def read(self, path: str) -> bytes:
        if self.store is None:
            with open(self.at(path), "rb") as f:
                return f.read()
        with self.store.open_input_stream(self.at(path)) as f:
            return f.read()


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        options = {k.lower(): v for k, v in options.items()}
        lines = lambda key: [x for x in options.get(key, "").split("\n") if x]
        if not options.get("path"):
            raise ValueError("path must name the root folder")
        self.root = options["path"]
        self.globs = lines("exclude")
        self.only = lines("include")
        self.wanted = int(options.get("partitions", "64"))
        self.contents = options.get("contents", "true").lower() == "true"
        self.hidden = options.get("hidden", "false").lower() == "true"
        if self.wanted < 1:
            raise ValueError("there is a partition at least")
        self.sizes: list[tuple[type, int]] = [(LessThanOrEqual, int(options["maxsize"]))] if "maxsize" in options else []
        self.sizes += [(GreaterThanOrEqual, int(options["minsize"]))] if "minsize" in options else []
        self.paths: list[tuple[str, tuple[str, ...]]] = []

    def pushFilters(self, filters: list[Filter]):
        """Takes tests of size, and of path by value, beginning or end; they decide before a file is opened."""
        for f in filters:
            column = getattr(f, "attribute", ())
            if isinstance(f, IsNotNull) and column in (("path",), ("absolute_path",)):
                continue
            if column == ("size",) and type(f) in _TESTS:
                self.sizes.append((type(f), f.value))
            elif column == ("path",) and isinstance(f, (EqualTo, StringStartsWith, StringEndsWith)):
                self.paths.append((type(f).__name__, (f.value,)))
            elif column == ("path",) and isinstance(f, In):
                self.paths.append(("EqualTo", tuple(f.value)))
            else:
                yield f

    def _rules(self) -> tuple[re.Pattern, re.Pattern, re.Pattern]:
        """What excludes a file, what excludes a whole folder, and what a file must fit."""
        one = lambda globs, none: re.compile("|".join(f"(?:{glob_regex(g)})" for g in globs) if globs else none)
        return one(self.globs, r"(?!)"), one([g[:-3] for g in self.globs if g.endswith("/**")], r"(?!)"), one(self.only, "")

    def _enters(self, folder: str, shut: re.Pattern) -> bool:
        name = folder.rsplit("/", 1)[-1]
        if shut.search(folder) or (name.startswith(".") and not self.hidden):
            return False
        for kind, values in self.paths:
            if kind in ("EqualTo", "StringStartsWith") and not any(v.startswith(folder + "/") or (kind == "StringStartsWith" and folder.startswith(v)) or (kind == "StringStartsWith" and (folder + "/").startswith(v)) for v in values):
                return False
        return True

    def _takes(self, path: str, size: int, out: re.Pattern, only: re.Pattern) -> bool:
        if (path.rsplit("/", 1)[-1].startswith(".") and not self.hidden) or out.search(path) or not only.search(path):
            return False
        tests = {"EqualTo": lambda vs: path in vs, "StringStartsWith": lambda vs: path.startswith(vs), "StringEndsWith": lambda vs: path.endswith(vs)}
        return all(_TESTS[k](size, v) for k, v in self.sizes) and all(tests[k](vs) for k, vs in self.paths)

    def partitions(self) -> list[Part]:
        """Walks from the root, breadth first, until there are some folders for each partition; the rest is walked by the tasks."""
        tree, (out, shut, only) = Tree(self.root), self._rules()
        front, files, errors, seen = [""], [], [], 0
        tree.entries("")  # a root that can't be read is an error of the query
        while front and len(front) < 8 * self.wanted and seen < 64 * self.wanted:
            inner = []
            for folder in front:
                seen += 1
                try:
                    folders, here = tree.entries(folder)
                except OSError as e:
                    errors.append((folder, f"{type(e).__name__}: {e}"))
                    continue
                inner += [f for f in folders if self._enters(f, shut)]
                files += [f for f in here if self._takes(*f, out, only)]
            front = inner
        n = max(1, min(self.wanted, len(front) + len(files)))
        files.sort(key=lambda f: (-f[1], f[0]))  # dealt out by size, so that shares are alike
        return [Part(tuple(front[k::n]), tuple(files[k::n]), tuple(errors) if k == 0 else ()) for k in range(n)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        tree, (out, shut, only) = Tree(self.root), self._rules()
        rows: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)
            rows.clear()
            return b

        rows += [(path, tree.at(path), None, None, None, error) for path, error in part.errors]
        for x in self._walk(tree, part, out, shut, only):
            path, size, error = x
            content = digest = None
            if error is None and self.contents:
                try:
                    raw = tree.read(path)
                    content, digest = raw.decode("utf-8", "replace"), hashlib.sha256(raw).hexdigest()
                except OSError as e:
                    error = f"{type(e).__name__}: {e}"
            rows.append((path, tree.at(path), size, content, digest, error))
            held += len(content or "")
            if len(rows) >= _ROWS or held >= _BYTES:
                held = 0
                yield batch()
        if rows:
            yield batch()

    def _walk(self, tree: Tree, part: Part, out: re.Pattern, shut: re.Pattern, only: re.Pattern) -> Iterator[tuple[str, int | None, str | None]]:
        """(path, size, error) of the files of a partition; a folder that can't be listed is a path without size."""
        yield from ((*f, None) for f in part.files)
        todo = list(reversed(part.folders))
        while todo:
            folder = todo.pop()
            try:
                folders, files = tree.entries(folder)
            except OSError as e:
                yield folder, None, f"{type(e).__name__}: {e}"
                continue
            todo += [f for f in reversed(folders) if self._enters(f, shut)]
            yield from ((*f, None) for f in files if self._takes(*f, out, only))


class FileTree(DataSource):
    """(path, absolute_path, size, content, hash, error) of the files under a folder.

    Options: path (the root), exclude and include (globs, one a line; a glob that ends in /** shuts whole folders, which are
    then never opened), minSize and maxSize in bytes, contents (false: list only), hidden (true: names that begin with a dot
    too), partitions. Filters on size and path are pushed down, so files that fail them are not opened either. Bytes that
    are no UTF-8 become replacement characters; hash is SHA-256 of the bytes. A file that can't be read has no content but an
    error, and so has a folder that can't be listed, which has no size.

    Spark 4.1 keeps the filters of a query on the same DataFrame for the next one that pushes none down (with
    spark.sql.python.filterPushdown.enabled): files() below always has one, others load the tree anew for each query.
    """

    @classmethod
    def name(cls) -> str:
        return "loam_files"

    def schema(self) -> str:
        return "path string, absolute_path string, size bigint, content string, hash string, error string"

    def reader(self, schema: StructType) -> TreeReader:
        return TreeReader(dict(self.options))


def files(spark: SparkSession, root: str, exclude: list[str] | None = None, include: list[str] | None = None, max_size: int | None = MAX_SIZE, min_size: int = 1, contents: bool = True, hidden: bool = False, partitions: int = 64, usual: bool = True) -> DataFrame:
    """The tree of a folder as a table (see FileTree); exclude adds to the usual folders and files that are left out, unless usual is false."""
    from loam.sources.ship import ship

    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FileTree)
    options = {"exclude": "\n".join((DEFAULT_EXCLUDES if usual else []) + (exclude or [])), "include": "\n".join(include or []), "minSize": str(min_size), "contents": str(contents).lower(), "hidden": str(hidden).lower(), "partitions": str(partitions)}
    if max_size is not None:
        options["maxSize"] = str(max_size)
    read = spark.read.format("loam_files").options(**options).load(root)
    return read.where("path is not null")  # a test that each query pushes down; without one Spark 4.1 reads with the filters of an earlier query
