"""Tables that change together: a build writes its own folder, and one small file, written last, makes it the current one.

Under a root are `versions/<number>-<random>/<table>` and `commits/<number>.json`, which names the place of every table. A
table that a build doesn't write stays where it is and is named again, so nothing is copied. A build that dies before
its commit changes nothing for readers; what it wrote goes with a later build's cleaning. Of two builds begun on the same
version the second to commit fails, as a commit file is never overwritten.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

KEPT = 2  # versions that stay after a commit, so that readers of the one before can finish


class ConcurrentBuild(RuntimeError):
    """Another build has committed since this one began."""


class Store:
    """Few small files and folders in any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self.fs = self.at("").getFileSystem(self.conf)

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))

    def names(self, folder: str) -> list[str]:
        path = self.at(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(path)] if self.fs.exists(path) else []

    def read(self, name: str) -> str:
        at = self.fs.open(self.at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(at, "UTF-8")
        finally:
            at.close()

    def create(self, name: str, text: str) -> bool:
        """False if the file is there already."""
        if self.fs.exists(self.at(name)):
            return False
        try:
            out = self.fs.create(self.at(name), False)
        except Exception as e:  # another was faster
            if "AlreadyExists" in str(e):
                return False
            raise
        try:
            out.write(text.encode())
        finally:
            out.close()
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


@dataclass(frozen=True)
class Version:
    """What one commit names: the place of each table under the root."""

    number: int
    tables: dict[str, str] = field(default_factory=dict)
    about: dict[str, str] = field(default_factory=dict)


class Versions:
    """The versions of the tables under a root."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.store = spark, Store(spark, root)

    def all(self) -> list[Version]:
        """In order of number. A commit file that was not written to its end is none."""
        out = []
        for name in self.store.names("commits"):
            if name.endswith(".json") and name[:-5].isdigit():
                try:
                    told = json.loads(self.store.read(f"commits/{name}"))
                    out.append(Version(int(name[:-5]), told["tables"], told["about"]))
                except (ValueError, KeyError):
                    continue
        return sorted(out, key=lambda v: v.number)

    def current(self) -> Version | None:
        return max(self.all(), key=lambda v: v.number, default=None)

    def path(self, version: Version | None, name: str) -> str | None:
        """The whole path of a table of a version; None if it has none."""
        return None if version is None or name not in version.tables else f"{self.store.root}/{version.tables[name]}"

    def read(self, name: str, number: int | None = None) -> DataFrame | None:
        """A table of the current version, or of the one with that number."""
        found = self.current() if number is None else next((v for v in self.all() if v.number == number), None)
        path = self.path(found, name)
        return None if path is None else self.spark.read.parquet(path)

    def begin(self) -> Build:
        return Build(self)

    def clean(self, keep: int = KEPT) -> None:
        """Delete commits but the last few, and folders begun before the current version that no remaining commit names."""
        kept = self.all()[-keep:]
        used = {p.split("/")[1] for v in kept for p in v.tables.values()}
        last = kept[-1].number if kept else 0
        for name in self.store.names("commits"):
            if name[:-5].isdigit() and kept and int(name[:-5]) < kept[0].number:
                self.store.delete(f"commits/{name}")
        for name in self.store.names("versions"):
            if name not in used and int(name.split("-")[0]) <= last:
                self.store.delete(f"versions/{name}")

    def export(self, to: str, level: int = 3) -> list[str]:
        """A bundle of the current version: every table, compressed by zstd, under a folder that has only these, readable once its list is there."""
        now, target = self.current(), Store(self.spark, to)
        if now is None:
            raise ValueError("nothing was built yet")
        if target.names(""):
            raise FileExistsError(to)
        for name in sorted(now.tables):
            df = self.spark.read.parquet(self.path(now, name))
            df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).parquet(f"{target.root}/{name}")
        target.create("bundle.json", json.dumps({"tables": sorted(now.tables), "about": now.about}))
        return sorted(now.tables)

    def load(self, bundle: str) -> Version:
        """The tables of a bundle, as a new version."""
        source, build = Store(self.spark, bundle), self.begin()
        if "bundle.json" not in source.names(""):
            raise ValueError(f"no whole bundle: {bundle}")
        told = json.loads(source.read("bundle.json"))
        for name in told["tables"]:
            build.write(self.spark.read.parquet(f"{source.root}/{name}"), name)
        return build.commit({**told["about"], "loaded": "true"})


class Build:
    """One version in the making: reads see what it has written, else what was current when it began."""

    def __init__(self, versions: Versions) -> None:
        self.versions, self.base = versions, versions.current()
        claimed = [int(n[:-5]) for n in versions.store.names("commits") if n[:-5].isdigit()]
        self.number = max(claimed, default=0) + 1  # past those that were not written to their end
        self.folder = f"versions/{self.number}-{uuid.uuid4().hex}"
        self.tables: dict[str, str] = {}

    def path(self, name: str) -> str:
        """Where a table of this build goes, for those who write by themselves."""
        self.tables[name] = f"{self.folder}/{name}"
        return f"{self.versions.store.root}/{self.tables[name]}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table, which may be made from its predecessor; returns what was written."""
        path = f"{self.versions.store.root}/{self.folder}/{name}"
        df.write.mode("overwrite").parquet(path)
        self.path(name)
        return self.versions.spark.read.parquet(path)

    def read(self, name: str) -> DataFrame | None:
        if name in self.tables:
            return self.versions.spark.read.parquet(f"{self.versions.store.root}/{self.tables[name]}")
        path = self.versions.path(self.base, name)
        return None if path is None else self.versions.spark.read.parquet(path)

    def commit(self, about: dict[str, str] | None = None, keep: int = KEPT) -> Version:
        """Make this the current version, at once and for all its tables."""
        tables = {**(self.base.tables if self.base else {}), **self.tables}
        if not self.versions.store.create(f"commits/{self.number:012d}.json", json.dumps({"tables": tables, "about": about or {}})):
            raise ConcurrentBuild(f"version {self.number} of {self.versions.store.root} is there already")
        self.versions.clean(keep)
        return Version(self.number, tables, about or {})
