"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_standing: dict[str, SparkSession] = {}


def folder(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir, which is deleted when the program ends; one of our own only where that is unset, and only on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.gettempdir() + "/loam-shared"
    path = f"{root}/loam/{name}-{uuid.uuid4().hex}"
    _standing[path] = spark
    return path


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a table into the shared folder and read it again."""
    path = folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._loam_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def free(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more, as their successors stand."""
    for t in tables:
        path = getattr(t, "_loam_path", None)
        if path in _standing:
            delete(_standing.pop(path), path)


def _at_exit() -> None:
    for path, spark in list(_standing.items()):
        with contextlib.suppress(Exception):  # the session may be gone; the cluster's own cleaning takes the folder
            delete(spark, path)


atexit.register(_at_exit)
