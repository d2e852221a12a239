"""Tags of many texts at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def content_tags(texts: DataFrame, top: int = 10, least: int = 2) -> DataFrame:
    """(id, path, tags): lower-cased path segments, then the most used capitalised words; texts (id, path, content).

    Words are counted by a distributed aggregation, so a long text costs no more than its words.
    """
    words = F.regexp_extract_all("content", F.lit(r"(?<![A-Za-z0-9_])([A-Z][a-zA-Z]{3,})(?![A-Za-z0-9_])"), 1)
    x = texts.select("id", F.posexplode(words).alias("pos", "word"))
    counted = x.groupBy("id", "word").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first")).where(F.col("n") >= least)
    rn = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "first"))
    best = counted.withColumn("rn", rn).where(F.col("rn") <= top).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rn", F.lower("word").alias("w")))).alias("ws"))
    segments = F.transform(F.filter(F.split("path", "/"), lambda p: ~F.contains(p, F.lit(".")) & (F.length(p) > 2)), F.lower)
    found = F.coalesce(F.transform("ws", lambda s: s["w"]), F.array().cast("array<string>"))
    return texts.select("id", "path").join(best, "id", "left").select("id", "path", F.array_distinct(F.concat(segments, found)).alias("tags"))
