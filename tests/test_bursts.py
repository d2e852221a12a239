import random
from datetime import UTC, datetime, timedelta

from pyspark.sql import functions as F

from loam.streaming import watch

START = datetime(2024, 1, 1, tzinfo=UTC)


def brute(times, gap):
    out = []
    for t in sorted(times):
        if out and t - out[-1][1] <= gap:
            out[-1][1], out[-1][2] = t, out[-1][2] + 1
        else:
            out.append([t, t, 1])
    return sorted((a, b + gap, n) for a, b, n in out)


def got(spark, times, gap):
    rows = [(START + timedelta(milliseconds=t), f"f{t}") for t in times]
    b = watch.bursts(spark.createDataFrame(rows, "ts timestamp, filename string"), f"{gap} milliseconds")
    ms = lambda c: F.unix_millis(c) - int(START.timestamp() * 1000)
    found = b.select(ms("start").alias("a"), ms("end").alias("b"), "events", "filename").collect()
    assert all(r.filename == f"f{r.b - gap}" for r in found)  # its last file
    return sorted((r.a, r.b, r.events) for r in found)


def test_stretches_change_no_burst(spark, monkeypatch):
    rng = random.Random(4)
    for span, gap, far in ((1, 10, 12), (3, 10, 30), (4, 7, 15), (4096, 10, 60)):
        monkeypatch.setattr(watch, "SPAN", span)
        times, t = [], 0
        for _ in range(400):
            t += rng.choice([0, 1, gap - 1, gap, gap + 1, rng.randint(0, far), span * gap])
            times.append(t)
        assert got(spark, times, gap) == brute(times, gap)


def test_one_burst_over_many_stretches(spark, monkeypatch):
    monkeypatch.setattr(watch, "SPAN", 2)
    times = list(range(0, 3000, 10))
    assert got(spark, times, 10) == [(0, 3000, 300)]
    none = spark.createDataFrame([(None, "x")], "ts timestamp, filename string")
    assert watch.bursts(none).count() == 0 and watch.bursts(none.where("false")).count() == 0


def test_filters_on_ends_come_after_merging(spark, monkeypatch):
    monkeypatch.setattr(watch, "SPAN", 4)
    rows = [(START + timedelta(milliseconds=t), "f") for t in (0, 8, 16, 100, 108)]
    b = watch.bursts(spark.createDataFrame(rows, "ts timestamp, filename string"), "10 milliseconds")
    assert [r.events for r in b.where(F.col("start") >= F.lit(START + timedelta(milliseconds=8))).collect()] == [2]
    assert [r.events for r in b.where(F.col("end") <= F.lit(START + timedelta(milliseconds=30))).collect()] == [3]
