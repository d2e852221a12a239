import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from loam.llm import decontamination as D
from loam.llm.suffix import FMIndex, suffix_array

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute(docs, items, window):
    out = {}
    grams = {}
    for i, t in items:
        w = WORD.findall(lower(t))
        for k in range(max(1, len(w) - window + 1)) if w else ():
            grams.setdefault(tuple(w[k : k + window]), set()).add(str(i))
    sizes = {len(g) for g in grams}
    for d, t in docs:
        w = WORD.findall(lower(t))
        hit, ids = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in grams:
                    hit |= set(range(k, k + n))
                    ids |= grams[tuple(w[k : k + n])]
        out[d] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def test_suffix_array_and_index():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 50, 400):
        x = rng.integers(1, 4, n)
        s = x.tolist()
        assert suffix_array(x).tolist() == sorted(range(n), key=lambda k: s[k:])
        f = FMIndex(x, 4, sample=3)
        pats = np.array([[a, b, c] for a in range(1, 4) for b in range(1, 4) for c in (0, 1, 2, 3)])
        lengths = (pats > 0).sum(1)
        lo, hi = f.search(pats, lengths)
        for p, m, a, b in zip(pats.tolist(), lengths, lo, hi, strict=True):
            want = [k for k in range(n - m + 1) if s[k : k + m] == p[:m]]
            assert sorted(f.locate(np.arange(a, b)).tolist()) == want


def test_against_brute_force(spark):
    r = random.Random(5)
    words = ["Alpha", "beta", "gamma9", "délta", "e", "zeta", "ÉTA", "x_y"]
    text = lambda n: "".join(r.choice(words) + r.choice([" ", ", ", "\n", "_", "  "]) for _ in range(n))
    items = [(k, text(r.choice([0, 1, 2, 4, 9, 15]))) for k in range(1, 12)] + [(50, None), (51, ""), (7, text(6)), (60, "only one-")]
    docs = [(k, text(r.choice([0, 1, 3, 30, 80]))) for k in range(60)] + [(100, None), (101, ""), (102, items[3][1]), (102, items[3][1]), (103, "zz " * 400 + text(9))]
    for window, shard in ((4, 30), (13, 10**6)):
        got = D.digest(D.scan(spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 as items", "2 as n_words").repartition(3), spark.createDataFrame(items, "item_id long, text string"), window, shard_words=shard)).collect()
        assert len(got) == len(docs)
        want = brute(docs, items, window)
        assert any(w[4] for w in want.values())
        for g in got:
            assert (g.n_words, g.n_hit, g.n_items, g.items_sha256, g.contaminated) == want[g.doc_id], g
            data = (dict(docs)[g.doc_id] or "").encode()
            assert sum(len(WORD.findall(lower(data[s.start : s.end].decode()))) for s in g.spans) == g.n_hit
            D.removed(data, [(s.start, s.end) for s in g.spans]).decode()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert D.scan(none, items).count() == 0
    got = D.digest(D.scan(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), items)).first()
    assert (got.n_words, got.n_hit, got.n_items, got.contaminated) == (2, 0, 0, False)


def test_parts_and_items_without_id(spark):
    r = random.Random(8)
    text = lambda n: " ".join(r.choice("abcdefghijklmnopqrstuvwxyz") + r.choice("xyz") for _ in range(n))
    items = [(f"i{k}", text(r.choice([3, 14, 20, 40]))) for k in range(12)]
    docs = [(k, text(40) + " " + r.choice(items)[1] * r.randrange(2) + " " + text(r.choice([0, 300]))) for k in range(40)] + [(40, None)]
    items = items + [(None, items[0][1]), (None, items[1][1]), (None, text(20))]
    d = spark.createDataFrame([*docs, (None, items[0][1])], "doc_id long, text string").withColumn("items", F.lit("x")).repartition(3)
    b = spark.createDataFrame(items, "item_id string, text string")
    one, many = (sorted(map(str, D.digest(D.scan(d, b, part_bytes=n)).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans").collect())) for n in (1 << 20, 200))
    assert one == many
    plain = {r.doc_id: r for r in D.digest(D.scan(d, b.where("item_id is not null"))).collect() if r.doc_id is not None}
    for r in D.digest(D.scan(d, b)).collect():
        if r.doc_id is not None:
            assert (r.n_hit, r.items_sha256, r.n_items - (None in r["items"])) == (plain[r.doc_id].n_hit, plain[r.doc_id].items_sha256, plain[r.doc_id].n_items)
    assert any(None in r["items"] for r in D.scan(d, b).collect())
    left = D.clean(d, b)
    assert left.columns == d.columns and left.count() == D.digest(D.scan(d, b)).where("not contaminated").count() < d.count()
