import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.llm import suffix_dedup as S


def brute(docs, w):
    seen, out = {}, {}
    texts = {d: (t or "").encode() for d, t in docs if d is not None}
    for d in sorted(texts):
        t = texts[d]
        for p in range(len(t) - w + 1):
            seen.setdefault(t[p : p + w], (d, p))
    for d, t in texts.items():
        cover = [False] * len(t)
        for p in range(len(t) - w + 1):
            if seen[t[p : p + w]] < (d, p):
                cover[p : p + w] = [True] * w
        left = bytes(c for c, x in zip(t, cover, strict=True) if not x)
        out[d] = (len(t), sum(cover), sum(c and not (k and cover[k - 1]) for k, c in enumerate(cover)), hashlib.sha256(left).hexdigest())
    return out


def corpus(seed):
    r = random.Random(seed)
    letters = "abcdé €\n"
    text = lambda n: "".join(r.choice(letters) for _ in range(n))
    passages = [text(n) for n in (3, 12, 20, 40, 90)]
    docs = []
    for k in range(120):
        t = "".join(r.choice([text(r.randrange(30)), r.choice(passages)]) for _ in range(r.randrange(8)))
        if k % 10 == 0 and docs:
            t = r.choice(docs)[1]
        docs.append(((k * 37) % 1000, t))
    return docs + [(2000, "ab" * 60), (2001, "a" * 300), (2002, None), (2003, ""), (2004, "a" * 300 + "b")]


def test_against_brute_force(spark):
    for seed, w, kmer, shard, budget in ((1, 10, 4, S.SHARD, S.induced.BUDGET), (2, 16, 8, 300, 100), (3, 7, 7, 50, 10)):
        docs = corpus(seed)
        df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 as spans", "'y' as anchor", "0 as n").repartition(5)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.dedup(df, w, kmer, shard=shard, budget=budget).collect()}
        want = brute(docs, w)
        assert sum(x[1] > 0 for x in want.values()) > 20
        assert got == want


def test_pieces_agree():
    import numpy as np

    r = random.Random(4)
    texts = ["".join(r.choice("abc") for _ in range(n)).encode() for n in (0, 5, 400, 39, 1000, 3)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    for piece in (50, 300, 10_000):
        s = S.segments(data, off, 20, 8, piece)
        windows = sorted((int(d), int(p) + k, int(a)) for d, p, n, a in zip(s["doc"], s["start"], s["n"], s["anchor"], strict=True) for k in range(n))
        assert [(d, p) for d, p, _ in windows] == [(d, p) for d, t in enumerate(texts) for p in range(len(t) - 19)]
        by_text = {}
        for d, p, a in windows:
            assert by_text.setdefault(texts[d][p : p + 20], a) == a


def test_repeated_rows_and_empty(spark):
    rows = [(1, "x" * 30 + "yz" * 20), (1, "x" * 30 + "yz" * 20), (None, "x" * 30), (5, "yz" * 20)]
    got = sorted((r.doc_id or 0, r.n_removed) for r in S.dedup(spark.createDataFrame(rows, "doc_id long, text string"), 20, 8).collect())
    assert got[0] == (0, 0) and got[1] == got[2] and got[3] == (5, 40)
    assert S.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hot_anchor_is_dealt_again():
    import numpy as np

    r = random.Random(5)
    line = bytes(r.choice(b"abcdefgh") for _ in range(12))
    texts = [bytes(r.choice(b"abcdefgh") for _ in range(40)) + line + bytes(r.choice(b"abcdefgh") for _ in range(40)) for _ in range(300)]
    texts += texts[:50]
    window, kmer = 40, 8
    which, at, n, anchor = S.split(texts, np.full(350, 7, np.uint64), np.full(350, 4), window, kmer)
    places = sorted((w, a + k) for w, a, m in zip(which.tolist(), at.tolist(), n.tolist(), strict=True) for k in range(m))
    assert places == [(w, p) for w, t in enumerate(texts) for p in range(len(t) - window + 1)]
    anchors, size = {}, {}
    for w, a, m, h in zip(which.tolist(), at.tolist(), n.tolist(), anchor.tolist(), strict=True):
        size[h] = size.get(h, 0) + m + window - 1
        for p in range(a, a + m):
            assert anchors.setdefault(texts[w][p : p + window], h) == h
    assert max(size.values()) < sum(map(len, texts)) / 8
    kept = S.split(texts, np.full(350, 7, np.uint64), np.zeros(350, np.int64), window, kmer)
    assert kept[0].tolist() == list(range(350)) and set(kept[3].tolist()) == {7}


def test_windows_beyond_the_common_prefixes(spark):
    df = spark.createDataFrame([(1, "a" * 600), (2, "b" + "a" * 600)], "doc_id long, text string")
    for f in (S.ranges, S.dedup, S.cleaned):
        with pytest.raises(ValueError, match="255"):
            f(df, window=256)
    assert {r.doc_id: r.n_removed for r in S.dedup(df, window=255).collect()} == {1: 599, 2: 600}


def test_rows_of_one_id_are_judged_each_by_its_own_text(spark):
    rng = np.random.default_rng(9)
    unit, other, third = (bytes(rng.integers(97, 123, n).astype(np.uint8)).decode() for n in (200, 600, 300))
    rows = [(1, unit + unit), (1, other), (2, third), (2, third + other[:150]), (2, third), (None, unit), (5, None), (5, unit + "!")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id or 0), r.n_bytes, r.n_removed) for r in S.dedup(df).collect())
    # doc 2's two texts: the one of the smaller hash keeps the passage that they share
    first, second = sorted([third, third + other[:150]], key=lambda t: spark.range(1).select(F.xxhash64(F.lit(t))).first()[0])
    lost = {third: 0 if first == third else 300, third + other[:150]: (0 if first != third else 300) + 150}
    assert got == sorted([(0, 200, 0), (1, 400, 200), (1, 600, 0), (2, 300, lost[third]), (2, 300, lost[third]), (2, 450, lost[third + other[:150]]), (5, 0, 0), (5, 201, 200)]), second
    kept = sorted((r.doc_id or 0, len(r.text or "")) for r in S.cleaned(df).collect())
    assert kept == sorted((d, n - r) for d, n, r in got if n - r or d == 5)


def test_names_of_other_columns_clash_with_nothing(spark):
    df = spark.createDataFrame([(1, "x" * 400, 7), (2, None, 8)], "doc_id long, text string, n long").selectExpr("*", "1 as spans", "2 as spans__", "3 as doc_id__", "4 as `a.b`", "5 as own", "6 as number", "7 as h", "8 as row")
    (one, two) = sorted(S.cleaned(df).collect(), key=lambda r: r.doc_id)
    assert one.text == "x" and (one["spans__"], one["a.b"], one["row"], one["n"]) == (2, 4, 8, 7) and two.text is None and S.cleaned(df).columns == df.columns
    assert S.dedup(df).count() == 2
