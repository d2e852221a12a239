import hashlib
import random
import zlib

from loam.llm import periodic as P
from loam.llm import queries


def brute(w, least=P.LEAST, times=P.TIMES):
    """Maximal stretches of every period, the smallest period of each."""
    out = {}
    for p in range(1, len(w) // times + 1):
        i = 0
        while i + p < len(w):
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i + p - s >= max(least, times * p) and i > s:
                out.setdefault((s, i + p), p)
            i += 1
    return sorted(((s, e, p) for (s, e), p in out.items()), key=lambda r: (r[0], r[2]))


def planted(rng):
    letters = rng.randint(1, 5)
    w = [rng.randrange(letters) for _ in range(rng.randint(0, 120))]
    for _ in range(rng.randint(0, 4)):
        at = rng.randint(0, len(w))
        unit = [rng.randrange(letters) for _ in range(rng.randint(1, 12))] * rng.randint(2, 9)
        w[at:at] = unit[: len(unit) - rng.randint(0, 3)] if rng.random() < 0.6 else w[at : at + 40] * rng.randint(1, 3)
    return w[:500]


def test_factors_are_the_longest_earlier_ones():
    rng = random.Random(4)
    for _ in range(60):
        w, i, want = planted(rng)[:150], 0, []
        while i < len(w):
            k = 0
            while i + k < len(w) and any(w[j : j + k + 1] == w[i : i + k + 1] for j in range(i)):
                k += 1
            want.append((i, max(k, 1)))
            i += max(k, 1)
        found = P.factors(w)
        assert [f[:2] for f in found] == want
        assert all(at < s and w[at : at + n] == w[s : s + n] for s, n, at in found if at >= 0)


def test_runs_against_brute_force():
    rng, seen = random.Random(5), 0
    for _ in range(400):
        w = planted(rng)
        for least, times in ((24, 3), (2, 2), (9, 3)):
            want = brute(w, least, times)
            seen += len(want)
            assert P.runs(w, least, times) == want
            assert P.text_runs([b"%d" % x for x in w], least, times) == want
    assert seen > 10_000


def test_long_periods():
    rng = random.Random(6)
    unit = [rng.randrange(2000) for _ in range(3000)]
    w = [-1, *unit * 3, *unit[:7], -2, *unit[:100], *[5] * 40]
    assert P.runs(w) == [(1, 9008, 3000), (9109, 9149, 1)] == [r for r in P.text_runs([str(x).encode() for x in w])]


def digest(doc, text):
    w = (text or "").encode().replace(b"\v", b" ").split()
    h = zlib.crc32(str(doc).encode())
    if doc is not None and h % 10 == 0 and w:
        a = h // 10 % len(w)
        p = 1 + (len(w) - a) // (3 + h // 10 % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    found = brute(w)
    drop = {i for s, e, p in found for i in range(s + p, e)}
    best = min(found, key=lambda r: (-(r[1] - r[0]) / r[2], r[0], r[2])) if found else None
    told = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{e - s},{p}\n" for s, e, p in found)
    return (doc, len(found), *told, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in drop)).hexdigest())


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(7)
    texts = [" ".join(f"w{x}" for x in planted(rng)) for _ in range(150)]
    rows = [*enumerate(texts), (500, None), (501, ""), (502, " \t\v\f\r\n"), (503, "a b " * 30), (504, "x" * 100_000), (505, "ab\tcd\n" * 5000), (506, "same " * 23), (507, "same " * 24), (None, "q r " * 20), (3, texts[3]), (3, texts[4])]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as start", "2 as `n.runs`").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(str, (tuple(r) for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect())))
    assert got == sorted(str(digest(*r)) for r in rows)
    full = {r.doc_id: r for r in P.detect(spark.createDataFrame(rows, "doc_id long, text string"), keep=True).collect()}
    assert [tuple(x) for x in full[505].runs] == [(0, 10_000, 2)] and bytes(full[505].collapsed) == b"ab cd" and full[506].runs == [] and full[507].collapsed == b"same"
    assert P.detect(spark.createDataFrame([], "doc_id long, text string")).count() == 0
