import hashlib
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline as P
import test_decontamination as TD
import test_ngram_join as TN

SF = "/root/testdata/sf0.001"


def brute_cut(docs, w):
    seen = {}
    for d in sorted(docs):
        t = docs[d].encode()
        for p in range(len(t) - w + 1):
            seen.setdefault(hashlib.md5(t[p : p + w]).digest(), (d, p))
    out = {}
    for d, text in docs.items():
        t = text.encode()
        cover = bytearray(len(t))
        for p in range(len(t) - w + 1):
            if seen[hashlib.md5(t[p : p + w]).digest()] < (d, p):
                cover[p : p + w] = b"\1" * w
        left = bytes(c for c, x in zip(t, cover, strict=True) if not x).decode("utf-8", "ignore")
        if left or not t:
            out[d] = left
    return out


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clash = docs.withColumn("text", docs.text)
    columns = docs.columns
    names = [n for n, _ in P.STAGES]
    assert names == ["language_id", "ngram_jaccard_join", "suffix_array_dedup", "benchmark_decontamination", "best_fit_packing"]
    before = {r.doc_id: r.text for r in docs.collect()}

    one = P.common.written(P.language_id(spark, clash, SF), "t1")
    kept = {r.doc_id: r.text for r in one.collect()}
    assert one.columns == columns and len(before) * 0.97 <= len(kept) <= len(before)

    two = P.common.written(P.ngram_jaccard_join(spark, one, SF), "t2")
    sets = {d: TN.shingles(t, 5) for d, t in kept.items()}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            s, t = sets[a], sets[b]
            if s and t and min(len(s), len(t)) * 5 >= 4 * max(len(s), len(t)) and 5 * len(s & t) >= 4 * len(s | t):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    rest = {r.doc_id: r.text for r in two.collect()}
    assert rest == {d: kept[d] for d in ids if find(d) == d} and two.columns == columns

    three = P.common.written(P.suffix_array_dedup(spark, two, SF), "t3")
    cut = {r.doc_id: r.text for r in three.collect()}
    assert cut == brute_cut(rest, 100)
    assert all(r.n_chars == len(r.text) for r in three.collect()) and dict(three.dtypes) == dict(docs.dtypes)

    four = P.common.written(P.benchmark_decontamination(spark, three, SF), "t4")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    judged = TD.brute(list(cut.items()), items, 13)
    assert {r.doc_id for r in four.collect()} == {d for d in cut if not judged[d][4]}

    five = P.best_fit_packing(spark, four, SF)
    rows = five.collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in four.collect()}
