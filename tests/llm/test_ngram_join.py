import random
import re

import numpy as np

from loam.llm import ngram_join as N

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(t, n=3):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(docs, num=9, den=10):
    sets = [(d, shingles(t)) for d, t in docs]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, s) in enumerate(sets):
        for b, t in sets[:k]:
            if s and t and den * len(s & t) >= num * len(s | t):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets}


def corpus(seed, bases=14, copies=14):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)] + ["Ünïcode", "nbsp in", "CAPS"]
    passage = [r.choice(vocabulary) for _ in range(25)]
    docs = []
    for _ in range(bases):
        base = [r.choice(vocabulary) for _ in range(r.choice([1, 2, 3, 8, 11, 12, 13, 25, 40, 90, 200, 700]))]
        if r.random() < 0.4:
            base += passage
        docs.append(base)
        for _ in range(r.randrange(copies)):
            w = list(r.choice(docs[-3:]))
            for _ in range(r.choice([0, 1, 1, 2, 3, max(1, len(w) // 40)])):
                k = r.randrange(len(w))
                r.choice([lambda: w.__setitem__(k, r.choice(vocabulary)), lambda: w.insert(k, r.choice(vocabulary)), lambda: w.pop(k) if len(w) > 1 else None])()
            docs.append(w)
    return [(k * 7 % 1009, "".join(x + r.choice([" ", "  ", "\n", "\t"]) for x in w)) for k, w in enumerate(docs)]


def test_keys_lose_no_pair():
    docs = corpus(3, 40, 20)
    text = [t.encode() for _, t in docs]
    data, off = np.frombuffer(b"".join(text), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in text])])
    s, at = N.shingle_sets(data, off)
    sets = [set(s[x:y].tolist()) for x, y in zip(at, at[1:], strict=False)]
    assert [len(x) for x in sets] == [len(shingles(t)) for _, t in docs]
    ids = N.set_ids(s, at)
    often = np.unique(s[::7])
    for num, den in ((9, 10), (4, 5)):
        half = at[len(at) // 2]
        two = [N.points(s[x:y], at[i:j] - x, num, den, often, np.arange(len(often)) % 5) for x, y, i, j in ((0, half, 0, len(at) // 2 + 1), (half, len(s), len(at) // 2, len(at)))]
        for few, most in ((64, 2000), (3, 5), (2, 2000)):
            c = N.Trees([N.unpack(N.pack(*p)) for p in two], num, den).candidates(few, most).to_pandas()
            c = c[(c.needed == 0) | (c.enough & (c.shared >= c.needed))]
            u, v = c.u.to_numpy(), c.v.to_numpy()
            block = dict(zip(ids.tolist(), ids.tolist(), strict=True)) | dict(zip(*(x.tolist() for x in N.common.roots(u, v)), strict=True))
            assert all(ids[a] == ids[b] or block[int(ids[a])] == block[int(ids[b])] for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]))
        pairs = 0
        for a in range(len(sets)):
            for b in range(a):
                if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                    pairs += ids[a] != ids[b]
                    assert ids[a] == ids[b] or block[int(ids[a])] == block[int(ids[b])]
                    lists = [s[at[x] : at[x + 1]] for x in (a, b)]
                    p = N.count_vectors(lists)
                    assert 0 in N.RTree(p[:1], num, den).near(p[1])
        assert pairs > 100


def test_against_brute_force(spark):
    for seed, chunk in ((1, 600), (2, 3)):
        docs = corpus(seed) + [(2000, None), (2001, ""), (2002, " \n\t"), (2003, "one"), (2004, "ONE"), (2005, "one two"), (2006, None)]
        df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "'x' as set_id", "1 as n", "2 as component").repartition(5)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.join(df, chunk=chunk).collect()}
        want = brute(docs)
        assert got == want
        assert sum(d != c for d, (_, c) in want.items()) > 20


def test_empty_and_repeated(spark):
    assert N.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = N.join(spark.createDataFrame([(5, "a b c"), (5, "a b c"), (None, "a b c"), (9, "a b c")], "doc_id long, text string")).collect()
    assert sorted(((r.doc_id or -1), r.component_id) for r in rows) == [(-1, 5), (5, 5), (5, 5), (9, 5)]


def test_names_of_other_columns_clash_with_nothing(spark):
    text = " ".join(f"w{k}" for k in range(40))
    df = spark.createDataFrame([(1, text), (2, text), (3, "other words than those"), (3, "other words than those")], "doc_id long, text string").selectExpr("*", "1 as id__", "2 as hash__", "3 as `a.b`", "4 as doc", "5 as row", "6 as i")
    kept = N.one_of_each(df, 4, 5, 5)
    assert kept.columns == df.columns and sorted((r.doc_id, r["a.b"], r["row"]) for r in kept.collect()) == [(1, 3, 5), (3, 3, 5)]


def test_order_counts_the_whole_table(spark):
    r = random.Random(11)
    passages = [" ".join(f"p{k}_{i}" for i in range(9)) for k in range(300)]
    own = lambda k: " ".join(f"d{k}_{i}" for i in range(31))
    texts = [f"{own(k)} {passages[k % 300]}" if k < 1800 else own(k) for k in range(20_000)]
    r.shuffle(texts)
    order = N.frequent(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4), 5)
    shared, _ = N.shingle_sets(*N.common.utf8(N.pa.array(passages)), 5)
    key, _, _ = N.keys(*N.shingle_sets(*N.common.utf8(N.pa.array([t for t in texts if "p" in t])), 5), 4, 5, *order)
    assert len(key) > 1800 * 7 and not np.isin(key, shared).any()


def test_passages_of_few_long_documents_make_no_pairs(spark):
    r = random.Random(12)
    words = lambda name, n: " ".join(f"{name}_{i}" for i in range(n))
    long = [f"{words(f'l{g}_{k}', 2000)} {words(f'p{g}', 60)}" for g in range(25) for k in range(12)]
    texts = long + [words(f"d{k}", 6) for k in range(40_000)]
    r.shuffle(texts)
    order = N.frequent(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4), 5)
    c = N.Trees([N.points(*N.shingle_sets(*N.common.utf8(N.pa.array(long)), 5), 4, 5, *order)], 4, 5).candidates()
    assert c.num_rows < 10
