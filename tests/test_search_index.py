import random
import re

from pyspark.sql import functions as F

from loam.operators import rank, search_index

SCHEMA = "ord long, path string, type string, content string, tags array<string>"
VOCABULARY = ["alpha", "alphabet", "beta", "bet", "gamma", "Delta", "in.ner", "naïve", "x", "the", "then", "other"]


def artifacts(spark, n, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(VOCABULARY) if rng.random() < 0.7 else f"w{rng.randrange(40)}"
    text = lambda: rng.choice(["# ", "", "## Title "]) + "".join(word() + rng.choice([" ", "\n", "\t", " | ", ",", ""]) for _ in range(rng.randrange(60)))
    rows = [(k, f"src/{word()}/{word()} {k % 5}.md", f"kind{k % 3}", None if k % 17 == 0 else text(), [word(), word().upper()][: k % 3]) for k in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def same(index, a, query, kind, limit):
    score = F.round("score", 9)
    want = [tuple(r) for r in rank.search(a, query, kind, limit).select("ord", "path", "type", score, "snippet").collect()]
    got = [tuple(r) for r in index.search(query, kind, limit).select("ord", "path", "type", score, "snippet").collect()]
    assert got == want, (query, kind, limit)
    return len(want)


def test_as_the_scan_ranks(spark, tmp_path):
    a = artifacts(spark, 300, 3).repartition(3)
    search_index.build(a, str(tmp_path / "i"), share=50)  # several shares of a term
    index, found = search_index.Index(spark, str(tmp_path / "i")), 0
    for query, kind, limit in (("alpha", None, 10), ("bet the", None, 7), ("ALPHABET w3", "kind1", 20), ("alpha alpha  zzz", None, 5), ("x", "all", 400), ("in.ner naïve", None, 10), ("src/alpha", None, 10), ("betatron", None, 10), ("nowhere", None, 10)):
        found += same(index, a, query, kind, limit)
    assert found > 100
    assert index.search("  ").count() == 0 and index.search("  ").columns == ["ord", "path", "type", "score", "snippet"] and index.search("zzz", snippets=False).columns == ["ord", "path", "type", "score"]


def test_blocks_are_left_out(spark, tmp_path):
    filler = [(k, f"p{k}", "m", ("rare " if k % 2 else "common ") * (1 + k % 9) + "word " * 300, []) for k in range(3000)]
    best = [(9000 + k, f"rare-{k}", "m", "# rare\n" + "rare " * 90, []) for k in range(20)]
    a = spark.createDataFrame(filler + best, SCHEMA)
    search_index.build(a, str(tmp_path / "i"))
    index = search_index.Index(spark, str(tmp_path / "i"))
    words = ["rare"]
    told = index.words(words)
    assert told[0]["terms"] > 1  # paths hold it within longer terms
    same(index, a, "rare", None, 5)
    (told,) = ([t] for t in index.words(["common"]))
    assert told[0]["terms"] == 1 and told[0]["rows"] == 1500
    few = [(k, f"q{k}", "m", ("term " * (600 if k < 12 else 1)) + "fill " * 500, []) for k in range(2000)]
    b = spark.createDataFrame(few, SCHEMA)
    search_index.build(b, str(tmp_path / "j"))
    other = search_index.Index(spark, str(tmp_path / "j"))
    told = other.words(["term"])
    least = other._bounds(["term"], told, [told[0]["rows"]], None, 3)
    read = other._postings(["term"], told, least).count()
    assert told[0]["terms"] == 1 and 12 <= read < 1000
    same(other, b, "term", None, 3)


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    search_index.build(none, str(tmp_path / "e"))
    index = search_index.Index(spark, str(tmp_path / "e"))
    assert index.search("anything at all").count() == 0


def shuffled(spark, what):
    """Bytes that what() shuffles."""
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark.sparkContext._jsc.sc().statusStore()
    def written():
        bus.waitUntilEmpty(30_000)
        return sum(store.executorList(False).apply(k).totalShuffleWrite() for k in range(store.executorList(False).size()))

    before = written()
    what()
    return written() - before


def test_postings_are_not_shuffled(spark, tmp_path):
    rng = random.Random(12)
    rows = [(k, f"p{k}", f"kind{k % 3}", " ".join(f"w{rng.randrange(400)}" for _ in range(150)), []) for k in range(2000)]
    a = spark.createDataFrame(rows, SCHEMA)
    assert shuffled(spark, lambda: search_index.build(a, str(tmp_path / "i"))) < 6 * len(rows) * 150  # a few bytes a term, the texts with it
    index = search_index.Index(spark, str(tmp_path / "i"))
    assert same(index, a, "w17 w300", "kind1", 20) == 20


def test_a_term_that_holds_a_word_twice(spark, tmp_path):
    rows = [(k, f"p{k}", "m", "fill " * (30 + k) + ("abab " if k < 40 else "ab-ab " if k < 60 else ""), []) for k in range(400)]
    a = spark.createDataFrame(rows, SCHEMA)
    search_index.build(a, str(tmp_path / "i"))
    index = search_index.Index(spark, str(tmp_path / "i"))
    for query in ("abab", "aba", "ab", "b-a fill", "ab-ab", "l f", "fil"):
        same(index, a, query, None, 7)


def test_terms_of_an_artifact(spark):
    texts = ["a b a\x01 a", "# b a\n\x00 a\x00 a a\x011 ab a-b", "", "x\x0by  \tz", "one line alone " * 3, "\x010 a\x080 1 0", "naïve 日本 naïve \U0001f600"]
    rng = random.Random(4)
    texts += ["".join(rng.choice(["a", "b", "\x01", "\x00", "0", "1", " ", "\t", "\n"]) for _ in range(rng.randrange(40))) for _ in range(300)]
    rows = [(t, rng.choice(texts).replace("\n", " "), rng.choice(["src/a", "a", "a b/b a", "a\x01/a", ""]), rng.choice([[], ["a"], ["a b", "b"], ["a\x01"]])) for t in texts]
    got = spark.createDataFrame(rows, "c string, t string, p string, g array<string>").select("*", search_index._counted(*[F.col(k) for k in "ctpg"]).alias("x")).collect()
    for r in got:
        want = {}
        for text, k in ((r.c, 0), (r.t, 1), (r.p, 2), (r.p.split("/")[-1], 4), (" ".join(r.g), 8)):
            for term in re.split(r"[ \t\n\x0B\f\r]+", text):
                if term:
                    hits, where = want.get(term, (0, 0))
                    want[term] = (hits + (k == 0), where | k)
        found = [x for x in r.x if x is not None]
        assert {x.term: (x.hits, x.where) for x in found} == want and len(found) == len(want), r


def test_texts_are_not_shuffled(spark, tmp_path):
    rng = random.Random(15)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(400)) for _ in range(60)]
    a = spark.createDataFrame([((k * 37) % 200, f"p{k}", "m", " ".join(rng.choice(words) for _ in range(100)), []) for k in range(200)], SCHEMA)
    assert shuffled(spark, lambda: search_index.build(a, str(tmp_path / "i"))) < 500_000  # the texts are 8 MB, their terms 24 kB
    index = search_index.Index(spark, str(tmp_path / "i"))
    assert same(index, a, f"{words[0]} {words[1][:30]}", None, 10) == 10


def test_tags_are_not_shuffled(spark, tmp_path):
    tags = [["One", "one", "two"], ["x" * 200], [], [], ["other"]]
    a = spark.createDataFrame([(k, "p", "m", "text", tags[k % 5]) for k in range(20_000)], SCHEMA)
    assert shuffled(spark, lambda: search_index.build(a, str(tmp_path / "i"))) < 10_000
    index = search_index.Index(spark, str(tmp_path / "i"))
    assert sorted(map(tuple, index._read("tags").where("ord < 5").select("ord", "tag", "n").collect())) == [(0, "one", 2), (0, "two", 1), (1, "x" * 200, 1), (4, "other", 1)]
    assert same(index, a, "one text", None, 10) == 10
