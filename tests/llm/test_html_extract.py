import numpy as np

from loam.llm import html_extract as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<nav><ul><li><a href=/a>Menu &amp; more</a></li></ul></nav><header>Site</header><!-- ad --><div class="ad">Buy <div>now</div> this</div>
<article class=post><header><h1>Title &eacute;&nbsp;x</h1></header><p><b>First
  para<br>goes   on<p>Second &lt;b&gt; 3 < 4<div class='share-buttons'>Share</div><pre>a
  b</pre><form>Name <input></form><section id="comments"><p>Nice!</p></section><p>Last &am</article>
<aside>Side</aside><footer>&copy; x</footer></body></html>"""


def test_blocks():
    assert "\n".join(t for k, t in H.blocks(PAGE) if k == H.MAIN) == "Title é x\nFirst para goes on\nSecond <b> 3 < 4\na b\nLast &am"
    assert H.blocks("") == []
    assert H.blocks("plain <b>text") == [(H.OTHER, "plain text")]
    assert [t for k, t in H.blocks("<div class=ad>x<article><p>kept</article>tail") if k == H.MAIN] == ["kept"]
    assert H.blocks("<p>cut <arti") == [(H.OTHER, "cut")]
    assert H.blocks("<script>never closed <p>x") == []
    assert H.blocks("<a " * 20000) is not None
    assert H.blocks('<p title="a>b">x</p><p title="un>y') == [(H.OTHER, "x"), (H.OTHER, "y")]


def brute_repeated(streams, run, pages):
    where = {}
    for k, s in enumerate(streams):
        for i in range(len(s) - run + 1):
            where.setdefault(tuple(s[i : i + run]), set()).add(k)
    out = []
    for s in streams:
        c = np.zeros(len(s), bool)
        for i in range(len(s) - run + 1):
            if len(where[tuple(s[i : i + run])]) >= pages:
                c[i : i + run] = True
        out.append(c)
    return out


def test_repeated_against_brute_force():
    rng = np.random.default_rng(0)
    for run, pages in ((2, 2), (3, 3), (4, 2)):
        streams = [rng.integers(0, 3, rng.integers(0, 12)).astype(np.uint64) for _ in range(12)]
        for a, b in zip(H.repeated(streams, run, pages), brute_repeated(streams, run, pages), strict=True):
            assert a.tolist() == b.tolist()


def test_extract(spark):
    boiler = "<p>All rights reserved by the owners of this site</p>"
    rows = [(k, "http://a.example/x", f"<div>{boiler}<p>{'abcdefghij'[k]} own {k}</p></div>") for k in range(8)]
    rows += [(20, "http://b.example/x", f"<div>{boiler}</div>"), (21, None, None), (22, "http://a.example/", ""), (23, "http://c.example/", PAGE), (23, "http://c.example/", PAGE)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as host", "3 as shard")
    for shard in (H.SHARD, 400):
        got = {r.page_id: r for r in H.extract(df, shard=shard).collect()}
        assert len(got) == 12
        assert got[20].text == "All rights reserved by the owners of this site"
        assert got[21].text == got[22].text == "" and got[21].n_chars == 0
        assert got[23].text.startswith("Title") and got[23].n_chars == len(got[23].text)
    got = {r.page_id: r.text for r in H.extract(df).collect()}
    assert got[3] == "d own 3"
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_repeats_are_found_over_the_whole_host(spark):
    run = "seven words that only four pages have"
    rows = [(k, "http://hot.example/x", f"<div><p>page {k} has {' '.join(f'w{k}x{i}' for i in range(20))}</p>" + f"<p>{run}</p>" * (k % 25 == 0) + "</div>") for k in range(100)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole, dealt = ({r.page_id: r.text for r in H.extract(df, shard=shard).collect()} for shard in (1 << 30, 400))
    assert whole == dealt and len(dealt) == 100
    assert not any(run in t for t in dealt.values()) and all(f"w{k}x19" in t for k, t in dealt.items())


def test_every_page_counts_that_has_a_stream(spark):
    chrome = "<div>the same words stand around all texts of this site</div>"
    rows = [(k, "http://a.example/x", f"{chrome}<article>article {k}</article>") for k in range(2)]
    rows += [(10, "http://a.example/y", f"{chrome}<div>main text without an article</div>")]
    rows += [(k, "http://b.example/x", f"<head><title>error {k}</title></head><p>please log in to see what is on this page</p>") for k in range(20, 23)]
    rows += [(30, "http://c.example/x", "<p>one page that is listed three times is one page</p>")] * 3
    rows += [(40, "http://d.example/x", f"{chrome}<article>article</article>"), (41, "http://d.example/y", f"{chrome}<div>too few pages</div>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for shard in (H.SHARD, 60):
        got = {r.page_id: r.text for r in H.extract(df, shard=shard).collect()}
        assert [got[k] for k in (0, 1, 10)] == ["article 0", "article 1", "main text without an article"]
        assert [got[k] for k in (20, 21, 22)] == ["", "", ""]
        assert got[30] == "one page that is listed three times is one page"
        assert got[41].startswith("the same words stand") and got[41].endswith("too few pages")


def test_weights_do_not_reach_beyond_a_stream():
    w = np.arange(1, 20, dtype=np.uint64)
    a, b, c = H.repeated([w[:5], w[10:16], w[:0]], 6, 3, np.array([9, 3, 9]))
    assert not a.any() and b.all() and not len(c)
