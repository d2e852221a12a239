"""Main text of web pages: markup roles, and a suffix array over each host's token streams.

A page is cut into blocks. Markup tells some apart: inside an article or main element, inside what can only be page
furniture (menus, forms, adverts, comments, ...), or neither. The token streams of what stands outside articles are
concatenated for each host and their suffixes sorted; runs of at least RUN tokens that recur on at least PAGES different
pages of the host (by their whole html) are boilerplate, and the tokens they cover go. Furniture goes whole; an article stays whole, as a copy of
an article is no boilerplate. If a page has an article, what stands outside of it is not the main text.

Pages are parsed where they are read. A host's distinct streams, each with the number of distinct pages that have it,
are dealt into shards of about SHARD bytes by a hash, so a hot host is many tasks. Each shard sorts its suffixes; what it counts for each run is summed over all shards of the host,
and every shard is told which of its runs reach PAGES in the whole host.
"""

from __future__ import annotations

import hashlib
import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .suffix import suffix_array
from .url_filter import split_url

RUN = 6
PAGES = 3
SHARD = 1 << 20
#: Hosts of more than a shard whose list is broadcast, and bytes of covers; more are joined by a shuffle.
FEW_HOSTS = 50_000
FEW_BYTES = 4 << 20

#: Elements whose content is never text of the page.
RAW = frozenset("script style noscript template textarea title iframe object svg math canvas audio video head".split())
#: Elements that are page furniture, wherever they stand; a header only outside an article.
FURNITURE = frozenset("nav footer aside form menu dialog select button datalist".split())
#: Words of class, id or role that mark page furniture.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe subscription signup sidebar widget widgets nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer masthead "
    "comment comments commentlist disqus replies respond share sharing social related recommended toolbar search login complementary contentinfo".split()
)
#: Words of class, id or role that mark the main text.
CONTENT = frozenset("article content main post entry story".split())
BLOCK = frozenset(
    "p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table thead tbody tfoot tr td th caption blockquote pre section article main header footer nav aside form fieldset figure "
    "figcaption address hr body html details summary center menu dialog legend option".split()
)
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?/][^a-zA-Z>][^>]*+(?:>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+)(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
_NAMES = re.compile(r"(?:^|[\s\"'/])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=/]|$)|display\s*:\s*none", re.I)
_CLOSE = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for n in RAW}
MAIN, OTHER, OFF = 2, 1, 0


def _marks(attributes: str, words: frozenset[str]) -> bool:
    for m in _NAMES.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            parts = re.split(r"[_\-]+", name)
            if any(w in words and not (k and parts[k - 1] in ("has", "with", "no", "without")) for k, w in enumerate(parts)):
                return True
    return False


def blocks(page: str) -> list[tuple[int, str]]:
    """[(kind, text)] of all blocks with text, in page order; unclosed elements end with the page."""
    out: list[tuple[int, str]] = []
    held: list[str] = []
    off_tag, off_depth, main_tag, main_depth = "", 0, "", 0

    def flush() -> None:
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                out.append((OFF if off_tag else MAIN if main_tag else OTHER, text))

    pos, n = 0, len(page)
    while pos < n:
        m = _TAG.search(page, pos)
        end = m.start() if m else n
        if end > pos:
            raw = page[pos:end]
            held.append(entities.unescape(raw) if "&" in raw else raw)
        if not m:
            break
        pos = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in RAW and not closing:
            if not attributes.rstrip().endswith("/") or tag not in ("svg", "math"):
                found = _CLOSE[tag].search(page, pos)
                body = re.compile(r"<body[\s>]", re.I).search(page, pos) if tag == "head" and not found else None
                pos = found.end() if found else body.start() if body else n
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag in BLOCK:
            flush()
        if tag in VOID:
            continue
        if off_tag:
            if tag == off_tag:
                off_depth += -1 if closing else 1
                if not off_depth:
                    flush()
                    off_tag = ""
            elif tag in ("article", "main") and not closing and not main_tag:  # furniture was left open
                flush()
                off_tag, main_tag, main_depth = "", tag, 1
            elif main_tag and closing and tag == main_tag and tag in ("article", "main"):
                flush()
                off_tag, main_tag = "", ""
            continue
        if closing:
            if tag == main_tag:
                main_depth -= 1
                if not main_depth:
                    flush()
                    main_tag = ""
            continue
        if tag in ("html", "body"):
            continue
        if tag in FURNITURE or (tag == "header" and not main_tag) or (attributes and tag not in ("article", "main") and (_marks(attributes, MARKS) or _HIDDEN.search(attributes))):
            flush()
            off_tag, off_depth = tag, 1
        elif main_tag:
            main_depth += tag == main_tag
        elif tag in ("article", "main") or (tag in ("div", "section") and attributes and _marks(attributes, CONTENT)):
            flush()
            main_tag, main_depth = tag, 1
    flush()
    return out


class Runs:
    """All runs of `run` words in some distinct streams of word hashes, in the order of their suffix array."""

    def __init__(self, streams: list[np.ndarray], run: int = RUN):
        self.run, self.streams = run, len(streams)
        self.size = np.array([len(s) for s in streams], np.int64)
        self.words = np.concatenate([np.zeros(0, np.uint64), *streams])
        _, ids = np.unique(self.words, return_inverse=True)
        self.first = np.concatenate([[0], np.cumsum(self.size + 1)])
        x = np.empty(len(ids) + len(streams), np.int64)
        stops = self.first[1:] - 1
        body = np.ones(len(x), bool)
        body[stops] = False
        x[body] = ids + len(streams)
        x[stops] = np.arange(len(streams))  # every stream ends in a symbol of its own
        stream = np.repeat(np.arange(len(streams)), self.size + 1)
        sa = suffix_array(x)
        self.start = sa[stops[stream[sa]] - sa >= run]  # a run that goes beyond its stream is none
        self.stream = stream[self.start]
        fresh = np.ones(len(self.start), bool)
        if len(fresh):
            fresh[1:] = np.any([x[self.start[1:] + k] != x[self.start[:-1] + k] for k in range(run)], axis=0)
        self.fresh, self.group = fresh, np.cumsum(fresh) - 1

    def count(self, weights: np.ndarray) -> np.ndarray:
        """For each group of equal runs: the sum of the weights of the streams that have it."""
        pair = np.unique(self.group * self.streams + self.stream)
        out = np.zeros(int(self.fresh.sum()), np.int64)
        np.add.at(out, pair // max(self.streams, 1), weights[pair % max(self.streams, 1)])
        return out

    def keys(self) -> np.ndarray:
        """A 64-bit hash of the words of each group's run."""
        at = (self.start - self.stream)[self.fresh]
        h = np.zeros(len(at), np.uint64)
        for k in range(self.run):
            h = common.mix(h + self.words[at + k]) * common.powers(2)[1]
        return h

    def covered(self, often: np.ndarray) -> list[np.ndarray]:
        """For each stream: which of its words lie in a run of one of these groups."""
        start = self.start[often[self.group]]
        cover = np.zeros(int(self.first[-1]) + 1, np.int64)
        cover[start] += 1
        np.add.at(cover, start + self.run, -1)
        cover = np.cumsum(cover) > 0
        return [cover[self.first[k] : self.first[k] + self.size[k]] for k in range(self.streams)]


def repeated(streams: list[np.ndarray], run: int = RUN, pages: int = PAGES, weights: np.ndarray | None = None) -> list[np.ndarray]:
    """For each distinct stream of word hashes: which of its words lie in a run that `pages` different pages have.

    The weight of a stream is the number of its pages, 1 if none are given.
    """
    r = Runs(streams, run)
    return r.covered(r.count(np.ones(len(streams), np.int64) if weights is None else weights) >= pages)


def _rest(page: list[tuple[int, str]]) -> str:
    """What stands outside articles, a block a line."""
    return "\n".join(t for k, t in page if k != MAIN)


def _stream(rest: str) -> np.ndarray:
    """Its word hashes."""
    text = rest.encode("utf-8", "replace")
    return common.word_hashes(np.frombuffer(text, np.uint8), np.array([0, len(text)]), common.SPACE)[0]


def _hash64(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)


def main_text(page: list[tuple[int, str]], covered: np.ndarray) -> str:
    """The article; or, on a page without one, its other blocks' words that no boilerplate run covers."""
    if any(k == MAIN for k, _ in page):
        return "\n".join(t for k, t in page if k == MAIN)
    out, at = [], 0
    for kind, text in page:
        n = len(text.encode("utf-8", "replace").split())
        if kind == OTHER:
            if not covered[at : at + n].any():
                out.append(text)
            elif n == len(words := text.split()):
                kept = " ".join(w for w, c in zip(words, covered[at : at + n].tolist(), strict=True) if not c)
                if kept:
                    out.append(kept)
            elif not covered[at : at + n].all():
                out.append(text)
        at += n
    return "\n".join(out)


_PARSED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("page", pa.int64()), ("stream", pa.int64()), ("rest", pa.string()), ("article", pa.string()), ("kinds", pa.binary())])


def _parse(batches):
    """The article, or without one what kind each line of the rest is; the rest of articles only once a batch and stream."""
    for b in batches:
        rows: list[list] = [[] for _ in range(5)]
        seen = set()
        for host, html in zip(b.column("host").to_pylist(), b.column("html"), strict=True):
            html = html.as_py() or ""
            page = blocks(html)
            rest, article = _rest(page), any(k == MAIN for k, _ in page)
            key = _hash64(_stream(rest).tobytes())
            known = article and (host, key) in seen
            seen.add((host, key))
            text, kinds = (main_text(page, np.zeros(0, bool)), None) if article else (None, bytes(k for k, _ in page))
            for column, v in zip(rows, (_hash64(html.encode("utf-8", "replace")), key, None if known else rest, text, kinds), strict=True):
                column.append(v)
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), b.column("host"), *(pa.array(c, t) for c, t in zip(rows, _PARSED.types[3:], strict=True))], schema=_PARSED)


def _finish(batches):
    """Texts of pages without an article."""
    for b in batches:
        texts = []
        for rest, kinds, cover in zip(*(b.column(n).to_pylist() for n in ("rest", "kinds", "cover")), strict=True):
            words = len(rest.encode("utf-8", "replace").split())
            covered = np.zeros(words, bool) if cover is None else np.unpackbits(np.frombuffer(cover, np.uint8), count=words).astype(bool)
            texts.append(main_text(list(zip(kinds, rest.split("\n"), strict=True)) if kinds else [], covered))
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def _covers(streams: DataFrame, run: int, least: int, shard: int) -> DataFrame:
    """(host, stream, cover): the words that boilerplate covers as bits, for streams of pages without article that have some."""
    spark = streams.sparkSession
    sizes = streams.groupBy("host").agg(F.sum(F.octet_length("rest")).alias("bytes")).where(F.col("bytes") > shard)
    sizes = common.written(sizes.select("host", F.ceil(F.col("bytes") / shard).cast("int").alias("shards")), "hosts")
    few = sizes.count() <= FEW_HOSTS
    d = streams.join(F.broadcast(sizes) if few else sizes, "host", "left").withColumn("shard", F.pmod("stream", F.coalesce("shards", F.lit(1))).cast("int"))
    if not few:  # else the join's partitioning by host would do for the groups
        d = d.repartition(common.parallelism(spark), "host", "shard")

    def runs(table):
        r = Runs([_stream(x.as_py()) for x in table.column("rest")], run)
        return r, r.count(table.column("pages").to_numpy())

    def counted(key, table):
        r, n = runs(table)
        n = np.minimum(n, least)
        return pa.table([pa.array([key[0].as_py()] * len(n), pa.string()), pa.array([key[1].as_py()] * len(n), pa.int32()), pa.array(r.keys().view(np.int64)), pa.array(n, pa.int64())], names=["host", "shard", "run", "n"])

    def cover(table, often):
        r, n = runs(table)
        covered = r.covered((n >= least) | np.isin(r.keys().view(np.int64), often.column("run").to_numpy()))
        rows = [k for k, (c, a) in enumerate(zip(covered, table.column("asked").to_pylist(), strict=True)) if a and c.any()]
        return table.select(["host", "stream"]).take(pa.array(rows, pa.int64())).append_column("cover", pa.array([np.packbits(covered[k]).tobytes() for k in rows], pa.binary()))

    # a stream stands in one shard, so the counts of the shards of a host add up
    hot = d.where("shards is not null").groupBy("host", "shard").applyInArrow(counted, "host string, shard int, run long, n long")
    often = hot.groupBy("host", "run").agg(F.sum("n").alias("n"), F.collect_list("shard").alias("shard")).where(F.col("n") >= least).select("host", F.explode("shard").alias("shard"), "run")
    return d.groupBy("host", "shard").cogroup(often.groupBy("host", "shard")).applyInArrow(cover, "host string, stream long, cover binary")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", run: int = RUN, least: int = PAGES, shard: int = SHARD) -> DataFrame:
    """(page_id, url, text, n_chars) for every row.

    Null or empty html: empty text. A null url is a page of the host "". Repeated rows each get their text; pages of a host
    with the same html count as one when repeats are looked for, all others each, whatever they share. Other columns are ignored; an empty table gives no row.
    """
    common.prepare(pages.sparkSession)
    host, _ = split_url(F.col(url_col))
    d = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), F.col(html_col).alias("html"))
    parsed = common.written(d.mapInArrow(_parse, "page_id long, url string, host string, page long, stream long, rest string, article string, kinds binary"), "parsed")
    streams = parsed.where("rest <> ''").groupBy("host", "stream").agg(F.first("rest").alias("rest"), F.max(F.col("kinds").isNotNull()).alias("asked"))
    streams = streams.join(parsed.select("host", "stream", "page").distinct().groupBy("host", "stream").agg(F.count("page").alias("pages")), ["host", "stream"])
    covers = common.written(_covers(common.written(streams, "streams"), run, least, shard), "covers")
    small = (covers.agg(F.sum(F.octet_length("cover") + F.octet_length("host"))).first()[0] or 0) <= FEW_BYTES
    other = parsed.where("article is null").select("page_id", "url", "host", "stream", "rest", "kinds").join(F.broadcast(covers) if small else covers, ["host", "stream"], "left")
    other = other.select("page_id", "url", "rest", "kinds", "cover").mapInArrow(_finish, "page_id long, url string, text string")
    out = parsed.where("article is not null").select("page_id", "url", F.col("article").alias("text")).unionByName(other)
    return out.select(F.col("page_id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
