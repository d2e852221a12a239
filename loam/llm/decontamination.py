"""Benchmark decontamination by an FM-index for each training shard.

A shard is a bounded run of documents. Its words become symbols: the benchmark's vocabulary, and 0 for any other word,
at which nothing can match. Only what could hold a phrase is indexed: runs of neighbouring word pairs that the benchmark
has too (every pair inside an occurrence is such a pair, so none is lost; most words of ordinary text fall away). The
index is the Burrows-Wheeler transform under a wavelet tree; each distinct phrase is searched backwards through its
ranks, found rows are located by sampled suffix positions, and the located spans are merged.

The benchmark is searched in parts of a bounded size, one after the other, each broadcast to the executors; documents
carry what is hit so far from part to part.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .suffix import FMIndex

WINDOW = 13
#: Words of one index; a longer document still is one index.
SHARD_WORDS = 250_000
#: Rows located at a time.
LOCATE = 1 << 18
#: Bytes of benchmark text that are broadcast at a time.
PART_BYTES = 8 << 20


@dataclass(frozen=True)
class Phrases:
    """The benchmark as symbols: vocabulary hashes (sorted), distinct phrases, and which items each phrase is of."""

    vocabulary: np.ndarray
    pairs: np.ndarray  # sorted first * len + second of neighbouring symbols
    rows: np.ndarray  # phrases x window, padded by 0
    lengths: np.ndarray
    item: np.ndarray  # of each (phrase, item) entry
    item_first: np.ndarray  # first entry of each phrase
    item_ids: list[str | None]


def phrases(items: list[tuple[object, str | None]], window: int = WINDOW) -> Phrases:
    """items: (item id, text); the benchmark's size bounds everything here. A short item is one phrase, an empty one none."""
    texts = [(t or "").encode() for _, t in items]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    h, at = common.word_hashes(data, offsets, common.NOT_ALNUM)
    vocabulary, symbol = np.unique(h, return_inverse=True)
    symbol = symbol + 1
    size = np.diff(at)
    many = np.where(size >= window, size - window + 1, np.minimum(size, 1))
    own = np.repeat(np.arange(len(items)), many)
    start = at[own] + np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
    place = np.arange(window)
    rows = np.where(place < size[own, None], np.append(symbol, np.zeros(window, np.int64))[start[:, None] + place], 0)
    rows, which = np.unique(rows, axis=0, return_inverse=True)
    entry = np.unique(which.ravel() * np.int64(max(1, len(items))) + own)
    phrase, item = entry // max(1, len(items)), entry % max(1, len(items))
    both = (rows[:, :-1] > 0) & (rows[:, 1:] > 0)
    pairs = np.unique(rows[:, :-1][both] * np.int64(len(vocabulary) + 1) + rows[:, 1:][both])
    return Phrases(vocabulary, pairs, rows, (rows > 0).sum(1), item, np.searchsorted(phrase, np.arange(len(rows) + 1)), [None if i is None else str(i) for i, _ in items])


def _runs(symbols: np.ndarray, doc_of_end: np.ndarray, p: Phrases) -> np.ndarray:
    """Places that could lie inside a phrase: in a run of known pairs within a document, or a known word if a phrase may be one word."""
    shortest = int(p.lengths.min())
    if shortest == 1:
        return symbols > 0
    known = len(p.vocabulary) + 1
    both = np.flatnonzero((symbols[:-1] > 0) & (symbols[1:] > 0) & ~doc_of_end[:-1])
    pair = symbols[both] * known + symbols[both + 1]
    if known * known <= 1 << 26:
        table = np.zeros(known * known, bool)
        table[p.pairs] = True
        both = both[table[pair]]
    else:
        both = both[p.pairs[np.minimum(np.searchsorted(p.pairs, pair), len(p.pairs) - 1)] == pair]
    linked = np.zeros(len(symbols) + 1, np.int8)
    linked[both + 1] = 1  # this place follows its predecessor
    # length of each run of links; a run of m links has m + 1 words
    edge = np.diff(linked, prepend=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = end - start + 1 >= shortest
    cover = np.zeros(len(symbols) + 1, np.int64)
    cover[start[long] - 1] += 1
    cover[end[long]] -= 1
    return np.cumsum(cover[:-1]) > 0


def hits(h: np.ndarray, at: np.ndarray, p: Phrases) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """For documents' word hashes: hit flag of every word, items of each document, index size.

    h: hashes of all words of a shard; at: index of each document's first word.
    """
    n = len(at) - 1
    hit = np.zeros(len(h) + 1, np.int64)
    nothing = np.zeros(0, np.int64)
    items: list[np.ndarray] = [nothing] * n
    if not len(h) or not len(p.rows):
        return hit[:-1] > 0, items, nothing
    where = np.minimum(np.searchsorted(p.vocabulary, h), len(p.vocabulary) - 1)
    symbols = np.where(p.vocabulary[where] == h, where + 1, 0)
    ends = np.zeros(len(h), bool)
    ends[at[1:][at[1:] > 0] - 1] = True
    kept = np.flatnonzero(_runs(symbols, ends, p))
    if not len(kept):
        return hit[:-1] > 0, items, nothing
    gap = np.ones(len(kept), bool)
    gap[1:] = (np.diff(kept) > 1) | ends[kept[:-1]]
    # symbols of the index: 0 the end, 1 a gap, then the vocabulary
    spot = np.arange(len(kept)) + np.cumsum(gap) - 1
    text = np.ones(int(spot[-1]) + 1, np.int64)
    text[spot] = symbols[kept] + 1
    back = np.zeros(len(text), np.int64)
    back[spot] = kept
    index = FMIndex(text, len(p.vocabulary) + 2)
    start, end = index.search(np.where(p.rows > 0, p.rows + 1, 0), p.lengths)
    found = np.flatnonzero(end > start)
    size = (end - start)[found]
    pair_doc, pair_item = [], []
    upto = np.concatenate([[0], np.cumsum(size)])
    for s in range(0, int(upto[-1]), LOCATE):
        k = np.arange(s, min(s + LOCATE, int(upto[-1])))
        phrase = np.searchsorted(upto, k, "right") - 1
        place = back[index.locate(start[found[phrase]] + k - upto[phrase])]
        phrase = found[phrase]
        np.add.at(hit, place, 1)
        np.add.at(hit, place + p.lengths[phrase], -1)
        doc = np.searchsorted(at, place, "right") - 1
        once = np.unique(doc * len(p.rows) + phrase)
        doc, phrase = once // len(p.rows), once % len(p.rows)
        m = p.item_first[phrase + 1] - p.item_first[phrase]
        entry = np.repeat(p.item_first[phrase] - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())
        pair = np.unique(np.repeat(doc, m) * len(p.item_ids) + p.item[entry])
        pair_doc.append(pair // len(p.item_ids))
        pair_item.append(pair % len(p.item_ids))
    if pair_doc:
        pair = np.unique(np.concatenate(pair_doc) * len(p.item_ids) + np.concatenate(pair_item))
        doc, item = pair // len(p.item_ids), pair % len(p.item_ids)
        cut = np.searchsorted(doc, np.arange(n + 1))
        items = [item[cut[k] : cut[k + 1]] for k in range(n)]
    return np.cumsum(hit[:-1]) > 0, items, np.array([len(text)])


def _shards(batches, text_col: str, shard_words: int):
    """Batches regrouped into shards of about that many words."""
    held, size = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.column("row").field(text_col).nbytes // 6
        if size >= shard_words:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _bits(column: pa.ChunkedArray, at: np.ndarray) -> np.ndarray:
    """Flags of all words of a shard, from the packed ones of each document (null: none)."""
    out = np.zeros(int(at[-1]), bool)
    for k, x in enumerate(column):
        if x.is_valid:
            out[at[k] : at[k + 1]] = np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=int(at[k + 1] - at[k])).astype(bool)
    return out


def _spans(hit: np.ndarray, at: np.ndarray, start: np.ndarray, end: np.ndarray, off: np.ndarray) -> pa.Array:
    """Each document's runs of hit words, from the first byte of the first to the last of the last."""
    full = at[:-1] < at[1:]
    opens, ends = hit.copy(), hit.copy()
    opens[1:] &= ~hit[:-1]
    opens[at[:-1][full]] |= hit[at[:-1][full]]
    ends[:-1] &= ~hit[1:]
    ends[at[1:][full] - 1] |= hit[at[1:][full] - 1]
    a, z = np.flatnonzero(opens), np.flatnonzero(ends)
    doc = np.searchsorted(at, a, "right") - 1
    cut = np.searchsorted(doc, np.arange(len(at))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cut), pa.StructArray.from_arrays([pa.array(start[a] - off[doc]), pa.array(end[z] - off[doc])], names=["start", "end"]))


_STATE = "hits binary, items array<string>"
_FOUND = "n_words long, n_hit long, items array<string>, spans array<struct<start:bigint,`end`:bigint>>"


def _pass(part, text_col: str, shard_words: int, last: bool):
    def run(batches):
        """Adds the hits of one part of the benchmark; the last part's pass gives the result."""
        p = part.value
        for t in _shards(batches, text_col, shard_words):
            data, off = common.utf8(t.column("row").chunk(0).field(text_col))
            start, end, at = common.words(data, off, common.NOT_ALNUM)
            h = common.range_hash(common.prefix_hash(data, lower=True), start, end)
            hit, found, _ = hits(h, at, p)
            hit = hit | _bits(t.column("hits"), at)
            items = pa.array([[*(before or []), *(p.item_ids[i] for i in x)] for before, x in zip(t.column("items").to_pylist(), found, strict=True)], pa.list_(pa.string()))
            if last:
                upto = np.concatenate([[0], np.cumsum(hit)])
                columns = {"row": t.column("row"), "n_words": pa.array(np.diff(at)), "n_hit": pa.array(upto[at[1:]] - upto[at[:-1]]), "items": items, "spans": _spans(hit, at, start, end, off)}
            else:
                bits = [np.packbits(hit[x:y]).tobytes() if hit[x:y].any() else None for x, y in zip(at, at[1:], strict=False)]
                columns = {"row": t.column("row"), "hits": pa.array(bits, pa.binary()), "items": items}
            yield from pa.table(columns).to_batches(max_chunksize=10_000)

    return run


def _scanned(rows: DataFrame, benchmark: DataFrame, window: int, text_col: str, item_col: str, item_text_col: str, shard_words: int, part_bytes: int) -> DataFrame:
    """rows (row struct, of which one field is the text) with n_words, n_hit, items and spans."""
    spark = rows.sparkSession
    common.prepare(spark)
    items = benchmark.select(F.col(item_col).alias("i"), F.col(item_text_col).alias("t")).distinct()
    parts = 1 + int(items.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // part_bytes
    out = rows.withColumns({"hits": F.lit(None).cast("binary"), "items": F.lit(None).cast("array<string>")})
    kind = rows.schema["row"].dataType.simpleString()
    for k in range(parts):
        mine = items.where(F.pmod(F.xxhash64("t", "i"), F.lit(parts)) == k).orderBy("i", "t").collect()
        part = spark.sparkContext.broadcast(phrases([tuple(r) for r in mine], window))
        last = k == parts - 1
        out = out.mapInArrow(_pass(part, text_col, shard_words, last), f"row {kind}, " + (_FOUND if last else _STATE))
        if not last:
            out = common.written(out, "hits")
    return out


def scan(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shard_words: int = SHARD_WORDS, part_bytes: int = PART_BYTES) -> DataFrame:
    """(id, n_words, n_hit, items, spans): spans are merged [start, end) bytes of the text from the first to the last hit word of a run.

    The benchmark is read to the driver in parts of about part_bytes. Null or empty texts have no words; an item without
    words is no phrase; repeated items each count by their id; an item without id hits like others and is a null among
    the items. Repeated documents, and those without id, each get a row; other columns are ignored. An empty benchmark
    hits nothing; an empty table gives no row.
    """
    rows = documents.select(F.struct(F.col(id_col).alias("id"), F.col(text_col).alias("text")).alias("row"))
    out = _scanned(rows, benchmark, window, "text", item_col, item_text_col, shard_words, part_bytes)
    return out.select(F.col("row.id").alias(id_col), "n_words", "n_hit", "items", "spans")


def clean(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", share: int = 20) -> DataFrame:
    """The rows, all columns as they are, that are not contaminated (see digest); each row by its own text."""
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    out = _scanned(rows, benchmark, window, text_col, item_col, item_text_col, SHARD_WORDS, PART_BYTES)
    return digest(out, share).where(~F.col("contaminated")).select("row.*")


def digest(scanned: DataFrame, share: int = 20) -> DataFrame:
    """Adds n_items, items_sha256 and contaminated (a hit, and share times the hit words at least all words).

    Items without id count as one, which items_sha256 leaves out.
    """
    ids = F.array_join(F.array_sort(F.array_distinct("items")), ",")
    return scanned.withColumn("n_items", F.size(F.array_distinct("items")).cast("long")).withColumn("items_sha256", F.sha2(ids, 256)).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def removed(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without its spans (bytes of whole words, so what is left is still UTF-8)."""
    out, at = [], 0
    for s, e in spans:
        out.append(text[at:s])
        at = e
    return b"".join([*out, text[at:]])


def sorted_items_sha256(ids: list[str]) -> str:
    """What items_sha256 is, for tests."""
    return hashlib.sha256(",".join(sorted(set(ids))).encode()).hexdigest()
