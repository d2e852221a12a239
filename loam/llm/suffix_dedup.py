"""Removal of repeated substrings: every byte that a string of WINDOW bytes covers which also starts earlier.

Windows are dealt out by content, so that equal ones meet whatever documents they stand in: each window belongs to its
anchor, the KMER-byte string in it with the least hash, and neighbouring windows of one anchor are a segment. A task keeps
the earliest of equal segments at once (all others are covered), so a passage that a third of all rows share is one
segment a batch before anything moves. Anchors that only one kind of segment has need no sorting: its earliest segment
stays and the others are covered. Where an anchor has segments that differ, the distinct ones go to its shard, whose
suffixes are sorted by external induced sorting; windows that share a common prefix of WINDOW bytes are neighbours there,
and all but the earliest are covered. The windows of an anchor of more than SHARD bytes are dealt out again by further
anchors, under other hashes, one for each doubling; equal ones still meet. Shards keep their text, queues and arrays in files beyond a memory budget.

Strings are judged on the input, and matches never cross documents.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, induced

WINDOW = 100
KMER = 32
#: Windows scanned at a time, and bytes of one suffix array: a shard of more is sorted in groups of whole anchors.
PIECE = 1 << 19
SHARD = 2 << 20
#: Anchors of more than a shard whose list is broadcast; more are joined by a shuffle.
FEW_ANCHORS = 50_000
_U = np.uint64


def segments(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, kmer: int = KMER, piece: int = PIECE, level: int = 0) -> dict[str, np.ndarray]:
    """All segments of some documents: anchor hash, content hash, document index, first window, number of windows.

    Each level has anchors by a hash of its own.
    """
    out: dict[str, list[np.ndarray]] = {k: [] for k in ("anchor", "content", "doc", "start", "n")}
    docs = len(offsets) - 1
    k = 0
    while k < docs:
        # a run of documents of about a piece, or a piece of a long one
        e = max(k + 1, int(np.searchsorted(offsets, offsets[k] + piece, "right")) - 1)
        lo, hi = int(offsets[k]), int(offsets[e])
        for s in range(lo, max(hi, lo + 1), piece) if e == k + 1 else (lo,):
            stop = min(s + piece + window - 1, hi) if e == k + 1 else hi
            for name, x in zip(out, _piece(data[s:stop], np.clip(offsets[k : e + 1] - s, 0, stop - s), window, kmer, level), strict=True):
                out[name].append(x + (k if name == "doc" else 0) + (s - lo if name == "start" and e == k + 1 else 0))
        k = e
    kinds = {"anchor": np.uint64, "content": np.uint64}
    return {n: np.concatenate(x).astype(kinds.get(n, np.int64)) if x else np.zeros(0, kinds.get(n, np.int64)) for n, x in out.items()}


def _piece(data, offsets, window, kmer, level):
    size = len(data)
    if size < window:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    c = common.prefix_hash(data)
    h = common.mix((c[kmer:] - c[:-kmer]) * common.powers(size + 1, inverse=True)[: size - kmer + 1])
    if level:
        h = common.mix(h + _U(level))
    bits = _U(max(1, size.bit_length()))
    low = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    span = window - kmer + 1
    have = 1
    while have * 2 <= span:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < span:
        low = np.minimum(low[: len(low) - (span - have)], low[span - have :])
    low &= (_U(1) << bits) - _U(1)
    at = low.astype(np.int64)
    left = np.diff(offsets)
    doc = np.repeat(np.arange(len(left)), np.maximum(left - window + 1, 0))
    start = np.concatenate([[0], np.cumsum(np.maximum(left - window + 1, 0))])
    p = np.arange(len(doc)) - start[doc] + offsets[doc]
    a = at[p]
    fresh = np.ones(len(p), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])
    f = np.flatnonzero(fresh)
    n = np.diff(np.append(f, len(p)))
    return h[a[f]], common.range_hash(c, p[f], p[f] + n + window - 1), doc[f], p[f] - offsets[doc[f]], n


def _first_of(order_by: tuple[np.ndarray, ...], same: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(order, whether each in that order is the first of its group); order_by: least important key first."""
    order = np.lexsort(order_by)
    fresh = np.ones(len(order), bool)
    if len(order):
        fresh[1:] = np.any([x[order[1:]] != x[order[:-1]] for x in same], axis=0)
    return order, fresh


_ENTRY = np.dtype([("anchor", "<u8"), ("content", "<u8"), ("doc", "<i8"), ("start", "<i8"), ("n", "<i4")])
_MAPPED = pa.schema([("bucket", pa.int32()), ("entries", pa.binary()), ("covered", pa.binary())])
_RANGE = np.dtype([("doc", "<i8"), ("start", "<i8"), ("n", "<i8")])


def _pack(x: np.ndarray) -> bytes:
    """Column by column and compressed, as ids and places compress well and hashes don't."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(x[n]).tobytes() for n in x.dtype.names))


def _unpack(raw: bytes, kind: np.dtype) -> np.ndarray:
    import zstandard

    plain = zstandard.ZstdDecompressor().decompress(raw)
    out, at = np.empty(len(plain) // kind.itemsize, kind), 0
    for n in kind.names:
        out[n] = np.frombuffer(plain, kind[n], len(out), at)
        at += len(out) * kind[n].itemsize
    return out


def _mapper(window: int, kmer: int, buckets: int):
    def run(batches):
        for b in batches:
            data, off = common.utf8(b.column(1))
            s = segments(data, off, window, kmer)
            ids = b.column(0).to_numpy()
            e = np.empty(len(s["n"]), _ENTRY)
            e["anchor"], e["content"], e["doc"], e["start"], e["n"] = s["anchor"], s["content"], ids[s["doc"]], s["start"], s["n"]
            order, first = _first_of((e["start"], e["doc"], e["content"], e["anchor"]), (e["anchor"], e["content"]))
            e = e[order]
            again = _later(e, first)
            c = np.empty(int(again.sum()), _RANGE)
            for n in _RANGE.names:
                c[n] = e[n][again]
            e = e[first]
            to = (e["anchor"] >> _U(44)).astype(np.int64) % buckets
            order = np.lexsort((e["start"], e["doc"], to))
            e, to = e[order], to[order]
            there, cut = np.unique(to, return_index=True)
            cut = np.append(cut, len(e))
            blobs = [_pack(e[x:y]) for x, y in zip(cut, cut[1:], strict=False)]
            covered: list = [None] * len(blobs)
            if len(c):
                there, blobs, covered = np.append(there, int(c["doc"][0]) % buckets), [*blobs, None], [*covered, _pack(_merged(c))]
            if len(blobs):
                yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(blobs, pa.binary()), pa.array(covered, pa.binary())], schema=_MAPPED)

    return run


def _later(e: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which entries (sorted by anchor, content, doc, start) repeat their group's first; the same place met twice does not."""
    at = np.maximum.accumulate(np.where(first, np.arange(len(e)), 0))
    return ~first & ((e["doc"] != e["doc"][at]) | (e["start"] != e["start"][at]))


def _merged(r: np.ndarray) -> np.ndarray:
    """Ranges of windows, joined where they touch."""
    r = r[np.lexsort((r["start"], r["doc"]))]
    if not len(r):
        return r
    end = r["start"] + r["n"]
    fresh = np.ones(len(r), bool)
    fresh[1:] = (r["doc"][1:] != r["doc"][:-1]) | (r["start"][1:] > end[:-1])
    f = np.flatnonzero(fresh)
    out = r[f].copy()
    out["n"] = np.maximum.reduceat(end, f) - out["start"]
    return out


_REDUCED = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("anchor", pa.int64())])


def _rows(doc, start, n, anchor=None):
    anchor = pa.nulls(len(doc), pa.int64()) if anchor is None else pa.array(anchor.view(np.int64))
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(doc)), pa.array(np.ascontiguousarray(start)), pa.array(n.astype(np.int64)), anchor], schema=_REDUCED)


def _reduce(batches):
    """All segments of some anchors: covered ranges, and (with their anchor) the distinct segments that need sorting."""
    held = []
    for b in batches:
        for entries, covered in zip(b.column("entries"), b.column("covered"), strict=True):
            if covered.is_valid:
                r = _unpack(covered.as_py(), _RANGE)
                yield _rows(r["doc"], r["start"], r["n"])
            if entries.is_valid:
                held.append(_unpack(entries.as_py(), _ENTRY))
    if held:
        e = np.concatenate(held)
        del held
        order, first = _first_of((e["start"], e["doc"], e["content"], e["anchor"]), (e["anchor"], e["content"]))
        e = e[order]
        again = _later(e, first)
        r = _merged(np.rec.fromarrays([e["doc"][again], e["start"][again], e["n"][again].astype(np.int64)], dtype=_RANGE))
        yield _rows(r["doc"], r["start"], r["n"])
        e = e[first]
        alone = np.ones(len(e), bool)
        same = e["anchor"][1:] == e["anchor"][:-1]
        alone[1:] &= ~same
        alone[:-1] &= ~same
        e = e[~alone]
        for k in range(0, len(e), 100_000):
            x = e[k : k + 100_000]
            yield _rows(x["doc"], x["start"], x["n"], np.ascontiguousarray(x["anchor"]))


def covered_windows(texts: list[bytes], doc: np.ndarray, start: np.ndarray, n: np.ndarray, window: int = WINDOW, budget: int = induced.BUDGET, folder: str | None = None) -> np.ndarray:
    """Ranges of windows of these segments that also start earlier in one of them, by sorting their suffixes."""
    size = np.array([len(t) + 1 for t in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    total = int(size.sum())
    own = tempfile.mkdtemp(prefix="shard-", dir=folder) if total > budget else None
    try:
        x = np.memmap(os.path.join(own, "text"), np.int16, "w+", shape=total + 1) if own else np.empty(total + 1, np.int16)
        for at, t in zip(first.tolist(), texts, strict=True):
            x[at : at + len(t)] = np.frombuffer(t, np.uint8)
            x[at : at + len(t)] += 2
            x[at + len(t)] = 1
        x[total] = 0
        sa, lcp = induced.sort(x, budget, folder=folder)
        which = np.full(total + 1, -1, np.int32)
        place = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
        which[place] = np.repeat(np.arange(len(texts), dtype=np.int32), n)
        group = np.cumsum(lcp < window)
        seg = which[sa]
        ok = seg >= 0
        at, group, seg = sa[ok], group[ok], seg[ok]
        p = start[seg] + at - first[seg]
        order, fresh = _first_of((p, doc[seg], group), (group,))
        seg, p = seg[order], p[order]
        top = np.maximum.accumulate(np.where(fresh, np.arange(len(p)), 0))
        late = ~fresh & ((doc[seg] != doc[seg][top]) | (p != p[top]))
        return _merged(np.rec.fromarrays([doc[seg][late], p[late], np.ones(int(late.sum()), np.int64)], dtype=_RANGE))
    finally:
        if own:
            shutil.rmtree(own, ignore_errors=True)


def split(texts: list[bytes], anchor: np.ndarray, levels: np.ndarray, window: int, kmer: int) -> tuple[np.ndarray, ...]:
    """Segments of hot anchors dealt out again: (which segment, first window in it, number of windows, anchor).

    Each level cuts at changes of its own anchor, and a window's new anchor is made of those of all its levels, so it
    depends on the old one and the window's bytes alone.
    """
    which, at, anchor = np.arange(len(texts)), np.zeros(len(texts), np.int64), anchor.copy()
    n = np.array([len(t) - window + 1 for t in texts], np.int64)
    for level in range(1, int(levels.max(initial=0)) + 1):
        live = levels[which] >= level
        parts = [texts[k][a : a + m + window - 1] for k, a, m in zip(which[live].tolist(), at[live].tolist(), n[live].tolist(), strict=True)]
        got = segments(np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64), window, kmer, level=level)
        old = np.flatnonzero(live)[got["doc"]]
        new = which[old], at[old] + got["start"], got["n"], common.mix(anchor[old] * _U(3) + got["anchor"])
        which, at, n, anchor = (np.concatenate([x[~live], y]) for x, y in zip((which, at, n, anchor), new, strict=True))
    return which, at, n, anchor


def _sorter(window: int, shard: int, budget: int):
    def run(batches):
        """Segments come sorted by anchor; those of one anchor are always sorted together, equal ones as the earliest."""
        held, late, size, last = {}, [], 0, None

        def flush():
            anchors, texts = zip(*held, strict=True)
            r = covered_windows(list(texts), *np.array(list(held.values()), np.int64).T, window, budget)
            return _rows(r["doc"], r["start"], r["n"])

        for b in batches:
            for anchor, *place, text in zip(*(b.column(k).to_pylist() for k in ("anchor", "doc_id", "start", "n", "segment")), strict=True):
                if size >= shard and anchor != last:
                    yield flush()
                    held, size = {}, 0
                last, other = anchor, held.get((anchor, text))
                if other is None:
                    held[anchor, text] = place
                    size += len(text)
                elif place != other:
                    held[anchor, text] = min(place, other)
                    late.append(max(place, other))
            if late:
                yield _rows(*np.array(late, np.int64).T)
                late = []
        if held:
            yield flush()

    return run


def keyed(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row struct of all columns, doc_id, text): doc_id is a number for each text of a doc_id, in order of doc_id; null without one.

    Where every doc_id names one text it is the doc_id itself. Else the pairs of doc_id and the text's hash are sorted and
    numbered anew (the texts of a doc_id in order of their hashes), so rows of one doc_id are judged each by its own text.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")
    d = documents.select(row, F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    hashed = d.where("doc_id is not null").select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    if hashed.groupBy("doc_id").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").isEmpty():
        return d
    numbers = hashed.distinct().orderBy("doc_id", "h").select("doc_id", "h", F.monotonically_increasing_id().alias("number"))
    numbers = common.written(numbers, "numbers")  # numbered once, as another run may part the rows otherwise
    named = numbers.select(F.col("doc_id").alias("d_"), F.col("h").alias("h_"), "number")
    is_row = (F.col("doc_id") == F.col("d_")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("h_"))
    return d.join(named, is_row, "left").select("row", F.col("number").alias("doc_id"), "text")


def ranges(documents: DataFrame, window: int = WINDOW, kmer: int = KMER, shard: int = SHARD, budget: int = induced.BUDGET) -> DataFrame:
    """(doc_id, spans): ascending ranges [start, start + n) of windows that also start earlier, for documents that have some.

    documents: (doc_id, text), where a doc_id names one text (see keyed).
    """
    if not 0 < window <= induced.CAP:  # common prefixes are counted no further
        raise ValueError(f"window must be 1 to {induced.CAP}, not {window}")
    spark = documents.sparkSession
    common.prepare(spark)
    parts = common.parallelism(spark)
    d = documents.select("doc_id", "text").where("doc_id is not null and text is not null")
    mapped = d.mapInArrow(_mapper(window, min(kmer, window), 2 * parts), "bucket int, entries binary, covered binary")
    reduced = common.written(mapped.repartition(parts, "bucket").mapInArrow(_reduce, "doc_id long, start long, n long, anchor long"), "anchors")
    differ = reduced.where("anchor is not null")
    hot = differ.groupBy("anchor").agg(F.sum(F.col("n") + (window - 1)).alias("bytes")).where(F.col("bytes") > shard)
    hot = common.written(hot.select("anchor", F.ceil(F.log2(F.col("bytes") / shard)).cast("int").alias("levels")), "hot")
    differ = differ.join(F.broadcast(hot) if hot.count() <= FEW_ANCHORS else hot, "anchor", "left")
    asked = differ.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "start", "n", F.coalesce("levels", F.lit(0)).alias("levels"))).alias("asked"))

    def fetch(batches):
        for b in batches:
            data, off = common.utf8(b.column("text"))
            rows: list[list] = [[] for _ in range(6)]
            for k, (doc, asked) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("asked").to_pylist(), strict=True)):
                for a in asked:
                    s = off[k] + a["start"]
                    for column, v in zip(rows, (a["anchor"], doc, a["start"], a["n"], a["levels"], data[s : min(s + a["n"] + window - 1, off[k + 1])].tobytes()), strict=True):
                        column.append(v)
            anchor, doc, start, n, levels = (np.array(c, np.int64) for c in rows[:5])
            texts = rows[5]
            if levels.any():
                which, at, n, anchor = split(texts, anchor.view(np.uint64), levels, window, min(kmer, window))
                doc, start, texts = doc[which], start[which] + at, [texts[k][a : a + m + window - 1] for k, a, m in zip(which.tolist(), at.tolist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(c).view(np.int64)) for c in (anchor, doc, start, n)), pa.array(texts, pa.binary())], names=["anchor", "doc_id", "start", "n", "segment"])

    segs = d.join(asked, "doc_id").select("doc_id", "text", "asked").mapInArrow(fetch, "anchor long, doc_id long, start long, n long, segment binary")
    segs = segs.repartition(parts, "anchor").sortWithinPartitions("anchor")
    sorted_ = segs.mapInArrow(_sorter(window, shard, budget), "doc_id long, start long, n long, anchor long")
    every = reduced.where("anchor is null").unionByName(sorted_).select("doc_id", F.struct("start", "n").alias("r"))
    return every.groupBy("doc_id").agg(F.array_sort(F.collect_list("r")).alias("spans"))


def uncovered(text: np.ndarray, start: np.ndarray, n: np.ndarray, window: int) -> np.ndarray:
    """Which bytes of a text no range of windows covers."""
    cover = np.zeros(len(text) + 1, np.int64)
    np.add.at(cover, np.minimum(start, len(text)), 1)
    np.add.at(cover, np.minimum(start + n + window - 1, len(text)), -1)
    return np.cumsum(cover[:-1]) <= 0


def _spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and numbers of all ranges of a batch, and where each row's begin."""
    flat = column.flatten()
    start, n = (flat.field(k).to_numpy() for k in range(2)) if len(flat) else (np.zeros(0, np.int64),) * 2
    return start, n, np.concatenate([[0], np.cumsum([len(x) if x.is_valid else 0 for x in column])])


def dedup(documents: DataFrame, window: int = WINDOW, kmer: int = KMER, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, shard: int = SHARD, budget: int = induced.BUDGET) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) for every row; kept: the remaining bytes.

    Null text counts as empty, and neither it nor a text of fewer than `window` bytes loses anything. Rows of one doc_id
    with the same text are the same document, which does not repeat itself by being listed twice; with different texts
    they are documents of their own, in order of the texts' hashes. A row without doc_id keeps its text. Other columns
    are ignored, whatever their names; an empty table gives no row.
    ValueError for a window of more than 255 bytes, up to which common prefixes are counted.
    """
    every = keyed(documents, id_col, text_col)
    found = ranges(every, window, kmer, shard, budget)
    d = every.select(F.col(f"row.`{id_col}`").cast("long").alias("own"), "doc_id", "text").join(found, "doc_id", "left")

    def cut(batches):
        for b in batches:
            data, off = common.utf8(b.column("text"))
            n, removed, count, sha, kept = [], [], [], [], []
            start, many, at = _spans(b.column("spans"))
            for k in range(b.num_rows):
                text = data[off[k] : off[k + 1]]
                stay = uncovered(text, start[at[k] : at[k + 1]], many[at[k] : at[k + 1]], window) if at[k + 1] > at[k] else np.ones(len(text), bool)
                left = text[stay].tobytes()
                n.append(len(text))
                removed.append(len(text) - len(left))
                count.append(int((~stay[1:] & stay[:-1]).sum() + (~stay[:1]).sum()))
                sha.append(hashlib.sha256(left).hexdigest())
                kept.append(left)
            columns = [b.column("own"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * keep_text, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_text)

    out = d.select("own", "text", "spans").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text)
    return out.withColumnRenamed("doc_id", id_col)


def cleaned(documents: DataFrame, window: int = WINDOW, kmer: int = KMER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, with what is covered cut out of their text; a character cut in two goes whole.

    A document of which nothing is left goes; an empty or null text stays as it is, and so does a row without doc_id. Rows
    of one doc_id are judged each by its own text; other columns may have any names.
    ValueError for a window of more than 255 bytes.
    """
    every = keyed(documents, id_col, text_col)
    found = ranges(every, window, kmer)
    joined = every.select("row", "doc_id").join(found, "doc_id", "left").select("row", "spans")
    at, schema = documents.columns.index(text_col), documents.schema

    def run(batches):
        for b in batches:
            columns = b.column(0).flatten()
            data, off = common.utf8(columns[at])
            start, many, cut = _spans(b.column(1))
            texts, stays = columns[at].to_pylist(), np.ones(b.num_rows, bool)
            for k in np.flatnonzero(np.diff(cut)).tolist():
                text = data[off[k] : off[k + 1]]
                texts[k] = text[uncovered(text, start[cut[k] : cut[k + 1]], many[cut[k] : cut[k + 1]], window)].tobytes().decode("utf-8", "ignore")
                stays[k] = bool(texts[k])
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=schema.names).filter(pa.array(stays))

    return joined.mapInArrow(run, schema)
