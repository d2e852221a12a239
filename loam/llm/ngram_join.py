"""Similarity join on n-gram sets by a count-vector R-tree.

Each document is its set of distinct word shingles. Two link when their Jaccard similarity reaches a bound; components of
links are the result. Identical sets are one from the start (set_id is a hash of the set), and no pair of equal ones is
ever made.

Sets are points: how many of their shingles fall into each of some hash groups. The overlap of two is at most the sum of
coordinate minima; an R-tree whose nodes carry coordinate maxima and the least size yields the pairs that this bound leaves.

Where the tree is searched. A tree over all points would have to be compared with itself as a whole, as random sets of
the same size are near each other in every coordinate. So its first coordinate is a shingle: shingles have one global
order (those that are frequent in the whole table come last, as counted by leading bits of their hashes), two sets that link share one of their first
size - ceil(share * size) + 1 shingles, and each set is a point under each of those. The points of a shingle are a tree of
their own, so a task holds whole trees; a search in it leaves pairs whose sizes and minima of counts allow the overlap that
a link needs. Of these, a pair that is only found under few shingles must be found under as many as a link makes it
share, and at one that leaves enough shingles after it. Nothing that links is lost, whatever the counts say. What hangs
together by such candidates is a block.

Verification. Within a block the points have more groups; what a second tree on them leaves and is not yet connected is
compared shingle by shingle. A large block is first compared with one pivot; only sets that don't link with it are then
compared with all others, in bounded chunks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Hash groups of a block's points, and of those under shingles, which travel with every one of them.
GROUPS, COARSE = 64, 32
LEAF = 32
#: Sets, and bytes of their shingles, compared in one task at most.
CHUNK, CHUNK_BYTES = 600, 16 << 20
_U = np.uint64
_K = np.array([0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x9FB21C651E98DF25], np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = 3, parting: np.ndarray = common.SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, and where each document's begin. Fewer than n words are one shingle."""
    h, at = common.word_hashes(data, offsets, parting)
    count = np.diff(at)
    docs = len(count)
    coef = common.mix(np.arange(1, n + 1, dtype=np.uint64) * _K[0]) | _U(1)
    own = np.repeat(np.arange(docs), np.maximum(count - n + 1, (count > 0).astype(count.dtype)))
    first = np.concatenate([[0], np.cumsum(np.maximum(count - n + 1, (count > 0).astype(count.dtype)))])
    place = at[own] + np.arange(len(own)) - first[own]
    s = np.full(len(own), 0, np.uint64)
    padded = np.concatenate([h, np.zeros(n, np.uint64)])
    for k in range(n):
        s += np.where(k < count[own], padded[place + k], _U(0)) * coef[k]
    s = common.mix(s + np.minimum(count[own], n).astype(np.uint64) * _K[1])
    for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        s[x:y].sort()
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != s[:-1]) | (own[1:] != own[:-1])
    s, own = s[keep], own[keep]
    return s, np.searchsorted(own, np.arange(docs + 1))


def set_ids(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each set, as a signed 64-bit number; 0 for the empty one."""
    c = np.concatenate([[_U(0)], np.cumsum(common.mix(s ^ _K[2]))]).astype(np.uint64)
    size = np.diff(at).astype(np.uint64)
    return np.where(size > 0, common.mix((c[at[1:]] - c[at[:-1]]) ^ (size * _K[3])), _U(0)).view(np.int64)


def weights(s: np.ndarray, common_hash: np.ndarray, common_count: np.ndarray) -> np.ndarray:
    """How frequent shingles are: counts of the hashes that are given, or, if none are, of all by their leading bits."""
    if len(common_hash):
        k = np.minimum(np.searchsorted(common_hash, s), len(common_hash) - 1)
        return np.where(common_hash[k] == s, common_count[k], 0)
    if len(common_count):
        return common_count[(s >> _U(65 - len(common_count).bit_length())).astype(np.int64)]
    return np.zeros(len(s), np.int64)


def keys(s: np.ndarray, at: np.ndarray, num: int, den: int, common_hash: np.ndarray, common_count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, index of the set, shingles left from it on in the global order) for all that a set is listed under."""
    size = np.diff(at)
    own = np.repeat(np.arange(len(size)), size)
    weight = weights(s, common_hash, common_count)
    order = np.lexsort((s, weight, own))
    place = np.arange(len(s)) - at[own]
    ok = place < (size + (-num * size // den) + 1)[own]
    return s[order[ok]], own[ok], size[own[ok]] - place[ok]


def least_shared(size_a, size_b, num: int, den: int):
    """How many of the shingles that both are listed under two sets share at least, if they link.

    Of the one whose list ends first in the global order, all listed shingles that the other has are in the other's list,
    and no more than its size less the overlap are missing there.
    """
    overlap = -(-num * (size_a + size_b) // (num + den))
    return overlap + (-num * np.maximum(size_a, size_b) // den) + 1


def may_link(size_a, left_a, size_b, left_b, num: int, den: int):
    """Whether sets that share a shingle can reach the overlap a link needs, by what is left from it on in each."""
    return (num + den) * np.minimum(left_a, left_b) >= num * (size_a + size_b)


class RTree:
    """Points sorted by size and packed into leaves and one level above; nodes bound coordinates from above and sizes from both sides."""

    def __init__(self, points: np.ndarray, num: int, den: int, size: np.ndarray | None = None):
        self.num, self.den = num, den
        size = points.sum(1) if size is None else size
        self.order = np.lexsort((*(points[:, k] for k in range(2)), size))
        self.points, self.size = points[self.order], size[self.order]
        self.leaves = np.arange(0, len(points), LEAF)
        self.top = np.arange(0, len(self.leaves), LEAF)
        self.leaf_max = np.maximum.reduceat(self.points, self.leaves, axis=0) if len(points) else self.points
        self.top_max = np.maximum.reduceat(self.leaf_max, self.top, axis=0) if len(points) else self.points

    def _may(self, q: np.ndarray, n: int, upper: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Whether an overlap that upper allows can reach the share: den * overlap >= num * (n + size - overlap)."""
        return (self.num + self.den) * np.minimum(q, upper).sum(1) >= self.num * (n + least)

    def near(self, q: np.ndarray, n: int | None = None) -> np.ndarray:
        """Indexes of points whose bound with q, of size n, reaches the similarity."""
        n = int(q.sum()) if n is None else n
        t = np.flatnonzero(self._may(q, n, self.top_max, self.size[self.leaves[self.top]]))
        leaf = (t[:, None] * LEAF + np.arange(LEAF)).ravel()
        leaf = leaf[leaf < len(self.leaves)]
        leaf = leaf[self._may(q, n, self.leaf_max[leaf], self.size[self.leaves[leaf]])]
        p = (leaf[:, None] * LEAF + np.arange(LEAF)).ravel()
        p = p[p < len(self.size)]
        return self.order[p[self._may(q, n, self.points[p], self.size[p])]]


def counts_of(s: np.ndarray, at: np.ndarray, groups: int) -> np.ndarray:
    """Points of sets that lie one after the other: how many of their shingles fall into each group."""
    group = (common.mix(s ^ _K[3]) >> _U(58)).astype(np.int64) * groups // 64
    own = np.repeat(np.arange(len(at) - 1), np.diff(at))
    return np.bincount(own * groups + group, minlength=(len(at) - 1) * groups).reshape(-1, groups)


def count_vectors(sets: list[np.ndarray]) -> np.ndarray:
    return counts_of(np.concatenate([np.zeros(0, np.uint64), *sets]), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64), GROUPS)


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    same = len(np.intersect1d(a, b, assume_unique=True))
    return den * same >= num * (len(a) + len(b) - same)


def join_block(ids: list[int], sets: list[np.ndarray], asks: np.ndarray, star: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between the sets where asks holds and all sets; those where star holds are connected already."""
    parent = np.arange(len(ids))
    pivot = int(np.flatnonzero(star)[0]) if star.any() else -1
    if pivot >= 0:
        parent[star] = pivot
    points = count_vectors(sets)
    tree = RTree(points, num, den)
    out = []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k in np.flatnonzero(asks).tolist():
        for c in tree.near(points[k]).tolist():
            if c != k and (not asks[c] or c < k):
                a, b = find(k), find(c)
                if a != b and linked(sets[k], sets[c], num, den):
                    parent[a] = b
                    out.append((ids[k], ids[c]))
    return out


#: Counters of shingles, as a power of two: the fewest and the most, and how many a document has between the two.
LEAST_SLOTS, MOST_SLOTS, SLOTS = 22, 24, 16
#: Counters in one piece, and steps of a count in an octave.
PIECE, STEPS = 1 << 16, 12
#: Points under one shingle that are compared as one leaf; more are a tree. More than TREE hold together untested, and so
#: do those that a tree's search leaves, if that is over DENSE for each point.
FEW, TREE, DENSE = 64, 20_000, 64


def frequent(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """No hashes, and how many shingles of the whole table begin with each leading bits of a hash, as a logarithm in a byte.

    Every document's distinct shingles are counted. A task has one table of counters, the pieces of all of them are added
    up in tasks, and the driver holds a byte for each of 16 million counters at most; they only make the order better.
    """
    import zstandard

    total = docs.count()
    if not total:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint8)
    bits = min(MOST_SLOTS, max(LEAST_SLOTS, (SLOTS * total).bit_length()))

    def count(batches):
        counts = np.zeros(1 << bits, np.uint32)
        for b in batches:
            np.add.at(counts, (shingle_sets(*common.utf8(b.column(0)), n)[0] >> _U(64 - bits)).astype(np.int64), np.uint32(1))
        pack = zstandard.ZstdCompressor(level=1).compress
        for k in range(0, 1 << bits, PIECE):
            if counts[k : k + PIECE].any():
                yield pa.RecordBatch.from_arrays([pa.array([k // PIECE], pa.int32()), pa.array([pack(counts[k : k + PIECE].tobytes())], pa.binary())], names=["piece", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, raw in zip(b.column("piece").to_pylist(), b.column("counts"), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(zstandard.ZstdDecompressor().decompress(raw.as_buffer()), np.uint32).astype(np.int64)
        levels = [np.minimum(STEPS * np.log2(1 + x), 255).astype(np.uint8).tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(levels, pa.binary())], names=["piece", "levels"])

    pieces = docs.select("text").mapInArrow(count, "piece int, counts binary").repartition(min(common.parallelism(docs.sparkSession), (1 << bits) // PIECE), "piece")
    levels = np.zeros((1 << bits) // PIECE * PIECE, np.uint8)
    for k, raw in pieces.mapInArrow(add, "piece int, levels binary").collect():
        levels[k * PIECE : (k + 1) * PIECE] = np.frombuffer(raw, np.uint8)
    return np.zeros(0, np.uint64), levels


#: Points under some shingles, as tasks pass them on: sets with their coarse points, and (shingle, which set, shingles left).
_SETS = [("set", "<i8"), ("size", "<i4"), ("point", "u1", (COARSE,))]
_ENTRIES = [("key", "<u8"), ("of", "<u2"), ("left", "<i4")]


def pack(sets: dict[str, np.ndarray], entries: dict[str, np.ndarray]) -> bytes:
    """Column by column and compressed."""
    import zstandard

    columns = [np.ascontiguousarray(x[k[0]].astype(k[1])) for x, kinds in ((sets, _SETS), (entries, _ENTRIES)) for k in kinds]
    return zstandard.ZstdCompressor(level=1).compress(np.array([len(sets["set"]), len(entries["key"])], "<i8").tobytes() + b"".join(c.tobytes() for c in columns))


def unpack(raw: bytes) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    import zstandard

    plain = zstandard.ZstdDecompressor().decompress(raw)
    sizes, at, out = np.frombuffer(plain, "<i8", 2), 16, []
    for n, kinds in zip(sizes.tolist(), (_SETS, _ENTRIES), strict=True):
        columns = {}
        for name, kind, *shape in kinds:
            width = shape[0] if shape else (1,)
            x = np.frombuffer(plain, kind, n * width[0], at)
            columns[name], at = x.reshape(n, *shape[0]) if shape else x, at + x.nbytes
        out.append(columns)
    return out[0], out[1]


def points(s: np.ndarray, at: np.ndarray, num: int, den: int, common_hash: np.ndarray, common_count: np.ndarray) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """(sets, entries) of some documents' shingles, equal sets once; a count of more than 254 is 255, which bounds nothing."""
    ids, sizes = set_ids(s, at), np.diff(at)
    _, once = np.unique(ids, return_index=True)
    once = np.sort(once[sizes[once] > 0])
    size = sizes[once]
    first = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    s = s[np.repeat(at[once] - first[:-1], size) + np.arange(int(first[-1]))]
    key, of, left = keys(s, first, num, den, common_hash, common_count)
    return {"set": ids[once], "size": size, "point": np.minimum(counts_of(s, first, COARSE), 255).astype(np.uint8)}, {"key": key, "of": of, "left": left}


def _listing(n: int, num: int, den: int, buckets: int, common_hash: np.ndarray, common_count: np.ndarray):
    def run(batches):
        """(bucket, packed): what the shingles of a bucket have in a batch."""
        for b in batches:
            sets, e = points(*shingle_sets(*common.utf8(b.column(0)), n), num, den, common_hash, common_count)
            if len(e["key"]):
                to = (e["key"] >> _U(40)).astype(np.int64) % buckets
                order = np.argsort(to, kind="stable")
                there, cut = np.unique(to[order], return_index=True)
                blobs = []
                for part in np.split(order, cut[1:]):
                    own, of = np.unique(e["of"][part], return_inverse=True)
                    blobs.append(pack({k: x[own] for k, x in sets.items()}, {"key": e["key"][part], "of": of, "left": e["left"][part]}))
                yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "listed"])

    return run


class Trees:
    """The points under some shingles, all of each: what candidates hold together."""

    def __init__(self, packed: list[tuple[dict[str, np.ndarray], dict[str, np.ndarray]]], num: int, den: int):
        self.num, self.den = num, den
        base = np.concatenate([[0], np.cumsum([len(s["set"]) for s, _ in packed])])
        ids, first, back = np.unique(np.concatenate([s["set"] for s, _ in packed]), return_index=True, return_inverse=True)
        self.ids = ids
        self.size = np.concatenate([s["size"] for s, _ in packed])[first].astype(np.int64)
        self.point = np.concatenate([s["point"] for s, _ in packed])[first]
        self.vague = (self.point == 255).any(1)
        key = np.concatenate([e["key"] for _, e in packed])
        of = back[np.concatenate([e["of"].astype(np.int64) + b for (_, e), b in zip(packed, base.tolist(), strict=False)])]
        left = np.concatenate([e["left"] for _, e in packed])
        order = np.lexsort((of, key))
        key, of, left = key[order], of[order], left[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
        key, self.of, self.left = key[fresh], of[fresh], left[fresh].astype(np.int64)
        fresh = np.ones(len(key), bool)
        fresh[1:] = key[1:] != key[:-1]
        self.first = np.flatnonzero(fresh)
        self.count = np.diff(np.append(self.first, len(key)))

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the bound on pairs of sets allows the overlap of a link."""
        ok = (self.num + self.den) * np.minimum(self.point[a], self.point[b]).sum(1, dtype=np.int64) >= self.num * (self.size[a] + self.size[b])
        return ok | (self.vague[a] & self.vague[b])

    def leaves(self, few: int):
        """Entries that meet under shingles of so many points at most, (entry, entry), a bounded number at a time."""
        k = (self.count > 1) & (self.count <= few)
        start, n = self.first[k], self.count[k]
        row = np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64), n) + np.arange(int(n.sum()))
        upto = np.concatenate([[0], np.cumsum(np.repeat(start + n, n) - row - 1)]).astype(np.int64)
        for s in range(0, int(upto[-1]), 1 << 19):
            k = np.arange(s, min(s + (1 << 19), int(upto[-1])))
            at = np.searchsorted(upto, k, "right") - 1
            x = row[at]
            y = x + 1 + k - upto[at]
            a, b = self.of[x], self.of[y]
            ok = self.den * np.minimum(self.size[a], self.size[b]) >= self.num * np.maximum(self.size[a], self.size[b])
            yield x[ok], y[ok]

    def tree(self, start: int, n: int) -> tuple[np.ndarray, np.ndarray, bool]:
        """(entry, entry, whether all are there) under one shingle, by searching its tree; if they are too many, what holds them together."""
        own = self.of[start : start + n]
        p = self.point[own].astype(np.int64)
        size = self.size[own]
        p[p == 255] = 1 << 20  # bounds nothing
        t = RTree(p, self.num, self.den, size)
        pairs, count, whole = [np.zeros((2, 0), np.int64)], 0, True
        for k in range(n):
            c = t.near(p[k], int(size[k]))
            pairs.append(np.stack([np.full(int((c > k).sum()), k), c[c > k]]))
            count += pairs[-1].shape[1]
            if count > DENSE * n:
                pairs, count, whole = [np.stack(common.roots(*np.concatenate(pairs, axis=1)))], 0, False
        x, y = np.concatenate(pairs, axis=1)
        return start + x, start + y, whole

    def candidates(self, few: int = FEW, most: int = TREE) -> pa.RecordBatch:
        """(u, v, shared, needed, enough): a forest of what is settled (needed 0), and pairs that further shingles may make candidates."""
        pair, shared, enough, n = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.int64(max(1, len(self.ids)))
        u, v = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def add(x: np.ndarray, y: np.ndarray) -> None:
            nonlocal pair, shared, enough
            a, b = self.of[x], self.of[y]
            first = may_link(self.size[a], self.left[x], self.size[b], self.left[y], self.num, self.den)
            pair, back = np.unique(np.concatenate([pair, a * n + b]), return_inverse=True)
            shared = np.bincount(back, np.concatenate([shared, np.ones(len(a), np.int64)])).astype(np.int64)
            enough = np.bincount(back, np.concatenate([enough, first])) > 0

        for x, y in self.leaves(few):
            add(x, y)
        for s, m in zip(self.first[self.count > few].tolist(), self.count[self.count > few].tolist(), strict=True):
            x, y, whole = self.tree(s, m) if m <= most else (np.arange(s + 1, s + m), np.full(m - 1, s), False)
            if whole:
                add(x, y)
            else:
                u, v = common.roots(np.concatenate([u, self.of[x]]), np.concatenate([v, self.of[y]]))
        ok = np.concatenate([[], *(self.near(pair[z : z + (1 << 17)] // n, pair[z : z + (1 << 17)] % n) for z in range(0, len(pair), 1 << 17))]).astype(bool)
        a, b, shared, enough = pair[ok] // n, pair[ok] % n, shared[ok], enough[ok]
        needed = least_shared(self.size[a], self.size[b], self.num, self.den)
        sure = enough & (shared >= needed)
        u, v = common.roots(np.concatenate([u, a[sure]]), np.concatenate([v, b[sure]]))
        rest, none = ~sure, np.zeros(len(u), np.int64)
        columns = [np.concatenate(c) for c in ((self.ids[u], self.ids[a[rest]]), (self.ids[v], self.ids[b[rest]]), (none, shared[rest]), (none, needed[rest]), (none == 0, enough[rest]))]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["u", "v", "shared", "needed", "enough"])


#: Packed bytes that a task takes apart at a time, a range of shingles after the other if it has more.
PACKED = 16 << 20


def _search(num: int, den: int):
    def run(batches):
        """Candidates under all shingles of a partition."""
        packed = [x.as_py() for b in batches for x in b.column("listed")]
        ranges = 1 + sum(map(len, packed)) // PACKED
        for k in range(ranges):
            part = []
            for raw in packed:
                sets, e = unpack(raw)
                if ranges > 1:
                    mine = np.flatnonzero(e["key"] % _U(ranges) == k)
                    own, of = np.unique(e["of"][mine], return_inverse=True)
                    sets, e = {n: x[own] for n, x in sets.items()}, {"key": e["key"][mine], "of": of, "left": e["left"][mine]}
                part.append((sets, e))
            if part:
                yield Trees(part, num, den).candidates()

    return run


def _identify(n: int):
    def run(batches):
        """(doc_id, text_hash, set_id, n) of every document."""
        for b in batches:
            s, at = shingle_sets(*common.utf8(b.column("text")), n)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(set_ids(s, at)), pa.array(np.diff(at))], names=["doc_id", "text_hash", "set_id", "n"])

    return run


#: Bits of a filter of ids, as a power of two: the fewest and the most.
LEAST_BITS, MOST_BITS = 22, 26


def id_bitmap(df: DataFrame, col: str, rows: int) -> np.ndarray:
    """A filter that holds every id of the column; others may pass by chance, one in 32 while ids are up to 2 million, and more beyond.

    It has 32 bits a row, and 8 MB at most, whatever the number of rows.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, (32 * rows).bit_length()))
    spread = F.pmod(F.xxhash64(F.col(col).cast("long")), F.lit(1 << bits))
    found = df.select(spread.alias("h")).groupBy((F.col("h") / 32).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h % 32 as int))")).alias("b")).toArrow()
    words = np.zeros(1 << (bits - 5), np.uint32)
    words[found.column("w").to_numpy()] = found.column("b").to_numpy().astype(np.uint32)
    return words


#: Bytes of pivots that are broadcast; more are joined by a shuffle.
PIVOT_BYTES = 32 << 20


def _links(docs: DataFrame, sets: DataFrame, block: DataFrame, num: int, den: int, n: int, chunk: int, chunk_bytes: int) -> DataFrame:
    """(u, v): links between sets that hold each component together; sets (set_id, doc_id, text_hash, n), block (node, component)."""
    member = block.select(F.col("node").alias("set_id"), F.col("component").alias("block")).unionByName(block.select(F.col("component").alias("set_id"), F.col("component").alias("block")).distinct())
    key = F.xxhash64("doc_id", "text_hash")
    member = common.written(member.join(sets, "set_id").select("set_id", "block", key.alias("key"), (F.col("n") * 8).alias("bytes")), "members")
    pieces = F.ceil(F.greatest(F.count(F.lit(1)) / chunk, F.sum("bytes") / chunk_bytes)).cast("int")
    sizes = member.groupBy("block").agg(pieces.alias("pieces"), F.count(F.lit(1)).alias("rows_"))
    many = member.count()
    member = common.join_by_key(member, sizes, "block", many)
    wanted = id_bitmap(member, "key", many)

    def gather(batches):
        for b in batches:
            h = b.column("h").to_numpy()
            part = b.filter(pa.array((wanted[h >> 5] >> (h & 31).astype(np.uint32)) & 1 == 1))
            if part.num_rows:
                _, once = np.unique(part.column("key").to_numpy(), return_index=True)
                part = part.take(pa.array(np.sort(once)))
                s, at = shingle_sets(*common.utf8(part.column("text")), n)
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(set_ids(s, at)), pa.array([s[x:y].tobytes() for x, y in zip(at, at[1:], strict=False)], pa.binary())], names=["key", "set_id", "hashes"])

    spread = F.pmod(F.xxhash64("key"), F.lit(len(wanted) * 32))
    held = docs.select("text", key.alias("key")).select("text", "key", spread.alias("h")).mapInArrow(gather, "key long, set_id long, hashes binary")
    sets = common.written(held.join(member, ["key", "set_id"]).select("block", "set_id", "pieces", "bytes", "hashes"), "blocks")

    # large blocks: one pivot, then only those who don't link with it ask all others
    large = sets.where("pieces > 1")
    pivot = large.where("set_id = block").select("block", F.col("hashes").alias("pivot"))
    few = (pivot.agg(F.sum(F.octet_length("pivot"))).first()[0] or 0) <= PIVOT_BYTES

    def against(batches):
        for b in batches:
            ok = [linked(np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(h.as_buffer(), np.uint64), num, den) for p, h in zip(b.column("pivot"), b.column("hashes"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("block", "set_id", "pieces", "bytes", "hashes")] + [pa.array(ok, pa.bool_())], names=["block", "set_id", "pieces", "bytes", "hashes", "star"])

    starred = large.join(F.broadcast(pivot) if few else pivot, "block").mapInArrow(against, "block long, set_id long, pieces int, bytes long, hashes binary, star boolean")
    starred = common.written(starred, "pivots")
    lone = starred.where("not star").groupBy("block").agg(F.ceil(F.greatest(F.count(F.lit(1)) / chunk, F.sum("bytes") / chunk_bytes)).cast("int").alias("cj"))
    split = starred.join(lone, "block")
    place = lambda c, *salt: F.pmod(F.xxhash64("set_id", *salt), F.col(c)).cast("int")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    everyone = split.select("block", place("pieces").alias("i"), each("cj").alias("j"), "set_id", "hashes", "star", F.lit(False).alias("asks"))
    askers = split.where("not star").select("block", each("pieces").alias("i"), place("cj", F.lit(1)).alias("j"), "set_id", "hashes", "star", F.lit(True).alias("asks"))
    small = sets.where("pieces = 1").select("block", F.lit(0).alias("i"), F.lit(0).alias("j"), "set_id", "hashes", F.lit(False).alias("star"), F.lit(True).alias("asks"))

    def compare(key, table):
        t = table.sort_by([("set_id", "ascending"), ("asks", "descending")])
        ids = t.column("set_id").to_numpy()
        keep = np.ones(len(ids), bool)
        keep[1:] = ids[1:] != ids[:-1]  # an asker that is in the chunk itself, or a document listed twice, counts once
        t = t.filter(pa.array(keep))
        hashes = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("hashes")]
        found = join_block(t.column("set_id").to_pylist(), hashes, t.column("asks").to_numpy(), t.column("star").to_numpy(), num, den)
        return pa.table([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["u", "v"])

    links = small.unionByName(everyone).unionByName(askers).groupBy("block", "i", "j").applyInArrow(compare, "u long, v long")
    return links.unionByName(starred.where("star and set_id <> block").select(F.col("set_id").alias("u"), F.col("block").alias("v")))


def groups(documents: DataFrame, num: int, den: int, n: int, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, text_hash, n, component_id, best_hash, rows_) of every row.

    The component's first row by doc_id (null last) and hash of the text is (component_id, best_hash); rows_: how many it has.
    """
    spark = documents.sparkSession
    common.prepare(spark)
    parts = common.parallelism(spark)
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    listed = docs.select("text").mapInArrow(_listing(n, num, den, 2 * parts, *frequent(docs, n)), "bucket int, listed binary")
    found = listed.repartition(parts, "bucket").mapInArrow(_search(num, den), "u long, v long, shared long, needed long, enough boolean")
    found = found.groupBy("u", "v").agg(F.sum("shared").alias("shared"), F.min("needed").alias("needed"), F.max("enough").alias("enough"))
    hanging = common.written(found.where("needed = 0 or (enough and shared >= needed)").select("u", "v"), "candidates")
    block = common.components(hanging, "u", "v")  # node, component: all but the smallest of each block
    per_doc = common.written(docs.select("doc_id", "text_hash", "text").mapInArrow(_identify(n), "doc_id long, text_hash long, set_id long, n long"), "documents")
    common.free(hanging)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    sets = per_doc.where("n > 0").groupBy("set_id").agg(first, F.count(F.lit(1)).alias("rows_"), F.first("n").alias("n"))
    sets = common.written(sets.select("set_id", "first.doc_id", "first.text_hash", "rows_", "n"), "sets")
    with common.passing():
        links = common.written(_links(docs, sets, block, num, den, n, chunk, chunk_bytes), "links", outside=True)
    common.free(block)
    found = common.components(links, "u", "v")
    common.free(links)

    # the first row and the number of rows of each component, told to its sets and from there to its rows
    labelled = sets.join(found, F.col("set_id") == F.col("node"), "left").select("set_id", "doc_id", "text_hash", "rows_", F.coalesce("component", "set_id").alias("label"))
    labelled = common.written(labelled, "labels")
    of_label = labelled.groupBy("label").agg(first, F.sum("rows_").alias("all_"), F.count(F.lit(1)).alias("rows_"))
    told = common.join_by_key(labelled.select("set_id", "label", F.col("rows_").alias("own_")), of_label, "label", labelled.count())
    told = common.written(told.select("set_id", F.col("first.doc_id").alias("component_id"), F.col("first.text_hash").alias("best_hash"), "all_", F.col("own_").alias("rows_")), "told")
    common.free(sets, found, labelled)
    out = common.join_by_key(per_doc.where("n > 0"), told, "set_id", per_doc.count()).select("doc_id", "text_hash", "n", "component_id", "best_hash", F.col("all_").alias("rows_"))
    return out.unionByName(per_doc.where("n = 0").select("doc_id", "text_hash", "n", F.col("doc_id").alias("component_id"), F.col("text_hash").alias("best_hash"), F.lit(1).cast("long").alias("rows_")))


def join(documents: DataFrame, num: int = 9, den: int = 10, n: int = 3, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, n_shingles, component_id): links have a Jaccard similarity of num/den at least; component_id is the smallest doc_id reached.

    Null, empty or blank text: no shingle, linked with nothing, its own component. Fewer than n words are one shingle.
    Repeated rows link with each other like any equal texts; a row without id is in the component of what it links with.
    Other columns are ignored, whatever their names. An empty table gives no row. Texts of any length count whole.
    """
    return groups(documents, num, den, n, id_col, text_col, chunk, chunk_bytes).select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def one_of_each(documents: DataFrame, num: int, den: int, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, all columns, without those that link with a row of smaller doc_id, directly or not.

    Of rows that share a doc_id, or have none, the one of the smaller hash of the text stays, and of equal rows one. A row
    without id stays only if no row of its component has one. Documents without words all stay.
    """
    with common.passing():
        g = common.written(groups(documents, num, den, n, id_col, text_col).where("rows_ > 1"), "groups")
        best = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("best_hash"))
        keys = [F.col("doc_id").alias("i"), F.col("text_hash").alias("h")]
        gone = common.written(g.where(~best).select(*keys).distinct(), "gone", outside=True)
        again = common.written(g.where(best).groupBy(*keys).count().where("count > 1").drop("count"), "again", outside=True)
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc"), F.xxhash64(f"`{text_col}`").alias("hash"))
    is_row = F.col("doc").eqNullSafe(F.col("i")) & (F.col("hash") == F.col("h"))
    listed = gone.unionByName(again).select(F.xxhash64("i", "h").alias("key"))
    told = documents.sparkSession.sparkContext.broadcast(id_bitmap(listed, "key", listed.count()))

    @F.pandas_udf("boolean")
    def may_be_listed(h: pd.Series) -> pd.Series:
        h, words = h.to_numpy(), told.value
        return pd.Series((words[h >> 5] >> (h & 31).astype(np.uint32)) & 1 == 1)

    # most rows are in neither list, and the filter tells so where they are read: only the others are shuffled
    spread = F.pmod(F.xxhash64(F.xxhash64("doc", "hash")), F.lit(len(told.value) * 32))
    rows = rows.withColumn("asked", may_be_listed(spread))
    kept = rows.where("asked").drop("asked").join(gone, is_row, "left_anti")
    if not again.isEmpty():
        once = kept.join(again, is_row, "left_semi").dropDuplicates(["doc", "hash"])
        kept = kept.join(again, is_row, "left_anti").unionByName(once)
    return rows.where("not asked").select("row.*").unionByName(kept.select("row.*"))
