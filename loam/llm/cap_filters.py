"""Near-duplicate vectors by spherical-cap filters.

Filter directions are the words of a structured random product code: after a random rotation, the dimensions fall into
three blocks (fewer below nine dimensions) with random codewords each, and every triple of codewords is a direction; a few such codes are used. A vector belongs to the caps of all
directions whose inner product with it exceeds a threshold; block scores and their maxima prune the list decoding. Equal
labels that share a cap are candidates; they are verified by cosine in double precision. Equal vectors are one from the
start. A pair is counted in the smallest cap that both share, so no list of pairs is ever made; large caps are cut into
chunks whose pairs are compared in tasks of bounded size.
"""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Product codes, each under a rotation of its own, as a vector may lie badly in one; and the caps of each code that a
#: vector is expected to lie in. The more, the higher the recall.
CODES = 8
CAPS = 5.0
CHUNK = 1500
#: Vectors whose largest component is above this, or below its inverse, are divided by it first, as their squares would overflow or vanish.
FAR = 1e100


@lru_cache(maxsize=64)
def code(dims: int, words: int, seed: int) -> tuple[np.ndarray, list[np.ndarray], list[slice]]:
    """Rotation, codewords of each block, and the blocks."""
    rng = np.random.default_rng((seed, dims, words))
    q, _ = np.linalg.qr(rng.standard_normal((dims, dims)))
    blocks = min(3, max(1, dims // 3))  # a block of one or two dimensions has hardly any directions to choose from
    cuts = [round(k * dims / blocks) for k in range(blocks + 1)]
    parts = [slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
    books = []
    for p in parts:
        w = rng.standard_normal((words, p.stop - p.start)) if p.stop - p.start > 1 else np.array([[1.0], [-1.0]])
        books.append(w / np.linalg.norm(w, axis=1, keepdims=True) / math.sqrt(blocks))
    return q, books, parts


def decode_all(x: np.ndarray, caps: float = CAPS, words: int = 32, codes: int = CODES) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) over all codes; filters of different codes have different numbers."""
    parts = [decode(x, k, caps, words) for k in range(codes)]
    return np.concatenate([r for r, _ in parts]), np.concatenate([f + k * words**3 for k, (_, f) in enumerate(parts)])


def decode(x: np.ndarray, seed: int, caps: float = CAPS, words: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) for every filter direction that exceeds the threshold, unit vectors as rows; each row has its best one at least."""
    q, books, parts = code(x.shape[1], words, seed)
    r = x @ q
    scores = [r[:, p] @ b.T for p, b in zip(parts, books, strict=True)]
    t = NormalDist().inv_cdf(1 - min(0.5, caps / math.prod(len(b) for b in books))) / math.sqrt(x.shape[1])
    best = sum(s.max(1) for s in scores)
    limit = np.minimum(t, best - 1e-12)
    row, filt, got = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x))
    for k, s in enumerate(scores):
        rest = sum((z.max(1) for z in scores[k + 1 :]), np.zeros(len(x)))
        total = got[:, None] + s[row]
        a, w = np.nonzero(total + rest[row, None] >= limit[row, None])
        row, filt, got = row[a], filt[a] * words + w, total[a, w]
    return row, filt


def _first_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest filter that each pair of padded ascending lists shares (-1 pads)."""
    out = np.full(len(a), -1)
    left = np.arange(len(a))
    for k in range(a.shape[1]):
        mine = a[left, k]
        there = (b[left] == mine[:, None]).any(1) & (mine >= 0)
        out[left[there]] = mine[there]
        left = left[~there]
        if not len(left):
            break
    return out


class _Links:
    """What one task finds: links of each vector, and a spanning forest of the edges within each cell."""

    def __init__(self, least: float):
        self.least = least

    def small(self, t: dict, cut: np.ndarray) -> tuple[np.ndarray, ...]:
        """Links (row, row) within many small cells at once; cut: first row of each cell."""
        size = np.diff(cut)
        later = np.repeat(cut[1:], size) - np.arange(cut[0], cut[-1]) - 1
        upto = np.concatenate([[0], np.cumsum(later)])
        out = []
        for s in range(0, int(upto[-1]), 100_000):
            k = np.arange(s, min(s + 100_000, int(upto[-1])))
            a = np.searchsorted(upto, k, "right") - 1
            b = a + 1 + k - upto[a]
            out.append(self.own(t, *self.close(t, a + cut[0], b + cut[0])))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2

    def close(self, t: dict, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = np.einsum("ij,ij->i", t["x"][a], t["x"][b]) >= self.least
        return a[ok], b[ok]

    def own(self, t: dict, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Only pairs whose smallest shared cap is the one they were found in."""
        ok = _first_common(t["caps"][a], t["caps"][b]) == t["filter"][a]
        return a[ok], b[ok]

    def large(self, t: dict, s: int, e: int) -> tuple[np.ndarray, np.ndarray]:
        """Links within one cell, or between its two sides."""
        rows = np.arange(s, e)
        same = t["i"][s] == t["j"][s]
        left, right = (rows, rows) if same else (rows[t["side"][s:e] == t["i"][s]], rows[t["side"][s:e] == t["j"][s]])
        out = []
        for k in range(0, len(left), 256):
            a, b = np.nonzero(t["x"][left[k : k + 256]] @ t["x"][right].T >= self.least)
            a, b = left[a + k], right[b]
            if same:
                a, b = a[a < b], b[a < b]
            out += [self.own(t, a[z : z + 20_000], b[z : z + 20_000]) for z in range(0, len(a), 20_000)]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2

    def table(self, t: dict) -> pa.RecordBatch:
        n = len(t["rep"])
        fresh = np.ones(n, bool)
        fresh[1:] = np.any([t[k][1:] != t[k][:-1] for k in ("cell", "i", "j")], axis=0)
        cut = np.append(np.flatnonzero(fresh), n)
        big = np.flatnonzero((np.diff(cut) > 64) | (t["i"][cut[:-1]] != t["j"][cut[:-1]]))
        found, at = [], 0
        for c in [*big.tolist(), len(cut) - 1]:
            if c > at:
                found.append(self.small(t, cut[at : c + 1]))
            if c < len(cut) - 1:
                found.append(self.large(t, int(cut[c]), int(cut[c + 1])))
            at = c + 1
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        links = np.bincount(a, t["weight"][b], n) + np.bincount(b, t["weight"][a], n)
        k = np.flatnonzero(links)
        who, back = np.unique(t["rep"][k], return_inverse=True)
        total = np.bincount(back, links[k], len(who)).astype(np.int64)
        x, r = common.roots(t["rep"][a], t["rep"][b])
        u = np.concatenate([who, x]).astype(np.int64)
        nulls = lambda k: pa.nulls(k, pa.int64())
        v, total = (pa.chunked_array(c).combine_chunks() for c in ([nulls(len(who)), pa.array(r.astype(np.int64))], [pa.array(total), nulls(len(x))]))
        return pa.RecordBatch.from_arrays([pa.array(u), v, total], names=["u", "v", "links"])


def _linker(least: float, single: bool):
    def run(batches):
        """Cells come sorted; the last one of a batch may go on in the next and is held back."""
        links, held = _Links(least), None

        def columns(table):
            t = {k: table.column(k).to_numpy() for k in ("filter", "i", "j", "side", "rep", "weight", "cell")}
            raw = np.frombuffer(b"".join(v.as_py() for v in table.column("raw")), np.float32 if single else np.float64).astype(np.float64)
            t["x"] = raw.reshape(len(t["rep"]), -1)
            t["x"] /= table.column("norm").to_numpy()[:, None]
            lists = [np.frombuffer(v.as_py(), np.int64) for v in table.column("caps")]
            t["caps"] = np.full((len(lists), max(map(len, lists))), -1, np.int64)
            for k, v in enumerate(lists):
                t["caps"][k, : len(v)] = v
            return t

        def split(table):
            """Tables of one vector length each, without the last cell."""
            last = table.num_rows - 1
            cell, i, j = (table.column(k).to_numpy() for k in ("cell", "i", "j"))
            k = int(np.argmax((cell == cell[last]) & (i == i[last]) & (j == j[last])))
            return table.slice(0, k), table.slice(k)

        def done(table):
            dims = table.column("dims").to_numpy()
            for d in np.unique(dims):
                yield links.table(columns(table.filter(pa.array(dims == d))))

        for b in batches:
            if b.num_rows:
                held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
                full, held = split(held)
                if full.num_rows:
                    yield from done(full)
        if held is not None:
            yield from done(held)

    return run


def near(vectors: DataFrame, least: float = 0.98, caps: float = CAPS, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", chunk: int = CHUNK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row; links join rows of equal label with a cosine of at least `least`.

    Rows whose label is null, or whose vector is null, empty, zero or holds a null or a non-finite number, link with
    nothing. Vectors of different lengths don't link. Repeated rows are vectors like others; rows of one id are judged each
    by its own vector. A cosine of exactly `least` links; components of any finite size count. Other columns are ignored; an empty table gives no row.
    """
    spark = vectors.sparkSession
    common.prepare(spark)
    e = F.col("e")
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("e"), F.col(label_col).alias("label"))
    good = F.col("label").isNotNull() & F.col("id").isNotNull() & (F.size(e) > 0) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.withColumn("most", F.when(good, F.array_max(F.transform(e, F.abs)))).withColumn("good", F.coalesce(F.col("most") > 0, F.lit(False)))
    far = (F.col("most") > FAR) | (F.col("most") < 1 / FAR)
    v = v.withColumn("whole", e).withColumn("e", F.when(F.col("good") & far, F.transform(e, lambda x: x / F.col("most"))).otherwise(e))
    v = v.withColumn("norm", F.when(F.col("good"), F.sqrt(F.aggregate(e, F.lit(0.0), lambda a, x: a + x * x))))
    v = v.withColumn("same", F.when(F.col("good"), F.sha2(F.array_join(F.transform("whole", lambda x: x.cast("string")), ","), 256)))
    groups = v.where("good").groupBy("label", "same").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("weight"), F.min_by("e", "id").alias("e"), F.min_by("norm", "id").alias("norm"))
    groups = common.written(groups.withColumn("rep", F.xxhash64("label", "same")), "vectors")  # an id may have several vectors, so groups have a name of their own

    words = int(min(2048, max(32, round((groups.count() * 0.6) ** (1 / 3)))))  # caps hold about as many vectors at any size
    single = dict(vectors.dtypes)[vec_col] == "array<float>"

    def caps_of(batches):
        for b in batches:
            size = b.column("dims").to_numpy()
            for d in np.unique(size).tolist():
                part = b.filter(pa.array(size == d))
                x = part.column("e").flatten().to_numpy().reshape(part.num_rows, d)
                row, filt = decode_all(x / part.column("norm").to_numpy()[:, None], caps, words)
                order = np.lexsort((filt, row))
                row, filt = row[order], filt[order]
                cut = np.searchsorted(row, np.arange(part.num_rows + 1))
                lists = [filt[a:z] for a, z in zip(cut, cut[1:], strict=False)]
                raw = pa.array([r.tobytes() for r in (x.astype(np.float32) if single else x)], pa.binary())
                kept = [part.column(k) for k in ("label", "dims", "rep", "weight", "norm")]
                yield pa.RecordBatch.from_arrays([*kept, raw, pa.array([f.astype(np.int64).tobytes() for f in lists], pa.binary()), pa.array([f.tolist() for f in lists], pa.list_(pa.int64()))], names=["label", "dims", "rep", "weight", "norm", "raw", "caps", "filters"])

    kind = dict(groups.dtypes)["label"]
    tagged = groups.select("label", F.size("e").alias("dims"), "rep", "weight", "norm", "e")
    listed = common.written(tagged.mapInArrow(caps_of, f"label {kind}, dims int, rep long, weight long, norm double, raw binary, caps binary, filters array<bigint>"), "caps")
    at = listed.select("rep", "dims", F.explode("filters").alias("filter"), F.xxhash64("label", "dims").alias("of")).withColumn("cell", F.xxhash64("of", "filter"))
    sizes = at.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    cells = at.join(sizes, "cell").withColumn("c", F.ceil(F.col("n") / chunk).cast("int")).withColumn("side", F.pmod(F.xxhash64("rep"), F.col("c")).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    cells = cells.select("cell", "filter", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "rep")
    cells = cells.join(listed.select("rep", "dims", "weight", "norm", "raw", "caps"), "rep")
    order = ["cell", "i", "j"]
    sorted_ = cells.repartition(common.parallelism(spark), *order).sortWithinPartitions(*order)
    found = common.written(sorted_.mapInArrow(_linker(least, single), "u long, v long, links long"), "links")
    part = common.components(found.where("v is not null"), "u", "v")
    links = found.where("links is not null").groupBy("u").agg(F.sum("links").alias("links"))
    named = groups.select("label", "same", "rep", "least", "weight").join(part.withColumnRenamed("node", "rep"), "rep", "left").join(links.withColumnRenamed("u", "rep"), "rep", "left")
    named = common.written(named.withColumn("component", F.coalesce("component", "rep")), "named")
    lowest = named.groupBy("component").agg(F.min("least").alias("lowest"), F.count(F.lit(1)).alias("rows_"))
    of_group = common.join_by_key(named, lowest, "component", named.count())
    of_group = of_group.select("label", "same", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.col("lowest").alias("component"))
    out = v.select("id", "label", "same").join(of_group, ["label", "same"], "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
