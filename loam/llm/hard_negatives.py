"""Hard negatives: for each anchor and each of its nearest rows of the same label, the best rows of other labels within a band of scores.

Scores are integer inner products of scaled vectors. All vectors are rotated onto the principal axes of the whole table, so
that most of a product is in the leading components: products are accumulated axis by axis group, what is missing is
bounded by the norms of the remainders plus slack for rounding, and pairs that the bound rules out are dropped early. The
others are verified by their integer product, so rotation, bounds and seeds change speed, never results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: A negative's score is from LOW to HIGH hundredths of the positive's.
LOW, HIGH = 50, 95
#: Bytes of the anchors that are searched for at a time; they are broadcast, so this bounds the driver and every worker.
PART_BYTES = 64 << 20
#: One row in so many is searched first. What it finds bounds what can be among the best, so each task passes on little.
SEED = 16
#: Rows and anchors that meet in one matrix product; the first rows come in smaller groups, to have bounds early.
ROWS, ANCHORS, FIRST = 4096, 512, (64, 512)
#: Squared length of a scaled vector up to which all scores are whole numbers of 63 bits.
LARGEST = float(1 << 62)
_LEAST = -(1 << 62) - 1
_NONE = (1 << 63) - 1


def scaled(x: np.ndarray, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Whole components floor(scale * x), and which vectors are short enough to be scored."""
    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
        fits = (y * y).sum(1) <= LARGEST
    y[~fits] = 0
    return y.astype(np.int64), fits


def vectors(batches, dims: int, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, whole components) of batches id, label, e; shorter vectors end in zeros, those not to be scored are left out."""
    for b in batches:
        lists = b.column("e")
        size = lists.value_lengths().to_numpy()
        x = np.zeros((b.num_rows, dims))
        x[np.arange(dims) < size[:, None]] = lists.flatten().to_numpy()
        y, fits = scaled(x, scale)
        yield b.column("id").to_numpy()[fits], b.column("label").to_numpy()[fits], y[fits]


def moments(rows: DataFrame, dims: int, scale: int) -> np.ndarray:
    """Sum of the products of every two components over all rows: partial sums by partition, added up by line of the matrix."""

    def partial(batches):
        total = np.zeros((dims, dims))
        for _, _, y in vectors(batches, dims, scale):
            y = y.astype(np.float64)
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array([line.tobytes() for line in total], pa.binary())], names=["line", "sums"])

    def added(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.float64) for x in table.column("sums").to_pylist())
        return pa.table({"line": table.column("line").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    sums = rows.mapInArrow(partial, "line long, sums binary").groupBy("line").applyInArrow(added, "line long, sums binary")
    out = np.zeros((dims, dims))
    for r in sums.collect():  # one line for each component
        out[r["line"]] = np.frombuffer(r["sums"], np.float64)
    return out


def axes(moment: np.ndarray) -> np.ndarray:
    """Columns: orthonormal principal axes, those of most weight first."""
    finite = np.nan_to_num(moment / max(np.abs(moment).max(initial=0.0), 1.0))
    return np.ascontiguousarray(np.linalg.eigh(finite)[1][:, ::-1])


@dataclass
class Rotated:
    """Vectors on the principal axes, with the norms of what follows each group of axes."""

    whole: np.ndarray
    turned: np.ndarray
    norm: np.ndarray
    rest: np.ndarray  # (groups, vectors)

    @classmethod
    def of(cls, whole: np.ndarray, axes_: np.ndarray, ends: list[int]) -> Rotated:
        turned = whole.astype(np.float64) @ axes_
        square = turned * turned
        rest = np.sqrt(np.array([square[:, e:].sum(1) for e in ends]))
        return cls(whole, turned, np.sqrt(square.sum(1)), rest)

    def take(self, k) -> Rotated:
        return Rotated(self.whole[k], self.turned[k], self.norm[k], self.rest[:, k])


def ends_of(dims: int) -> list[int]:
    """Where the groups of axes end: an eighth, a quarter, half and all of them."""
    return sorted({max(1, dims // 8), max(1, dims // 4), max(1, dims // 2), dims})


def surviving(a: Rotated, x: Rotated, ends: list[int], need: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): pairs whose product may be from need[i] to most[i]; all such pairs, and as few others as the bounds allow."""
    slack = 64 * max(ends[-1], 1) * np.finfo(np.float64).eps
    product, i, j, begin = np.zeros((len(a.norm), len(x.norm))), None, None, 0
    for g, end in enumerate(ends):
        if i is None:
            product += a.turned[:, begin:end] @ x.turned[:, begin:end].T
            room = a.rest[g][:, None] * x.rest[g] + (slack * a.norm)[:, None] * x.norm
            fits = (product + room >= need[:, None]) & (product - room <= most[:, None])
            if g == len(ends) - 1 or 8 * np.count_nonzero(fits) <= fits.size:
                i, j = np.nonzero(fits)
                product = product[i, j]
        else:
            for s in range(0, len(i), 1 << 15):
                k = slice(s, s + (1 << 15))
                product[k] += np.einsum("ij,ij->i", a.turned[i[k], begin:end], x.turned[j[k], begin:end])
            room = a.rest[g][i] * x.rest[g][j] + slack * a.norm[i] * x.norm[j]
            fits = (product + room >= need[i]) & (product - room <= most[i])
            i, j, product = i[fits], j[fits], product[fits]
        begin = end
    return i, j


def exact(a: Rotated, x: Rotated, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i), np.int64)
    for s in range(0, len(i), 1 << 15):
        k = slice(s, s + (1 << 15))
        out[k] = np.einsum("ij,ij->i", a.whole[i[k]], x.whole[j[k]])
    return out


class Best:
    """For each anchor and band, the first k rows by score (higher first) and id."""

    def __init__(self, anchors: int, bands: int, k: int) -> None:
        self.score = np.full((anchors, bands, k), _LEAST)
        self.id = np.full((anchors, bands, k), _NONE)

    def merge(self, band: int, i: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        k = self.score.shape[2]
        worst, of = self.score[i, band, -1], self.id[i, band, -1]
        new = (score > worst) | ((score == worst) & (ids < of))
        i, score, ids = i[new], score[new], ids[new]
        if len(i):
            u = np.unique(i)
            i, score, ids = np.concatenate([np.repeat(u, k), i]), np.concatenate([self.score[u, band].ravel(), score]), np.concatenate([self.id[u, band].ravel(), ids])
            order = np.lexsort((ids, -score, i))
            i, score, ids = i[order], score[order], ids[order]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            first = rank < k
            self.score[i[first], band, rank[first]] = score[first]
            self.id[i[first], band, rank[first]] = ids[first]


@dataclass
class Wanted:
    """Anchors in order of their labels, and what is looked for: rows of the same label or of others, by bands of scores."""

    ids: np.ndarray
    labels: np.ndarray
    at: Rotated
    same: bool
    low: np.ndarray  # (anchors, bands)
    high: np.ndarray
    k: int
    score: np.ndarray | None = None  # the worst (score, id) that can still be among the best, as the seeds have it
    id: np.ndarray | None = None

    def search(self, batches, dims: int, scale: int, axes_: np.ndarray) -> Best:
        ends, best = ends_of(dims), Best(*self.low.shape, self.k)
        held: list[tuple] = []
        firsts = list(FIRST)

        def meet() -> None:
            ids, labels, whole = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            s = 0
            while s < len(ids):
                z = s + (firsts.pop(0) if firsts else ROWS)
                self._meet(best, ids[s:z], labels[s:z], Rotated.of(whole[s:z], axes_, ends), ends)
                s = z

        for x in vectors(batches, dims, scale):
            held.append(x)
            if sum(len(y[0]) for y in held) >= ROWS:
                meet()
        if held:
            meet()
        return best

    def _meet(self, best: Best, ids: np.ndarray, labels: np.ndarray, x: Rotated, ends: list[int]) -> None:
        if self.same:
            order = np.argsort(labels, kind="stable")
            values, first = np.unique(labels[order], return_index=True)
            for v, a, z in zip(values, first, [*first[1:], len(order)], strict=True):
                s, e = np.searchsorted(self.labels, v), np.searchsorted(self.labels, v, "right")
                rows = order[a:z]
                for t in range(s, e, ANCHORS):
                    self._block(best, slice(t, min(e, t + ANCHORS)), ids[rows], labels[rows], x.take(rows), ends)
        else:
            for t in range(0, len(self.ids), ANCHORS):
                self._block(best, slice(t, t + ANCHORS), ids, labels, x, ends)

    def _block(self, best: Best, part: slice, ids: np.ndarray, labels: np.ndarray, x: Rotated, ends: list[int]) -> None:
        a, low, high = self.at.take(part), self.low[part], self.high[part]
        need = np.maximum(low, best.score[part, :, -1])
        if self.score is not None:
            need = np.maximum(need, self.score[part])
        open_ = need <= high
        if not open_.any():
            return
        need, most = np.where(open_, need, _NONE).min(1), np.where(open_, high, _LEAST).max(1)
        i, j = surviving(a, x, ends, need.astype(np.float64), most.astype(np.float64))
        other = (ids[j] != self.ids[part][i]) & ((labels[j] == self.labels[part][i]) == self.same)
        i, j = i[other], j[other]
        score, row = exact(a, x, i, j), ids[j]
        for band in range(low.shape[1]):
            fits = (score >= low[i, band]) & (score <= high[i, band])
            if self.score is not None:
                worst = self.score[part][i, band]
                fits &= (score > worst) | ((score == worst) & (row <= self.id[part][i, band]))
            best.merge(band, i[fits] + part.start, score[fits], row[fits])


def _first(rows: DataFrame, wanted: Wanted, dims: int, scale: int, axes_: np.ndarray) -> tuple[DataFrame, object]:
    """(anchor, band, id, score, rank) of the best over all rows, and the broadcast it reads."""
    told = rows.sparkSession.sparkContext.broadcast((wanted, axes_))

    def run(batches):
        w, turn = told.value
        best = w.search(batches, dims, scale, turn)
        a, band, k = np.nonzero(best.id != _NONE)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (a, band, best.id[a, band, k], best.score[a, band, k])], names=["anchor", "band", "id", "score"])

    found = rows.mapInArrow(run, "anchor long, band long, id long, score long")
    by = Window.partitionBy("anchor", "band").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= wanted.k), told


def _arrays(found: DataFrame, told, shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids by (anchor, band, rank) of the anchors at hand."""
    score, ids = np.full(shape, _LEAST), np.full(shape, _NONE)
    t = found.toArrow()
    told.destroy()
    at = tuple(t.column(c).to_numpy() - s for c, s in (("anchor", 0), ("band", 0), ("rank", 1)))
    score[at], ids[at] = t.column("score").to_numpy(), t.column("id").to_numpy()
    return score, ids


def mine(
    rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
    part_bytes: int = PART_BYTES, seed: int = SEED,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of which the column anchor is true.

    A vector's components are floor(scale * x); a score is the whole inner product with the anchor's; higher scores come
    first, ties by smaller id. An anchor's positives are its first other rows of the same label, and its negatives, for
    each of them, the first rows of other labels that have low to high hundredths of the positive's score (so none where
    that is below 0). Rows whose id, label or vector is null, or whose vector holds a null or a non-finite number, take no
    part, nor do vectors whose scaled length passes 2**31, as their scores may not fit a long. Shorter vectors count as
    ending in zeros. Repeated rows are rows like others, but a row of the anchor's own id is none of its positives or
    negatives. Other columns are ignored; a table without anchors gives no row.

    Anchors, a query set, are searched for in parts of part_bytes against all rows where those are read, so the table is
    read four times for each part; nothing but each task's best rows is shuffled.
    """
    spark = rows.sparkSession
    common.prepare(spark)
    e = F.col("e")
    all_rows = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), F.col(f"`{vec_col}`").cast("array<double>").alias("e"), anchor.alias("asks"))
    all_rows = all_rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & e.isNotNull() & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    dims, asking = all_rows.agg(F.max(F.size("e")), F.count_if("asks")).first()
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not asking:
        return empty
    dims = max(dims, 1)
    parts = 1 + asking * dims * 16 // part_bytes
    asks = all_rows.where("asks").select("id", "label", "e").withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)))
    asks = common.written(asks, "anchors")
    source = all_rows.select("id", "label", "e")
    turn = axes(moments(source, dims, scale))
    return reduce(DataFrame.unionByName, [_mined(source, asks.where(F.col("part") == k), turn, dims, positives, negatives, low, high, scale, seed) for k in range(parts)])


def _mined(rows: DataFrame, asks: DataFrame, turn: np.ndarray, dims: int, positives: int, negatives: int, low: int, high: int, scale: int, seed: int) -> DataFrame:
    """What the anchors of one part get, as a scratch table."""
    read = list(vectors(asks.select("id", "label", "e").toArrow().to_batches(), dims, scale))
    ids, labels, whole = (np.concatenate([x[k] for x in read]) if read else np.zeros((0, dims)[: 1 + (k == 2)], np.int64) for k in range(3))
    order = np.lexsort((ids, labels))
    ids, labels, at = ids[order], labels[order], Rotated.of(whole[order], turn, ends_of(dims))
    n = len(ids)
    some = rows.where(F.pmod(F.xxhash64("id", "e"), F.lit(seed)) == 0)

    def best(same: bool, lows: np.ndarray, highs: np.ndarray, k: int) -> tuple[DataFrame, object]:
        shape = (*lows.shape, k)
        score, id_ = _arrays(*_first(some, Wanted(ids, labels, at, same, lows, highs, k), dims, scale, turn), shape)
        return _first(rows, Wanted(ids, labels, at, same, lows, highs, k, score[:, :, -1], id_[:, :, -1]), dims, scale, turn)

    score, of = (x[:, 0] for x in _arrays(*best(True, np.full((n, 1), _LEAST + 1), np.full((n, 1), _NONE - 1), positives), (n, 1, positives)))
    there = of != _NONE
    held = np.where(there & (score >= 0), score, 0)
    # ceil(low * s / 100) and floor(high * s / 100) without passing 63 bits
    q, r = held // 100, held % 100
    lows, highs = q * low + -(-r * low // 100), q * high + r * high // 100
    wanted = there & (score >= 0)
    found, told = best(False, np.where(wanted, lows, 1), np.where(wanted, highs, 0), negatives)
    names = rows.sparkSession.sparkContext.broadcast((ids, of, score))

    def named(batches):
        anchor_ids, positive, scores = names.value
        for b in batches:
            a, band = b.column("anchor").to_numpy(), b.column("band").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor_ids[a]), pa.array(positive[a, band]), b.column("rank"), b.column("id"), pa.array(scores[a, band]), b.column("score")],
                names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
            )

    out = common.written(found.mapInArrow(named, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"), "mined")
    told.destroy()
    names.destroy()
    return out
