"""Language identification by nearest centroids of character n-gram vectors.

A text is the vector of its byte 1- to 3-grams (ASCII letters lower-cased, every other ASCII byte a blank), hashed into
DIMS places, weighted by 1 + ln(count) and inverse document frequency and brought to length one. Each language has a few
centroids, found by spherical k-means on a bounded sample of its labelled texts; a text gets the language of the centroid
of largest cosine, and is rejected where that cosine is below what the language's own sample shows. Whole texts are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

DIMS = 8192
#: Labelled texts of each language that the fit looks at, chosen by a hash of the id; the bound of what reaches the driver.
SAMPLE = 400
CENTROIDS = 4
UNKNOWN = "und"
_CHUNK = 128

_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    of: np.ndarray
    floor: np.ndarray


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """n-gram counts of each document, documents x DIMS."""
    n = len(offsets) - 1
    out = np.zeros(n * DIMS, np.float32)
    b = _FOLD[data].astype(np.uint32)
    doc = np.repeat(np.arange(n, dtype=np.int64) * DIMS, np.diff(offsets))
    for k, seed in ((1, 0x2C1B3C6D), (2, 0x297A2D39), (3, 0x9E3779B1)):
        if len(b) < k:
            break
        h = b[: len(b) - k + 1].copy()
        for i in range(1, k):
            h = h * np.uint32(257) + b[i : len(b) - k + 1 + i]
        h = ((h + np.uint32(k)) * np.uint32(seed)) >> np.uint32(32 - 13)
        at = doc[: len(h)]
        ok = at == doc[k - 1 :]
        ok &= b[: len(h)] != 32 if k == 1 else True
        out += np.bincount((at + h)[ok], minlength=n * DIMS).astype(np.float32)
    return out.reshape(n, DIMS)


def vectors(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(c) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def _clusters(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; the first centre is the mean, each further one the text farthest from those before."""
    centres = x.mean(0, keepdims=True)
    centres /= max(np.linalg.norm(centres), 1e-12)
    while len(centres) < min(k, len(x)):
        centres = np.vstack([centres, x[np.argmin((x @ centres.T).max(1))]])
    for _ in range(rounds):
        own = (x @ centres.T).argmax(1)
        for j in range(len(centres)):
            if (own == j).any():
                centres[j] = x[own == j].mean(0)
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def fit(c: np.ndarray, languages: list[str], clusters: int = CENTROIDS, slack: float = 0.5) -> Model:
    """Model from the counts and languages of the sample. floor: slack times the lowest hundredth of its own cosines."""
    idf = (np.log((1 + len(c)) / (1 + (c > 0).sum(0))) + 1).astype(np.float32)
    x, names = vectors(c, idf), sorted(set(languages))
    y = np.array([names.index(a) for a in languages])
    parts = [_clusters(x[y == k], clusters) for k in range(len(names))]
    of = np.repeat(np.arange(len(names)), [len(p) for p in parts])
    floor = np.array([slack * np.quantile((x[y == k] @ parts[k].T).max(1), 0.01) for k in range(len(names))])
    return Model(idf, np.vstack(parts).astype(np.float32) if parts else np.zeros((0, DIMS), np.float32), names, of, floor)


def _letters(text: bytes) -> bool:
    return any(ch.isalpha() for ch in text.decode("utf-8", "replace"))


_SPARSE = pa.schema([("lang", pa.string()), ("at", pa.binary()), ("n", pa.binary())])


def train(documents: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Fit on rows where may_learn holds and lang is not null; of each language about `sample` rows at most, by a hash of the id."""
    common.prepare(documents.sparkSession)
    d = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), may_learn.alias("may")).where("may and lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in d.groupBy("lang").count().collect()}
    if not sizes:
        return fit(np.zeros((0, DIMS), np.float32), [])
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, sample / n)])[F.col("lang")]
    chosen = d.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share * 1_000_003)

    def run(batches):
        for b in batches:
            for s in range(0, b.num_rows, _CHUNK):
                part = b.slice(s, _CHUNK)
                c, at, n = counts(*common.utf8(part.column("text"))), [], []
                for row in c:
                    there = np.flatnonzero(row)
                    at.append(there.astype("<u2").tobytes())
                    n.append(row[there].astype("<f4").tobytes())
                yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array(at, pa.binary()), pa.array(n, pa.binary())], schema=_SPARSE)

    rows = chosen.select("text", "lang").mapInArrow(run, "lang string, at binary, n binary").collect()
    c, languages = np.zeros((len(rows), DIMS), np.float32), []
    for k, r in enumerate(rows):
        c[k, np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["n"], "<f4")
        languages.append(r["lang"])
    order = sorted(range(len(rows)), key=lambda k: (languages[k], bytes(rows[k]["at"]), bytes(rows[k]["n"])))  # not the order in which tasks end
    return fit(c[order], [languages[k] for k in order])


def judge(data: np.ndarray, off: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the language, cosine, rejected) of each text; the index after the last language is 'und'."""
    n = len(off) - 1
    alpha = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data | 32 >= 97) & (data | 32 <= 122) & (data < 128), out=alpha[1:])
    letters = alpha[off[1:]] > alpha[off[:-1]]
    for k in np.flatnonzero(~letters & (np.diff(off) > 0)):
        letters[k] = _letters(data[off[k] : off[k + 1]].tobytes())
    if not len(model.of):
        return np.zeros(n, int), np.zeros(n), np.ones(n, bool)
    cos = vectors(counts(data, off), model.idf) @ model.centroids.T
    best = cos.argmax(1)
    lang = np.where(letters, model.of[best], len(model.languages))
    score = np.where(letters, np.clip(cos[np.arange(n), best].astype(np.float64), 0, 1), 0.0)
    return lang, score, ~letters | (score < np.append(model.floor, 2)[lang])


def predict(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected) for every row; score: the best cosine.

    Null text or one without a letter: 'und', 0, rejected. Without any learned language every text is that. Ties go to the
    language that comes first by name. Repeated rows each get their answer; other columns are ignored.
    """
    common.prepare(documents.sparkSession)
    names = np.array([*model.languages, UNKNOWN], object)

    def run(batches):
        for b in batches:
            for s in range(0, b.num_rows, _CHUNK):
                part = b.slice(s, _CHUNK)
                lang, score, rejected = judge(*common.utf8(part.column(1)), model)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names[lang], pa.string()), pa.array(score), pa.array(rejected)], names=[id_col, "lang_pred", "score", "rejected"])

    kind = dict(documents.dtypes)[id_col]
    return documents.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, rejected boolean")


def accepted(documents: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows, all columns as they are, that predict() does not reject."""
    common.prepare(documents.sparkSession)
    at = documents.columns.index(text_col)

    def run(batches):
        for b in batches:
            for s in range(0, b.num_rows, _CHUNK):
                part = b.slice(s, _CHUNK)
                yield part.filter(pa.array(~judge(*common.utf8(part.column(at)), model)[2]))

    return documents.mapInArrow(run, documents.schema)
