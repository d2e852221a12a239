"""Toxicity by multiple-instance learning: labels are of documents, scores are of sentences.

A sentence's probability is a logistic function of the words in it; a document's is their noisy-or, 1 - prod(1 - p).
Only document labels are needed for training, after which the sentences that caused a score can be pointed at. Words and
their beginnings (for inflected forms) are judged by 64-bit hashes; the vocabulary is what a bounded labelled sample shows
to matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled documents of each class that the fit looks at, chosen by a hash of the id; the bound of what reaches the driver.
SAMPLE = 1500
#: Words kept: those in at least MIN_DOCS sampled documents, the VOCABULARY with the strongest association.
MIN_DOCS, VOCABULARY = 4, 4096
THRESHOLD = 0.3
#: A sentence ends after . ! ? or a line end.
_STOP = np.zeros(256, bool)
_STOP[[0x2E, 0x21, 0x3F, 0x0A]] = True
_SLOTS = 1 << 16
#: Bytes of the beginnings of longer words that count as words of their own.
BEGINNINGS = (4, 5, 6)


@dataclass(frozen=True)
class Model:
    words: np.ndarray  # hashes, sorted
    weights: np.ndarray
    bias: float


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(feature hash, its sentence, first sentence of each document, end byte of each sentence); features in order of sentences."""
    start, end, _ = common.words(data, offsets, common.NOT_ALNUM)
    c = common.prefix_hash(data, lower=True)
    h = common.range_hash(c, start, end)
    last = np.zeros(len(data), bool)
    last[np.flatnonzero(_STOP[data])] = True
    full = offsets[1:][np.diff(offsets) > 0]
    last[full - 1] = True
    stop = np.flatnonzero(last) + 1
    of = np.searchsorted(stop, start, "right")
    hs, ofs = [h], [of]
    for n in BEGINNINGS:
        k = np.flatnonzero(end - start > n)
        hs.append(common.mix(common.range_hash(c, start[k], start[k] + n)))
        ofs.append(of[k])
    h, of = np.concatenate(hs), np.concatenate(ofs)
    order = np.argsort(of, kind="stable")
    return h[order], of[order], np.searchsorted(stop, offsets, "right"), stop


def _loss_step(w, b, docs, sent_of, sent_doc, word, y, weight):
    z = b + np.bincount(sent_of, w[word], len(sent_doc))
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    log_none = np.bincount(sent_doc, np.log1p(-np.minimum(p, 1 - 1e-9)), docs)
    doc = -np.expm1(log_none)
    # d(-log likelihood)/dz: p for a clean document; -p (1 - doc) / doc for a toxic one
    g = np.where(y[sent_doc] > 0, -p * (1 - doc[sent_doc]) / np.maximum(doc[sent_doc], 1e-9), p) * weight[sent_doc]
    return np.bincount(word, g[sent_of], len(w)), g.sum()


def fit(texts: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, weight: np.ndarray, rounds: int = 300, rate: float = 0.1, l1: float = 2e-4) -> Model:
    """texts: (word hashes, sentence of each) of each document; weight: rows of the corpus that a document stands for."""
    if not len(texts) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    seen = [np.unique(h) for h, _ in texts]
    doc = np.repeat(np.arange(len(seen)), [len(x) for x in seen])
    vocabulary, at = np.unique(np.concatenate(seen), return_inverse=True)
    n1 = np.bincount(at, y[doc] > 0, len(vocabulary))
    n0 = np.bincount(at, y[doc] == 0, len(vocabulary))
    t1, t0 = (y > 0).sum(), (y == 0).sum()
    lift = np.abs(np.log((n1 + 0.5) / (t1 + 1)) - np.log((n0 + 0.5) / (t0 + 1))) * np.sqrt(n1 + n0)
    lift[n1 + n0 < MIN_DOCS] = -1
    keep = np.sort(np.argsort(-lift, kind="stable")[:VOCABULARY])
    words = vocabulary[keep[lift[keep] > 0]]
    word, sent_of, sent_doc, base = [], [], [], 0
    for k, (h, s) in enumerate(texts):
        n = int(s.max()) + 1 if len(s) else 1
        there = np.searchsorted(words, h)
        ok = (there < len(words)) & (words[np.minimum(there, len(words) - 1)] == h) if len(words) else np.zeros(len(h), bool)
        pair = np.unique(np.stack([s[ok], there[ok]]), axis=1)
        sent_of.append(pair[0] + base)
        word.append(pair[1])
        sent_doc.append(np.full(n, k))
        base += n
    word, sent_of, sent_doc = (np.concatenate(x).astype(np.int64) for x in (word, sent_of, sent_doc))
    w, b = np.zeros(len(words)), -4.0
    weight = weight / weight.sum()
    m, v, mb, vb = np.zeros(len(w)), np.zeros(len(w)), 0.0, 0.0
    for t in range(1, rounds + 1):
        g, gb = _loss_step(w, b, len(texts), sent_of, sent_doc, word, y, weight)
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.99**t
        step = rate / (np.sqrt(v / c2) + 1e-6)
        w = w - step * m / c1
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-6)
    return Model(words, w, b)


def _table(model: Model) -> tuple[np.ndarray, np.ndarray]:
    """A two-step lookup: whether any learned word shares a hash's low bits."""
    there = np.zeros(_SLOTS, bool)
    there[(model.words & np.uint64(_SLOTS - 1)).astype(np.int64)] = True
    return there, model.words


def sentence_scores(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(probability of each sentence, first sentence of each document, end byte of each sentence)."""
    h, of, first, stop = sentences(data, offsets)
    z = np.full(len(stop), model.bias)
    if len(model.words):
        there, known = _table(model)
        k = np.flatnonzero(there[(h & np.uint64(_SLOTS - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(known, h[k]), len(known) - 1)
        ok = known[at] == h[k]
        pair = np.unique(of[k[ok]] * np.int64(len(known)) + at[ok])  # a word counts once in a sentence
        z += np.bincount(pair // len(known), model.weights[pair % len(known)], len(stop))
    return 1 / (1 + np.exp(-np.clip(z, -30, 30))), first, stop


def _sample_run(batches):
    for b in batches:
        data, off = common.utf8(b.column("text"))
        h, of, first, _ = sentences(data, off)
        at = np.searchsorted(of, first)
        hs = [h[at[k] : at[k + 1]].astype("<u8").tobytes() for k in range(b.num_rows)]
        ss = [(of[at[k] : at[k + 1]] - first[k]).astype("<u4").tobytes() for k in range(b.num_rows)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array(hs, pa.binary()), pa.array(ss, pa.binary())], names=["doc_id", "toxic", "h", "s"])


def train(documents: DataFrame, labels: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fit on labelled documents where may_learn (of the id) holds; about `sample` of each class at most, by a hash of the id.

    Rows with a null label or id teach nothing; a document with several label rows counts by the largest.
    """
    common.prepare(documents.sparkSession)
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(may_learn)
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not sizes:
        return fit([], np.zeros(0), np.zeros(0))
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, sample / n)])[F.col("toxic")]
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share * 1_000_003)
    d = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = d.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text").mapInArrow(_sample_run, "doc_id long, toxic int, h binary, s binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["h"])))
    y = np.array([r["toxic"] for r in rows], float)
    got = {k: max(1, int((y == k).sum())) for k in sizes}
    weight = np.array([sizes[int(k)] / got[int(k)] for k in y])
    return fit([(np.frombuffer(r["h"], "<u8"), np.frombuffer(r["s"], "<u4").astype(np.int64)) for r in rows], y, weight)


def score(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, worst_start, worst_end, worst_score): noisy-or over the whole text, and the bytes of its worst sentence.

    A null or empty text has no sentence of its own and scores as one without known words; its worst sentence is null.
    Repeated rows each get their score; other columns are ignored.
    """
    common.prepare(documents.sparkSession)
    kind = dict(documents.dtypes)[id_col]

    def run(batches):
        for b in batches:
            data, off = common.utf8(b.column(1))
            p, first, stop = sentence_scores(model, data, off)
            none = np.zeros(len(p) + 1)
            np.cumsum(np.log1p(-np.minimum(p, 1 - 1e-9)), out=none[1:])
            total = -np.expm1(np.minimum(none[first[1:]] - none[first[:-1]], 0))
            full = first[1:] > first[:-1]
            total[~full] = 1 / (1 + np.exp(-model.bias))
            begin, end, worst = ([None] * b.num_rows for _ in range(3))
            if len(p):
                doc = np.repeat(np.arange(b.num_rows), np.diff(first))
                order = np.lexsort((np.arange(len(p)), -p, doc))
                top = order[np.searchsorted(doc, np.flatnonzero(full))]
                for k, s in zip(np.flatnonzero(full).tolist(), top.tolist(), strict=True):
                    begin[k], end[k], worst[k] = int(max(off[k], stop[s - 1] if s else 0) - off[k]), int(stop[s] - off[k]), float(p[s])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.clip(total, 0, 1)), pa.array(begin, pa.int64()), pa.array(end, pa.int64()), pa.array(worst, pa.float64())], names=[id_col, "score", "worst_start", "worst_end", "worst_score"])

    return documents.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, score double, worst_start long, worst_end long, worst_score double")


def offending(documents: DataFrame, model: Model, least: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, end, sentence_score): every sentence of at least that score, in bytes of the text."""
    common.prepare(documents.sparkSession)
    kind = dict(documents.dtypes)[id_col]

    def run(batches):
        for b in batches:
            data, off = common.utf8(b.column(1))
            p, first, stop = sentence_scores(model, data, off)
            k = np.flatnonzero(p >= least)
            doc = np.searchsorted(first, k, "right") - 1
            begin = np.where(k > first[doc], stop[np.maximum(k - 1, 0)], off[doc])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), pa.array(begin - off[doc]), pa.array(stop[k] - off[doc]), pa.array(p[k])], names=[id_col, "start", "end", "sentence_score"])

    return documents.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, start long, `end` long, sentence_score double")
