"""Harmonic packing: documents of a length class fill sequences by a fixed count, each worker on its own.

Class k (1 to CLASSES) holds lengths from size/(k+1), excluded, to size/k; the last class holds all shorter ones too. A
sequence of class k is closed by its k-th document, so a worker keeps one open sequence for each class and decides about a
document when it comes. Documents may be cut, so what a closed sequence lacks is filled up: with the beginning of a
document longer than a sequence, or with a document that the gaps still open take whole. At the end of a worker's rows
what is open is strung together, and the last tokens become sequences of powers of two, which need no padding either.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .packing import encode, encoder

SIZE = 2048
END = 1
#: Length classes; a worker's open sequences hold CLASSES * (CLASSES + 1) / 2 documents at most.
CLASSES = 64

#: A piece: document (id, tokens in all), the ids before it, its ids.
Piece = tuple[tuple[int | None, int], int, np.ndarray]


class Packer:
    """Packs documents as they come; every method yields finished sequences, each a list of pieces."""

    def __init__(self, size: int = SIZE, classes: int = CLASSES) -> None:
        self.size, self.classes = size, classes
        self.open: list[list[Piece]] = [[] for _ in range(classes + 1)]
        self.gaps: list[tuple[int, int, list[Piece]]] = []  # (-gap, number, pieces) of closed sequences, largest gap first
        self.lacking = self.closed = 0

    def add(self, doc: tuple[int | None, int], ids: np.ndarray) -> Iterator[list[Piece]]:
        n, at = len(ids), 0
        if n > self.size or n <= self.lacking:
            at = yield from self._fill(doc, ids, 0)
        while n - at >= self.size:
            yield [(doc, at, ids[at : at + self.size])]
            at += self.size
        if at < n:
            k = min(self.size // (n - at), self.classes)
            self.open[k].append((doc, at, ids[at:].copy()))
            if len(self.open[k]) == k:
                yield from self._close(self.open[k])
                self.open[k] = []

    def _close(self, pieces: list[Piece]) -> Iterator[list[Piece]]:
        gap = self.size - sum(len(p[2]) for p in pieces)
        if gap:
            heapq.heappush(self.gaps, (-gap, self.closed, pieces))
            self.closed += 1
            self.lacking += gap
        else:
            yield pieces

    def _fill(self, doc: tuple[int | None, int], ids: np.ndarray, before: int):
        """Cuts ids into the gaps, as long as there are both; how many went."""
        at = 0
        while self.gaps and at < len(ids):
            gap, number, pieces = heapq.heappop(self.gaps)
            part = ids[at : at - gap]
            pieces.append((doc, before + at, part.copy()))
            at += len(part)
            self.lacking -= len(part)
            if len(part) == -gap:
                yield pieces
            else:
                heapq.heappush(self.gaps, (gap + len(part), number, pieces))
        return at

    def finish(self) -> Iterator[list[Piece]]:
        rest: list[Piece] = []
        for doc, before, ids in (p for pieces in reversed(self.open) for p in pieces):  # the shortest are cut last of all
            at = yield from self._fill(doc, ids, before)
            if at < len(ids):
                rest.append((doc, before + at, ids[at:]))
        rest += [p for _, _, pieces in sorted(self.gaps, key=lambda g: g[:2]) for p in pieces]
        left, k, at = sum(len(p[2]) for p in rest), 0, 0
        while left:
            want = self.size if left >= self.size else 1 << (left.bit_length() - 1)
            left -= want
            pieces = []
            while want:
                doc, before, ids = rest[k]
                part = ids[at : at + want]
                pieces.append((doc, before + at, part))
                want -= len(part)
                at += len(part)
                if at == len(ids):
                    k, at = k + 1, 0
            yield pieces
        self.__init__(self.size, self.classes)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
_SQL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Sequences of one batch of results.
_SEQUENCES = 512


def pack_documents(documents: DataFrame, ranks_file: str, pattern: str, size: int = SIZE, classes: int = CLASSES, end: int = END, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]): the pieces of all documents, tokenised and packed.

    Every sequence has size ids, or a power of two of them (fewer than the bits of size from each partition of the input), so
    none is padded. Null or empty text is the end id alone. Each row, repeated or not, is a document; null ids are kept;
    other columns are ignored; an empty table gives no row. A partition is packed where it is read, row by row, without a
    shuffle: a worker holds one open sequence a class, and closed ones that lack less than two sequences' ids in all.
    sequence_id is the partition's number times 2**40 and a number within; a partition that is computed again, after a
    lost executor, takes its own sequences' place whole. ids: little-endian unsigned 32-bit.
    """
    if size < 1 or classes < 1:
        raise ValueError("a sequence has an id at least, and there is a class at least")
    common.prepare(documents.sparkSession)
    schema = _SCHEMA.append(pa.field("ids", pa.binary())) if keep_ids else _SCHEMA

    def run(batches):
        enc, packer = encoder(ranks_file, pattern), Packer(size, classes)
        number = TaskContext.get().partitionId() << 40
        rows: list[list] = [[] for _ in schema]

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)
            for c in rows:
                c.clear()
            return out

        def sequences():
            for b in batches:
                for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    text = text.as_py()
                    ids = np.array([*encode(text, enc), end] if text else [end], "<u4")
                    yield from packer.add((doc, len(ids)), ids)
            yield from packer.finish()

        for k, pieces in enumerate(sequences()):
            offset = 0
            for (doc, tokens), start, ids in pieces:
                raw = ids.tobytes()
                for column, x in zip(rows, (doc, start, len(ids), zlib.crc32(raw), tokens, number + k, offset, raw), strict=False):
                    column.append(x)
                offset += len(ids)
            if k % _SEQUENCES == _SEQUENCES - 1:
                yield batch()
        yield batch()

    d = documents.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return d.mapInArrow(run, _SQL + ", ids binary" * keep_ids).withColumnRenamed("doc_id", id_col)
