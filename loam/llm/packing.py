"""Packing of tokenised documents into sequences of a fixed length.

Lengths are packed, not rows: the counts of the 1..size lengths (a table of bounded size) are packed by the driver into
patterns with multiplicities, and every piece then finds its place from its rank among the pieces of its length. Exact
complements come first: for each length, largest first, single, pair and triple sums that exactly fill its gap are
looked up among the lengths still available and consumed as often as the counts allow; what remains goes best-fit.
"""

from __future__ import annotations

import base64
import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SIZE = 1024
END = 2
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
#: Pieces of one length that are ranked in one task; a length of more is dealt into sub-groups, as one may hold most pieces.
RANKED = 500_000

_encoders: dict[str, object] = {}


def encoder(ranks_file: str, pattern: str):
    """The byte-level BPE of a rank file; one for each worker process.

    It gives the ids that the `tokenizers` file of the same vocabulary gives, about four times as fast.
    """
    if ranks_file not in _encoders:
        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[ranks_file] = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[ranks_file]


def encode(text: str, enc) -> list[int]:
    """Ids of a whole text; the special token's string is its id, as `tokenizers` has it."""
    if SPECIAL not in text:
        return enc.encode_ordinary(text)
    parts = text.split(SPECIAL)
    ids = enc.encode_ordinary(parts[0])
    for p in parts[1:]:
        ids.append(SPECIAL_ID)
        ids += enc.encode_ordinary(p)
    return ids


_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def pieces(documents: DataFrame, ranks_file: str, pattern: str, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): every document's ids and the end id, cut if longer than size.

    A longer document's first piece is the shorter one, so that all others are full. ids: little-endian unsigned 32-bit.
    """
    schema = _PIECE.append(pa.field("ids", pa.binary())) if keep_ids else _PIECE

    def run(batches):
        enc = encoder(ranks_file, pattern)
        for b in batches:
            rows: list[list] = [[] for _ in schema]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py()
                ids = np.array([*encode(text, enc), END] if text else [END], "<u4")
                n = len(ids)
                cuts = [0, *range(n % size or size, n, size), n] if n > size else [0, n]
                for k, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    raw = ids[s:e].tobytes()
                    for column, x in zip(rows, (doc, k, s, e - s, zlib.crc32(raw), raw), strict=False):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)

    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of one sequence, how many such sequences)] for all pieces that counts has.

    Complements of up to three, two and one pieces are each tried; the fewest sequences win. The number of patterns is
    bounded by the number of lengths, not of pieces: each one uses up a length or fills bins of one kind.
    """
    return min((_plan(counts, size, most) for most in (3, 2, 1)), key=lambda p: sum(n for _, n in p))


def _plan(counts: dict[int, int], size: int, most: int) -> list[tuple[tuple[int, ...], int]]:
    have = np.zeros(size + 1, np.int64)
    for k, n in counts.items():
        have[k] = n
    out: list[tuple[tuple[int, ...], int]] = []

    def use(*lengths: int) -> None:
        need = {x: lengths.count(x) for x in lengths}
        n = min(int(have[x]) // k for x, k in need.items())
        if n:
            for x, k in need.items():
                have[x] -= n * k
            out.append((lengths, n))

    use(size)
    for a in range(size - 1, 0, -1):
        gap = size - a
        if have[a]:
            use(a, gap)
        if have[a] and most >= 2:
            for b in range(gap - 1, (gap - 1) // 2, -1):
                if have[a] and have[b] and have[gap - b]:
                    use(a, b, gap - b)
        if have[a] and most >= 3:
            there = np.flatnonzero(have[:gap])
            for b in there[::-1].tolist():
                rest = gap - b
                if not have[a] or 3 * b < gap:
                    break
                if have[b] and rest >= 2:
                    c = np.arange(min(b, rest - 1), (rest - 1) // 2, -1)
                    for x in c[(have[c] > 0) & (have[rest - c] > 0)].tolist():
                        use(a, b, x, rest - x)
                        if not have[a] or not have[b]:
                            break
    gaps: list[int] = []  # of open bins, ascending; bins of one gap are kept together
    bins: dict[int, list[list]] = {}

    def put(gap: int, lengths: tuple[int, ...], n: int) -> None:
        if gap not in bins:
            bisect.insort(gaps, gap)
            bins[gap] = []
        bins[gap].append([lengths, n])

    for a in range(size - 1, 0, -1):
        n = int(have[a])
        while n:
            at = bisect.bisect_left(gaps, a)
            if at == len(gaps):
                per = size // a
                if n >= per:
                    put(size - per * a, (a,) * per, n // per)
                if n % per:
                    put(size - (n % per) * a, (a,) * (n % per), 1)
                break
            gap = gaps[at]
            lengths, m = bins[gap].pop()
            k = min(n, m)
            if m > k:
                bins[gap].append([lengths, m - k])
            if not bins[gap]:
                del bins[gap], gaps[at]
            put(gap - a, (*lengths, a), k)
            n -= k
    return out + [(tuple(x), n) for group in bins.values() for x, n in group]


def places(patterns: list[tuple[tuple[int, ...], int]], size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys length << 44 | first rank, with the first sequence and the offset that belong to each range of ranks."""
    rank, rows, base = [0] * (size + 1), [], 0
    for lengths, n in patterns:
        at = 0
        for x in lengths:
            rows.append((x << 44 | rank[x], base, at))
            rank[x] += n
            at += x
        base += n
    rows.sort()
    keys, first, offset = (np.array([r[k] for r in rows], np.int64) for k in range(3))
    return keys, first, offset


def pack(parts: DataFrame, size: int = SIZE, ranked_: int = RANKED) -> DataFrame:
    """parts (doc_id, piece, length, any others) with sequence_id and offset added.

    parts must be a stored table, as it is read more than once. Ties and repeated rows each get a place of their own.
    """
    spark = parts.sparkSession
    total = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}  # a row for each length
    salts = [1 + total.get(k, 0) // ranked_ for k in range(size + 1)]
    first_salt = np.concatenate([[0], np.cumsum(salts)])
    of_length = F.get(F.array(*[F.lit(n) for n in salts]), F.col("length").cast("int"))
    salted = parts.withColumn("salt_", F.pmod(F.xxhash64("doc_id", "piece"), of_length).cast("int"))
    starts = np.zeros(int(first_salt[-1]), np.int64)  # pieces of the same length in the sub-groups before
    if max(salts) > 1:
        held = np.zeros(len(starts), np.int64)
        for r in salted.groupBy("length", "salt_").count().collect():  # one for each RANKED pieces
            held[first_salt[r["length"]] + r["salt_"]] = r["count"]
        before = np.concatenate([[0], np.cumsum(held)[:-1]])
        starts = before - np.repeat(before[first_salt[:-1]], salts)
    keys, first, offset = places(plan(total, size), size)
    w = Window.partitionBy("length", "salt_").orderBy("doc_id", "piece")
    ranked = salted.withColumn("rank_", F.row_number().over(w) - 1)
    schema = parts.schema

    def run(batches):
        for b in batches:
            length = b.column("length").to_numpy()
            rank = b.column("rank_").to_numpy() + starts[first_salt[length] + b.column("salt_").to_numpy()]
            at = np.searchsorted(keys, length << 44 | rank, "right") - 1
            sequence = first[at] + rank - (keys[at] & ((1 << 44) - 1))
            kept = [b.column(n) for n in schema.names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset[at])], names=[*schema.names, "sequence_id", "offset"])

    from pyspark.sql import types as T

    return ranked.mapInArrow(run, T.StructType([*schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


def pack_documents(documents: DataFrame, ranks_file: str, pattern: str, size: int = SIZE, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise and pack all documents.

    Null or empty text is the end id alone. Each row, repeated or not, is a document; null ids are kept. Other columns are
    ignored. An empty table gives no row.
    """
    common.prepare(documents.sparkSession)
    return pack(common.written(pieces(documents, ranks_file, pattern, size, id_col, text_col, keep_ids), "pieces"), size)
