"""Periodic runs of words: stretches that repeat with a period, found in linear time after Kolpakov and Kucherov.

A text's words are factorised from the left (each factor is the longest one that also starts earlier, read off a suffix
automaton). Runs that touch or cross a factor's start come from Main's algorithm (longest common extensions to both
sides of the border, within a window that the factorisation bounds), runs inside a factor are copied from its earlier
occurrence. Only stretches that can hold a run at all are factorised: in a run of three periods and 24 words every
sequence of eight words after the first period stands one period earlier too.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: A run has so many words at least, and so many periods.
LEAST, TIMES = 24, 3
#: Words of the sequences that tell stretches without runs apart.
GRAM = 8

_MULTIPLIERS = np.random.default_rng(20250311).integers(1, 1 << 63, GRAM, dtype=np.uint64) | np.uint64(1)


def factors(w: list[int]) -> list[tuple[int, int, int]]:
    """[(start, length, earlier start)]: from the left, the longest factors that also start earlier (overlaps count); -1 for a new word."""
    step: list[dict[int, int]] = [{}]
    link, length, first = [-1], [0], [-1]  # first: where the first occurrence of a state's strings ends
    last = 0
    for i, c in enumerate(w):
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        first.append(i)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(step)
                step.append(step[q].copy())
                link.append(link[q])
                length.append(length[p] + 1)
                first.append(first[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    out, i, n = [], 0, len(w)
    while i < n:
        state, k, at = 0, 0, -1
        while i + k < n:
            state = step[state][w[i + k]]
            begin = first[state] - k
            if begin >= i:
                break
            k, at = k + 1, begin
        out.append((i, max(k, 1), at))
        i += max(k, 1)
    return out


def _z(s: list[int]) -> list[int]:
    """For each place, how many symbols from there on equal those from the start on."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        if i + k >= right or not i < right:
            while i + k < n and s[k] == s[i + k]:
                k += 1
            left, right = i, i + k
        z[i] = k
    return z


def _crossing(w: list[int], low: int, b: int, e: int, least: int, times: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of repetitions in w[low:e], maximal there, that begin at b or before it and end after it."""
    t, u = w[low:b], w[b:e]
    back = t[::-1]
    out = []
    zu = _z(u)
    zb = _z(back)
    # both ends of t: what u begins with, seen from each place of t, and what t ends with, seen from each place of t + u
    zt = _z([*u, -1, *t]) if t else []
    zw = _z([*back, -1, *u[::-1], *back]) if t else []
    n, m = len(u), len(t)
    for p in range(1, n):
        right = zu[p]
        left = min(zw[m + 1 + n - p], m) if m else 0
        size = left + p + right
        if size >= least and size >= times * p:
            out.append((b - left, b + p + right, p))
    for p in range(1, m + 1):
        right = min(zt[n + 1 + m - p], n)
        left = zb[p] if p < m else 0
        size = left + p + right
        if right and size >= least and size >= times * p:
            out.append((b - p - left, b + right, p))
    return out


def runs(w: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """All (start, end, smallest period) with length >= max(least, times * period) that no neighbour extends, by start and period.

    times must be 2 or more. w: words by number (from 0).
    """
    found: dict[tuple[int, int], int] = {}
    by_start: dict[int, list[tuple[int, int]]] = {}

    def add(s: int, e: int, p: int) -> None:
        old = found.get((s, e))
        if old is None or p < old:
            found[s, e] = p
            if old is not None:
                by_start[s].remove((e, old))
            by_start.setdefault(s, []).append((e, p))

    before = 0
    for b, size, at in factors(w):
        e = b + size
        reach = 2 * before + size
        if reach + size >= least:
            # one word more on both sides tells whether a neighbour extends what is found
            low, high = max(0, b - reach - 1), min(len(w), e + 1)
            for s, z, p in _crossing(w, low, b, high, least, times):
                if (z > e and not (high == e)) or (s == low and low > 0) or (z < len(w) and w[z] == w[z - p]) or (s > 0 and w[s - 1] == w[s - 1 + p]):
                    continue  # goes on into a later factor, or into what an earlier border has told
                add(s, z, p)
        if at >= 0 and by_start:
            shift = b - at
            for s in range(b + 1, e - least + 1):
                for z, p in tuple(by_start.get(s - shift, ())):
                    z = min(z + shift, e)
                    if z - s >= least and z - s >= times * p and not (z < len(w) and w[z] == w[z - p]):
                        add(s, z, p)
        before = size
    return sorted(((s, e, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


def stretches(codes: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int]]:
    """Disjoint [start, end) that hold every run with its neighbours; most texts have none.

    After a run's first period p, each of its sequences of GRAM words has its last occurrence p words before it or nearer,
    and there are at least (times - 1) * p - GRAM + 1 of them in a row.
    """
    n = len(codes)
    if n < least or least - least // times < GRAM:
        return [(0, n)] if n >= least else []
    h = np.zeros(n - GRAM + 1, np.uint64)
    x = common.mix(codes.astype(np.uint64) + np.uint64(1))
    for k in range(GRAM):
        h += x[k : n - GRAM + 1 + k] * _MULTIPLIERS[k]
    order = np.argsort(h, kind="stable")
    same = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    if not len(same):
        return []
    gap = np.zeros(len(h), np.int64)  # 0: not there before
    gap[order[same + 1]] = order[same + 1] - order[same]
    shortest = least - least // times - GRAM + 1
    on = gap > 0
    while True:
        edge = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).astype(np.int8)))
        first, end = edge[::2], edge[1::2]
        size = end - first
        most = np.where(size >= shortest, (size + GRAM - 1) // (times - 1), 0)  # the longest period that so many in a row allow
        allowed = np.zeros(len(h), np.int64)
        for s, e, q in zip(first.tolist(), end.tolist(), most.tolist(), strict=True):
            allowed[s:e] = q
        keep = on & (gap <= allowed)
        if keep.sum() == on.sum():
            break
        on = keep
    out: list[tuple[int, int]] = []
    for s, e, q in zip(first.tolist(), end.tolist(), most.tolist(), strict=True):
        s, e = max(0, s - q - 1), min(n, e + GRAM)
        while out and out[-1][1] >= s:
            s, e = min(s, out[-1][0]), max(e, out[-1][1])
            out.pop()
        out.append((s, e))
    return out


def text_runs(words: list[bytes], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, end, period) of the runs of a text's words."""
    if len(words) < least:
        return []
    number: dict[bytes, int] = {}
    codes = np.fromiter((number.setdefault(x, len(number)) for x in words), np.int64, len(words))
    out = []
    for s, e in stretches(codes, least, times):
        out += [(s + a, s + z, p) for a, z, p in runs(codes[s:e].tolist(), least, times) if (a or not s) and (s + z < e or e == len(words))]
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept(n: int, found: list[tuple[int, int, int]]) -> np.ndarray | None:
    """Which of n words no run has after its first period; None: all."""
    if not found:
        return None
    cover = np.zeros(n + 1, np.int64)
    for s, e, p in found:
        cover[s + p] += 1
        cover[e] -= 1
    return np.cumsum(cover[:-1]) == 0


def echoed(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with a periodic end, for one document in ten: h = crc32 of the decimal doc_id; from word a = (h // 10) % n on with period p."""
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * (-(-(n - a) // p)))[: n - a]


_FIELDS = [("n_words", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _best(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length / period; of ties the first, then that of the smaller period."""
    best = None
    for s, e, p in found:
        if best is None or (e - s) * best[2] > (best[1] - best[0]) * p:
            best = (s, e, p)
    return best


def detect(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None, least: int = LEAST, times: int = TIMES, keep: bool = False) -> DataFrame:
    """(id, n_words, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256[, runs, collapsed]) for every row.

    Words are what ASCII white space parts. The run told is that of greatest length / period (ties: smallest start, then period),
    nulls without a run. runs_sha256 is over `start,length,period` lines of all runs, collapsed_sha256 over the words
    that no run has after its first period, joined by one space. keep adds the runs and that text. rewrite: changes a
    row's words first. Null or empty text has no words; repeated rows, and those without id, are rows like others; other
    columns are ignored; an empty table gives no row. A row costs memory linear in its own words (some 600 bytes for each
    word of a stretch that may be periodic), nothing is held from row to row, and nothing is shuffled.
    """
    if times < 2 or least < 1:
        raise ValueError("a run has two periods and a word at least")
    common.prepare(documents.sparkSession)
    fields = _FIELDS + [("runs", _RUNS), ("collapsed", pa.binary())] * keep

    def run(batches):
        for b in batches:
            rows: list[list] = [[] for _ in fields]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = (text.as_py() or b"").split()
                if rewrite is not None:
                    words = rewrite(doc, words)
                found = text_runs(words, least, times)
                stay = kept(len(words), found)
                left = b" ".join(words if stay is None else [words[k] for k in np.flatnonzero(stay).tolist()])
                lines = "".join(f"{s},{e - s},{p}\n" for s, e, p in found).encode()
                best = _best(found)
                told = (None,) * 4 if best is None else (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2])
                values = (len(words), len(found), *told, hashlib.sha256(lines).hexdigest(), hashlib.sha256(left).hexdigest(), [(s, e - s, p) for s, e, p in found], left)
                for column, x in zip(rows, values, strict=False):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, (_, t) in zip(rows, fields, strict=True))], names=["doc_id", *(k for k, _ in fields)])

    schema = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    schema += ", runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed binary" * keep
    d = documents.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    return d.mapInArrow(run, schema).withColumnRenamed("doc_id", id_col)
