"""External induced suffix sorting with common-prefix values.

Suffixes of two kinds: an S-suffix is smaller than its right neighbour, an L-suffix larger; an LMS-suffix is an S-suffix
after an L one. From the LMS-suffixes in order, one pass over the symbols upwards induces all L-suffixes and one downwards
all S-suffixes: whatever leaves the queue puts its left neighbour into it. The queue is a priority queue over (symbol,
arrival): within a symbol, arrivals are in order already, so it is a first-in-first-out run for each symbol, kept in
memory up to a budget and beyond that in files. Each tuple carries its common prefix with the one before; what an induced
tuple carries is one more than the least value passed since the last tuple put under its symbol. The LMS-suffixes come
from the same induction without their order, naming, and recursion on the names.
"""

from __future__ import annotations

import os
import shutil
import tempfile

import numpy as np

from .suffix import suffix_array

CAP = 255
#: Bytes of tuples that a queue holds in memory, and the names up to which recursion ends in memory.
BUDGET = 64 << 20
BASE = 4_000_000
_TUPLE = np.dtype([("at", "<i8"), ("lcp", "u1")])


class DiskQueue:
    """First-in-first-out runs of (position, common prefix) for each symbol; the largest ones go to files beyond the budget."""

    def __init__(self, budget: int, folder: str | None = None):
        self.budget, self.folder, self.own = budget, folder, None
        self.runs: dict[int, list[np.ndarray]] = {}
        self.size: dict[int, int] = {}
        self.held = self.spilled = 0

    def _file(self, c: int) -> str:
        if self.own is None:
            self.own = tempfile.mkdtemp(prefix="induced-", dir=self.folder)
        return os.path.join(self.own, f"{c}.run")

    def push(self, c: int, at: np.ndarray, lcp: np.ndarray) -> None:
        t = np.empty(len(at), _TUPLE)
        t["at"], t["lcp"] = at, lcp
        self.runs.setdefault(c, []).append(t)
        self.size[c] = self.size.get(c, 0) + t.nbytes
        self.held += t.nbytes
        while self.held > self.budget:
            big = max(self.size, key=self.size.get)
            with open(self._file(big), "ab") as f:
                for run in self.runs.pop(big):
                    run.tofile(f)
            self.spilled += self.size[big]
            self.held -= self.size.pop(big)

    def pop(self, c: int) -> tuple[np.ndarray, np.ndarray]:
        parts = self.runs.pop(c, [])
        self.held -= self.size.pop(c, 0)
        if self.own and os.path.exists(self._file(c)):
            parts.insert(0, np.fromfile(self._file(c), _TUPLE))
            os.unlink(self._file(c))
        t = np.concatenate(parts) if parts else np.empty(0, _TUPLE)
        return t["at"].copy(), t["lcp"].copy()

    def close(self) -> None:
        if self.own:
            shutil.rmtree(self.own, ignore_errors=True)


def _range_min(v: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least of v[lo..hi], ends included; CAP where the range is empty."""
    out = np.full(len(lo), CAP, np.uint8)
    span = hi - lo + 1
    level, table = 0, v
    for level in range(int(span.max(initial=0)).bit_length()):
        k = np.flatnonzero((span >> level) == 1)
        out[k] = np.minimum(table[lo[k]], table[hi[k] - (1 << level) + 1])
        w = 1 << level
        table = np.minimum(table[:-w], table[w:]) if len(table) > w else table[:0]
    return out


class _Pass:
    """One direction of the induction."""

    def __init__(self, x, want, budget, folder, with_lcp):
        self.x, self.want, self.with_lcp = x, want, with_lcp
        self.queue = DiskQueue(budget, folder)
        self.least = np.full(int(x.max()) + 1, CAP, np.uint8) if with_lcp else None

    def induce(self, at: np.ndarray, lcp: np.ndarray, same: int) -> tuple[np.ndarray, np.ndarray]:
        """Put left neighbours into the queue; those under the symbol `same` are returned instead, as the next layer."""
        k = np.flatnonzero(at > 0)
        k = k[self.want[at[k] - 1]]
        t = self.x[at[k] - 1]
        order = np.argsort(t, kind="stable")
        k, t = k[order], t[order]
        fresh = np.ones(len(t), bool)
        fresh[1:] = t[1:] != t[:-1]
        cut = np.append(np.flatnonzero(fresh), len(t))
        new = np.zeros(len(t), np.uint8)
        if self.with_lcp:
            lo = np.zeros(len(t), np.int64)
            lo[1:] = np.where(fresh[1:], 0, k[:-1] + 1)
            m = _range_min(lcp, lo, k)
            m[cut[:-1]] = np.minimum(m[cut[:-1]], self.least[t[cut[:-1]]])
            new = np.minimum(m, CAP - 1) + np.uint8(1)
            after = np.append(np.minimum.accumulate(lcp[::-1])[::-1], np.uint8(CAP))
            self.least = np.minimum(self.least, after[0])
            self.least[t[cut[:-1]]] = after[k[cut[1:] - 1] + 1]
        stay = (np.zeros(0, np.int64), np.zeros(0, np.uint8))
        for a, b in zip(cut, cut[1:], strict=False):
            if t[a] == same:
                stay = (at[k[a:b]] - 1, new[a:b])
            else:
                self.queue.push(int(t[a]), at[k[a:b]] - 1, new[a:b])
        return stay

    def bucket(self, c: int) -> tuple[np.ndarray, np.ndarray]:
        """All that is induced under a symbol, layer by layer as it follows from itself."""
        out, layer = [], self.queue.pop(c)
        if len(layer[0]):
            layer[1][0] = 0
        while len(layer[0]):
            out.append(layer)
            layer = self.induce(*layer, c)
        return tuple(np.concatenate(z) for z in zip(*out, strict=True)) if out else layer


def _induce(x, small, run, seeds, seed_lcp, budget, folder, with_lcp=True):
    """All suffixes in order with their common prefixes (capped), from the LMS-suffixes in order."""
    symbols = np.unique(x).tolist()
    edges = np.searchsorted(x[seeds], np.append(np.array(symbols, x.dtype), x.max()), "left")
    edges[-1] = len(seeds)
    up = _Pass(x, ~small, budget, folder, with_lcp)
    larger = {}
    try:
        for c, a, b in zip(symbols, edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            at, lcp = up.bucket(c)
            larger[c] = (at, lcp)
            if b > a:
                s, sl = seeds[a:b], seed_lcp[a:b].copy()
                sl[0] = min(run[at[-1]], run[s[0]]) if len(at) else 0
                up.induce(s, sl, -1)
    finally:
        up.queue.close()
    down = _Pass(x, small, budget, folder, with_lcp)
    parts = []
    try:
        down.queue.push(0, np.array([len(x) - 1]), np.zeros(1, np.uint8))  # the end mark, which nothing induces
        for c in reversed(symbols):
            s, sl = down.bucket(c)
            at, lcp = larger.pop(c)
            edge = np.uint8(min(run[s[-1]], run[at[-1]]) if len(s) and len(at) else 0)
            if len(s):
                parts.append((s[::-1], np.append(edge, sl[:0:-1]).astype(np.uint8)))
            if len(at):
                parts.append((at, lcp))
                down.induce(at[::-1], np.append(edge, lcp[:0:-1]).astype(np.uint8), -1)
    finally:
        down.queue.close()
    return tuple(np.concatenate(z) for z in zip(*reversed(parts), strict=True))


def _adjacent_lcp(x: np.ndarray, at: np.ndarray, cap: int = CAP) -> np.ndarray:
    """Common prefix of each suffix with the one before it in the list, up to the cap; four symbols at a time, if 16 bits hold each."""
    n = len(x)
    per = 4 if x.dtype.itemsize <= 2 else 1
    symbols = np.zeros(n + cap + 2 * per, np.uint64)
    symbols[:n] = x
    word = symbols[: n + cap + per].copy()
    for k in range(1, per):
        word |= symbols[k : k + len(word)] << np.uint64(16 * k)
    del symbols
    out = np.zeros(len(at), np.int64)
    live = np.arange(1, len(at))
    a, b = at[:-1], at[1:]
    while len(live):
        differ = word[a] ^ word[b]
        same = differ == 0
        last, differ = live[~same], differ[~same]
        for k in range(1, per):
            out[last] += differ & np.uint64((1 << 16 * k) - 1) == 0
        live, a, b = live[same], a[same] + per, b[same] + per
        out[live] += per
        more = out[live] < cap
        live, a, b = live[more], a[more], b[more]
    out[1:] = np.minimum(out[1:], n - np.maximum(at[:-1], at[1:]))  # beyond the end nothing is common
    return np.minimum(out, cap).astype(np.uint8)


def sort(x: np.ndarray, budget: int = BUDGET, base: int = BASE, folder: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, common prefix with the suffix before, capped at 255) of symbols; the last must be 0 and the only 0."""
    n = len(x)
    if n < 3:
        at = np.argsort(x, kind="stable")
        return at, np.zeros(n, np.uint8)
    change = np.append(np.flatnonzero(x[1:] != x[:-1]), n - 1)  # last place of each run of equal symbols
    length = np.diff(np.append(-1, change))
    rises = np.append(x[change[:-1]] < x[change[:-1] + 1], True)
    small = np.repeat(rises, length)
    run = np.minimum(np.repeat(change, length) - np.arange(n) + 1, CAP).astype(np.uint8)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    rough = lms[np.argsort(x[lms], kind="stable")]
    order, _ = _induce(x, small, run, rough, np.zeros(len(rough), np.uint8), budget, folder, with_lcp=False)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = order[is_lms[order]]
    # names: equal where two neighbours have the same symbols up to and with the next LMS place
    end = np.empty(n, np.int64)
    end[lms] = np.append(lms[1:], n - 1)
    size = end[order] - order
    fresh = np.ones(len(order), bool)
    live = np.flatnonzero(size[1:] == size[:-1]) + 1
    fresh[live] = False
    step = np.zeros(len(order), np.int64)
    while len(live):
        differs = x[order[live] + step[live]] != x[order[live - 1] + step[live]]
        fresh[live[differs]] = True
        live = live[~differs]
        step[live] += 1
        live = live[step[live] <= size[live]]
    name = np.empty(n, np.int64)
    name[order] = np.cumsum(fresh) - 1
    names = name[lms]
    if fresh.all():
        sorted_lms = order
    elif len(lms) > base and int(names.max()) < len(lms) // 64:
        sorted_lms = lms[sort(names, budget, base, folder)[0]]
    else:
        sorted_lms = lms[suffix_array(names)]
    return _induce(x, small, run, sorted_lms, _adjacent_lcp(x, sorted_lms), budget, folder)
