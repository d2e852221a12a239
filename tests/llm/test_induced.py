import time

import numpy as np

from loam.llm import induced as I


def naive(x):
    s = x.tolist()
    sa = sorted(range(len(s)), key=lambda k: s[k:])
    lcp = [0]
    for a, b in zip(sa, sa[1:], strict=False):
        k = 0
        while max(a, b) + k < len(s) and s[a + k] == s[b + k]:
            k += 1
        lcp.append(min(k, 255))
    return sa, lcp


def test_against_naive(tmp_path):
    rng = np.random.default_rng(2)
    for trial in range(250):
        n, sigma = int(rng.integers(0, 120)), int(rng.integers(1, 5))
        x = rng.integers(1, sigma + 1, n)
        if trial % 3 == 0 and n:
            x = np.tile(x[: int(rng.integers(1, 7))], 20)[:n]
        if trial % 5 == 0:
            x = np.repeat(x, 3)
        x = np.append(x, 0)
        sa, lcp = I.sort(x, budget=200 if trial % 2 else I.BUDGET, base=4 if trial % 4 == 0 else I.BASE, folder=str(tmp_path))
        want = naive(x)
        assert sa.tolist() == want[0]
        assert lcp.tolist() == want[1]
    assert not list(tmp_path.iterdir())


def test_long_runs_and_repeats():
    x = np.append(np.concatenate([np.ones(700), np.full(3, 2), np.ones(700), np.tile([2, 1, 3], 300)]).astype(np.int64), 0)
    sa, lcp = I.sort(x)
    want = naive(x)
    assert sa.tolist() == want[0] and lcp.tolist() == want[1]


def test_spill():
    rng = np.random.default_rng(5)
    x = np.append(rng.integers(1, 30, 20_000), 0)
    a = I.sort(x, budget=1000)
    b = I.sort(x)
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all()


def test_common_prefixes_by_words_of_symbols():
    rng = np.random.default_rng(8)
    x = np.append(np.tile(rng.integers(1, 200, 1 << 16), 16), 0).astype(np.int16)  # most neighbours have the longest prefix in common
    at = np.argsort(x.astype(np.int64) * 1000 + np.append(x[1:], 0), kind="stable")[:: 5]

    def plain():
        out, live = np.zeros(len(at), np.int64), np.arange(1, len(at))
        while len(live):
            a, b = at[live - 1] + out[live], at[live] + out[live]
            live = live[(a < len(x)) & (b < len(x)) & (x[np.minimum(a, len(x) - 1)] == x[np.minimum(b, len(x) - 1)])]
            out[live] += 1
            live = live[out[live] < I.CAP]
        return out

    seconds = []
    for f in (plain, lambda: I._adjacent_lcp(x, at)):
        start = time.process_time()
        seconds.append((f(), time.process_time() - start))
    (want, slow), (got, fast) = seconds
    assert (got == want).all() and (got == I.CAP).mean() > 0.1
    assert fast < 0.7 * slow
    for kind in (np.int16, np.int64):  # symbols that end anywhere, none of them unique
        y = rng.integers(0, 2, 300).astype(kind)
        p = rng.permutation(300)
        for cap in (7, I.CAP):
            common = [next((k for k in range(cap) if max(a, b) + k >= 300 or y[a + k] != y[b + k]), cap) for a, b in zip(p, p[1:], strict=False)]
            assert I._adjacent_lcp(y, p, cap).tolist() == [0, *common]
