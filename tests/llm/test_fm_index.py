import numpy as np
import pytest

from featshare.llm.fm_index import FMIndex


def make(rng, sigma, sizes):
    return [rng.integers(0, sigma, n) for n in sizes]


@pytest.mark.parametrize("seed,sigma", [(0, 2), (1, 3), (2, 50)])
def test_search_and_locate(seed, sigma):
    rng = np.random.default_rng(seed)
    seqs = make(rng, sigma, [0, 1, 40, 25, 25, 7])
    seqs[4] = seqs[3].copy()
    words, lengths = np.concatenate(seqs), np.array([len(s) for s in seqs])
    fm = FMIndex(words, lengths, sigma, sample=5)
    starts = np.cumsum(lengths) - lengths
    pats = [rng.integers(0, sigma, rng.integers(1, 5)) for _ in range(60)] + [np.array([-1, 0])]
    width = max(map(len, pats))
    grid = np.full((len(pats), width), -1)
    for i, p in enumerate(pats):
        grid[i, width - len(p):] = p
    lo, hi = fm.search(grid, np.array([len(p) for p in pats]))
    for p, a, b in zip(pats, lo, hi):
        want = sorted(s + i for s, q in zip(starts, seqs) for i in range(len(q) - len(p) + 1)
                      if (q[i:i + len(p)] == p).all())
        assert sorted(fm.locate(np.arange(a, b)).tolist()) == want


@pytest.mark.parametrize("seed,sigma", [(0, 2), (1, 3), (2, 8)])
def test_matching_statistics(seed, sigma):
    rng = np.random.default_rng(seed)
    seqs = make(rng, sigma, [30, 12, 1, 20, 20])
    seqs[3][5:15] = seqs[0][3:13]
    words, lengths = np.concatenate(seqs), np.array([len(s) for s in seqs])
    mult = rng.integers(1, 3, len(seqs))
    fm = FMIndex(words, lengths, sigma, lcp=True)
    got = fm.matching_statistics(words, lengths, np.repeat(mult, lengths))
    k = 0
    for q in seqs:
        for i in range(len(q)):
            best = 0
            for n in range(1, len(q) - i + 1):
                occ = sum(m for s, m in zip(seqs, mult) for j in range(len(s) - n + 1) if (s[j:j + n] == q[i:i + n]).all())
                if occ >= 2:
                    best = n
            assert got[k] == best
            k += 1


def test_empty():
    fm = FMIndex(np.zeros(0, np.int64), np.zeros(0, np.int64), 1)
    lo, hi = fm.search(np.array([[0]]), np.array([1]))
    assert lo[0] >= hi[0]
