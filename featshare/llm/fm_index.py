"""Compressed FM-index over word sequences, vectorised over many queries.

A shard's sequences are concatenated with separators, sorted by suffix, and kept as a
Burrows-Wheeler transform in a wavelet matrix of packed bit vectors (word popcounts plus one
counter per 64 bits). Queries run in lock step: every numpy operation advances all of them.
"""

from __future__ import annotations

import numpy as np


class BitVector:
    """Packed bits with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        pad = np.zeros(-(len(bits) + 1) % 64 + len(bits) + 1, np.uint8)
        pad[:len(bits)] = bits
        self.words = np.packbits(pad, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate(([0], np.cumsum(counts)))[:-1].astype(np.int32)
        self.zeros = len(bits) - int(counts.sum())

    def rank1(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        w, mask = i >> 6, (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)


class WaveletMatrix:
    """Rank of any symbol in a sequence over 0..sigma-1."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.levels = []
        self.depth = max(1, int(sigma - 1).bit_length())
        for k in range(self.depth - 1, -1, -1):
            bits = (seq >> k) & 1
            self.levels.append((k, BitVector(bits.astype(np.uint8))))
            seq = np.concatenate((seq[bits == 0], seq[bits == 1]))
        self.begin = self._down(np.arange(sigma), np.zeros(sigma, np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, v in self.levels:
            ones = v.rank1(i)
            i = np.where((c >> k) & 1, v.zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often ``c`` occurs before position ``i``."""
        return self._down(c, i) - self.begin[c]

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at ``i`` and their ranks there."""
        c = np.zeros(len(i), np.int64)
        for k, v in self.levels:
            one, ones = v.rank1(i + 1) - v.rank1(i), v.rank1(i)
            c |= one.astype(np.int64) << k
            i = np.where(one, v.zeros + ones, i - ones)
        return c, i - self.begin[c]


def suffix_order(text: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array by prefix doubling, and the ranks of every level (equal ranks at level j:
    the first 2^j symbols are equal). Separators must be distinct symbols."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    levels, k = [rank.astype(np.int32)], 1
    order = np.argsort(rank, kind="stable")
    while n and rank.max() < n - 1:
        second = np.zeros(n, np.int64)
        second[:-k] = rank[k:] + 1
        pair = rank * (n + 1) + second
        order = np.argsort(pair)
        sorted_ = pair[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(sorted_[1:] != sorted_[:-1])))
        levels.append(rank.astype(np.int32))
        k *= 2
    return order, levels


class FMIndex:
    """Index of the sequences ``words`` (dense ids 0..sigma-1) cut at ``lengths``.

    Positions are those of ``words``. ``sample`` is the distance of sampled suffix positions;
    starts of sequences are sampled too, so a walk never crosses a separator.
    """

    def __init__(self, words: np.ndarray, lengths: np.ndarray, sigma: int, sample: int = 16, lcp: bool = False):
        n_seq = len(lengths)
        self.n = len(words) + n_seq
        ends = np.cumsum(lengths + 1) - 1
        text = np.empty(self.n, np.int64)  # separators 0..n_seq-1, then words
        inner = np.ones(self.n, bool)
        inner[ends] = False
        text[ends] = np.arange(n_seq)
        text[inner] = words + n_seq
        position = np.cumsum(inner) - 1  # of a text place in words
        order, levels = suffix_order(text)
        # one symbol for all separators: no query steps through one
        flat = np.where(inner, text - n_seq + 1, 0)
        self.sigma = sigma + 1
        self.count = np.concatenate(([0], np.cumsum(np.bincount(flat, minlength=self.sigma))))
        self.wavelet = WaveletMatrix(flat[order - 1], self.sigma)
        starts = np.concatenate(([0], ends[:-1] + 1)) if n_seq else np.zeros(0, np.int64)
        sampled = np.zeros(self.n, bool)
        sampled[::sample] = True
        sampled[starts] = True
        at = sampled[order]
        self.sampled = BitVector(at.astype(np.uint8))
        self.is_sampled = at
        self.samples = position[order[at]] + np.where(inner[order[at]], 0, 1)
        self.lcp_table = self._lcp(order, levels) if lcp else None
        self.positions_in_order = position[order] if lcp else None
        self.word_rows = inner[order] if lcp else None

    def _lcp(self, order, levels):
        a, b = order[:-1].copy(), order[1:].copy()
        total = np.zeros(max(self.n - 1, 0), np.int64)
        for j in range(len(levels) - 1, -1, -1):
            r = np.concatenate((levels[j], [-1] * (1 << j)))  # past the end nothing matches
            x, y = np.minimum(a, len(r) - 1), np.minimum(b, len(r) - 1)
            same = (r[x] == r[y]) & (a < self.n) & (b < self.n)
            a[same] += 1 << j
            b[same] += 1 << j
            total[same] += 1 << j
        low = np.concatenate(([0], total, [0]))  # low[i]: rows i-1 and i
        low = low.astype(np.uint8 if low.max() < 256 else np.int32)
        table, k = [low], 1
        while 2 * k <= len(low):
            low = np.minimum(low[:-k], low[k:])
            table.append(low)
            k *= 2
        return table

    def full(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        return np.zeros(n, np.int64), np.full(n, self.n, np.int64)

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward-search step: intervals of c + pattern from those of the patterns."""
        both = self.count[np.concatenate((c, c)) + 1] + self.wavelet.rank(
            np.concatenate((c, c)) + 1, np.concatenate((lo, hi)))
        return both[:len(c)], both[len(c):]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of right-aligned patterns (rows of dense ids, last word in the last
        column; -1: a word the index does not hold). Empty interval: no occurrence."""
        lo, hi = self.full(len(patterns))
        width = patterns.shape[1] if len(patterns) else 0
        for t in range(width):
            c = patterns[:, width - 1 - t]
            live = np.flatnonzero((t < lengths) & (lo < hi))
            known = c[live] >= 0
            hi[live[~known]] = lo[live[~known]]
            live = live[known]
            if live.size:
                lo[live], hi[live] = self.extend(c[live], lo[live], hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffix-array rows: walk back by LF until a sampled row."""
        out = np.zeros(len(rows), np.int64)
        at, todo, steps = rows.copy(), np.arange(len(rows)), 0
        while todo.size:
            here = self.is_sampled[at[todo]]
            hit = todo[here]
            out[hit] = self.samples[self.sampled.rank1(at[hit])] + steps
            todo = todo[~here]
            if todo.size:
                c, r = self.wavelet.access(at[todo])
                at[todo] = self.count[c] + r
            steps += 1
        return out

    def parent(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The next shorter match of each interval: drop words from the right until the
        interval grows. Returns the longer intervals and the shorter lengths."""
        low = self.lcp_table[0]
        depth = np.maximum(low[lo], low[hi])
        left, right = lo.copy(), hi.copy()
        # leftwards while low[left] >= depth, rightwards while low[right] >= depth
        for j in range(len(self.lcp_table) - 1, -1, -1):
            t, k = self.lcp_table[j], 1 << j
            i = left - k + 1
            ok = (i >= 0) & (depth > 0)
            ok[ok] = t[i[ok]] >= depth[ok]
            left[ok] -= k
            ok = (right + k <= len(low)) & (depth > 0)
            ok[ok] = t[right[ok]] >= depth[ok]
            right[ok] += k
        return (np.where(depth > 0, left, 0), np.where(depth > 0, right, self.n), depth.astype(np.int64))

    def matching_statistics(self, words: np.ndarray, lengths: np.ndarray, weight: np.ndarray,
                            least: int = 2, window: int = 1) -> np.ndarray:
        """For each place of the streamed sequences (all their words indexed): the length of
        the longest match that starts there and occurs with a total weight of ``least``.
        ``weight`` is per index position; sequences are streamed from their ends. Matches only
        move left, so a sequence whose match ends before word ``window`` holds no match of
        that length any more and is streamed no further (zeros remain)."""
        total = np.zeros(self.n + 1, np.int64)
        if len(weight):
            row_weight = np.where(self.word_rows, weight[np.minimum(self.positions_in_order, len(weight) - 1)], 0)
            np.cumsum(row_weight, out=total[1:])
        out = np.zeros(len(words), np.int64)
        first = np.cumsum(lengths) - lengths
        at = lengths.copy()  # words of each sequence not yet streamed
        lo, hi = self.full(len(lengths))
        depth = np.zeros(len(lengths), np.int64)
        lanes = np.flatnonzero(lengths >= window)
        while lanes.size:
            at[lanes] -= 1
            c = words[first[lanes] + at[lanes]]
            todo = lanes
            while todo.size:
                a, b = self.extend(c, lo[todo], hi[todo])
                good = total[b] - total[a] >= least
                won = todo[good]
                lo[won], hi[won] = a[good], b[good]
                depth[won] += 1
                todo, c = todo[~good], c[~good]
                # the word alone matches nothing, or no window is left: no more attempts
                done = (depth[todo] == 0) | (at[todo] + depth[todo] < window)
                lost = todo[done]
                lo[lost], hi[lost], depth[lost] = 0, self.n, 0
                todo, c = todo[~done], c[~done]
                if todo.size:
                    lo[todo], hi[todo], depth[todo] = self.parent(lo[todo], hi[todo])
            out[first[lanes] + at[lanes]] = depth[lanes]
            lanes = lanes[(at[lanes] > 0) & (at[lanes] + depth[lanes] >= window)]
        return out
