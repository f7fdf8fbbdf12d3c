"""Spelling variants by Bloom-guided neighbourhoods.

The vocabulary (words that occur often enough) is counted with built-in functions. Its words
go into blocked Bloom filters, one per word length: a word sets five bits of one 64-bit block.
A word's neighbours are guessed, not compared: every single deletion and every replacement by
a larger letter is hashed from the word's rolling hash without being spelled out, and probed
against the broadcast filters of its length. (The longer word of an insertion finds the pair
by a deletion, the smaller-lettered word of a replacement finds it from its side, so each pair
is probed once.) Only positives are spelled out and shuffled to an exact join with the
vocabulary, which removes the false ones.

The filters' blocks are numbered through all lengths, and a round of probing broadcasts at most
``FILTER_BLOCKS`` of them (16 MB): a larger vocabulary takes more rounds, not more memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, received, send, slices, written

LEAST_LENGTH = 6
LEAST_COUNT = 5
#: a form occurs at least so many times as often as its variant
RATIO = 5
#: a run whose crc32 with its document's id this divides loses a letter
DAMAGE = 199
#: 64-bit blocks of a round's filters
FILTER_BLOCKS = 1 << 21
#: filter bits per word of a length, and blocks of a length at least
BITS = 16
LEAST_BLOCKS = 1024
#: probes hashed at a time
PROBES = 1 << 20

_P = 0x9E3779B97F4A7C15
_INVERSE = pow(_P, -1, 1 << 64)


def words_of(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH,
             least_count: int = LEAST_COUNT, damage: int = DAMAGE) -> DataFrame:
    """(word, n): the vocabulary, from maximal runs of letters of whole texts. A shorter run
    than ``least_length`` can't become a word, so runs are taken from that length on."""
    run = F.explode(F.regexp_extract_all(ascii_lower(F.col(text).cast("string")),
                                         F.lit(rf"[a-zÀ-ÿ]{{{least_length},}}"), F.lit(0)))
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), run.alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat_ws(":", "k", "run").cast("binary")))
    cut = F.expr("concat(substring(run, 1, cast(h % length(run) as int)), substring(run, cast(h % length(run) as int) + 2))")
    return (runs.select(F.when(F.col("h") % damage == 0, cut).otherwise(F.col("run")).alias("word"))
            .where(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
            .where(F.col("n") >= least_count))


def _powers(n: int) -> np.ndarray:
    factors = np.full(n + 1, _P, np.uint64)
    factors[0] = 1
    return np.cumprod(factors, dtype=np.uint64)


def _mixed(h: np.ndarray, length: int) -> np.ndarray:
    """A hash of all bits of a rolling hash."""
    h = h + np.uint64(length)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _cell(mixed: np.ndarray, n_blocks: int) -> np.ndarray:
    return ((mixed >> np.uint64(32)) * np.uint64(n_blocks)) >> np.uint64(32)


def _mask(mixed: np.ndarray) -> np.ndarray:
    out = np.zeros(mixed.shape, np.uint64)
    for shift in (0, 6, 12, 18, 24):
        out |= np.uint64(1) << ((mixed >> np.uint64(shift)) & np.uint64(63))
    return out


def _by_length(words: list[str]):
    """(length, row numbers, code points as a rows x length matrix) for each length."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    for n, rows in sorted(groups.items()):
        for lo, hi in slices([n] * len(rows), PROBES):
            part = rows[lo:hi]
            yield n, part, np.frombuffer("".join(words[i] for i in part).encode("utf-32-le"), np.uint32).reshape(-1, n)


class Layout:
    """Where each length's blocks lie among all blocks."""

    def __init__(self, counts: dict[int, int], bits: int = BITS):
        self.blocks = {n: max(LEAST_BLOCKS, -(-c * bits // 64)) for n, c in sorted(counts.items())}
        self.base, self.total = {}, 0
        for n, b in self.blocks.items():
            self.base[n], self.total = self.total, self.total + b

    def cells(self, mixed: np.ndarray, n: int) -> np.ndarray:
        return _cell(mixed, self.blocks[n]).astype(np.int64) + self.base[n]

    def meets(self, n: int, lo: int, hi: int) -> bool:
        return n in self.base and self.base[n] < hi and self.base[n] + self.blocks[n] > lo


def filter_blocks(words: DataFrame, layout: Layout) -> DataFrame:
    """(cell, bits): the blocks of all filters that hold a word."""
    sent = send(words.sparkSession, layout)

    def run(batches):
        own = received(sent)
        for b in batches:
            for n, _, codes in _by_length(b.column(0).to_pylist()):
                mixed = _mixed((codes * _powers(n)[:n]).sum(axis=1, dtype=np.uint64), n)
                yield pa.RecordBatch.from_arrays([pa.array(own.cells(mixed, n)), pa.array(_mask(mixed).view(np.int64))],
                                                 names=["cell", "bits"])

    return words.select("word").mapInArrow(run, "cell long, bits long").groupBy("cell").agg(
        F.expr("bit_or(bits)").alias("bits"))


class Round:
    """Filter blocks [lo, hi), and the probes that fall on them."""

    def __init__(self, layout: Layout, lo: int, cells: np.ndarray, bits: np.ndarray, size: int, letters: list[str]):
        self.layout, self.lo, self.hi = layout, lo, lo + size
        self.held = np.zeros(size, np.uint64)
        self.held[cells - lo] = bits.view(np.uint64)
        self.letters = np.array(sorted(map(ord, letters)), np.uint64)

    def hits(self, mixed: np.ndarray, n: int) -> np.ndarray:
        """Which of the hashed strings of length n the filters may hold."""
        cell = self.layout.cells(mixed, n)
        inside = (cell >= self.lo) & (cell < self.hi)
        found = np.zeros(mixed.shape, bool)
        mask = _mask(mixed[inside])
        found[inside] = (self.held[cell[inside] - self.lo] & mask) == mask
        return found

    def guesses(self, words: list[str]):
        """(row number, neighbour that may be a word) pairs."""
        for n, rows, codes in _by_length(words):
            shorter, same = self.layout.meets(n - 1, self.lo, self.hi), self.layout.meets(n, self.lo, self.hi)
            if not shorter and not same:
                continue
            power = _powers(n)
            for lo, hi in slices([n * max(len(self.letters), 1)] * len(rows), PROBES):
                c = codes[lo:hi].astype(np.uint64)
                terms = c * power[:n]
                before = np.zeros((len(c), n + 1), np.uint64)
                np.cumsum(terms, axis=1, out=before[:, 1:])
                whole = before[:, -1:]
                if shorter:
                    gone = before[:, :-1] + (whole - before[:, 1:]) * np.uint64(_INVERSE)
                    first = np.ones(c.shape, bool)  # of equal neighbours, the first goes: the rest spell the same
                    first[:, 1:] = c[:, 1:] != c[:, :-1]
                    row, at = np.nonzero(first)
                    hit = self.hits(_mixed(gone[row, at], n - 1), n - 1)
                    for r, i in zip(row[hit].tolist(), at[hit].tolist()):
                        w = words[rows[lo + r]]
                        yield rows[lo + r], w[:i] + w[i + 1:]
                if same:
                    step = max(1, PROBES // max(1, len(c) * len(self.letters)))
                    for start in range(0, n, step):  # positions of very long words a few at a time
                        cut = c[:, start:start + step, None]
                        row, at, letter = np.nonzero(self.letters > cut)
                        put = self.letters[letter]
                        at = at + start
                        hit = self.hits(_mixed(whole[row, 0] + (put - c[row, at]) * power[at], n), n)
                        for r, i, x in zip(row[hit].tolist(), at[hit].tolist(), put[hit].tolist()):
                            w = words[rows[lo + r]]
                            yield rows[lo + r], w[:i] + chr(x) + w[i + 1:]


def guessed_pairs(words: DataFrame, filter_limit: int = FILTER_BLOCKS, bits: int = BITS) -> DataFrame | None:
    """(word, n, guess): positives of the filters over all rounds; None without words."""
    spark = words.sparkSession
    counts = {r["l"]: r["c"] for r in words.groupBy(F.char_length("word").alias("l")).agg(F.count("*").alias("c")).collect()}
    if not counts:
        return None
    letters = [r["x"] for r in words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("x"))
               .where("x <> ''").distinct().collect()]  # at most 90
    layout = Layout(counts, bits)
    blocks = written(filter_blocks(words, layout), "bloom")
    out = None
    for lo in range(0, layout.total, filter_limit):
        size = min(filter_limit, layout.total - lo)
        held = blocks.where((F.col("cell") >= lo) & (F.col("cell") < lo + size)).toArrow()
        sent = send(spark, Round(layout, lo, held["cell"].to_numpy(), held["bits"].to_numpy(), size, letters))

        def run(batches, sent=sent):
            own = received(sent)
            for b in batches:
                texts, n = b.column(0).to_pylist(), b.column(1)
                rows, guesses = [], []
                for r, g in own.guesses(texts):
                    rows.append(r)
                    guesses.append(g)
                    if len(rows) == 65536:
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), n.take(pa.array(rows)), pa.array(guesses)],
                                                         names=["word", "n", "guess"])
                        rows, guesses = [], []
                if rows:
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), n.take(pa.array(rows)), pa.array(guesses)],
                                                     names=["word", "n", "guess"])

        found = written(words.select("word", "n").mapInArrow(run, "word string, n long, guess string"), "guesses")
        out = found if out is None else out.unionByName(found)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word with a form, by pointer jumping: a form occurs ``RATIO`` times as
    often as its variant, so chains end, and each round halves what is left of them."""
    at = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(at.join(ahead, "root", "left"), "roots")
        at = step.select("word", F.coalesce("next", "root").alias("root"))
        if step.where("next is not null").isEmpty():
            return at


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH,
                      least_count: int = LEAST_COUNT, ratio: int = RATIO, damage: int = DAMAGE,
                      filter_limit: int = FILTER_BLOCKS, bits: int = BITS) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are maximal runs of ``A-Z a-z`` and U+00C0 to U+00FF, A-Z lowered, of at least
    ``least_length`` letters and ``least_count`` occurrences in all; of a run whose crc32 with
    its document's key ``damage`` divides, one letter is deleted first. Two words are near if
    one inserted, deleted or replaced letter parts them. A word's form is the near word that
    occurs most (ties: smallest in code-point order) if it occurs ``ratio`` times as often, or
    null; root follows the forms to the last. Null texts have no words; a null key counts as
    an empty one; repeated rows count again. Empty input gives no rows; other columns are
    ignored. ``filter_limit`` and ``bits`` size the filters and change no result.
    """
    words = written(words_of(docs, key, text, least_length, least_count, damage), "words")
    guesses = guessed_pairs(words, filter_limit, bits)
    if guesses is None:
        return words.select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n",
                            F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("form_n"))
    other = words.select(F.col("word").alias("guess"), F.col("n").alias("m"))
    pairs = guesses.join(other, "guess")
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("word").alias("a"), F.col("n"), F.col("guess").alias("b"), F.col("m")),
        F.struct(F.col("guess").alias("a"), F.col("m").alias("n"), F.col("word").alias("b"), F.col("n").alias("m")))).alias("x")).select("x.*")
    best = F.min(F.struct((-F.col("m")).alias("less"), F.col("b").alias("form")))
    near = both.groupBy(F.col("a").alias("word")).agg(F.first("n").alias("n"), F.count("*").alias("n_near"), best.alias("best"))
    form_n = -F.col("best.less")
    is_form = form_n >= F.col("n") * ratio
    near = written(near.select("word", "n_near", F.when(is_form, F.col("best.form")).alias("form"),
                               F.when(is_form, form_n).alias("form_n")), "near")
    last = roots(near.where("form is not null"))
    return (words.join(near, "word", "left").join(last, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n",
                    F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"))
