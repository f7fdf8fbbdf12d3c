"""Stupid-backoff language-model scores, computed by joining n-gram tables.

Texts are held in blocks of about ``BLOCK_BYTES``. Every block pre-aggregates its n-grams of
all orders and ships the distinct ones, once per block, to the partition their hash names;
a partition adds the counts up over all blocks and answers each block with the counts the
rest of the corpus has. The block then scores its own texts. Counts cover all documents, and
a document is scored by what the others hold: its own n-grams are taken out first, else no
n-gram would ever be unseen.

An n-gram of three words or more can only occur elsewhere if both shorter n-grams inside it
do, so higher orders are shipped in later rounds, and only where the answers before allow it.
A frequent n-gram reaches its partition once per block, not once per occurrence; partitions
hold about ``PART_KEYS`` keys whatever the corpus size, and blocks are cut by bytes, so one
source or a group of copies spreads over many.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, binary_text, slices, written

ORDER = 3
ALPHA = 0.4
BLOCK_BYTES = 8 << 20
PART_KEYS = 2_000_000


def _blocks(docs: DataFrame, key: str, text: str, block_bytes: int) -> DataFrame:
    """(block, place, words, doc_id, t): rows in blocks, numbered as the tasks read them."""
    def run(batches):
        part, block, used, place = TaskContext.get().partitionId(), 0, 0, 0
        for b in batches:
            ids, places, words = [], [], []
            for t in b.column(1):
                size = len(t.as_buffer()) + 16
                if used and used + size > block_bytes:
                    block, used, place = block + 1, 0, 0
                ids.append((part << 32) + block)
                places.append(place)
                words.append(len(t.as_py().split()))
                used, place = used + size, place + 1
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.int64()),
                                              pa.array(words, pa.int64()), *b.columns],
                                             names=["block", "place", "words", "doc_id", "t"])

    rows = docs.select(F.col(key).alias("doc_id"), binary_text(text).alias("t"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"block long, place long, words long, doc_id {kind}, t binary")


def grams(texts: list[bytes], order: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(words per text, one array of n-gram hashes per order, owner): place i of order n holds
    the n-gram that ends at word i; texts are parted, and n-grams that cross texts are 0."""
    words = [t.translate(ASCII_LOWER).split() for t in texts]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    one = np.concatenate([np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w)) for w in words]
                         or [np.zeros(0, np.uint64)])
    owner = np.repeat(np.arange(len(words)), lengths)
    at = np.arange(len(one)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = [one]
    for n in range(1, order):
        low = out[-1]
        high = np.zeros_like(one)
        if len(one) > n:
            x = low[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(n)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            high[1:] = x ^ (x >> np.uint64(32))
        high[at < n] = 0
        out.append(high)
    return lengths, out, owner


def _distinct(gram: np.ndarray, n_parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams in order: (keys, counts, end of each partition)."""
    keys, counts = np.unique(gram[gram != 0], return_counts=True)
    part = ((keys >> np.uint64(32)) * np.uint64(n_parts)) >> np.uint64(32)  # equal ranges of the hash
    return keys, counts, np.cumsum(np.bincount(part.astype(np.int64), minlength=n_parts))


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys, not none: the first, then differences in as few bytes as the largest
    needs."""
    steps = np.diff(keys)
    wide = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return bytes([wide]) + keys[:1].tobytes() + steps.view(np.uint8).reshape(-1, 8)[:, :wide].tobytes()


def unpack_keys(raw: bytes) -> np.ndarray:
    wide, first = raw[0], np.frombuffer(raw, np.uint64, 1, offset=1)
    steps = np.zeros(((len(raw) - 9) // wide, 8), np.uint8)
    steps[:, :wide] = np.frombuffer(raw, np.uint8, offset=9).reshape(-1, wide)
    return np.cumsum(np.concatenate((first, steps.view(np.uint64).ravel())), dtype=np.uint64)


def _small(x: np.ndarray) -> bytes:
    """Counts in as few bytes as the largest needs, width first."""
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if not len(x) or x.max() <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes()


def _counts(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"u{raw[0]}", offset=1).astype(np.int64)


def _runs(block: np.ndarray, sizes: list[int], limit: int):
    """Runs of consecutive rows of one block and about ``limit`` bytes."""
    heads = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
    for lo, hi in zip(heads, heads[1:]):
        for a, b in slices(sizes[lo:hi], limit):
            yield lo + a, lo + b


_TABLE = "block long, lo long, hi long, n long, part long, keys binary, counts binary"
#: orders shipped in the first round; higher ones only where their parts are known elsewhere
FIRST = 2


def _table_rows(gram: np.ndarray, n: int, where: tuple[int, int, int], n_parts: int) -> list[tuple]:
    """Rows of a run's distinct n-grams (``where``: block, first and last place)."""
    keys, counts, ends = _distinct(gram, n_parts)
    out, start = [], 0
    for p, end in enumerate(ends.tolist()):
        if end > start:
            out.append((*where, n, p, pack_keys(keys[start:end]), _small(counts[start:end])))
        start = end
    return out


def _tables(texts: DataFrame, order: int, n_parts: int, block_bytes: int) -> DataFrame:
    """Every run's distinct n-grams of the first orders: (block, lo, hi, n, part, keys, counts)."""
    schema = pa.schema([(c, pa.int64()) for c in ("block", "lo", "hi", "n", "part")]
                       + [("keys", pa.binary()), ("counts", pa.binary())])

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            block, place = (b.column(i).to_numpy() for i in (0, 1))
            sizes = pa.compute.binary_length(b.column(2)).to_numpy(zero_copy_only=False) + 16
            for lo, hi in _runs(block, sizes.tolist(), block_bytes):
                where, out = (int(block[lo]), int(place[lo]), int(place[hi - 1]) + 1), []
                for n, gram in enumerate(grams(b.column(2).slice(lo, hi - lo).to_pylist(), min(order, FIRST))[1], 1):
                    out += _table_rows(gram, n, where, n_parts)
                if out:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)

    return texts.select("block", "place", "t").mapInArrow(run, _TABLE)


def _rest(got: pd.DataFrame, order: int) -> list[np.ndarray]:
    """Per order, a run's answered counts in the order of its keys."""
    got = got.sort_values(["n", "part"])
    return [np.concatenate([_counts(c) for c in got.loc[got["n"] == n, "rest"]] or [np.zeros(0, np.int64)])
            for n in range(1, order + 1)]


def _higher_tables(texts: DataFrame, answers: DataFrame, n: int, n_parts: int) -> DataFrame:
    """Every run's distinct n-grams of order ``n`` that the other runs may hold: they can only
    if they hold both (n-1)-grams inside. The others are unseen there without asking."""
    def run(rows: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        out = []
        for lo, hi, raw, own in _ranges(rows, got):
            _, gram, owner = grams(raw, n)
            may = _known(gram, owner, _rest(own, n - 1))[0][n - 1]
            out += _table_rows(np.where(may, gram[n - 1], 0), n, (int(rows["block"].iloc[0]), lo, hi), n_parts)
        return pd.DataFrame(out, columns=["block", "lo", "hi", "n", "part", "keys", "counts"])

    return (texts.select("block", "place", "t").groupBy("block").cogroup(answers.groupBy("block"))
            .applyInPandas(run, _TABLE))


def _ranges(rows: pd.DataFrame, got: pd.DataFrame):
    """A block's runs: (first place, last place, texts, their answers)."""
    rows = rows.sort_values("place")
    place = rows["place"].to_numpy()
    for (lo, hi), own in got.groupby(["lo", "hi"]):
        inside = rows["t"][(place >= lo) & (place < hi)]
        yield int(lo), int(hi), [bytes(t) for t in inside], own


def _known(gram: list[np.ndarray], owner: np.ndarray, rest: list[np.ndarray]):
    """(per order, places whose n-gram was asked for; per answered order, how often other texts
    hold the n-gram that ends at a place). One more order than ``rest`` is judged."""
    asked, others, held = [], [], []
    for n in range(len(gram)):
        has = gram[n] != 0
        if n >= FIRST:
            before = np.concatenate(([0], held[n - 1][:-1]))[:len(has)]
            has = has & (held[n - 1] > 0) & (before > 0)
        asked.append(has)
        if n == len(rest):
            break
        count, outside = np.zeros(len(owner), np.int64), np.zeros(len(owner), np.int64)
        # sorted by n-gram, and within one by place, so also by text
        place = np.argsort(gram[n], kind="stable")
        place = place[len(place) - int((gram[n] != 0).sum()):]
        if len(place):
            own, text = gram[n][place], owner[place]
            key = np.concatenate(([True], own[1:] != own[:-1]))
            pair = np.concatenate(([True], key[1:] | (text[1:] != text[:-1])))
            number, group = np.cumsum(key) - 1, np.cumsum(pair) - 1
            run_rest = np.zeros(number[-1] + 1, np.int64)
            run_rest[has[place[key]]] = rest[n]
            outside[place] = run_rest[number]
            count[place] = (run_rest + np.bincount(number))[number] - np.bincount(group)[group]
        held.append(outside)
        others.append(count)
    return asked, others


def _answers(tables: DataFrame) -> DataFrame:
    """Each run's n-grams joined with the corpus counts of their partition: what the other
    runs hold of every key, in the run's own key order."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = [unpack_keys(k) for k in pdf["keys"]]
        own = np.concatenate([_counts(c) for c in pdf["counts"]])
        _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        rest = np.bincount(inverse, own).astype(np.int64)[inverse] - own
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        return pd.DataFrame({"block": pdf["block"], "lo": pdf["lo"], "hi": pdf["hi"], "n": pdf["n"], "part": pdf["part"],
                             "rest": [_small(r) for r in np.split(rest, cuts)]})

    return tables.groupBy("n", "part").applyInPandas(
        run, "block long, lo long, hi long, n long, part long, rest binary")


def score_texts(raw: list[bytes], rest: list[np.ndarray], order: int, total: int, alpha: float):
    """(words, sum of log scores) per text. ``rest``: per order, the other runs' counts of the
    run's distinct n-grams in their order; ``total``: words of the corpus."""
    lengths, gram, owner = grams(raw, order)
    others, has = _known(gram, owner, rest)[1], [g != 0 for g in gram]
    rows = np.maximum(total - lengths, 0)[owner].astype(float)
    value = np.where(others[0] > 0, others[0] / np.maximum(rows, 1), 1 / (rows + 1))
    for n in range(1, order):  # a longer context, where the text has one
        context = np.concatenate(([1], others[n - 1][:-1]))[:len(owner)]
        seen = np.where(others[n] > 0, others[n] / np.maximum(context, 1), alpha * value)
        value = np.where(has[n], seen, value)
    return lengths, np.bincount(owner, np.log(value), minlength=len(raw))


def lm_scores(docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER, alpha: float = ALPHA,
              block_bytes: int = BLOCK_BYTES, part_keys: int = PART_KEYS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, log_score (sum of natural logs) and
    mean_log_score (null without words).

    Words are what ASCII white space parts, A-Z lowered. The score of a word is the count of
    the longest n-gram (up to ``order`` words, within the text) that other rows hold over the
    count of its context, times ``alpha`` per word of context given up; a word no other row
    holds scores 1 / (N + 1) in place of count / N, N the words of the other rows. Null texts
    have no words and score 0. Repeated rows are other rows of each other. Empty input gives
    no rows; other columns are ignored.
    """
    texts = written(_blocks(docs, key, text, block_bytes), "texts")
    total = int(texts.agg(F.sum("words")).first()[0] or 0)
    n_parts = max(1, -(-total * order // part_keys))
    answers = written(_answers(_tables(texts, order, n_parts, block_bytes)), "counts")
    for n in range(FIRST + 1, order + 1):
        more = written(_answers(_higher_tables(texts, answers, n, n_parts)), "counts")
        answers = answers.unionByName(more)

    def run(rows: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place", ignore_index=True)
        place = rows["place"].to_numpy()
        n_words, logs = np.zeros(len(rows), np.int64), np.zeros(len(rows))
        for lo, hi, raw, own in _ranges(rows, got):
            at = np.flatnonzero((place >= lo) & (place < hi))
            n_words[at], logs[at] = score_texts(raw, _rest(own, order), order, total, alpha)
        return pd.DataFrame({"doc_id": rows["doc_id"], "n_words": n_words, "log_score": logs})

    kind = texts.schema["doc_id"].dataType.simpleString()
    return (texts.groupBy("block").cogroup(answers.groupBy("block"))
            .applyInPandas(run, f"doc_id {kind}, n_words long, log_score double")
            .withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words"))))
