"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of documents in one task. Only stretches of words that all occur in the
benchmark can hold a window of it, so a shard's index covers those stretches (exactly every
place a window can occur). Windows are searched backwards through wavelet-matrix ranks, all
at once; occurrences are located from sampled suffix positions and merged to removal spans.

The benchmark is dealt to blocks of about ``BLOCK_WORDS`` words, which Spark tasks build and write
to the shared folder. A pass over the documents takes ``GROUP`` blocks, broadcast one by one;
a benchmark of more blocks takes more passes, whose spans are merged, not more memory.
"""

from __future__ import annotations

import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, binary_text, ragged, received, text_slices, written
from .fm_index import FMIndex

WINDOW = 10
BLOCK_WORDS = 200_000
#: blocks of one pass over the documents
GROUP = 16
SHARD_BYTES = 8 << 20

#: word bytes lowered; every other ASCII byte becomes a space (bytes of other characters are word bytes)
WORD_TABLE = bytes(c if re.fullmatch(rb"[0-9a-z\x80-\xff]", bytes([c])) else 32 for c in ASCII_LOWER)


def split_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text with A-Z lowered."""
    return text.translate(WORD_TABLE).split()


class Block:
    """Distinct windows of some benchmark items, as rows of word ids (1..), right-aligned."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple, set[int]] = {}
        self.items = [i for i, _ in items]
        for n, (_, words) in enumerate(items):
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            for k in range(max(1, len(ids) - window + 1)):
                owners.setdefault(tuple(ids[k:k + window]), set()).add(n)
        self.lengths = np.array([len(w) for w in owners], np.int64)
        self.windows = np.zeros((len(owners), window), np.int64)
        for row, w in enumerate(owners):
            self.windows[row, window - len(w):] = w
        self.owners = [sorted(o) for o in owners.values()]


def blocks(benchmark: DataFrame, item: str, text: str, window: int, block_words: int) -> DataFrame:
    """(block, data): pickled :class:`Block` objects of the items that have words, built in tasks.
    Items are dealt by hash, each whole to one block."""
    rows = benchmark.select(F.col(item).cast("string").alias("i"), binary_text(text).alias("t"))
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-size // (6 * block_words)))  # a word and its gap take about six bytes

    def build(part: pa.Table) -> pa.Table:
        items = zip(part.column("i").to_pylist(), (split_words(t.as_py()) for t in part.column("t")))
        held = sorted(((i, w) for i, w in items if w), key=repr)
        data = [cloudpickle.dumps(Block(held, window))] if held else []
        return pa.table({"block": pa.array(part.column("block")[:len(data)].to_pylist(), pa.int32()),
                         "data": pa.array(data, pa.binary())})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(n)).cast("int"))
    return dealt.groupBy("block").applyInArrow(build, "block int, data binary")


def search_shard(words: list[list[bytes]], block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All occurrences of a block's windows in a shard: (window, document, word position)."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    n = int(lengths.sum())
    ids = np.fromiter(map(block.vocabulary.get, chain.from_iterable(words), repeat(0)), np.int64, n)
    owner = np.repeat(np.arange(len(words)), lengths)
    known = ids > 0
    new = np.ones(n, bool)  # a stretch begins
    new[1:] = ~known[:-1] | (owner[1:] != owner[:-1])
    head = np.flatnonzero(known & new)
    end = np.ones(n, bool)
    end[:-1] = ~known[1:] | new[1:]
    size = np.flatnonzero(known & end) + 1 - head
    long = size >= block.lengths.min()
    head, size = head[long], size[long]
    none = np.zeros(0, np.int64)
    if not len(head):
        return none, none, none
    place = ragged(head, size)
    vocab, dense = np.unique(ids[place], return_inverse=True)
    at = np.minimum(np.searchsorted(vocab, block.windows), len(vocab) - 1)
    patterns = np.where(vocab[at] == block.windows, at, -1)
    fm = FMIndex(dense, size, len(vocab))
    lo, hi = fm.search(patterns, block.lengths)
    count = np.maximum(hi - lo, 0)
    found = place[fm.locate(ragged(lo, count))]
    which = np.repeat(np.arange(len(count)), count)
    doc = owner[found]
    return which, doc, found - (np.cumsum(lengths) - lengths)[doc]


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
                       item: str = "item_id", item_text: str = "text", window: int = WINDOW,
                       block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, ``spans`` (merged word intervals [a, b)
    that occurrences of a window cover) and ``items`` (ids, as strings, of the benchmark items
    with a window there).

    A window is ``window`` consecutive words of an item; an item with fewer words, but not
    none, is one window. Null texts have no words; items without words have no window; a null
    item id is the empty string. Repeated item ids count once. Empty tables give no rows
    (documents) or no hits (benchmark). Other columns are ignored.
    """
    return _contaminated(docs, benchmark, key, text, item, item_text, window, block_words).drop("mark")


def _contaminated(docs: DataFrame, benchmark: DataFrame, key: str, text: str, item: str, item_text: str,
                  window: int, block_words: int) -> DataFrame:
    """:func:`contaminated_spans` with a hash of the text, ``mark``."""
    built = written(blocks(benchmark, item, item_text, window, block_words), "benchmark-blocks")
    numbers = sorted(r["block"] for r in built.select("block").collect())
    groups = [numbers[i:i + GROUP] for i in range(0, len(numbers), GROUP)] or [[]]
    passes = []
    for group in groups:
        data = built.where(F.col("block").isin(group)).orderBy("block").select("data")
        sent = [docs.sparkSession.sparkContext.broadcast(bytes(r["data"])) for r in data.toLocalIterator()]
        passes.append(_search(docs, sent, key, text))
        if len(groups) > 1:
            passes[-1] = written(passes[-1], "contaminated")
            for s in sent:
                s.unpersist()
    if len(passes) == 1:
        return passes[0]
    every = passes[0]
    for more in passes[1:]:
        every = every.unionByName(more)
    found = (every.where(F.size("spans") > 0).groupBy(F.col("doc_id").alias("k"), F.col("mark").alias("m"))
             .agg(F.flatten(F.collect_set("spans")).alias("found"),
                  F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("names")))
    rows = passes[0].select("doc_id", "n_words", "mark")
    joined = rows.join(found, rows["doc_id"].eqNullSafe(found["k"]) & (rows["mark"] == found["m"]), "left")
    spans, names = (F.array().cast(kind) for kind in (SPANS, "array<string>"))
    return _merged(joined.select("doc_id", "n_words", F.coalesce("found", spans).alias("spans"),
                                 F.coalesce("names", names).alias("items"), "mark"))


SPANS = "array<struct<a:bigint,b:bigint>>"


def _merged(rows: DataFrame) -> DataFrame:
    """Overlapping and touching spans of each row as one."""
    def merge(spans: list[dict]) -> list[dict]:
        out: list[dict] = []
        for s in sorted(spans, key=lambda s: (s["a"], s["b"])):
            if out and s["a"] <= out[-1]["b"]:
                out[-1]["b"] = max(out[-1]["b"], s["b"])
            else:
                out.append(dict(s))
        return out

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index("spans")
            yield b.set_column(at, b.schema.field(at), pa.array([merge(s) for s in b.column(at).to_pylist()], b.schema.field(at).type))

    return rows.mapInArrow(run, rows.schema)


def _search(docs: DataFrame, sent: list, key: str, text: str) -> DataFrame:
    """One pass over the documents with some blocks of the benchmark."""
    def run(batches):
        for b in batches:
            for lo, texts in text_slices(b.column(1), SHARD_BYTES):
                words = [split_words(t) for t in texts]
                lengths = np.fromiter(map(len, words), np.int64, len(words))
                offset = np.cumsum(lengths + 1) - lengths - 1
                cover = np.zeros(int((lengths + 1).sum()) + 1, np.int64)
                items = [set() for _ in words]
                for s in sent:
                    block = received(s)  # one block at a time
                    which, doc, at = search_shard(words, block)
                    np.add.at(cover, offset[doc] + at, 1)
                    np.add.at(cover, offset[doc] + at + block.lengths[which], -1)
                    for d, w in set(zip(doc.tolist(), which.tolist())):
                        items[d].update(block.items[o] or "" for o in block.owners[w])
                hit = np.concatenate(([0], (np.cumsum(cover) > 0).astype(np.int8)))
                turn = np.diff(hit)
                a, z = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
                owner = np.searchsorted(offset, a, side="right") - 1
                cut = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(words))))).astype(np.int32)
                span = pa.StructArray.from_arrays([pa.array(a - offset[owner]), pa.array(z - offset[owner])],
                                                  names=["a", "b"])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, len(words)), pa.array(lengths),
                     pa.ListArray.from_arrays(pa.array(cut), span),
                     pa.array([sorted(i) for i in items], pa.list_(pa.string())), b.column(2).slice(lo, len(words))],
                    names=["doc_id", "n_words", "spans", "items", "mark"])

    rows = docs.select(F.col(key).alias("doc_id"), binary_text(text).alias("t"), _mark(F.col(text)).alias("mark"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, spans {SPANS}, items array<string>, mark long")


def _mark(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
                      item: str = "item_id", item_text: str = "text", window: int = WINDOW,
                      block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark window, all columns as they are.
    Rows that share a key are judged each by its own text; null keys are keys like any other."""
    bad = (_contaminated(docs, benchmark, key, text, item, item_text, window, block_words).where(F.size("spans") > 0)
           .select(F.col("doc_id").alias("__key"), F.col("mark").alias("__mark")).distinct())
    return docs.join(bad, docs[key].eqNullSafe(bad["__key"]) & (_mark(docs[text]) == bad["__mark"]), "left_anti")
