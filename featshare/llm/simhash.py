"""SimHash near-dedup with a byte-position inverted index and count filtering.

A fingerprint is eight positional bytes. Two fingerprints that differ in at most four bits
differ in at most four bytes, so at least four of their eight positional bytes match: the
guaranteed minimum. The index posts every distinct fingerprint under positional bytes, taken
three positions at a time (``TRIPLES``, chosen so that any four positions contain one of
them), which keeps a posting list at one in 2^24 of the fingerprints instead of one in 2^8.
Inside a posting list the shared positional bytes of a pair are tallied, pairs that reach the
minimum are kept, and their bit distance is verified.

A list emits a spanning forest of its links, never all its pairs: linked sets stay the same.
A list longer than ``BLOCK`` is cut into blocks, and each pair of blocks is one group, so one
crowded neighbourhood spreads over many tasks of bounded size.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, binary_text, components, written

SHINGLE = 4
MAX_BITS = 4
SEED = 42
BLOCK = 1024


def _triples() -> list[tuple[int, int, int]]:
    """20 triples of 8 positions such that any 4 positions contain one: three groups in a
    ring; a triple lies in one group, or takes two positions of one and one of the next."""
    group = [0, 0, 0, 1, 1, 1, 2, 2]
    out = []
    for t in combinations(range(8), 3):
        g = [group[p] for p in t]
        inside = len(set(g)) == 1
        two_one = len(set(g)) == 2 and any(
            g.count(x) == 2 and g.count((x + 1) % 3) == 1 for x in range(3))
        if inside or two_one:
            out.append(t)
    return out


TRIPLES = _triples()


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a UTF-8 text: A-Z lowered, ASCII white space splits words, shingles
    with repeats hashed by XXH64 (seed 42); a bit is set if over half the hashes set it.
    No words: zero. Fewer words than a shingle: one hash of all of them."""
    words = text.translate(ASCII_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    n = max(len(words) - shingle + 1, 1)
    starts = np.concatenate(([0], gaps + 1))[:n].tolist()
    stops = np.concatenate((gaps, [len(joined)]))[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[i:j], SEED) for i, j in zip(starts, stops)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 65536):  # bounded memory on very long texts
        bits = np.unpackbits(hashes[k:k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): one row per row; null text has no words, so fingerprint zero."""
    def run(batches):
        for b in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))],
                                             names=["doc_id", "fp"])

    rows = docs.select(F.col(key).alias("doc_id"), binary_text(text).alias("t"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, fp long")


def _posting_keys(fp: Column) -> Column:
    byte = [F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255)) for i in range(8)]
    keys = []
    for n, (a, b, c) in enumerate(TRIPLES):
        keys.append(F.lit(n << 24) + F.shiftleft(byte[a], 16) + F.shiftleft(byte[b], 8) + byte[c])
    return F.array(*[k.cast("long") for k in keys])


def forest(fps: np.ndarray, max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """Spanning forest of the links in one posting list (indices into ``fps``). For every
    frontier fingerprint: tally positional bytes shared with the unreached ones, keep those
    that reach the guaranteed minimum, verify the bit distance."""
    least = 8 - max_bits  # each differing byte holds a differing bit at least
    left = np.arange(len(fps))
    out = []
    while left.size:
        queue, left = [int(left[0])], left[1:]
        while queue and left.size:
            i = queue.pop()
            diff = fps[left] ^ fps[i]
            shared = (diff.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
            near = (shared >= least) & (np.bitwise_count(diff) <= max_bits)
            if near.any():
                hit = left[near].tolist()
                out += [(i, j) for j in hit]
                queue += hit
                left = left[~near]
    return out


def links(fps: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """(a, b) pairs of distinct fingerprints (column ``fp``) whose closure is the closure of
    all pairs within ``max_bits`` bits. ``max_bits`` is at most 4, which TRIPLES guarantee."""
    if not 0 <= max_bits <= 4:
        raise ValueError("the posting triples guarantee candidates up to 4 differing bits")
    postings = fps.select("fp", F.explode(_posting_keys(F.col("fp"))).alias("key"))
    lists = postings.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("m").cast("long")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("m") - 1))
    groups = (postings.join(lists, "key").withColumn("m", blocks).withColumn("i", own)
              .withColumn("j", other)
              .groupBy("key", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"))
              .agg(F.collect_list("fp").alias("fps")))

    def run(batches):
        for b in batches:
            lists_, a, c = b.column(0), [], []
            values = lists_.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(np.diff(lists_.offsets.to_numpy()))
            for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist()):
                part = np.ascontiguousarray(values[lo:hi]).view(np.uint64)
                for i, j in forest(part, max_bits):
                    a.append(int(values[lo + i]))
                    c.append(int(values[lo + j]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], names=["a", "b"])

    return groups.select("fps").mapInArrow(run, "a long, b long").distinct()


def simhash_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                   max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (signed 64 bits) and component_id, the smallest
    key reachable over links of at most ``max_bits`` differing bits.

    Equal fingerprints are one node however many rows carry them, so a group of copies costs
    one posting; rows are joined back at the end. Null and word-less texts share fingerprint
    zero. Null keys are never a component_id unless a component has no other. Repeated rows
    stay repeated; empty input gives no rows; other columns are ignored.
    """
    rows = written(fingerprints(docs, key, text, shingle), "fingerprints")
    member = _members(rows, F.col("doc_id"), max_bits, block)
    return rows.join(member, "fp").select("doc_id", "fp", F.col("first").alias("component_id"))


def _members(rows: DataFrame, rank: Column, max_bits: int, block: int) -> DataFrame:
    """(fp, first): for each distinct fingerprint the smallest ``rank`` of its component's rows."""
    nodes = written(rows.groupBy("fp").agg(F.min(rank).alias("first")), "nodes")
    root = components(links(nodes.select("fp"), max_bits, block), "simhash")
    rooted = nodes.join(root, nodes["fp"] == root["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("first"))
    return rooted.select("fp", "root").join(smallest, "root").select("fp", "first")


def keep_one_per_group(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                       max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """``docs`` with one document of each group only, all columns as they are: the one of the
    smallest key, null keys last, and of equal keys the text of the smallest hash.

    A document is a key and a text, so rows that share a key only are judged each by its own
    text, and rows that repeat both stay or go together. Null texts and texts without words are
    one group. Empty input gives no rows; clashing names of other columns do no harm.
    """
    mark = F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))
    marked = docs.select(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), mark.alias("mark")).alias("id"),
                         F.col(text).alias("t"))
    rows = written(fingerprints(marked, "id", "t", shingle), "fingerprints")
    gone = (rows.join(_members(rows, F.col("doc_id"), max_bits, block), "fp").where("doc_id <> first")
            .select(F.col("doc_id.key").alias("__key"), F.col("doc_id.mark").alias("__mark")).distinct())
    own = F.xxhash64(F.coalesce(docs[text].cast("string"), F.lit("")))
    return docs.join(gone, docs[key].eqNullSafe(gone["__key"]) & (own == gone["__mark"]), "left_anti")
