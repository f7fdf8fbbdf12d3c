"""Ranked lexical search by dense blocked matrix products.

Items (queries) come in blocks of at most about ``BLOCK_WORDS`` words; a block's vocabulary is
all that reaches the tasks. One pass over the documents keeps, per document, its length and
the counts of the block's terms (document rows in sparse form, written once); document
frequencies and the corpus totals are sums over those rows. Scoring multiplies dense tiles:
document impacts (documents x terms) times item weights (terms x items), both whole numbers
held in float64. A term tile ends before any item's partial sum could reach 2^53, so every
product is exact whatever order BLAS adds in, and tile results are added up in 64-bit integers.

A task sees its documents in key order and keeps, per item, the ``k`` best so far. Rows of a
tile are ranked by a stable sort, so equal scores keep key order and a tie is never cut at
random. The tasks' rows meet in two windows, per item and bucket first, then per item.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import binary_text, received, send, text_slices, written
from .decontamination import split_words

K = 20
#: words of the items that are searched in one pass over the documents
BLOCK_WORDS = 200_000
#: documents, terms and items of a dense tile: 2^22 impacts (32 MB) at most
TILE_DOCS, TILE_TERMS, TILE_ITEMS = 1024, 4096, 256
#: an impact is (10^9 tf) div (1000 tf + 12 m), so it stays below this
IMPACT = 1_000_000
EXACT = 1 << 53
SLICE_BYTES = 4 << 20
BUCKETS = 64


def weight(n_docs: int, df: int) -> int:
    """floor(1000 ln((2N + 2) / (2 df + 1))), at least 0."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def term_tiles(weights: np.ndarray, limit: int = EXACT, most: int = TILE_TERMS):
    """Cut the terms of an (items x terms) integer matrix into tiles of at most ``most`` terms
    in which no item's partial sum can reach ``limit``: (term indices, float64 matrix terms x
    items). A weight that alone could reach it is dealt to several tiles."""
    room = (limit - 1) // IMPACT
    left, order = weights.copy(), np.arange(weights.shape[1])
    while len(order):
        part = np.minimum(left[:, order], room)
        total = np.cumsum(part, axis=1).max(axis=0)
        stop = max(1, min(int(np.searchsorted(total, room, side="right")), most))
        tile = order[:stop]
        yield tile, np.ascontiguousarray(part[:, :stop].T, np.float64)
        left[:, tile] -= part[:, :stop]
        order = np.concatenate((tile[left[:, tile].any(axis=0)], order[stop:]))


class Search:
    """Vocabulary of a block of items, and their weights once document frequencies are known."""

    def __init__(self, items: list[tuple[int, list[bytes]]]):
        self.items = np.array([no for no, _ in items], np.int64)
        self.vocabulary: dict[bytes, int] = {}
        self.counts = []  # per item: (term ids, times)
        for _, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            self.counts.append(np.unique(np.array(ids, np.int64), return_counts=True))

    def weigh(self, n_docs: int, df: dict[int, int]) -> None:
        w = np.array([weight(n_docs, df.get(t, 0)) for t in range(len(self.vocabulary))], np.int64)
        self.tiles, places = [], []
        for lo in range(0, len(self.items), TILE_ITEMS):
            group = self.counts[lo:lo + TILE_ITEMS]
            terms = np.unique(np.concatenate([t for t, _ in group]))
            matrix = np.zeros((len(group), len(terms)), np.int64)
            for row, (t, times) in enumerate(group):
                matrix[row, np.searchsorted(terms, t)] = times * w[t]
            self.tiles.append((lo, len(group), [(terms[i], q) for i, q in term_tiles(matrix)]))
            places.append(terms)
        del self.vocabulary, self.counts  # tasks that score need the tiles only

    def score(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int):
        """Integer scores of a tile of documents, one group of items at a time."""
        order = np.argsort(term, kind="stable")
        doc, term, impact = doc[order], term[order], impact[order]
        for lo, width, parts in self.tiles:
            total = np.zeros((n_docs, width), np.int64)
            for terms, q in parts:
                # entries whose term lies in this tile; a tile's terms are ascending
                at = np.searchsorted(terms, term)
                at[at == len(terms)] = 0
                own = terms[at] == term
                if own.any():
                    dense = np.zeros((n_docs, len(terms)))
                    dense[doc[own], at[own]] = impact[own]
                    total += (dense @ q).astype(np.int64)
            yield lo, total


def _term_counts(docs: DataFrame, key: str, text: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs): words of a text, and its counts of the vocabulary's terms."""
    sent = send(docs.sparkSession, vocabulary)

    def run(batches):
        known = received(sent)
        size = max(len(known), 1)
        for b in batches:
            for lo, texts in text_slices(b.column(1), SLICE_BYTES):
                n, keys, cut = [], [], [0]
                counts = []
                for t in texts:
                    words = split_words(t)
                    ids = np.fromiter((i for i in map(known.get, words) if i is not None), np.int64)
                    ids, times = np.unique(ids, return_counts=True)
                    n.append(len(words))
                    keys.append(ids)
                    counts.append(times)
                    cut.append(cut[-1] + len(ids))
                offsets = pa.array(np.array(cut, np.int32))
                join = lambda parts, kind: pa.array(np.concatenate(parts).astype(kind))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, len(texts)), pa.array(n, pa.int64()),
                     pa.ListArray.from_arrays(offsets, join(keys, np.int32)),
                     pa.ListArray.from_arrays(offsets, join(counts, np.int64))],
                    names=["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col(key).alias("doc_id"), binary_text(text).alias("t"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n long, terms array<int>, tfs array<long>")


def _best(rows: DataFrame, search: Search, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item_no, doc_id, score): each task's ``k`` best documents with a score, per item."""
    sent = send(rows.sparkSession, search)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        own, held = received(sent), {}
        keys: list = []  # documents that some item holds
        for b in batches:
            for lo in range(0, b.num_rows, TILE_DOCS):
                part = b.slice(lo, TILE_DOCS)
                count = np.diff(part.column(2).offsets.to_numpy())
                if not count.sum():
                    continue
                doc = np.repeat(np.arange(part.num_rows), count)
                term = part.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                tf = part.column(3).flatten().to_numpy(zero_copy_only=False)
                # Python numbers: 25 n N may pass 64 bits in a very large corpus
                m = np.array([75 + 25 * n * n_docs // n_terms for n in part.column(1).to_pylist()], np.int64)
                for first, total in own.score(doc, term, impacts(tf, m[doc]), part.num_rows):
                    before = held.get(first)
                    base = len(keys)
                    order = np.argsort(-total, axis=0, kind="stable")[:k]  # ties: earlier rows, so smaller keys
                    score, place = np.take_along_axis(total, order, 0), order + base
                    if before is not None:  # earlier documents first, so a stable sort keeps key order
                        score, place = np.vstack((before[0], score)), np.vstack((before[1], place))
                        order = np.argsort(-score, axis=0, kind="stable")[:k]
                        score, place = np.take_along_axis(score, order, 0), np.take_along_axis(place, order, 0)
                    held[first] = (score, place)
                keys += part.column(0).to_pylist()
                if len(keys) > 64 * TILE_DOCS:  # forget documents that no item holds
                    live = np.unique(np.concatenate([p.ravel() for _, p in held.values()]))
                    held = {f: (s, np.searchsorted(live, p)) for f, (s, p) in held.items()}
                    keys = [keys[i] for i in live.tolist()]
        for first, (score, place) in held.items():
            row, column = np.nonzero(score > 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own.items[first + column]), pa.array([keys[i] for i in place[row, column].tolist()], KIND),
                 pa.array(score[row, column])], names=["item_no", "doc_id", "score"])

    KIND = pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64()
    ordered = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_last())
    return ordered.mapInArrow(run, f"item_no long, doc_id {kind}, score long")


def _first(rows: DataFrame, k: int, *by: str | Column) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _empty(spark: SparkSession, item_kind: str, doc_kind: str) -> DataFrame:
    return spark.createDataFrame([], f"item_id {item_kind}, rank int, doc_id {doc_kind}, score long")


def lexical_search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
                   item: str = "item_id", item_text: str = "text", k: int = K,
                   block_words: int = BLOCK_WORDS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of highest score above 0 for every
    item, equal scores by ascending key, nulls last; fewer where fewer score.

    A term is a maximal run of ASCII letters and digits and of any other non-ASCII characters,
    A-Z lowered. Null texts have no terms; an item without terms, or without a document that
    holds one, has no rows. Every row is a document of its own, repeated ones too; every item
    row is an item of its own, so rows that repeat an item id are ranked each by itself. Empty
    tables give no rows. Other columns are ignored. Keys are integers or strings.
    """
    spark = docs.sparkSession
    kinds = items.schema[item].dataType.simpleString(), docs.schema[key].dataType.simpleString()
    own = written(items.select(F.col(item).alias("item_id"), binary_text(item_text).alias("t"))
                  .withColumn("item_no", F.monotonically_increasing_id()), "items")
    size = own.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n_blocks = max(1, -(-size // (6 * block_words)))  # a word and its gap take six bytes or more
    found = []
    for block in range(n_blocks):
        part = own.where(F.pmod(F.xxhash64("item_no"), F.lit(n_blocks)) == block)
        words = [(r["item_no"], split_words(bytes(r["t"]))) for r in part.select("item_no", "t").collect()]
        words = sorted((no, w) for no, w in words if w)
        if not words:
            continue
        search = Search(words)
        rows = written(_term_counts(docs, key, text, search.vocabulary), "term-counts")
        n_docs, n_terms = rows.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        if not n_docs:
            return _empty(spark, *kinds)
        df = rows.select(F.explode("terms").alias("term")).groupBy("term").count()
        search.weigh(n_docs, {r["term"]: r["count"] for r in df.collect()})  # at most the block's vocabulary
        found.append(written(_best(rows, search, n_docs, n_terms, k), "best"))
    if not found:
        return _empty(spark, *kinds)
    best = found[0]
    for more in found[1:]:
        best = best.unionByName(more)
    few = _first(best.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS))), k, "item_no", "bucket")
    return (_first(few.drop("rank"), k, "item_no").join(own.select("item_no", "item_id"), "item_no")
            .select("item_id", "rank", "doc_id", "score"))
