"""Substring dedup with a compressed FM-index per shard.

Two equal windows of ``window`` words share the smallest hash among their ``GRAM``-word
grams, so that hash (the anchor) names a shard where both can be found. Consecutive windows
with one anchor form a segment; a window lies in exactly one segment. An anchor met once in
the whole corpus cannot repeat and goes no further. The other segments are pre-aggregated
(equal ones become one with a multiplicity) and dealt to shards by anchor; every shard builds
an FM-index of its segments and streams them through it: backward search over the wavelet
matrix yields matching statistics, the longest match at every word that occurs with a total
multiplicity of two or more, and matches of at least a window are the intervals to remove.

An anchor with more than ``CROWD`` different segments is split: its segments are cut into
single windows that become anchors of their own, which again collapse when equal. No shard
holds more than its share of one passage, however common it is.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_text, ragged, text_slices, written
from .fm_index import FMIndex

WINDOW = 35
GRAM = 16
#: windows of one segment at most
RUN = 40
CROWD = 1000
SHARD_WORDS = 300_000
#: bytes kept of a word's hash; 48 bits, and a window compares all its words
WORD_BYTES = 6
SLICE = 2 << 20


def _mix(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ np.uint64(k)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def segments(hashes: np.ndarray, lengths: np.ndarray, window: int, gram: int):
    """Segments of concatenated texts: (text, start within the text, number of windows,
    anchor, how often the anchor's gram occurs in the segment)."""
    none = np.zeros(0, np.int64)
    if len(hashes) < window:
        return none, none, none, none.view(np.uint64), none
    g, k = hashes, 1
    while k < gram:  # gram is a power of two
        g = _mix(g[:-k], g[k:], k)
        k *= 2
    width = window - gram + 1
    low, k = g, 1
    while 2 * k <= width:
        low = np.minimum(low[:-k], low[k:])
        k *= 2
    low = np.minimum(low[:len(g) - width + 1], low[width - k:width - k + len(g) - width + 1])
    offset = np.cumsum(lengths) - lengths
    n = np.maximum(lengths - window + 1, 0)
    at = ragged(offset, n)
    if not len(at):
        return none, none, none, none.view(np.uint64), none
    anchor, text = low[at], np.repeat(np.arange(len(lengths)), n)
    head = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]))))
    size = np.diff(np.append(head, len(at)))  # periodic text repeats its anchor: cut its runs
    cuts = -(-size // RUN)
    head = np.repeat(head, cuts) + RUN * ragged(np.zeros(len(cuts), np.int64), cuts)
    count = np.diff(np.append(head, len(at)))
    grams = count + width - 1  # gram places under the segment's windows
    same = g[ragged(at[head], grams)] == np.repeat(anchor[head], grams)
    often = np.add.reduceat(same, np.cumsum(grams) - grams, dtype=np.int64)
    return text[head], at[head] - offset[text[head]], count, anchor[head], often


def _batches(b, column: int):
    """Slices of a batch: (first row, word lists, lengths, hashes)."""
    for lo, texts in text_slices(b.column(column), SLICE):
        words = [t.split() for t in texts]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        yield lo, words, lengths


def _flat(words: list[list[bytes]]) -> np.ndarray:
    return np.concatenate([word_hashes(w) for w in words]) if words else np.zeros(0, np.uint64)


def scan(docs: DataFrame, key: str, text: str, window: int, gram: int) -> DataFrame:
    """First pass: (doc_id, mark, n_words, sha256 of the words, anchors, weights)."""
    def run(batches):
        for b in batches:
            for lo, words, lengths in _batches(b, 2):
                who, _, _, anchor, often = segments(_flat(words), lengths, window, gram)
                cut = np.concatenate(([0], np.cumsum(np.bincount(who, minlength=len(words))))).astype(np.int32)
                sha = [hashlib.sha256(b" ".join(w)).hexdigest() for w in words]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, len(words)), b.column(1).slice(lo, len(words)), pa.array(lengths),
                     pa.array(sha), pa.ListArray.from_arrays(pa.array(cut), pa.array(anchor.view(np.int64))),
                     pa.ListArray.from_arrays(pa.array(cut), pa.array(np.minimum(often, 2).astype(np.int32)))],
                    names=["doc_id", "mark", "n_words", "sha", "anchors", "weights"])

    rows = _keyed(docs, key, text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, mark long, n_words long, sha string, "
                                "anchors array<long>, weights array<int>")


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, mark, t): mark tells texts of a repeated key apart; rows that repeat both are
    the same text under the same key and get the same result."""
    return docs.select(F.col(key).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("mark"),
                       binary_text(text).alias("t"))


def _cut_segments(marked: DataFrame, window: int, gram: int, with_words: bool) -> DataFrame:
    """Second pass over documents with repeated anchors: their segments."""
    def run(batches):
        for b in batches:
            wanted = b.column(3)
            for lo, words, lengths in _batches(b, 2):
                hashes = _flat(words)
                who, start, count, anchor, _ = segments(hashes, lengths, window, gram)
                part = wanted.slice(lo, len(words))
                values = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                owner = np.repeat(np.arange(len(words)), np.asarray(pa.compute.list_value_length(part)))
                pairs = set(zip(owner.tolist(), values.tolist()))
                keep = np.fromiter(((w, a) in pairs for w, a in zip(who.tolist(), anchor.view(np.int64).tolist())),
                                   bool, len(who))
                who, start, count, anchor = who[keep], start[keep], count[keep], anchor[keep]
                raw = hashes.view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES].tobytes()
                at = (np.cumsum(lengths) - lengths)[who] + start
                stop = at + count + window - 1
                segs = [raw[i * WORD_BYTES:j * WORD_BYTES] for i, j in zip(at.tolist(), stop.tolist())]
                cols = [pa.array(anchor.view(np.int64)), pa.array(segs, pa.binary())]
                names = ["anchor", "seg"]
                if not with_words:
                    take = pa.array(who + lo)
                    cols += [b.column(0).take(take), b.column(1).take(take), pa.array(start)]
                    names += ["doc_id", "mark", "start"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = marked.schema["doc_id"].dataType.simpleString()
    return marked.select("doc_id", "mark", "t", "wanted").mapInArrow(
        run, "anchor long, seg binary" + ("" if with_words else f", doc_id {kind}, mark long, start long"))


def _digest(seg: str) -> list:
    return [F.xxhash64(seg).alias("d1"), F.xxhash64(F.col(seg), F.lit(1)).alias("d2")]


def repeated_intervals(segs: DataFrame, window: int, n_shards: int) -> DataFrame:
    """(d1, d2, hits) of distinct segments(anchor, seg, mult): merged word intervals whose
    windows occur twice or more in all, by matching statistics against the shard's index."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        raw = [np.frombuffer(s, np.uint8).reshape(-1, WORD_BYTES) for s in pdf["seg"]]
        lengths = np.array([len(r) for r in raw], np.int64)
        wide = np.zeros((int(lengths.sum()), 8), np.uint8)
        wide[:, :WORD_BYTES] = np.concatenate(raw)
        vocab, words = np.unique(wide.view(np.uint64).ravel(), return_inverse=True)
        index = FMIndex(words, lengths, len(vocab), lcp=True)
        match = index.matching_statistics(words, lengths, np.repeat(pdf["mult"].to_numpy(np.int64), lengths),
                                          window=window)
        out, at = [], np.cumsum(lengths) - lengths
        hit = np.flatnonzero(match >= window)
        owner = np.searchsorted(at, hit, side="right") - 1
        found: dict[int, list[list[int]]] = {}
        for o, s, n in zip(owner.tolist(), (hit - at[owner]).tolist(), match[hit].tolist()):
            spans = found.setdefault(o, [])
            if spans and s <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], s + n)
            else:
                spans.append([s, s + n])
        d1, d2 = pdf["d1"].to_numpy(), pdf["d2"].to_numpy()
        for o, spans in found.items():
            out.append((d1[o], d2[o], [x for s in spans for x in s]))
        return pd.DataFrame(out, columns=["d1", "d2", "hits"])

    shard = F.pmod(F.xxhash64("anchor"), F.lit(n_shards))
    return (segs.select("seg", "mult", *_digest("seg"), shard.alias("shard"))
            .groupBy("shard").applyInPandas(run, "d1 long, d2 long, hits array<int>"))


def _shards(segs: DataFrame, shard_words: int) -> int:
    words = segs.agg(F.sum(F.octet_length("seg"))).first()[0] or 0
    return max(1, -(-int(words) // (WORD_BYTES * shard_words)))


def _kept(docs: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            removed, sha = [], []
            for t, spans in zip(b.column(2), b.column(3)):
                words, spans = t.as_py().split(), spans.as_py()
                gone = np.zeros(len(words) + 1, np.int64)
                np.add.at(gone, [s["a"] for s in spans], 1)
                np.add.at(gone, [s["b"] for s in spans], -1)
                keep = np.cumsum(gone[:-1]) == 0
                text = b" ".join([w for w, k in zip(words, keep.tolist()) if k])
                removed.append(len(words) - int(keep.sum()))
                sha.append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(removed, pa.int64()), pa.array(sha),
                                              b.column(3)], names=["k", "m", "removed", "kept_sha", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "mark", "t", "spans").mapInArrow(
        run, f"k {kind}, m long, removed long, kept_sha string, spans array<struct<a:long,b:long>>")


def substring_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW,
                    gram: int = GRAM, crowd: int = CROWD, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 and ``spans``, the
    word intervals [a, b) removed (per segment; they may touch). A word goes if a window of
    ``window`` words over it occurs anywhere else, in its own text or another.

    Words are what ASCII white space parts, unchanged; null has none, and shorter texts than a
    window lose nothing. Repeated rows are texts of their own, so they lose their windows.
    Empty input gives no rows; other columns are ignored.
    """
    if window < gram or gram & (gram - 1):
        raise ValueError("gram must be a power of two and at most the window")
    first = written(scan(docs, key, text, window, gram), "anchors")
    pairs = first.select("doc_id", "mark", F.explode(F.arrays_zip("anchors", "weights")).alias("x")).select(
        "doc_id", "mark", F.col("x.anchors").alias("anchor"), F.col("x.weights").alias("weight"))
    often = pairs.groupBy("anchor").agg(F.sum("weight").alias("n")).where("n > 1").select("anchor")
    wanted = (pairs.select("doc_id", "mark", "anchor").join(often, "anchor", "left_semi")
              .groupBy(F.col("doc_id").alias("k"), F.col("mark").alias("m")).agg(F.collect_set("anchor").alias("wanted")))
    rows = _keyed(docs, key, text)
    marked = written(rows.join(wanted, rows["doc_id"].eqNullSafe(wanted["k"]) & (rows["mark"] == wanted["m"]))
                     .drop("k", "m"), "marked")
    segs = written(_cut_segments(marked, window, gram, True).groupBy("anchor", "seg")
                   .agg(F.count("*").alias("mult")), "segments")
    crowded = written(segs.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > crowd)
                      .select("anchor"), "crowded")
    if crowded.isEmpty():
        hits = repeated_intervals(segs, window, _shards(segs, shard_words))
    else:
        hits = _with_crowds(segs, crowded, window, shard_words)
    places = _cut_segments(marked, window, gram, False).select("doc_id", "mark", "start", *_digest("seg"))
    hit = F.explode(F.expr("transform(sequence(0, size(hits) div 2 - 1), "
                           "i -> struct(start + hits[2 * i] as a, start + hits[2 * i + 1] as b))"))
    spans = (places.join(hits, ["d1", "d2"]).select("doc_id", "mark", hit.alias("x"))
             .groupBy(F.col("doc_id").alias("k"), F.col("mark").alias("m"))
             .agg(F.sort_array(F.collect_set("x")).alias("spans")))
    texts = marked.drop("wanted").join(
        spans, marked["doc_id"].eqNullSafe(spans["k"]) & (marked["mark"] == spans["m"])).drop("k", "m")
    cleaned = written(_kept(texts), "cleaned").dropDuplicates(["k", "m"])
    return (first.join(cleaned, first["doc_id"].eqNullSafe(cleaned["k"]) & (first["mark"] == cleaned["m"]), "left")
            .select("doc_id", "n_words", F.coalesce("removed", F.lit(0)).cast("long").alias("n_removed"),
                    F.coalesce("kept_sha", "sha").alias("kept_sha256"),
                    F.coalesce("spans", F.array().cast("array<struct<a:bigint,b:bigint>>")).alias("spans")))


def _with_crowds(segs: DataFrame, crowded: DataFrame, window: int, shard_words: int) -> DataFrame:
    """Intervals when some anchors have a crowd of different segments: those are cut into
    single windows, dealt by window, and their hits put back to the segments."""
    calm = segs.join(crowded, "anchor", "left_anti")
    step = WORD_BYTES
    singles = (segs.join(crowded, "anchor", "left_semi")
               .select("mult", *[c.alias(n) for c, n in zip((F.xxhash64("seg"), F.xxhash64(F.col("seg"), F.lit(1))),
                                                            ("s1", "s2"))],
                       "seg", F.explode(F.expr(f"sequence(0, octet_length(seg) div {step} - {window})")).alias("at"))
               .select("mult", "s1", "s2", "at", F.expr(f"substring(seg, at * {step} + 1, {window * step})").alias("seg")))
    own = singles.groupBy("seg").agg(F.sum("mult").alias("mult")).withColumn("anchor", F.xxhash64("seg"))
    both = written(calm.select("anchor", "seg", "mult").unionByName(own.select("anchor", "seg", "mult")), "split")
    hits = written(repeated_intervals(both, window, _shards(both, shard_words)), "hits")
    back = (singles.select("s1", "s2", "at", *_digest("seg")).join(hits, ["d1", "d2"], "left_semi")
            .groupBy(F.col("s1").alias("d1"), F.col("s2").alias("d2"))
            .agg(F.flatten(F.collect_list(F.array(F.col("at"), F.col("at") + window))).alias("hits")))
    return hits.unionByName(back)
