"""Best-fit packing of tokenized documents by a grouping genetic algorithm on islands.

Documents become token pieces; pieces are dealt to shards of about ``SHARD`` pieces, and each
shard is one bin-packing problem. Its islands start from best-fit packings in different
orders. A crossover injects whole well-filled bins of one parent into another, removes bins
that then hold duplicates, and best-fits the displaced pieces, largest first. Between epochs
every island's elite migrates to the next island of the ring (a join on shard and island).
A shard whose packing reaches the lower bound is finished and evolves no further. Bins left
poorly filled are opened and their pieces dealt to new shards, until one shard holds them or
a round saves nothing.
"""

from __future__ import annotations

import re
import sys
import types
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_text, ragged, slices, written

CAPACITY = 4096
SHARD = 4096
ISLANDS = 3
POPULATION = 4
EPOCHS = 2
GENERATIONS = 6
#: a bin filled below this share of the capacity is opened again in the next round
REOPEN = 0.99
ROUNDS = 4


class WordTokenizer:
    """Ids of whole texts by a tokenizer that parts words at white space, lower-cases, and
    never joins letters or digits with other characters, but joins any run of those.

    A distinct white-space word is looked up, not encoded again. A new one is lowered and
    parted behind its last letter, digit or space into a base and a tail, and bases and tails
    not met before are encoded in bulk, set apart by the marker ``0`` whose id is known. Words
    outside Latin letters, and words that hold the marker or may hold a special token, go
    through the tokenizer as they are.
    """

    MARK = "0"
    ODD = re.compile("[^\x00-\u024f]|0|<[|]")
    #: what a tail is made of: neither letter, digit nor Unicode white space (U+001C to U+001F are
    #: none); lower-casing makes U+0307 of the dotted capital I
    TAIL = "".join(c for c in map(chr, range(0x250)) if not c.isalnum() and c not in "\t\n\v\f\r \x85\xa0") + "\u0307"

    def __init__(self, spec: str, room: int = 600_000):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(spec)
        self.lowered = Tokenizer.from_str(spec)
        self.lowered.normalizer = None  # its input is lowered, and Latin letters are composed
        (self.mark,) = self.whole.encode(self.MARK, add_special_tokens=False).ids
        self.room = room
        self.forget()

    @classmethod
    def of_worker(cls, spec: str) -> WordTokenizer:
        """The worker process's tokenizer, parsed once; its words go with the task
        (:meth:`forget`), so an idle worker holds little."""
        kept = sys.modules.setdefault("_word_tokenizers", types.ModuleType("_word_tokenizers")).__dict__
        if spec not in kept:
            kept[spec] = cls(spec)
        return kept[spec]

    def forget(self):
        none = np.zeros(0, np.int64)
        self.words, self.parts = {}, {}
        self.word_at, self.part_at = (none, none, none.astype(np.uint32)), (none, none, none.astype(np.uint32))

    @staticmethod
    def _encode(tokenizer, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def _append(index: dict, at: tuple, keys: list[str], lengths: np.ndarray, ids: np.ndarray) -> tuple:
        index.update(zip(keys, range(len(index), len(index) + len(keys))))
        starts = len(at[2]) + np.cumsum(lengths) - lengths
        return tuple(np.concatenate(x) for x in zip(at, (starts, lengths, ids)))

    def _learn_parts(self, parts: list[str]):
        lengths, pools, keys, alone = [], [], [], []
        for k in range(0, len(parts), 4000):
            some = parts[k:k + 4000]
            ids = self._encode(self.lowered, [f" {self.MARK} ".join(some)])[0]
            cut = np.flatnonzero(ids == self.mark)
            if len(cut) != len(some) - 1:  # a part gave the marker itself: one by one
                alone += some
                continue
            bounds = np.concatenate(([-1], cut, [len(ids)]))
            lengths.append(np.diff(bounds) - 1)
            pools.append(ids[ids != self.mark])
            keys += some
        for part, ids in zip(alone, self._encode(self.lowered, alone) if alone else []):
            lengths.append(np.array([len(ids)]))
            pools.append(ids)
            keys.append(part)
        if keys:
            self.part_at = self._append(self.parts, self.part_at, keys, np.concatenate(lengths), np.concatenate(pools))

    def _learn(self, words: list[str]):
        odd = self.ODD.search
        direct, plain = [], []
        for w in words:
            (direct if odd(w) else plain).append(w)
        low = [w.lower() for w in plain]
        base = [w.rstrip(self.TAIL) for w in low]
        tail = [w[len(b):] for w, b in zip(low, base)]
        fresh = set(base).union(tail).difference(self.parts)
        if fresh:
            self._learn_parts(list(fresh))
        pair = np.empty(2 * len(plain), np.int64)
        pair[::2] = np.fromiter(map(self.parts.__getitem__, base), np.int64, len(plain))
        pair[1::2] = np.fromiter(map(self.parts.__getitem__, tail), np.int64, len(plain))
        starts, lengths, pool = self.part_at
        ids = pool[ragged(starts[pair], lengths[pair])]
        own = lengths[pair[::2]] + lengths[pair[1::2]]
        self.word_at = self._append(self.words, self.word_at, plain, own, ids)
        if direct:
            ids = self._encode(self.whole, direct)
            self.word_at = self._append(self.words, self.word_at, direct, np.array([len(i) for i in ids]),
                                        np.concatenate(ids))

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one text after the other, and where each text ends; a text's ids
        are those the tokenizer gives for the whole text."""
        split = pa.compute.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.words) > self.room:
            self.forget()
        fresh = [w for w in words if w not in self.words]
        if fresh:
            self._learn(fresh)
        number = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        at = number[coded.indices.to_numpy(zero_copy_only=False)]
        starts, lengths, pool = self.word_at
        sizes = lengths[at]
        total = np.concatenate(([0], np.cumsum(sizes)))
        offsets = split.offsets.to_numpy()
        return pool[ragged(starts[at], sizes)], total[offsets[1:] - offsets[0]]


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text",
           capacity: int = CAPACITY, end_id: int = 1, tokens: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, idx) and, if asked for, tokens: the ids of
    each row's text and the end id, cut into pieces of at most ``capacity``. Null text is
    empty: one piece with the end id. (part, idx) names a piece; write the frame before using
    it twice."""
    with open(tokenizer, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary: 1-2 MB

    def run(batches):
        tok = WordTokenizer.of_worker(spec.value)
        try:
            yield from cut(tok, batches)
        finally:
            tok.forget()

    def cut(tok, batches):
        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            keys, texts = b.column(0), b.column(1).cast(pa.string())
            for lo, hi in slices((pa.compute.binary_length(b.column(1)).to_numpy() + 1).tolist(), 8 << 20):
                row, piece, start, length, crc, held = [], [], [], [], [], []
                flat, ends = tok.ids(texts.slice(lo, hi - lo))
                flat = np.insert(flat, ends, end_id).astype("<u4")
                ends = (ends + np.arange(1, len(ends) + 1)).tolist()
                for i, (begin, end) in enumerate(zip([0, *ends], ends), lo):
                    ids = flat[begin:end]
                    for k, s in enumerate(range(0, len(ids), capacity)):
                        own = ids[s:s + capacity]
                        row.append(i)
                        piece.append(k)
                        start.append(s)
                        length.append(len(own))
                        crc.append(zlib.crc32(own.tobytes()))
                        if tokens:
                            held.append(own.astype(np.int32))
                m = len(row)
                columns = [keys.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                           pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([part] * m, pa.int32()),
                           pa.array(range(n, n + m), pa.int64())]
                if tokens:
                    bounds = np.concatenate(([0], np.cumsum(length))).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(held))))
                yield pa.RecordBatch.from_arrays(columns, names=names)
                n += m

    rows = docs.select(F.col(key).alias("doc_id"), binary_text(text).alias("t"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, idx long"
    schema += ", tokens array<int>" if tokens else ""
    names = [c.split()[0] for c in schema.split(", ")]
    return rows.mapInArrow(run, schema)


class OpenBins:
    """Room of open bins: a bitmap of the rooms in use finds the tightest bin in one step."""

    def __init__(self, room: np.ndarray):
        self.room = room.tolist()
        self.at: dict[int, list[int]] = {}
        self.bits = 0
        for b, r in enumerate(self.room):
            if r > 0:
                self.at.setdefault(r, []).append(b)
        for r in self.at:
            self.bits |= 1 << r

    def put(self, size: int, capacity: int) -> int:
        """Place one piece into the bin it fits best, else into a new one; the bin."""
        fit = self.bits >> size
        if fit:
            r = size + (fit & -fit).bit_length() - 1
            same = self.at[r]
            b = same.pop()
            if not same:
                self.bits ^= 1 << r
        else:
            r, b = capacity, len(self.room)
            self.room.append(capacity)
        self.room[b] = left = r - size
        if left:
            self.at.setdefault(left, []).append(b)
            self.bits |= 1 << left
        return b


def best_fit(sizes: np.ndarray, order: np.ndarray, capacity: int, bins: np.ndarray | None = None,
             room: np.ndarray | None = None) -> np.ndarray:
    """Best-fit of the pieces in ``order``; the others keep their ``bins`` (room: of those)."""
    out = np.full(len(sizes), -1, np.int64) if bins is None else bins
    holes = OpenBins(np.zeros(0, np.int64) if room is None else room)
    out[order] = [holes.put(s, capacity) for s in sizes[order].tolist()]
    return np.unique(out, return_inverse=True)[1]


def fitness(sizes: np.ndarray, bins: np.ndarray, capacity: int) -> tuple[int, float]:
    """(fewer bins, then fuller ones): larger is better."""
    fill = np.bincount(bins, sizes) / capacity
    return -len(fill), float((fill ** 2).mean())


def crossover(sizes: np.ndarray, a: np.ndarray, b: np.ndarray, capacity: int, rng) -> np.ndarray:
    """A child of ``a`` with whole well-filled bins of ``b``; duplicates' bins are emptied."""
    fill = np.bincount(b, sizes) / capacity
    chosen = rng.random(len(fill)) < 0.3 * fill ** 8
    injected = chosen[b]
    broken = np.zeros(a.max() + 1, bool)
    broken[a[injected]] = True
    worst = np.bincount(a, sizes)  # and the emptiest bins are opened with them (mutation)
    broken[np.argsort(worst, kind="stable")[:max(1, len(worst) // 50)]] = True
    child = np.where(injected, b + len(broken), a)
    displaced = ~injected & broken[a]
    child[displaced] = -1
    kept, child_kept = np.unique(child[~displaced], return_inverse=True)
    child[~displaced] = child_kept
    room = capacity - np.bincount(child_kept, sizes[~displaced], minlength=len(kept)).astype(np.int64)
    order = np.flatnonzero(displaced)
    return best_fit(sizes, order[np.argsort(-sizes[order], kind="stable")], capacity, child, room)


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    return max(-(-int(sizes.sum()) // capacity), int((2 * sizes > capacity).sum()))


def start_population(sizes: np.ndarray, capacity: int, rng, population: int = POPULATION) -> list[np.ndarray]:
    """Best-fit decreasing, then best-fit of disturbed orders."""
    out = [best_fit(sizes, np.argsort(-sizes, kind="stable"), capacity)]
    for k in range(1, population):
        noisy = sizes * rng.uniform(1 - 0.1 * k, 1 + 0.1 * k, len(sizes))
        out.append(best_fit(sizes, np.argsort(-noisy, kind="stable"), capacity))
    return out


def evolve(sizes: np.ndarray, pop: list[np.ndarray], capacity: int, rng, generations: int = GENERATIONS):
    """Some generations of one island: a child of two parents replaces the worst if better."""
    scored = sorted(((fitness(sizes, p, capacity), i, p) for i, p in enumerate(pop)), key=lambda x: x[:2], reverse=True)
    best = -lower_bound(sizes, capacity)
    for g in range(generations):
        if scored[0][0][0] >= best:
            break
        for _ in range(len(scored)):
            i, j = rng.choice(len(scored), 2, replace=False)
            child = crossover(sizes, scored[i][2], scored[j][2], capacity, rng)
            f = fitness(sizes, child, capacity)
            if f > scored[-1][0]:
                scored[-1] = (f, -g, child)
                scored.sort(key=lambda x: x[:2], reverse=True)
    return [s[2] for s in scored]


_STATE = ("shard long, island int, done boolean, part array<int>, idx array<long>, sizes array<int>, "
          "pop array<int>, n_bins long, fit double")


def _state(shard, island, part, idx, sizes, pop, capacity):
    n, f = fitness(sizes, pop[0], capacity)
    return {"shard": shard, "island": island, "done": -n <= lower_bound(sizes, capacity), "part": part, "idx": idx,
            "sizes": sizes.astype(np.int32), "pop": np.concatenate(pop).astype(np.int32), "n_bins": -n, "fit": f}


def pack_shards(items: DataFrame, n_shards: int, salt: int, capacity: int = CAPACITY, islands: int = ISLANDS,
                epochs: int = EPOCHS, name: str = "pack") -> DataFrame:
    """Packs ``items(part, idx, length)``: (part, idx, length, shard, bin, offset, fill).
    One group holds one shard, about ``SHARD`` pieces by hash, whatever their documents."""
    def start(pdf):
        pdf = pdf.sort_values(["length", "part", "idx"], ascending=[False, True, True])
        shard, sizes = int(pdf["shard"].iloc[0]), pdf["length"].to_numpy(np.int64)
        part, idx = pdf["part"].to_numpy(np.int32), pdf["idx"].to_numpy(np.int64)
        first = best_fit(sizes, np.arange(len(sizes)), capacity)
        if -fitness(sizes, first, capacity)[0] <= lower_bound(sizes, capacity):
            return pd.DataFrame([_state(shard, 0, part, idx, sizes, [first], capacity)])
        return pd.DataFrame([
            _state(shard, i, part, idx, sizes,
                   start_population(sizes, capacity, np.random.default_rng([salt, shard, i])), capacity)
            for i in range(islands)])

    state = written(items.select("part", "idx", "length",
                                 F.pmod(F.xxhash64("part", "idx", F.lit(salt)), F.lit(n_shards)).alias("shard"))
                    .groupBy("shard").applyInPandas(start, _STATE), name)

    def epoch(k):
        def run(frames):
            for pdf in frames:
                rows = []
                for r in pdf.itertuples(index=False):
                    sizes = np.asarray(r.sizes, np.int64)
                    pop = list(np.asarray(r.pop, np.int64).reshape(-1, len(sizes)))
                    if r.elite is not None:
                        pop[-1] = np.asarray(r.elite, np.int64)
                    pop = evolve(sizes, pop, capacity, np.random.default_rng([salt, r.shard, r.island, k]))
                    rows.append(_state(r.shard, r.island, r.part, r.idx, sizes, pop, capacity))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in _STATE.split(", ")])
        return run

    done = state.where("done")
    active = state.where("not done")
    for k in range(epochs):
        if active.isEmpty():
            break
        elite = active.select("shard", ((F.col("island") + 1) % islands).alias("island"),
                              F.slice("pop", F.lit(1), F.size("sizes")).alias("elite"))
        if k == 0:
            elite = elite.withColumn("elite", F.lit(None).cast("array<int>"))
        active = written(active.join(elite, ["shard", "island"], "left").mapInPandas(epoch(k), _STATE), name)
    best = (done.unionByName(active).groupBy("shard")
            .agg(F.max_by(F.struct("part", "idx", "sizes", "pop"),
                          F.struct(-F.col("n_bins"), "fit", -F.col("island"))).alias("s")).select("shard", "s.*"))

    def lay_out(frames):
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                sizes = np.asarray(r.sizes, np.int64)
                bins = np.asarray(r.pop, np.int64)[:len(sizes)]
                order = np.argsort(bins, kind="stable")
                s, b = sizes[order], bins[order]
                total = np.concatenate(([0], np.cumsum(s)))
                head = np.concatenate(([True], b[1:] != b[:-1]))
                offset = total[:-1] - np.maximum.accumulate(np.where(head, total[:-1], 0))
                yield pd.DataFrame({"part": np.asarray(r.part)[order], "idx": np.asarray(r.idx)[order], "length": s,
                                    "shard": r.shard, "bin": b, "offset": offset,
                                    "fill": np.bincount(bins, sizes).astype(np.int64)[b]})

    return written(best.mapInPandas(lay_out, "part int, idx long, length long, shard long, bin long, "
                                             "offset long, fill long"), name)


def pack(items: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, rounds: int = ROUNDS) -> DataFrame:
    """(part, idx, sequence_id, offset) of every row of ``items(part, idx, length)``, which
    must be a written frame. Full pieces are sequences of their own; the rest is packed.
    Empty input gives no rows; ties are broken by (part, idx), so a rerun packs alike."""
    full = items.where(F.col("length") >= capacity).select(
        "part", "idx", (-F.lit(1) - (F.col("part").cast("long") * F.lit(1 << 40) + F.col("idx"))).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"))
    placed = full
    todo = items.where(F.col("length") < capacity).select("part", "idx", "length")
    n = todo.count()
    kept = None  # packings of the round before, for the pieces in todo
    for r in range(rounds):
        if not n:
            break
        n_shards = -(-n // shard)
        got = pack_shards(todo, n_shards, r, capacity)
        ids = got.withColumn("sequence_id", F.lit(r << 56) + F.col("shard") * F.lit(1 << 24) + F.col("bin"))
        if kept is not None:
            before = kept.agg(F.countDistinct("sequence_id")).first()[0]
            if ids.agg(F.countDistinct("sequence_id")).first()[0] >= before:
                break
        last = n_shards == 1 or r == rounds - 1
        sure = F.lit(True) if last else F.col("fill") >= REOPEN * capacity
        placed = placed.unionByName(ids.where(sure).select("part", "idx", "sequence_id", "offset"))
        kept = None if last else ids.where(~sure)
        if last:
            break
        todo = kept.select("part", "idx", "length")
        n = todo.count()
    if kept is not None:
        placed = placed.unionByName(kept.select("part", "idx", "sequence_id", "offset"))
    return placed


def pack_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text",
                   capacity: int = CAPACITY, end_id: int = 1, tokens: bool = False) -> DataFrame:
    """Every piece of every document with its place: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset, and its ``tokens`` if asked for. Repeated rows are packed each;
    null text packs the end id alone; other columns are ignored."""
    cut = written(pieces(docs, tokenizer, key, text, capacity, end_id, tokens), "pieces")
    place = pack(cut.select("part", "idx", "length"), capacity)
    return cut.join(place, ["part", "idx"]).drop("part", "idx")
