"""Toxicity by compression distance: one zstandard dictionary of toxic text, one of ordinary
text, and windows that compress shorter with the first than with the second.

Training uses a bounded sample of labelled rows (``SAMPLE`` of each class, by hash), whole
texts. Half of it makes the dictionaries, the other half calibrates. Dictionaries are
contrastive: from the toxic texts only words holding a character ``GRAM``-gram that is
significantly more frequent there than in the other class are kept, so the dictionaries differ
in what tells the classes apart. (Dictionaries of class texts as they are were tried: see the
README.) A window is one word; it is compressed with a suffix that both dictionaries hold,
because zstandard finds no matches in the last bytes of its input and stores raw what saves too
little. The saved bytes per window are counted per document, and a logistic calibration turns
the counts into a score.

Grams and words are counted, and calibration features made, by Spark; the driver gets the
telling grams, the most frequent words up to a dictionary's size, ``TRAINING`` windows for
zstandard's own selection, and ten numbers per calibration row.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import binary_text, received, send, written
from .logistic import logistic

SAMPLE = 4000
GRAM = 5
#: log of how unlikely a gram's surplus in a class must be (Chernoff bound), and its least ratio
SURPLUS = 14.0
RATIO = 5.0
DICTIONARY = 8192
#: the ordinary dictionary is so many times larger: it explains common words, not classes
ORDINARY = 32
#: eight-word windows of a class, by hash, among which zstandard selects
TRAINING = 50_000
SUFFIX = bytes(range(1, 25))
THRESHOLD = 0.7
#: windows whose saved bytes are remembered in a task
ROOM = 400_000

WORD = re.compile(r"[^\W\d_]+")


def windows(text: str) -> list[str]:
    """Lower-case words with the spaces around them."""
    return WORD.findall(text.lower())


def _grams(word: str) -> list[str]:
    w = f" {word} "
    return [w[i:i + GRAM] for i in range(len(w) - GRAM + 1)]


def _surplus(own: Column, n: int, other: Column, m: int) -> Column:
    """Whether a gram is in significantly more texts of its own class (n texts) than the other
    class (m texts) lets expect."""
    expected = F.lit(float(n)) * (other + 0.5) / F.lit(float(m))
    return (own > RATIO * expected) & (own * F.log(own / expected) - own + expected >= SURPLUS)


def _counts(seen: DataFrame) -> DataFrame:
    """(y, gram, item, n): words with their occurrences, and grams with the texts that hold
    them, per class."""
    def run(batches):
        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), b.column(1)):
                words: dict[str, int] = {}
                for w in windows(t.as_py().decode()):
                    words[w] = words.get(w, 0) + 1
                grams = {g for w in words for g in _grams(w)}
                n = len(words) + len(grams)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([y] * n, pa.int32()), pa.array([False] * len(words) + [True] * len(grams)),
                     pa.array([*words, *grams], pa.string()), pa.array([*words.values(), *[1] * len(grams)], pa.int64())],
                    names=["y", "gram", "item", "n"])

    return (seen.select("y", "t").mapInArrow(run, "y int, gram boolean, item string, n long")
            .groupBy("y", "gram", "item").agg(F.sum("n").alias("n")))


def _telling_words(words: DataFrame, telling: set[str]) -> DataFrame:
    """The words that hold a telling gram; all of them if there is none."""
    if not telling:
        return words

    def run(batches):
        for b in batches:
            yield b.filter(pa.array([any(g in telling for g in _grams(w)) for w in b.column(0).to_pylist()], pa.bool_()))

    return words.mapInArrow(run, "item string, n long")


def _training_windows(seen: DataFrame, telling: set[str]) -> list[bytes]:
    """Eight-word windows of whole texts (of their telling words, if there are such), the
    ``TRAINING`` smallest by hash."""
    def run(batches):
        for b in batches:
            for t in b.column(0):
                words = windows(t.as_py().decode())
                if telling:
                    words = [w for w in words if any(g in telling for g in _grams(w))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f" {' '.join(words[i:i + 8])} " for i in range(0, len(words), 8)], pa.string())], names=["w"])

    rows = seen.select("t").mapInArrow(run, "w string").orderBy(F.xxhash64("w"), "w").limit(TRAINING).collect()
    return [r["w"].encode() for r in rows]


def _dictionary(samples: list[bytes], common: list[str], size: int) -> bytes:
    """Dictionary content of a class: zstandard's selection where it has enough samples, then
    the most frequent words, the commonest last, where matches cost least."""
    try:
        trained = zstandard.train_dictionary(size // 2, samples, k=32, d=6).as_bytes()[-size // 2:]
    except zstandard.ZstdError:
        trained = b""
    words = b""
    for w in common:
        if len(words) + len(w.encode()) + 1 > size // 2:
            break
        words = w.encode() + b" " + words
    return trained + b" " + words


class Distance:
    """Saved bytes of a window: ordinary minus toxic compressed length."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.compressors = [self._compressor(ordinary), self._compressor(toxic)]
        self.saved: dict[str, int] = {}

    @staticmethod
    def _compressor(content: bytes):
        how = zstandard.ZstdCompressionParameters.from_level(
            3, min_match=5, search_log=6, strategy=zstandard.STRATEGY_BTLAZY2, write_content_size=False,
            write_checksum=False, write_dict_id=False)
        held = zstandard.ZstdCompressionDict(content + SUFFIX, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return zstandard.ZstdCompressor(compression_params=how, dict_data=held)

    def __call__(self, word: str) -> int:
        raw = f" {word} ".encode() + SUFFIX
        ordinary, toxic = (len(c.compress(raw)) for c in self.compressors)
        return ordinary - toxic

    def features(self, text: str) -> list[float]:
        words = windows(text)
        if len(self.saved) > ROOM:
            self.saved.clear()
        for w in set(words).difference(self.saved):
            self.saved[w] = self(w)
        d = np.fromiter(map(self.saved.__getitem__, words), np.int64, len(words))
        n = max(len(d), 1)
        top = np.sort(d)[::-1][:3] if len(d) else np.zeros(1)
        return [*(math.log1p(int((d >= k).sum())) for k in (1, 2, 3)), *(float((d >= k).sum()) / n for k in (2, 3)),
                float(top[0]), float(top.mean()), float(d.sum()) / n, math.log1p(n)]


class Model:
    """Dictionaries (ordinary, toxic) and calibration. Without them the score is the label rate."""

    def __init__(self, rate: float, content: list[bytes] | None = None, fit=None):
        self.rate, self.content, self.fit = rate, content, fit
        self.distance = Distance(content[1], content[0]) if content else None

    def __getstate__(self):  # compressors don't travel; tasks make their own
        return {"rate": self.rate, "content": self.content, "fit": self.fit}

    def __setstate__(self, state):
        self.__init__(**state)

    def score(self, texts: Iterable[str]) -> np.ndarray:
        if self.fit is None:
            return np.array([self.rate for _ in texts])
        mean, scale, w = self.fit
        x = (np.array([self.distance.features(t) for t in texts]) - mean) / scale
        return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
          usable: Column | None = None, sample: int = SAMPLE, size: int = DICTIONARY) -> Model:
    """Model from at most ``sample`` labelled rows of each class (smallest hashes of the key).
    Only rows whose key meets ``usable`` are seen.

    Labels other than 0 and 1, null ones and null keys are left out, repeated ones count once;
    a key with both labels counts in both classes, and rows that repeat a key count each. Null
    texts count as empty. With fewer than four rows of a class the score is the label rate.
    """
    marked = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull())
    if usable is not None:
        marked = marked.where(usable)
    marked = marked.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).distinct()
    few = [marked.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(sample) for y in (0, 1)]
    turn = F.row_number().over(Window.partitionBy("y").orderBy(F.xxhash64("k"), "k"))  # of the sample only
    few = few[0].unionByName(few[1]).withColumn("half", turn % 2)
    texts = docs.select(F.col(key).alias("k"), binary_text(text).alias("t"))
    seen = written(texts.join(F.broadcast(few), "k").select("y", "half", "t"), "labelled")
    sizes = {(r["y"], r["half"]): r["n"] for r in seen.groupBy("y", "half").agg(F.count("*").alias("n")).collect()}
    total = [sizes.get((y, 0), 0) + sizes.get((y, 1), 0) for y in (0, 1)]
    rate = total[1] / sum(total) if sum(total) else 0.0
    if min(total) < 4 or len(sizes) < 4:
        return Model(rate)
    base = seen.where("half = 1")
    counts = written(_counts(base), "counts")
    of = lambda y: F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0)).cast("double")
    grams = counts.where("gram").groupBy("item").agg(of(1).alias("own"), of(0).alias("other"))
    telling = {r["item"] for r in grams.where(_surplus(F.col("own"), sizes[1, 1], F.col("other"), sizes[0, 1])).collect()}
    content = []
    for y, want, room in ((0, set(), ORDINARY * size), (1, telling, size)):
        words = _telling_words(counts.where(~F.col("gram") & (F.col("y") == y)).select("item", "n"), want)
        common = words.orderBy(F.col("n").desc(), "item").limit(room // 4).collect()  # a word takes two bytes or more
        content.append(_dictionary(_training_windows(base.where(F.col("y") == y), want), [r["item"] for r in common], room))
    model = Model(rate, content)
    sent = send(docs.sparkSession, model)

    def run(batches):
        own = received(sent)
        for b in batches:
            xs = [own.distance.features(t.as_py().decode()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(xs, pa.list_(pa.float64()))], names=["y", "x"])

    rows = seen.where("half = 0").select("y", "t").mapInArrow(run, "y int, x array<double>").collect()
    rows = sorted((r["y"], tuple(r["x"])) for r in rows)  # one order, whatever the partitions
    return Model(rate, content, logistic(np.array([x for _, x in rows]), np.array([float(y) for y, _ in rows])))


def toxicity(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text",
             threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) of every row; whole texts, null counts as empty. Labels,
    keys and other columns are no inputs. Repeated rows score alike; empty input, no rows."""
    sent = send(docs.sparkSession, model)  # two dictionaries and ten numbers

    def run(batches):
        own = received(sent)
        for b in batches:
            if not b.num_rows:
                continue
            score = own.score(t.as_py().decode() for t in b.column(1))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                names=["doc_id", "score", "predicted"])

    rows = docs.select(F.col(key).alias("doc_id"), binary_text(text).alias("t"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, score double, predicted int")
