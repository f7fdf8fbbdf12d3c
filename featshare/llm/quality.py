"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

Evidence of a document: a logistic classifier over character and word statistics of its whole
text, trained on a bounded sample of labelled rows, gives a log likelihood ratio. Prior of a
document: the good rate of its path (a section of a host), shrunk towards its host, which is
shrunk towards all documents. Both shrinkage strengths are estimated from the spread of the
sites' rates (method of moments), by grouped aggregation. A document's own evidence is taken
out of its sites' sums, so it is not counted twice. Posterior odds are prior odds times the
likelihood ratio; sparse sites fall back on the global prior.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binary_text, received, send, written
from .logistic import logistic

SAMPLE = 2000
#: documents with a posterior below this are rejected
THRESHOLD = 0.5
#: bounds of the shrinkage strength, in documents
STRENGTH = (2.0, 1000.0)

_KINDS = ["upper", "lower", "digit", "space", "newline", "stop", "symbol", "other"]


def _kind(byte: int) -> int:
    c = chr(byte)
    if byte >= 128:
        return 7
    if c.isupper():
        return 0
    if c.islower():
        return 1
    if c.isdigit():
        return 2
    if c == "\n":
        return 4
    if c.isspace():
        return 3
    return 5 if c in ".,;:?'\"-()" else 6


CLASS = np.array([_kind(b) for b in range(256)], np.uint8)


def features(text: bytes) -> list[float]:
    """Statistics of a UTF-8 text, all finite; an empty text has zeros."""
    count = np.bincount(CLASS[np.frombuffer(text, np.uint8)], minlength=8).astype(float)
    words = text.split()
    n, size = max(len(words), 1), max(len(text), 1)
    letters = max(count[0] + count[1] + count[7], 1.0)
    distinct = len(set(words))
    again = sum(map(bytes.__eq__, words[1:], words))
    alone = sum(1 for w in words if len(w) == 1 and not w.isalnum())
    return [math.log1p(len(words)), count[0] / letters, count[2] / size, 10 * count[5] / size, 10 * count[6] / size,
            min(10 * count[6] / size, 0.3), count[7] / size, 10 * count[4] / size, distinct / n, math.log1p(n / max(distinct, 1)),
            again / n, min(again / n, 0.05), alone / n, min(alone / n, 0.05), len(text) / n / 10]


class Model:
    """Log likelihood ratio of good against bad (zero without both classes), and the rate of
    good rows among all labels, which the sample of each class does not show."""

    def __init__(self, rows: list[tuple[list[float], int]], rate: float | None = None):
        y = np.array([k for _, k in rows], float)
        self.rate = rate if rate is not None else float(y.mean()) if len(y) else 0.5
        self.fit = None
        if 0 < y.sum() < len(y):
            self.fit = logistic(np.array([x for x, _ in rows]), y)
            self.base = math.log(y.sum() / (len(y) - y.sum()))

    def evidence(self, texts: Iterable[bytes]) -> np.ndarray:
        x = np.array([features(t) for t in texts])
        if self.fit is None or not len(x):
            return np.zeros(len(x))
        mean, scale, w = self.fit
        x = (x - mean) / scale
        return np.clip(x @ w[:-1] + w[-1], -20, 20) - self.base


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
          usable: Column | None = None, sample: int = SAMPLE) -> Model:
    """Model from at most ``sample`` labelled rows of each class (smallest hashes of the key);
    only rows whose key meets ``usable`` are seen. Features of their whole texts are made in
    tasks; the driver gets those numbers only, at most one row per sampled key and text.

    Labels other than 0 and 1, null ones and null keys are left out, repeated ones count once;
    a key with both labels counts in both classes. Without both classes there is no evidence.
    """
    marked = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull())
    if usable is not None:
        marked = marked.where(usable)
    marked = marked.select(F.col(key).alias("k"), F.col(label).alias("y")).distinct()
    rate = marked.agg(F.avg("y")).first()[0]
    few = [marked.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(sample) for y in (0, 1)]
    few = few[0].unionByName(few[1])
    texts = docs.select(F.col(key).alias("k"), binary_text(text).alias("t"))
    seen = texts.join(F.broadcast(few), "k").select("k", F.col("y").cast("int").alias("y"), "t")

    def run(batches):
        for b in batches:
            xs = [features(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(xs, pa.list_(pa.float64()))],
                                             names=["k", "y", "x"])

    kind = seen.schema["k"].dataType.simpleString()
    rows = seen.mapInArrow(run, f"k {kind}, y int, x array<double>").distinct().collect()
    rows = sorted((r["k"], r["y"], tuple(r["x"])) for r in rows)  # one order, whatever the partitions
    return Model([(list(x), y) for _, y, x in rows], rate)


def score(docs: DataFrame, model: Model, key: str, text: str, host: Column, path: Column) -> DataFrame:
    """(doc_id, host, path, evidence) per row."""
    sent = send(docs.sparkSession, model)

    def run(batches):
        own = received(sent)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(own.evidence(t.as_py() for t in b.column(3)))],
                                             names=["doc_id", "host", "path", "evidence"])

    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(host.cast("string"), F.lit("")).alias("host"),
                       F.coalesce(path.cast("string"), F.lit("")).alias("path"), binary_text(text).alias("t"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, host string, path string, evidence double")


def _sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def _logit(p: Column) -> Column:
    return F.log(p / (F.lit(1.0) - p))


def _strength(sites: DataFrame, mean: Column) -> float:
    """Shrinkage strength by moments: how many documents a prior is worth, from the spread of
    site rates around their prior mean beyond what chance gives. One row reaches the driver."""
    rate = F.col("s") / F.col("n")
    row = sites.where("n >= 2").agg(
        F.sum(F.col("n") * (rate - mean) * (rate - mean)).alias("spread"), F.sum(mean * (1 - mean)).alias("chance"),
        F.sum(F.col("n") * mean * (1 - mean)).alias("weight")).first()
    if not row["weight"]:
        return STRENGTH[1]
    # E[spread] = chance + (weight - chance) / (strength + 1)
    beyond = (row["spread"] - row["chance"]) / max(row["weight"] - row["chance"], 1e-9)
    return min(max(1 / beyond - 1, STRENGTH[0]), STRENGTH[1]) if beyond > 0 else STRENGTH[1]


def quality(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", host: str = "source",
            path: str = "lang", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, host, path, evidence, host_rate, path_rate (the
    document's shrunk priors), posterior and kept.

    Null text counts as empty; null hosts and paths are a site of their own, the empty name.
    Repeated rows are documents of their own. Empty input gives no rows; other columns are
    ignored. One host may hold any share of the rows: sites are aggregated map-side first,
    and their rows are joined back by a join that AQE can split.
    """
    rows = written(score(docs, model, key, text, F.col(host), F.col(path)), "evidence")
    prior = math.log(max(model.rate, 1e-6) / max(1 - model.rate, 1e-6))
    rows = rows.withColumn("p", _sigmoid(F.col("evidence") + prior))
    paths = written(rows.groupBy("host", "path").agg(F.sum("p").alias("s"), F.count("*").alias("n")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("s").alias("hs"), F.sum("n").alias("hn"))
    total = paths.agg(F.sum("s"), F.sum("n")).first()
    rate = min(max((total[0] + 1) / (total[1] + 2), 1e-6), 1 - 1e-6) if total[1] else 0.5
    k_host = _strength(hosts.select(F.col("hs").alias("s"), F.col("hn").alias("n")), F.lit(rate))
    above = F.least(F.greatest((F.col("hs") + k_host * rate) / (F.col("hn") + k_host), F.lit(1e-6)), F.lit(1 - 1e-6))
    sites = paths.join(hosts, "host")
    k_path = _strength(sites.select("s", "n", above.alias("m")), F.col("m"))
    # the document itself is taken out of its host's and path's sums
    host_rate = (F.col("hs") - F.col("p") + k_host * rate) / (F.col("hn") - 1 + k_host)
    path_rate = (F.col("s") - F.col("p") + k_path * F.col("host_rate")) / (F.col("n") - 1 + k_path)
    bound = (F.lit(1e-6), F.lit(1 - 1e-6))
    return (rows.join(sites, ["host", "path"])
            .withColumn("host_rate", F.least(F.greatest(host_rate, bound[0]), bound[1]))
            .withColumn("path_rate", F.least(F.greatest(path_rate, bound[0]), bound[1]))
            .withColumn("posterior", _sigmoid(_logit(F.col("path_rate")) + F.col("evidence")))
            .select("doc_id", "host", "path", "evidence", "host_rate", "path_rate", "posterior",
                    (F.col("posterior") >= threshold).alias("kept")))


def keep_good(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", host: str = "source",
              path: str = "lang", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rejected rows, all columns as they are. Rows that repeat a key are
    judged together and go if all of them are rejected; null keys are kept."""
    judged = (quality(docs, model, key, text, host, path, threshold).groupBy("doc_id")
              .agg(F.bool_or("kept").alias("kept")).where("not kept").select(F.col("doc_id").alias("__key")))
    return docs.join(judged, docs[key] == judged["__key"], "left_anti")
