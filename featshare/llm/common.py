"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featshare.session import materialize

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: bytes.translate table: A-Z to a-z, every other byte unchanged (safe on UTF-8)
ASCII_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Spark drops a query's shuffle files when it ends instead of when the driver collects garbage
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame written once to the shared folder and read back: cuts lineage, and a
    lost executor doesn't make the work before it run again. The shuffle files behind it
    go as soon as it is written."""
    conf, before = df.sparkSession.conf, {}
    for setting, value in ((SHUFFLE_CLEANUP, "true"), ("spark.sql.parquet.compression.codec", "zstd")):
        before[setting] = conf.get(setting, None)
        conf.set(setting, value)
    try:
        return materialize(df, f"llm-{name}")
    finally:
        for setting, value in before.items():
            conf.unset(setting) if value is None else conf.set(setting, value)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Text without other letters takes the fast built-in."""
    return (F.when(F.octet_length(text) == F.char_length(text), F.lower(text))
            .otherwise(F.translate(text, UPPER, UPPER.lower())))


def binary_text(col: str) -> Column:
    """A text column as UTF-8 bytes for Arrow tasks; null counts as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")


def send(spark: SparkSession, value):
    """Broadcast an object of this subpackage by value, classes included (bounded by the caller)."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(sent):
    """The object behind :func:`send`, made anew for a task."""
    return cloudpickle.loads(sent.value)


def slices(sizes: list[int], limit: int):
    """Cut consecutive items into runs of about ``limit`` in sum: (start, stop) pairs."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def text_slices(texts: pa.Array, limit: int):
    """Runs of about ``limit`` bytes of a binary column: (first row, list of its texts). Only one
    run at a time is held as Python objects."""
    sizes = pa.compute.binary_length(texts).to_numpy(zero_copy_only=False) + 1
    for lo, hi in slices(sizes.tolist(), limit):
        yield lo, texts.slice(lo, hi - lo).to_pylist()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of every run, one run after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of ``edges(a long, b long)``: one row (node, root) per node
    that has an edge, root the smallest node reachable.

    Alternating large-star and small-star steps, each an aggregation and a join whose hot
    side AQE can split; every round is written to the shared folder, so the plan does not
    grow and nothing about the graph reaches the driver but one checksum per round.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"),
                                             F.least("a", "b").alias("v")).distinct(), name)
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(
            F.explode(F.array(F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")),
                              F.struct("u", F.col("m").alias("v")))).alias("x"))
            .select("x.*").where("u <> v").distinct())
        e = written(small, name)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    return (e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
            .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
