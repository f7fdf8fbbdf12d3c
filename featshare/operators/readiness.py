"""Readiness from status logs instead of sleep-and-poll loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featshare.functions.states import state_class

DECIDING = ("ready", "failed")

_EPOCH_NTZ = "timestamp_ntz'1970-01-01 00:00:00'"


def to_micros(c: Column, dtype) -> Column:
    """Microseconds since the epoch, without a time zone step for timestamp_ntz."""
    if isinstance(dtype, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH_NTZ), c)
    return F.unix_micros(c)


def from_micros(c: Column, dtype) -> Column:
    if isinstance(dtype, T.TimestampNTZType):
        return F.timestamp_add("MICROSECOND", c, F.expr(_EPOCH_NTZ))
    return F.timestamp_micros(c)


def classify(status_events: DataFrame, kind: str = "online_table", state_cols=("state",),
             compat: bool = False) -> DataFrame:
    """Add ``state_class`` (C6) to a status log."""
    return status_events.withColumn("state_class", state_class(kind, *state_cols, compat=compat))


def readiness(status_events: DataFrame, timeout_s: int, start=None, kind: str = "online_table",
              state_cols=("state",), object_col: str = "object_name", ts_col: str = "ts",
              objects: DataFrame | None = None) -> DataFrame:
    """Per object, the first deciding state (ready or failed) within
    ``[start, start + timeout)`` gives the verdict and its time; otherwise ``timeout``.
    ``start`` defaults to each object's first event. Ready is tested before failed.
    ``objects`` (one ``object_name`` column) lists the objects being waited on; those
    without any event in the window get ``timeout`` too.

    One hash aggregation: the earliest deciding event is the ``min`` of one long,
    ``micros(ts) * 2 + rank`` (rank 0 for ready, 1 for failed, so ready wins a tie).
    Fixed-width buffers keep it on HashAggregate with map-side combine, so an object
    with a huge log costs one partial row per map task. If the earliest deciding event
    is past the deadline, so is every other one, hence no second pass is needed.
    """
    dtype = status_events.schema[ts_col].dataType
    ev = classify(status_events, kind, state_cols).select(
        F.col(object_col).alias("object_name"), F.col(ts_col).alias("ts"), "state_class")
    if start is not None:
        ev = ev.where(F.col("ts") >= F.lit(start).cast(dtype))
    rank = F.when(F.col("state_class") == "ready", F.lit(0)).otherwise(F.lit(1)).cast("bigint")
    packed = F.when(F.col("state_class").isin(*DECIDING), to_micros(F.col("ts"), dtype) * 2 + rank)
    agg = ev.groupBy("object_name").agg(F.min("ts").alias("first_seen"), F.min(packed).alias("_p"))
    if objects is not None:
        agg = objects.select("object_name").distinct().join(agg, "object_name", "left")
    d_rank = F.pmod(F.col("_p"), F.lit(2))
    d_ts = from_micros(F.expr("(_p - pmod(_p, 2)) div 2"), dtype)
    d_cls = F.when(d_rank == 0, F.lit("ready")).otherwise(F.lit("failed"))
    begin = F.col("first_seen") if start is None else F.lit(start).cast(dtype)
    deadline = begin + F.expr(f"INTERVAL {int(timeout_s)} SECONDS")
    in_time = F.coalesce(d_ts < deadline, F.lit(False))
    return agg.select(
        "object_name", begin.alias("start_ts"), deadline.alias("deadline"),
        F.when(in_time, d_cls).otherwise(F.lit("timeout")).alias("verdict"),
        F.when(in_time, d_ts).alias("decided_at"))


def poll_samples(status_events: DataFrame, interval_s: int, kind: str = "online_table",
                 object_col: str = "object_name", ts_col: str = "ts", state_col: str = "state") -> DataFrame:
    """The state a poller with period ``interval_s`` would see: the last state in
    each tumbling interval per object, with its class and the number of events."""
    w = F.window(F.col(ts_col), f"{int(interval_s)} seconds")
    g = (status_events.groupBy(F.col(object_col).alias("object_name"), w.alias("w"))
         .agg(F.max_by(F.col(state_col), F.col(ts_col)).alias("state"),
              F.count(F.lit(1)).alias("n_events")))
    return g.select("object_name", F.col("w.start").alias("window_start"), "state",
                    state_class(kind, "state").alias("state_class"), "n_events")


#: intervals of one object that meet in one window
GRID_BLOCK = 1024


def poll_grid(status_events: DataFrame, interval_s: int, kind: str = "online_table", object_col: str = "object_name",
              ts_col: str = "ts", state_col: str = "state", block: int = GRID_BLOCK) -> DataFrame:
    """T2 as a poller sees it: one row per object and interval from its first event to its
    last, intervals without an event included (``n_events`` 0), each with the last state
    reported up to the interval's end.

    The log is aggregated per object and interval first. The time axis is cut into blocks of
    ``block`` intervals: a block's last state is carried over the blocks of an object, and the
    intervals of a block are filled inside it, so no window holds more than ``block`` rows or
    the blocks of one object.
    """
    dtype = status_events.schema[ts_col].dataType
    step = int(interval_s) * 1_000_000
    seen = poll_samples(status_events, interval_s, kind, object_col, ts_col, state_col).select(
        "object_name", (F.floor(to_micros(F.col("window_start"), dtype) / step)).cast("bigint").alias("i"),
        F.struct("state").alias("_s"), "n_events")
    per_block = seen.groupBy("object_name", F.floor(F.col("i") / block).cast("bigint").alias("block")).agg(
        F.max_by("_s", "i").alias("_last"), F.min("i").alias("lo"), F.max("i").alias("hi"))
    ends = per_block.groupBy("object_name").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    blocks = ends.select("object_name", "lo", "hi", F.explode(F.sequence(
        F.floor(F.col("lo") / block).cast("bigint"), F.floor(F.col("hi") / block).cast("bigint"))).alias("block"))
    before = Window.partitionBy("object_name").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (blocks.join(per_block.select("object_name", "block", "_last"), ["object_name", "block"], "left")
              .withColumn("_carried", F.last("_last", ignorenulls=True).over(before)))
    grid = blocks.select("object_name", "block", "_carried", F.explode(F.sequence(
        F.greatest("lo", F.col("block") * block), F.least("hi", F.col("block") * block + (block - 1)))).alias("i"))
    inside = Window.partitionBy("object_name", "block").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    filled = (grid.join(seen, ["object_name", "i"], "left")
              .withColumn("_now", F.coalesce(F.last("_s", ignorenulls=True).over(inside), F.col("_carried"))))
    return filled.select("object_name", from_micros(F.col("i") * step, dtype).alias("window_start"),
                         F.col("_now.state").alias("state"),
                         state_class(kind, F.col("_now.state")).alias("state_class"),
                         F.coalesce("n_events", F.lit(0)).cast("bigint").alias("n_events"))


def publish_rollup(outcomes: DataFrame, readiness_df: DataFrame | None = None, group_cols=()) -> DataFrame:
    """A3: are all tables ready? Counts per outcome; false if any publish failed or (with
    readiness) any table did not reach ready. Grouped by ``group_cols`` if given."""
    o = outcomes
    if readiness_df is not None:
        o = o.join(readiness_df.select(F.col("object_name").alias("online_table_name"), "verdict"),
                   "online_table_name", "left")
        ready = F.col("outcome").isin("published", "exists") & (F.col("verdict") == "ready")
    else:
        ready = F.col("outcome").isin("published", "exists")
    o = o.withColumn("_ready", F.coalesce(ready, F.lit(False)))
    return o.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n_tables"),
        F.count_if(F.col("outcome") == "published").alias("n_published"),
        F.count_if(F.col("outcome") == "exists").alias("n_exists"),
        F.count_if(F.col("outcome") == "failed").alias("n_failed"),
        F.count_if(F.col("_ready")).alias("n_ready"),
        F.bool_and("_ready").alias("all_ready"))
