"""Registered streaming queries (T3-T5) and their oracles.

Each reads the given ``events`` parquet in place as a file stream under
``trigger(availableNow=True)``, writes to a file sink or ``foreachBatch`` in the shared work
folder, and returns what it wrote, read back as a batch frame. No server and no port are
involved.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featshare.operators.changes import snapshot_as_of
from featshare.operators.training import score_batch
from featshare.plans.queries_data import OLS_CTES, REQUEST_CTES, SCORED, fitted
from featshare.plans.queries_meta import TIMEOUT_S, _readiness_sql
from featshare.plans.registry import online_table_state_sql, register
from featshare.session import work_dir
from featshare.sources import fs
from featshare.sources.fixtures import DERIVED, base, derived
from featshare.sources.publish import publish_snapshot, read_published
from featshare.streaming.publish_stream import publish_stream
from featshare.streaming.readiness_stream import ROCKSDB, readiness_stream, readiness_stream_from_first
from featshare.streaming.score_stream import score_stream


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table as a stream, read where it is. A file source lists folders: a
    table that is one file is named by a filter on its folder."""
    folder, reader = sf_dir.rstrip("/"), spark.readStream.schema(base(spark, sf_dir, "events").schema)
    if fs.is_dir(spark, f"{folder}/events.parquet"):
        return reader.parquet(f"{folder}/events.parquet")
    return reader.option("pathGlobFilter", "events.parquet").parquet(folder)


def derived_on(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """A derived fixture's SQL applied to a stream of ``events``."""
    view = f"events_stream_{uuid.uuid4().hex[:8]}"
    stream.createOrReplaceTempView(view)
    sql = DERIVED[name][0].replace("from events", f"from {view}")
    return spark.sql(sql)


@contextmanager
def state_store(spark: SparkSession, provider: str):
    """Streams started inside use this state store."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, provider)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def run_to_files(df: DataFrame, name: str) -> str:
    spark = df.sparkSession
    out, ckpt = work_dir(spark, f"{name}-out"), work_dir(spark, f"{name}-ckpt")
    q = (df.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return out


# ---------------------------------------------------------------- T3

T3_START = datetime(2024, 1, 10)
T3_TIMEOUT_S = 2 * 86400
T3_DELAY = "1 hour"
CLOSE_USER = -1


def _t3_oracle_ctes():
    start = T3_START.strftime("%Y-%m-%d %H:%M:%S")
    return {
        "ev": f"""select object_name, ts, {online_table_state_sql('state')} as cls from status_events
                  where ts >= timestamp '{start}'""",
        "objs": "select distinct object_name from ev",
        "dc": f"""select object_name, min(ts) as dts, arg_min(cls, ts) as dcls from ev
                  where cls in ('ready', 'failed')
                    and ts < timestamp '{start}' + interval {T3_TIMEOUT_S} second
                  group by object_name""",
    }


def t3(spark, sf_dir):
    stream = derived_on(spark, closed_events(spark, sf_dir), "status_events")
    verdicts = readiness_stream(stream, T3_TIMEOUT_S, T3_START, T3_DELAY)
    decided = spark.read.parquet(run_to_files(verdicts, "t3"))
    # the objects waited on: those seen since the start; the ones seen too late time out
    waited = derived(spark, sf_dir, "status_events").where(
        F.col("ts") >= F.lit(T3_START).cast("timestamp_ntz")).select("object_name").distinct()
    return waited.join(decided, "object_name", "left").select(
        "object_name", F.coalesce("verdict", F.lit("timeout")).alias("verdict"), "decided_at")


def closed_events(spark, sf_dir):
    """The event stream with an end-of-stream marker that moves the watermark past every deadline."""
    closing = {"event_id": -1, "ts": datetime(2099, 1, 1), "user_id": CLOSE_USER, "event_type": "view",
               "value": 0.0, "props": "{}"}
    end, events = work_dir(spark, "t3-end"), base(spark, sf_dir, "events")
    spark.createDataFrame([closing], events.schema).coalesce(1).write.parquet(end)
    return events_stream(spark, sf_dir).unionByName(spark.readStream.schema(events.schema).parquet(end))


def t3_own_start(spark, sf_dir):
    with state_store(spark, ROCKSDB):
        verdicts = readiness_stream_from_first(derived_on(spark, closed_events(spark, sf_dir), "status_events"), TIMEOUT_S)
        out = spark.read.parquet(run_to_files(verdicts, "t3-own"))
    marker = f"main.default.t{CLOSE_USER}_online"
    return out.where(F.col("object_name") != marker)


# ---------------------------------------------------------------- T4

T4_BUCKET_ROWS = 200


def t4(spark, sf_dir):
    model = fitted(spark, sf_dir)
    gap = derived(spark, sf_dir, "feature_gap")
    requests = derived_on(spark, events_stream(spark, sf_dir), "score_requests")
    scored = score_batch(requests, "body", "k bigint", model, features=gap, lookup_key="k", table_key="id",
                         id_cols=["event_id"])
    out = run_to_files(scored, "t4")
    return spark.read.parquet(out).withColumn("prediction", F.round("prediction", 2))


def t4_published(spark, sf_dir):
    """The features lie in a published copy; a micro-batch reads its buckets of it."""
    target, out, ckpt = work_dir(spark, "t4-target"), work_dir(spark, "t4-out"), work_dir(spark, "t4-ckpt")
    publish_snapshot(derived(spark, sf_dir, "feature_gap"), target, ["id"], rows_per_bucket=T4_BUCKET_ROWS)
    requests = derived_on(spark, events_stream(spark, sf_dir), "score_requests")
    q = score_stream(requests, "body", "k bigint", fitted(spark, sf_dir), target, "k", out, ckpt, table_key="id",
                     id_cols=["event_id"])
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return spark.read.parquet(out).drop("batch_id").withColumn("prediction", F.round("prediction", 2))


# ---------------------------------------------------------------- T5

T5_COLUMNS = ["user_id", "commit_version", "commit_ts", "value"]


def t5(spark, sf_dir):
    """The change stream on a target that holds a snapshot of the first half of the changes."""
    changes = derived_on(spark, events_stream(spark, sf_dir), "change_rows")
    target, ckpt = work_dir(spark, "t5-target"), work_dir(spark, "t5-ckpt")
    known = derived(spark, sf_dir, "change_rows")
    half = known.agg((F.max("commit_version") / 2).cast("bigint")).first()[0]
    publish_snapshot(snapshot_as_of(known, ["user_id"], version=half).select(*T5_COLUMNS), target, ["user_id"],
                     order_col="commit_version")
    q = publish_stream(changes, target, ["user_id"], T5_COLUMNS, ckpt, order_col="commit_version")
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return read_published(spark, target).select(*T5_COLUMNS)


def register_streaming() -> None:
    register("t3_readiness_stream", fixtures=["status_events"], ctes=_t3_oracle_ctes(), oracle="""
select o.object_name, coalesce(d.dcls, 'timeout') as verdict, d.dts as decided_at
from objs o left join dc d on o.object_name = d.object_name""")(t3)
    register("t3_readiness_own_start", fixtures=["status_events"], ctes=_readiness_sql("status_events", TIMEOUT_S),
             oracle="select object_name, start_ts, verdict, decided_at from rd")(t3_own_start)
    register("t4_score_stream", fixtures=["labels_frame", "feature_gap"], ctes={**OLS_CTES, **REQUEST_CTES},
             oracle=SCORED)(t4)
    register("t4_score_published", fixtures=["labels_frame", "feature_gap"], ctes={**OLS_CTES, **REQUEST_CTES},
             oracle=SCORED)(t4_published)
    register("t5_publish_stream", fixtures=["change_rows"], oracle="""
select c.user_id, c.commit_version, c.commit_ts, c.value
from change_rows c join (
    select user_id, max(commit_version) as v from change_rows
    where change_type <> 'update_preimage' group by user_id) m
  on c.user_id = m.user_id and c.commit_version = m.v
where c.change_type <> 'delete'""")(t5)

