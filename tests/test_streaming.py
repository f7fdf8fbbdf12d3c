"""Streams survive a restart: T3 resumed from its checkpoint equals batch T1, one verdict
per object across both runs, and no state after the deadline."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from featshare.functions import LinearModel
from featshare.operators import readiness
from featshare.session import work_dir
from featshare.sources import fs
from featshare.sources.fixtures import Fixtures
from featshare.sources import publish_changes, publish_snapshot
from featshare.streaming import queries as Q
from featshare.streaming.readiness_stream import readiness_stream
from featshare.streaming.score_stream import score_stream

from conftest import SF_SMALL


def test_readiness_stream_restart_equals_batch(spark):
    status = Fixtures(spark, SF_SMALL).status_events
    src, out, ckpt = work_dir(spark, "t-src"), work_dir(spark, "t-out"), work_dir(spark, "t-ckpt")
    deadline = Q.T3_START + timedelta(seconds=Q.T3_TIMEOUT_S)
    left = {}

    def run(more):
        more.write.mode("append").parquet(src)
        stream = spark.readStream.schema(status.schema).parquet(src)
        v = readiness_stream(stream, Q.T3_TIMEOUT_S, Q.T3_START, Q.T3_DELAY)
        q = (v.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
             .outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
        assert q.exception() is None
        ops = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
        left["rows"] = ops[-1]
        return spark.read.schema(v.schema).parquet(out)

    inside = status.where(F.col("ts") < F.lit(deadline).cast("timestamp_ntz"))
    assert run(inside.where("hash(ts) % 2 = 0")).count() == 0  # the watermark has not passed the deadline
    assert left["rows"] > 0
    run(inside.where("hash(ts) % 2 <> 0"))
    end = spark.createDataFrame([("main.default.end", datetime(2099, 1, 1), "ONLINE")], status.schema)
    got = run(end)
    late = status.limit(50).withColumn("ts", F.lit(datetime(2098, 1, 1)).cast("timestamp_ntz"))
    got = run(late)  # rows after the watermark bring nothing back
    assert left["rows"] == 0
    assert got.count() == got.select("object_name").distinct().count()  # one verdict per object
    want = readiness(inside, Q.T3_TIMEOUT_S, start=Q.T3_START).select("object_name", "verdict", "decided_at")
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))


def test_score_stream_reads_the_current_version_and_survives_a_replay(spark):
    """Batches before and after a publish see the version of their time; a batch replayed after a
    failure overwrites its folder."""
    src, target, out, ckpt = (work_dir(spark, f"t-score-{n}") for n in ("src", "target", "out", "ckpt"))
    publish_snapshot(spark.range(0, 100).selectExpr("id", "cast(id as double) as x"), target, ["id"], rows_per_bucket=10)
    model = LinearModel(("x",), (2.0,), 1.0, "y", 2, 0)

    def run(bodies):
        spark.createDataFrame(list(enumerate(bodies)), "req int, body string").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("req int, body string").parquet(src)
        q = score_stream(stream, "body", "k bigint", model, target, "k", out, ckpt, table_key="id", id_cols=["req"])
        q.awaitTermination()
        assert q.exception() is None
        scored = spark.read.parquet(out)
        return sorted((r["batch_id"], r["req"], r["pos"], r["k"], r["prediction"]) for r in scored.where("k is not null").collect())

    first = [(0, 0, 0, 3, 7.0), (0, 1, 0, 4, 9.0), (0, 1, 1, 3, 7.0), (0, 3, 0, 500, None)]
    assert run(['{"k": 3}', '{"inputs": [{"k": 4}, {"k": 3}]}', "broken", '{"k": 500}', '{"k": null}']) == first
    change = spark.sql("select 3L as id, 10.0d as x, 'update_postimage' as change_type, 1 as o")
    publish_changes(spark, target, change, ["id"], "o")
    second = [*first, (1, 0, 0, 3, 21.0)]
    assert run(['{"k": 3}']) == second
    spark.createDataFrame([(9, 9, 9, None, None)], "req int, pos int, k bigint, x double, prediction double") \
        .write.mode("append").parquet(f"{out}/batch_id=1")  # what a failed attempt may have left
    fs.delete(spark, f"{ckpt}/commits/1")
    assert run(["none"]) == second and spark.read.parquet(out).where("req = 9").count() == 0
