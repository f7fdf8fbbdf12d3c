"""Waits from each object's own start, the poller's grid, and components of shared models."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from featshare.operators.components import consolidated_share, model_components
from featshare.operators.readiness import poll_grid, readiness
from featshare.session import materialize, work_dir
from featshare.streaming.queries import state_store
from featshare.streaming.readiness_stream import ROCKSDB, readiness_stream_from_first

T0 = datetime(2024, 3, 1)
SCHEMA = "object_name string, ts timestamp_ntz, state string"


def log(seed, n=300, objects=12):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        who = "hot" if rng.random() < 0.4 else f"o{rng.randrange(objects)}"
        state = rng.choice(["PROVISIONING"] * 6 + ["ONLINE", "OFFLINE_FAILED", None])
        rows.append((who, T0 + timedelta(seconds=i * 40 + rng.randrange(-100, 100)), state))
    return rows


@pytest.mark.parametrize("timeout_s", [90, 900])
def test_own_start_over_a_restart(spark, timeout_s):
    """Several files and a restart in between: the verdicts of T1; at the end only the end
    marker's own wait is left in the state."""
    rows = log(timeout_s)
    folder, out, ckpt = (work_dir(spark, n) for n in ("own-in", "own-out", "own-ckpt"))

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
        with state_store(spark, ROCKSDB):
            q = (readiness_stream_from_first(stream, timeout_s, slice_s=30, delay="5 minutes").writeStream.format("parquet")
                 .option("path", out).option("checkpointLocation", ckpt).trigger(availableNow=True).start())
            q.awaitTermination()
        assert q.exception() is None
        return q

    def add(part):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)

    add(rows[:150])
    run()
    add(rows[150:])
    add([("end", datetime(2099, 1, 1), None)])
    q = run()
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect() if r.object_name != "end")
    want = sorted((r.object_name, r.start_ts, r.verdict, r.decided_at)
                  for r in readiness(spark.createDataFrame(rows, SCHEMA), timeout_s).collect())
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert {r[2] for r in want} >= {"ready", "timeout"}
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3  # the marker's wait and its timer


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_grid_against_plain_python(spark, block):
    rows = log(block, 120)
    frame = spark.createDataFrame([*rows, *rows[:5], ("once", T0, "ONLINE")], SCHEMA)
    got = {(r.object_name, r.window_start): (r.state, r.state_class, r.n_events) for r in poll_grid(frame, 300, block=block).collect()}
    by = {}
    for who, ts, state in [*rows, *rows[:5], ("once", T0, "ONLINE")]:
        by.setdefault(who, []).append((ts, state))
    want = {}
    for who, seen in by.items():
        at = min(seen)[0] if len(seen) == 1 else min(t for t, _ in seen)
        at = T0 + timedelta(seconds=(at - T0).total_seconds() // 300 * 300)
        while at <= max(t for t, _ in seen):
            upto = [x for x in seen if x[0] < at + timedelta(seconds=300)]
            state = max(upto, key=lambda x: x[0])[1]
            up = (state or "").upper()
            cls = "ready" if "ONLINE" in up and "OFFLINE" not in up else "failed" if "FAILED" in up else "waiting"
            want[who, at] = (state, cls, sum(t >= at for t, _ in upto))
            at += timedelta(seconds=300)
    assert got == want
    assert poll_grid(frame.limit(0), 300).count() == 0


def components_of(pairs, models):
    parent = {m: m for m in models}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    users = {}
    for m, t, d in pairs:
        if d is not None:
            users.setdefault((t, d), []).append(m)
    for group in users.values():
        for m in group[1:]:
            a, b = sorted((find(group[0]), find(m)))
            parent[b] = a
    return {m: find(m) for m in models}


def test_components_against_union_find(spark):
    rng = random.Random(4)
    models = [f"m{i:03}" for i in range(160)]
    pairs = [(f"m{rng.randrange(100):03}", rng.choice(["TABLE", "FUNCTION"]), f"d{rng.randrange(90)}") for _ in range(110)]
    pairs += [(f"m{i:03}", "TABLE", f"path{j}") for i in range(100, 150) for j in (i, i + 1)]  # a long path
    pairs += [(m, "TABLE", "hot") for m in models[::3] if m < "m060"] + [("m151", "TABLE", None), ("m152", "TABLE", None)]
    labels = components_of(pairs, models)
    m = spark.createDataFrame([(x,) for x in models + models[:3]], "model_name string")
    deps = spark.createDataFrame(pairs + pairs[:9], "model_name string, dep_type string, dep_name string")
    assert {r.model_name: r.component for r in model_components(m, deps).collect()} == labels
    want = {}
    for who, label in labels.items():
        want.setdefault((label, "MODEL", who), set()).add(who)
    for who, kind, dep in pairs:
        if dep is not None:
            want.setdefault((labels[who], kind, dep), set()).add(who)
    got = {(r.component, r.object_type, r.object_name): r.n_models for r in consolidated_share(m, deps).collect()}
    assert got == {k: len(v) for k, v in want.items()}
    assert consolidated_share(m.limit(0), deps.limit(0)).count() == 0


def test_hot_dependency_is_split(spark):
    """A dependency that most models use: the join that hands out its label splits its rows."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        edges = spark.range(0, 60_000, 1, 8).select(F.format_string("m%06d", "id").alias("model_name"), F.lit("TABLE").alias("dep_type"),
                                                    F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.format_string("d%d", "id")).alias("dep_name"))
        of_dep = materialize(edges.groupBy("dep_name").agg(F.min("model_name").alias("label")))
        joined = edges.join(of_dep, "dep_name")
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
        labels = model_components(edges.select("model_name"), edges)
        assert labels.select("component").distinct().count() == 20_001
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_components_read_once_and_shrink(spark, monkeypatch):
    """A consolidated share evaluates the dependencies once, and its rounds write less and less."""
    rng = random.Random(7)
    models = [f"m{i:03}" for i in range(60)]
    pairs = [(m, "TABLE", f"d{i}") for m in models for i in rng.sample(range(45), 2)]
    read, written = spark.sparkContext.accumulator(0), []

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    def write(df, name="stage"):
        out = materialize(df, name)
        written.append((name, out.count()))
        return out

    monkeypatch.setattr("featshare.operators.components.materialize", write)
    deps = spark.createDataFrame(pairs, "model_name string, dep_type string, dep_name string")
    m = spark.createDataFrame([(x,) for x in models], "model_name string")
    got = {(r.component, r.object_name) for r in consolidated_share(m, deps.mapInArrow(counted, deps.schema)).collect()
           if r.object_type == "MODEL"}
    assert got == {(label, who) for who, label in components_of(pairs, models).items()}
    assert read.value == len(pairs)
    links = [n for name, n in written if name == "links"]
    assert links[-1] == 0 and all(b < a for a, b in zip(links, links[1:])) and sum(links) <= 2 * links[0]


def test_own_start_of_the_past_costs_no_state(spark):
    """Waits that the watermark has passed, their time to be remembered included, get their verdicts
    without a write to the state or a timer."""
    rows = log(11, 80)
    folder, out, ckpt = (work_dir(spark, n) for n in ("past-in", "past-out", "past-ckpt"))
    spark.createDataFrame([*rows, ("end", datetime(2099, 1, 1), None)], SCHEMA).coalesce(1).write.parquet(folder)
    with state_store(spark, ROCKSDB):
        q = (readiness_stream_from_first(spark.readStream.schema(SCHEMA).parquet(folder), 900).writeStream.format("parquet")
             .option("path", out).option("checkpointLocation", ckpt).trigger(availableNow=True).start())
        q.awaitTermination()
    assert q.exception() is None
    want = [tuple(r) for r in readiness(spark.createDataFrame(rows, SCHEMA), 900)
            .select("object_name", "start_ts", "verdict", "decided_at").collect()]
    assert sorted(map(repr, map(tuple, spark.read.parquet(out).collect()))) == sorted(map(repr, want))
    waits = [p["stateOperators"][0] for p in q.recentProgress if p["stateOperators"]]
    assert {r[2] for r in want} >= {"ready", "timeout"}
    assert all(w["numRowsUpdated"] == 0 and w["numRowsTotal"] == 0 for w in waits)
