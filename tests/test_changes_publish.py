"""Change feed, time travel and publishing round trips."""

import pytest
from pyspark.sql import functions as F

import featshare.operators.changes as changes_module
from featshare.operators import change_feed, change_feed_by_blocks, publish_rollup, snapshot_as_of
from featshare.session import work_dir
from featshare.sources import publish_changes, publish_many, publish_snapshot, read_published, read_published_for
from featshare.sources import fs
from featshare.sources.fixtures import Fixtures
from featshare.sources.publish import _stored, apply_changes, bucket_counts, versions
from featshare.streaming.publish_stream import publish_batch, publish_stream

from conftest import SF_SMALL

SCHEMA = "id bigint, a double, b string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_change_feed_null_safe(spark):
    before = spark.createDataFrame([(1, 1.0, None), (2, 2.0, "x"), (3, 3.0, "y")], SCHEMA)
    after = spark.createDataFrame([(1, 1.0, None), (2, 2.5, "x"), (4, 4.0, None)], SCHEMA)
    got = rows(change_feed(before, after, ["id"]))
    assert got == [(2, 2.0, "x", "update_preimage"), (2, 2.5, "x", "update_postimage"),
                   (3, 3.0, "y", "delete"), (4, 4.0, None, "insert")]


def test_change_feed_joins_only_blocks_that_differ(spark):
    schema = "id bigint, a double, b string, l array<string>"
    old = [(i, float(i), None if i % 3 else "x", ["p", None]) for i in range(1000)]
    new = [(i, a + (i == 205), "x" if i == 778 else b, [None, "p"] if i == 501 else l)
           for i, a, b, l in old if i != 210] + [(2000, None, None, None)]
    before, after = (spark.createDataFrame(r, schema) for r in (old, new))
    want = sorted(map(str, change_feed(before, after, ["id"]).collect()))
    assert len(want) == 8  # three updates, a delete, an insert
    for block in ("id div 100", None, "0"):
        assert sorted(map(str, change_feed_by_blocks(before, after, ["id"], block).collect())) == want
    # a swap of nulls between columns and of values between rows is seen
    a = spark.createDataFrame([(1, None, "1"), (2, 1.0, "z")], "id bigint, a double, b string")
    b = spark.createDataFrame([(1, 1.0, "1"), (2, None, "z")], "id bigint, a double, b string")
    assert change_feed_by_blocks(a, b, ["id"], "0").count() == 4
    assert change_feed_by_blocks(a, a, ["id"]).count() == 0 == change_feed_by_blocks(a.limit(0), a.limit(0), ["id"]).count()
    none = spark.createDataFrame([(None, 1.0, "x")], "id bigint, a double, b string")
    assert rows(change_feed_by_blocks(none, none, ["id"])) == rows(change_feed(none, none, ["id"]))


def test_unchanged_blocks_do_not_reach_the_join(spark):
    old = spark.range(20000).selectExpr("id", "id * 2 as v")
    new = old.withColumn("v", F.expr("if(id = 12345, 0, v)"))
    calls = []
    real = changes_module.change_feed
    try:
        changes_module.change_feed = lambda b, a, k: calls.append((b.count(), a.count())) or real(b, a, k)
        assert changes_module.change_feed_by_blocks(old, new, ["id"], "id div 1000").count() == 2
    finally:
        changes_module.change_feed = real
    assert calls == [(1000, 1000)]


def test_publish_round_trip_v0_to_v1(spark):
    fx = Fixtures(spark, SF_SMALL)
    target = work_dir(spark, "t-pub")
    assert publish_snapshot(fx.features_v0, target, ["id"]) == 1
    assert publish_changes(spark, target, change_feed(fx.features_v0, fx.features_v1, ["id"]), ["id"]) == 2
    assert rows(read_published(spark, target)) == rows(fx.features_v1)
    assert rows(read_published(spark, target, 1)) == rows(fx.features_v0)
    assert versions(spark, target) == [1, 2]


def test_buckets_follow_the_rows(spark):
    """The stored side is joined where it lies; a target that outgrows its buckets gets more."""
    target = work_dir(spark, "t-buckets")
    base = spark.createDataFrame([(i, float(i), "x") for i in range(100)], SCHEMA)
    publish_snapshot(base, target, ["id"], rows_per_bucket=10)
    assert bucket_counts(spark, target) == {1: 10}
    change = spark.createDataFrame([(7, 70.0, "y", "update_postimage", 1)], SCHEMA + ", change_type string, o int")
    new = apply_changes(_stored(spark, f"{target}/v0000000001-b10", ["id"], 10), change, ["id"], "o", buckets=10)
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "SelectedBucketsCount: 10 out of 10" in plan
    assert plan.count("Exchange") == 2  # both on the side of the changes: last per key, then the buckets
    assert publish_changes(spark, target, change, ["id"], "o", rows_per_bucket=10) == 2
    want = [(i, 70.0, "y") if i == 7 else (i, float(i), "x") for i in range(100)]
    assert rows(read_published(spark, target)) == want
    assert rows(read_published(spark, target, keys=["id"])) == want
    assert publish_changes(spark, target, change.limit(0), ["id"], "o") == 2
    fresh = work_dir(spark, "t-fresh")
    many = spark.range(0, 500).selectExpr("id", "id * 1.0D as a", "'x' as b", "'insert' as change_type", "cast(id as int) as o")
    publish_snapshot(base.limit(0), fresh, ["id"], rows_per_bucket=10)
    publish_changes(spark, fresh, many, ["id"], "o", rows_per_bucket=10)
    assert bucket_counts(spark, fresh) == {1: 1, 2: 50} and read_published(spark, fresh).count() == 500


def test_refused_and_unfinished_versions_do_not_count(spark):
    target = work_dir(spark, "t-refused")
    good = spark.createDataFrame([(1, 1.0, "a"), (2, 2.0, "b")], SCHEMA)
    publish_snapshot(good, target, ["id"])
    for bad in ([(1, 1.0, "a"), (1, 2.0, "b")], [(None, 1.0, "a")]):
        with pytest.raises(ValueError):
            publish_snapshot(spark.createDataFrame(bad, SCHEMA), target, ["id"])
    good.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{target}/v0000000002-b1")
    assert versions(spark, target) == [1] and rows(read_published(spark, target)) == rows(good)
    assert publish_snapshot(good.limit(1), target, ["id"]) == 2 and read_published(spark, target).count() == 1


def files_read(df) -> int:
    """Files that the scan of a collected frame opened."""
    df.collect()
    read = df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().get("numFiles")
    return read.get().value() if read.isDefined() else 0


def test_few_keys_read_few_files_of_a_published_copy(spark):
    target = work_dir(spark, "t-few")
    publish_snapshot(spark.range(0, 2000).selectExpr("id", "id * 2 as f"), target, ["id"], rows_per_bucket=100)
    publish_changes(spark, target, spark.sql("select 7L as id, 0L as f, 'delete' as change_type, 1 as o"), ["id"], "o")
    assert bucket_counts(spark, target)[2] == 20
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for keys, files in (("(3)", 1), ("(3), (3), (null), (1203)", 2), ("(null)", 0), ("(99999999999)", 1)):
            batch = spark.sql(f"select cast(col1 as bigint) as k from values {keys}")
            part = read_published_for(batch, target, "id", "k")
            assert files_read(part) <= files
            got = batch.join(part, batch["k"] == part["id"], "left").select("k", "f").collect()
            assert sorted((r["k"] or -1, r["f"] or -1) for r in got) == sorted(
                (r["k"] or -1, r["k"] * 2 if r["k"] and r["k"] < 2000 else -1) for r in batch.collect())
        everything = spark.range(-50, 2100).selectExpr("cast(id as int) as k")  # an int meets the bigint's buckets
        part = read_published_for(everything, target, "id", "k")
        assert files_read(part) == 20 and sorted(r["id"] for r in part.collect()) == [i for i in range(2000) if i != 7]
        joined = everything.join(part.hint("merge"), F.col("k").cast("bigint") == part["id"], "left")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and plan.count("Exchange") == 1 and joined.where("f is not null").count() == 1999
        assert read_published_for(everything.limit(0), target, "id", "k").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    with pytest.raises(ValueError, match="published id is bigint"):
        read_published_for(spark.sql("select '3' as k"), target, "id", "k")
    with pytest.raises(FileNotFoundError):
        read_published_for(everything, work_dir(spark, "t-none"), "id", "k")


def test_pruned_read_of_compound_and_text_keys(spark):
    target = work_dir(spark, "t-few2")
    rows2 = spark.range(0, 600).selectExpr("concat('k', id % 50) as a", "id as b", "id * 3 as f")
    publish_snapshot(rows2, target, ["a", "b"], rows_per_bucket=50)
    batch = spark.sql("select * from values ('k3', 53L), ('k3', 54L), ('k49', 549L), (null, 1L), ('k1', null) as t(a, b)")
    part = read_published_for(batch, target, ["a", "b"])
    got = batch.join(part, ["a", "b"], "left").collect()
    assert sorted((r["a"] or "", r["b"] or 0, r["f"] or 0) for r in got) == [
        ("", 1, 0), ("k1", 0, 0), ("k3", 53, 159), ("k3", 54, 0), ("k49", 549, 1647)]


def counted(spark, df, ticks):
    """``df`` with every evaluated row counted."""
    return df.mapInPandas(lambda parts: (ticks.add(len(p)) or p for p in parts), df.schema)


def test_a_refresh_evaluates_its_source_once_and_fits_its_buckets(spark):
    target = work_dir(spark, "t-refresh")
    frame = lambda n: spark.range(0, n, 1, 4).selectExpr("id", "id * 2 as f")
    assert publish_snapshot(frame(1000), target, ["id"], rows_per_bucket=100) == 1
    for version, (n, buckets) in enumerate([(1500, 10), (5000, 50), (900, 9), (0, 1), (150, 1)], 2):
        ticks = spark.sparkContext.accumulator(0)
        assert publish_snapshot(counted(spark, frame(n), ticks), target, ["id"], rows_per_bucket=100) == version
        assert ticks.value == n and bucket_counts(spark, target)[version] == buckets
        assert read_published(spark, target).count() == n
        joined = frame(n).join(read_published(spark, target, keys=["id"]).withColumnRenamed("f", "g"), "id")
        assert joined.where("f = g").count() == n
    assert set(fs.list_dirs(spark, target)) == {f"v{v:010d}-b{b}" for v, b in bucket_counts(spark, target).items()}
    ticks = spark.sparkContext.accumulator(0)
    with pytest.raises(ValueError, match="1 repeated"):
        publish_snapshot(counted(spark, frame(10).union(frame(1)), ticks), target, ["id"])
    assert ticks.value == 11 and len(versions(spark, target)) == 6
    fresh, ticks = work_dir(spark, "t-given"), spark.sparkContext.accumulator(0)
    publish_snapshot(counted(spark, frame(100), ticks), fresh, ["id"], rows_per_bucket=1, buckets=3)
    assert ticks.value == 100 and bucket_counts(spark, fresh) == {1: 3}


def test_lookup_on_a_published_copy_moves_only_the_labels(spark):
    target = work_dir(spark, "t-lookup")
    publish_snapshot(spark.range(0, 4000).selectExpr("id", "id * 2 as f"), target, ["id"], rows_per_bucket=1000)
    labels = spark.range(0, 9000).selectExpr("id % 5000 as id", "id as row_id").repartition(4, "id")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = labels.join(read_published(spark, target, keys=["id"]), "id", "left")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
        assert out.count() == 9000 and out.where("f is null").count() == 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


CHANGES = "id bigint, a double, b string, change_type string, o bigint"


def test_late_changes_lose(spark):
    target = work_dir(spark, "t-late")
    publish_snapshot(spark.createDataFrame([(1, 0.0, "s"), (2, 0.0, "s"), (3, 0.0, "s")], SCHEMA), target, ["id"])

    def go(*changes):
        publish_changes(spark, target, spark.createDataFrame(changes, CHANGES), ["id"], "o")
        return rows(read_published(spark, target))

    assert go((1, 5.0, "x", "update_postimage", 5), (2, None, None, "delete", 6)) == [(1, 5.0, "x"), (3, 0.0, "s")]
    # older than the stored row, older than the tombstone, an older insert of a deleted key
    assert go((1, 4.0, "x", "update_postimage", 4), (2, 5.0, "x", "insert", 5)) == [(1, 5.0, "x"), (3, 0.0, "s")]
    # equal order is a replay; newer ones apply; several per key: the last
    assert go((1, 5.5, "z", "update_postimage", 5), (2, 7.0, "x", "insert", 7), (3, 1.0, "x", "update_postimage", 1),
              (3, 3.0, "x", "update_postimage", 3), (3, 2.0, "x", "update_preimage", 9)) == \
        [(1, 5.0, "x"), (2, 7.0, "x"), (3, 3.0, "x")]


def test_unordered_duplicates_are_refused(spark):
    target = work_dir(spark, "t-unordered")
    publish_snapshot(spark.createDataFrame([(1, 0.0, "s")], SCHEMA), target, ["id"])
    twice = spark.createDataFrame([(1, 1.0, "x", "update_postimage", 1), (1, 2.0, "x", "update_postimage", 2)], CHANGES)
    with pytest.raises(ValueError):
        publish_changes(spark, target, twice, ["id"])
    with pytest.raises(ValueError):
        publish_changes(spark, target, spark.createDataFrame([(None, 1.0, "x", "insert", 1)], CHANGES), ["id"], "o")
    assert rows(read_published(spark, target)) == [(1, 0.0, "s")]


def test_publish_snapshot_rejects_duplicates(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (1, 2.0, "b")], SCHEMA)
    with pytest.raises(ValueError):
        publish_snapshot(df, work_dir(spark, "t-dup"), ["id"])


def test_publish_many_goes_on_after_failure(spark):
    good = spark.createDataFrame([(1, 1.0, "a")], SCHEMA)
    bad = spark.createDataFrame([(1, 1.0, "a"), (1, 2.0, "b")], SCHEMA)
    out = publish_many(spark, [("s.a", "o.a", good, ["id"]), ("s.b", "o.b", bad, ["id"]),
                               ("s.c", "o.a", good, ["id"])], work_dir(spark, "t-many"))
    assert [(r.source_table_name, r.outcome) for r in out.orderBy("source_table_name").collect()] == \
        [("s.a", "published"), ("s.b", "failed"), ("s.c", "exists")]
    roll = publish_rollup(out).first()
    assert (roll.n_tables, roll.n_published, roll.n_exists, roll.n_failed, roll.all_ready) == (3, 1, 1, 1, False)


def test_snapshot_as_of_last_version_equals_replay(spark):
    ch = Fixtures(spark, SF_SMALL).change_rows
    last = ch.agg(F.max("commit_version")).first()[0]
    snap = snapshot_as_of(ch, ["user_id"], version=last)
    assert rows(snap) == rows(snapshot_as_of(ch, ["user_id"]))
    early = snapshot_as_of(ch, ["user_id"], version=10)
    assert early.count() <= 11


def test_publish_batch_is_idempotent(spark):
    changes = spark.createDataFrame(
        [(1, 1, "insert", 1.0), (2, 2, "insert", 2.0), (1, 3, "update_postimage", 3.0), (2, 4, "delete", None)],
        "user_id bigint, commit_version bigint, change_type string, value double")
    target = work_dir(spark, "t-batch")
    cols = ["user_id", "commit_version", "value"]

    def go(where):
        publish_batch(changes.where(where), target, ["user_id"], cols, "commit_version")

    go("commit_version <= 2")
    go("commit_version > 2")
    go("commit_version > 2")  # a replay after a failure changes no row
    assert rows(read_published(spark, target)) == [(1, 3, 3.0)]
    go("true")  # all changes again, as a new checkpoint reads them
    assert rows(read_published(spark, target)) == [(1, 3, 3.0)]


def test_stream_after_a_snapshot_loses_nothing(spark):
    """A target with versions, a restart and a new checkpoint: every change arrives once."""
    schema = "user_id bigint, commit_version bigint, change_type string, value double"
    cols = ["user_id", "commit_version", "value"]
    target, src = work_dir(spark, "t-after"), work_dir(spark, "t-after-src")
    publish_snapshot(spark.createDataFrame([(1, 2, 2.0), (9, 1, 9.0)], "user_id bigint, commit_version bigint, value double"),
                     target, ["user_id"], order_col="commit_version")

    def run(ckpt):
        q = publish_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), target,
                           ["user_id"], cols, ckpt, "commit_version")
        q.awaitTermination()
        assert q.exception() is None

    def add(*changes):
        spark.createDataFrame(changes, schema).coalesce(1).write.mode("append").parquet(src)

    a, b = work_dir(spark, "t-ckpt-a"), work_dir(spark, "t-ckpt-b")
    add((1, 1, "update_postimage", 1.0), (2, 3, "insert", 3.0))
    add((9, 4, "delete", None))
    run(a)
    assert rows(read_published(spark, target)) == [(1, 2, 2.0), (2, 3, 3.0)]
    add((1, 6, "update_postimage", 6.0), (9, 2, "insert", 2.0))
    run(a)  # restart
    want = [(1, 6, 6.0), (2, 3, 3.0)]
    assert rows(read_published(spark, target)) == want
    run(b)  # a new checkpoint reads everything again
    assert rows(read_published(spark, target)) == want
