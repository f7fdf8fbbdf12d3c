"""A key holding a third of the rows: results stay whole and exact on every path."""

import pytest
from pyspark.sql import functions as F

from featshare.operators import feature_lookup, latest_model_version, readiness
from featshare.operators.sharing import share_details
from featshare.operators.lookup import hot_keys
from featshare.sources import check_primary_key


@pytest.fixture()
def skewed(spark):
    # 30,000 label rows, key 7 holds a third of them
    labels = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 5000).alias("k"),
        F.col("id").alias("row_id"))
    feats = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 1.5).alias("f"))
    return labels, feats


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_salted_lookup_equals_plain_join(spark, skewed):
    labels, feats = skewed
    assert [r.k for r in hot_keys(labels, ["k"], 0.05).collect()] == [7]
    plain = feature_lookup(labels, feats, "k", ["f"])
    salted = feature_lookup(labels, feats, "k", ["f"], hot_key_fraction=0.05, salt_buckets=8)
    assert salted.count() == labels.count()
    assert rows(salted.select("k", "row_id", "f")) == rows(plain.select("k", "row_id", "f"))


def test_aqe_splits_the_hot_partition(spark, skewed):
    labels, feats = skewed
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        out = feature_lookup(labels, feats, "k", ["f"])
        got = out.count()
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert got == labels.count()
        assert "SortMergeJoin(skew=true)" in plan  # the hot partition was split
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_equal_rows_of_a_hot_key_are_spread(spark):
    same = spark.range(9000).select(F.lit(7).alias("k"), F.lit("x").alias("v")).union(
        spark.createDataFrame([(1, "y"), (None, "z")], "k int, v string"))
    feats = spark.createDataFrame([(7, 1.0), (1, 2.0)], "k int, f double")
    out = feature_lookup(same, feats, "k", ["f"], hot_key_fraction=0.5, salt_buckets=4)
    assert sorted(map(repr, map(tuple, out.groupBy("k", "v", "f").count().collect()))) == \
        ["(1, 'y', 2.0, 1)", "(7, 'x', 1.0, 9000)", "(None, 'z', None, 1)"]


@pytest.mark.parametrize("fraction", [0, 1, 1e-9, -0.5, 2])
def test_hot_key_fraction_is_bounded(spark, skewed, fraction):
    with pytest.raises(ValueError):
        feature_lookup(*skewed, "k", ["f"], hot_key_fraction=fraction)


def test_hot_share_is_split(spark):
    """A share with a third of the objects: the items' side of the join is split."""
    objects = spark.range(60000).select(
        F.concat(F.lit("share_"), F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 500)).alias("share_name"),
        F.concat(F.lit("o"), "id").alias("object_name"), F.lit("TABLE").alias("object_type"))
    shares = spark.range(600).select(F.concat(F.lit("share_"), "id").alias("share_name"), F.lit("c").alias("comment"))
    grants = spark.createDataFrame([("share_0", "p", "SELECT")], "share_name string, principal string, privilege string")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        out = share_details(shares, objects, grants)
        got = out.collect()
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(got) == 60000 + 1 + 100  # items, the grant, shares without anything
    assert {r.n_objects for r in got if r.share_name == "share_0"} == {20000 + 80}


def test_hot_group_aggregates_are_exact(spark, skewed):
    labels, _ = skewed
    dup = check_primary_key(labels, ["k"]).where("k = 7").first()
    assert dup.n_rows == labels.where("k = 7").count() > 10000 - 1
    mv = labels.select(F.lit("m").alias("model_name"), F.col("row_id").cast("string").alias("version"))
    assert latest_model_version(mv).first().version == "29999"
    ev = labels.select(F.lit("obj").alias("object_name"),
                       F.timestamp_seconds(F.col("row_id")).cast("timestamp_ntz").alias("ts"),
                       F.when(F.col("row_id") == 12345, "ONLINE").otherwise("PROVISIONING").alias("state"))
    r = readiness(ev, 86400).first()
    assert (r.verdict, str(r.decided_at)) == ("ready", "1970-01-01 03:25:45")
