"""Feature tables (S2-S5, K1, K2, P2), training and scoring."""

import pytest
from pyspark.sql import functions as F

from featshare.functions import FeatureFunction, LinearModel, check_signature, infer_signature, predict
from featshare.operators import FeatureLookup, create_training_set, feature_lookup, score_batch, train_linear
from featshare.session import work_dir
from featshare.sources import (check_not_null, check_primary_key, create_feature_table, drop_feature_table,
                               ensure_feature_table, ensure_registered_table, infer_request_signature,
                               parse_score_requests, read_feature_table, read_score_requests, read_share, request_rejects,
                               register_feature_table)
from featshare.sources import feature_tables, fs
from featshare.sources.feature_tables import read_metadata, table_location

DEMO_SCHEMA = "id bigint, feature_1 double, feature_2 double, target double"


@pytest.fixture()
def demo(spark):
    # The reference's demo rows, (i, i, 10i, 11i) for i = 1..5
    return spark.createDataFrame([(i, float(i), 10.0 * i, 11.0 * i) for i in range(1, 6)], DEMO_SCHEMA)


def test_create_read_and_metadata(spark, demo):
    path = work_dir(spark, "t-create")
    create_feature_table(demo, path, ["id"], "Demo feature table")
    assert read_metadata(spark, path)["primary_keys"] == ["id"]
    got = read_feature_table(spark, path, columns=["id", "target"], where=F.col("id") > 3)
    assert sorted(r.id for r in got.collect()) == [4, 5]
    with pytest.raises(FileExistsError):
        create_feature_table(demo, path, ["id"])


def test_create_rejects_bad_keys(spark, demo):
    dup = demo.unionByName(demo.limit(1))
    with pytest.raises(ValueError, match="1 key"):
        create_feature_table(dup, work_dir(spark, "t-dup"), ["id"])
    nulls = demo.unionByName(spark.createDataFrame([(None, 1.0, 1.0, 1.0)], DEMO_SCHEMA))
    with pytest.raises(ValueError, match="1 row"):
        create_feature_table(nulls, work_dir(spark, "t-null"), ["id"])
    assert check_not_null(nulls, ["id"]).count() == 1
    assert [tuple(r) for r in check_primary_key(dup, ["id"]).collect()] == [(1, 2)]


def test_create_evaluates_its_source_once_and_leaves_nothing_behind(spark):
    ticks = spark.sparkContext.accumulator(0)
    def source(n):
        return spark.range(0, n, 1, 4).selectExpr("id % 60 as id", "id as f").mapInPandas(
            lambda parts: (ticks.add(len(p)) or p for p in parts), "id bigint, f bigint")
    path = work_dir(spark, "t-once")
    create_feature_table(source(60), path, ["id"])
    assert ticks.value == 60 and read_feature_table(spark, path).count() == 60 and fs.is_complete(spark, path)
    bad = work_dir(spark, "t-once-bad")
    with pytest.raises(ValueError, match="40 key"):
        create_feature_table(source(100), bad, ["id"])
    assert ticks.value == 160 and not fs.exists(spark, bad)
    empty = work_dir(spark, "t-once-empty")
    create_feature_table(source(0), empty, ["id"])
    assert read_metadata(spark, empty)["primary_keys"] == ["id"] and fs.is_complete(spark, empty)


def test_ensure_outcomes(spark, demo):
    path = work_dir(spark, "t-ensure")
    assert ensure_feature_table(demo, path, ["id"]) == "created"
    assert ensure_feature_table(demo, path, ["id"]) == "reused"
    assert ensure_feature_table(demo, path, ["id", "feature_1"]) == "recreated"
    assert read_metadata(spark, path)["primary_keys"] == ["id", "feature_1"]
    assert read_feature_table(spark, path).count() == 5


def test_registered_table_is_complete_at_every_step(spark, demo, monkeypatch):
    root, name = work_dir(spark, "t-registered"), "demo_registered_t"
    assert ensure_registered_table(demo, name, root, ["id"]) == "created"
    assert ensure_registered_table(demo, name, root, ["id"]) == "reused"
    first = table_location(spark, name)
    seen, write = [], feature_tables._write_metadata

    def read_between(*args):
        seen.append((spark.table(name).count(), table_location(spark, name)))
        write(*args)
        seen.append((spark.table(name).count(), table_location(spark, name)))
    monkeypatch.setattr(feature_tables, "_write_metadata", read_between)
    more = demo.withColumn("feature_3", F.lit("x")).unionByName(
        spark.createDataFrame([(6, 6.0, 60.0, 66.0, "y")], DEMO_SCHEMA + ", feature_3 string"))
    assert ensure_registered_table(more, name, root, ["id", "feature_1"]) == "recreated"
    assert seen == [(5, first), (5, first)]
    assert spark.table(name).count() == 6 and spark.table(name).columns[-1] == "feature_3"
    assert sorted(r.feature_3 for r in spark.table(name).collect()) == ["x"] * 5 + ["y"]
    with pytest.raises(ValueError):  # a version that fails its check changes nothing
        ensure_registered_table(more.unionByName(more), name, root, ["id"])
    assert spark.table(name).count() == 6
    other = more.select("id", F.col("feature_1").cast("string").alias("feature_1"))
    assert ensure_registered_table(other, name, root, ["id"], delete_replaced=True) == "recreated"
    assert spark.table(name).dtypes == [("id", "bigint"), ("feature_1", "string")]
    assert spark.read.parquet(first).count() == 5
    assert drop_feature_table(spark, name) and table_location(spark, name) is None


def test_drop_is_registration_only(spark, demo):
    path = work_dir(spark, "t-drop")
    create_feature_table(demo, path, ["id"])
    register_feature_table(spark, "demo_features_t", path)
    assert drop_feature_table(spark, "demo_features_t") is True
    assert drop_feature_table(spark, "demo_features_t") is False  # a warning, not an error
    assert read_feature_table(spark, path).count() == 5


def test_signature(spark, demo):
    sig = infer_signature(demo.drop("id"), outputs=["target"])
    assert sig["inputs"] == [("feature_1", "double"), ("feature_2", "double")]
    other = demo.select(F.col("feature_1").cast("float"), "id")
    diffs = {(r.column_name, r.problem) for r in check_signature(other, sig).collect()}
    assert diffs == {("feature_1", "mistyped"), ("feature_2", "missing"), ("id", "extra")}


def test_training_set_and_fit_on_demo(spark, demo):
    labels = demo.select("id", "target")
    ts = create_training_set(labels, [FeatureLookup(demo, ("feature_1", "feature_2"), "id")],
                             label="target", exclude_columns=["id"])
    assert ts.columns == ["target", "feature_1", "feature_2"]
    model = train_linear(ts, ["feature_1", "feature_2"], "target")
    # feature_2 = 10 * feature_1: coefficients are not unique, predictions are
    preds = sorted(round(r.prediction, 6) for r in predict(ts, model).collect())
    assert preds == [11.0, 22.0, 33.0, 44.0, 55.0]
    with pytest.raises(ValueError, match="already in the frame"):
        feature_lookup(demo, demo, "id", ["feature_1"])


def test_lookup_keeps_unmatched_rows(spark, demo):
    labels = spark.createDataFrame([(1, 0.0), (9, 0.0), (9, 1.0)], "id bigint, target double")
    out = feature_lookup(labels, demo, "id", ["feature_1"]).orderBy("id", "target").collect()
    assert [(r.id, r.feature_1) for r in out] == [(1, 1.0), (9, None), (9, None)]


def test_parse_requests_both_forms(spark):
    bodies = spark.createDataFrame([
        (1, '{"inputs":[{"id":1},{"id":2},{"id":3}]}'),
        (2, '{"inputs":[{"feature_1":1.0,"feature_2":10.0}]}'),
        (3, '{"id": 7}'),
        (4, "not json")], "req int, body string")
    out = parse_score_requests(bodies, "body", "id bigint, feature_1 double, feature_2 double", ["req"])
    got = sorted((r.req, r.pos, r.id, r.feature_1) for r in out.collect())
    assert got == [(1, 0, 1, None), (1, 1, 2, None), (1, 2, 3, None), (2, 0, None, 1.0), (3, 0, 7, None)]


BODIES = ['{"k":1}', '{"inputs":[{"k":1},{"k":"x"},null,5,"s",{"k":2.5},{"z":1},[1]]}', '{"inputs":[]}', '{"inputs":5}',
          '{"inputs":null}', "not json {", "[1]", "null", "", None, '{"k":"x"}', "{}", '{"k":1', '{"inputs":"a"}']


def test_received_is_parsed_plus_rejected(spark):
    df = spark.createDataFrame(list(enumerate(BODIES)), "i int, body string")
    good = sorted((r.i, r.pos, r.k) for r in parse_score_requests(df, "body", "k bigint", ["i"]).collect())
    assert good == [(0, 0, 1), (1, 0, 1), (1, 6, None), (11, 0, None)]
    bad = sorted((r.i, r.pos, r.reason) for r in request_rejects(df, "body", "k bigint", ["i"]).collect())
    assert bad == [(1, 1, "mistyped"), (1, 2, "null_record"), (1, 3, "mistyped"), (1, 4, "mistyped"), (1, 5, "mistyped"),
                   (1, 7, "mistyped"), (3, 0, "inputs_not_a_list"), (4, 0, "inputs_not_a_list"), (5, 0, "malformed"),
                   (6, 0, "malformed"), (7, 0, "malformed"), (8, 0, "malformed"), (9, 0, "malformed"),
                   (10, 0, "mistyped"), (12, 0, "malformed"), (13, 0, "inputs_not_a_list")]
    missing = request_rejects(df, "body", "k bigint", ["i"], required=["k"]).where("reason = 'missing'")
    assert sorted((r.i, r.pos) for r in missing.collect()) == [(1, 6), (11, 0)]


KINDS = "w int, d double, n decimal(6,2), b boolean, s string, t date, o struct<x:bigint,y:string>, a array<double>, m map<string,int>"


@pytest.mark.parametrize("record, bad, shown", [
    ('{"w": 1, "d": 2, "n": 1.5, "b": true, "s": "x", "t": "2024-01-02"}', False, ("w", 1)),
    ('{"w": 3000000000}', True, None), ('{"w": "1"}', True, None), ('{"w": 1.5}', True, None), ('{"w": null}', False, ("w", None)),
    ('{"d": 1.25e3}', False, ("d", 1250.0)), ('{"d": "1"}', True, None), ('{"d": "NaN"}', False, None),
    ('{"n": 123456.5}', True, None), ('{"b": 1}', True, None), ('{"b": "true"}', True, None),
    ('{"s": {"q": [1]}}', False, ("s", '{"q":[1]}')), ('{"t": "yesterday"}', True, None), ('{"t": 5}', True, None),
    ('{"o": {"x": 7, "z": 0}}', False, ("o", (7, None))), ('{"o": {"x": "7"}}', True, None), ('{"o": 5}', True, None),
    ('{"o": {}}', False, ("o", (None, None))), ('{"a": [1, 2.5, null]}', False, ("a", [1.0, 2.5, None])),
    ('{"a": [1, "2"]}', True, None), ('{"a": {"0": 1}}', True, None), ('{"m": {"k": 1}}', False, ("m", {"k": 1})),
    ('{"m": {"k": 1.5}}', True, None), ('{"else": 1}', False, ("w", None)), ('[]', True, None), ('"w"', True, None)])
def test_records_are_typed_by_what_json_says(spark, record, bad, shown):
    bodies = spark.createDataFrame([(1, f'{{"inputs": [{record}]}}')], "i int, body string")
    row, = read_score_requests(bodies, "body", KINDS, ["i"]).collect()
    assert row["reason"] == ("mistyped" if bad else None)
    if shown:
        assert row["rec"][shown[0]] == shown[1]


def test_odd_bodies(spark):
    bodies = spark.createDataFrame(
        [(1, ' \t\n{"k": 1} '), (2, '{"k": 1, "k": 2}'), (3, '{"k": 1} x'), (4, '{"\\u0069nputs": [{"k": 4}]}'),
         (5, '{"inputs": [' + ",".join(f'{{"k": {i}}}' for i in range(50_000)) + "]}"), (6, "{'k': 1}"),
         (7, '{"k": 1, "text": "say \\"inputs\\": [2]"}')], "i int, body string")
    counts = {(r["i"], r["reason"]): r["count"] for r in
              read_score_requests(bodies, "body", "k bigint", ["i"]).groupBy("i", "reason").count().collect()}
    assert counts == {(1, None): 1, (2, "malformed"): 1, (3, None): 1, (4, None): 1, (5, None): 50_000,
                      (6, "malformed"): 1, (7, None): 1}
    assert read_score_requests(bodies.limit(0), "body", "k bigint", ["i"]).count() == 0


def test_a_body_is_parsed_once(spark):
    bodies = spark.createDataFrame([(1, '{"k": 1}')], "i int, body string")
    for out in (parse_score_requests(bodies, "body", KINDS, ["i"]), request_rejects(bodies, "body", KINDS, ["i"], required=["w"])):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("parseJson(") == 1 and "from_json" not in plan


def test_signature_of_bodies(spark):
    df = spark.createDataFrame([("all", b) for b in BODIES] + [
        ("one", '{"a": 1, "b": {"c": 1.5}}'), ("one", '{"a": null, "b": {"c": 2, "d": ["x", null]}}'),
        ("one", '{"inputs": [{"a": 3000000000}, {}], "other": 1}'), (None, '{"n": null}'), ("none", "{}"), ("none", "[]")],
        "g string, body string")
    got = {(r.g, r.column_name): tuple(r)[2:] for r in infer_request_signature(df, "body", "g").collect()}
    # bodies 0, 10 and 11, and four objects of the list in body 1, are records
    assert got == {("all", "k"): ("VARIANT", 7, 5, 0, False),
                   ("all", "z"): ("BIGINT", 7, 1, 0, False),
                   ("one", "a"): ("BIGINT", 4, 3, 1, False),
                   ("one", "b"): ("OBJECT<c: DECIMAL(21,1), d: ARRAY<STRING>>", 4, 2, 0, False),
                   (None, "n"): ("VOID", 1, 1, 1, False)}
    whole = infer_request_signature(df.where("g = 'one'"), "body").collect()
    assert sorted(r.column_name for r in whole) == ["a", "b"]
    assert infer_request_signature(df.limit(0), "body", "g").collect() == []


@pytest.mark.parametrize("d", [1, 3, 40])
def test_train_linear_one_rule_for_every_width(spark, d):
    """Null, NaN and infinite rows are dropped and counted, collinear features fit, whatever d."""
    import numpy as np
    rng = np.random.default_rng(d)
    x = rng.normal(size=(400, d)) * rng.uniform(0.1, 100, d)
    if d > 1:
        x[:, -1] = 2 * x[:, 0]
    y = x @ np.arange(1, d + 1) + 7
    rows = [(*map(float, r), float(t)) for r, t in zip(x, y)]
    rows += [(*r[:-1], bad) for r, bad in zip(rows[:4], (None, float("nan"), float("inf"), None))]
    rows += [(bad, *r[1:]) for r, bad in zip(rows[4:7], (None, float("nan"), float("-inf")))]
    names = [f"f{i}" for i in range(d)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*names, "y"])).repartition(7)
    m = train_linear(df, names, "y")
    assert (m.n_rows, m.n_dropped) == (400, 7)
    fit = x @ np.array(m.coefficients) + m.intercept
    assert np.abs(fit - y).max() < 1e-6 * np.abs(y).max()
    if d > 1:  # the minimum-norm solution of the collinear pair
        c = 1 + 2 * d
        assert np.allclose([m.coefficients[0], m.coefficients[-1]], [c / 5, 2 * c / 5], atol=1e-6)
    with pytest.raises(ValueError):
        train_linear(df.limit(0), names, "y")


def test_score_batch_skips_lookup_with_all_features(spark, demo):
    model = LinearModel(("feature_1", "feature_2"), (1.0, 1.0), 0.0)
    full = spark.createDataFrame([(1, '{"inputs":[{"feature_1":1.0,"feature_2":10.0}]}')], "req int, body string")
    out = score_batch(full, "body", "feature_1 double, feature_2 double", model, id_cols=["req"])
    assert [r.prediction for r in out.collect()] == [11.0]
    keys = spark.createDataFrame([(1, '{"inputs":[{"id":2},{"id":42}]}')], "req int, body string")
    out = score_batch(keys, "body", "id bigint", model, features=demo, lookup_key="id", id_cols=["req"])
    assert sorted((r.id, r.prediction) for r in out.collect()) == [(2, 22.0), (42, None)]


def test_feature_function_pandas_path(spark, demo):
    import pandas as pd
    from featshare.operators import feature_spec

    def clip(a: pd.Series) -> pd.Series:
        return a.clip(upper=3.0)

    out = feature_spec(demo, [FeatureFunction("f_sql", "feature_1 * 2"),
                              FeatureFunction("f_py", clip, ("feature_1",))])
    got = sorted((r.f_sql, r.f_py) for r in out.collect())
    assert got == [(2.0, 1.0), (4.0, 2.0), (6.0, 3.0), (8.0, 3.0), (10.0, 3.0)]


def test_mount_share_reads_the_same_files(spark):
    from featshare.sources import mount_share
    from featshare.sources.shares import view_name
    from conftest import SF_SMALL

    objects = spark.createDataFrame([("prod.tpch.customer", "TABLE"), ("prod.tpch.m", "MODEL"),
                                     ("prod.tpch.gone", "TABLE")], "object_name string, object_type string")
    src = f"{SF_SMALL}/customer.parquet"
    out = {r.object_name: r for r in mount_share(spark, objects, "tgt", {"prod.tpch.customer": src}).collect()}
    assert set(out) == {"prod.tpch.customer", "prod.tpch.gone"}  # models get no view
    assert out["prod.tpch.customer"].mounted_name == "tgt.tpch.customer"
    assert out["prod.tpch.gone"].location is None
    mounted = spark.table(view_name("tgt.tpch.customer"))
    assert mounted.inputFiles() == spark.read.parquet(src).inputFiles()  # no copy
    assert mounted.count() == spark.read.parquet(src).count()


def test_read_share_is_one_scan(spark):
    root = work_dir(spark, "t-share")
    for i in range(4):
        df = spark.range(10 * i, 10 * i + 5).selectExpr("id", "id % 2 as p", "cast(id as string) as mounted")
        (df.write.partitionBy("p") if i == 3 else df.repartition(2).write).parquet(f"{root}/t {i}+%41")
    locations = spark.createDataFrame([(f"prod.s.t{i}", f"{root}/t {i}+%41") for i in range(4)] + [("prod.s.gone", None)],
                                      "object_name string, location string")
    rows = [(f"prod.s.t{i}", "TABLE") for i in (0, 1, 1)] + [("prod.s.t2", "MODEL"), ("prod.s.gone", "TABLE"), ("prod.s.x", "TABLE")]
    objects = spark.createDataFrame(rows, "object_name string, object_type string")
    out = read_share(objects, locations, "tgt")
    assert out.columns == ["mounted_name", "id", "p", "mounted"]
    assert sorted((r.mounted_name, r.id) for r in out.collect()) == \
        [("tgt.s.t0", i) for i in range(5)] + [("tgt.s.t1", i) for i in range(10, 15)]
    parted = spark.createDataFrame([("prod.s.t3", "TABLE")], "object_name string, object_type string")
    assert sorted((r.id, r.p) for r in read_share(parted, locations, "tgt").collect()) == [(i, i % 2) for i in range(30, 35)]
    assert read_share(objects.limit(0), locations, "tgt", "id long").count() == 0
    with pytest.raises(ValueError):
        read_share(objects.limit(0), locations, "tgt")


def test_wide_fit_matches_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(7)
    d, n = 40, 400
    x = rng.normal(size=(n, d))
    y = 3.0 + x @ rng.normal(size=d) + rng.normal(scale=0.01, size=n)
    cols = [f"f{i}" for i in range(d)]
    pdf = __import__("pandas").DataFrame(x, columns=cols).assign(target=y)
    df = spark.createDataFrame(pdf)
    model = train_linear(df, cols, "target")
    assert model.n_rows == n and model.n_dropped == 0
    want = np.linalg.lstsq(np.c_[np.ones(n), x], y, rcond=None)[0]
    assert abs(model.intercept - want[0]) < 1e-6
    assert np.allclose(model.coefficients, want[1:], atol=1e-6)
