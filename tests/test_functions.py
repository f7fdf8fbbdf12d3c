"""Column functions on the hand-written edge rows (FIXTURES.md section 4)."""

import json

from pyspark.sql import functions as F

from featshare.functions import (dns_name, endpoint_name, invocation_url, normalize_configs, online_name,
                                 result_json, secret_scan, shared_name, source_endpoint_name, state_class)
from featshare.functions.config import secret_key, secret_scope
from featshare.functions.states import error_class


def col_values(spark, values, expr, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_dns_name_edge_rows(spark):
    names = ["main-online-store", "_My__Cat_", "a..b", "--x__Y--", "É_ü", "", "___", "A-_-B", "a\tb c\nd", None]
    want = ["main-online-store", "my-cat", "ab", "x-y", "", "", "", "a-b", "abcd", None]
    assert col_values(spark, names, dns_name) == want


def test_shared_and_online_names(spark):
    names = ["c.s.t", "t", "s.t", "a.b.c.d", "c.s."]
    assert col_values(spark, names, lambda c: shared_name(c, "shared")) == \
        ["shared.s.t", "t", "s.t", "a.b.c.d", "shared.s."]
    assert col_values(spark, names, lambda c: online_name(c, "main", "default")) == \
        ["main.default.t_online", "main.default.t_online", "main.default.t_online",
         "main.default.d_online", "main.default._online"]


def test_endpoint_names(spark):
    assert col_values(spark, ["prod.ml.My_Model"], endpoint_name) == ["target-my-model-endpoint"]
    assert col_values(spark, ["My_Model"], source_endpoint_name) == ["source-My_Model-endpoint"]
    assert col_values(spark, ["ep"], lambda c: invocation_url("https://h", c)) == \
        ["https://h/serving-endpoints/ep/invocations"]


def test_secret_references(spark):
    vals = ["{{secrets/a/b}}", "{{secrets/a/b}}tail", "x{{secrets/a/b}}", "{{secrets/a/b/c}}", "plain", "", None]
    assert col_values(spark, vals, secret_scope) == ["a", "a", None, "a", None, None, None]
    assert col_values(spark, vals, secret_key) == ["b", "b", None, "b/c", None, None, None]
    df = spark.createDataFrame([(v,) for v in vals], "host string")
    got = {(r.scope, r.secret_key): r.n_refs for r in secret_scan(df, ["host"]).collect()}
    assert got == {("a", "b"): 2, ("a", "b/c"): 1}


def test_normalize_configs(spark):
    df = spark.createDataFrame([("", "NONE", "x", "True", None), ("y", "z", None, "yes", "TRUE")],
                               "a string, b string, c string, f1 string, f2 string")
    out = normalize_configs(df, ["a", "b", "c"], ["f1", "f2"]).collect()
    assert [tuple(r) for r in out] == [(None, None, "x", True, False), ("y", "z", None, False, True)]


def test_state_classes(spark):
    states = ["AVAILABLE", "UNAVAILABLE", "READY", "NOT_READY", "ONLINE", "ONLINE_PIPELINE_FAILED",
              "OFFLINE", "OFFLINE_FAILED", None, "OnlineStoreState.AVAILABLE"]
    # online tables keep the substring rule: an enum printed with its class name
    # ("OnlineStoreState...") contains ONLINE, so it counts as ready
    assert col_values(spark, states, lambda c: state_class("online_table", c)) == \
        ["waiting", "waiting", "waiting", "waiting", "ready", "ready", "waiting", "failed", "waiting", "ready"]
    assert col_values(spark, states, lambda c: state_class("online_store", c)) == \
        ["ready", "waiting", "waiting", "waiting", "waiting", "waiting", "waiting", "waiting", "waiting", "ready"]
    assert col_values(spark, states, lambda c: state_class("online_store", c, compat=True))[:2] == ["ready", "ready"]


def test_endpoint_state(spark):
    rows = [("READY", "NOT_UPDATING"), ("NOT_READY", "IN_PROGRESS"), ("READY", "IN_PROGRESS"),
            ("NOT_READY", "NOT_UPDATING"), ("NOT_READY", "UPDATE_FAILED"),
            ("EndpointStateReady.READY", "EndpointStateConfigUpdate.UPDATE_FAILED")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, r string, u string").orderBy("i")
    exact = [x[0] for x in df.select(state_class("endpoint", "r", "u")).collect()]
    compat = [x[0] for x in df.select(state_class("endpoint", "r", "u", compat=True)).collect()]
    assert exact == ["ready", "waiting", "waiting", "ready", "waiting", "ready"]
    assert compat == ["ready", "waiting", "waiting", "ready", "ready", "ready"]


def test_error_class(spark):
    msgs = ["Share does NOT EXIST", "Recipient not_found", "RESOURCE_DOES_NOT_EXIST: x", "NotFound",
            "Object already exists in share", "ALREADY_EXISTS", "Conflict: update in progress",
            "Update IN PROGRESS", "Permission denied", None]
    # RESOURCE_DOES_NOT_EXIST matches none of the substrings (underscores), as in the reference
    assert col_values(spark, msgs, error_class) == \
        ["not_found", "not_found", "other", "not_found", "already_exists", "already_exists",
         "conflict", "conflict", "other", "other"]


def test_result_json(spark):
    df = spark.createDataFrame([("s1", "c", 1)], "name string, comment string, n int")
    doc = json.loads(result_json(df).first()["result"])
    assert doc == {"status": "success", "data": {"name": "s1", "comment": "c", "n": 1}}
    kept = result_json(df, data_cols=["comment"]).first()
    assert kept["name"] == "s1" and json.loads(kept["result"])["data"] == {"comment": "c"}


def test_error_envelope(spark):
    from featshare.functions.envelope import error_json

    df = spark.createDataFrame([("ValueError", "Recipient r does not exist")], "t string, m string")
    doc = json.loads(df.select(error_json(F.col("t"), F.col("m")).alias("j")).first().j)
    assert doc == {"status": "error", "error_type": "ValueError", "message": "Recipient r does not exist"}
