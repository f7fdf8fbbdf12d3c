"""Decision tables and registry rules on hand-written rows."""

from datetime import datetime

from featshare.operators import (latest_model_version, poll_samples, readiness, recipient_plan,
                                 validate_run_configs, validate_target_configs, versions_desc)
from featshare.operators.registry import distinct_dependencies, flatten_dependencies, version_rejects
from featshare.plans import deployment_decision

REQ = ("model_name string, share_name string, recipient_name string, target_metastore_id string, "
       "source_metastore_id string, create_recipient boolean")


def test_recipient_plan_decision_table(spark):
    reqs = spark.createDataFrame([
        ("m1", "s", "same", "ms-1", "ms-1", True),
        ("m2", "s", "tok", "ms-2", "ms-1", True),
        ("m3", "s", "d2d", "ms-2", "ms-1", True),
        ("m4", "s", "new", "ms-2", "ms-1", True),
        ("m5", "s", "new", "ms-2", "ms-1", False),
        ("m6", "s", "tok", None, "ms-1", False),
        ("m7", "s", "new", None, "ms-1", True),
        ("m8", "s", "new", "", "ms-1", False)], REQ)
    recips = spark.createDataFrame([("tok", "TOKEN", None), ("d2d", "DATABRICKS", "ms-9"),
                                    ("same", "DATABRICKS", "ms-1")],
                                   "recipient_name string, authentication_type string, global_metastore_id string")
    got = {r.model_name: (r.recipient_name, r.action, r.effective_auth)
           for r in recipient_plan(reqs, recips).collect()}
    assert got == {
        "m1": ("self", "use_self", "DATABRICKS"), "m2": ("tok", "keep_token_warn", "TOKEN"),
        "m3": ("d2d", "update_metastore", "DATABRICKS"), "m4": ("new", "create_d2d", "DATABRICKS"),
        "m5": ("new", "error", None), "m6": ("tok", "keep", "TOKEN"),
        "m7": ("new", "create_token", "TOKEN"), "m8": ("new", "error", None)}


def test_deployment_decision_table(spark):
    rows = [(c, n, r, d) for c in (True, False) for n in (0, 2) for r in (True, False) for d in (True, False)]
    df = spark.createDataFrame(rows, "create_online_table boolean, n_tables int, all_ready boolean, deploy_serving boolean")
    got = {(r.create_online_table, r.n_tables, r.all_ready, r.deploy_serving): (r.online_step, r.tables_ready, r.deploy)
           for r in deployment_decision(df).collect()}
    assert got[(True, 2, True, True)] == ("run", True, "yes")
    assert got[(True, 2, False, True)] == ("run", False, "blocked")
    assert got[(True, 0, False, True)] == ("skip_none_needed", True, "yes")
    assert got[(False, 2, True, True)] == ("disabled", False, "blocked")
    assert got[(False, 0, True, True)] == ("disabled", False, "yes")
    assert {v[2] for k, v in got.items() if not k[3]} == {"off"}


def test_target_config_rules(spark):
    df = spark.createDataFrame([
        (1, "s", "self", "c", True, "main", "default"),
        (2, "", "self", "c", True, "", "NONE"),
        (3, None, "", "", False, "", ""),
        (4, "NONE", "p", "c", False, "x", "y")],
        "config_id int, share_name string, provider_name string, target_catalog string, "
        "create_online_table boolean, online_table_target_catalog string, online_table_target_schema string")
    got = sorted((r.config_id, r.rule) for r in validate_target_configs(df).collect())
    assert got == [(2, 1), (2, 4), (2, 5), (3, 1), (3, 2), (3, 3), (4, 1)]


def test_run_config_mode_rule(spark):
    df = spark.createDataFrame([
        (1, "source", "m", "s", "r", None, None, None, None),
        (2, "source", "m", "NONE", "", None, None, None, None),
        (3, "target", None, "s", None, "p", "c", "h", "t"),
        (4, "target", None, "s", None, "p", "c", "", None),
        (5, "other", None, None, None, None, None, None, None)],
        "config_id int, mode string, model_name string, share_name string, recipient_name string, "
        "provider_name string, target_catalog string, target_host string, target_token string")
    got = {r.config_id: (r.valid, r.missing_fields) for r in validate_run_configs(df).collect()}
    assert got == {1: (True, ""), 2: (False, "share_name,recipient_name"), 3: (True, ""),
                   4: (False, "target_host,target_token"), 5: (False, "mode")}


def test_versions_compare_as_numbers(spark):
    mv = spark.createDataFrame([("a", "9", "r9"), ("a", "10", "r10"), ("a", "2", "r2"), ("a", "x", "bad"),
                                ("b", "1", "r1")], "model_name string, version string, run_id string")
    got = {r.model_name: (r.version, r.run_id) for r in latest_model_version(mv).collect()}
    assert got == {"a": ("10", "r10"), "b": ("1", "r1")}
    assert [r.version for r in version_rejects(mv).collect()] == ["x"]
    top = versions_desc(mv, 2).where("model_name = 'a'").orderBy("version_rank").collect()
    assert [r.version for r in top] == ["10", "9"]


def test_nested_dependencies_first_seen(spark):
    schema = ("model_name string, version string, dependencies array<struct<table: struct<table_full_name: string>, "
              "function: struct<function_full_name: string>>>")
    deps = [{"table": {"table_full_name": "c.s.t2"}, "function": None},
            {"table": None, "function": {"function_full_name": "c.s.f"}},
            {"table": {"table_full_name": "c.s.t1"}, "function": None},
            {"table": {"table_full_name": "c.s.t2"}, "function": None}]
    df = spark.createDataFrame([("m", "1", deps)], schema)
    flat = distinct_dependencies(flatten_dependencies(df))
    got = sorted((r.pos, r.dep_type, r.dep_name) for r in flat.collect())
    assert got == [(1, "TABLE", "c.s.t2"), (2, "FUNCTION", "c.s.f"), (3, "TABLE", "c.s.t1")]


def test_readiness_ready_first_and_timeout(spark):
    t = lambda s: datetime(2024, 1, 1, 0, 0, s)
    ev = spark.createDataFrame([
        ("a", t(0), "PROVISIONING"), ("a", t(5), "ONLINE_PIPELINE_FAILED"), ("a", t(9), "OFFLINE_FAILED"),
        ("b", t(0), "PROVISIONING"), ("b", t(3), "OFFLINE_FAILED"),
        ("c", t(0), "PROVISIONING"), ("c", t(50), "ONLINE")],
        "object_name string, ts timestamp_ntz, state string")
    got = {r.object_name: (r.verdict, r.decided_at) for r in readiness(ev, 30).collect()}
    assert got == {"a": ("ready", t(5)), "b": ("failed", t(3)), "c": ("timeout", None)}
    later = {r.object_name: r.verdict for r in readiness(ev, 30, start=t(4)).collect()}
    assert later == {"a": "ready", "c": "timeout"}  # b has no event after the start
    waited = readiness(ev, 30, start=t(4), objects=ev.select("object_name"))
    assert {r.object_name: r.verdict for r in waited.collect()} == {"a": "ready", "b": "timeout", "c": "timeout"}
    polls = poll_samples(ev, 15).where("object_name = 'a'").orderBy("window_start").collect()
    assert [(p.state, p.state_class, p.n_events) for p in polls] == [("OFFLINE_FAILED", "failed", 3)]


def test_dependency_summary_tells_none_from_unreadable(spark):
    from featshare.operators import dependency_summary

    deps = spark.createDataFrame([
        ("m", "1", 1, "TABLE", "c.s.t2"), ("m", "1", 2, "CONNECTION", "c.s.conn"),
        ("m", "1", 3, "TABLE", None), ("m", "1", 4, "FUNCTION", "c.s.f"), ("m", "1", 5, "TABLE", "c.s.t2"),
        ("m", "2", 1, "TABLE", "c.s.x")],
        "model_name string, version string, pos int, dep_type string, dep_name string")
    versions = spark.createDataFrame([("m", "1"), ("n", "7")], "model_name string, version string")
    got = {r.model_name: r for r in dependency_summary(versions, deps).collect()}
    m, n = got["m"], got["n"]
    assert (m.tables, m.functions, m.n_other_types, m.n_unreadable) == (["c.s.t2"], ["c.s.f"], 1, 1)
    assert [s.table_name_short for s in m.online_table_specs] == ["t2"]
    assert (n.tables, n.functions, n.n_tables, n.n_other_types, n.n_unreadable, n.has_feature_lookups) == \
        ([], [], 0, 0, 0, False)


def test_staging_does_not_change_plan_results(spark):
    from featshare.plans import source_plan, target_plan
    from featshare.sources.fixtures import Fixtures

    fx = Fixtures(spark, "/root/testdata/sf0.001")
    args = (fx.share_requests, fx.model_versions, fx.dependencies, fx.share_objects, fx.share_grants,
            fx.recipients)
    a, b = source_plan(*args, stage=True)["summary"], source_plan(*args, stage=False)["summary"]
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    targs = (fx.registered_models, fx.model_versions, fx.dependencies, fx.table_status_events, fx.catalog_settings,
             fx.catalogs, fx.publish_outcomes, fx.online_stores, "https://h", 21600)
    c, d = target_plan(*targs, stage=True)["summary"], target_plan(*targs, stage=False)["summary"]
    assert sorted(map(repr, c.collect())) == sorted(map(repr, d.collect()))
