"""Operators against brute force on small random inputs (hypothesis)."""

from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from featshare.operators import change_feed, change_feed_by_blocks, latest_model_version, readiness
from featshare.sources import apply_changes

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))

value = st.one_of(st.none(), st.sampled_from([0.0, 1.5, -2.0]))
label = st.one_of(st.none(), st.sampled_from(["a", "b"]))
table = st.dictionaries(st.integers(0, 30), st.tuples(value, label), max_size=25)


def frame(spark, d):
    rows = [(k, v, s) for k, (v, s) in d.items()]
    return spark.createDataFrame(rows, "id bigint, v double, s string")


@SETTINGS
@given(before=table, after=table)
def test_change_feed_applied_to_before_gives_after(spark, before, after):
    b, a = frame(spark, before), frame(spark, after)
    changes = change_feed(b, a, ["id"])
    kinds = {}
    for r in changes.collect():
        kinds.setdefault(r.id, set()).add(r.change_type)
    for k in set(before) | set(after):
        want = (set() if before.get(k) == after.get(k) and k in before and k in after
                else {"insert"} if k not in before else {"delete"} if k not in after
                else {"update_preimage", "update_postimage"})
        assert kinds.get(k, set()) == want
    got = sorted(tuple(r) for r in apply_changes(b, changes, ["id"]).collect())
    assert got == sorted((k, v, s) for k, (v, s) in after.items())


@SETTINGS
@given(before=table, after=table, block=st.sampled_from([None, "id div 4", "0", "id"]))
def test_blocks_lose_no_change(spark, before, after, block):
    b, a = frame(spark, before), frame(spark, after)
    want = sorted(map(str, change_feed(b, a, ["id"]).collect()))
    assert sorted(map(str, change_feed_by_blocks(b, a, ["id"], block, n_blocks=5).collect())) == want


@SETTINGS
@given(versions=st.lists(st.tuples(st.sampled_from(["m1", "m2", "m3"]),
                                   st.integers(0, 10 ** 6), st.booleans()), min_size=1, max_size=30,
                         unique_by=lambda t: (t[0], t[1])))
def test_latest_version_is_numeric_max(spark, versions):
    rows = [(m, (f"0{n}" if pad else str(n)), f"r{n}") for m, n, pad in versions]
    df = spark.createDataFrame(rows, "model_name string, version string, run_id string")
    got = {r.model_name: int(r.version) for r in latest_model_version(df).collect()}
    want = {}
    for m, n, _ in versions:
        want[m] = max(want.get(m, -1), n)
    assert got == want


STATES = ["ONLINE", "PROVISIONING", "OFFLINE", "OFFLINE_FAILED", "ONLINE_PIPELINE_FAILED", None]


def _cls(s):
    u = (s or "").upper()
    if "ONLINE" in u and "OFFLINE" not in u:
        return "ready"
    return "failed" if "FAILED" in u else "waiting"


@SETTINGS
@given(log=st.lists(st.tuples(st.sampled_from(["x", "y", "z"]), st.integers(0, 500),
                              st.sampled_from(STATES)), min_size=1, max_size=40,
                    unique_by=lambda t: (t[0], t[1])),
       timeout=st.integers(1, 300))
def test_readiness_matches_scan(spark, log, timeout):
    t0 = datetime(2024, 1, 1)
    rows = [(o, t0 + timedelta(seconds=s), st_) for o, s, st_ in log]
    df = spark.createDataFrame(rows, "object_name string, ts timestamp_ntz, state string")
    got = {r.object_name: (r.verdict, r.decided_at) for r in readiness(df, timeout).collect()}
    want = {}
    for o in {r[0] for r in rows}:
        ev = sorted((ts, s) for oo, ts, s in rows if oo == o)
        start = ev[0][0]
        verdict = ("timeout", None)
        for ts, s in ev:
            if ts >= start + timedelta(seconds=timeout):
                break
            if _cls(s) in ("ready", "failed"):
                verdict = (_cls(s), ts)
                break
        want[o] = verdict
    assert got == want
