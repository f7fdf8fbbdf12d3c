"""Registered queries of the feature data path and the change and publish path."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from featshare.functions.model import FeatureFunction, feature_function, predict
from featshare.operators.changes import change_feed, change_feed_by_blocks, snapshot_as_of
from featshare.operators.lookup import FeatureLookup, create_training_set, feature_lookup, feature_spec
from featshare.operators.training import model_frame, score_batch, train_linear
from featshare.plans.registry import register
from featshare.session import work_dir
from featshare.sources.feature_tables import (check_not_null, check_primary_key, create_feature_table,
                                              drop_feature_table, ensure_feature_table,
                                              ensure_registered_table, read_feature_table, register_feature_table,
                                              table_location)
from featshare.sources.fixtures import Fixtures, base
from featshare.sources.publish import (current_version, publish_changes, publish_many, publish_snapshot,
                                       read_published)
from featshare.sources.requests import infer_request_signature, parse_score_requests, request_rejects
from featshare.sources.shares import mount_share, read_share, view_name

# ---------------------------------------------------------------- flagship (entry)

def training_by_segment(spark, sf_dir):
    """S1 + J1 + J2 on orders x customer: the training set of order totals with customer
    features, summarised per market segment."""
    cust = read_feature_table(spark, f"{sf_dir}/customer.parquet",
                              columns=["c_custkey", "c_acctbal", "c_mktsegment"])
    labels = base(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("id"),
        F.col("o_totalprice").alias("target"))
    ts = create_training_set(
        labels, [FeatureLookup(cust, ("c_acctbal", "c_mktsegment"), "id", "c_custkey")],
        label="target", exclude_columns=["row_id"])
    return ts.groupBy(F.col("c_mktsegment").alias("segment")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("c_acctbal").alias("n_matched"),
        F.round(F.sum("target"), 2).alias("sum_target"),
        F.round(F.avg("c_acctbal"), 6).alias("avg_acctbal"))


register("j2_training_set_by_segment", oracle="""
select c.c_mktsegment as segment, count(*) as n_rows, count(c.c_acctbal) as n_matched,
       round(sum(o.o_totalprice), 2) as sum_target, round(avg(c.c_acctbal), 6) as avg_acctbal
from orders o left join customer c on o.o_custkey = c.c_custkey
group by c.c_mktsegment""")(training_by_segment)


# ---------------------------------------------------------------- S1-S4, K1, K2, P1

@register("s1_read_feature_table", oracle="""
select c_custkey, c_mktsegment, c_acctbal from customer where c_acctbal > 0""")
def s1(spark, sf_dir):
    return read_feature_table(spark, f"{sf_dir}/customer.parquet",
                              columns=["c_custkey", "c_mktsegment", "c_acctbal"],
                              where=F.col("c_acctbal") > 0)


@register("s2_create_feature_table", fixtures=["features_v0"], oracle="""
select id, feature_1, feature_2, segment from features_v0""")
def s2(spark, sf_dir):
    path = work_dir(spark, "s2")
    create_feature_table(Fixtures(spark, sf_dir).features_v0, path, ["id"], "customer features")
    return read_feature_table(spark, path)


@register("s3_ensure_feature_table", fixtures=["features_v1"], oracle="""
select id, feature_1, feature_2, segment, 'created,reused,recreated' as outcomes from features_v1""")
def s3(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    p1, p2 = work_dir(spark, "s3a"), work_dir(spark, "s3b")
    o1 = ensure_feature_table(fx.features_v0, p1, ["id"], "v0")
    o2 = ensure_feature_table(fx.features_v0, p1, ["id"], "v0")
    fx.features_v0.write.parquet(p2)  # a folder that is not a feature table
    o3 = ensure_feature_table(fx.features_v1, p2, ["id"], "v1")
    return read_feature_table(spark, p2).withColumn("outcomes", F.lit(",".join([o1, o2, o3])))


@register("s3_ensure_registered_table", oracle="""
select l_orderkey, l_linenumber, max(l_quantity) as l_quantity, max(l_quantity * l_extendedprice) as worth,
       'created,reused,recreated' as outcomes from lineitem group by l_orderkey, l_linenumber""")
def s3_registered(spark, sf_dir):
    """Order lines behind a catalog name, recreated with other keys and one more column."""
    lines = base(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    old = lines.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("l_linenumber"), F.max("l_quantity").alias("l_quantity"))
    new = lines.groupBy("l_orderkey", "l_linenumber").agg(
        F.max("l_quantity").alias("l_quantity"), F.max(F.expr("l_quantity * l_extendedprice")).alias("worth"))
    root, name = work_dir(spark, "s3r"), f"fs_{uuid.uuid4().hex[:10]}"
    outcomes = [ensure_registered_table(old, name, root, ["l_orderkey"]),
                ensure_registered_table(old, name, root, ["l_orderkey"])]
    outcomes.append(ensure_registered_table(new, name, root, ["l_orderkey", "l_linenumber"]))
    out = read_feature_table(spark, table_location(spark, name)).withColumn("outcomes", F.lit(",".join(outcomes)))
    drop_feature_table(spark, name)
    return out


@register("s4_drop_feature_table", fixtures=["features_v0"], oracle="""
select id, feature_1, feature_2, segment, 'true,false' as dropped, false as still_registered
from features_v0""")
def s4(spark, sf_dir):
    path = work_dir(spark, "s4")
    create_feature_table(Fixtures(spark, sf_dir).features_v0, path, ["id"])
    name = f"fs_{uuid.uuid4().hex[:10]}"
    register_feature_table(spark, name, path)
    first = drop_feature_table(spark, name)
    second = drop_feature_table(spark, name)
    return (read_feature_table(spark, path)
            .withColumn("dropped", F.lit(f"{str(first).lower()},{str(second).lower()}"))
            .withColumn("still_registered", F.lit(spark.catalog.tableExists(name))))


@register("k1_check_not_null", fixtures=["features_v1"], oracle="""
select id, feature_1, feature_2, segment from features_v1 where segment is null""")
def k1(spark, sf_dir):
    return check_not_null(Fixtures(spark, sf_dir).features_v1, ["segment"])


@register("k2_check_primary_key", oracle="""
select l_orderkey, l_linenumber, count(*) as n_rows from lineitem
group by l_orderkey, l_linenumber having count(*) > 1""")
def k2(spark, sf_dir):
    return check_primary_key(base(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@register("p1_select_features", fixtures=["features_v1"], oracle="""
select id, segment as label, feature_1, feature_2 from features_v1""")
def p1(spark, sf_dir):
    return Fixtures(spark, sf_dir).features_v1.select("id", F.col("segment").alias("label"),
                                                      "feature_1", "feature_2")


@register("l1_input_example", fixtures=["features_v0"], oracle="""
select id, feature_1, feature_2 from features_v0 order by feature_1 desc, id limit 5""")
def l1(spark, sf_dir):
    # top-k is the feature here: a few rows kept beside the model (TakeOrdered plan)
    return (Fixtures(spark, sf_dir).features_v0.select("id", "feature_1", "feature_2")
            .orderBy(F.col("feature_1").desc(), "id").limit(5))


# ---------------------------------------------------------------- S6, S7

# what score_requests holds, record by record: the good ones and the bad ones with their reason
REQUEST_CTES = {
    "received": """
select event_id, 0 as pos, cast(json_extract(props, '$.k') as bigint) as k, null as reason, props as record
from events where event_id % 8 in (0, 7)
union all select event_id, 0, user_id, null, null from events where event_id % 8 in (1, 2)
union all select event_id, 1, user_id + 1, null, null from events where event_id % 8 = 1
union all select event_id, 4, null, null, null from events where event_id % 8 = 2
union all select event_id, 1, null, 'null_record', null from events where event_id % 8 = 2
union all select event_id, 2, null, 'mistyped', '{"k":"x"}' from events where event_id % 8 = 2
union all select event_id, 3, null, 'mistyped', '5' from events where event_id % 8 = 2
union all select event_id, 0, null, 'mistyped', '{"k": "x"}' from events where event_id % 8 = 3
union all select event_id, 0, null, 'malformed', '{"k": ' || user_id from events where event_id % 8 = 4
union all select event_id, 0, null, 'inputs_not_a_list', '{"inputs": ' || user_id || '}' from events where event_id % 8 = 6""",
    "good": "select event_id, pos, k from received where reason is null",
}


@register("s6_parse_score_requests", ctes=REQUEST_CTES, oracle="select event_id, pos, k from good")
def s6(spark, sf_dir):
    return parse_score_requests(Fixtures(spark, sf_dir).score_requests, "body", "k bigint", ["event_id"])


@register("p2_request_rejects", ctes=REQUEST_CTES, oracle="""
select event_id, pos, coalesce(reason, 'missing') as reason,
       case when reason is null then '{"k":null}' else record end as record
from received where reason is not null or k is null""")
def p2_rejects(spark, sf_dir):
    """Requests against a recorded signature whose field is required."""
    return request_rejects(Fixtures(spark, sf_dir).score_requests, "body", "k bigint", ["event_id"], required=["k"])


@register("p2_infer_signature", ctes={**REQUEST_CTES, "fields": """
select e.user_id, e.event_id % 8 as client, case when reason is not null then 'STRING' when k is null then 'VOID' else 'BIGINT' end as kind
from received r join events e on r.event_id = e.event_id where reason is null or record like '{"k":%"x"}'"""}, oracle="""
select user_id, client, 'k' as column_name,
       case when count(distinct kind) filter (kind <> 'VOID') > 1 then 'VARIANT' else coalesce(max(kind) filter (kind <> 'VOID'), 'VOID') end as type,
       count(*) as n_records, count(*) as n_present, count(*) filter (kind = 'VOID') as n_null,
       count(*) filter (kind = 'VOID') = 0 as required
from fields group by user_id, client""")
def p2_infer(spark, sf_dir):
    """The signature that the requests of each user's clients show."""
    requests = Fixtures(spark, sf_dir).score_requests.withColumn("client", F.col("event_id") % 8)
    return infer_request_signature(requests, "body", ["user_id", "client"])


MOUNTED = ["customer", "orders", "part", "supplier"]


@register("s7_mount_share", oracle="""
select 'shared_cat.tpch.customer' as mounted_name, count(*) as n_rows, round(sum(c_acctbal), 2) as checksum from customer
union all select 'shared_cat.tpch.orders', count(*), round(sum(o_totalprice), 2) from orders
union all select 'shared_cat.tpch.part', count(*), round(sum(p_retailprice), 2) from part
union all select 'shared_cat.tpch.supplier', count(*), round(sum(s_acctbal), 2) from supplier""")
def s7(spark, sf_dir):
    objects = spark.createDataFrame([(f"prod.tpch.{t}", "TABLE") for t in MOUNTED]
                                    + [("prod.tpch.model", "MODEL")], "object_name string, object_type string")
    locations = {f"prod.tpch.{t}": f"{sf_dir}/{t}.parquet" for t in MOUNTED}
    mounted = mount_share(spark, objects, "shared_cat", locations)
    measure = {"customer": "c_acctbal", "orders": "o_totalprice", "part": "p_retailprice",
               "supplier": "s_acctbal"}
    # one union of the mounted views, name as a column, aggregated once
    rows = None
    for r in mounted.collect():  # the mounts of one share
        t = r["mounted_name"].rsplit(".", 1)[1]
        v = spark.table(view_name(r["mounted_name"])).select(
            F.lit(r["mounted_name"]).alias("mounted_name"), F.col(measure[t]).cast("double").alias("v"))
        rows = v if rows is None else rows.unionByName(v)
    return rows.groupBy("mounted_name").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("v"), 2).alias("checksum"))


@register("s7_read_share", oracle="""
select 'shared_cat.sales.orders_' || lower(substr(o_orderpriority, 1, 1)) as mounted_name, o_orderkey, o_custkey, o_totalprice
from orders where o_orderpriority not like '5%'""")
def s7_share(spark, sf_dir):
    """Orders kept as a table per priority; a share of all but one of them, read in one scan."""
    root = work_dir(spark, "s7")
    orders = base(spark, sf_dir, "orders").select(
        F.concat(F.lit("orders_"), F.lower(F.substring("o_orderpriority", 1, 1))).alias("tbl"), "o_orderkey", "o_custkey", "o_totalprice")
    orders.write.partitionBy("tbl").parquet(root)
    tables = orders.select("tbl").distinct().select(
        F.concat(F.lit("prod.sales."), "tbl").alias("object_name"), F.lit("TABLE").alias("object_type"),
        F.concat(F.lit(f"{root}/tbl="), "tbl").alias("location"))
    shared = tables.where("object_name not like '%_5'").select("object_name", "object_type")
    return read_share(shared, tables.select("object_name", "location"), "shared_cat")


# ---------------------------------------------------------------- S8-S10

@register("s8_publish_snapshot", fixtures=["features_v1"], oracle="""
select id, feature_1, feature_2, segment from features_v1""")
def s8(spark, sf_dir):
    target = work_dir(spark, "s8")
    publish_snapshot(Fixtures(spark, sf_dir).features_v1, target, ["id"])
    return read_published(spark, target)


@register("s9_publish_changes", fixtures=["features_v1"], oracle="""
select id, feature_1, feature_2, segment from features_v1""")
def s9(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    target = work_dir(spark, "s9")
    publish_snapshot(fx.features_v0, target, ["id"])
    publish_changes(spark, target, change_feed(fx.features_v0, fx.features_v1, ["id"]), ["id"])
    return read_published(spark, target)


BATCHES = 3


@register("s9_publish_unordered", fixtures=["change_rows"], oracle="""
select c.user_id, c.commit_version, c.commit_ts, c.value
from change_rows c join (
    select user_id, max(commit_version) as v from change_rows
    where change_type <> 'update_preimage' group by user_id) m
  on c.user_id = m.user_id and c.commit_version = m.v
where c.change_type <> 'delete'""")
def s9_unordered(spark, sf_dir):
    """All changes in batches that mix old and new, the last batch replayed: the copy holds
    the last change per key."""
    changes = Fixtures(spark, sf_dir).change_rows
    target = work_dir(spark, "s9u")
    columns = ["user_id", "commit_version", "commit_ts", "value"]
    publish_snapshot(changes.select(*columns).limit(0), target, ["user_id"])
    for i in (2, 0, 1, 1):
        publish_changes(spark, target, changes.where(F.col("commit_version") % BATCHES == i), ["user_id"],
                        "commit_version")
    return read_published(spark, target).select(*columns)


@register("s10_publish_many", fixtures=["features_v0", "features_v1"], oracle="""
select 'prod.ml.features_v0' as source_table_name, 'main.default.features_v0_online' as online_table_name,
       'published' as outcome, cast(null as varchar) as error_class, (select count(*) from features_v0) as n_rows
union all
select 'prod.ml.features_v1', 'main.default.features_v1_online', 'published', null, (select count(*) from features_v1)
union all
select 'prod.ml.lineitem', 'main.default.lineitem_online', 'failed', 'other', null
union all
select 'prod.other.features_v0', 'main.default.features_v0_online', 'exists', null, (select count(*) from features_v0)""")
def s10(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    root = work_dir(spark, "s10")
    tables = [
        ("prod.ml.features_v0", "main.default.features_v0_online", fx.features_v0, ["id"]),
        ("prod.ml.features_v1", "main.default.features_v1_online", fx.features_v1, ["id"]),
        ("prod.ml.lineitem", "main.default.lineitem_online", fx.lineitem, ["l_orderkey", "l_linenumber"]),
        ("prod.other.features_v0", "main.default.features_v0_online", fx.features_v0, ["id"]),
    ]
    outcomes = publish_many(spark, tables, root)
    counts = None
    for online in sorted({t[1] for t in tables}):
        target = f"{root}/{online}"
        if current_version(spark, target) is not None:
            c = read_published(spark, target).agg(F.lit(online).alias("online_table_name"),
                                                   F.count(F.lit(1)).alias("n_rows"))
            counts = c if counts is None else counts.unionByName(c)
    out = outcomes.select("source_table_name", "online_table_name", "outcome", "error_class")
    return out.join(counts, "online_table_name", "left") if counts is not None else \
        out.withColumn("n_rows", F.lit(None).cast("bigint"))


# ---------------------------------------------------------------- J1, J2, D1, D4

@register("j1_feature_lookup", fixtures=["labels_frame", "feature_gap"], oracle="""
select l.row_id, l.id, l.target, g.feature_1, g.feature_2
from labels_frame l left join feature_gap g on l.id = g.id""")
def j1(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return feature_lookup(fx.labels_frame, fx.feature_gap, "id", ["feature_1", "feature_2"])


@register("j2_create_training_set", fixtures=["labels_frame", "feature_gap", "features_v0"], oracle="""
select l.id, l.target, g.feature_1, g.feature_2, v.segment
from labels_frame l left join feature_gap g on l.id = g.id left join features_v0 v on l.id = v.id""")
def j2(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return create_training_set(
        fx.labels_frame,
        [FeatureLookup(fx.feature_gap, ("feature_1", "feature_2"), "id"),
         FeatureLookup(fx.features_v0, ("segment",), "id")],
        label="target", exclude_columns=["row_id"])


@register("d1_feature_function", fixtures=["labels_frame", "feature_gap"], oracle="""
select l.row_id, g.feature_1 * g.feature_2 as f_mul,
       round(l.target / nullif(g.feature_2, 0), 6) as f_ratio
from labels_frame l left join feature_gap g on l.id = g.id""")
def d1(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    df = feature_lookup(fx.labels_frame, fx.feature_gap, "id", ["feature_1", "feature_2"])
    df = feature_function(df, FeatureFunction("f_mul", "feature_1 * feature_2"))
    df = feature_function(df, FeatureFunction("f_ratio", "round(target / nullif(feature_2, 0), 6)"))
    return df.select("row_id", "f_mul", "f_ratio")


@register("d4_feature_spec", fixtures=["labels_frame", "feature_gap", "features_v0"], oracle="""
select l.row_id, l.id, l.target, g.feature_1, g.feature_2,
       round(g.feature_1 / nullif(g.feature_2, 0), 6) as f_ratio, v.segment as v0_segment
from labels_frame l left join feature_gap g on l.id = g.id left join features_v0 v on l.id = v.id""")
def d4(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    spec = [FeatureLookup(fx.feature_gap, ("feature_1", "feature_2"), "id"),
            FeatureFunction("f_ratio", "round(feature_1 / nullif(feature_2, 0), 6)"),
            FeatureLookup(fx.features_v0, ("segment",), "id", rename={"segment": "v0_segment"})]
    return feature_spec(fx.labels_frame, spec)


# ---------------------------------------------------------------- A4, D2, D3

def fitted(spark, sf_dir):
    """A4 on the J2 training set of order totals with gap-feature lookups."""
    fx = Fixtures(spark, sf_dir)
    ts = create_training_set(fx.labels_frame,
                             [FeatureLookup(fx.feature_gap, ("feature_1", "feature_2"), "id")],
                             label="target", exclude_columns=["row_id", "id"])
    return train_linear(ts, ["feature_1", "feature_2"], "target")


OLS_CTES = {
    "ts": """select l.target as y, g.feature_1 as x1, g.feature_2 as x2
             from labels_frame l join feature_gap g on l.id = g.id
             where l.target is not null and g.feature_1 is not null and g.feature_2 is not null""",
    "st": """select count(*) as n, avg(y) as my, avg(x1) as m1, avg(x2) as m2,
                    covar_pop(x1, x1) as c11, covar_pop(x1, x2) as c12, covar_pop(x2, x2) as c22,
                    covar_pop(x1, y) as c1y, covar_pop(x2, y) as c2y from ts""",
    "ols": """select *, (c22 * c1y - c12 * c2y) / (c11 * c22 - c12 * c12) as b1,
                        (c11 * c2y - c12 * c1y) / (c11 * c22 - c12 * c12) as b2 from st""",
    "model": "select *, my - b1 * m1 - b2 * m2 as b0 from ols",
}


@register("a4_train_linear", fixtures=["labels_frame", "feature_gap"], ctes=OLS_CTES, oracle="""
select n as n_rows, (select count(*) from labels_frame) - n as n_dropped, round(b0, 6) as intercept,
       round(b1, 8) as coef_feature_1, round(b2, 8) as coef_feature_2 from model""")
def a4(spark, sf_dir):
    m = fitted(spark, sf_dir)
    return model_frame(spark, m, digits=6).select(
        "n_rows", "n_dropped", "intercept",
        F.round("coef_feature_1", 8).alias("coef_feature_1"),
        F.round("coef_feature_2", 8).alias("coef_feature_2"))


@register("d2_predict", fixtures=["labels_frame", "feature_gap"], ctes=OLS_CTES, oracle="""
select l.row_id, round((select b0 from model) + (select b1 from model) * g.feature_1
                       + (select b2 from model) * g.feature_2, 2) as prediction
from labels_frame l join feature_gap g on l.id = g.id""")
def d2(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    m = fitted(spark, sf_dir)
    rows = feature_lookup(fx.labels_frame, fx.feature_gap, "id", ["feature_1", "feature_2"]) \
        .where("feature_1 is not null and feature_2 is not null")
    return predict(rows, m).select("row_id", F.round("prediction", 2).alias("prediction"))


SCORED = """
select e.event_id, e.pos, e.k, g.feature_1, g.feature_2,
       round((select b0 from model) + (select b1 from model) * g.feature_1
             + (select b2 from model) * g.feature_2, 2) as prediction
from good e left join feature_gap g on e.k = g.id"""


@register("d3_score_batch", fixtures=["labels_frame", "feature_gap"], ctes={**OLS_CTES, **REQUEST_CTES}, oracle=SCORED)
def d3(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    m = fitted(spark, sf_dir)
    out = score_batch(fx.score_requests, "body", "k bigint", m, features=fx.feature_gap,
                      lookup_key="k", table_key="id", id_cols=["event_id"])
    return out.withColumn("prediction", F.round("prediction", 2))


# ---------------------------------------------------------------- J7, W5

@register("j7_change_feed", fixtures=["features_v0", "features_v1"], oracle="""
select a.id, a.feature_1, a.feature_2, a.segment, 'insert' as change_type
from features_v1 a where not exists (select 1 from features_v0 b where b.id = a.id)
union all
select b.id, b.feature_1, b.feature_2, b.segment, 'delete'
from features_v0 b where not exists (select 1 from features_v1 a where a.id = b.id)
union all
select b.id, b.feature_1, b.feature_2, b.segment, 'update_preimage'
from features_v0 b join features_v1 a on a.id = b.id
where b.feature_1 is distinct from a.feature_1 or b.feature_2 is distinct from a.feature_2
   or b.segment is distinct from a.segment
union all
select a.id, a.feature_1, a.feature_2, a.segment, 'update_postimage'
from features_v0 b join features_v1 a on a.id = b.id
where b.feature_1 is distinct from a.feature_1 or b.feature_2 is distinct from a.feature_2
   or b.segment is distinct from a.segment""")
def j7(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return change_feed(fx.features_v0, fx.features_v1, ["id"])


CHANGED_BLOCK = "o_orderkey div 100 % 10 = 3"

ORDERS_NOW = """
select o_orderkey, o_orderstatus, o_totalprice + case when o_orderkey % 7 = 0 then 1 else 0 end as o_totalprice
from orders where o_orderkey // 100 % 10 = 3 and o_orderkey % 11 <> 0
union all
select -o_orderkey, o_orderstatus, o_totalprice from orders where o_orderkey // 100 % 10 = 3 and o_orderkey % 13 = 0"""


@register("j7_change_feed_blocks", ctes={
    "old": "select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderkey // 100 % 10 = 3",
    "new": ORDERS_NOW}, oracle="""
select n.*, 'insert' as change_type from new n where o_orderkey not in (select o_orderkey from old)
union all select o.*, 'delete' from old o where o_orderkey not in (select o_orderkey from new)
union all select o.*, 'update_preimage' from old o join new n using (o_orderkey) where o.o_totalprice <> n.o_totalprice
union all select n.*, 'update_postimage' from old o join new n using (o_orderkey) where o.o_totalprice <> n.o_totalprice""")
def j7_blocks(spark, sf_dir):
    """Orders against their next version, where one key block of ten has changes (and new keys
    have come): only the blocks whose digests differ are joined."""
    old = base(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    touched = F.expr(CHANGED_BLOCK)
    price = F.col("o_totalprice") + F.when(touched & F.expr("o_orderkey % 7 = 0"), 1).otherwise(0)
    new = (old.where(~touched | F.expr("o_orderkey % 11 <> 0")).withColumn("o_totalprice", price)
           .unionByName(old.where(touched & F.expr("o_orderkey % 13 = 0")).withColumn("o_orderkey", -F.col("o_orderkey"))))
    return change_feed_by_blocks(old, new, ["o_orderkey"], "o_orderkey div 100")


AS_OF = "2024-01-15 00:00:00"


@register("w5_snapshot_as_of", fixtures=["change_rows"], oracle=f"""
select c.user_id, c.commit_version, c.commit_ts, c.value
from change_rows c join (
    select user_id, max(commit_version) as v from change_rows
    where commit_ts <= timestamp '{AS_OF}' and change_type <> 'update_preimage' group by user_id) m
  on c.user_id = m.user_id and c.commit_version = m.v
where c.change_type <> 'delete'""")
def w5(spark, sf_dir):
    return snapshot_as_of(Fixtures(spark, sf_dir).change_rows, ["user_id"], timestamp=AS_OF)
