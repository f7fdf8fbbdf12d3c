"""Test inputs: the driver's parquet tables and the metadata tables derived from them.

Every derived table is one SQL statement that runs unchanged on Spark SQL and on DuckDB,
so a query's Spark plan and its oracle start from the same rows. The derived tables grow
with the base tables (model versions with orders, dependencies with line items, ...).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations")

# name -> (SQL over base tables, base tables it reads)
DERIVED = {
    # one model per customer; versions are orders
    "model_versions": ("""
select concat('prod.ml.model_', cast(o_custkey as string)) as model_name,
       cast(o_orderkey as string) as version,
       concat('run-', cast(o_orderkey as string)) as run_id,
       o_orderdate as created_at
from orders""", ("orders",)),

    # one row per line item; some of other types, some unreadable
    "dependencies": ("""
select concat('prod.ml.model_', cast(o_custkey as string)) as model_name,
       cast(l_orderkey as string) as version,
       l_linenumber as pos,
       case when l_partkey % 37 = 5 then null when l_partkey % 40 = 7 then 'CONNECTION'
            when l_partkey % 40 = 9 then 'VOLUME' when l_partkey % 4 = 0 then 'FUNCTION' else 'TABLE' end as dep_type,
       case when l_partkey % 74 = 42 then null else
       concat('prod.ml.', case when l_partkey % 40 = 7 then 'conn_'
            when l_partkey % 4 = 0 then 'fn_' else 'features_' end,
            cast(l_partkey as string)) end as dep_name
from lineitem join orders on l_orderkey = o_orderkey""", ("lineitem", "orders")),

    # a share per 15 models, as many as there are suppliers; some models have no version
    "share_requests": ("""
select distinct concat('prod.ml.model_', cast(o_custkey as string)) as model_name,
       concat('share_', cast(cast(floor(o_custkey / 15) as bigint) as string)) as share_name,
       concat('recipient_', cast(cast(floor(o_custkey / 15) as bigint) as string)) as recipient_name,
       case when o_custkey % 4 = 3 then '' else concat('aws:ms-', cast(o_custkey % 5 as string)) end as target_metastore_id,
       'aws:ms-0' as source_metastore_id,
       o_custkey % 7 <> 0 as create_recipient
from orders
union all
select concat('prod.ml.unversioned_', cast(c_custkey as string)), concat('share_', cast(cast(floor(c_custkey / 15) as bigint) as string)),
       concat('recipient_', cast(cast(floor(c_custkey / 15) as bigint) as string)), 'aws:ms-1', 'aws:ms-0', true
from customer where c_custkey % 25 = 4""", ("orders", "customer")),

    "share_objects": ("""
select distinct concat('share_', cast(cast(floor(p_partkey / 20) as bigint) as string)) as share_name,
       concat('prod.ml.', case when p_partkey % 4 = 0 then 'fn_' else 'features_' end,
              cast(p_partkey as string)) as object_name,
       case when p_partkey % 4 = 0 then 'FUNCTION' else 'TABLE' end as object_type,
       case when p_partkey % 5 = 0 then 'PERMISSION_DENIED' else 'ACTIVE' end as status
from part where p_partkey % 3 = 0 and p_partkey % 40 <> 7
union all
select distinct concat('share_', cast(cast(floor(o_custkey / 15) as bigint) as string)),
       concat('prod.ml.features_', cast(l_partkey as string)), 'TABLE', 'ACTIVE'
from lineitem join orders on l_orderkey = o_orderkey
where o_custkey % 3 = 0 and l_partkey % 4 <> 0 and l_partkey % 3 <> 0
union all
select distinct concat('share_', cast(cast(floor(o_custkey / 15) as bigint) as string)),
       concat('prod.ml.model_', cast(o_custkey as string)), 'MODEL', 'ACTIVE'
from orders where o_custkey % 2 = 0""", ("part", "orders", "lineitem")),

    "share_grants": ("""
select concat('share_', cast(s_suppkey as string)) as share_name,
       concat('recipient_', cast(s_suppkey as string)) as principal,
       'SELECT' as privilege
from supplier where s_suppkey % 2 = 0""", ("supplier",)),

    "recipients": ("""
select concat('recipient_', cast(s_suppkey as string)) as recipient_name,
       case when s_suppkey % 4 = 0 then 'TOKEN' else 'DATABRICKS' end as authentication_type,
       case when s_suppkey % 4 = 0 then null
            else concat('aws:ms-', cast(s_nationkey % 5 as string)) end as global_metastore_id,
       case when s_suppkey % 6 = 0 then '' else s_name end as comment,
       cast(1700000000 + s_suppkey as bigint) as created_at,
       concat('user', cast(s_suppkey as string), '@example.com') as created_by
from supplier where s_suppkey % 3 <> 1""", ("supplier",)),

    "status_events": ("""
select concat('main.default.t', cast(user_id as string), '_online') as object_name, ts,
       case event_type when 'view' then 'ONLINE' when 'click' then 'PROVISIONING'
            when 'purchase' then 'ONLINE_NO_PENDING_UPDATE'
            when 'signup' then case when user_id % 3 = 0 then 'StoreState.AVAILABLE' when user_id % 3 = 1 then 'UNAVAILABLE'
                                    else 'OFFLINE' end
            else 'OFFLINE_FAILED' end as state
from events""", ("events",)),

    # Added here: request bodies of every kind a scoring service receives.
    "score_requests": ("""
select event_id, user_id,
       case event_id % 8
         when 1 then concat('{"inputs": [{"k": ', cast(user_id as string), '}, {"k": ', cast(user_id + 1 as string), '}]}')
         when 2 then concat('{"inputs": [{"k": ', cast(user_id as string), '}, null, {"k": "x"}, 5, {"k": null}]}')
         when 3 then '{"k": "x"}'
         when 4 then concat('{"k": ', cast(user_id as string))
         when 5 then '{"inputs": []}'
         when 6 then concat('{"inputs": ', cast(user_id as string), '}')
         else props end as body
from events""", ("events",)),

    "log_messages": ("""
select event_id, case event_type when 'view' then 'Share does NOT EXIST'
       when 'click' then 'Recipient not_found' when 'purchase' then 'Object already exists in share'
       when 'signup' then 'Conflict: update in progress' else 'Permission denied' end as message
from events""", ("events",)),

    "target_configs": ("""
select c_custkey as config_id,
       case when c_custkey % 11 = 0 then '' else 'my_share' end as share_name,
       case when c_custkey % 13 = 0 then '' else 'self' end as provider_name,
       case when c_custkey % 17 = 0 then '' else 'shared_cat' end as target_catalog,
       c_custkey % 2 = 0 as create_online_table,
       case when c_custkey % 3 = 0 then '' else 'main' end as online_table_target_catalog,
       case when c_custkey % 5 = 0 then 'NONE' else 'default' end as online_table_target_schema
from customer""", ("customer",)),

    "features_v0": ("""
select c_custkey as id, c_acctbal as feature_1, cast(c_nationkey as double) as feature_2, c_mktsegment as segment
from customer""", ("customer",)),

    "features_v1": ("""
select c_custkey as id, case when c_custkey % 5 = 0 then c_acctbal + 100 else c_acctbal end as feature_1,
       cast(c_nationkey as double) as feature_2,
       case when c_custkey % 19 = 0 then null else c_mktsegment end as segment
from customer where c_custkey % 17 <> 0
union all
select c_custkey + 1000000 as id, c_acctbal as feature_1, cast(c_nationkey as double) as feature_2, c_mktsegment as segment
from customer where c_custkey % 29 = 0""", ("customer",)),

    "feature_gap": ("""
select c_custkey as id, c_acctbal as feature_1, cast(c_nationkey as double) as feature_2
from customer where c_custkey % 4 <> 0""", ("customer",)),

    "labels_frame": ("""
select o_orderkey as row_id, o_custkey as id, o_totalprice as target from orders""", ("orders",)),

    "table_registry": ("""
select concat('prod.ml.features_', cast(p_partkey as string)) as table_name,
       concat('uuid-', cast(p_partkey as string), case when p_partkey % 10 = 0 then '-b' else '-a' end) as table_id
from part where p_partkey % 21 <> 0""", ("part",)),

    "online_tables": ("""
select concat('main.default.features_', cast(p_partkey as string), '_online') as online_table_name,
       concat('prod.ml.features_', cast(p_partkey as string)) as source_table_name,
       concat('uuid-', cast(p_partkey as string), '-a') as source_table_id
from part where p_partkey % 3 = 0""", ("part",)),

    "shares": ("""
select concat('share_', cast(s_suppkey as string)) as share_name,
       case when s_suppkey % 2 = 0 then s_name end as comment,
       cast(1700000000 + s_suppkey as bigint) as created_at,
       concat('user', cast(s_suppkey as string), '@example.com') as created_by
from supplier""", ("supplier",)),

    # one row per served entity: an endpoint per model, some serve an older version, some two
    "endpoints": ("""
select concat('target-model-', cast(o_custkey as string), '-endpoint') as endpoint_name,
       concat('prod.ml.model_', cast(o_custkey as string)) as entity_name,
       cast(case when o_custkey % 2 = 0 then max(o_orderkey) else min(o_orderkey) end as string) as entity_version,
       case when o_custkey % 3 = 0 then 'NOT_READY' else 'READY' end as ready,
       case when o_custkey % 4 = 0 then 'IN_PROGRESS' else 'NOT_UPDATING' end as config_update
from orders where o_custkey % 5 <> 1 group by o_custkey
union all
select distinct concat('target-model-', cast(o_custkey as string), '-endpoint'),
       concat('prod.ml.challenger_', cast(o_custkey as string)), '1',
       case when o_custkey % 3 = 0 then 'NOT_READY' else 'READY' end,
       case when o_custkey % 4 = 0 then 'IN_PROGRESS' else 'NOT_UPDATING' end
from orders where o_custkey % 5 <> 1 and o_custkey % 10 = 0""", ("orders",)),

    "catalogs": ("""
select concat('shared_', cast(s_suppkey as string)) as catalog_name,
       case when s_suppkey % 3 = 0 then 'MANAGED_CATALOG' else 'DELTASHARING_CATALOG' end as catalog_type
from supplier where s_suppkey % 4 <> 1 and s_suppkey % 6 <> 0""", ("supplier",)),

    # some models have versions, parts beyond the customers' keys do not
    "registered_models": ("""
select distinct concat('shared_', cast(cast(floor(p_partkey / 20) as bigint) as string)) as catalog_name,
       case when p_partkey % 6 = 0 then 'information_schema'
            else concat('sch_', cast(p_partkey % 4 as string)) end as schema_name,
       concat('prod.ml.model_', cast(p_partkey as string)) as model_name
from part""", ("part",)),

    "model_shares": ("""
select concat('prod.ml.model_', cast(o_custkey as string)) as model_name,
       concat('recipient_', cast(o_orderkey % 3 as string)) as recipient_name,
       concat('share_', cast(o_orderkey % 5 as string)) as share_name,
       max(o_orderdate) as created_at
from orders group by 1, 2, 3""", ("orders",)),

    "change_rows": ("""
select user_id, event_id as commit_version, ts as commit_ts,
       case event_type when 'error' then 'delete' when 'signup' then 'insert'
            else 'update_postimage' end as change_type, value
from events""", ("events",)),

    # feature tables of many catalogs and schemas; a short name that lies in several of them
    # becomes one online name (parts divisible by 5 have one table only)
    "source_tables": ("""
select distinct concat(case when l_partkey % 5 = 0 then 'cat_0.sch_'
                            else concat('cat_', cast(l_suppkey % 3 as string), case when l_suppkey % 2 = 0 then '.sch_' else '.dev_' end) end,
                       cast(cast(floor(l_partkey / 50) as bigint) as string), '.features_', cast(l_partkey as string)) as table_name
from lineitem""", ("lineitem",)),

    # a schema per share, of which some hold no table; 'cat_2.dev_*' and others stay uncovered
    "share_schemas": ("""
select concat('share_', cast(s_suppkey as string)) as share_name,
       concat('cat_', cast(s_suppkey % 4 as string), case when s_suppkey % 5 = 0 then '.dev_' else '.sch_' end,
              cast(cast(floor(s_suppkey / 3) as bigint) as string)) as schema_full_name
from supplier""", ("supplier",)),

    # Added here (not in the fixture list): a status log for the feature tables that
    # models depend on (features_0 .. features_39), so readiness can gate deployment.
    "table_status_events": ("""
select concat('main.default.features_', cast(user_id as string), '_online') as object_name, ts,
       case when user_id % 4 <> 0 and event_type <> 'error' then 'ONLINE'
            when event_type = 'view' then 'ONLINE' when event_type = 'click' then 'PROVISIONING'
            when event_type = 'purchase' then 'ONLINE_NO_PENDING_UPDATE' when event_type = 'signup' then 'OFFLINE'
            else 'OFFLINE_FAILED' end as state
from events""", ("events",)),

    # Added here: how publishing each feature table ended (S10's outcomes).
    "publish_outcomes": ("""
select concat('prod.ml.features_', cast(p_partkey as string)) as source_table_name,
       case when p_partkey % 11 = 3 then 'failed' when p_partkey % 7 = 2 then 'exists' else 'published' end as outcome
from part""", ("part",)),

    # Added here: the target-side settings of every catalog, some of them invalid.
    "catalog_settings": ("""
select concat('shared_', cast(s_suppkey as string)) as catalog_name,
       s_suppkey % 2 = 0 as use_existing,
       s_suppkey % 3 <> 0 as create_online_table, s_suppkey % 5 <> 4 as deploy_serving,
       case when s_suppkey % 9 = 7 then '' else 'my_share' end as share_name,
       'self' as provider_name,
       concat('shared_', cast(s_suppkey as string)) as target_catalog,
       case when s_suppkey % 8 = 5 then 'NONE' else 'main' end as online_table_target_catalog,
       'default' as online_table_target_schema,
       case when s_suppkey % 4 = 2 then concat('Store_', cast(s_suppkey as string)) else '' end as online_store_name,
       s_suppkey % 10 <> 8 as create_online_store
from supplier""", ("supplier",)),

    # Added here: the online stores that exist, and their states.
    "online_stores": ("""
select concat('store-', cast(s_suppkey as string)) as store_name,
       case when s_suppkey % 3 = 0 then 'State.UNAVAILABLE' else 'State.AVAILABLE' end as state
from supplier where s_suppkey % 10 <> 8
union all
select 'main-online-store', 'AVAILABLE' from supplier where s_suppkey = 0""", ("supplier",)),

    # Added here: command-line run configs with secret references in host and token.
    "run_configs": ("""
select c_custkey as config_id,
       case when c_custkey % 2 = 0 then 'source' else 'target' end as mode,
       case when c_custkey % 7 = 0 then '' else concat('prod.ml.model_', cast(c_custkey as string)) end as model_name,
       case when c_custkey % 11 = 0 then 'NONE' else concat('share_', cast(cast(floor(c_custkey / 15) as bigint) as string)) end as share_name,
       case when c_custkey % 13 = 0 then '' else concat('recipient_', cast(c_custkey as string)) end as recipient_name,
       case when c_custkey % 3 = 0 then 'self' else '' end as provider_name,
       case when c_custkey % 17 = 0 then '' else 'shared_cat' end as target_catalog,
       case c_custkey % 4 when 0 then concat('{{secrets/scope_', cast(c_nationkey % 3 as string), '/host}}')
            when 1 then concat('https://ws-', cast(c_nationkey as string), '.example.com')
            when 2 then concat('x{{secrets/s/', c_mktsegment, '}}') else '' end as target_host,
       case when c_custkey % 5 = 0 then concat('{{secrets/scope_', cast(c_nationkey % 3 as string), '/token/', c_mktsegment, '}}')
            else 'tok-plain' end as target_token,
       case c_custkey % 3 when 0 then 'True' when 1 then 'false' else 'yes' end as deploy_serving,
       case when c_custkey % 4 = 0 then 'TRUE' else 'no' end as create_online_table
from customer""", ("customer",)),
}


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables, as its files are now."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register_base(spark: SparkSession, sf_dir: str, names) -> None:
    for n in names:
        base(spark, sf_dir, n).createOrReplaceTempView(n)


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived metadata table, planned by Spark SQL over the base tables."""
    sql, bases = DERIVED[name]
    register_base(spark, sf_dir, bases)
    return spark.sql(sql)


class Fixtures:
    """Attribute access to base and derived tables of one scale factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in DERIVED:
            return derived(self.spark, self.sf_dir, name)
        if name in BASE_TABLES:
            return base(self.spark, self.sf_dir, name)
        raise AttributeError(name)


def oracle_with(names, body: str) -> str:
    """The DuckDB form: the same fixture SQL as CTEs, then the oracle body."""
    names = list(dict.fromkeys(names))
    ctes = ",\n".join(f"{n} AS ({DERIVED[n][0].strip()})" for n in names)
    return f"WITH {ctes}\n{body.strip()}" if names else body.strip()
