"""Registered queries of the fleet metadata path: registry, sharing, links, configs,
names, readiness and the composed source and target plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from featshare.functions.config import SECRET_PATTERN, normalize_configs, secret_scan
from featshare.functions.envelope import result_json
from featshare.functions.names import (dns_name, endpoint_name, invocation_url, online_name,
                                       shared_name, short_name, source_endpoint_name)
from featshare.functions.states import error_class, state_class
from featshare.operators.components import consolidated_share, model_components
from featshare.operators.links import broken_links, online_name_collisions, resolve_links
from featshare.operators.quality import (TARGET_RULES, error_triage, store_name_audit, validate_run_configs,
                                         validate_target_configs)
from featshare.operators.readiness import poll_grid, poll_samples, publish_rollup, readiness
from featshare.operators.registry import (cut_to_versions, dependency_drift, dependency_summary, discover_model,
                                          distinct_dependencies, effective_share, latest_model_version,
                                          schema_share, shared_by_many, version_for_run, versions_desc,
                                          wanted_objects)
from featshare.operators.sharing import (already_shared, catalog_plan, endpoint_plan, endpoint_status,
                                         grant_plan, list_recipients, list_shares, recipient_plan,
                                         share_details, share_update_plan, shareable)
from featshare.plans.registry import (HOST, PLAN_CTES, SOURCE_CTES, dns_sql, endpoint_state_sql, joined,
                                      online_table_state_sql, register)
from featshare.plans.source_plan import source_plan
from featshare.plans.target_plan import deployment_decision, store_plan, target_plan
from featshare.session import materialize
from featshare.sources.fixtures import Fixtures

REQ_FX = ["model_versions", "dependencies", "share_requests"]


# ---------------------------------------------------------------- W1, L2, J10, W2, A1

@register("w1_latest_model_version", fixtures=["model_versions"], oracle="""
select model_name, arg_max(version, cast(version as bigint)) as version,
       arg_max(run_id, cast(version as bigint)) as run_id,
       arg_max(created_at, cast(version as bigint)) as created_at
from model_versions where try_cast(version as bigint) is not null group by model_name""")
def w1(spark, sf_dir):
    return latest_model_version(Fixtures(spark, sf_dir).model_versions)


@register("l2_versions_desc", fixtures=["model_versions"], oracle="""
select model_name, version, run_id, created_at, version_rank from (
  select *, row_number() over (partition by model_name order by cast(version as bigint) desc) as version_rank
  from model_versions where try_cast(version as bigint) is not null) t
where version_rank <= 3""")
def l2(spark, sf_dir):
    return versions_desc(Fixtures(spark, sf_dir).model_versions, 3) \
        .withColumn("version_rank", F.col("version_rank").cast("bigint"))


@register("j10_version_for_run", fixtures=["model_versions"], oracle="""
select m.model_name, m.run_id, max(m.version) as version
from model_versions m join (
    select model_name, arg_max(run_id, cast(version as bigint)) as run_id
    from model_versions group by model_name) r
  on m.model_name = r.model_name and m.run_id = r.run_id
group by m.model_name, m.run_id""")
def j10(spark, sf_dir):
    mv = Fixtures(spark, sf_dir).model_versions
    return version_for_run(mv, latest_model_version(mv).select("model_name", "run_id"))


@register("w2_distinct_dependencies", fixtures=["dependencies"], oracle="""
select model_name, version, dep_type, dep_name, min(pos) as pos from dependencies
where dep_type in ('TABLE', 'FUNCTION') and dep_name is not null
group by model_name, version, dep_type, dep_name""")
def w2(spark, sf_dir):
    return distinct_dependencies(Fixtures(spark, sf_dir).dependencies) \
        .withColumn("pos", F.col("pos").cast("bigint"))


def _summary_cols(df):
    return df.select("model_name", "version", joined("tables").alias("tables"),
                     joined("functions").alias("functions"), "n_tables", "n_functions",
                     "has_feature_lookups",
                     joined(F.transform("online_table_specs", lambda s: s["table_name_short"]))
                     .alias("online_table_names"), "n_other_types", "n_unreadable")


@register("a1_dependency_summary", fixtures=["model_versions", "dependencies"],
          ctes={"latest": SOURCE_CTES["latest"], "ldeps": SOURCE_CTES["ldeps"]}, oracle="""
select l.model_name, l.version,
       coalesce(string_agg(case when d.dep_type = 'TABLE' then d.dep_name end, ',' order by d.pos, d.dep_name), '') as tables,
       coalesce(string_agg(case when d.dep_type = 'FUNCTION' then d.dep_name end, ',' order by d.pos, d.dep_name), '') as functions,
       count(case when d.dep_type = 'TABLE' then 1 end) as n_tables,
       count(case when d.dep_type = 'FUNCTION' then 1 end) as n_functions,
       count(case when d.dep_type = 'TABLE' then 1 end) > 0 as has_feature_lookups,
       coalesce(string_agg(case when d.dep_type = 'TABLE' then regexp_extract(d.dep_name, '[^.]*$') end, ','
                           order by d.pos, d.dep_name), '') as online_table_names,
       coalesce(max(o.n_other_types), 0) as n_other_types, coalesce(max(o.n_unreadable), 0) as n_unreadable
from latest l left join ldeps d on l.model_name = d.model_name and l.version = d.version
left join (select x.model_name, x.version,
                  count(distinct case when x.dep_type is not null and x.dep_name is not null
                                       and x.dep_type not in ('TABLE', 'FUNCTION')
                                      then x.dep_type || '|' || x.dep_name end) as n_other_types,
                  count(case when x.dep_type is null or x.dep_name is null then 1 end) as n_unreadable
           from dependencies x join latest y on x.model_name = y.model_name and x.version = y.version
           group by x.model_name, x.version) o on l.model_name = o.model_name and l.version = o.version
group by l.model_name, l.version""")
def a1(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    latest = latest_model_version(fx.model_versions.select("model_name", "version"))
    return _summary_cols(dependency_summary(latest, fx.dependencies))


@register("a8_shared_by_many", fixtures=["model_versions", "dependencies"],
          ctes={"latest": SOURCE_CTES["latest"], "ldeps": SOURCE_CTES["ldeps"]}, oracle="""
select p.dep_type, p.dep_name, p.model_name, c.n_models
from (select distinct dep_type, dep_name, model_name from ldeps) p
join (select dep_type, dep_name, count(distinct model_name) as n_models from ldeps
      group by dep_type, dep_name having count(distinct model_name) > 1) c
  on p.dep_type = c.dep_type and p.dep_name = c.dep_name""")
def a8(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    latest = latest_model_version(fx.model_versions.select("model_name", "version"))
    deps = distinct_dependencies(cut_to_versions(fx.dependencies, latest))
    return shared_by_many(deps)


A8_CTES = {
    "latest": SOURCE_CTES["latest"], "ldeps": SOURCE_CTES["ldeps"],
    "edges": "select distinct model_name, dep_type, dep_name from ldeps",
    "hops": """select distinct a.model_name as a, b.model_name as b from edges a join edges b
               on a.dep_type = b.dep_type and a.dep_name = b.dep_name""",
    "comp": """select model_name, min(label) as component from (
      with recursive reach(model_name, label) as (
        select model_name, model_name from latest
        union select h.b, r.label from reach r join hops h on h.a = r.model_name where r.label < h.b)
      select * from reach) group by model_name"""}


@register("a8_model_components", fixtures=["model_versions", "dependencies"], ctes=A8_CTES, oracle="""
select model_name, component from comp""")
def a8_components(spark, sf_dir):
    return model_components(*_latest_dependencies(Fixtures(spark, sf_dir)))


@register("a8_consolidated_share", fixtures=["model_versions", "dependencies"], ctes=A8_CTES, oracle="""
select component, object_type, object_name, count(*) as n_models from (
  select component, 'MODEL' as object_type, model_name as object_name from comp
  union all select component, dep_type, dep_name from edges join comp using (model_name))
group by 1, 2, 3""")
def a8_share(spark, sf_dir):
    return consolidated_share(*_latest_dependencies(Fixtures(spark, sf_dir)))


def _latest_dependencies(fx):
    """Models with a version, and the distinct dependencies of their latest one."""
    latest = materialize(latest_model_version(fx.model_versions.select("model_name", "version")), "latest-versions")
    return latest.select("model_name"), distinct_dependencies(cut_to_versions(fx.dependencies, latest))


# ---------------------------------------------------------------- W3, W4

W3_CTES = {
    "firsts": """select catalog_name, min(schema_name) as schema_name from registered_models
                 where schema_name <> 'information_schema' group by catalog_name""",
    "found0": """select f.catalog_name, f.schema_name, min(r.model_name) as model_name
                 from firsts f join registered_models r
                   on r.catalog_name = f.catalog_name and r.schema_name = f.schema_name
                 group by f.catalog_name, f.schema_name""",
    "lv": """select model_name, arg_max(version, cast(version as bigint)) as version
             from model_versions where try_cast(version as bigint) is not null group by model_name""",
    "found": """select f.catalog_name, f.schema_name, f.model_name, coalesce(l.version, '1') as version
                from found0 f left join lv l on f.model_name = l.model_name""",
    "fdeps": """select d.model_name, d.version, d.dep_type, d.dep_name, min(d.pos) as pos
                from dependencies d join (select distinct model_name, version from found) f
                  on d.model_name = f.model_name and d.version = f.version
                where d.dep_type in ('TABLE', 'FUNCTION') and d.dep_name is not null
                group by 1, 2, 3, 4"""}


@register("w3_discover_model", fixtures=["registered_models", "model_versions", "dependencies"],
          ctes=W3_CTES,
          oracle="""
select f.catalog_name, f.schema_name, f.model_name, f.version,
       coalesce(string_agg(case when d.dep_type = 'TABLE' then d.dep_name end, ',' order by d.pos, d.dep_name), '') as tables,
       coalesce(string_agg(case when d.dep_type = 'FUNCTION' then d.dep_name end, ',' order by d.pos, d.dep_name), '') as functions,
       count(case when d.dep_type = 'TABLE' then 1 end) as n_tables,
       count(case when d.dep_type = 'FUNCTION' then 1 end) as n_functions
from found f left join fdeps d on f.model_name = d.model_name and f.version = d.version
group by f.catalog_name, f.schema_name, f.model_name, f.version""")
def w3(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    d = discover_model(fx.registered_models, fx.model_versions, fx.dependencies)
    return d.select("catalog_name", "schema_name", "model_name", "version",
                    joined("tables").alias("tables"), joined("functions").alias("functions"),
                    "n_tables", "n_functions")


@register("w4_effective_share", fixtures=["model_shares"], oracle="""
select model_name, recipient_name, share_name, created_at from (
  select *, row_number() over (partition by model_name, recipient_name
                               order by created_at desc, share_name desc) as rn
  from model_shares) t where rn = 1""")
def w4(spark, sf_dir):
    return effective_share(Fixtures(spark, sf_dir).model_shares)


# ---------------------------------------------------------------- U1-U3, J3-J6, P5

@register("u1_wanted_objects", fixtures=REQ_FX, ctes=SOURCE_CTES, oracle="""
select * from wanted""")
def u1(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return wanted_objects(fx.share_requests, fx.model_versions, fx.dependencies)


@register("j3_share_update_plan", fixtures=REQ_FX + ["share_objects"], ctes=SOURCE_CTES, oracle="""
select w.*, case when w.object_type = 'TABLE' then 'ENABLED' end as history_data_sharing_status
from wanted w
where not exists (select 1 from share_objects s where s.share_name = w.share_name and s.object_name = w.object_name)""")
def j3(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return share_update_plan(wanted_objects(fx.share_requests, fx.model_versions, fx.dependencies),
                             fx.share_objects)


@register("j4_already_shared", fixtures=REQ_FX + ["share_objects"], ctes=SOURCE_CTES, oracle="""
select w.* from wanted w
where exists (select 1 from share_objects s where s.share_name = w.share_name and s.object_name = w.object_name)""")
def j4(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return already_shared(wanted_objects(fx.share_requests, fx.model_versions, fx.dependencies),
                          fx.share_objects)


@register("u2_dependency_drift", fixtures=REQ_FX + ["share_objects"], ctes=SOURCE_CTES, oracle="""
select w.share_name, w.object_name, w.object_type, 'missing' as drift
from (select distinct share_name, object_name, object_type from wanted) w
where not exists (select 1 from share_objects s where s.share_name = w.share_name and s.object_name = w.object_name)
union all
select s.share_name, s.object_name, s.object_type, 'extra'
from share_objects s
where s.share_name in (select share_name from wanted)
  and not exists (select 1 from wanted w where w.share_name = s.share_name and w.object_name = s.object_name)""")
def u2(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return dependency_drift(wanted_objects(fx.share_requests, fx.model_versions, fx.dependencies),
                            fx.share_objects, shares=fx.share_requests)


@register("u3_schema_share", fixtures=["share_schemas", "source_tables"], oracle="""
select s.schema_full_name, s.share_name, t.table_name
from share_schemas s join source_tables t
  on s.schema_full_name = split_part(t.table_name, '.', 1) || '.' || split_part(t.table_name, '.', 2)""")
def u3(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return schema_share(fx.share_schemas, fx.source_tables)


@register("j6_recipient_plan", fixtures=["share_requests", "recipients"], ctes=PLAN_CTES, oracle="""
select * from plan2""")
def j6(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return recipient_plan(fx.share_requests, fx.recipients)


@register("j5_grant_plan", fixtures=["share_requests", "recipients", "share_grants"], ctes=PLAN_CTES, oracle="""
select distinct p.share_name, p.recipient_name as principal, 'SELECT' as privilege
from plan2 p
where p.action <> 'error'
  and not exists (select 1 from share_grants g where g.share_name = p.share_name
                  and g.principal = p.recipient_name and g.privilege = 'SELECT')""")
def j5(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return grant_plan(recipient_plan(fx.share_requests, fx.recipients), fx.share_grants)


@register("p5_shareable", fixtures=REQ_FX + ["recipients"], ctes={
    **PLAN_CTES,
    "latest": SOURCE_CTES["latest"],
    "adeps": """select d.model_name, d.version, d.dep_type, d.dep_name, min(d.pos) as pos
                from dependencies d join latest l on d.model_name = l.model_name and d.version = l.version
                where d.dep_name is not null group by 1, 2, 3, 4""",
    "req": SOURCE_CTES["req"],
    "objs": """select share_name, model_name, model_name as object_name, 'MODEL' as object_type from req
               union all
               select q.share_name, q.model_name, a.dep_name, a.dep_type
               from req q join adeps a on q.model_name = a.model_name and q.version = a.version"""},
    oracle="""
select share_name, model_name, recipient_name, object_name, object_type, effective_auth,
       reason is null as shareable, reason from (
  select o.share_name, o.model_name, p.recipient_name, o.object_name, o.object_type, p.effective_auth,
         case when o.object_type = 'CONNECTION' then 'connection_never_shared'
              when p.effective_auth is null then 'no_recipient'
              when o.object_type in ('MODEL', 'FUNCTION') and p.effective_auth <> 'DATABRICKS' then 'needs_d2d'
              when o.object_type in ('MODEL', 'FUNCTION', 'TABLE') then null
              else 'unsupported_type' end as reason
  from objs o left join plan2 p on o.share_name = p.share_name and o.model_name = p.model_name) x""")
def p5(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    objs = wanted_objects(fx.share_requests, fx.model_versions, fx.dependencies, include_all_types=True)
    return shareable(objs, recipient_plan(fx.share_requests, fx.recipients))


# ---------------------------------------------------------------- J8, J9, A7, J11, J12

@register("j8_broken_links", fixtures=["online_tables", "table_registry"], oracle="""
select o.online_table_name, o.source_table_name, o.source_table_id, t.table_id as current_table_id,
       case when t.table_id is null then 'gone' else 'recreated' end as status
from online_tables o left join table_registry t on o.source_table_name = t.table_name
where t.table_id is null or t.table_id <> o.source_table_id""")
def j8(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return broken_links(fx.online_tables, fx.table_registry)


@register("j9_resolve_links", fixtures=["online_tables", "table_registry"], oracle="""
select o.online_table_name, o.source_table_name, o.source_table_id, t.table_name as current_table_name
from online_tables o join table_registry t on o.source_table_id = t.table_id""")
def j9(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return resolve_links(fx.online_tables, fx.table_registry)


@register("a7_online_name_collisions", fixtures=["source_tables"], ctes={
    "src": "select distinct table_name as source_table_name from source_tables",
    "named": """select source_table_name,
                       'main.default.' || regexp_extract(source_table_name, '[^.]*$') || '_online' as online_table_name
                from src""",
    "grp": """select online_table_name, count(*) as n_sources, min(source_table_name) as first_source
              from named group by 1 having count(*) > 1"""},
    oracle="""
select n.online_table_name, n.source_table_name, g.n_sources,
       case when n.source_table_name = g.first_source then 'published' else 'exists' end as reference_outcome
from named n join grp g on n.online_table_name = g.online_table_name""")
def a7(spark, sf_dir):
    return online_name_collisions(Fixtures(spark, sf_dir).source_tables, "table_name", "main", "default")


@register("j11_catalog_plan", fixtures=["registered_models", "catalogs"], oracle="""
select w.catalog_name, w.use_existing,
       case when c.catalog_name is not null then 'reuse' when w.use_existing then 'error' else 'create' end as action,
       c.catalog_type, c.catalog_type like '%DELTASHARING%' as is_sharing_catalog
from (select distinct catalog_name, cast(substr(catalog_name, 8) as integer) % 2 = 0 as use_existing
      from registered_models) w
left join catalogs c on w.catalog_name = c.catalog_name""")
def j11(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    wanted = fx.registered_models.select(
        "catalog_name",
        (F.expr("substring(catalog_name, 8)").cast("int") % 2 == 0).alias("use_existing")).distinct()
    return catalog_plan(wanted, fx.catalogs)


@register("j12_endpoint_plan", fixtures=["model_versions", "endpoints"],
          ctes={"latest": SOURCE_CTES["latest"],
                "m": f"""select *, case when cast(regexp_extract(model_name, '(\\d+)$', 1) as integer) % 6 = 1
                                        then 'given-' || regexp_extract(model_name, '[^.]*$')
                                        else 'target-' || {dns_sql("regexp_extract(model_name, '[^.]*$')")} || '-endpoint'
                                   end as endpoint_name from latest""",
                "ranked": f"""select m.model_name, m.version, m.endpoint_name, e.entity_name, e.entity_version,
                       case when e.endpoint_name is null then null else {endpoint_state_sql("e.ready", "e.config_update")} end as st,
                       count(e.endpoint_name) over (partition by m.model_name) as n_served,
                       row_number() over (partition by m.model_name order by coalesce(e.entity_name = m.model_name, false) desc,
                                          e.entity_version <> m.version, e.entity_name, e.entity_version) as rn
                from m left join endpoints e on e.endpoint_name = m.endpoint_name"""}, oracle="""
select model_name, version, endpoint_name, entity_name as current_entity, entity_version as current_version,
       st as endpoint_state, n_served,
       case when n_served = 0 then 'create' when entity_name = model_name and entity_version = version then 'current'
            else 'update' end as action,
       'Small' as workload_size, true as scale_to_zero_enabled
from ranked where rn = 1""")
def j12(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    num = F.regexp_extract("model_name", r"(\d+)$", 1).cast("int")
    models = latest_model_version(fx.model_versions).withColumn(
        "endpoint_name", F.when(num % 6 == 1, F.concat(F.lit("given-"), short_name("model_name"))).otherwise(F.lit("")))
    return endpoint_plan(models, fx.endpoints)


# ---------------------------------------------------------------- P6, P7, A2, C8

@register("p6_list_shares", fixtures=["shares"], oracle="""
select share_name as name, nullif(comment, '') as comment,
       nullif(cast(created_at as varchar), '') as created_at, nullif(created_by, '') as created_by
from shares""")
def p6s(spark, sf_dir):
    return list_shares(Fixtures(spark, sf_dir).shares)


@register("p6_list_recipients", fixtures=["recipients"], oracle="""
select recipient_name as name, nullif(authentication_type, '') as authentication_type,
       nullif(global_metastore_id, '') as global_metastore_id, nullif(comment, '') as comment,
       nullif(cast(created_at as varchar), '') as created_at, nullif(created_by, '') as created_by
from recipients""")
def p6r(spark, sf_dir):
    return list_recipients(Fixtures(spark, sf_dir).recipients)


@register("p7_endpoint_status", fixtures=["endpoints"], oracle=f"""
select endpoint_name as name, ready, config_update, count(*) as n_served,
       string_agg(entity_name || ':' || entity_version, ',' order by entity_name, entity_version) as served,
       {endpoint_state_sql("ready", "config_update")} as state,
       '{HOST}/serving-endpoints/' || endpoint_name || '/invocations' as invocation_url
from endpoints group by endpoint_name, ready, config_update""")
def p7(spark, sf_dir):
    return endpoint_status(Fixtures(spark, sf_dir).endpoints, HOST)


@register("a2_share_details", fixtures=["shares", "share_objects", "share_grants"], ctes={
    "items": """select share_name, 'object' as item_kind, object_name as item_name, object_type as item_detail,
                       status as item_status
                from share_objects
                union all
                select share_name, 'permission', principal,
                       string_agg(distinct privilege, ',' order by privilege), null
                from share_grants group by share_name, principal""",
    "counts": """select share_name, count(case when item_kind = 'object' then 1 end) as n_objects,
                        count(case when item_kind = 'permission' then 1 end) as n_permissions
                 from items group by share_name"""},
    oracle="""
select s.share_name, s.comment, i.item_kind, i.item_name, i.item_detail, i.item_status,
       coalesce(c.n_objects, 0) as n_objects, coalesce(c.n_permissions, 0) as n_permissions
from shares s left join items i on s.share_name = i.share_name
left join counts c on s.share_name = c.share_name""")
def a2(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return share_details(fx.shares, fx.share_objects, fx.share_grants)


@register("c8_result_json", fixtures=["shares"], oracle="""
select share_name,
       '{"status":"success","data":{"name":"' || share_name || '","created_at":"' || cast(created_at as varchar)
       || '","created_by":"' || created_by || '"}}' as result
from shares""")
def c8(spark, sf_dir):
    listing = list_shares(Fixtures(spark, sf_dir).shares).select(
        F.col("name").alias("share_name"), "name", "created_at", "created_by")
    return result_json(listing, data_cols=["name", "created_at", "created_by"])


# ---------------------------------------------------------------- P3, P4, C3, C4, C5, A5, A6

def _quoted(text):
    return text.replace("'", "''")


P3_COLUMNS = {"online_table_target_catalog": "otc", "online_table_target_schema": "ots"}


@register("p3_validate_target_configs", fixtures=["target_configs"], ctes={
    "t": """select config_id,
                   nullif(nullif(share_name, ''), 'NONE') as share_name,
                   nullif(nullif(provider_name, ''), 'NONE') as provider_name,
                   nullif(nullif(target_catalog, ''), 'NONE') as target_catalog,
                   coalesce(create_online_table, false) as online,
                   nullif(nullif(online_table_target_catalog, ''), 'NONE') as otc,
                   nullif(nullif(online_table_target_schema, ''), 'NONE') as ots
            from target_configs"""},
    oracle="\nunion all\n".join(
        f"""select config_id, {rule} as rule, '{field}' as field, '{_quoted(message)}' as message,
       '{_quoted(remedy)}' as remediation from t where {'online and ' if online else ''}{P3_COLUMNS.get(field, field)} is null"""
        for rule, field, online, message, remedy in TARGET_RULES))
def p3(spark, sf_dir):
    return validate_target_configs(Fixtures(spark, sf_dir).target_configs)


def _nn(c):
    return f"nullif(nullif({c}, ''), 'NONE')"


@register("p4_validate_run_configs", fixtures=["run_configs"], ctes={
    "t": f"""select config_id, mode,
                    case when mode = 'source' then concat_ws(',',
                           case when {_nn('model_name')} is null then 'model_name' end,
                           case when {_nn('share_name')} is null then 'share_name' end,
                           case when {_nn('recipient_name')} is null then 'recipient_name' end)
                         when mode = 'target' then concat_ws(',',
                           case when {_nn('share_name')} is null then 'share_name' end,
                           case when {_nn('provider_name')} is null then 'provider_name' end,
                           case when {_nn('target_catalog')} is null then 'target_catalog' end,
                           case when {_nn('target_host')} is null then 'target_host' end,
                           case when {_nn('target_token')} is null then 'target_token' end)
                         else 'mode' end as missing_fields
             from run_configs"""},
    oracle="""
select config_id, mode, missing_fields = '' as valid, missing_fields from t""")
def p4(spark, sf_dir):
    return validate_run_configs(Fixtures(spark, sf_dir).run_configs)


@register("c3_secret_scan", fixtures=["run_configs"], ctes={
    "kv": """select 'target_host' as column_name, target_host as value from run_configs
             union all select 'target_token', target_token from run_configs""",
    "refs": f"""select column_name, regexp_extract(value, '{SECRET_PATTERN}', 1) as scope,
                       regexp_extract(value, '{SECRET_PATTERN}', 2) as secret_key from kv"""},
    oracle="""
select column_name, scope, secret_key, count(*) as n_refs from refs
where scope is not null and scope <> '' group by 1, 2, 3""")
def c3(spark, sf_dir):
    return secret_scan(Fixtures(spark, sf_dir).run_configs, ["target_host", "target_token"])


@register("c4_normalize_configs", fixtures=["run_configs"], oracle=f"""
select config_id, mode, {_nn('model_name')} as model_name, {_nn('share_name')} as share_name,
       {_nn('recipient_name')} as recipient_name, {_nn('provider_name')} as provider_name,
       {_nn('target_catalog')} as target_catalog, {_nn('target_host')} as target_host,
       {_nn('target_token')} as target_token,
       coalesce(lower(deploy_serving) = 'true', false) as deploy_serving,
       coalesce(lower(create_online_table) = 'true', false) as create_online_table
from run_configs""")
def c4(spark, sf_dir):
    return normalize_configs(
        Fixtures(spark, sf_dir).run_configs,
        ["model_name", "share_name", "recipient_name", "provider_name", "target_catalog",
         "target_host", "target_token"],
        ["deploy_serving", "create_online_table"])


@register("c5_error_class", fixtures=["log_messages"], oracle="""
select event_id, case
    when lower(message) like '%not found%' or lower(message) like '%does not exist%'
      or lower(message) like '%not\\_found%' escape '\\' or lower(message) like '%notfound%' then 'not_found'
    when lower(message) like '%already exists%' or lower(message) like '%already\\_exists%' escape '\\' then 'already_exists'
    when lower(message) like '%conflict%' or lower(message) like '%in progress%' then 'conflict'
    else 'other' end as error_class
from log_messages""")
def c5(spark, sf_dir):
    lm = Fixtures(spark, sf_dir).log_messages
    return lm.select("event_id", error_class("message").alias("error_class"))


@register("a5_error_triage", fixtures=["log_messages"], oracle="""
select error_class, count(*) as n_messages from (
  select case
    when lower(message) like '%not found%' or lower(message) like '%does not exist%'
      or contains(lower(message), 'not_found') or lower(message) like '%notfound%' then 'not_found'
    when lower(message) like '%already exists%' or contains(lower(message), 'already_exists') then 'already_exists'
    when lower(message) like '%conflict%' or lower(message) like '%in progress%' then 'conflict'
    else 'other' end as error_class
  from log_messages) t group by error_class""")
def a5(spark, sf_dir):
    return error_triage(Fixtures(spark, sf_dir).log_messages)


@register("c1_dns_name", oracle=f"""
select p_partkey, {dns_sql('p_name')} as dns_name, {dns_sql('p_type')} as dns_type,
       {dns_sql("p_brand || '_' || p_type")} as dns_brand_type from part""")
def c1(spark, sf_dir):
    part = Fixtures(spark, sf_dir).part
    return part.select("p_partkey", dns_name("p_name").alias("dns_name"), dns_name("p_type").alias("dns_type"),
                       dns_name(F.concat("p_brand", F.lit("_"), "p_type")).alias("dns_brand_type"))


@register("a6_store_name_audit", ctes={
    "names": """select p_type as name from part
                union all select replace(lower(p_type), ' ', '_') from part
                union all select regexp_replace(p_brand, '[A-Za-z0-9]', '', 'g') from part""",
    "pairs": f"""select distinct {dns_sql('name')} as dns_name, name from names where name is not null"""},
    oracle="""
select dns_name, count(*) as n_names, case when dns_name = '' then 'empty' else 'collision' end as problem
from pairs group by dns_name having count(*) > 1 or dns_name = ''""")
def a6(spark, sf_dir):
    part = Fixtures(spark, sf_dir).part
    names = (part.select(F.col("p_type").alias("n"))
             .unionByName(part.select(F.replace(F.lower("p_type"), F.lit(" "), F.lit("_")).alias("n")))
             .unionByName(part.select(F.regexp_replace("p_brand", "[A-Za-z0-9]", "").alias("n"))))
    return store_name_audit(names, "n")


@register("c2_shared_name", fixtures=["dependencies", "registered_models"], ctes={
    "names": """select distinct dep_name as name from dependencies
                union select distinct catalog_name || '.' || schema_name || '.' || regexp_extract(model_name, '[^.]*$')
                from registered_models
                union select distinct model_name from registered_models
                union select distinct regexp_extract(model_name, '[^.]*$') from registered_models"""},
    oracle="""
select name,
       case when len(string_split(name, '.')) = 3
            then 'shared_cat.' || split_part(name, '.', 2) || '.' || split_part(name, '.', 3)
            else name end as shared,
       'main.default.' || regexp_extract(name, '[^.]*$') || '_online' as online
from names""")
def c2(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    rm = fx.registered_models
    names = (fx.dependencies.select(F.col("dep_name").alias("name"))
             .union(rm.select(F.concat_ws(".", "catalog_name", "schema_name", short_name("model_name"))))
             .union(rm.select("model_name")).union(rm.select(short_name("model_name"))).distinct())
    return names.select("name", shared_name("name", "shared_cat").alias("shared"),
                        online_name("name", "main", "default").alias("online"))


@register("c6_state_class", fixtures=["status_events"], oracle=f"""
select object_name, ts, state, {online_table_state_sql('state')} as table_state,
       case when upper(regexp_extract(coalesce(state, ''), '[^.]*$')) = 'AVAILABLE' then 'ready' else 'waiting' end as store_state,
       case when upper(coalesce(state, '')) like '%AVAILABLE%' then 'ready' else 'waiting' end as store_state_compat
from status_events""")
def c6(spark, sf_dir):
    se = Fixtures(spark, sf_dir).status_events
    return se.select("object_name", "ts", "state",
                     state_class("online_table", "state").alias("table_state"),
                     state_class("online_store", "state").alias("store_state"),
                     state_class("online_store", "state", compat=True).alias("store_state_compat"))


@register("c7_endpoint_name", fixtures=["model_versions"], oracle=f"""
select model_name,
       'target-' || {dns_sql("regexp_extract(model_name, '[^.]*$')")} || '-endpoint' as endpoint_name,
       'source-' || regexp_extract(model_name, '[^.]*$') || '-endpoint' as source_endpoint_name,
       '{HOST}/serving-endpoints/target-' || {dns_sql("regexp_extract(model_name, '[^.]*$')")}
         || '-endpoint/invocations' as invocation_url
from (select distinct model_name from model_versions) m""")
def c7(spark, sf_dir):
    m = Fixtures(spark, sf_dir).model_versions.select("model_name").distinct()
    return m.select("model_name", endpoint_name("model_name").alias("endpoint_name"),
                    source_endpoint_name(short_name("model_name")).alias("source_endpoint_name"),
                    invocation_url(HOST, endpoint_name("model_name")).alias("invocation_url"))


# ---------------------------------------------------------------- T1, T2, A3

TIMEOUT_S = 600  # the reference's online-table wait


def _readiness_sql(events: str, timeout_s: int) -> dict:
    return {
        "ev": f"""select object_name, ts, {online_table_state_sql('state')} as cls from {events}""",
        "fs": "select object_name, min(ts) as first_seen from ev group by object_name",
        "dc": """select object_name, min(ts) as dts, arg_min(cls, ts) as dcls from ev
                 where cls in ('ready', 'failed') group by object_name""",
        "rd": f"""select f.object_name, f.first_seen as start_ts,
                         f.first_seen + interval {timeout_s} second as deadline,
                         case when d.dts < f.first_seen + interval {timeout_s} second then d.dcls else 'timeout' end as verdict,
                         case when d.dts < f.first_seen + interval {timeout_s} second then d.dts end as decided_at
                  from fs f left join dc d on f.object_name = d.object_name""",
    }


@register("t1_readiness", fixtures=["status_events"], ctes=_readiness_sql("status_events", TIMEOUT_S),
          oracle="select * from rd")
def t1(spark, sf_dir):
    return readiness(Fixtures(spark, sf_dir).status_events, TIMEOUT_S)


@register("t2_poll_samples", fixtures=["status_events"], oracle=f"""
select object_name, time_bucket(interval '30 seconds', ts) as window_start,
       arg_max(state, ts) as state, {online_table_state_sql('arg_max(state, ts)')} as state_class,
       count(*) as n_events
from status_events group by object_name, time_bucket(interval '30 seconds', ts)""")
def t2(spark, sf_dir):
    return poll_samples(Fixtures(spark, sf_dir).status_events, 30)


GRID_S = 6 * 3600


@register("t2_poll_grid", fixtures=["status_events"], ctes={
    "s": f"""select object_name, time_bucket(interval '{GRID_S} seconds', ts) as w, arg_max(state, ts) as state, count(*) as n
             from status_events group by 1, 2""",
    "grid": f"""select object_name, unnest(generate_series(min(w), max(w), interval '{GRID_S} seconds')) as w
                from s group by object_name"""}, oracle=f"""
select g.object_name, g.w as window_start, s.state, {online_table_state_sql('s.state')} as state_class,
       case when s.w = g.w then s.n else 0 end as n_events
from grid g asof join s on g.object_name = s.object_name and g.w >= s.w""")
def t2_grid(spark, sf_dir):
    return poll_grid(Fixtures(spark, sf_dir).status_events, GRID_S)


TABLE_TIMEOUT_S = 6 * 3600


def _model_tables(fx):
    """Online tables of every model's latest version with their publish outcomes, and the
    readiness of just those tables."""
    latest = latest_model_version(fx.model_versions.select("model_name", "version"))
    deps = distinct_dependencies(cut_to_versions(fx.dependencies, latest))
    tables = (deps.where(F.col("dep_type") == "TABLE")
              .select("model_name", F.col("dep_name").alias("source_table_name"),
                      online_name("dep_name", "main", "default").alias("online_table_name"))
              .join(fx.publish_outcomes, "source_table_name", "left"))
    log = fx.table_status_events.join(
        tables.select(F.col("online_table_name").alias("object_name")).distinct(), "object_name", "left_semi")
    return latest, tables, readiness(log, TABLE_TIMEOUT_S)


MODEL_TABLES = """select d.model_name, 'main.default.' || regexp_extract(d.dep_name, '[^.]*$') || '_online' as online_table_name,
                         p.outcome from ldeps d left join publish_outcomes p on p.source_table_name = d.dep_name
                  where d.dep_type = 'TABLE'"""
OK = "coalesce(r.verdict = 'ready' and t.outcome in ('published', 'exists'), false)"


@register("a3_publish_rollup", fixtures=["model_versions", "dependencies", "table_status_events", "publish_outcomes"], ctes={
    "latest": SOURCE_CTES["latest"], "ldeps": SOURCE_CTES["ldeps"],
    **_readiness_sql("table_status_events", TABLE_TIMEOUT_S),
    "tabs": MODEL_TABLES},
    oracle=f"""
select t.model_name, count(*) as n_tables, count(case when t.outcome = 'published' then 1 end) as n_published,
       count(case when t.outcome = 'exists' then 1 end) as n_exists,
       count(case when t.outcome = 'failed' then 1 end) as n_failed,
       count(case when {OK} then 1 end) as n_ready, bool_and({OK}) as all_ready
from tabs t left join rd r on t.online_table_name = r.object_name
group by t.model_name""")
def a3(spark, sf_dir):
    _, tables, ready = _model_tables(Fixtures(spark, sf_dir))
    return publish_rollup(tables, ready, group_cols=["model_name"]).select(
        "model_name", "n_tables", "n_published", "n_exists", "n_failed", "n_ready", "all_ready")


# ---------------------------------------------------------------- C9, C10

def _flags(model_col):
    num = F.regexp_extract(model_col, r"(\d+)$", 1).cast("int")
    return (num % 3 != 0).alias("create_online_table"), (num % 4 != 0).alias("deploy_serving")


@register("c9_deployment_decision", fixtures=["model_versions", "dependencies", "table_status_events", "publish_outcomes"], ctes={
    "latest": SOURCE_CTES["latest"], "ldeps": SOURCE_CTES["ldeps"],
    **_readiness_sql("table_status_events", TABLE_TIMEOUT_S),
    "tabs": MODEL_TABLES,
    "roll": f"""select t.model_name, count(*) as n_tables, bool_and({OK}) as all_ready
                from tabs t left join rd r on t.online_table_name = r.object_name group by t.model_name""",
    "m": """select l.model_name, coalesce(r.n_tables, 0) as n_tables, r.all_ready,
                   cast(regexp_extract(l.model_name, '(\\d+)$', 1) as integer) % 3 <> 0 as create_online_table,
                   cast(regexp_extract(l.model_name, '(\\d+)$', 1) as integer) % 4 <> 0 as deploy_serving
            from latest l left join roll r on l.model_name = r.model_name"""},
    oracle="""
select model_name, create_online_table, deploy_serving, n_tables,
       case when create_online_table and n_tables > 0 then 'run'
            when create_online_table then 'skip_none_needed' else 'disabled' end as online_step,
       case when create_online_table and n_tables > 0 then coalesce(all_ready, false)
            when create_online_table then true else false end as tables_ready,
       case when not deploy_serving then 'off'
            when n_tables > 0 and not (case when create_online_table and n_tables > 0 then coalesce(all_ready, false)
                                            when create_online_table then true else false end) then 'blocked'
            else 'yes' end as deploy
from m""")
def c9(spark, sf_dir):
    latest, tables, ready = _model_tables(Fixtures(spark, sf_dir))
    roll = publish_rollup(tables, ready, group_cols=["model_name"])
    m = (latest.join(roll.select("model_name", "n_tables", "all_ready"), "model_name", "left")
         .select("model_name", F.coalesce("n_tables", F.lit(0)).alias("n_tables"), "all_ready",
                 *_flags(F.col("model_name"))))
    return deployment_decision(m).select("model_name", "create_online_table", "deploy_serving", "n_tables",
                                         "online_step", "tables_ready", "deploy")


@register("c10_run_summary", fixtures=REQ_FX + ["share_objects", "share_grants", "recipients"], ctes={
    **SOURCE_CTES, **PLAN_CTES,
    "toadd": """select share_name, model_name, count(*) as n_to_add from wanted w
                where not exists (select 1 from share_objects s where s.share_name = w.share_name
                                  and s.object_name = w.object_name) group by 1, 2""",
    "gm": """select distinct p.share_name, p.recipient_name from plan2 p where p.action <> 'error'
             and not exists (select 1 from share_grants g where g.share_name = p.share_name
                             and g.principal = p.recipient_name and g.privilege = 'SELECT')""",
    "wc": """select share_name, model_name, max(version) as version,
                    count(case when object_type = 'TABLE' then 1 end) as n_tables,
                    count(case when object_type = 'FUNCTION' then 1 end) as n_functions,
                    string_agg(object_name, ',' order by pos, object_name) filter (object_type = 'TABLE') as feature_tables,
                    string_agg(object_name, ',' order by pos, object_name) filter (object_type = 'FUNCTION') as functions
             from wanted group by 1, 2"""},
    oracle="""
select p.model_name, w.version, p.share_name, p.recipient_name, p.action as recipient_action,
       coalesce(w.n_tables, 0) as n_tables, coalesce(w.n_functions, 0) as n_functions,
       coalesce(w.feature_tables, '') as feature_tables, coalesce(w.functions, '') as functions,
       coalesce(a.n_to_add, 0) as n_to_add, g.recipient_name is not null as grant_missing,
       case when p.action = 'error' then 'error: recipient' when w.version is null then 'error: no versions'
            else 'ok' end as status
from plan2 p
left join wc w on p.share_name = w.share_name and p.model_name = w.model_name
left join toadd a on p.share_name = a.share_name and p.model_name = a.model_name
left join gm g on p.share_name = g.share_name and p.recipient_name = g.recipient_name""")
def c10(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    plan = source_plan(fx.share_requests, fx.model_versions, fx.dependencies, fx.share_objects,
                       fx.share_grants, fx.recipients)
    return (plan["summary"].withColumn("feature_tables", joined("feature_tables"))
            .withColumn("functions", joined("functions")))


def _nonempty(c):
    return f"nullif(nullif({c}, ''), 'NONE')"


@register("c10_target_summary", fixtures=["registered_models", "model_versions", "dependencies", "table_status_events",
                                          "publish_outcomes", "catalog_settings", "catalogs", "online_stores"], ctes={
    **W3_CTES,
    **_readiness_sql("table_status_events", TABLE_TIMEOUT_S),
    "fsum": """select f.catalog_name, f.schema_name, f.model_name, f.version,
                      count(case when d.dep_type = 'TABLE' then 1 end) as n_tables,
                      count(case when d.dep_type = 'FUNCTION' then 1 end) as n_functions
               from found f left join fdeps d on f.model_name = d.model_name and f.version = d.version
               group by 1, 2, 3, 4""",
    "tabs": """select f.catalog_name, f.model_name, p.outcome,
                      c.online_table_target_catalog || '.' || c.online_table_target_schema || '.'
                      || regexp_extract(d.dep_name, '[^.]*$') || '_online' as online_table_name
               from found f join fdeps d on f.model_name = d.model_name and f.version = d.version
               join catalog_settings c on c.catalog_name = f.catalog_name
               left join publish_outcomes p on p.source_table_name = d.dep_name
               where d.dep_type = 'TABLE'""",
    "roll": f"""select t.catalog_name, t.model_name, count(case when {OK} then 1 end) as n_ready,
                       count(case when t.outcome = 'failed' then 1 end) as n_failed, bool_and({OK}) as all_ready
                from tabs t left join rd r on t.online_table_name = r.object_name group by 1, 2""",
    "bad": f"""select catalog_name from catalog_settings where create_online_table and (
                 {_nonempty('share_name')} is null or {_nonempty('provider_name')} is null or {_nonempty('target_catalog')} is null
                 or {_nonempty('online_table_target_catalog')} is null or {_nonempty('online_table_target_schema')} is null)""",
    "st": f"""select x.catalog_name, x.store_name,
                     case when s.store_name is not null then 'use' when x.create_online_store then 'create' else 'error' end as store_action,
                     coalesce(upper(regexp_extract(s.state, '[^.]*$')) = 'AVAILABLE', false) as store_ready
              from (select catalog_name, create_online_store,
                           {dns_sql(f"coalesce({_nonempty('online_store_name')}, online_table_target_catalog || '-online-store')")} as store_name
                    from catalog_settings where create_online_table) x
              left join online_stores s on s.store_name = x.store_name""",
    "m": """select s.*, coalesce(r.n_ready, 0) as n_ready, coalesce(r.n_failed, 0) as n_failed,
                   coalesce(c.create_online_table, false) as create_online_table, coalesce(c.deploy_serving, false) as deploy_serving,
                   c.online_table_target_catalog || '.' || c.online_table_target_schema as loc,
                   st.store_name, st.store_action, coalesce(st.store_ready, false) as store_ready,
                   coalesce(r.all_ready, false) and coalesce(st.store_ready, false) as ok,
                   case when b.catalog_name is not null then 'config'
                        when c.use_existing and k.catalog_name is null then 'catalog' end as stop
            from fsum s left join roll r on s.catalog_name = r.catalog_name and s.model_name = r.model_name
            left join catalog_settings c on c.catalog_name = s.catalog_name
            left join (select distinct catalog_name from bad) b on b.catalog_name = s.catalog_name
            left join catalogs k on k.catalog_name = s.catalog_name
            left join st on st.catalog_name = s.catalog_name""",
    "d": """select *,
                   case when create_online_table and n_tables > 0 then 'run'
                        when create_online_table then 'skip_none_needed' else 'disabled' end as online_step,
                   case when create_online_table and n_tables > 0 then ok else create_online_table end as tables_ready
            from m""",
    "e": """select *, case when stop is not null then 'stopped' when not deploy_serving then 'off'
                           when n_tables > 0 and not tables_ready then 'blocked' else 'yes' end as deploy from d"""},
    oracle=f"""
select catalog_name, model_name, version, n_tables, n_functions, n_ready, n_failed, online_step, store_name, store_action,
       tables_ready, deploy,
       case when deploy = 'stopped' then stop when deploy <> 'blocked' then null
            when online_step = 'disabled' then 'no_online_tables' when not store_ready then 'store'
            when n_failed > 0 then 'publish' else 'readiness' end as blocked_by,
       case when deploy = 'yes' then 'target-' || {dns_sql("regexp_extract(model_name, '[^.]*$')")} || '-endpoint' end as endpoint_name,
       case when deploy = 'yes' then '{HOST}/serving-endpoints/target-' || {dns_sql("regexp_extract(model_name, '[^.]*$')")}
                 || '-endpoint/invocations' end as invocation_url,
       case when create_online_table then loc end as online_location
from e""")
def c10t(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return target_plan(fx.registered_models, fx.model_versions, fx.dependencies, fx.table_status_events,
                       fx.catalog_settings, fx.catalogs, fx.publish_outcomes, fx.online_stores, HOST,
                       TABLE_TIMEOUT_S)["summary"]


@register("c6_store_plan", fixtures=["catalog_settings", "online_stores"], oracle=f"""
select x.catalog_name, x.store_name,
       case when s.store_name is not null then 'use' when x.create_online_store then 'create' else 'error' end as store_action,
       coalesce(upper(regexp_extract(s.state, '[^.]*$')) = 'AVAILABLE', false) as store_ready
from (select catalog_name, create_online_store,
             {dns_sql(f"coalesce({_nonempty('online_store_name')}, online_table_target_catalog || '-online-store')")} as store_name
      from catalog_settings where create_online_table) x
left join online_stores s on s.store_name = x.store_name""")
def c6_stores(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    return store_plan(fx.catalog_settings, fx.online_stores)
