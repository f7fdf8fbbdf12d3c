"""Named queries over the test tables and their DuckDB oracles.

``QUERIES[key](spark, sf_dir) -> DataFrame``; ``ORACLES[key]`` is plain SQL over the same
parquet tables (registered as views of the same names): the fixture SQL as CTEs, then a
body written by hand, not generated from the Spark plan. Every column is aliased the
same on both sides; lists are flattened to comma-joined strings in their defined order;
doubles that come out of sums are rounded.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from featshare.sources.fixtures import oracle_with

QUERIES: dict = {}
ORACLES: dict = {}


def register(key: str, fixtures=(), oracle: str | None = None, ctes: dict | None = None):
    """Register a query and (optionally) its oracle."""
    def deco(fn):
        QUERIES[key] = fn
        if oracle is not None:
            body = oracle.strip()
            if ctes:
                extra = ",\n".join(f"{k} AS ({v.strip()})" for k, v in ctes.items())
                if fixtures:
                    sql = oracle_with(fixtures, "")
                    ORACLES[key] = f"{sql},\n{extra}\n{body}"
                else:
                    ORACLES[key] = f"WITH {extra}\n{body}"
            else:
                ORACLES[key] = oracle_with(fixtures, body)
        return fn
    return deco


def joined(col):
    """A list column as one comma-joined string (order kept)."""
    return F.array_join(col, ",")


# ----------------------------------------------------------------------------
# SQL pieces shared by several oracles (DuckDB dialect).

LATEST = """
select model_name, arg_max(version, cast(version as bigint)) as version
from model_versions where try_cast(version as bigint) is not null group by model_name"""

LATEST_DEPS = """
select d.model_name, d.version, d.dep_type, d.dep_name, min(d.pos) as pos
from dependencies d join latest l on d.model_name = l.model_name and d.version = l.version
where d.dep_type in ('TABLE', 'FUNCTION') and d.dep_name is not null
group by d.model_name, d.version, d.dep_type, d.dep_name"""

REQ = """
select r.share_name, r.model_name, r.recipient_name, l.version
from share_requests r left join latest l on r.model_name = l.model_name"""

WANTED = """
select share_name, model_name, recipient_name, version, model_name as object_name,
       'MODEL' as object_type, 0 as type_rank, cast(0 as bigint) as pos from req
union all
select q.share_name, q.model_name, q.recipient_name, q.version, w.dep_name as object_name,
       w.dep_type as object_type,
       case when w.dep_type = 'TABLE' then 1 when w.dep_type = 'FUNCTION' then 2 else 3 end as type_rank,
       cast(w.pos as bigint) as pos
from req q join ldeps w on q.model_name = w.model_name and q.version = w.version"""

PLAN0 = """
select r.model_name, r.share_name, r.target_metastore_id, r.source_metastore_id, r.create_recipient,
       r.recipient_name, c.authentication_type as existing_auth, c.recipient_name is not null as ex,
       (r.target_metastore_id is not null and r.target_metastore_id <> '') as known,
       (r.target_metastore_id is not null and r.target_metastore_id <> ''
        and r.target_metastore_id is not distinct from r.source_metastore_id) as same
from share_requests r left join recipients c on r.recipient_name = c.recipient_name"""

PLAN = """
select model_name, share_name, target_metastore_id, source_metastore_id, create_recipient,
       recipient_name as requested_recipient,
       case when same then 'self' else recipient_name end as recipient_name, existing_auth,
       case when same then 'use_self'
            when known and ex and upper(coalesce(existing_auth, '')) like '%TOKEN%' then 'keep_token_warn'
            when known and ex then 'update_metastore'
            when known and coalesce(create_recipient, false) then 'create_d2d'
            when known then 'error'
            when ex then 'keep'
            when coalesce(create_recipient, false) then 'create_token'
            else 'error' end as action
from plan0"""

PLAN2 = """
select *, case when action in ('use_self', 'create_d2d') then 'DATABRICKS'
               when action = 'create_token' then 'TOKEN'
               when action = 'error' then null else existing_auth end as effective_auth
from plan"""

SOURCE_CTES = {"latest": LATEST, "ldeps": LATEST_DEPS, "req": REQ, "wanted": WANTED}
PLAN_CTES = {"plan0": PLAN0, "plan": PLAN, "plan2": PLAN2}


def dns_sql(x: str) -> str:
    return (f"regexp_replace(trim(lower(regexp_replace(replace({x}, '_', '-'), "
            f"'[^a-zA-Z0-9-]', '', 'g')), '-'), '-+', '-', 'g')")


def online_table_state_sql(x: str) -> str:
    u = f"upper(coalesce({x}, ''))"
    return (f"case when {u} like '%ONLINE%' and {u} not like '%OFFLINE%' then 'ready' "
            f"when {u} like '%FAILED%' then 'failed' else 'waiting' end")


def endpoint_state_sql(r: str, u: str) -> str:
    rr = f"upper(regexp_extract(coalesce({r}, ''), '[^.]*$'))"
    uu = f"upper(regexp_extract(coalesce({u}, ''), '[^.]*$'))"
    return (f"case when ({rr} = 'READY' and {uu} <> 'IN_PROGRESS') or {uu} = 'NOT_UPDATING' "
            f"then 'ready' else 'waiting' end")


HOST = "https://target.example.com"

# import the query modules so that they register themselves
from featshare.plans import queries_data, queries_meta  # noqa: E402,F401
