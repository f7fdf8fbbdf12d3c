"""The target side for every catalog at once: config and catalog gates, discovery, online
store and tables, readiness gate and summary (P3, J11, W3, C2, C6, T1, A3, C9, C10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featshare.functions.names import dns_name, endpoint_name, invocation_url, online_name
from featshare.functions.states import online_store_state
from featshare.operators.quality import validate_target_configs
from featshare.operators.readiness import publish_rollup, readiness
from featshare.operators.registry import discover_model
from featshare.operators.sharing import catalog_plan
from featshare.session import materialize


def deployment_decision(df: DataFrame) -> DataFrame:
    """From ``create_online_table``, ``deploy_serving``, ``n_tables`` and
    ``all_ready``: the online step (``run``, ``skip_none_needed``, ``disabled``), whether
    tables count as ready, and the deploy decision (``yes``, ``blocked``, ``off``).
    Deployment is blocked when the model has feature tables that are not ready."""
    create = F.coalesce(F.col("create_online_table"), F.lit(False))
    deploy = F.coalesce(F.col("deploy_serving"), F.lit(False))
    has = F.coalesce(F.col("n_tables"), F.lit(0)) > 0
    step = (F.when(create & has, F.lit("run")).when(create, F.lit("skip_none_needed"))
            .otherwise(F.lit("disabled")))
    ready = (F.when(create & has, F.coalesce(F.col("all_ready"), F.lit(False)))
             .when(create, F.lit(True)).otherwise(F.lit(False)))
    decision = (F.when(~deploy, F.lit("off")).when(has & ~ready, F.lit("blocked"))
                .otherwise(F.lit("yes")))
    return df.withColumn("online_step", step).withColumn("tables_ready", ready) \
        .withColumn("deploy", decision)


def store_plan(settings: DataFrame, stores: DataFrame) -> DataFrame:
    """The online store of every catalog that wants online tables: its DNS name (the given
    one, else ``<online catalog>-online-store``), the action (``use``, ``create``, ``error``
    when it is missing and may not be created) and whether it is available now."""
    given = F.nullif(F.nullif("online_store_name", F.lit("")), F.lit("NONE"))
    name = dns_name(F.coalesce(given, F.concat("online_table_target_catalog", F.lit("-online-store"))))
    have = stores.select("store_name", (online_store_state("state") == "ready").alias("_ready"))
    j = (settings.where(F.coalesce("create_online_table", F.lit(False)))
         .select("catalog_name", name.alias("store_name"), F.coalesce("create_online_store", F.lit(False)).alias("_may"))
         .join(have, "store_name", "left"))
    action = (F.when(F.col("_ready").isNotNull(), F.lit("use")).when(F.col("_may"), F.lit("create"))
              .otherwise(F.lit("error")))
    return j.select("catalog_name", "store_name", action.alias("store_action"),
                    F.coalesce("_ready", F.lit(False)).alias("store_ready"))


def target_plan(registered_models: DataFrame, model_versions: DataFrame, deps: DataFrame,
                status_events: DataFrame, settings: DataFrame, catalogs: DataFrame, outcomes: DataFrame,
                stores: DataFrame, host: str, timeout_s: int = 600, stage: bool = True) -> dict:
    """All target-side results. ``settings`` has one row per catalog: use_existing,
    create_online_table, deploy_serving, the P3 fields, online_store_name and
    create_online_store. ``outcomes`` (source_table_name, outcome) says how publishing each
    table ended (S10), ``stores`` which online stores exist.

    Gates, in order: a config that fails P3 (checked when online tables are wanted) and a
    catalog that cannot be set up (J11 ``error``) stop the catalog's run; a store that is not
    available, a failed publish and a table that is not ready leave the tables not ready,
    which blocks deployment (C9). ``blocked_by`` names the first gate that closed.

    The discovered models (one row per catalog) feed both the table list and the summary;
    with ``stage`` they are written once to the shared work folder so discovery runs once.
    The status log is cut to the wanted online tables before it is aggregated.
    """
    found = discover_model(registered_models, model_versions, deps)
    if stage:
        found = materialize(found, "discovered-models")
    where_to = settings.select("catalog_name", "online_table_target_catalog", "online_table_target_schema")
    tables = (found.select("catalog_name", "model_name", F.explode("tables").alias("source_table_name"))
              .join(where_to, "catalog_name")
              .withColumn("online_table_name", online_name(
                  "source_table_name", F.col("online_table_target_catalog"), F.col("online_table_target_schema")))
              .join(outcomes.select("source_table_name", "outcome"), "source_table_name", "left"))
    wanted = tables.select(F.col("online_table_name").alias("object_name")).distinct()
    ready = readiness(status_events.join(wanted, "object_name", "left_semi"), timeout_s)
    roll = publish_rollup(tables, ready, group_cols=("catalog_name", "model_name"))
    online = settings.where(F.coalesce("create_online_table", F.lit(False)))
    invalid = (validate_target_configs(online, ("catalog_name",)).groupBy("catalog_name")
               .agg(F.count(F.lit(1)).alias("n_config_errors")))
    setup = catalog_plan(settings.select("catalog_name", "use_existing"), catalogs).select(
        "catalog_name", F.col("action").alias("catalog_action"))
    store = store_plan(settings, stores)
    base = (found.select("catalog_name", "schema_name", "model_name", "version", "n_tables", "n_functions")
            .join(roll.select("catalog_name", "model_name", "n_ready", "n_failed", F.col("all_ready").alias("_all")),
                  ["catalog_name", "model_name"], "left")
            .join(settings, "catalog_name", "left")
            .join(invalid, "catalog_name", "left").join(setup, "catalog_name", "left").join(store, "catalog_name", "left"))
    store_ok = F.coalesce("store_ready", F.lit(False))
    base = base.withColumn("all_ready", F.col("_all") & store_ok)
    decided = deployment_decision(base)
    stop = (F.when(F.coalesce("n_config_errors", F.lit(0)) > 0, F.lit("config"))
            .when(F.col("catalog_action") == "error", F.lit("catalog")))
    closed = (F.when(stop.isNotNull(), stop).when(F.col("deploy") != "blocked", F.lit(None).cast("string"))
              .when(F.col("online_step") == "disabled", F.lit("no_online_tables"))
              .when(~store_ok, F.lit("store"))
              .when(F.coalesce("n_failed", F.lit(0)) > 0, F.lit("publish")).otherwise(F.lit("readiness")))
    decided = decided.withColumn("blocked_by", closed).withColumn(
        "deploy", F.when(stop.isNotNull(), F.lit("stopped")).otherwise(F.col("deploy")))
    ep = endpoint_name("model_name")
    summary = decided.select(
        "catalog_name", "model_name", "version", "n_tables", "n_functions",
        F.coalesce("n_ready", F.lit(0)).alias("n_ready"), F.coalesce("n_failed", F.lit(0)).alias("n_failed"),
        "online_step", "store_name", "store_action", "tables_ready", "deploy", "blocked_by",
        F.when(F.col("deploy") == "yes", ep).alias("endpoint_name"),
        F.when(F.col("deploy") == "yes", invocation_url(host, ep)).alias("invocation_url"),
        F.when(F.coalesce("create_online_table", F.lit(False)), F.concat_ws(
            ".", "online_table_target_catalog", "online_table_target_schema")).alias("online_location"))
    return {"found": found, "tables": tables, "readiness": ready, "rollup": roll,
            "decision": decided, "summary": summary}
