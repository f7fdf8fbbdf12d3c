"""The source side for every request at once: recipient, latest version, dependencies,
objects to add, grants to make, and a run summary (J6, W1, W2, U1, J3, J5, C10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featshare.operators.registry import wanted_objects
from featshare.operators.sharing import grant_plan, recipient_plan, share_update_plan
from featshare.session import materialize


def source_run_summary(plan: DataFrame, wanted: DataFrame, to_add: DataFrame,
                       grants_missing: DataFrame) -> DataFrame:
    """C10 (source): one row per request: model, version, share, recipient, dependency
    counts and names (in dependency order; a list is as long as its model's dependencies),
    objects to add, whether a grant is missing, and a status. A model without versions or a
    recipient step that cannot proceed is an ``error``."""
    def names(kind):
        own = F.when(F.col("object_type") == kind, F.struct("pos", "object_name"))
        return F.array_sort(F.collect_set(own))["object_name"]

    w = wanted.groupBy("share_name", "model_name").agg(
        F.max("version").alias("version"),
        F.count_if(F.col("object_type") == "TABLE").alias("n_tables"),
        F.count_if(F.col("object_type") == "FUNCTION").alias("n_functions"),
        names("TABLE").alias("feature_tables"), names("FUNCTION").alias("functions"))
    a = to_add.groupBy("share_name", "model_name").agg(F.count(F.lit(1)).alias("n_to_add"))
    g = grants_missing.select("share_name", F.col("principal").alias("recipient_name"),
                              F.lit(True).alias("grant_missing")).distinct()
    j = (plan.select("share_name", "model_name", "recipient_name", "action")
         .join(w, ["share_name", "model_name"], "left")
         .join(a, ["share_name", "model_name"], "left")
         .join(g, ["share_name", "recipient_name"], "left"))
    status = (F.when(F.col("action") == "error", F.lit("error: recipient"))
              .when(F.col("version").isNull(), F.lit("error: no versions"))
              .otherwise(F.lit("ok")))
    return j.select(
        "model_name", "version", "share_name", "recipient_name",
        F.col("action").alias("recipient_action"),
        F.coalesce("n_tables", F.lit(0)).alias("n_tables"),
        F.coalesce("n_functions", F.lit(0)).alias("n_functions"),
        F.coalesce("feature_tables", F.array().cast("array<string>")).alias("feature_tables"),
        F.coalesce("functions", F.array().cast("array<string>")).alias("functions"),
        F.coalesce("n_to_add", F.lit(0)).alias("n_to_add"),
        F.coalesce("grant_missing", F.lit(False)).alias("grant_missing"),
        status.alias("status"))


def source_plan(requests: DataFrame, model_versions: DataFrame, deps: DataFrame,
                share_objects: DataFrame, grants: DataFrame, recipients: DataFrame,
                stage: bool = True) -> dict:
    """All source-side results. The recipient plan and the wanted objects feed several
    results; with ``stage`` they are written once to the shared work folder (both are
    request-sized) so the version and dependency scans run once, not once per use."""
    plan = recipient_plan(requests, recipients)
    wanted = wanted_objects(requests, model_versions, deps)
    if stage:
        plan, wanted = materialize(plan, "recipient-plan"), materialize(wanted, "wanted-objects")
    to_add = share_update_plan(wanted, share_objects)
    missing = grant_plan(plan, grants)
    return {"recipients": plan, "wanted": wanted, "to_add": to_add, "grants": missing,
            "summary": source_run_summary(plan, wanted, to_add, missing)}
