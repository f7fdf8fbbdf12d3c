"""Share, recipient, grant, catalog and endpoint plans as joins.

Each plan is computed for every request at once; the result rows are the actions the
control plane would take, one per object.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featshare.functions.names import endpoint_name, invocation_url
from featshare.functions.states import endpoint_state

PRESENT_KEYS = ["share_name", "object_name"]

# Recipient authentication types, as the recipient records spell them.
# Models and functions go only to recipients of the first kind; tables to either.
AUTH_D2D = "DATABRICKS"
AUTH_TOKEN = "TOKEN"
# Fixed value: the marker in a catalog type that says the catalog was made from a share.
SHARING_CATALOG_MARK = "DELTASHARING"


def share_update_plan(wanted: DataFrame, share_objects: DataFrame) -> DataFrame:
    """Objects to ADD: wanted minus present, matched by name only (not type), as
    the reference does. History sharing is ``ENABLED`` for tables only. Order by
    ``type_rank`` then ``pos`` (model, tables, functions)."""
    present = share_objects.select(*PRESENT_KEYS).distinct()
    return (wanted.join(present, PRESENT_KEYS, "left_anti")
            .withColumn("history_data_sharing_status",
                        F.when(F.col("object_type") == "TABLE", F.lit("ENABLED"))))


def already_shared(wanted: DataFrame, share_objects: DataFrame) -> DataFrame:
    """The wanted objects that are present."""
    return wanted.join(share_objects.select(*PRESENT_KEYS).distinct(), PRESENT_KEYS, "left_semi")


def recipient_plan(requests: DataFrame, recipients: DataFrame) -> DataFrame:
    """Per request, the recipient actually used and the action, first match wins:

    same metastore -> ``self`` / use_self; known target metastore: existing TOKEN ->
    keep_token_warn, existing other -> update_metastore, missing -> create_d2d or error;
    unknown target metastore: existing -> keep, missing -> create_token or error.
    ``effective_auth`` is the authentication the recipient has after the action.
    """
    r = recipients.select("recipient_name", F.col("authentication_type").alias("existing_auth"),
                          F.lit(True).alias("_exists"))
    j = requests.join(r, "recipient_name", "left")
    tgt, src = F.col("target_metastore_id"), F.col("source_metastore_id")
    known = tgt.isNotNull() & (tgt != F.lit(""))
    same = known & tgt.eqNullSafe(src)
    exists = F.coalesce(F.col("_exists"), F.lit(False))
    create = F.coalesce(F.col("create_recipient"), F.lit(False))
    token = F.upper(F.coalesce(F.col("existing_auth"), F.lit(""))).contains(AUTH_TOKEN)
    action = (F.when(same, F.lit("use_self"))
              .when(known & exists & token, F.lit("keep_token_warn"))
              .when(known & exists, F.lit("update_metastore"))
              .when(known & create, F.lit("create_d2d"))
              .when(known, F.lit("error"))
              .when(exists, F.lit("keep"))
              .when(create, F.lit("create_token"))
              .otherwise(F.lit("error")))
    out = j.select(
        *[c for c in requests.columns if c != "recipient_name"],
        F.col("recipient_name").alias("requested_recipient"),
        F.when(same, F.lit("self")).otherwise(F.col("recipient_name")).alias("recipient_name"),
        "existing_auth", action.alias("action"))
    eff = (F.when(F.col("action").isin("use_self", "create_d2d"), F.lit(AUTH_D2D))
           .when(F.col("action") == "create_token", F.lit(AUTH_TOKEN))
           .when(F.col("action") == "error", F.lit(None).cast("string"))
           .otherwise(F.col("existing_auth")))
    return out.withColumn("effective_auth", eff)


def grant_plan(plan: DataFrame, grants: DataFrame, privilege: str = "SELECT") -> DataFrame:
    """SELECT grants still missing for the recipients the plan uses (requests whose
    recipient step failed get no grant)."""
    want = (plan.where(F.col("action") != "error")
            .select("share_name", F.col("recipient_name").alias("principal"),
                    F.lit(privilege).alias("privilege")).distinct())
    return want.join(grants.select("share_name", "principal", "privilege"),
                     ["share_name", "principal", "privilege"], "left_anti")


def shareable(objects: DataFrame, plan: DataFrame) -> DataFrame:
    """P5: can each wanted object go to the request's recipient? MODEL and FUNCTION
    need D2D authentication (``AUTH_D2D``), TABLE may also go to ``AUTH_TOKEN``,
    CONNECTION never.
    ``objects`` has (share_name, model_name, object_name, object_type); ``plan`` is J6."""
    p = plan.select("share_name", "model_name", "recipient_name", "effective_auth")
    j = objects.select("share_name", "model_name", "object_name", "object_type") \
        .join(p, ["share_name", "model_name"], "left")
    auth, typ = F.col("effective_auth"), F.col("object_type")
    reason = (F.when(typ == "CONNECTION", F.lit("connection_never_shared"))
              .when(auth.isNull(), F.lit("no_recipient"))
              .when(typ.isin("MODEL", "FUNCTION") & (auth != AUTH_D2D), F.lit("needs_d2d"))
              .when(typ.isin("MODEL", "FUNCTION", "TABLE"), F.lit(None).cast("string"))
              .otherwise(F.lit("unsupported_type")))
    return j.select("share_name", "model_name", "recipient_name", "object_name", "object_type",
                    "effective_auth", reason.isNull().alias("shareable"), reason.alias("reason"))


def catalog_plan(wanted: DataFrame, catalogs: DataFrame) -> DataFrame:
    """Per wanted catalog (``catalog_name``, ``use_existing``): ``reuse`` if it
    exists, else ``error`` when told to use an existing one, else ``create``. Sharing
    catalogs are flagged by ``SHARING_CATALOG_MARK`` in their type."""
    c = catalogs.select("catalog_name", "catalog_type", F.lit(True).alias("_exists"))
    j = wanted.join(c, "catalog_name", "left")
    exists = F.coalesce(F.col("_exists"), F.lit(False))
    action = (F.when(exists, F.lit("reuse"))
              .when(F.coalesce(F.col("use_existing"), F.lit(False)), F.lit("error"))
              .otherwise(F.lit("create")))
    return j.select("catalog_name", "use_existing", action.alias("action"), "catalog_type",
                    F.col("catalog_type").contains(SHARING_CATALOG_MARK).alias("is_sharing_catalog"))


# The served entity settings every created or updated endpoint gets.
WORKLOAD_SIZE = "Small"
SCALE_TO_ZERO = True


def _served(endpoints: DataFrame) -> DataFrame:
    """Per endpoint, from one row per served entity: its states, the number of entities and
    the list of them (an endpoint's definition, a few entries)."""
    return endpoints.groupBy("endpoint_name").agg(
        F.max("ready").alias("ready"), F.max("config_update").alias("config_update"),
        F.count(F.lit(1)).alias("n_served"),
        F.array_sort(F.collect_list(F.struct("entity_name", "entity_version"))).alias("served"))


def endpoint_plan(models: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Per (model, latest version): ``create`` when no endpoint has the model's
    name, ``current`` when it already serves this entity and version, else ``update``
    (after the endpoint is ready for an update). ``models`` may name the endpoint
    (``endpoint_name``, null or empty: the generated name). ``endpoints`` has one row per
    served entity; the current one is the model's own, else the first."""
    given = F.nullif("endpoint_name", F.lit("")) if "endpoint_name" in models.columns else F.lit(None).cast("string")
    m = models.select("model_name", "version",
                      F.coalesce(given, endpoint_name("model_name")).alias("endpoint_name"))
    e = endpoints.select("endpoint_name", "entity_name", "entity_version",
                         endpoint_state("ready", "config_update").alias("endpoint_state"))
    j = m.join(e, "endpoint_name", "left")
    own = F.coalesce(F.col("entity_name") == F.col("model_name"), F.lit(False))
    # own entity first, then its served latest version, then by name
    rank = F.struct((~own).alias("a"), (F.col("entity_version") != F.col("version")).alias("b"),
                    F.col("entity_name").alias("c"), F.col("entity_version").alias("d"))
    one = j.groupBy("model_name", "version", "endpoint_name").agg(
        F.min_by(F.struct("entity_name", "entity_version", "endpoint_state"), rank).alias("_e"),
        F.count("entity_name").alias("n_served"))
    same = (F.col("_e.entity_name") == F.col("model_name")) & (F.col("_e.entity_version") == F.col("version"))
    action = (F.when(F.col("n_served") == 0, F.lit("create")).when(same, F.lit("current")).otherwise(F.lit("update")))
    return one.select("model_name", "version", "endpoint_name", F.col("_e.entity_name").alias("current_entity"),
                      F.col("_e.entity_version").alias("current_version"),
                      F.col("_e.endpoint_state").alias("endpoint_state"), "n_served", action.alias("action"),
                      F.lit(WORKLOAD_SIZE).alias("workload_size"),
                      F.lit(SCALE_TO_ZERO).alias("scale_to_zero_enabled"))


def list_shares(shares: DataFrame) -> DataFrame:
    """Share listing; ``created_at`` as a string, empty values as null."""
    return shares.select(
        F.col("share_name").alias("name"),
        F.nullif(F.col("comment"), F.lit("")).alias("comment"),
        F.nullif(F.col("created_at").cast("string"), F.lit("")).alias("created_at"),
        F.nullif(F.col("created_by"), F.lit("")).alias("created_by"))


def list_recipients(recipients: DataFrame) -> DataFrame:
    """Recipient listing; ``created_at`` as a string, empty values as null."""
    return recipients.select(
        F.col("recipient_name").alias("name"),
        F.nullif(F.col("authentication_type").cast("string"), F.lit("")).alias("authentication_type"),
        F.nullif(F.col("global_metastore_id"), F.lit("")).alias("global_metastore_id"),
        F.nullif(F.col("comment"), F.lit("")).alias("comment"),
        F.nullif(F.col("created_at").cast("string"), F.lit("")).alias("created_at"),
        F.nullif(F.col("created_by"), F.lit("")).alias("created_by"))


def endpoint_status(endpoints: DataFrame, host) -> DataFrame:
    """Per endpoint its name, states, served entities (``entity:version``, comma-joined,
    with their number), readiness and invocation URL."""
    entities = F.transform("served", lambda e: F.concat_ws(":", e["entity_name"], e["entity_version"]))
    return _served(endpoints).select(
        F.col("endpoint_name").alias("name"), "ready", "config_update", "n_served",
        F.array_join(entities, ",").alias("served"),
        endpoint_state("ready", "config_update").alias("state"),
        invocation_url(host, "endpoint_name").alias("invocation_url"))


def share_details(shares: DataFrame, share_objects: DataFrame, grants: DataFrame) -> DataFrame:
    """A2: share details, flattened: one row per (share, object), with its status, and per (share,
    principal) with the principal's sorted privileges, plus per-share counts. Shares
    with neither still get one row. Nothing collects a whole share into one value, and the
    items are joined from their own side: a share with a third of all objects is split by the
    skew-join rule, or broadcast as the small list of shares it is."""
    status = F.col("status") if "status" in share_objects.columns else F.lit(None).cast("string")
    objs = share_objects.select("share_name", F.lit("object").alias("item_kind"),
                                F.col("object_name").alias("item_name"),
                                F.col("object_type").alias("item_detail"), status.alias("item_status"))
    perms = (grants.groupBy("share_name", "principal")
             .agg(F.array_join(F.array_sort(F.collect_set("privilege")), ",").alias("item_detail"))
             .select("share_name", F.lit("permission").alias("item_kind"),
                     F.col("principal").alias("item_name"), "item_detail",
                     F.lit(None).cast("string").alias("item_status")))
    items = objs.unionByName(perms)
    counts = items.groupBy("share_name").agg(
        F.count(F.when(F.col("item_kind") == "object", 1)).alias("n_objects"),
        F.count(F.when(F.col("item_kind") == "permission", 1)).alias("n_permissions"))
    # dealt anew, else the join below has no exchange of its own to split
    s = (shares.select("share_name", "comment").join(counts, "share_name", "left")
         .repartition(F.xxhash64("share_name")))
    full = items.join(s, "share_name")
    none = (s.where(F.col("n_objects").isNull())
            .withColumns({c: F.lit(None).cast("string") for c in ("item_kind", "item_name", "item_detail", "item_status")}))
    return full.unionByName(none, allowMissingColumns=True).select(
        "share_name", "comment", "item_kind", "item_name", "item_detail", "item_status",
        F.coalesce("n_objects", F.lit(0)).alias("n_objects"),
        F.coalesce("n_permissions", F.lit(0)).alias("n_permissions"))
