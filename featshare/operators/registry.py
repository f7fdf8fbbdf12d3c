"""Model registry questions over every model at once.

Per-model "latest" and "first" questions are aggregates (``max_by`` / ``min``), not
windows: aggregates combine map-side, so a model with a third of all versions costs one
partial row per map task in the shuffle rather than one task holding all its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featshare.functions.names import short_name

DEP_TYPES = ("TABLE", "FUNCTION")


def version_number(col: str = "version"):
    """Versions are strings holding integers; compare them as numbers. ``try_cast``
    gives null for a bad string instead of failing the job under ANSI mode."""
    return F.col(col).try_cast("bigint")


def version_rejects(model_versions: DataFrame, version_col: str = "version") -> DataFrame:
    """Rows whose version is not an integer (kept out of every comparison)."""
    return model_versions.where(version_number(version_col).isNull())


def latest_model_version(model_versions: DataFrame, model_col: str = "model_name",
                         version_col: str = "version") -> DataFrame:
    """The highest version per model, as a number, with the rest of its row.

    A hash aggregate finds the top number per model (fixed-width buffer, map-side
    combine: a model with a third of all versions ships one partial row per map task),
    then a semi join keeps the rows that carry it; AQE broadcasts the per-model maxima
    when their measured size allows. Only the few rows left, one per model unless two
    strings spell the same number ("7", "07"), go through the final ``max_by``.
    """
    rest = [c for c in model_versions.columns if c != model_col]
    v = model_versions.withColumn("_vnum", version_number(version_col)).where(F.col("_vnum").isNotNull())
    top = v.groupBy(model_col).agg(F.max("_vnum").alias("_vnum"))
    hits = v.join(top, [model_col, "_vnum"], "left_semi")
    return (hits.groupBy(model_col)
            .agg(F.max_by(F.struct(*rest), F.col(version_col)).alias("_l"))
            .select(model_col, *[F.col("_l")[c].alias(c) for c in rest]))


def versions_desc(model_versions: DataFrame, k: int, model_col: str = "model_name",
                  version_col: str = "version") -> DataFrame:
    """L2: the k newest versions per model, newest first (``version_rank`` 1..k).

    ``row_number() <= k`` is planned with a window group limit, which keeps only the
    top k per model in each map task before the shuffle."""
    vnum = version_number(version_col)
    w = Window.partitionBy(model_col).orderBy(vnum.desc())
    return (model_versions.where(vnum.isNotNull())
            .withColumn("version_rank", F.row_number().over(w))
            .where(F.col("version_rank") <= k))


def version_for_run(model_versions: DataFrame, runs: DataFrame) -> DataFrame:
    """The version that belongs to each (model, run id); if several do, the highest."""
    vnum = version_number("version")
    mv = model_versions.where(vnum.isNotNull()).select("model_name", "run_id", "version")
    return (runs.select("model_name", "run_id").join(mv, ["model_name", "run_id"], "inner")
            .groupBy("model_name", "run_id")
            .agg(F.max_by("version", version_number("version")).alias("version")))


def flatten_dependencies(df: DataFrame, deps_col: str = "dependencies",
                         keys=("model_name", "version")) -> DataFrame:
    """Nested dependencies (array of ``struct<table: struct<table_full_name>,
    function: struct<function_full_name>>``) to ``(keys, pos, dep_type, dep_name)``."""
    d = df.select(*keys, F.posexplode(deps_col).alias("pos", "dep"))
    table = F.col("dep.table.table_full_name")
    func = F.col("dep.function.function_full_name")
    return d.select(
        *keys, (F.col("pos") + 1).alias("pos"),
        F.when(table.isNotNull(), F.lit("TABLE")).when(func.isNotNull(), F.lit("FUNCTION")).alias("dep_type"),
        F.coalesce(table, func).alias("dep_name"))


def distinct_dependencies(deps: DataFrame) -> DataFrame:
    """One row per (model, version, type, name) with its first-seen position; types
    other than TABLE and FUNCTION are dropped."""
    return (deps.where(F.col("dep_type").isin(*DEP_TYPES) & F.col("dep_name").isNotNull())
            .groupBy("model_name", "version", "dep_type", "dep_name")
            .agg(F.min("pos").alias("pos")))


def cut_to_versions(deps: DataFrame, versions: DataFrame) -> DataFrame:
    """Dependencies of the given (model, version) pairs only: a semi join against the
    small version list (AQE broadcasts it when its measured size allows), done before
    any de-duplication or grouping so the bulk of the input is dropped first."""
    keys = ["model_name", "version"]
    return deps.join(versions.select(*keys), keys, "left_semi")


def _ordered_names(dep_type: str):
    picked = F.collect_list(F.when((F.col("dep_type") == dep_type) & F.col("dep_name").isNotNull(),
                                   F.struct("pos", "dep_name")))
    return F.transform(F.array_sort(picked), lambda x: x["dep_name"])


def dependency_summary(versions: DataFrame, deps: DataFrame) -> DataFrame:
    """A1: per (model, version) of ``versions``: ordered table and function lists,
    counts, ``has_feature_lookups`` and online table specs. No dependencies gives empty
    lists; dependencies of other types (connections: detected, never shared) and rows
    without a type or name are counted apart (``n_other_types``, ``n_unreadable``), so
    "none" and "could not be read" are told apart.

    Dependencies are first cut to the wanted versions (a semi join against the small
    version list), then grouped once per (model, version, type, name) with the first
    position and the row count (W2 and the counts come from this one pass), then
    listed. A list holds one model version's distinct dependencies, which is bounded by
    that version's definition.
    """
    return _with_dependencies(versions.select("model_name", "version"), deps)


def _with_dependencies(wanted: DataFrame, deps: DataFrame) -> DataFrame:
    """A1's columns behind those of ``wanted`` (model, version and any others)."""
    keys = ["model_name", "version"]
    others = [c for c in wanted.columns if c not in keys]
    g = (cut_to_versions(deps, wanted)
         .groupBy("model_name", "version", "dep_type", "dep_name")
         .agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("_rows")))
    readable = F.col("dep_type").isNotNull() & F.col("dep_name").isNotNull()
    lists = g.groupBy(*keys).agg(
        _ordered_names("TABLE").alias("tables"),
        _ordered_names("FUNCTION").alias("functions"),
        F.count_if(readable & ~F.col("dep_type").isin(*DEP_TYPES)).alias("n_other_types"),
        F.sum(F.when(~readable, F.col("_rows"))).alias("n_unreadable"))
    empty = F.array().cast("array<string>")
    out = wanted.join(lists, keys, "left").select(
        *keys, *others,
        F.coalesce("tables", empty).alias("tables"),
        F.coalesce("functions", empty).alias("functions"),
        F.coalesce("n_other_types", F.lit(0)).cast("bigint").alias("n_other_types"),
        F.coalesce("n_unreadable", F.lit(0)).cast("bigint").alias("n_unreadable"))
    return out.select(
        *keys, *others, "tables", "functions",
        F.size("tables").cast("bigint").alias("n_tables"),
        F.size("functions").cast("bigint").alias("n_functions"),
        (F.size("tables") > 0).alias("has_feature_lookups"),
        F.transform("tables", lambda t: F.struct(t.alias("source_table"),
                                                 short_name(t).alias("table_name_short")))
        .alias("online_table_specs"),
        "n_other_types", "n_unreadable")


def wanted_objects(requests: DataFrame, model_versions: DataFrame, deps: DataFrame,
                   include_all_types: bool = False) -> DataFrame:
    """Per request (model, share): the model, then the distinct tables, then the
    distinct functions of its latest version. ``type_rank`` (0 model, 1 table,
    2 function) and ``pos`` (first-seen position) give the order.

    ``include_all_types`` keeps other dependency types too (CONNECTION), for P5.
    """
    latest = latest_model_version(model_versions.select("model_name", "version"))
    # a model is an object of its own: every version carries it along like a dependency, so the
    # latest versions are found once and one join cuts both (they are unique; a semi join would be
    # pushed through the union and find them twice)
    own = model_versions.select("model_name", "version", F.lit("MODEL").alias("object_type"),
                                F.col("model_name").alias("object_name"), F.lit(0).cast("bigint").alias("pos"),
                                F.lit(0).alias("type_rank"))
    named = deps.where(F.col("dep_name").isNotNull())
    if not include_all_types:
        named = named.where(F.col("dep_type").isin(*DEP_TYPES))
    rank = (F.when(F.col("dep_type") == "TABLE", 1).when(F.col("dep_type") == "FUNCTION", 2)
            .otherwise(3))
    needed = named.select("model_name", "version", F.col("dep_type").alias("object_type"),
                          F.col("dep_name").alias("object_name"), F.col("pos").cast("bigint").alias("pos"),
                          rank.alias("type_rank"))
    objects = (own.unionByName(needed).join(latest, ["model_name", "version"])
               .groupBy("model_name", "version", "object_type", "object_name", "type_rank")
               .agg(F.min("pos").alias("pos")))
    # a model without a version still wants itself
    j = (requests.select("share_name", "model_name", "recipient_name")
         .join(objects, "model_name", "left"))
    none = F.col("object_name").isNull()
    return j.select("share_name", "model_name", "recipient_name", "version",
                    F.coalesce("object_name", "model_name").alias("object_name"),
                    F.when(none, F.lit("MODEL")).otherwise(F.col("object_type")).alias("object_type"),
                    F.coalesce("type_rank", F.lit(0)).alias("type_rank"),
                    F.coalesce("pos", F.lit(0)).cast("bigint").alias("pos"))


def dependency_drift(wanted: DataFrame, share_objects: DataFrame, shares: DataFrame | None = None) -> DataFrame:
    """Per share, objects the latest models need that are missing, and objects no
    longer needed. Only shares that have requests are compared. One full outer join.

    ``shares`` (the requests' share names) saves a second evaluation of ``wanted``; every
    request contributes its model row to ``wanted``, so both give the same set."""
    w = wanted.select("share_name", "object_name", F.col("object_type").alias("w_type")).distinct()
    shares = (w if shares is None else shares).select("share_name").distinct()
    s = (share_objects.join(shares, "share_name", "left_semi")
         .select("share_name", "object_name", F.col("object_type").alias("s_type")))
    j = w.join(s, ["share_name", "object_name"], "full_outer")
    drift = F.when(F.col("s_type").isNull(), F.lit("missing")).when(F.col("w_type").isNull(), F.lit("extra"))
    return (j.select("share_name", "object_name",
                     F.coalesce("w_type", "s_type").alias("object_type"), drift.alias("drift"))
            .where(F.col("drift").isNotNull()))


def schema_share(share_schemas: DataFrame, tables: DataFrame, name_col: str = "table_name") -> DataFrame:
    """Every table under each shared schema (``catalog.schema``), new ones included.
    An equi-join on the schema part of the name."""
    t = tables.withColumn("schema_full_name", F.substring_index(F.col(name_col), ".", 2))
    return share_schemas.join(t, "schema_full_name", "inner")


def shared_by_many(deps: DataFrame) -> DataFrame:
    """Dependencies used by more than one model, one row per (dependency, model),
    with the number of models. Two map-side-combined aggregations and a join; no list
    of models is ever built in one task."""
    pairs = deps.select("dep_type", "dep_name", "model_name").distinct()
    counts = (pairs.groupBy("dep_type", "dep_name").agg(F.count(F.lit(1)).alias("n_models"))
              .where(F.col("n_models") > 1))
    return pairs.join(counts, ["dep_type", "dep_name"], "inner")


def discover_model(registered_models: DataFrame, model_versions: DataFrame, deps: DataFrame) -> DataFrame:
    """Per catalog, the first model (by schema, then name) outside
    ``information_schema``, its latest version (``"1"`` when it has none) and its
    dependency lists (A1)."""
    first = (registered_models.where(F.col("schema_name") != "information_schema")
             .groupBy("catalog_name")
             .agg(F.min(F.struct("schema_name", "model_name")).alias("_f"))
             .select("catalog_name", F.col("_f.schema_name").alias("schema_name"),
                     F.col("_f.model_name").alias("model_name")))
    versions = model_versions.select("model_name", "version").join(first.select("model_name"), "model_name", "left_semi")
    found = first.join(latest_model_version(versions), "model_name", "left") \
        .withColumn("version", F.coalesce("version", F.lit("1")))
    return _with_dependencies(found, deps)


def effective_share(model_shares: DataFrame) -> DataFrame:
    """When a model reaches a recipient through several shares, only the newest
    counts (latest ``created_at``, then the greatest share name)."""
    order = F.struct("created_at", "share_name")
    return (model_shares.groupBy("model_name", "recipient_name")
            .agg(F.max_by(F.struct("share_name", "created_at"), order).alias("_e"))
            .select("model_name", "recipient_name", F.col("_e.share_name").alias("share_name"),
                    F.col("_e.created_at").alias("created_at")))
