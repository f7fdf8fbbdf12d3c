"""Config validation, message triage and name audits (P3, P4, A5, A6). All map-only
except the final counts, which combine map-side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featshare.functions.config import normalize_configs
from featshare.functions.names import dns_name
from featshare.functions.states import error_class

# The five target-config rules, in order, with the reference's message
# and remediation text. Rules 4 and 5 apply only when online tables are on.
TARGET_RULES = [
    (1, "share_name", False,
     "share_name is required",
     "Provide the name of the Delta Share to consume"),
    (2, "provider_name", False,
     "provider_name is required",
     "Use 'self' for same-metastore sharing or the provider name for cross-metastore"),
    (3, "target_catalog", False,
     "target_catalog is required",
     "Provide the catalog name to create from the share"),
    (4, "online_table_target_catalog", True,
     "online_table_target_catalog is required when create_online_table=true",
     "Shared catalogs are read-only. Specify a writable catalog for online tables (e.g., 'main')"),
    (5, "online_table_target_schema", True,
     "online_table_target_schema is required when create_online_table=true",
     "Specify the schema within online_table_target_catalog (e.g., 'default')"),
]

TARGET_STRING_COLS = ["share_name", "provider_name", "target_catalog",
                      "online_table_target_catalog", "online_table_target_schema"]

# Fields each run mode requires.
MODE_REQUIRED = {
    "source": ["model_name", "share_name", "recipient_name"],
    "target": ["share_name", "provider_name", "target_catalog", "target_host", "target_token"],
}


def validate_target_configs(df: DataFrame, key_cols=("config_id",), normalize: bool = True) -> DataFrame:
    """One row per failed rule, all failures kept, in rule order. C4 runs first, so
    empty strings and ``NONE`` fail a required field."""
    if normalize:
        df = normalize_configs(df, [c for c in TARGET_STRING_COLS if c in df.columns],
                               ["create_online_table"] if dict(df.dtypes).get("create_online_table") == "string" else [])
    on = F.coalesce(F.col("create_online_table"), F.lit(False))
    checks = []
    for rule, fieldname, needs_online, msg, fix in TARGET_RULES:
        bad = F.col(fieldname).isNull()
        if needs_online:
            bad = on & bad
        checks.append(F.when(bad, F.struct(F.lit(rule).alias("rule"), F.lit(fieldname).alias("field"),
                                           F.lit(msg).alias("message"), F.lit(fix).alias("remediation"))))
    # explode all five slots, keep the failed ones (a plain filter stays in codegen)
    return (df.select(*key_cols, F.explode(F.array(*checks)).alias("_f")).where(F.col("_f").isNotNull())
            .select(*key_cols, "_f.rule", "_f.field", "_f.message", "_f.remediation"))


def validate_run_configs(df: DataFrame, key_cols=("config_id",), normalize: bool = True) -> DataFrame:
    """The mode rule: source needs 3 fields, target needs 5. One row per config with
    ``valid`` and the missing fields (comma-separated, in rule order)."""
    fields = sorted({f for fs in MODE_REQUIRED.values() for f in fs})
    if normalize:
        df = normalize_configs(df, fields)
    mode = F.col("mode")
    missing = None
    for m, req in MODE_REQUIRED.items():
        # concat_ws skips nulls: the names of the missing fields, in rule order
        listed = F.concat_ws(",", *[F.when(F.col(f).isNull(), F.lit(f)) for f in req])
        missing = F.when(mode == m, listed) if missing is None else missing.when(mode == m, listed)
    missing = missing.otherwise(F.lit("mode"))
    return df.select(*key_cols, "mode", missing.alias("missing_fields")).select(
        *key_cols, "mode", (F.col("missing_fields") == "").alias("valid"), "missing_fields")


def error_triage(messages: DataFrame, message_col: str = "message") -> DataFrame:
    """A5: count messages by class."""
    return (messages.select(error_class(message_col).alias("error_class"))
            .groupBy("error_class").agg(F.count(F.lit(1)).alias("n_messages")))


def store_name_audit(names: DataFrame, name_col: str) -> DataFrame:
    """DNS names that several distinct names collapse to (``collision``) and names
    that collapse to nothing (``empty``), with the number of distinct source names."""
    pairs = (names.select(F.col(name_col).alias("name")).where("name is not null")
             .select(dns_name("name").alias("dns_name"), "name").distinct())
    g = pairs.groupBy("dns_name").agg(F.count(F.lit(1)).alias("n_names"))
    problem = F.when(F.col("dns_name") == "", F.lit("empty")).when(F.col("n_names") > 1, F.lit("collision"))
    return g.select("dns_name", "n_names", problem.alias("problem")).where(F.col("problem").isNotNull())
