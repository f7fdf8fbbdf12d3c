"""Config values as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featshare.functions.names import as_col

# Fixed value: a secret reference is matched at the start of the value only
# (anything may follow the closing braces). Group 1 is the scope, group 2 the key.
SECRET_PATTERN = r"^\{\{secrets/([^/]+)/([^}]+)\}\}"

# Fixed value: the literal that the job definition uses for "not given".
NONE_LITERAL = "NONE"


def missing_to_null(c) -> Column:
    """Empty string and the literal ``NONE`` become null."""
    col = as_col(c)
    return F.when((col == F.lit("")) | (col == F.lit(NONE_LITERAL)), F.lit(None).cast("string")) \
        .otherwise(col)


def truthy(c) -> Column:
    """``lower(x) = 'true'``; everything else, null included, is false."""
    return F.coalesce(F.lower(as_col(c).cast("string")) == F.lit("true"), F.lit(False))


def normalize_configs(df: DataFrame, string_cols, bool_cols=()) -> DataFrame:
    """C4: missing strings to null, flag strings to booleans; other columns untouched."""
    string_cols, bool_cols = set(string_cols), set(bool_cols)
    out = []
    for name in df.columns:
        if name in string_cols:
            out.append(missing_to_null(name).alias(name))
        elif name in bool_cols:
            out.append(truthy(name).alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


def secret_scope(c) -> Column:
    """Scope of a secret reference, or null."""
    v = F.regexp_extract(as_col(c), SECRET_PATTERN, 1)
    return F.when(v != F.lit(""), v)


def secret_key(c) -> Column:
    """Key of a secret reference, or null."""
    v = F.regexp_extract(as_col(c), SECRET_PATTERN, 2)
    return F.when(v != F.lit(""), v)


def secret_scan(df: DataFrame, cols) -> DataFrame:
    """Count config values that are secret references, by column, scope and key.

    Values are never resolved. One map-side stack of the scanned columns, then one
    aggregation with partial (map-side) combine.
    """
    cols = list(cols)
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
        for c in cols])).alias("kv")).select("kv.column_name", "kv.value")
    refs = stacked.select(
        "column_name",
        secret_scope("value").alias("scope"),
        secret_key("value").alias("secret_key"),
    ).where(F.col("scope").isNotNull())
    return refs.groupBy("column_name", "scope", "secret_key").agg(F.count(F.lit(1)).alias("n_refs"))
