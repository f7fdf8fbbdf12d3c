"""Keyed feature tables on parquet (S1-S4) and their key checks (K1, K2).

A feature table is a parquet folder plus a one-row JSON record of its primary keys and
description under ``<path>/_featshare_meta`` (the leading underscore keeps it out of
parquet scans). Both are written by Spark, so the same code works on any file system.
"""

from __future__ import annotations

import json
import logging
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featshare.sources import fs

log = logging.getLogger(__name__)

META_DIR = "_featshare_meta"


# ---------------------------------------------------------------- K1, K2

def check_not_null(df: DataFrame, keys) -> DataFrame:
    """K1: rows with a null in any key column (map-only filter)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    cond = None
    for k in keys:
        cond = F.col(k).isNull() if cond is None else (cond | F.col(k).isNull())
    return df.where(cond)


def check_primary_key(df: DataFrame, keys) -> DataFrame:
    """K2: keys that occur more than once, with their count. One aggregation with
    map-side partial counts, so a hot key costs one row per map task in the shuffle."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
            .where(F.col("n_rows") > 1))


def key_violations(df: DataFrame, keys) -> tuple[int, int]:
    """(rows with a null key, keys that repeat) in a single job over the key columns."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    any_null = None
    for k in keys:
        any_null = F.col(k).isNull() if any_null is None else (any_null | F.col(k).isNull())
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    row = per_key.agg(
        F.coalesce(F.sum(F.when(any_null, F.col("n"))), F.lit(0)).alias("null_rows"),
        F.count(F.when(~any_null & (F.col("n") > 1), F.lit(1))).alias("dup_keys"),
    ).first()
    return int(row["null_rows"]), int(row["dup_keys"])


def assert_keys(df: DataFrame, keys) -> None:
    null_rows, dup_keys = key_violations(df, keys)
    if null_rows or dup_keys:
        raise ValueError(f"primary key {list(keys)} violated: {null_rows} row(s) with a null key, "
                         f"{dup_keys} key(s) repeated")


# ---------------------------------------------------------------- S1

def read_feature_table(spark: SparkSession, path: str, columns=None, where=None) -> DataFrame:
    """Scan a feature table. Column lists and predicates reach the parquet scan
    (``ReadSchema`` / ``PushedFilters``)."""
    df = spark.read.parquet(path)
    if where is not None:
        df = df.where(where)
    if columns:
        df = df.select(*columns)
    return df


def read_metadata(spark: SparkSession, path: str) -> dict | None:
    """The recorded keys and description, or None when the folder is not a feature table."""
    meta = f"{path.rstrip('/')}/{META_DIR}"
    if not fs.is_complete(spark, meta):
        return None
    row = spark.read.json(meta).first()
    if row is None or row["primary_keys"] is None:
        return None
    return {"primary_keys": json.loads(row["primary_keys"]), "description": row["description"],
            "created_at": row["created_at"]}


def _write_metadata(spark: SparkSession, path: str, keys, description: str) -> None:
    rec = [(json.dumps(list(keys)), description or "",
            datetime.now(timezone.utc).isoformat(timespec="seconds"))]
    (spark.createDataFrame(rec, "primary_keys string, description string, created_at string")
     .coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}/{META_DIR}"))


# ---------------------------------------------------------------- S2, S3

def create_feature_table(df: DataFrame, path: str, primary_keys, description: str = "",
                         check: bool = True) -> str:
    """Write the parquet folder, check K1 and K2, record keys and description.
    Fails if the folder exists.

    ``df`` is evaluated once: the keys are checked on the key columns of the written copy. It
    has no ``_SUCCESS`` marker and no record until they hold, and is deleted if they don't."""
    spark = df.sparkSession
    keys = [primary_keys] if isinstance(primary_keys, str) else list(primary_keys)
    missing = [k for k in keys if k not in df.columns]
    if missing:
        raise ValueError(f"primary key column(s) {missing} not in frame")
    if fs.exists(spark, path):
        raise FileExistsError(f"feature table {path} already exists")
    df.write.mode("errorifexists").options(**fs.UNMARKED).parquet(path)
    if check:
        try:
            assert_keys(spark.read.schema(df.schema).parquet(path), keys)
        except Exception:
            fs.delete(spark, path)
            raise
    fs.mark_complete(spark, path)
    _write_metadata(spark, path, keys, description)
    return path


def ensure_feature_table(df: DataFrame, path: str, primary_keys, description: str = "") -> str:
    """S3: ``created`` when absent; ``reused`` when present with recorded keys equal to
    ``primary_keys``; otherwise ``recreated``: written to a new folder first, then swapped
    in by renames (old aside, new in, old deleted). A failure at any step leaves a complete
    copy under one of the names; between the two renames ``path`` itself has no table."""
    spark = df.sparkSession
    keys = [primary_keys] if isinstance(primary_keys, str) else list(primary_keys)
    if not fs.exists(spark, path):
        create_feature_table(df, path, keys, description)
        return "created"
    meta = read_metadata(spark, path)
    if meta is not None and meta["primary_keys"] == keys:
        return "reused"
    tag = uuid.uuid4().hex[:8]
    staging = f"{path.rstrip('/')}.__rebuild-{tag}"
    retired = f"{path.rstrip('/')}.__retired-{tag}"
    create_feature_table(df, staging, keys, description)
    # swap by renames: at every moment one complete copy exists under one of three names
    if not fs.rename(spark, path, retired):
        raise OSError(f"could not move {path} aside")
    if not fs.rename(spark, staging, path):
        fs.rename(spark, retired, path)
        raise OSError(f"could not move {staging} to {path}")
    fs.delete(spark, retired)
    return "recreated"


# ---------------------------------------------------------------- registration, S4

def register_feature_table(spark: SparkSession, name: str, path: str) -> None:
    """Register the folder under a catalog name (an external table: files stay put)."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} USING parquet LOCATION '{path}'")


def table_location(spark: SparkSession, name: str) -> str | None:
    """The folder a catalog name points at, or None for an unknown name."""
    if not spark.catalog.tableExists(name):
        return None
    return spark.sql(f"DESCRIBE FORMATTED {name}").where("col_name = 'Location'").first()["data_type"]


def ensure_registered_table(df: DataFrame, name: str, root: str, primary_keys, description: str = "",
                            delete_replaced: bool = False) -> str:
    """S3 behind a catalog name: ``created``, ``reused`` (recorded keys equal ``primary_keys``) or
    ``recreated``. Every version is a fresh folder under ``root``; it is checked and complete
    before the name points at it, and no folder is renamed, so nothing is copied on an object store.

    A reader by name finds a complete table at any moment. Columns that the new version adds are
    added to the registration first (null in the old version). Only where a column is dropped or
    changes its type is the registration itself dropped and made anew, with a moment without the
    name; the files of both versions stay. The replaced folder is kept for readers that have
    begun, unless ``delete_replaced``.
    """
    spark = df.sparkSession
    keys = [primary_keys] if isinstance(primary_keys, str) else list(primary_keys)
    old = table_location(spark, name)
    if old is not None:
        meta = read_metadata(spark, old)
        if meta is not None and meta["primary_keys"] == keys:
            return "reused"
    path = create_feature_table(df, f"{root.rstrip('/')}/v-{uuid.uuid4().hex[:12]}", keys, description)
    if old is None:
        register_feature_table(spark, name, path)
        return "created"
    had = {f.name: f.dataType for f in spark.table(name).schema}
    has = {f.name: f.dataType for f in df.schema}
    if all(has.get(c) == t for c, t in had.items()):
        new = ", ".join(f"`{c}` {t.simpleString()}" for c, t in has.items() if c not in had)
        if new:
            spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({new})")
        spark.sql(f"ALTER TABLE {name} SET LOCATION '{path}'")
    else:
        spark.sql(f"DROP TABLE {name}")
        register_feature_table(spark, name, path)
    if delete_replaced:
        fs.delete(spark, old)
    return "recreated"


def drop_feature_table(spark: SparkSession, name: str) -> bool:
    """Remove the registration; a missing table is a warning, not an error."""
    if not spark.catalog.tableExists(name):
        log.warning("feature table %s does not exist; nothing to drop", name)
        return False
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    return True
