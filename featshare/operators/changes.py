"""Change feeds and time travel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featshare.session import materialize
from featshare.sources.publish import last_change_per_key


def change_feed(before: DataFrame, after: DataFrame, keys) -> DataFrame:
    """Row changes between two versions of a keyed table: ``insert``, ``delete``,
    and ``update_preimage`` + ``update_postimage`` for rows whose non-key values differ
    (null-safe: null equals null).

    One full outer join on the keys (each side shuffled once), then a map-side explode
    of the images.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    cols = [c for c in before.columns if c not in keys]
    if sorted(cols) != sorted(c for c in after.columns if c not in keys):
        raise ValueError("before and after have different columns")
    b = before.select(*keys, F.struct(*cols).alias("_b"))
    a_struct = F.struct(*[F.col(c).cast(before.schema[c].dataType).alias(c) for c in cols])
    a = after.select(*keys, a_struct.alias("_a"))
    j = b.join(a, on=keys, how="full_outer")

    def img(kind, s):
        return F.struct(F.lit(kind).alias("change_type"), F.col(s).alias("img"))

    images = (F.when(F.col("_b").isNull(), F.array(img("insert", "_a")))
              .when(F.col("_a").isNull(), F.array(img("delete", "_b")))
              .when(~F.col("_b").eqNullSafe(F.col("_a")),
                    F.array(img("update_preimage", "_b"), img("update_postimage", "_a"))))
    ex = j.select(*keys, F.explode(images).alias("_c"))
    return ex.select(*keys, *[F.col("_c.img")[c].alias(c) for c in cols],
                     F.col("_c.change_type").alias("change_type"))


def _digests(df: DataFrame, columns, side: str) -> DataFrame:
    """Per block: rows and two sums of row hashes; the order of the rows has no part in them."""
    cells = []
    for c in columns:
        # hash functions skip nulls, so nulls are told apart by flags, nested ones by the JSON text
        nested = isinstance(df.schema[c].dataType, (T.ArrayType, T.StructType, T.MapType))
        cells += [F.to_json(F.struct(c), {"ignoreNullFields": "false"}) if nested else F.col(c), F.col(c).isNull()]
    sums = [F.sum(F.xxhash64(F.lit(seed), *cells).cast("decimal(38,0)")).alias(f"_{side}{seed}") for seed in (1, 2)]
    return df.groupBy("_block").agg(F.count(F.lit(1)).alias(f"_{side}0"), *sums)


def change_feed_by_blocks(before: DataFrame, after: DataFrame, keys, block: str | None = None,
                          n_blocks: int = 65536) -> DataFrame:
    """J7 where few keys change: the rows of :func:`change_feed`, but only blocks of keys that
    differ enter its join.

    ``block`` is a SQL expression over the key columns (for instance ``id div 100000``: changes of
    neighbouring keys fall into few blocks); without one keys are hashed to ``n_blocks``. A block
    is left out when both versions have as many rows of it and two equal 64-bit hash sums; one
    scan and one aggregation with partial sums per side find them. Rows with a null key, which
    equal no other key, always take part. Keys are unique in both versions (K2).
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    if sorted(before.columns) != sorted(after.columns):
        raise ValueError("before and after have different columns")
    columns = before.columns
    after = after.select(*[F.col(c).cast(before.schema[c].dataType).alias(c) for c in columns])
    at = F.expr(block) if block else F.pmod(F.xxhash64(*keys), F.lit(n_blocks))
    no_null = F.lit(True)
    for k in keys:
        no_null = no_null & F.col(k).isNotNull()
    sides = [df.withColumn("_block", F.when(no_null, at)) for df in (before, after)]
    b, a = (_digests(df, columns, side) for df, side in zip(sides, "ba"))
    same = F.lit(True)
    for i in range(3):
        same = same & F.col(f"_b{i}").eqNullSafe(F.col(f"_a{i}"))
    # written, so that the joins below see its real size and neither side is summed up twice
    differ = materialize(b.join(a, "_block", "full_outer").where(~same & F.col("_block").isNotNull()).select("_block"),
                         "changed-blocks")
    b, a = (df.join(differ, "_block", "left_semi").unionByName(df.where("_block is null")).drop("_block") for df in sides)
    return change_feed(b.select(*columns), a.select(*columns), keys)


def snapshot_as_of(changes: DataFrame, keys, version=None, timestamp=None,
                   version_col: str = "commit_version", ts_col: str = "commit_ts",
                   change_col: str = "change_type") -> DataFrame:
    """Table state at a version and/or time, from its change rows: the last change
    per key at or before the bound (``max_by`` on the version, combined map-side), with
    deleted keys dropped."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    c = changes
    if version is not None:
        c = c.where(F.col(version_col) <= F.lit(version))
    if timestamp is not None:
        c = c.where(F.col(ts_col) <= F.lit(timestamp).cast(changes.schema[ts_col].dataType))
    last = last_change_per_key(c, keys, version_col, change_col)
    return last.where(F.col(change_col) != F.lit("delete")).drop(change_col)
