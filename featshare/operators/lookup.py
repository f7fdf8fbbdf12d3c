"""Feature lookups and training sets."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featshare.functions.model import FeatureFunction, feature_function


def _as_list(v):
    return [v] if isinstance(v, str) else list(v)


#: least share of the rows a hot key may be asked to hold, which bounds their number
LEAST_HOT_FRACTION = 1e-4


def hot_keys(df: DataFrame, keys, fraction: float) -> DataFrame:
    """Keys holding more than ``fraction`` of the rows of ``df``: one aggregation with
    map-side combine, then a filter against the total. At most ``1 / fraction`` keys can
    qualify, and ``fraction`` is checked, so the result has 10,000 keys at most."""
    if not LEAST_HOT_FRACTION <= fraction < 1:
        raise ValueError(f"hot key fraction {fraction} is not in [{LEAST_HOT_FRACTION}, 1)")
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    return counts.where(F.col("_n") > F.lit(fraction * total)).select(*keys)


def _salted_join(left: DataFrame, right: DataFrame, keys, hot: DataFrame, buckets: int) -> DataFrame:
    """Left join that spreads each hot key over ``buckets`` tasks. Hot rows that are equal
    become one with a count, so that many repeats cannot share a salt; the others get a salt
    from a hash of the whole row (deterministic, so a retried task salts the same way), the
    right rows of hot keys are copied once per salt, and the counts are unfolded after the
    join. All other rows are joined as they are. ``hot`` has a proven size bound (see
    :func:`hot_keys`), so it is broadcast."""
    flag = F.broadcast(hot)
    calm = left.join(flag, keys, "left_anti").join(right, list(keys), "left")
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), F.lit(buckets))
    counted = (left.join(flag, keys, "left_semi").groupBy(*left.columns).agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_salt", salt))
    copies = right.join(flag, keys, "left_semi").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))))
    joined = counted.join(copies, list(keys) + ["_salt"], "left")
    spread = joined.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    return calm.unionByName(spread.select(*calm.columns))


def feature_lookup(df: DataFrame, features: DataFrame, lookup_key, feature_names,
                   table_key=None, rename: dict | None = None, hot_key_fraction: float | None = None,
                   salt_buckets: int = 32) -> DataFrame:
    """Add named features by key. Every left row is kept and unmatched features are
    null; the row count does not change because the feature table's key is unique (K2,
    checked when the table was written).

    Only the key and the named features are read from the feature table (pruned at the
    scan). The join strategy is left to AQE: a small feature table is broadcast by its
    measured size, a large one is sort-merge joined, and a hot lookup key on the left is
    split by the skew-join rule instead of landing in one task. ``hot_key_fraction``
    salts keys above that share of the rows explicitly (for when AQE cannot split).
    """
    lk, tk = _as_list(lookup_key), _as_list(table_key or lookup_key)
    if len(lk) != len(tk):
        raise ValueError("lookup_key and table_key differ in length")
    rename = rename or {}
    out_names = [rename.get(n, n) for n in feature_names]
    clash = [n for n in out_names if n in df.columns]
    if clash:
        raise ValueError(f"feature name(s) {clash} already in the frame")
    right = features.select(*[F.col(t).alias(l) for t, l in zip(tk, lk)],
                            *[F.col(n).alias(o) for n, o in zip(feature_names, out_names)])
    if hot_key_fraction is not None:
        return _salted_join(df, right, lk, hot_keys(df, lk, hot_key_fraction), salt_buckets)
    return df.join(right, on=lk, how="left")


@dataclass
class FeatureLookup:
    """One lookup of a training set or feature spec."""

    table: DataFrame
    feature_names: tuple
    lookup_key: object
    table_key: object = None
    rename: dict = field(default_factory=dict)


def _apply(df: DataFrame, step) -> DataFrame:
    if isinstance(step, FeatureLookup):
        return feature_lookup(df, step.table, step.lookup_key, step.feature_names,
                              step.table_key, step.rename)
    if isinstance(step, FeatureFunction):
        if step.output in df.columns:
            raise ValueError(f"feature name {step.output!r} already in the frame")
        return feature_function(df, step)
    raise TypeError(f"not a lookup or a function: {step!r}")


def feature_spec(df: DataFrame, steps) -> DataFrame:
    """An ordered list of lookups and on-demand functions applied as one plan."""
    for step in steps:
        df = _apply(df, step)
    return df


def create_training_set(df: DataFrame, lookups, label: str, exclude_columns=(),
                        functions=()) -> DataFrame:
    """Every lookup in order (then on-demand functions), excluded columns dropped,
    the label kept. Name clashes are an error. Consecutive lookups on the same key reuse
    the first join's hash partitioning, so the label side is shuffled once."""
    if label not in df.columns:
        raise ValueError(f"label {label!r} not in frame")
    if label in set(exclude_columns):
        raise ValueError("the label cannot be excluded")
    out = feature_spec(df, list(lookups) + list(functions))
    return out.drop(*exclude_columns)
