"""Published copies for fast key lookup.

A published table is a folder of plain Parquet versions, ``<target>/v0000000001-b16``: rows
bucketed by a hash of the key into (here) 16 buckets, sorted by key inside. A version is
written whole into a fresh folder and exists when its ``_SUCCESS`` marker does, which is set
only after the keys were checked; a path that is being read is never overwritten. The bucketing
is Spark's own (``bucketBy``), so the join of S9 reads the stored side where it lies, without
an exchange. The number of buckets follows the rows: a version that outgrows its buckets is
dealt anew.

Besides the table's columns a row keeps ``_order``, the order value of the change that wrote
it (null: unknown, older than any), and ``_deleted``: a deleted key stays as a tombstone, so
that an older change arriving late cannot bring it back. Readers see neither.
"""

from __future__ import annotations

import logging
import re
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featshare.functions.states import error_class
from featshare.sources import fs
from featshare.sources.feature_tables import assert_keys

log = logging.getLogger(__name__)

_ORDER, _DELETED = "_order", "_deleted"
_FOLDER = re.compile(r"v(\d{10})-b(\d+)")
#: rows of one bucket, about
ROWS_PER_BUCKET = 1_000_000


def _order_value(df: DataFrame, order_col: str | None) -> Column:
    """An order column as the one type ``_order`` has in every version."""
    kind = T.DecimalType(38, 6)
    if order_col is None:
        return F.lit(None).cast(kind)
    own = df.schema[order_col].dataType
    if isinstance(own, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(F.col(order_col).cast("timestamp")).cast(kind)
    if isinstance(own, T.NumericType):
        return F.col(order_col).cast(kind)
    raise ValueError(f"{order_col} is {own.simpleString()}: an order column is a number, date or timestamp")


def _path(target: str, version: int, buckets: int) -> str:
    return f"{target.rstrip('/')}/v{version:010d}-b{buckets}"


def bucket_counts(spark: SparkSession, target: str) -> dict[int, int]:
    """Complete versions of a published table and their numbers of buckets."""
    found = {}
    for name in fs.list_dirs(spark, target):
        at = _FOLDER.fullmatch(name)
        if at and fs.is_complete(spark, f"{target.rstrip('/')}/{name}"):
            found[int(at[1])] = int(at[2])
    return found


def versions(spark: SparkSession, target: str) -> list[int]:
    """Complete versions of a published table, ascending."""
    return sorted(bucket_counts(spark, target))


def current_version(spark: SparkSession, target: str) -> int | None:
    return max(bucket_counts(spark, target), default=None)


def read_published(spark: SparkSession, target: str, version: int | None = None, keys=()) -> DataFrame:
    """The current (or a given) version of a published table. With ``keys``, the ones it was
    published by, the frame knows its bucketing, and a join on them moves only the other side."""
    found = bucket_counts(spark, target)
    v = max(found, default=None) if version is None else version
    if v not in found:
        raise FileNotFoundError(f"nothing published at {target}" if version is None else f"no version {version} at {target}")
    return _stored(spark, _path(target, v, found[v]), keys, found[v]).where(f"not {_DELETED}").drop(_ORDER, _DELETED)


def read_published_for(rows: DataFrame, target: str, keys, row_keys=None, version: int | None = None) -> DataFrame:
    """The part of a published table that can hold a key of ``rows``, bucketed as it lies, for a
    join with few rows (a micro-batch). One aggregation over ``rows`` finds the buckets its keys fall into,
    at most as many numbers as the table has buckets, and the range of the first key. Files of
    other buckets are not opened, and inside a file (sorted by key) row groups outside the range
    are not read. ``keys`` are the ones the table was published by, ``row_keys`` their names in
    ``rows``; both sides have the same type, or whole numbers of any width, because a bucket is a
    hash of the stored type. Rows with a null key find nothing and count for nothing."""
    spark, found = rows.sparkSession, bucket_counts(rows.sparkSession, target)
    keys = [keys] if isinstance(keys, str) else list(keys)
    row_keys = keys if row_keys is None else [row_keys] if isinstance(row_keys, str) else list(row_keys)
    if len(keys) != len(row_keys):
        raise ValueError("keys and row_keys differ in length")
    v = max(found, default=None) if version is None else version
    if v not in found:
        raise FileNotFoundError(f"no version {version or ''} published at {target}")
    state = _stored(spark, _path(target, v, found[v]), keys, found[v])
    wanted = []
    for key, own in zip(keys, row_keys):
        has, needs = rows.schema[own].dataType, state.schema[key].dataType
        if has != needs and not (isinstance(has, T.IntegralType) and isinstance(needs, T.IntegralType)):
            raise ValueError(f"{own} is {has.simpleString()}, the published {key} is {needs.simpleString()}")
        wanted.append(F.col(own).try_cast(needs).alias(f"_k{len(wanted)}"))  # out of range: equal to no stored key
    names = [f"_k{i}" for i in range(len(keys))]
    some = rows.select(*wanted).dropna(subset=names)
    spans = some.groupBy(F.pmod(F.hash(*names), F.lit(found[v])).alias("_bucket")).agg(
        F.min("_k0").alias("low"), F.max("_k0").alias("high"))
    spans = spans.collect()  # a row per bucket
    state = state.where(f"not {_DELETED}")
    if len(spans) < found[v]:
        # a condition on the file name prunes the file list; the bucket is its last number
        at = F.regexp_extract(F.col("_metadata.file_name"), r"_([0-9]+)\.c[0-9]+[^_]*$", 1).cast("int")
        state = state.where(at.isin([r["_bucket"] for r in spans]))
    if spans:
        low, high = min(r["low"] for r in spans), max(r["high"] for r in spans)
        state = state.where(F.col(keys[0]).between(F.lit(low), F.lit(high)))
    return state.drop(_ORDER, _DELETED)


def _stored(spark: SparkSession, path: str, keys, buckets: int) -> DataFrame:
    """Stored rows, tombstones and bookkeeping columns included."""
    schema = spark.read.parquet(f"{path}/_schema").schema
    plain = spark.read.schema(schema).parquet(path)
    keys = [keys] if isinstance(keys, str) else list(keys)
    if not keys:
        return plain
    table, by = f"published_{uuid.uuid4().hex[:16]}", ", ".join(f"`{k}`" for k in keys)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) "
              f"INTO {buckets} BUCKETS LOCATION '{path}'")
    out = spark.table(table)
    out.schema  # resolved: the frame keeps the files and the bucketing
    spark.sql(f"DROP TABLE {table}")  # the registration; the files are not its own
    return out


def _write_version(df: DataFrame, target: str, version: int, keys, buckets: int, check: bool,
                   rows_per_bucket: int | None = None) -> None:
    """Write rows (with their bookkeeping columns) as a version. Rows are counted while they are
    written, with ``check`` null and repeated keys too, and the version counts only if
    there are none. With ``rows_per_bucket``, a version whose buckets turn out over twice or
    under a quarter of that is dealt anew from its files before it counts."""
    spark, path = df.sparkSession, _path(target, version, buckets)
    if fs.exists(spark, path):
        fs.delete(spark, path)  # debris of a failed attempt at this version
    seen = Observation()
    metrics, out = [F.count(F.lit(1)).alias("rows")], df
    if check:
        again = F.row_number().over(Window.partitionBy(*keys).orderBy(*keys)) > 1  # the rows lie by key already
        null = F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))
        metrics += [F.count_if(null).alias("nulls"), F.count_if("_again").alias("repeats")]
        out = out.withColumn("_again", again)
    out = out.observe(seen, *metrics).drop("_again")
    table = f"published_{uuid.uuid4().hex[:16]}"
    (out.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).options(**fs.UNMARKED).option("path", path)
     .saveAsTable(table))
    spark.sql(f"DROP TABLE {table}")
    out.limit(0).coalesce(1).write.parquet(f"{path}/_schema")  # a bucketed write leaves no file where no row is
    if check and (seen.get["nulls"] or seen.get["repeats"]):
        fs.delete(spark, path)
        raise ValueError(f"key {keys}: {seen.get['nulls']} null and {seen.get['repeats']} repeated rows")
    if rows_per_bucket:
        right = _buckets(seen.get["rows"], rows_per_bucket)
        if right > 2 * buckets or buckets > 4 * right:
            written = spark.read.schema(df.schema).parquet(path)
            _write_version(written.repartition(right, *keys), target, version, keys, right, False)
            fs.delete(spark, path)
            return
    fs.mark_complete(spark, path)


def _buckets(rows: int, rows_per_bucket: int) -> int:
    return max(1, -(-rows // rows_per_bucket))


def publish_snapshot(source_df: DataFrame, target: str, primary_keys, check: bool = True,
                     order_col: str | None = None, rows_per_bucket: int = ROWS_PER_BUCKET,
                     buckets: int | None = None) -> int:
    """Full refresh of the online copy, one row per key; null or repeated keys are an error
    and publish nothing. Returns the version. With ``order_col`` the rows keep that order
    value, and later changes must exceed it. The keys are checked in the pass that writes.

    A refresh evaluates its source once: it starts from the buckets of the version before and
    is dealt anew from its own files if the rows no longer fit them. The first version of a
    target counts its rows before, unless ``buckets`` is given (and then kept)."""
    spark = source_df.sparkSession
    keys = [primary_keys] if isinstance(primary_keys, str) else list(primary_keys)
    found = bucket_counts(spark, target)
    last = max(found, default=0)
    fitting = None if buckets else rows_per_bucket
    buckets = buckets or found.get(last) or _buckets(source_df.count(), rows_per_bucket)
    rows = source_df.withColumn(_ORDER, _order_value(source_df, order_col)).withColumn(_DELETED, F.lit(False))
    _write_version(rows.repartition(buckets, *keys), target, last + 1, keys, buckets, check, fitting)
    return last + 1


def last_change_per_key(changes: DataFrame, keys, order_col: str | None = None,
                        change_col: str = "change_type") -> DataFrame:
    """The effective change per key: pre-images dropped, then the highest ``order_col`` (a
    null order is lower than any; rows with equal order are told apart by their values).

    ``max_by`` is an aggregate with a map-side partial step, so a key with millions of
    changes ships one partial row per map task, not its whole history. Without
    ``order_col`` a key with several changes has no last one: that is an error.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    ch = changes.where(F.col(change_col) != F.lit("update_preimage"))
    if order_col is None:
        assert_keys(ch, keys)
        return ch
    rest = [c for c in ch.columns if c not in keys]
    # order first: the largest struct is the last change, whatever order the rows arrive in
    ranked = F.struct(F.col(order_col).alias("_o"), *rest)
    last = ch.groupBy(*keys).agg(F.max(ranked).alias("_last"))
    return last.select(*keys, *[F.col("_last")[c].alias(c) for c in rest])


def apply_changes(state: DataFrame, changes: DataFrame, primary_keys, order_col: str | None = None,
                  change_col: str = "change_type", buckets: int | None = None) -> DataFrame:
    """S9 core: the stored rows after the changes. ``state`` holds the table's columns plus
    ``_order`` and ``_deleted`` (a plain table, without them, gives the plain new table);
    ``changes`` holds the table's columns plus ``change_col``
    (insert, delete, update_preimage, update_postimage) and optionally ``order_col``.

    With ``order_col``, a change applies only if its order exceeds that of the stored row or
    tombstone, so changes may arrive in any order and any number of times. Without, the
    changes apply as they come, one per key. ``buckets`` is the number of buckets by key of
    a bucketed ``state``: the changes are dealt likewise.
    """
    keys = [primary_keys] if isinstance(primary_keys, str) else list(primary_keys)
    if _DELETED not in state.columns:
        stored = state.withColumn(_ORDER, _order_value(state, None)).withColumn(_DELETED, F.lit(False))
        after = apply_changes(stored, changes, keys, order_col, change_col)
        return after.where(f"not {_DELETED}").drop(_ORDER, _DELETED)
    eff = last_change_per_key(changes, keys, order_col, change_col)
    values = [c for c in state.columns if c not in (*keys, _ORDER, _DELETED)]
    new = eff.select(*keys, F.struct(
        *values, _order_value(eff, order_col).alias(_ORDER),
        (F.col(change_col) == "delete").alias(_DELETED)).alias("_new"))
    if buckets:
        new = new.repartition(buckets, *keys)
    old = state.select(*keys, F.struct(*values, _ORDER, _DELETED).alias("_old"))
    j = old.join(new, keys, "full_outer")
    wins = F.col("_new").isNotNull()
    if order_col:
        wins = wins & (F.col("_old").isNull() | F.col("_old")[_ORDER].isNull()
                       | (F.col("_new")[_ORDER] > F.col("_old")[_ORDER]))
    row = F.when(wins, F.col("_new")).otherwise(F.col("_old"))
    return j.select(*keys, row.alias("_r")).select(
        *[F.col(c) if c in keys else F.col("_r")[c].alias(c) for c in state.columns])


def publish_changes(spark: SparkSession, target: str, changes: DataFrame, primary_keys,
                    order_col: str | None = None, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    """Incremental publish: the next version is the current one with the changes applied.
    Returns the current version afterwards. An empty change set writes nothing.

    The last changes per key are dealt to the stored version's buckets, and the join reads its
    stored side in place; the result lies in the same buckets and is written without another
    exchange, unless rows outgrow them twofold. With ``order_col`` a replayed change set gives
    a version with the same rows.
    """
    keys = [primary_keys] if isinstance(primary_keys, str) else list(primary_keys)
    found = bucket_counts(spark, target)
    cur = max(found, default=None)
    if cur is None:
        raise FileNotFoundError(f"publish a snapshot to {target} before publishing changes")
    any_null = F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))
    n_changes, n_null = changes.agg(F.count(F.lit(1)), F.count_if(any_null)).first()
    if n_null:
        raise ValueError(f"changes with a null key {keys}")
    if not n_changes:
        return cur
    state = _stored(spark, _path(target, cur, found[cur]), keys, found[cur])
    new = apply_changes(state, changes, keys, order_col, buckets=found[cur])
    rows, buckets = state.count() + n_changes, found[cur]
    if rows > 2 * rows_per_bucket * buckets:
        buckets = _buckets(rows, rows_per_bucket)
        new = new.repartition(buckets, *keys)
    _write_version(new, target, cur + 1, keys, buckets, False)
    return cur + 1


def _publish_one(spark: SparkSession, target_root: str, entry) -> tuple:
    source_name, online_name, df, keys = entry
    target = f"{target_root.rstrip('/')}/{online_name}"
    try:
        if current_version(spark, target) is not None:
            return (source_name, online_name, "exists", None, None)
        v = publish_snapshot(df, target, keys)
        return (source_name, online_name, "published", v, None)
    except Exception as exc:  # noqa: BLE001 - every failure becomes an outcome row
        log.error("publish of %s failed: %s", source_name, exc)
        return (source_name, online_name, "failed", None, str(exc).split("\n")[0])


def publish_many(spark: SparkSession, tables, target_root: str, max_parallel: int = 4) -> DataFrame:
    """Publish each table; per table outcome ``published``, ``exists`` or ``failed``,
    going on after a failure. ``tables`` is a list of
    ``(source_table_name, online_table_name, DataFrame, primary_keys)``.

    The list is one model's dependencies (metadata-sized); each table is its own
    distributed job, and up to ``max_parallel`` of them are submitted at once (Spark
    schedules concurrent jobs from several driver threads). Tables that share an online
    name are published in list order, so the first one wins and the others report
    ``exists``. Returns the outcomes as a DataFrame (feeds A3).
    """
    from concurrent.futures import ThreadPoolExecutor

    tables = list(tables)
    # one chain per online name, in list order; the chains run concurrently
    chains: dict = {}
    for i, t in enumerate(tables):
        chains.setdefault(t[1], []).append((i, t))
    results: dict = {}

    def run_chain(chain):
        for i, t in chain:
            results[i] = _publish_one(spark, target_root, t)

    with ThreadPoolExecutor(max_workers=max(1, max_parallel)) as pool:
        list(pool.map(run_chain, chains.values()))
    rows = [results[i] for i in range(len(tables))]
    out = spark.createDataFrame(
        rows, "source_table_name string, online_table_name string, outcome string, "
              "version int, message string")
    return out.withColumn("error_class", F.when(F.col("message").isNotNull(), error_class("message")))
