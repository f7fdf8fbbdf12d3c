"""Read-only, no-copy access to a share's tables under the target catalog's names: a view
each, or all tables of one schema as one frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featshare.functions.names import shared_name
from featshare.sources import fs


def view_name(full_name: str) -> str:
    """Temp views take one-part names: ``cat.sch.tbl`` becomes ``cat__sch__tbl``."""
    return full_name.replace(".", "__")


def mount_share(spark: SparkSession, share_objects: DataFrame, target_catalog: str,
                locations: dict) -> DataFrame:
    """One temp view per TABLE object over the source files (nothing is copied).

    ``share_objects`` has ``object_name`` and ``object_type``; ``locations`` maps a
    source table name to its folder. The table list is share metadata (one row per
    shared table), so it is small by nature. Returns one row per TABLE object:
    source name, name under the target catalog, view name, location (null when the
    source has no known location, in which case no view is made).
    """
    tables = (share_objects.where(F.col("object_type") == "TABLE")
              .select("object_name", shared_name("object_name", target_catalog).alias("mounted_name"))
              .distinct())
    rows = []
    for r in tables.toLocalIterator():
        loc = locations.get(r["object_name"])
        vname = view_name(r["mounted_name"])
        if loc is not None:
            spark.read.parquet(loc).createOrReplaceTempView(vname)
        rows.append((r["object_name"], r["mounted_name"], vname, loc))
    return spark.createDataFrame(
        rows, "object_name string, mounted_name string, view_name string, location string")


def read_share(share_objects: DataFrame, locations: DataFrame, target_catalog: str, schema=None) -> DataFrame:
    """S7 for tables of one schema: the rows of all shared tables in one scan, with their name
    under the target catalog as the first column, ``mounted_name``.

    ``share_objects`` has ``object_name`` and ``object_type``, ``locations`` has ``object_name``
    and ``location`` (a table's folder of Parquet files). Only the list of shared tables comes to
    the driver, in one job; however many tables a share has, the scan is one relation whose file
    list Spark makes, and a file finds its table by the folder it lies in. Objects without a location and
    objects that are no TABLE are left out, repeated ones count once; no table at all is an
    error unless ``schema`` is given. Without ``schema`` the one of the first file is taken.
    """
    spark = share_objects.sparkSession
    wanted = (share_objects.where("object_type = 'TABLE'").join(locations.where("location is not null"), "object_name")
              .select(shared_name("object_name", target_catalog).alias("mounted_name"), "location").distinct().collect())
    if not wanted and schema is None:
        raise ValueError("the share has no table with a known location, and no schema is given")
    if not wanted:
        empty = spark.createDataFrame([], schema)
        return empty.select(F.lit("").alias("mounted_name"), *empty.columns)
    folders = spark.createDataFrame([(r["mounted_name"], fs.qualified(spark, r["location"])) for r in wanted],
                                    "mounted_name string, _folder string")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    files = reader.parquet(*sorted({r["location"] for r in wanted}))
    # which file belongs to which table is found once a file (a scan without columns), not per row;
    # a file lies in its table's folder or in partition folders below. file_path is an encoded
    # URI, with an empty authority where the scheme has none
    paths = files.select(F.col("_metadata.file_path").alias("_file")).distinct()
    plain = F.regexp_replace(F.url_decode(F.replace("_file", F.lit("+"), F.lit("%2B"))), "^([A-Za-z0-9]+):///", "$1:/")
    parts = F.split(plain, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    owner = paths.select("_file", F.explode(above).alias("_folder")).join(folders, "_folder").drop("_folder")
    return files.withColumn("_file", F.col("_metadata.file_path")).join(owner, "_file").select("mounted_name", *files.columns)
