"""Online table links to their sources.

Lookups at serving time resolve a table by its id, not its name, so a source dropped
and recreated under the same name breaks the link.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featshare.functions.names import as_col, online_name


def broken_links(online_tables: DataFrame, table_registry: DataFrame) -> DataFrame:
    """Online tables whose recorded source id is not the current id of that name
    (``recreated``), or whose source name is gone (``gone``)."""
    reg = table_registry.select(F.col("table_name").alias("source_table_name"),
                                F.col("table_id").alias("current_table_id"))
    j = online_tables.join(reg, "source_table_name", "left")
    status = (F.when(F.col("current_table_id").isNull(), F.lit("gone"))
              .when(F.col("current_table_id") != F.col("source_table_id"), F.lit("recreated")))
    return (j.select("online_table_name", "source_table_name", "source_table_id",
                     "current_table_id", status.alias("status"))
            .where(F.col("status").isNotNull()))


def resolve_links(online_tables: DataFrame, table_registry: DataFrame) -> DataFrame:
    """Map each online table to its source by id, whatever the name now is."""
    reg = table_registry.select(F.col("table_id").alias("source_table_id"),
                                F.col("table_name").alias("current_table_name"))
    return online_tables.join(reg, "source_table_id", "inner").select(
        "online_table_name", "source_table_name", "source_table_id", "current_table_name")


def online_name_collisions(tables: DataFrame, name_col, catalog, schema) -> DataFrame:
    """Distinct source tables that map to the same online table name (the name keeps
    only the last part). One row per colliding source, with the group size; the
    reference publishes the first and reports the others as ``exists``."""
    t = (tables.select(as_col(name_col).alias("source_table_name")).where("source_table_name is not null")
         .distinct()
         .withColumn("online_table_name", online_name("source_table_name", catalog, schema)))
    g = (t.groupBy("online_table_name")
         .agg(F.count(F.lit(1)).alias("n_sources"), F.min("source_table_name").alias("_first"))
         .where(F.col("n_sources") > 1))
    return t.join(g, "online_table_name", "inner").select(
        "online_table_name", "source_table_name", "n_sources",
        F.when(F.col("source_table_name") == F.col("_first"), F.lit("published"))
        .otherwise(F.lit("exists")).alias("reference_outcome"))
