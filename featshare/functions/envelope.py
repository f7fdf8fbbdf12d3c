"""Result rows as a JSON envelope, built by ``to_json`` on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def result_json(df: DataFrame, status: str = "success", data_cols=None,
                out_col: str = "result") -> DataFrame:
    """One JSON document per row: ``{"status": ..., "data": {...}}``.

    Columns not in ``data_cols`` are kept beside the document (keys for joins).
    """
    data_cols = list(data_cols or df.columns)
    keep = [c for c in df.columns if c not in data_cols]
    doc = F.to_json(F.struct(F.lit(status).alias("status"),
                             F.struct(*[F.col(c) for c in data_cols]).alias("data")))
    return df.select(*keep, doc.alias(out_col))


def error_json(error_type_col, message_col, status: str = "error"):
    """The error form of the envelope as a column."""
    return F.to_json(F.struct(F.lit(status).alias("status"),
                              error_type_col.alias("error_type"),
                              message_col.alias("message")))
