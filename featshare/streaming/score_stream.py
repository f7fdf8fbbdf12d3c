"""T4 against a published feature table: requests scored as they come.

Per micro-batch only the buckets of the table that the batch's keys fall into are read, and
the version current at that time is used, so a table published anew is seen by the next
batch. A batch's rows are one folder, ``<out>/batch_id=<n>``, which a replayed batch
overwrites, so a restart neither loses nor repeats a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from featshare.functions.model import LinearModel, predict
from featshare.operators.lookup import feature_lookup
from featshare.sources.publish import read_published_for
from featshare.sources.requests import parse_score_requests


def score_records(records: DataFrame, model: LinearModel, target: str, lookup_key, table_key=None) -> DataFrame:
    """Records with the model's missing features looked up in the published table, and scored.
    Records whose key is null or not published have null features and a null prediction."""
    missing = [f for f in model.features if f not in records.columns]
    if missing:
        features = read_published_for(records, target, table_key or lookup_key, lookup_key)
        records = feature_lookup(records, features, lookup_key, missing, table_key)
    return predict(records, model)


def score_stream(requests: DataFrame, body_col: str, record_schema, model: LinearModel, target: str, lookup_key,
                 out: str, checkpoint: str, table_key=None, id_cols=(), available_now: bool = True):
    """Start the scoring query; returns the StreamingQuery. ``target`` is the published feature
    table (S8, S9), by ``table_key``; ``out`` the folder of the scored rows."""

    def score(batch: DataFrame, batch_id: int) -> None:
        # read for its keys and for the join; lost parts are read again from the batch
        records = parse_score_requests(batch, body_col, record_schema, id_cols).persist()
        try:
            scored = score_records(records, model, target, lookup_key, table_key)
            scored.write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch_id={batch_id}")
        finally:
            records.unpersist()

    writer = requests.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()
