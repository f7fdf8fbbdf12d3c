"""T5: incremental publish of a change stream, one new version per micro-batch.

``foreachBatch`` applies S9 to the current version, whoever wrote it. Changes are judged by
their order alone, so a batch replayed after a failure, or read again by a new checkpoint,
leaves the rows as they are. ``trigger(availableNow=True)`` gives the triggered mode,
the default trigger the continuous one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from featshare.sources.publish import current_version, publish_changes, publish_snapshot


def publish_batch(batch: DataFrame, target: str, keys, columns, order_col: str) -> int:
    """Apply one micro-batch of changes to ``target``; a target without a version starts
    empty, and its buckets follow the rows. Returns the current version afterwards."""
    spark = batch.sparkSession
    if current_version(spark, target) is None:
        publish_snapshot(batch.select(*columns).limit(0), target, keys)
    return publish_changes(spark, target, batch, keys, order_col)


def publish_stream(changes: DataFrame, target: str, keys, columns, checkpoint: str,
                   order_col: str, available_now: bool = True):
    """Start the publishing query; returns the StreamingQuery. ``order_col`` is required:
    micro-batches may hold a key several times and out of order. The size of a micro-batch
    is the source's business (for a file source, ``maxFilesPerTrigger``)."""
    keys = [keys] if isinstance(keys, str) else list(keys)

    def apply(df: DataFrame, batch_id: int) -> None:
        publish_batch(df, target, keys, list(columns), order_col)

    writer = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()
