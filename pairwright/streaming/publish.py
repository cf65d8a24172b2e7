"""Append-only publication fed by a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from pairwright.session import cut_lineage
from pairwright.sources.publish import publish


def publish_stream(
    incoming: DataFrame, store: str, checkpoint: str, key: str, publication: str, ordinal: str, decisions: str | None = None
) -> StreamingQuery:
    """Run the batch decision on every micro-batch; stops when the available input is consumed.

    A batch replayed after a failure finds its rows already committed and decides no-op, so the store
    stays exactly-once. ``decisions`` optionally keeps every decided row, keyed by batch.
    """

    def merge(batch: DataFrame, number: int) -> None:
        # the batch is looked at more than once
        rows = cut_lineage(batch)
        decided = publish(batch.sparkSession, rows, store, key, publication, ordinal)
        if decisions is not None:
            decided.write.mode("overwrite").parquet(f"{decisions}/batch={number}")

    return (
        incoming.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
