"""Per-session counters and late activity over event streams.

Every micro-batch writes what it adds to a folder of its own, which a replay overwrites. Sums over the folders are the current
values, so no state is kept, nothing is behind a watermark, and rows that arrive late count like any other. Inside a
micro-batch the joins and counts are ordinary batch jobs with split hot sessions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pairwright.operators.keyed import attach


def session_counts(events: DataFrame, session: str, category: str, at: str, span: str = "1 day") -> DataFrame:
    """Event counts per session, category and ``span`` of event time."""
    counted = events.groupBy(F.window(at, span).alias("span"), session, category).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(session, category, F.col("span.start").alias("span_start"), "n")


def log_batches(events: DataFrame, added: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str) -> StreamingQuery:
    """Write ``added(batch)`` of every micro-batch to its own folder under ``folder``."""

    def write(batch: DataFrame, number: int) -> None:
        added(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return (
        events.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def total_counts(logged: DataFrame, keys: Sequence[str]) -> DataFrame:
    return logged.groupBy(*keys).agg(F.sum("n").alias("n"))


def late_activity(events: DataFrame, completions: DataFrame, session: str, at: str, done: str, spread: Sequence[str]) -> DataFrame:
    """Events after the completion time of their session."""
    return attach(events, completions, [session], spread=spread).where(F.col(at) > F.col(done))
