"""Continuous runs: windowed status counts under a watermark, and an append sink that may be restarted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def status_counts(rows: DataFrame, time: str, status: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows per window and status; what comes later than `late` is not counted."""
    out = rows.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), status).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), status, "n")


def once_each(rows: DataFrame, key: str, time: str, late: str = "2 hours") -> DataFrame:
    """The first row of each key within the watermark."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def run_batches(queries: DataFrame, answer: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Answers each micro-batch of queries; a batch that is tried again replaces what it wrote."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        answer(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return queries.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
