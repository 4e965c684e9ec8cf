"""Compare each arriving snapshot of links with a baseline, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridweft.operators.connect import diff_connections


def stream_diff(snapshots: DataFrame, baseline: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write added, removed and changed links of every micro-batch as Parquet, partitioned by batch_id.

    A batch is written to a folder of its own, so that a repeated one overwrites itself.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        found = diff_connections(baseline, batch.select("source", "dest", "status", "seq"))
        found.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return snapshots.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, length: str = "10 minutes", delay: str = "5 minutes") -> DataFrame:
    """Issues per window and severity of a stream (ts, severity), late ones dropped after ``delay``."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", length), "severity").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "severity", "n")
