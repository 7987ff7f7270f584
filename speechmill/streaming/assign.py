"""Streams of new utterances: windowed counts with late data, and nearest-centroid assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from speechmill.operators.vectors import nearest


def windowed_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums a window and kind; works on streams (with a watermark) and tables alike."""
    return (
        events.withColumn(time, F.col(time).cast("timestamp"))
        .withWatermark(time, late)
        .groupBy(F.window(time, size).alias("w"), kind)
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("window_start"), kind, "n", "total")
    )


def assign_clusters(stream: DataFrame, centres: DataFrame, path: str, checkpoint: str, vector: str = "embedding", group: str = "label") -> StreamingQuery:
    """Appends each batch of a stream with its nearest centroid to a Parquet table. A batch that is
    repeated after a failure overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        nearest(batch, vector, centres, group).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
