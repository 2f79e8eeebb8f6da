"""Live stack traces: linking and windowed counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from symlake.operators.logs import link_frames, stack_frames
from symlake.streaming.index import stream_id


def stream_frames(lines: DataFrame, decls: DataFrame, text: str = "text") -> DataFrame:
    """Frames of a line stream linked to code by a stream-static join. ``decls`` keeps the files it was made with; use
    ``run_linked`` where the index grows."""
    return link_frames(stack_frames(lines, text), decls)


def run_linked(lines: DataFrame, open_decls: Callable[[SparkSession], DataFrame], path: str, checkpoint: str,
               text: str = "text") -> StreamingQuery:
    """Link a line stream batch by batch. ``open_decls`` opens the index anew for every batch, so what was added to it
    since shows up. Each batch owns a folder, named by stream and batch, that a replay overwrites."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        linked = link_frames(stack_frames(batch, text), open_decls(spark))
        linked.write.mode("overwrite").parquet(f"{path}/source={stream_id(spark, checkpoint)}/batch={batch_id}")

    return (
        lines.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
    )


def stream_counts(frames: DataFrame, event_time: str, window: str = "1 hour", watermark: str = "2 hours") -> DataFrame:
    """Frame counts per tumbling window; rows later than the watermark are dropped and closed windows leave the
    state."""
    return (
        frames.withWatermark(event_time, watermark)
        .groupBy(F.window(event_time, window), "type_name", "method")
        .agg(F.count(F.lit(1)).alias("n_frames"))
        .select(F.col("window.start").alias("window_start"), "type_name", "method", "n_frames")
    )


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append-only sink: exactly-once files."""
    return (
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(path)
    )


def run_counts_to_table(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Update sink: each batch writes its changed groups to its own folder, so a replayed batch replaces itself.
    Read it back with ``read_counts``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/source={stream_id(batch.sparkSession, checkpoint)}/batch={batch_id}")

    return (
        counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        .foreachBatch(write).trigger(availableNow=True).start()
    )


def read_counts(spark, path: str) -> DataFrame:
    """Current count per group: the one of the latest batch that changed it."""
    rows = spark.read.option("basePath", path).parquet(path)
    return rows.groupBy("window_start", "type_name", "method").agg(
        F.max_by("n_frames", "batch").alias("n_frames"))
