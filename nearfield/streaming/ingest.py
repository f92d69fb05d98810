"""Streams beside the stored points: ingest into an index's delta, and neighbours of streamed queries (an extension)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import Index
from ..operators.knn import knn_join


def ingest(points: DataFrame, index: Index, checkpoint: str, then: Callable[[Index], None], rebuild_threshold: float = 2.0) -> StreamingQuery:
    """Adds each micro-batch of streamed points (``id, vec``) to the index; ``then`` gets each new handle.

    A batch is stored beside the stream's checkpoint and read from there. One that comes again after a restart adds
    nothing, since ids that the index has are left out.
    """
    held = [index]

    def add(batch: DataFrame, number: int) -> None:
        path = f"{checkpoint}/points/batch={number}"
        new = batch.select("id", "vec").dropDuplicates(["id"]).join(held[0]._all().select("id"), "id", "left_anti")
        new.write.mode("overwrite").parquet(path)
        stored = batch.sparkSession.read.schema(batch.select("id", "vec").schema).parquet(path)
        if not stored.isEmpty():
            held[0] = held[0].add_points(stored, rebuild_threshold)
        then(held[0])

    return points.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).start()


def search_stream(queries: DataFrame, points: DataFrame, k: int, path: str, checkpoint: str, name: str = "l2") -> StreamingQuery:
    """Exact neighbours of streamed queries (``qid, vec``) among stored points, a Parquet folder for each micro-batch."""

    def answer(batch: DataFrame, number: int) -> None:
        knn_join(batch, points, k, name).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).start()


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by window and type, with a watermark for late ones; the same plan for streams and tables."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
