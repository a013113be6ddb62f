"""Observations as a stream: incremental coverage and per-camera state."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sightline.schema import IMAGE_POINTS


def read_observations(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """Parquet files of observations as they arrive; files_per_trigger bounds a batch."""
    return spark.readStream.schema(IMAGE_POINTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def frame_counts(stream: DataFrame, window: str = "1 second", late: str = "2 seconds") -> DataFrame:
    """Rows, frames and points of each camera in windows of frame time, closed once they can't change."""
    timed = stream.withColumn("at", F.timestamp_micros((F.col("frame_time") * 1e6).cast("long"))).withWatermark("at", late)
    return timed.groupBy(F.window("at", window), "cam_id").agg(
        F.count("*").alias("n"), F.approx_count_distinct("sync_index").alias("frames"), F.min("sync_index").alias("first_frame"), F.max("sync_index").alias("last_frame")
    ).select(F.col("window.start").alias("start"), "cam_id", "n", "frames", "first_frame", "last_frame")


def every_nth(stream: DataFrame, step: int) -> DataFrame:
    return stream.filter(F.col("sync_index") % step == 0)


def matched_pairs(left: DataFrame, right: DataFrame, late: str = "2 seconds") -> DataFrame:
    """Stream-stream join of two cameras on the point and frame, up to ``late`` apart; state is dropped behind the watermark."""
    timed = [d.withColumn("at", F.timestamp_micros((F.col("frame_time") * 1e6).cast("long"))).withWatermark("at", late) for d in (left, right)]
    a, b = (d.select(*(F.col(c).alias(f"{c}_{s}") for c in ("sync_index", "object_id", "keypoint_id", "img_loc_x", "img_loc_y", "at"))) for d, s in zip(timed, "ab"))
    same = F.expr("sync_index_a = sync_index_b AND object_id_a = object_id_b AND keypoint_id_a = keypoint_id_b AND at_a BETWEEN at_b - INTERVAL {late} AND at_b + INTERVAL {late}".format(late=late))
    return a.join(b, same)


BOX = T.StructType([T.StructField(n, T.DoubleType()) for n in ("x0", "y0", "x1", "y1")] + [T.StructField("n", T.LongType())])


def tracked_boxes(stream: DataFrame, pad: float = 0.1) -> DataFrame:
    """(cam_id, x0, y0, x1, y1, n): the padded box of all points of a camera so far, one row a batch and camera.

    The state of a camera is one box, whatever the length of the stream.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        box = state.get if state.exists else (float("inf"), float("inf"), float("-inf"), float("-inf"), 0)
        x0, y0, x1, y1, n = box
        for pdf in batches:
            x0, y0 = min(x0, pdf["img_loc_x"].min()), min(y0, pdf["img_loc_y"].min())
            x1, y1, n = max(x1, pdf["img_loc_x"].max()), max(y1, pdf["img_loc_y"].max()), n + len(pdf)
        state.update((float(x0), float(y0), float(x1), float(y1), int(n)))
        dx, dy = (x1 - x0) * pad, (y1 - y0) * pad
        yield pd.DataFrame({"cam_id": [key[0]], "x0": [x0 - dx], "y0": [y0 - dy], "x1": [x1 + dx], "y1": [y1 + dy], "n": [n]})

    out = "cam_id long, x0 double, y0 double, x1 double, y1 double, n long"
    return stream.groupBy("cam_id").applyInPandasWithState(update, out, BOX.simpleString()[7:-1].replace(":", " "), "update", "NoTimeout")


class FileSink:
    """Parquet under ``path``, a folder for each batch: a batch that comes again replaces its own folder alone.

    Once the stream has ended there is a table ``path``/end with the number of batches; a
    reader that waits for all rows waits for that.
    """

    def __init__(self, path: str, change: Callable[[DataFrame], DataFrame] = lambda d: d) -> None:
        self.path, self.change = path.rstrip("/"), change

    def batch(self, rows: DataFrame, batch_id: int) -> None:
        self.change(rows).write.mode("overwrite").parquet(f"{self.path}/rows/batch={batch_id}")

    def end(self, spark: SparkSession, batches: int) -> None:
        spark.createDataFrame([(batches,)], "batches long").write.mode("overwrite").parquet(f"{self.path}/end")

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/rows").drop("batch")

    def ended(self, spark: SparkSession) -> int | None:
        """The number of batches once the stream has ended, until then None."""
        try:
            return spark.read.schema("batches long").parquet(f"{self.path}/end").first()["batches"]
        except AnalysisException:
            return None


def fan_out(stream: DataFrame, sinks: Sequence[FileSink], checkpoint: str, available: bool = True) -> StreamingQuery:
    """One stream into several sinks: each batch is read once, kept while all sinks take it, and dropped.

    With ``available`` the query ends once all that is there has been read, and hands the end on to
    every sink. A failure in one sink fails the batch; on the next start all of them get it again and
    replace what they had of it.
    """
    spark = stream.sparkSession

    def each(rows: DataFrame, batch_id: int) -> None:
        rows.persist()
        try:
            for sink in sinks:
                sink.batch(rows, batch_id)
        finally:
            rows.unpersist()

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    if not available:
        return writer.start()
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    batches = [p["batchId"] for p in query.recentProgress]
    last = max(batches, default=-1)
    for sink in sinks:
        # A restart without new rows adds no batch to those that there are.
        sink.end(spark, max(last + 1, sink.ended(spark) or 0))
    return query
