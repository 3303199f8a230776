"""Streams: pages and detections from folders as they arrive, and a periodic hook."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import detections as det, documents


def read_stream(spark: SparkSession, path: str, like: DataFrame, files_a_trigger: int | None = None) -> DataFrame:
    """A stream of Parquet files of a folder, or of one file, with the schema of a batch frame."""
    r = spark.readStream.schema(like.schema)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        r, path = r.option("pathGlobFilter", at.getName()), str(at.getParent())
    if files_a_trigger:
        r = r.option("maxFilesPerTrigger", files_a_trigger)
    return r.parquet(path)


def stream_markdown(pages: DataFrame, to: str, checkpoint: str) -> StreamingQuery:
    """Markdown of pages, appended to a folder of Parquet; what has arrived is done, then it ends."""
    return documents.page_markdown(pages).writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_detections(detections: DataFrame, to: str, checkpoint: str, **options) -> StreamingQuery:
    """Post-processed detections. An image's detections arrive in one file, so each batch is complete in itself; a
    batch that is repeated after a failure overwrites its own folder."""

    def each(batch: DataFrame, number: int) -> None:
        det.postprocess(batch, **options).write.mode("overwrite").parquet(f"{to}/batch={number}")

    return detections.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def every(period: int, hook: Callable[[DataFrame, int], None], always: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that calls the hook for batches 0, period, 2 * period, ..."""
    if period == 0:
        raise ZeroDivisionError("the period is 0")

    def each(batch: DataFrame, number: int) -> None:
        if always:
            always(batch, number)
        if number % period == 0:
            hook(batch, number)

    return each
