"""Streams of fetch and parse records."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def deduplicated(stream: DataFrame, key: str, at: str, delay: str = "1 hour") -> DataFrame:
    """The first record of each key within the watermark's delay; state for older keys goes."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, at: str, width: str = "1 day", delay: str = "1 hour", by: str = "event_type") -> DataFrame:
    """Records and value sums for each window and kind, once the watermark has passed the window."""
    grouped = stream.withWatermark(at, delay).groupBy(F.window(at, width), by)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")


def append_new(stream: DataFrame, target: str, keys: list[str], checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Each micro-batch's records whose keys the target folder (Parquet) lacks are appended to it, after `transform`:
    a restarted stream repeats nothing. Of the target only the keys between the batch's smallest and largest first key are
    read: put first a key that grows with time, and old files are skipped by their statistics."""

    def write(batch: DataFrame, epoch: int) -> None:
        new = first = batch.dropDuplicates(keys).persist()  # read for its bounds, the join and the write
        hadoop = batch.sparkSession._jvm.org.apache.hadoop.fs.Path(target)
        if hadoop.getFileSystem(batch.sparkSession._jsc.hadoopConfiguration()).exists(hadoop):
            low, high = new.agg(F.min(keys[0]), F.max(keys[0])).first()
            held = batch.sparkSession.read.parquet(target).select(*keys)
            new = new.join(held.where(F.col(keys[0]).between(F.lit(low), F.lit(high))), keys, "left_anti") if low is not None else new
        (transform(new) if transform else new).write.mode("append").parquet(target)
        first.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
