"""Incremental forms: what is new since the last run, and windows over late events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_new(spark: SparkSession, folder: str, schema: str, files: int = 100) -> DataFrame:
    """A stream over the parquet files of a folder, at most ``files`` in a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def append_unseen(stream: DataFrame, target: str, checkpoint: str, key: str) -> StreamingQuery:
    """Write rows whose key the target doesn't have yet, then stop; of equal keys in a batch one is kept.

    A batch that is run again after a failure finds its rows in the target already.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        at = spark._jvm.org.apache.hadoop.fs.Path(target)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            ends = fresh.agg(F.min(key).alias("low"), F.max(key).alias("high")).first()
            if ends.low is not None:  # the ends reach the files' statistics, so that old files aren't read
                known = spark.read.parquet(target).where(F.col(key).between(ends.low, ends.high)).select(key)
                fresh = fresh.join(known, key, "left_anti")
        fresh.select(*batch.columns).write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, time: str, kind: str, value: str, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by window and kind; events later than ``late`` are left out."""
    timed = events.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", late)
    grouped = timed.groupBy(F.window("_time", length).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return grouped.select(F.col("w.start").alias("starts"), kind, "n", "total")
