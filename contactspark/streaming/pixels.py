"""Incremental pixel counts of a stream of contact files, and windowed counts of an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from contactspark import schema as S
from contactspark.operators.contacts import intra_pixels, not_short


def contact_stream(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(S.CONTACTS).option("sep", "\t").option("header", True).option("maxFilesPerTrigger", files_per_trigger).csv(folder)


def pixel_stream(contacts: DataFrame, resolution: int) -> DataFrame:
    """Running pixel sums; state holds a row for each pixel."""
    return intra_pixels(not_short(contacts), resolution)


def start(contacts: DataFrame, resolution: int, path: str, checkpoint: str) -> StreamingQuery:
    """Write the pixels that each micro-batch changes, with their sums so far, at ``path``/batch=N.

    A batch that is run again replaces its own folder, so a restart counts nothing twice.
    """

    def keep(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return pixel_stream(contacts, resolution).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The pixels that a stream has written: of each its last sum."""
    return spark.read.parquet(path).groupBy("cell_id", "chrom", "bin1", "bin2").agg(F.max_by("count", "batch").alias("count"))


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and means by window and type; rows later than the watermark are dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "mean")
