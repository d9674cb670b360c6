"""Contiguous, byte-balanced shards from a global prefix sum of sizes.

Rows are range-partitioned by id (narrow columns only, never the text). The totals of the partitions give each partition
its offset; a running sum inside the partition gives each row its place among all bytes; equal targets cut that line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contactspark.llm.common import materialise


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )


def byte_shards(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, start_byte) for every row of ``docs``.

    A row's shard is the target interval that holds the middle of its bytes, so shards are contiguous in the order
    (doc_id, text_crc32, size) and a shard's bytes differ from the target by less than one row at either end. A null text
    counts no bytes plus the one that ends it, and its crc32 is 0; a null doc_id comes first; repeated rows each get their
    own slot; an empty table gives no rows; further columns of ``docs`` are ignored. ``slot`` is gapless from 0 in a shard.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    spark = docs.sparkSession
    n = partitions or max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["doc_id", "text_crc32", "size"]
    placed = sizes(docs, id_col, text_col).repartitionByRange(n, *order).withColumn("part", F.spark_partition_id())
    placed = materialise(placed, "shard-sizes")  # range bounds come from a sample: fixed once for both uses below
    by_part = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(by_part), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(by_part), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(everything).alias("all_bytes"),
    )
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        placed.withColumn("start_byte", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .withColumn("row", F.coalesce(F.count("*").over(inside), F.lit(0)))
        .join(F.broadcast(offsets), "part")  # at most one row for each of the n partitions
        .withColumn("start_byte", F.col("start_byte") + F.col("bytes_before"))
        .withColumn("row", F.col("row") + F.col("rows_before"))
        .withColumn("shard", F.expr(f"cast(((2 * start_byte + size) * {n_shards}) div (2 * all_bytes) as int)"))
    )
    rows = materialise(rows.select(*order, "start_byte", "row", "shard"), "shard-rows")
    firsts = rows.groupBy("shard").agg(F.min("row").alias("first_row"))
    return rows.join(F.broadcast(firsts), "shard").select(  # at most n_shards rows
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("row") - F.col("first_row")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "start_byte",
    )
