"""What an explorer asks for when cells are picked: the selection, its labels and values, and its merged map, in one answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grown(cells: DataFrame, chosen: list[int], size: int) -> DataFrame:
    """(cell_id): the chosen cells; a single one grows to the ``size`` nearest by (x, y), itself included.

    A missing coordinate of either cell counts as no distance; ties go to the smaller id. An unknown cell selects nothing.
    """
    if len(chosen) != 1 or size <= 1:
        return cells.where(F.col("cell_id").isin(chosen)).select("cell_id") if chosen else cells.select("cell_id").limit(0)
    one = cells.where(F.col("cell_id") == chosen[0]).select(F.col("x").alias("cx"), F.col("y").alias("cy")).limit(1)
    part = lambda a, b: F.coalesce(F.nanvl((F.col(a) - F.col(b)) * (F.col(a) - F.col(b)), F.lit(0.0)), F.lit(0.0))
    near = cells.join(F.broadcast(one)).withColumn("d", part("x", "cx") + part("y", "cy"))  # one row
    return near.orderBy("d", "cell_id").limit(size).select("cell_id")


def selection(cells: DataFrame, pixels: DataFrame, chosen: list[int], grow: int = 1, buckets: int = 20) -> DataFrame:
    """(part, chrom, a, b, name, value) for cells (cell_id, x, y, label, value) and their pixels:

    * ``cell``: each selected cell (a);
    * ``label``: how many of them have each label (name);
    * ``histogram``: how many have a value in bucket a of ``buckets`` equal ones over the values of *all* cells, empty ones left out;
    * ``map``: the mean over the selected cells of each pixel (chrom, a, b).

    The selection is found once; one pass over its cells counts labels and buckets, one over the pixels merges the map. An empty
    selection gives no rows.
    """
    ids = F.broadcast(grown(cells, chosen, grow))  # what a user has picked, or ``grow`` rows
    edges = cells.agg(F.min("value").cast("double").alias("lo"), F.max("value").cast("double").alias("hi"))
    bucket = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("value") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / buckets)), F.lit(buckets - 1))).otherwise(F.lit(0)).cast("long")
    row = lambda part, a, name: F.struct(F.lit(part).alias("part"), a.cast("long").alias("a"), name.cast("string").alias("name"))
    nothing = F.lit(None)
    asked = F.array(row("cell", F.col("cell_id"), nothing), row("label", nothing, F.col("label")), F.when(F.col("value").isNotNull(), row("histogram", bucket, nothing)))
    mine = cells.join(ids, "cell_id", "left_semi").join(F.broadcast(edges))  # one row
    counts = mine.select(F.explode(asked).alias("r")).where("r IS NOT NULL").groupBy("r.part", "r.a", "r.name").agg(F.count("*").cast("double").alias("value"))
    counts = counts.select("part", F.lit(None).cast("string").alias("chrom"), "a", F.lit(None).cast("long").alias("b"), "name", "value")
    number = ids.agg(F.count("*").alias("n"))
    merged = pixels.join(ids, "cell_id", "left_semi").groupBy("chrom", "bin1", "bin2").agg(F.sum("count").alias("s")).join(F.broadcast(number))  # one row
    return counts.unionByName(merged.select(F.lit("map").alias("part"), "chrom", F.col("bin1").cast("long").alias("a"), F.col("bin2").cast("long").alias("b"), F.lit(None).cast("string").alias("name"), (F.col("s") / F.col("n")).alias("value")))
