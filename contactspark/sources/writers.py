"""Sinks: triplets, maps, imputed parts, cool-like tables, tracks, embeddings. All are Parquet, partitioned for the reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def pixels(df: DataFrame, path: str) -> None:
    """By chromosome, sorted by cell in each file, so that a cell's map is a pruned scan."""
    df.repartition("chrom", F.pmod("cell_id", F.lit(64))).sortWithinPartitions("chrom", "cell_id", "bin1", "bin2").write.mode("overwrite").partitionBy("chrom").parquet(path)


def upsert(df: DataFrame, path: str, partition: list[str]) -> None:
    """Replace only the partitions that ``df`` has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


def imputed(df: DataFrame, path: str, part: str) -> None:
    """(stage, cell_id, chrom, i, j, p) by stage, chromosome and ``part``, the name of this batch of cells.

    Further parts are added beside the first; writing a part again replaces it, so a retry doubles nothing.
    """
    named = df.select("stage", "chrom", F.lit(part).alias("part"), "cell_id", "i", "j", F.col("p").cast("float").alias("p"))
    named.sortWithinPartitions("cell_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("stage", "chrom", "part").parquet(path)


def linked(first: DataFrame, second: DataFrame | None = None) -> DataFrame:
    """Parts of imputed maps (cell_id, chrom, i, j, p), each over its map's mean; a second stage is added where it exists."""
    over = lambda df: df.withColumn("p", F.col("p") / F.avg("p").over(Window.partitionBy("cell_id", "chrom")))
    out = over(first)
    if second is None:
        return out
    more = over(second).withColumnRenamed("p", "q")
    return out.join(more, ["cell_id", "chrom", "i", "j"], "left").select("cell_id", "chrom", "i", "j", (F.col("p") + F.coalesce("q", F.lit(0.0))).alias("p"))


def cool_tables(pixels_df: DataFrame, index: DataFrame, resolution: int) -> tuple[DataFrame, DataFrame]:
    """Bins (bin_id, chrom, start, end) and pixels (cell_id, bin1_id, bin2_id, count float) of the upper triangle."""
    at = index.select("chrom", "start_bin", "n_bins")
    bins = at.select("chrom", "start_bin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bins") - 1)).alias("b"))
    bins = bins.select((F.col("start_bin") + F.col("b")).alias("bin_id"), "chrom", (F.col("b") * resolution).alias("start"), ((F.col("b") + 1) * resolution).alias("end"))
    rows = pixels_df.where("bin2 >= bin1").join(F.broadcast(at), "chrom")
    return bins, rows.select("cell_id", (F.col("start_bin") + F.col("bin1")).alias("bin1_id"), (F.col("start_bin") + F.col("bin2")).alias("bin2_id"), F.col("count").cast("float").alias("count"))


def write_cool_tables(pixels_df: DataFrame, index: DataFrame, resolution: int, path: str) -> None:
    bins, rows = cool_tables(pixels_df, index, resolution)
    bins.coalesce(1).sortWithinPartitions("bin_id").write.mode("overwrite").parquet(f"{path}/bins")
    rows.repartitionByRange("cell_id", "bin1_id").sortWithinPartitions("cell_id", "bin1_id", "bin2_id").write.mode("overwrite").parquet(f"{path}/pixels")


def cell_maps(pixels_df: DataFrame, index: DataFrame, resolution: int, path: str, append: bool = False, parts: int | None = None) -> None:
    """Pixels (cell_id, chrom, bin1, bin2, count), raw, walked or imputed, as a ``cellmaps`` table with its bins.

    Cells are dealt by ranges to ``parts``, or as many as their size asks for, so that a cell is in few; ``append`` adds cells to those that are there. A merged map is a
    table of one cell, see ``merged``.
    """
    from contactspark.sources import cellmaps

    spark = pixels_df.sparkSession
    spark.dataSource.register(cellmaps.CellMaps)
    bins, rows = cool_tables(pixels_df, index, resolution)
    order = ["cell_id", "bin1_id", "bin2_id"]
    dealt = (rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)).sortWithinPartitions("cell_id", "bin1_id", "bin2_id")
    dealt.write.format("cellmaps").mode("append" if append else "overwrite").save(path)
    places = [[r["chrom"], r["start"], r["end"]] for r in bins.orderBy("bin_id").toLocalIterator()]  # of the index, not of contacts
    cellmaps.write_manifest(path, cellmaps.manifest(path) | {"bins": places})


def read_cell_maps(spark: SparkSession, path: str, cells: list[int] | None = None) -> DataFrame:
    """(cell_id, chrom, bin1, bin2, count) of a ``cellmaps`` table, of all cells or some; bins count within their chromosome."""
    from contactspark.sources import cellmaps

    spark.dataSource.register(cellmaps.CellMaps)
    bins = cellmaps.manifest(path)["bins"]
    first: dict[str, int] = {}
    for at, (chrom, *_) in enumerate(bins):
        first.setdefault(chrom, at)
    starts = sorted((v, k) for k, v in first.items())
    index = spark.createDataFrame([(c, a, b) for (a, c), b in zip(starts, [*(s for s, _ in starts[1:]), len(bins)])], "chrom string, __from long, __to long")
    reader = spark.read.format("cellmaps")
    rows = (reader.option("cells", ",".join(map(str, cells))) if cells else reader).load(path)
    on = (F.col("bin1_id") >= F.col("__from")) & (F.col("bin1_id") < F.col("__to"))
    joined = rows.join(F.broadcast(index), on)  # a row for each chromosome
    return joined.select("cell_id", "chrom", (F.col("bin1_id") - F.col("__from")).alias("bin1"), (F.col("bin2_id") - F.col("__from")).alias("bin2"), "count")


def merged(maps: DataFrame) -> DataFrame:
    """A merged map (chrom, bin1, bin2, v) as the pixels of cell 0."""
    return maps.select(F.lit(0).cast("long").alias("cell_id"), "chrom", "bin1", "bin2", F.col("v").alias("count"))


def tracks(df: DataFrame, path: str) -> None:
    """(track, cell_id, chrom, start, end, value); the bulk's cell_id is null."""
    df.write.mode("overwrite").partitionBy("track", "chrom").parquet(path)


def embeddings(df: DataFrame, path: str) -> None:
    df.select("id", "v").write.mode("overwrite").parquet(path)


def fetch_map(spark: SparkSession, path: str, chrom: str, cell_id: int, stages: list[str]) -> DataFrame:
    """Point query: the stages of one cell's map, pruned to their partitions; a missing one has no rows."""
    return spark.read.parquet(path).where(F.col("stage").isin(stages) & (F.col("chrom") == chrom) & (F.col("cell_id") == cell_id)).select("stage", "i", "j", "p")
