"""Scans with declared schemas. Every format splits, so no chunking by hand and no order of rows is assumed."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contactspark import schema as S
from contactspark.operators.contacts import not_short_intra
from contactspark.operators.maps import grid, symmetric
from contactspark.operators.order import running
from contactspark.operators.tables import materialise


def chrom_sizes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.CHROM_SIZES).csv(path, sep="\t")


def contacts(spark: SparkSession, path: str) -> DataFrame:
    """One table of all cells, tab-separated with a header. A missing count is 1."""
    return spark.read.schema(S.CONTACTS).csv(path, sep="\t", header=True, enforceSchema=True).withColumn("count", F.coalesce("count", F.lit(1.0)))


def _place(path: Column) -> Column:
    """A path without its scheme and host, as files' own paths and those of a list may differ in these."""
    return F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")


def cell_contacts(spark: SparkSession, file_list: str, columns: str = S.CELL_CONTACTS, header: bool = False, comment: str | None = "#") -> DataFrame:
    """One file for each cell; cell_id is the line of the file's path in ``file_list``, from 0. A missing count is 1.

    Files are told apart by their whole paths; ``cell_name`` is the last part. A relative path is one of the driver's folder. Paths
    that are listed twice are refused.
    """
    listed = [r["value"].strip() for r in spark.read.text(file_list, wholetext=False).coalesce(1).where(F.trim("value") != "").toLocalIterator()]  # a row for each file
    paths = [p if ":" in p.split("/")[0] or p.startswith("/") else os.path.abspath(p) for p in listed]
    if len(set(paths)) != len(paths):
        raise ValueError("the paths of a list must differ")
    order = spark.createDataFrame(list(enumerate(paths)), "cell_id long, path string").select("cell_id", _place(F.col("path")).alias("__place"), F.element_at(F.split("path", "/"), -1).alias("cell_name"))
    options = {"sep": "\t", "header": header} | ({"comment": comment} if comment else {})
    rows = spark.read.schema(columns).csv(paths, **options).withColumn("__place", _place(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))))  # given as a URI
    rows = rows.join(order, "__place").drop("__place")
    count = F.coalesce("count", F.lit(1.0)) if "count" in rows.columns else F.lit(1.0)
    return rows.withColumn("count", count)


def cell_contacts_intra(spark: SparkSession, file_list: str, **options) -> DataFrame:
    """The fast path of ``cell_contacts``: only pairs on one chromosome that aren't too near, dropped in the scan."""
    return not_short_intra(cell_contacts(spark, file_list, **options))


def cytoband(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.CYTOBAND).csv(path, sep="\t", comment="#")


def on_bins(track: DataFrame, index: DataFrame, resolution: int) -> DataFrame:
    """A (chrom, bin in bp, value) track on every bin: -1 means missing, bins without a row are 0, the last row of a bin wins."""
    placed = track.select("chrom", F.floor(F.col("bin") / resolution).cast("long").alias("b"), "bin", F.when(F.col("value") != -1, F.col("value")).alias("value"))
    last = placed.groupBy("chrom", F.col("b").alias("bin")).agg(F.max_by(F.struct("value"), "bin").alias("x"))
    return grid(index).join(last, ["chrom", "bin"], "left").select("chrom", "bin", F.when(F.col("x").isNull(), F.lit(0.0)).otherwise(F.col("x.value")).alias("value"))


def calibration(spark: SparkSession, path: str, index: DataFrame, resolution: int) -> DataFrame:
    return on_bins(spark.read.schema(S.CALIBRATION).csv(path, sep="\t"), index, resolution)


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, offset, sequence): a piece for each line, in upper case; a header's first word names the sequence.

    Running counts of headers and bases give each line its sequence and place, so neither a file nor a chromosome is held in
    one task. A header without lines has one empty piece. Lines before the first header are left out.
    """
    lines = spark.read.text(path, wholetext=False).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("n"), F.trim("value").alias("line"))
    head = F.startswith("line", F.lit(">"))
    counted = materialise(running(lines, ["file"], ["n"], {"heads": head.cast("long"), "before": F.when(head, 0).otherwise(F.length("line")).cast("long")}), "fasta")
    names = counted.where(head).select("file", (F.col("heads") + 1).alias("heads"), F.split(F.substring("line", 2, 1 << 20), r"\s").getItem(0).alias("chrom"), F.col("before").alias("start"))
    body = counted.where(~head & (F.col("line") != "")).select("file", "heads", "before", "line")
    return names.join(body, ["file", "heads"], "left").select("chrom", F.coalesce(F.col("before") - F.col("start"), F.lit(0)).cast("long").alias("offset"), F.upper(F.coalesce("line", F.lit(""))).alias("sequence"))


def bulk_map(bins: DataFrame, pixels: DataFrame, index: DataFrame, fallback: DataFrame, resolution: int) -> DataFrame:
    """(chrom, i, j, v) of a bulk map in bins and pixels tables, each chromosome scaled to a mean row sum of 1.

    A chromosome whose number of bins differs from the index takes the fallback's rows (chrom, i, j, v).
    """
    sizes = bins.groupBy("chrom").agg(F.count("*").alias("have"), F.min("bin_id").alias("first"))
    fits = index.join(F.broadcast(sizes), "chrom", "left").select("chrom", "n_bins", "first", (F.coalesce("have", F.lit(-1)) == F.col("n_bins")).alias("fits"))
    ids = bins.select("bin_id", "chrom")
    local = pixels.join(ids.withColumnRenamed("bin_id", "bin1_id"), "bin1_id").join(ids.select(F.col("bin_id").alias("bin2_id"), F.col("chrom").alias("other")), "bin2_id").where("chrom = other").join(F.broadcast(fits.where("fits")), "chrom")
    sym = symmetric(local.select("chrom", (F.col("bin1_id") - F.col("first")).alias("bin1"), (F.col("bin2_id") - F.col("first")).alias("bin2"), F.nanvl(F.col("count").cast("double"), F.lit(0.0)).alias("count")), double_diagonal=False)
    total = sym.groupBy("chrom").agg(F.sum("v").alias("t")).join(F.broadcast(index.select("chrom", "n_bins")), "chrom")
    scaled = sym.join(F.broadcast(total), "chrom").select("chrom", "i", "j", (F.col("v") * F.col("n_bins") / F.col("t")).alias("v"))
    return scaled.unionByName(fallback.join(F.broadcast(fits.where("not fits").select("chrom")), "chrom", "left_semi").select("chrom", "i", "j", "v"))


def npy(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, v) of a small dense matrix that the driver reads; its non-zero cells only."""
    import numpy as np

    m = np.load(path, allow_pickle=False)
    i, j = np.nonzero(m)
    return spark.createDataFrame(list(zip(i.tolist(), j.tolist(), m[i, j].astype(float).tolist())), "i long, j long, v double")


def labels(spark: SparkSession, path: str) -> DataFrame:
    """Cell labels from Parquet, or CSV with a header; pickles are never read."""
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.csv(path, header=True, inferSchema=True)


def signals(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("cell_id long, chrom string, bin long, signal string, value double").parquet(path)
