"""Long-format contact maps: symmetry, statistics, pseudo-bulk, masks, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["cell_id", "chrom"]


def symmetric(pixels: DataFrame, value: str = "count", double_diagonal: bool = True) -> DataFrame:
    """Both triangles (i, j, v); the diagonal is doubled, as a map plus its transpose has it, unless told otherwise."""
    rest = [c for c in pixels.columns if c not in ("bin1", "bin2", value)]
    pair = lambda a, b: F.struct(F.col(a).alias("i"), F.col(b).alias("j"))
    v = F.when(F.col("bin1") == F.col("bin2"), F.col(value) * (2 if double_diagonal else 1)).otherwise(F.col(value))
    both = F.when(F.col("bin1") == F.col("bin2"), F.array(pair("bin1", "bin2"))).otherwise(F.array(pair("bin1", "bin2"), pair("bin2", "bin1")))
    return pixels.select(*rest, v.alias("v"), F.explode(both).alias("p")).select(*rest, "p.i", "p.j", "v")


def grid(index: DataFrame) -> DataFrame:
    """(chrom, bin): every local bin of a bin index."""
    return index.select("chrom", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bins") - 1)).alias("bin"))


def gcn_map(pixels: DataFrame, index: DataFrame, n_cells: int) -> DataFrame:
    """Off-diagonal map of each cell with 1 on the diagonal of empty rows, scaled to the chromosome's mean reads a cell."""
    off = symmetric(pixels.where("bin1 <> bin2"))
    rows = off.groupBy(*KEY, "i").agg(F.sum("v").alias("s"))
    cells = pixels.select(*KEY).distinct()
    empty = cells.join(F.broadcast(grid(index)), "chrom").withColumnRenamed("bin", "i").join(rows, [*KEY, "i"], "left_anti").select(*KEY, "i", F.col("i").alias("j"), F.lit(1.0).alias("v"))
    full = off.select(*KEY, "i", "j", F.col("v").cast("double").alias("v")).unionByName(empty)
    sums = full.groupBy(*KEY).agg(F.sum("v").alias("s"))
    mean = pixels.groupBy("chrom").agg((F.sum("count") / n_cells).alias("reads"))
    return full.join(sums, KEY).join(F.broadcast(mean), "chrom").select(*KEY, "i", "j", (F.col("v") * F.col("reads") / (F.col("s") + 1e-15)).alias("v"))


def cell_counts(pixels: DataFrame) -> DataFrame:
    """Reads and off-diagonal pixels of each cell and chromosome."""
    return pixels.groupBy(*KEY).agg(F.sum("count").alias("reads"), F.count(F.when(F.col("bin1") != F.col("bin2"), 1)).alias("qc"))


def quality_flag(pixels: DataFrame, index: DataFrame) -> DataFrame:
    """(cell_id, qc, threshold, good): enough off-diagonal pixels for the chromosomes' well covered bins."""
    bulk = symmetric(pixels.groupBy("chrom", "bin1", "bin2").agg(F.sum("count").alias("count")))
    wide = bulk.groupBy("chrom", "i").agg(F.countDistinct("j").alias("n")).join(F.broadcast(index.select("chrom", "n_bins")), "chrom")
    size = wide.where("n > 0.1 * n_bins").groupBy().agg(F.count("*").alias("size"))
    qc = pixels.groupBy("cell_id").agg(F.count(F.when(F.col("bin1") != F.col("bin2"), 1)).alias("qc"))
    threshold = F.greatest(F.lit(0.25) * F.col("size") - 5, F.lit(0.0))
    return qc.join(F.broadcast(size)).select("cell_id", "qc", threshold.alias("threshold"), (F.col("qc") >= threshold).alias("good"))


def occupancy(pixels: DataFrame, index: DataFrame, factor: int) -> DataFrame:
    """(cell_id, filled, possible, sparsity): distinct coarse pairs against half of all coarse pairs."""
    coarse = lambda c: F.floor(F.col(c) / factor)
    filled = pixels.groupBy("cell_id").agg(F.countDistinct("chrom", coarse("bin1"), coarse("bin2")).alias("filled"))
    side = F.ceil(F.col("n_bins") / factor)
    possible = index.agg(F.sum(F.floor(side * side / 2)).alias("possible"))
    return filled.join(F.broadcast(possible)).select("cell_id", "filled", "possible", (F.col("filled") / F.col("possible")).alias("sparsity"))


def pseudo_bulk(pixels: DataFrame, index: DataFrame) -> DataFrame:
    """(chrom, i, j, v): sum over cells and its transpose, 1 on the diagonal of rows empty in the upper triangle, values
    clipped to mean + 10 deviations of the dense map, rows of sum 1."""
    upper = pixels.groupBy("chrom", "bin1", "bin2").agg(F.sum("count").cast("double").alias("count"))
    bins = F.broadcast(grid(index))
    empty = bins.join(upper.select("chrom", F.col("bin1").alias("bin")).distinct(), ["chrom", "bin"], "left_anti").select("chrom", F.col("bin").alias("i"), F.col("bin").alias("j"), F.lit(1.0).alias("v"))
    full = symmetric(upper).unionByName(empty).groupBy("chrom", "i", "j").agg(F.sum("v").alias("v"))
    cells = F.broadcast(index.select("chrom", (F.col("n_bins") * F.col("n_bins")).alias("n")))
    moments = full.groupBy("chrom").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q")).join(cells, "chrom")
    moments = moments.select("chrom", (F.col("s") / F.col("n") + 10 * F.sqrt(F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2))).alias("top"))
    clipped = full.join(F.broadcast(moments), "chrom").select("chrom", "i", "j", F.least("v", "top").alias("v"))
    rows = clipped.groupBy("chrom", "i").agg(F.sum("v").alias("row"))
    return clipped.join(rows, ["chrom", "i"]).select("chrom", "i", "j", (F.col("v") / F.col("row")).alias("v"))


def distance_decay(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("chrom", (F.col("bin2") - F.col("bin1")).alias("distance")).agg(F.avg("count").alias("mean"))


def cell_weight(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("cell_id").agg(F.avg("count").alias("weight"))


def read_counts(pixels: DataFrame, n_bins: int) -> DataFrame:
    """Reads of each cell; log10(reads + 1) of them once the largest exceeds the number of bins."""
    reads = pixels.groupBy("cell_id").agg(F.sum("count").alias("reads"))
    top = reads.agg(F.max("reads").alias("__top"))
    return reads.join(F.broadcast(top)).select("cell_id", "reads", F.when(F.col("__top") > n_bins, F.log10(F.col("reads") + 1)).otherwise(F.col("reads")).cast("double").alias("shown"))


def near_ratio(pixels: DataFrame, near: int = 20) -> DataFrame:
    """(cell_id, ratio): share of the symmetric map within ``near`` diagonals, the main one once."""
    d = F.col("bin2") - F.col("bin1")
    close = 2 * F.sum(F.when(d < near, F.col("count")).otherwise(0)) - F.sum(F.when(d == 0, F.col("count")).otherwise(0))
    whole = F.sum(F.when(d == 0, F.col("count")).otherwise(2 * F.col("count")))
    return pixels.groupBy("cell_id").agg((close / whole).alias("ratio"))


def merge_cells(pixels: DataFrame, groups: DataFrame, group: str, mean: bool = True) -> DataFrame:
    """One map for each group of cells: sum, or sum over the number of the group's cells."""
    sizes = groups.groupBy(group).agg(F.count("*").alias("n"))
    merged = pixels.join(groups, "cell_id").groupBy(group, "chrom", "bin1", "bin2").agg(F.sum("count").alias("v"))
    return merged.join(F.broadcast(sizes), group).select(group, "chrom", "bin1", "bin2", (F.col("v") / F.col("n") if mean else F.col("v")).alias("v"))


def select_cells(pixels: DataFrame, cells: list[int], mean: bool = True) -> DataFrame:
    chosen = pixels.where(F.col("cell_id").isin(cells)).groupBy("chrom", "bin1", "bin2").agg(F.sum("count").alias("v"))
    return chosen.withColumn("v", F.col("v") / len(cells)) if mean else chosen


def label_counts(labels: DataFrame, label: str) -> DataFrame:
    return labels.groupBy(label).agg(F.count("*").alias("n"))


def histogram(values: DataFrame, value: str, n: int = 20) -> DataFrame:
    """(bucket, low, high, n): ``n`` equal buckets from least to largest value, the last one closed."""
    edges = values.agg(F.min(value).cast("double").alias("__a"), F.max(value).cast("double").alias("__b"))
    k = F.least(F.floor((F.col(value) - F.col("__a")) / ((F.col("__b") - F.col("__a")) / n)), F.lit(n - 1)).cast("int")
    counts = values.join(F.broadcast(edges)).groupBy(k.alias("bucket"), "__a", "__b").agg(F.count("*").alias("n"))
    width = (F.col("__b") - F.col("__a")) / n
    return counts.select("bucket", (F.col("__a") + F.col("bucket") * width).alias("low"), (F.col("__a") + (F.col("bucket") + 1) * width).alias("high"), "n")


def expected(sym: DataFrame, keys: list[str], nonzero: bool = True) -> DataFrame:
    """Expected value of each diagonal: over its non-zero entries, or over all that are there."""
    n = F.count(F.when(F.col("v") != 0, 1)) + 1e-15 if nonzero else F.count("v")
    return sym.groupBy(*keys, (F.col("j") - F.col("i")).alias("d")).agg((F.sum("v") / n).alias("expected"))


def arm_lengths(cytoband: DataFrame) -> DataFrame:
    return cytoband.groupBy("chrom", F.substring("name", 1, 1).alias("arm")).agg(F.sum(F.col("end") - F.col("start")).alias("length"))


def split_arms(cytoband: DataFrame, least: int = 20_000_000) -> DataFrame:
    """(chrom, split): where the short arm ends, if it is long enough to stand alone; else null."""
    arms = arm_lengths(cytoband).where("arm = 'p'")
    return cytoband.select("chrom").distinct().join(arms, "chrom", "left").select("chrom", F.when(F.col("length") >= least, F.col("length")).alias("split"))


def centromere_bins(cytoband: DataFrame, resolution: int, pad: int) -> DataFrame:
    """(chrom, bin) of the centromeres, widened by ``pad``; bins before 0 are left out."""
    a = F.greatest(F.floor((F.col("start") - pad) / resolution), F.lit(0)).cast("long")
    b = F.ceil((F.col("end") + pad) / resolution).cast("long")
    span = F.when(b > a, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))
    return cytoband.where("type = 'acen'").select("chrom", F.explode(span).alias("bin")).distinct()


def gap_bins(sym_bulk: DataFrame, index: DataFrame) -> DataFrame:
    """(chrom, bin) of the bins whose bulk row is empty."""
    filled = sym_bulk.groupBy("chrom", F.col("i").alias("bin")).agg(F.sum("v").alias("s")).where("s <> 0")
    return grid(index).join(filled, ["chrom", "bin"], "left_anti")


def without_bins(sym: DataFrame, bins: DataFrame) -> DataFrame:
    """Anti join of the rows and columns of a map with a list of bins."""
    out = sym
    for side in ("i", "j"):
        out = out.join(bins.select("chrom", F.col("bin").alias(side)), ["chrom", side], "left_anti")
    return out


def band(sym: DataFrame, k: int) -> DataFrame:
    """The k nearest diagonals; all of them if k is not positive."""
    return sym.where(F.abs(F.col("i") - F.col("j")) < k) if k > 0 else sym


def drop_sparse_rows(sym: DataFrame, keys: list[str], percent: float = 0.0, value: str = "v") -> DataFrame:
    """Without rows and columns of zero diagonal (percent 0) or of the lowest row sums; bins are numbered anew from 0."""
    bins = sym.groupBy(*keys, F.col("i").alias("bin")).agg(F.sum(value).alias("s"), F.sum(F.when(F.col("i") == F.col("j"), F.col(value)).otherwise(0)).alias("diagonal"))
    if percent:
        among = Window.partitionBy(*keys)
        bins = bins.withColumn("r", F.row_number().over(among.orderBy("s", "bin"))).withColumn("n", F.count("*").over(among)).where(F.col("r") > F.floor(F.col("n") * percent / 100))
    else:
        bins = bins.where("diagonal <> 0")
    bins = bins.select(*keys, "bin", (F.row_number().over(Window.partitionBy(*keys).orderBy("bin")) - 1).cast("long").alias("new"))
    out = sym
    for side in ("i", "j"):
        out = out.join(bins.select(*keys, F.col("bin").alias(side), F.col("new").alias(f"new_{side}")), [*keys, side])
    return out.select(*keys, F.col("new_i").alias("i"), F.col("new_j").alias("j"), value)


def bin_pairs(index: DataFrame, least: int, most: int, masked: DataFrame | None = None) -> DataFrame:
    """(chrom, bin1, bin2) at ``least`` <= distance < ``most``: a generated band, no self join."""
    bins = grid(index)
    if masked is not None:
        bins = bins.join(masked, ["chrom", "bin"], "left_anti")
    sized = bins.join(F.broadcast(index.select("chrom", "n_bins")), "chrom")
    a, b = F.col("bin") + least, F.least(F.col("bin") + most, F.col("n_bins"))
    pairs = sized.where(a < b).select("chrom", F.col("bin").alias("bin1"), F.explode(F.sequence(a, b - 1)).alias("bin2"))
    return pairs if masked is None else pairs.join(masked.withColumnRenamed("bin", "bin2"), ["chrom", "bin2"], "left_anti").select("chrom", "bin1", "bin2")


def neighbour_sum(pixels: DataFrame, neighbours: DataFrame) -> DataFrame:
    """(cell_id, chrom, bin1, bin2, v): maps of the neighbours (cell, nbr, weight) of each cell, weighted and summed."""
    joined = neighbours.join(pixels.withColumnRenamed("cell_id", "nbr"), "nbr")
    return joined.groupBy(F.col("cell").alias("cell_id"), "chrom", "bin1", "bin2").agg(F.sum(F.col("weight") * F.col("count")).alias("v"))
