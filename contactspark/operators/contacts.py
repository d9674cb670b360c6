"""From contact pairs to binned, deduplicated pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactspark.operators.order import place

SHORT = 2500  # bp; nearer pairs are ligation artefacts


def bin_index(chrom_sizes: DataFrame, resolution: int, order: list[str] | None = None) -> DataFrame:
    """(chrom_idx, chrom, n_bins, start_bin, end_bin): half-open ranges of global bins, chromosomes in the given order."""
    sizes = chrom_sizes.withColumn("n_bins", F.ceil(F.col("size") / resolution).cast("long"))
    if order:
        rank = F.array_position(F.array(*map(F.lit, order)), F.col("chrom"))
        sizes = sizes.where(F.col("chrom").isin(order)).withColumn("chrom_idx", (rank - 1).cast("int"))
    else:
        sizes = sizes.withColumn("chrom_idx", (F.row_number().over(Window.orderBy("chrom")) - 1).cast("int"))
    ends = F.sum("n_bins").over(Window.orderBy("chrom_idx").rowsBetween(Window.unboundedPreceding, 0))
    return sizes.select("chrom_idx", "chrom", "n_bins", (ends - F.col("n_bins")).alias("start_bin"), ends.alias("end_bin"))


def not_short(contacts: DataFrame) -> DataFrame:
    """Drop pairs on one chromosome that are nearer than SHORT but not at one place."""
    d = F.abs(F.col("pos2") - F.col("pos1"))
    return contacts.where((F.col("chrom1") != F.col("chrom2")) | (d >= SHORT) | (d == 0))


def not_short_intra(contacts: DataFrame) -> DataFrame:
    """Only pairs on one chromosome at SHORT or more; pairs at one place go too."""
    return contacts.where((F.col("chrom1") == F.col("chrom2")) & (F.abs(F.col("pos2") - F.col("pos1")) >= SHORT))


def to_bins(contacts: DataFrame, resolution: int) -> DataFrame:
    place = lambda c: F.floor(F.col(c) / resolution).cast("long")
    return contacts.withColumn("bin1", place("pos1")).withColumn("bin2", place("pos2"))


def to_global_bins(contacts: DataFrame, index: DataFrame, resolution: int) -> DataFrame:
    """Bins in the global numbering; pairs on chromosomes outside the index are dropped. The index has a row a chromosome."""
    index = F.broadcast(index.select("chrom", "chrom_idx", "start_bin"))
    out = to_bins(contacts, resolution)
    for k in ("1", "2"):
        side = index.select(F.col("chrom").alias(f"chrom{k}"), F.col("chrom_idx").alias(f"chrom_idx{k}"), F.col("start_bin").alias(f"__start{k}"))
        out = out.join(side, f"chrom{k}").withColumn(f"bin{k}", F.col(f"bin{k}") + F.col(f"__start{k}")).drop(f"__start{k}")
    return out


def intra_pixels(contacts: DataFrame, resolution: int, canonical: bool = True) -> DataFrame:
    """(cell_id, chrom, bin1, bin2, count) of pairs on one chromosome. ``canonical`` merges (a, b) with (b, a)."""
    p = to_bins(contacts.where("chrom1 = chrom2"), resolution).select("cell_id", F.col("chrom1").alias("chrom"), "bin1", "bin2", "count")
    if not canonical:
        p = p.groupBy("cell_id", "chrom", "bin1", "bin2").agg(F.sum("count").alias("count"))
    low, high = F.least("bin1", "bin2").alias("bin1"), F.greatest("bin1", "bin2").alias("bin2")
    p = p.select("cell_id", "chrom", low, high, "count")
    return p.groupBy("cell_id", "chrom", "bin1", "bin2").agg(F.sum("count").alias("count")) if canonical else p


def inter_pixels(contacts: DataFrame, resolution: int) -> DataFrame:
    p = to_bins(contacts.where("chrom1 <> chrom2"), resolution)
    return p.groupBy("cell_id", "chrom1", "chrom2", "bin1", "bin2").agg(F.sum("count").alias("count"))


def distance_filter(pixels: DataFrame, least: int, most: int) -> DataFrame:
    """Strictly between, in bins."""
    d = F.col("bin2") - F.col("bin1")
    return pixels.where((d > least) & (d < most))


def trainable(pixels: DataFrame, gap: int = 2) -> DataFrame:
    """Pixels that may be learned from: off the diagonal by ``gap`` bins."""
    return pixels.where((F.col("bin1") != F.col("bin2")) & (F.col("bin2") - F.col("bin1") >= gap))


def rescale(pixels: DataFrame, factor: int) -> DataFrame:
    """Pixels of a coarser resolution, as distinct coarse pairs with their sums."""
    to = lambda c: F.floor(F.col(c) / factor).cast("long").alias(c)
    return pixels.select("cell_id", "chrom", to("bin1"), to("bin2"), "count").groupBy("cell_id", "chrom", "bin1", "bin2").agg(F.sum("count").alias("count"))


def hash_order(seed: int, *cols: str) -> Column:
    """A seeded order that any engine with md5 reproduces."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]).cast("binary"))


def exact_share(rows: DataFrame, share: float, keys: list[str], seed: int = 0, partition: list[str] | None = None) -> DataFrame:
    """Column ``chosen`` for exactly floor(share * n) rows (of each partition), in hash order: no sampling error."""
    part = partition or []
    want = rows.groupBy(*part).agg(F.floor(F.lit(share) * F.count("*")).alias("__want"))
    placed = place(rows, part, [hash_order(seed, *keys), *keys], "__place")
    placed = placed.join(F.broadcast(want), part) if part else placed.withColumn("__want", F.lit(want.first()["__want"]))
    return placed.withColumn("chosen", F.col("__place") < F.col("__want")).drop("__place", "__want")


def node_ranges(n_cells: int, index: DataFrame) -> DataFrame:
    """(node_type, start_id, end_id): 0 is padding, cells from 1, then the bins of each chromosome; ends are exclusive."""
    first = index.select(F.col("chrom").alias("node_type"), (F.col("start_bin") + n_cells + 1).alias("start_id"), (F.col("end_bin") + n_cells + 1).alias("end_id"))
    cells = index.sparkSession.createDataFrame([("cell", 1, n_cells + 1)], "node_type string, start_id long, end_id long")
    return cells.unionByName(first)


#: Sparsity over which a positive gets so many negatives; below all of them FALLBACK.
POLICY, FALLBACK = ((0.3, 1), (0.2, 2), (0.15, 3), (0.1, 4)), 5


def negatives_policy(occupancy: DataFrame, policy: tuple[tuple[float, int], ...] = POLICY, fallback: int = FALLBACK) -> DataFrame:
    """(cell_id, negatives): how many negatives a positive of each cell gets, by the cell's share of filled pairs."""
    n = F.lit(fallback)
    for least, count in reversed(policy):
        n = F.when(F.col("sparsity") > least, count).otherwise(n)
    return occupancy.select("cell_id", n.alias("negatives"))
