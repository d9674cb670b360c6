"""Normalisations and convolutions of long-format maps. ``sym`` holds both triangles as (keys..., i, j, v)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactspark.operators.maps import expected
from contactspark.operators.order import tie_ranked


def coverage_sqrt(sym: DataFrame, keys: list[str]) -> DataFrame:
    """Divide by the square roots of both rows' sums."""
    rows = sym.groupBy(*keys, "i").agg(F.sum("v").alias("__s"))
    other = rows.withColumnRenamed("i", "j").withColumnRenamed("__s", "__t")
    v = F.when((F.col("__s") > 0) & (F.col("__t") > 0), F.col("v") / F.sqrt("__s") / F.sqrt("__t")).otherwise(F.lit(0.0))
    return sym.join(rows, [*keys, "i"]).join(other, [*keys, "j"]).select(*keys, "i", "j", v.alias("v"))


def observed_expected(sym: DataFrame, keys: list[str], nonzero: bool = True) -> DataFrame:
    """Each value over its diagonal's expected value; the diagonal itself is 1."""
    e = expected(sym, keys, nonzero)
    v = F.when(F.col("d") == 0, F.lit(1.0)).otherwise(F.when(F.col("expected") != 0, F.col("v") / F.col("expected")).otherwise(F.lit(0.0)))
    return sym.withColumn("d", F.col("j") - F.col("i")).join(F.broadcast(e) if not keys else e, [*keys, "d"]).select(*keys, "i", "j", v.alias("v"))


def signed_log2(v: Column) -> Column:
    return F.log2(1 + F.abs(v)) * F.sign(v)


def spread(sym: DataFrame, keys: list[str], steps_i: list[tuple[int, float]], steps_j: list[tuple[int, float]], index: DataFrame, edge: str) -> DataFrame:
    """A separable convolution: each pixel is spread to its destinations, then summed.

    ``edge``: 'zero' drops what leaves the map, 'reflect' folds it back (the edge bin repeated).
    """
    step = lambda steps, name: F.explode(F.array(*[F.struct(F.lit(d).cast("long").alias("d"), F.lit(w).alias("w")) for d, w in steps])).alias(name)
    out = sym.join(F.broadcast(index.select("chrom", "n_bins")), "chrom").select("*", step(steps_i, "si")).select("*", step(steps_j, "sj"))
    for side in ("i", "j"):
        out = out.withColumn(side, F.col(side) + F.col(f"s{side}.d"))
        if edge == "reflect":
            out = out.withColumn(side, F.when(F.col(side) < 0, -1 - F.col(side)).when(F.col(side) >= F.col("n_bins"), 2 * F.col("n_bins") - 1 - F.col(side)).otherwise(F.col(side)))
        else:
            out = out.where((F.col(side) >= 0) & (F.col(side) < F.col("n_bins")))
    return out.groupBy(*keys, "i", "j").agg(F.sum(F.col("v") * F.col("si.w") * F.col("sj.w")).alias("v"))


def mean3(sym: DataFrame, keys: list[str], index: DataFrame) -> DataFrame:
    """Mean of the 3 by 3 neighbourhood, zeros outside."""
    out = spread(sym, keys, [(-1, 1.0), (0, 1.0), (1, 1.0)], [(-1, 1.0), (0, 1.0), (1, 1.0)], index, "zero")
    return out.withColumn("v", F.col("v") / 9)


def gauss3(sym: DataFrame, keys: list[str], index: DataFrame) -> DataFrame:
    """Gaussian blur of deviation 1 cut at one bin, edges reflected, then divided by the map's total."""
    side = math.exp(-0.5)
    w = [side / (1 + 2 * side), 1 / (1 + 2 * side)]
    steps = [(-1, w[0]), (0, w[1]), (1, w[0])]
    out = spread(sym, keys, steps, steps, index, "reflect")
    total = out.groupBy(*keys).agg(F.sum("v").alias("__t"))
    return out.join(total, keys).select(*keys, "i", "j", (F.col("v") / F.col("__t")).alias("v"))


def normal_density(x: float) -> float:
    return math.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def row_moving_average(sym: DataFrame, keys: list[str], index: DataFrame, radius: int) -> DataFrame:
    """Row r gets phi(k / radius) of rows r - k and r + k for k up to 2 radius; rows outside are the edge rows."""
    offsets = [(k, normal_density(abs(k) / radius)) for k in range(-2 * radius, 2 * radius + 1)]
    step = F.explode(F.array(*[F.struct(F.lit(d).cast("long").alias("d"), F.lit(w).alias("w")) for d, w in offsets]))
    n, i, r = F.col("n_bins"), F.col("i"), 2 * radius
    # a row feeds its neighbours; an edge row also feeds those that would look beyond the edge
    low = F.greatest(i - r, F.lit(0).cast("long"))
    high = F.least(i + r, n - 1)
    target = F.explode(F.sequence(low, high)).alias("to")
    out = sym.join(F.broadcast(index.select("chrom", "n_bins")), "chrom").select("*", target).select("*", step.alias("s"))
    source = F.greatest(F.least(F.col("to") + F.col("s.d"), n - 1), F.lit(0).cast("long"))
    return out.where(source == i).groupBy(*keys, F.col("to").alias("i"), "j").agg(F.sum(F.col("v") * F.col("s.w")).alias("v"))


def log_rows(sym: DataFrame, keys: list[str]) -> DataFrame:
    """log1p, then rows of absolute sum 1."""
    logged = sym.withColumn("v", F.log1p("v"))
    return logged.withColumn("v", F.col("v") / F.sum(F.abs(F.col("v"))).over(Window.partitionBy(*keys, "i")))


def pool_columns(sym: DataFrame, keys: list[str], factor: int) -> DataFrame:
    """Mean of ``factor`` neighbouring columns of the dense map."""
    return sym.groupBy(*keys, "i", F.floor(F.col("j") / factor).alias("j")).agg((F.sum("v") / factor).alias("v"))


def walk(sym: DataFrame, keys: list[str], index: DataFrame, steps: int, restart: float = 0.5) -> DataFrame:
    """Random walk with restart for a fixed number of steps, as joins and sums.

    The diagonal is emptied, columns without a value get 1 on it, columns are scaled to sum 1; the walk starts at identity.
    """
    off = sym.where("i <> j")
    cells = sym.select(*keys).distinct().join(F.broadcast(index.select("chrom", "n_bins")), "chrom")
    every = cells.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bins") - 1)).alias("j"))
    empty = every.join(off.select(*keys, "j").distinct(), [*keys, "j"], "left_anti").select(*keys, F.col("j").alias("i"), "j", F.lit(1.0).alias("v"))
    p = off.select(*keys, "i", "j", F.col("v").cast("double").alias("v")).unionByName(empty)
    p = p.withColumn("v", F.col("v") / F.sum("v").over(Window.partitionBy(*keys, "j")))
    eye = every.select(*keys, F.col("j").alias("i"), "j", F.lit(1.0).alias("v"))
    q = eye
    for _ in range(steps):
        moved = q.withColumnRenamed("j", "m").withColumnRenamed("v", "w").join(p.withColumnRenamed("i", "m"), [*keys, "m"])
        moved = moved.groupBy(*keys, "i", "j").agg((restart * F.sum(F.col("w") * F.col("v"))).alias("v"))
        q = moved.unionByName(eye.withColumn("v", F.col("v") * (1 - restart))).groupBy(*keys, "i", "j").agg(F.sum("v").alias("v"))
    return q.where("i <> j")


def match_coverage(sym: DataFrame, batches: DataFrame, least: float = 0.8) -> DataFrame:
    """(chrom, batch, correlation, scale): rank correlation of each batch's row sums with the bulk's, over bulk rows with
    values; where it is below ``least``, rows of that batch are to be scaled by bulk over batch."""
    cover = sym.join(batches, "cell_id").groupBy("chrom", "batch", "i").agg(F.sum("v").alias("s"))
    shares = cover.withColumn("s", F.col("s") / F.sum("s").over(Window.partitionBy("chrom", "batch")))
    all_rows = sym.groupBy("chrom", "i").agg(F.sum("v").alias("t"))
    all_rows = all_rows.withColumn("t", F.col("t") / F.sum("t").over(Window.partitionBy("chrom"))).where("t > 0")
    frame = all_rows.join(F.broadcast(cover.select("chrom", "batch").distinct()), "chrom").join(shares, ["chrom", "batch", "i"], "left").fillna(0.0, ["s"])
    ranked = tie_ranked(frame, ["chrom", "batch"], {"rs": "s", "rt": "t"})
    rho = ranked.groupBy("chrom", "batch").agg(F.when(F.stddev_pop("rs") * F.stddev_pop("rt") > 0, F.covar_pop("rs", "rt") / (F.stddev_pop("rs") * F.stddev_pop("rt"))).alias("correlation"))
    scale = F.when(F.col("correlation") < least, F.when(F.col("s") > 0, F.col("t") / F.col("s")).otherwise(F.lit(0.0))).otherwise(F.lit(1.0))
    return frame.join(F.broadcast(rho), ["chrom", "batch"]).select("chrom", "batch", "i", "correlation", scale.alias("scale"))


def bin_features(sym: DataFrame, index: DataFrame) -> DataFrame:
    """(chrom, i, j, v): rows over their sums, then standardised over all cells of the dense maps, empty ones as 0."""
    rows = sym.groupBy("chrom", "i").agg(F.sum("v").alias("s"))
    scaled = sym.join(rows, ["chrom", "i"]).select("chrom", "i", "j", (F.col("v") / F.col("s")).alias("v"))
    n = index.agg(F.sum(F.col("n_bins") * F.col("n_bins")).alias("n"))
    moments = scaled.agg(F.sum("v").alias("x"), F.sum(F.col("v") * F.col("v")).alias("xx")).join(F.broadcast(n))  # a row each
    moments = moments.select((F.col("x") / F.col("n")).alias("m"), F.sqrt(F.col("xx") / F.col("n") - F.pow(F.col("x") / F.col("n"), 2)).alias("s"))
    return scaled.join(F.broadcast(moments)).select("chrom", "i", "j", ((F.col("v") - F.col("m")) / F.col("s")).alias("v"))


def node_attributes(index: DataFrame) -> DataFrame:
    """(chrom, bin, hot, place): one-hot chromosome in the index's order, and the bin's place in its chromosome from 0 to 1."""
    order = index.agg(F.transform(F.array_sort(F.collect_list(F.struct("chrom_idx", "chrom"))), lambda x: x["chrom"]).alias("chroms"))
    sized = index.join(F.broadcast(order)).select("chrom", "n_bins", F.transform("chroms", lambda c: (c == F.col("chrom")).cast("int")).alias("hot"))
    return sized.select("chrom", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bins") - 1)).alias("bin"), "hot", "n_bins").select("chrom", "bin", "hot", (F.col("bin") / F.col("n_bins")).alias("place"))


def cell_covariates(pixels: DataFrame, labels: DataFrame, batch: str = "batch") -> DataFrame:
    """(cell_id, reads, hot): log of 1 + reads, and one-hot batch in the order of the batches' names."""
    reads = pixels.groupBy("cell_id").agg(F.log1p(F.sum("count")).alias("reads"))
    names = labels.select(F.col(batch).alias("b")).distinct().agg(F.array_sort(F.collect_list("b")).alias("names"))
    hot = F.transform("names", lambda b: (b == F.col(batch)).cast("int")).alias("hot")
    return reads.join(labels, "cell_id").join(F.broadcast(names)).select("cell_id", "reads", hot)


def tie_rank(value: str, partition: list[str]) -> Column:
    """Ranks from 1 within groups that fit a task; equal values share their mean rank. ``order.tie_ranked`` has no such limit."""
    among = Window.partitionBy(*partition)
    return F.rank().over(among.orderBy(value)) + (F.count("*").over(Window.partitionBy(*partition, value)) - 1) / F.lit(2.0)
