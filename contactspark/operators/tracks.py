"""One-dimensional features: insulation, boundaries, scores along bins, sequence composition."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactspark.operators.maps import grid
from contactspark.operators.order import place, tie_ranked


def insulation(sym: DataFrame, keys: list[str], index: DataFrame, window: int) -> DataFrame:
    """(keys, bin, score): contacts across each bin over all contacts of its box; 1 where the box is empty.

    Each pixel is spread to the bins it counts for, so no self join is needed. Across means above the diagonal from the
    ``window`` bins before to the ``window`` after; the last column of the map never counts as across.
    """
    n, i, j = F.col("n_bins"), F.col("i"), F.col("j")
    zero = F.lit(0).cast("long")
    sized = sym.join(F.broadcast(index.select("chrom", "n_bins")), "chrom")
    a, b = F.greatest(i + 1, j - window), F.least(j - 1, i + window)
    across = sized.where((i < j) & (j < n - 1) & (a <= b)).select(*keys, F.explode(F.sequence(a, b)).alias("bin"), F.col("v").alias("x"), F.lit(0).alias("y"))
    c, e = F.greatest(F.greatest(i, j) - window, zero), F.least(F.least(i, j) + window, n - 1)
    inside = sized.where(c <= e).select(*keys, F.explode(F.sequence(c, e)).alias("bin"), F.lit(0).alias("x"), F.col("v").alias("y"))
    sums = across.unionByName(inside).groupBy(*keys, "bin").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    every = sym.select(*keys).distinct().join(F.broadcast(grid(index)), "chrom")
    score = F.when(F.col("y") > 0, F.col("x") / F.col("y")).otherwise(F.lit(1.0))
    return every.join(sums, [*keys, "bin"], "left").select(*keys, "bin", score.alias("score"))


def local_minima(scores: DataFrame, keys: list[str], order: int) -> DataFrame:
    """Column ``boundary``: strictly below ``order`` bins on both sides, never at the very edge, and 0 < score < 0.999."""
    along = Window.partitionBy(*keys).orderBy("bin")
    left = F.min("score").over(along.rowsBetween(-order, -1))
    right = F.min("score").over(along.rowsBetween(1, order))
    s = F.col("score")
    return scores.withColumn("boundary", F.coalesce((s < left) & (s < right) & (s > 0) & (s < 0.999), F.lit(False)))


def reliable_rows(sym: DataFrame, keys: list[str], index: DataFrame, share: float = 0.01) -> DataFrame:
    """(keys, bin, reliable): rows whose sum is over ``share`` of the mean row sum of the dense map."""
    rows = sym.groupBy(*keys, F.col("i").alias("bin")).agg(F.sum("v").alias("s"))
    total = F.sum("s").over(Window.partitionBy(*keys))
    return rows.join(F.broadcast(index.select("chrom", "n_bins")), "chrom").select(*keys, "bin", (F.col("s") > share * total / F.col("n_bins")).alias("reliable"))


def cumulative(scores: DataFrame, keys: list[str]) -> DataFrame:
    return scores.withColumn("cum", F.sum("score").over(Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))


def score_distance(scores: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b, distance): |cum(a) - cum(b) - (a - b) * least score between, both ends included|."""
    packed = cumulative(scores, keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bin", "score", "cum"))).alias("t"))  # a row of bins for each track
    at = lambda c, f: F.element_at(F.col("t"), (F.col(c) + 1).cast("int"))[f]
    low, high = F.least("a", "b"), F.greatest("a", "b")
    least = F.array_min(F.transform(F.slice("t", (low + 1).cast("int"), (high - low + 1).cast("int")), lambda x: x["score"]))
    distance = F.abs(at("a", "cum") - at("b", "cum") - (F.col("a") - F.col("b")) * least)
    return pairs.join(packed, keys).select(*keys, "a", "b", distance.alias("distance"))


def nearest_shared(own: DataFrame, shared: DataFrame, scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bin, shared, distance): each boundary's nearest shared one, left or right, by score distance; left at a tie."""
    marks = own.select(*keys, "bin", F.lit(None).cast("long").alias("s")).unionByName(own.select(*keys).distinct().join(shared, "chrom").select(*keys, "bin", F.col("bin").alias("s")))
    along = Window.partitionBy(*keys).orderBy("bin")
    left = F.last("s", ignorenulls=True).over(along.rangeBetween(Window.unboundedPreceding, 0))
    right = F.first("s", ignorenulls=True).over(along.rangeBetween(0, Window.unboundedFollowing))
    near = marks.withColumns({"l": left, "r": right}).where("s is null").select(*keys, F.col("bin").alias("a"), F.explode(F.array_distinct(F.filter(F.array("l", "r"), lambda x: x.isNotNull()))).alias("b"))
    ranked = score_distance(scores, near, keys).withColumn("k", F.row_number().over(Window.partitionBy(*keys, "a").orderBy("distance", "b")))
    return ranked.where("k = 1").select(*keys, F.col("a").alias("bin"), F.col("b").alias("shared"), "distance")


def boundary_gaps(boundaries: DataFrame, keys: list[str], least: int = 1) -> DataFrame:
    """Gap to the boundary before; ``close`` marks the right one of two that are at most ``least`` apart."""
    gap = F.col("bin") - F.lag("bin").over(Window.partitionBy(*keys).orderBy("bin"))
    return boundaries.withColumn("gap", gap).withColumn("close", F.coalesce(F.col("gap") <= least, F.lit(False)))


def z_score(tracks: DataFrame, keys: list[str], value: str) -> DataFrame:
    among = Window.partitionBy(*keys)
    sd = F.stddev_pop(value).over(among)
    return tracks.withColumn(value, F.when(sd > 0, (F.col(value) - F.avg(value).over(among)) / sd).otherwise(F.lit(0.0)))


def quantile_ranks(tracks: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Uniform quantile transform with as many quantiles as values: mean of the lowest and highest place of ties, in [0, 1]."""
    count = tracks.groupBy(*keys).agg(F.count("*").alias("__n"))
    ranked = tie_ranked(tracks, keys, {"__r": value}).join(count, keys)  # a row for each group
    return ranked.withColumn(value, F.when(F.col("__n") > 1, (F.col("__r") - 1) / (F.col("__n") - 1)).otherwise(F.lit(0.0))).drop("__r", "__n")


def rank_match(source: DataFrame, target: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``source`` with its values replaced by the target's values of the same rank (keys, bin, value)."""
    ranked = lambda df: place(df, keys, [value, "bin"], "__r")
    return ranked(source).drop(value).join(ranked(target).select(*keys, "__r", value), [*keys, "__r"]).drop("__r")


def merge_close(boundaries: DataFrame, keys: list[str], reach: int = 4) -> DataFrame:
    """Boundaries (keys, bin, n) without those that a neighbour within ``reach`` bins outweighs: more members win, the left one
    at a tie."""
    w = Window.partitionBy(*keys).orderBy("bin")
    right = (F.lead("bin").over(w) - F.col("bin") <= reach) & (F.lead("n").over(w) > F.col("n"))
    left = (F.col("bin") - F.lag("bin").over(w) <= reach) & (F.lag("n").over(w) >= F.col("n"))
    return boundaries.withColumn("gone", F.coalesce(right, F.lit(False)) | F.coalesce(left, F.lit(False))).where("not gone").select(*keys, "bin")


def orientation(track: DataFrame, calibration: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, high, low, sign): -1 where the calibration is lower over the top tenth of the track than over the bottom tenth."""
    joined = track.join(calibration, ["chrom", "bin"])
    cut = joined.groupBy(*keys).agg(F.percentile(value, F.lit(0.9)).alias("__top"), F.percentile(value, F.lit(0.1)).alias("__low"))
    joined = joined.join(F.broadcast(cut), keys)
    out = joined.groupBy(*keys).agg(F.avg(F.when(F.col(value) > F.col("__top"), F.col("cal"))).alias("high"), F.avg(F.when(F.col(value) < F.col("__low"), F.col("cal"))).alias("low"))
    return out.withColumn("sign", F.when(F.col("high") < F.col("low"), -1).otherwise(1))


def smooth(track: DataFrame, keys: list[str], value: str, length: int, window: str = "hanning") -> DataFrame:
    """(keys, place, value): moving window over the track with reflected ends; n + length - 1 places from 0."""
    shapes = {
        "flat": lambda k: 1.0,
        "hanning": lambda k: 0.5 - 0.5 * math.cos(2 * math.pi * k / (length - 1)),
        "hamming": lambda k: 0.54 - 0.46 * math.cos(2 * math.pi * k / (length - 1)),
        "bartlett": lambda k: 1 - abs(2 * k / (length - 1) - 1),
        "blackman": lambda k: 0.42 - 0.5 * math.cos(2 * math.pi * k / (length - 1)) + 0.08 * math.cos(4 * math.pi * k / (length - 1)),
    }
    weights = [shapes[window](k) for k in range(length)]
    total = sum(weights)
    steps = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w / total).alias("w")) for k, w in enumerate(weights)])
    n = F.count("*").over(Window.partitionBy(*keys))
    placed = track.withColumn("__n", n)
    # the reflected track starts length - 1 places before the first value and ends length - 1 after the last
    here = F.array(F.col("bin") + (length - 1), (length - 1) - F.col("bin"), 2 * F.col("__n") - F.col("bin") + (length - 3))
    inside = lambda p, k: F.when(k == 0, F.lit(True)).when(k == 1, (F.col("bin") >= 1) & (F.col("bin") <= length - 1)).otherwise((F.col("bin") <= F.col("__n") - 2) & (F.col("bin") >= F.col("__n") - length))
    padded = placed.select(*keys, value, "__n", F.explode(F.filter(here, inside)).alias("p"))
    out = padded.select(*keys, value, "__n", "p", F.explode(steps).alias("s")).withColumn("place", F.col("p") - (length - 1) + F.col("s.k"))
    return out.where((F.col("place") >= 0) & (F.col("place") < F.col("__n") + length - 1)).groupBy(*keys, "place").agg(F.sum(F.col(value) * F.col("s.w")).alias(value))


def cpg_rate(sequence: Column) -> Column:
    """CG pairs over the pairs that could be: n - 1 without those that an N touches; 0 if there are none."""
    s = F.upper(sequence)
    n, unknown = F.length(s), F.length(s) - F.length(F.replace(s, F.lit("N"), F.lit("")))
    cg = (F.length(s) - F.length(F.replace(s, F.lit("CG"), F.lit("")))) / 2
    double = F.regexp_count(s, F.lit("N(?=N)"))
    edge = F.when(F.substring(s, 1, 1) == "N", 1).when(F.substring(s, -1, 1) == "N", 1).otherwise(0)
    pairs = n - 1 - 2 * unknown + double + edge
    return F.when(pairs > 0, cg / pairs).otherwise(F.lit(0.0))


def cpg_windows(genome: DataFrame, window: int, keep_tail: bool = False) -> DataFrame:
    """(chrom, start, end, rate) of each window; the last, shorter one only on request.

    ``genome`` holds whole sequences (chrom, sequence) or pieces of them (chrom, offset, sequence), as ``readers.fasta``
    gives. Each piece is cut at the windows' borders once, from left to right, and windows are put together from their cuts,
    so no sequence is copied or held whole.
    """
    pieces = genome if "offset" in genome.columns else genome.withColumn("offset", F.lit(0).cast("long"))
    size = pieces.groupBy("chrom").agg(F.max(F.col("offset") + F.length("sequence")).alias("size"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chrom, offset, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                borders = [0, *range(window - offset % window, len(text), window), len(text)]
                for at in range(0, len(borders) - 1, 4096):
                    low, high = borders[at : at + 4096], borders[at + 1 : at + 4097]
                    yield pa.RecordBatch.from_pydict({"chrom": [chrom] * len(high), "w": [(offset + a) // window for a in low[: len(high)]], "at": [offset + a for a in low[: len(high)]], "part": [text[a:b] for a, b in zip(low, high)]})

    cuts = pieces.where(F.length("sequence") > 0).select("chrom", "offset", "sequence").mapInArrow(cut, "chrom string, w long, at long, part string")
    joined = cuts.groupBy("chrom", "w").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]), "").alias("s"))
    start = F.col("w") * window
    out = joined.join(F.broadcast(size), "chrom").select("chrom", start.alias("start"), F.least(start + window, "size").alias("end"), cpg_rate(F.col("s")).alias("rate"))
    return out if keep_tail else out.where(F.col("end") - F.col("start") == window)
