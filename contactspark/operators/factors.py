"""Factorisations of sparse tables that share rows: a model fitted on some rows and applied to all, cell features, co-assay codes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contactspark.operators.linalg import _orthonormal, _square, _times, sparse_svd
from contactspark.operators.order import place
from contactspark.operators.tables import materialise


def svd_model(rows: DataFrame, k: int, **options) -> DataFrame:
    """(feature, v array<double>): the first k right singular vectors of the sparse table (id, feature, v); 0 where there are fewer."""
    scores = materialise(sparse_svd(rows, k, **options), "svd-scores")
    width = scores.agg(F.max(F.size("v"))).first()[0] or 0
    squares = scores.agg(*[F.sum(F.col("v")[c] * F.col("v")[c]) for c in range(width)]).first() if width else []
    top = max([x or 0.0 for x in squares], default=0.0)
    per = [F.sum(F.col("x") * F.col("s")[c]) / x if (x or 0.0) > 1e-12 * top and top > 0 else F.lit(0.0) for c, x in enumerate(squares)]
    joined = rows.select("id", "feature", F.col("v").cast("double").alias("x")).join(scores.withColumnRenamed("v", "s"), "id")
    return materialise(joined.groupBy("feature").agg(F.array(*per).cast("array<double>").alias("v")), "svd-model")


def folded(rows: DataFrame, model: DataFrame) -> DataFrame:
    """(id, v): scores of the rows of (id, feature, v) on a model's vectors; features that the model doesn't know count nothing."""
    width = model.agg(F.max(F.size("v"))).first()[0] or 0
    joined = rows.select("id", "feature", F.col("v").cast("double").alias("x")).join(model.withColumnRenamed("v", "m"), "feature", "left")
    sums = [F.coalesce(F.sum(F.col("x") * F.col("m")[c]), F.lit(0.0)) for c in range(width)]
    return joined.groupBy("id").agg(F.array(*sums).cast("array<double>").alias("v"))


def feature_size(cells: int, lengths: dict[str, float], features: int, most: int = 2400) -> dict[str, int]:
    """How many components each chromosome gets, from the cells and the chromosomes' lengths in megabases (``lengths``).

    Of several chromosomes: half the cells or half the megabases, whichever is more, but at most 65 % of the cells, dealt by length;
    of a single one 80 % of the smaller of its cells and ``features``. Each has one at least.
    """
    whole = sum(int(v) for v in lengths.values())
    total = min(max(int(cells * 0.5), int(whole * 0.5)), int(cells * 0.65)) if len(lengths) > 1 else int(min(cells, features) * 0.8)
    return {c: int(min(total, most) / max(whole, 1) * int(v)) + 1 for c, v in lengths.items()}


def cell_features(pixels: DataFrame, k: int, quality: DataFrame | None = None, length: float = 1.0, least_cells: int = 5, outlier: float = 10.0) -> DataFrame:
    """(id, v) of each cell: scores of its pixels off the diagonal, then those on it.

    Pixels (cell_id, chrom, bin1, bin2, count) count if more than ``least_cells`` cells, or all cells but two if that is less, have
    them; counts are cut at their mean + ``outlier`` deviations, for each of the two parts; then both parts of a cell together sum to
    ``length``. A part gives ``k`` components, or two less than the smaller part has pixels; a part without pixels gives none.
    ``quality`` (cell_id, good): with more than ten cells that aren't good the vectors are fitted on good cells alone, and all are
    placed by them. Up to three cells get a 1 each at their own place. Cells without pixels that count have zeros.
    """
    table = materialise(pixels.select(F.col("cell_id").alias("id"), (F.col("bin1") != F.col("bin2")).alias("off"), F.concat_ws("-", "chrom", "bin1", "bin2").alias("feature"), F.col("count").cast("double").alias("c")), "feature-pixels")
    ids = table.select("id").distinct()
    n = ids.count()
    if n <= 3:
        return place(ids, [], ["id"], "at").select("id", F.transform(F.sequence(F.lit(0), F.lit(max(n - 1, 0))), lambda i: (i == F.col("at")).cast("double")).alias("v"))
    seen = table.groupBy("off", "feature").agg(F.countDistinct("id").alias("n")).where(F.col("n") > min(least_cells, n - 2))
    kept = table.join(seen.select("off", "feature"), ["off", "feature"], "left_semi")
    parts = {r["off"]: r for r in kept.groupBy("off").agg((F.avg("c") + outlier * F.stddev_pop("c")).alias("top"), F.countDistinct("feature").alias("n")).collect()}  # two rows
    size = min([k, *(r["n"] - 2 for r in parts.values())])
    if not parts or size < 1:
        return ids.select("id", F.array_repeat(F.lit(0.0), 0).alias("v"))
    top = F.when(F.col("off"), F.lit(parts[True]["top"] if True in parts else None)).otherwise(F.lit(parts[False]["top"] if False in parts else None))
    cut = kept.withColumn("c", F.least("c", top))
    scaled = materialise(cut.select("id", "off", "feature", (F.col("c") / F.sum("c").over(Window.partitionBy("id")) * length).alias("v")), "feature-values")
    good = None
    if quality is not None:
        known = ids.join(quality.select(F.col("cell_id").alias("id"), "good"), "id", "left").withColumn("good", F.coalesce("good", F.lit(False)))
        good = known.where("good").select("id") if known.where("NOT good").count() > 10 else None
    out = ids
    for off in sorted(parts, reverse=True):
        rows = scaled.where(F.col("off") == off).select("id", "feature", "v")
        model = svd_model(rows if good is None else rows.join(good, "id", "left_semi"), size)
        out = out.join(folded(rows, model).withColumnRenamed("v", f"v{int(off)}"), "id", "left")
    none = F.array_repeat(F.lit(0.0), size)
    return materialise(out.select("id", F.concat(*[F.coalesce(f"v{int(off)}", none) for off in sorted(parts, reverse=True)]).alias("v")), "cell-features")


class CrossCovariance:
    """Singular vectors of X'Y of two sparse tables (id, feature, v) over the ids that both have, features less their means.

    Neither X'Y nor a dense table is made: a block of directions goes from the features of one table to the ids, loses its mean
    there, and goes on to the features of the other, all by joins and sums. ``left`` and ``right`` (feature, v), ``values``
    descending, and ``codes`` (id, x, y): what each id has on either side. With no more ids than k + ``extra`` the result is exact.
    """

    def __init__(self, x: DataFrame, y: DataFrame, k: int, extra: int = 20, rounds: int = 6) -> None:
        both = materialise(x.select("id").distinct().join(y.select("id").distinct(), "id"), "shared-ids")
        clean = lambda t: materialise(t.where("v IS NOT NULL").select("id", "feature", F.col("v").cast("double").alias("x")).join(both, "id", "left_semi"), "shared-table")
        a, b = clean(x), clean(y)
        width, self.values = k + extra, []

        def at_ids(table: DataFrame, vectors: DataFrame, columns: list[str]) -> tuple[DataFrame, np.ndarray]:
            sums = table.join(vectors, "feature").groupBy("id").agg(*[F.sum(F.col("x") * F.col(c)).alias(c) for c in columns])
            full = materialise(both.join(sums, "id", "left").select("id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in columns]), "shared-scores")
            mean = np.array(full.agg(*[F.avg(c) for c in columns]).first(), float)
            return full.select("id", *[(F.col(c) - float(m)).alias(c) for c, m in zip(columns, mean)]), mean

        def at_features(table: DataFrame, scores: DataFrame, columns: list[str]) -> DataFrame:
            return table.join(scores, "id").groupBy("feature").agg(*[F.sum(F.col("x") * F.col(c)).alias(c) for c in columns])

        names = [f"w{t}" for t in range(width)]
        start = b.select("feature").distinct().select("feature", *[(F.xxhash64("feature", F.lit(t)) / F.lit(float(1 << 63))).alias(c) for t, c in enumerate(names)])
        right, columns = _orthonormal(start, names, False, "feature")
        none = x.sparkSession.createDataFrame([], "feature string, v array<double>")
        for turn in range(rounds):
            if not columns:
                break
            left, columns = _orthonormal(at_features(a, at_ids(b, right, columns)[0], columns), columns, False, "feature")
            if not columns:
                break
            right, columns = _orthonormal(at_features(b, at_ids(a, left, columns)[0], columns), columns, False, "feature")
            if len(columns) < width and turn:  # the directions hold all there is
                break
        if not columns:
            self.left = self.right = none
            self.codes = both.select("id", F.array_repeat(F.lit(0.0), 0).alias("x"), F.array_repeat(F.lit(0.0), 0).alias("y"))
            return
        image = materialise(at_features(a, at_ids(b, right, columns)[0], columns), "shared-image")
        values, turn = np.linalg.eigh(_square(image, columns)[2])
        order = [c for c in np.argsort(-values)[:k] if values[c] > 1e-20 * max(values.max(), 1e-300)]
        zero = np.zeros(len(columns))
        self.values = np.sqrt(values[order])
        right, to = _times(right, columns, zero, turn[:, order], "feature")
        left, _ = _times(image, columns, zero, turn[:, order] / self.values, "feature")
        top = left.agg(*[F.max_by(c, F.struct(F.round(F.abs(F.col(c)), 9), -F.xxhash64("feature"))) for c in to]).first()
        signs = [-1.0 if (v or 0.0) < 0 else 1.0 for v in top]  # the largest entry of each left vector is positive
        vectors = lambda t: t.select("feature", F.array(*[F.col(c) * s for c, s in zip(to, signs)]).alias("v"))
        codes = lambda table, t, name: at_ids(table, t, to)[0].select("id", F.array(*[F.col(c) * s for c, s in zip(to, signs)]).alias(name))
        self.left, self.right = vectors(left), vectors(right)
        self.codes = codes(a, left, "x").join(codes(b, right, "y"), "id")


def standard_signals(signals: DataFrame) -> DataFrame:
    """(id, feature, v) of (cell_id, chrom, bin, signal, value): each signal less its mean over all, over its deviation; a constant
    signal is 0."""
    per = signals.groupBy("signal").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    v = F.when(F.col("s") > 0, (F.col("value") - F.col("m")) / F.col("s")).otherwise(F.lit(0.0))
    return signals.join(per, "signal").select(F.col("cell_id").alias("id"), F.concat_ws("-", "signal", "chrom", "bin").alias("feature"), v.alias("v"))
