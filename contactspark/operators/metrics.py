"""Similarity of maps, quality of scores and labels, losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactspark.operators.maps import grid
from contactspark.operators.norms import tie_rank
from contactspark.operators.order import quantiles, running, tie_ranked


def pearson(x: str, y: str) -> Column:
    """Correlation of two columns; null where one is constant."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread > 0, F.covar_pop(x, y) / spread)


def align(a: DataFrame, b: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(chrom, d, x, y) of two maps (chrom, i, j, v), i <= j. With an index every cell of the upper triangle, empty ones 0."""
    x = a.where("i <= j").select("chrom", "i", "j", F.col("v").cast("double").alias("x"))
    y = b.where("i <= j").select("chrom", "i", "j", F.col("v").cast("double").alias("y"))
    if index is None:
        both = x.join(y, ["chrom", "i", "j"], "full")
    else:
        cells = grid(index).join(F.broadcast(index.select("chrom", "n_bins")), "chrom").select("chrom", F.col("bin").alias("i"), F.explode(F.sequence("bin", F.col("n_bins") - 1)).alias("j"))
        both = cells.join(x, ["chrom", "i", "j"], "left").join(y, ["chrom", "i", "j"], "left")
    return both.select("chrom", "i", "j", (F.col("j") - F.col("i")).alias("d"), F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"))


def flat(aligned: DataFrame) -> DataFrame:
    """(chrom, pearson, spearman) over all aligned cells."""
    ranked = tie_ranked(aligned, ["chrom"], {"rx": "x", "ry": "y"})
    return ranked.groupBy("chrom").agg(pearson("x", "y").alias("pearson"), pearson("rx", "ry").alias("spearman"))


def by_diagonal(aligned: DataFrame, positive_only: bool = False, least: int = 5) -> DataFrame:
    """(chrom, d, pearson, spearman) of each diagonal off the main one; null for constant or short ones."""
    cells = aligned.where("y > 0") if positive_only else aligned
    ranked = cells.where("d > 0").withColumns({"rx": tie_rank("x", ["chrom", "d"]), "ry": tie_rank("y", ["chrom", "d"])})
    usable = (F.count("*") >= least) & (F.stddev_pop("x") > 0) & (F.stddev_pop("y") > 0)
    return ranked.groupBy("chrom", "d").agg(F.when(usable, pearson("x", "y")).alias("pearson"), F.when(usable, pearson("rx", "ry")).alias("spearman"))


def stratum_adjusted(aligned: DataFrame) -> DataFrame:
    """(chrom, scc): correlation of each diagonal weighed by n and both deviations; constant diagonals weigh nothing."""
    s = aligned.groupBy("chrom", "d").agg(F.count("*").alias("n"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"), F.covar_pop("x", "y").alias("c"))
    return s.groupBy("chrom").agg((F.sum(F.col("n") * F.col("c")) / F.sum(F.col("n") * F.col("sx") * F.col("sy"))).alias("scc"))


def stratum_adjusted_stable(aligned: DataFrame) -> DataFrame:
    """(chrom, scc, skipped): diagonals weighed by n times the variance of ranks 1/n to 1, a function of n alone; the main
    diagonal is left out, constant ones are counted as skipped."""
    s = aligned.where("d > 0").groupBy("chrom", "d").agg(F.count("*").alias("n"), pearson("x", "y").alias("r"), ((F.stddev_pop("x") > 0) & (F.stddev_pop("y") > 0)).alias("ok"))
    variance = (F.col("n") + 1) / (12 * F.col("n"))  # sample variance of 1/n, 2/n, ..., 1
    weight = F.when(F.col("ok"), F.col("n") * variance)
    return s.groupBy("chrom").agg((F.sum(weight * F.col("r")) / F.sum(weight)).alias("scc"), F.count(F.when(~F.col("ok"), 1)).alias("skipped"))


def auroc(rows: DataFrame, label: str, score: str) -> DataFrame:
    """(auroc, positives, negatives) from tie-averaged ranks: counts for each score first, so only distinct scores are ordered."""
    by = rows.groupBy(F.col(score).alias("s")).agg(F.sum(label).cast("long").alias("p"), F.count("*").alias("n"))
    wins = running(by, [], ["s"], {"below": F.col("n") - F.col("p")}).withColumn("w", F.col("p") * (F.col("below") + (F.col("n") - F.col("p")) / 2))
    total = wins.agg(F.sum("w").alias("w"), F.sum("p").alias("positives"), F.sum(F.col("n") - F.col("p")).alias("negatives"))
    return total.select((F.col("w") / (F.col("positives") * F.col("negatives"))).alias("auroc"), "positives", "negatives")


def aupr(rows: DataFrame, label: str, score: str) -> DataFrame:
    """Average precision: precision at each distinct score times the recall it adds."""
    by = rows.groupBy(F.col(score).alias("s")).agg(F.sum(label).cast("long").alias("p"), F.count("*").alias("n"))
    steps = running(by, [], [-F.col("s").cast("double")], {"p_before": F.col("p"), "n_before": F.col("n")}).withColumn("precision", (F.col("p_before") + F.col("p")) / (F.col("n_before") + F.col("n")))
    return steps.agg((F.sum(F.col("p") * F.col("precision")) / F.sum("p")).alias("aupr"))


def accuracy(rows: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    return rows.agg(F.avg(((F.col(score) >= threshold).cast("int") == F.col(label)).cast("double")).alias("accuracy"))


def continuous_fit(rows: DataFrame, truth: str, score: str) -> DataFrame:
    """Pearson and Spearman, for labels that are not binary."""
    ranked = tie_ranked(rows, [], {"__truth": truth, "__score": score})
    return ranked.agg(pearson(truth, score).alias("pearson"), pearson("__truth", "__score").alias("spearman"))


def rand_index(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labellings."""
    pairs = lambda n: n * (n - 1) / 2
    table = rows.groupBy(a, b).agg(F.count("*").alias("n"))
    cells = table.agg(F.sum(pairs(F.col("n"))).alias("ij"), F.sum("n").alias("n"))
    one = table.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("i"))
    two = table.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("j"))
    joined = cells.join(F.broadcast(one)).join(F.broadcast(two))
    chance = F.col("i") * F.col("j") / pairs(F.col("n"))
    top = (F.col("i") + F.col("j")) / 2
    return joined.select(F.when(top != chance, (F.col("ij") - chance) / (top - chance)).otherwise(F.lit(1.0)).alias("ari"))


def confusion(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.groupBy(a, b).agg(F.count("*").alias("n"))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def swish(x: Column) -> Column:
    return x * sigmoid(x)


def arcosh_like(x: Column) -> Column:
    """ln(x + sqrt(x^2 + 1)), which is asinh."""
    return F.log(x + F.sqrt(x * x + 1))


def log_cosh(x: Column) -> Column:
    return F.abs(x) + F.log1p(F.exp(-2 * F.abs(x))) - F.log(F.lit(2.0))


def bce_logits(x: Column, y: Column, weight: Column) -> Column:
    return weight * (softplus(x) - x * y)


def losses(rows: DataFrame, label: str, score: str, weight: str) -> DataFrame:
    """Means of the weighted cross-entropy on logits, squared error, log-cosh, x-sigmoid and x-tanh losses."""
    e = F.col(label) - F.col(score)
    return rows.agg(
        F.avg(bce_logits(F.col(score), F.col(label), F.col(weight))).alias("bce"),
        F.avg(e * e).alias("mse"),
        F.avg(log_cosh(e)).alias("log_cosh"),
        F.avg(2 * e * sigmoid(e) - e).alias("x_sigmoid"),
        F.avg(e * F.tanh(e)).alias("x_tanh"),
    )


def rank_loss(rows: DataFrame, truth: str, score: str, block: str) -> DataFrame:
    """Mean softplus of wrongly ordered score differences over ordered pairs within blocks of bounded size."""
    a = rows.select(block, F.col(truth).alias("ta"), F.col(score).alias("sa"))
    b = rows.select(block, F.col(truth).alias("tb"), F.col(score).alias("sb"))
    return a.join(b, block).where("ta > tb").agg(F.avg(softplus(F.col("sb") - F.col("sa"))).alias("rank_loss"), F.count("*").alias("pairs"))


def weight_transform(rows: DataFrame, weight: str, negatives: int) -> DataFrame:
    """log2(w + 1), capped at its 99 % quantile, scaled to a mean of ``negatives``."""
    logged = rows.withColumn(weight, F.log2(F.col(weight) + 1))
    cap = quantiles(logged, weight, [0.99])[0]
    capped = logged.withColumn(weight, F.least(weight, F.lit(cap)))
    mean = capped.agg(F.avg(weight).alias("__m"))
    return capped.join(F.broadcast(mean)).withColumn(weight, F.col(weight) / F.col("__m") * negatives).drop("__m")


def regress_out(rows: DataFrame, value: str, covariate: str, keys: list[str]) -> DataFrame:
    """``value`` minus its least-squares fit on the covariate, for each group of keys."""
    fit = rows.groupBy(*keys).agg(F.regr_slope(value, covariate).alias("__b"), F.regr_intercept(value, covariate).alias("__a"))
    return rows.join(F.broadcast(fit), keys).withColumn(value, F.col(value) - F.coalesce(F.col("__a") + F.col("__b") * F.col(covariate), F.lit(0.0))).drop("__a", "__b")


def clip_scale(rows: DataFrame, value: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Clipped to two quantiles, then to [0, 1]."""
    a, b = quantiles(rows, value, [low, high])
    if a is None or a == b:
        return rows.withColumn(value, F.when(F.col(value).isNotNull(), F.lit(0.0)))
    return rows.withColumn(value, (F.greatest(F.least(value, F.lit(b)), F.lit(a)) - a) / (b - a))
