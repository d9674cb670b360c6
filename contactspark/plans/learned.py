"""Queries over trained models; checked by held-out accuracy and against numpy, as there is nothing to compare with in SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactspark.operators import contacts as C
from contactspark.operators import factors as K
from contactspark.operators import graph as G
from contactspark.operators import linalg as L
from contactspark.operators import maps as M
from contactspark.operators import metrics as Q
from contactspark.operators import neural as H
from contactspark.operators import training as T
from contactspark.operators.tables import materialise
from contactspark.plans import fixtures as X

#: Rounds of each stage (without and with the neighbours' maps), rows of a local step, nearest cells that lend their maps.
ROUNDS, BATCH, NEIGHBOURS = (8, 12), 64, 4


def _global(df: DataFrame, index: DataFrame) -> DataFrame:
    at = F.broadcast(index.select("chrom", "start_bin"))  # a row for each chromosome
    return df.join(at, "chrom").withColumns({"a": F.col("bin1") + F.col("start_bin"), "b": F.col("bin2") + F.col("start_bin")}).drop("start_bin")


def _coverage(features: DataFrame, reads: DataFrame) -> DataFrame:
    """(id, v, coverage): standardised features and log of the reads, standardised."""
    logs = reads.select("id", F.log1p("n").alias("c"))
    mean, spread = logs.agg(F.avg("c"), F.stddev_pop("c")).first()
    cover = logs.select("id", ((F.col("c") - (mean or 0.0)) / float(spread or 1.0)).alias("coverage"))
    return materialise(H.standardised(features).join(cover, "id"), "features")


class Trained:
    """A scorer fitted on 85 % of the hyperedges in two stages, the second with what each cell's nearest cells have there."""

    def __init__(self, spark, d) -> None:
        self.index = X.index(spark)
        pixels = X.pixels(spark, d)
        split = materialise(C.exact_share(C.trainable(pixels), 0.85, ["cell_id", "chrom", "bin1", "bin2"], 5, ["chrom"]), "split")
        train, test, every = split.where("chosen"), split.where("not chosen"), split.drop("chosen")
        n_cells = (split.agg(F.max("cell_id")).first()[0] or 0) + 1
        seen = materialise(_global(train, self.index), "train")
        both = seen.select("cell_id", "chrom", "a", "b", "count").unionByName(seen.select("cell_id", "chrom", F.col("b").alias("a"), F.col("a").alias("b"), "count"))
        rows = both.groupBy(F.col("a").alias("id"), F.concat_ws("-", "chrom", "b").alias("feature")).agg(F.sum("count").alias("v"))
        scores = materialise(K.cell_features(train, 8), "cell-scores")
        self.cells = _coverage(scores, seen.groupBy(F.col("cell_id").alias("id")).agg(F.sum("count").alias("n")))
        place = self.index.select("start_bin", "n_bins", F.explode(F.sequence("start_bin", F.col("end_bin") - 1)).alias("id"))
        bins = place.join(L.sparse_svd(rows, 16), "id", "left").select("id", F.concat(*[F.array(F.coalesce(F.get("v", F.lit(c)), F.lit(0.0))) for c in range(16)], F.array((F.col("id") - F.col("start_bin")) / F.col("n_bins"))).alias("v"))
        reads = place.join(both.groupBy(F.col("a").alias("id")).agg(F.sum("count").alias("n")), "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))
        self.bins = _coverage(bins, reads)
        near = G.kernel_weights(G.nearest(self.cells.select("id", "v"), NEIGHBOURS + 1)).where("id <> nbr").select(F.col("id").alias("cell"), "nbr", "weight")
        self.evidence = materialise(_global(M.neighbour_sum(train.select("cell_id", "chrom", "bin1", "bin2", "count"), near), self.index).select("cell_id", "a", "b", "v"), "evidence")

        draw = lambda rows, seed, ratio: _global(G.near_positive(G.negatives(rows, self.index, 1, n_cells, 20, seed, pair_ratio=ratio), every, reach=0), self.index)
        labelled = lambda df, label, kind, held: df.select("cell_id", "a", "b", F.lit(label).alias("label"), F.lit(kind).alias("kind"), F.lit(held).alias("held"))
        edges = labelled(seen, 1, 0, False).unionByName(labelled(draw(train, 1, 1.0), 0, 1, False)).unionByName(labelled(draw(train, 3, 0.0), 0, 2, False))
        self.test = materialise(labelled(_global(test, self.index), 1, 0, True).unionByName(labelled(draw(test, 2, 0.5), 0, 1, True)), "test-edges")
        # a seeded tenth of the training hyperedges measures when to stop; the test's are never looked at
        edges = edges.withColumn("held", F.pmod(F.xxhash64("cell_id", "a", "b"), F.lit(10)) == 0)
        self.model = H.Scorer(self.cells.agg(F.max(F.size("v"))).first()[0], self.bins.agg(F.max(F.size("v"))).first()[0], 6)
        self.weights, self.history = self.model.start(), []
        first, second = ROUNDS
        for stage, rounds in enumerate(ROUNDS):
            rows = H.featured(edges, self.cells, self.bins, self.evidence if stage else None)
            rows = materialise(rows.repartition("cell_id", "a", "b"), "hyperedges")  # each task with some of every kind

            def pick(a: T.Arrays, turn: int, r: np.random.Generator, before: int = first * stage) -> np.ndarray:
                ratio = 0.5 * min(1.0, (turn + before) / (first + second / 2))  # near negatives come in step by step
                return (a["kind"] == 0) | (r.random(len(a["kind"])) < np.where(a["kind"] == 1, ratio, 1 - ratio))

            self.weights, history = T.train(rows, self.weights, self.model.losses, rounds, kinds=2, rate=0.01, batch=BATCH, held="held", pick=pick, shares=[1.0, 0.1], balance=(1, "cell", 0.2), least=0.001, patience=5, seed=stage)
            self.history += history

    def imputed(self, pairs: DataFrame) -> DataFrame:
        return H.impute(self.model, self.weights, H.featured(pairs, self.cells, self.bins, self.evidence))


def held_out(spark, d):
    """(auroc, positives, negatives) on held-out hyperedges."""
    trained = Trained(spark, d)
    scored = trained.imputed(trained.test.select("cell_id", "a", "b")).dropDuplicates(["cell_id", "a", "b"]).join(trained.test, ["cell_id", "a", "b"])
    return Q.auroc(scored, "label", "p")


def imputed(spark, d):
    """(cell_id, a, b, p): every pair of the band of every cell."""
    trained = Trained(spark, d)
    pairs = X.pixels(spark, d).select("cell_id").distinct().crossJoin(F.broadcast(M.bin_pairs(trained.index, 1, 11)))
    return trained.imputed(_global(pairs, trained.index))


def _embeddings(spark, d) -> DataFrame:
    rows = X.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return materialise(H.standardised(rows), "autoencoder-rows")


def tied_codes(spark, d):
    """(id, v, error): codes of 8 numbers of the embeddings, by layers of 32 and 8 that begin as principal components."""
    rows = _embeddings(spark, d)
    model = H.TiedAutoEncoder([rows.agg(F.max(F.size("v"))).first()[0], 32, 8])
    weights, _ = T.train(rows, model.start(axes=L.principal_axes(rows, 32)[1]), model.losses, 40, rate=0.003, batch=64, least=0.01, patience=10)
    return model.encoded(rows, weights)


def balanced_losses(spark, d):
    """(round, main, rebuilt, share, agreement): gradient norms of two losses over the cells' layer, and how far the weighted ones
    are from each other, for each round of training with balance."""
    trained = Trained(spark, d)
    rows = [(i, r.norms[0], r.norms[1], r.shares[1], r.shares[1] * r.norms[1] / (0.2 * r.norms[0])) for i, r in enumerate(trained.history)]
    return spark.createDataFrame(rows, "round int, main double, rebuilt double, share double, agreement double")


QUERIES = {"h3_held_out_auroc": held_out, "h9_imputed_pairs": imputed, "h1_tied_codes": tied_codes, "h8_balanced_losses": balanced_losses}
ORACLE: dict[str, str] = {}
