"""Neighbours in embedding space, negative sampling, sparse products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactspark.operators import grid
from contactspark.operators.grid import Rows
from contactspark.operators.order import place, quantiles
from contactspark.operators.tables import materialise


#: Blocks of rows up to which all pairs meet; the id of no row.
FEW_BLOCKS, NOBODY = 4, np.iinfo(np.int64).max


class Nearest:
    """Fold of the ``k`` nearest rows of each group of the others: products find candidates, differences decide, ties go to itself
    and then to the smaller id."""

    def __init__(self, k: int, metric: str) -> None:
        self.k, self.metric = k, metric

    def start(self, x: Rows) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        return {}

    def meet(self, x: Rows, y: Rows, state: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        own, q, _ = x
        own_norms = (q**2).sum(axis=1)
        for g in np.unique(y[2]).tolist():
            some = slice(None) if (y[2] == g).all() else y[2] == g
            ids, v = y[0][some], y[1][some]
            if g not in state:
                state[g] = np.full((len(own), self.k), np.inf), np.full((len(own), self.k), NOBODY)
            far, who = state[g]
            known, norms, turned = bool(np.intersect1d(own, ids).size), (v**2).sum(axis=1), -2 * v.T
            for at in range(0, len(own), 256):
                mine, z, a, d, n = (part[at : at + 256] for part in (own, q, own_norms, far, who))
                if self.metric == "cosine":
                    rough = 1 - z @ v.T / np.maximum(np.sqrt(a)[:, None] * np.sqrt(norms), 1e-300)
                    slack, most = np.full(len(z), 1e-9), d[:, -1] + 1e-9
                else:
                    rough = z @ turned
                    rough += norms
                    slack = 1e-9 * (a + norms.max(initial=0.0)) + 1e-300
                    most = d[:, -1] ** 2 + slack - a
                exact = rough.copy() if self.metric == "cosine" else None
                if known:
                    rough[mine[:, None] == ids] = -np.inf
                if len(ids) > self.k and np.isinf(most).any():
                    most = np.minimum(most, np.partition(rough, self.k - 1, axis=1)[:, self.k - 1] + 2 * slack)
                i, j = np.nonzero(rough <= most[:, None])
                if not len(i):
                    continue
                new = exact[i, j] if self.metric == "cosine" else np.sqrt(((z[i] - v[j]) ** 2).sum(axis=1))
                new = np.where(mine[i] == ids[j], 0.0, new)
                rows, i = np.unique(i, return_inverse=True)
                i = np.concatenate([np.repeat(np.arange(len(rows)), self.k), i])
                new, j = np.concatenate([d[rows].ravel(), new]), np.concatenate([n[rows].ravel(), ids[j]])
                best = np.lexsort((j, j != mine[rows][i], new, i))
                take = best[np.searchsorted(i[best], np.arange(len(rows)))[:, None] + np.arange(self.k)]
                d[rows], n[rows] = new[take], j[take]

    def rows(self, x: Rows, state: dict[int, tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        found = [(np.repeat(x[0], self.k), who.ravel(), far.ravel(), np.full(who.size, g)) for g, (far, who) in state.items()]
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, t) for t in (int, int, float, int)]
        return [c[columns[1] != NOBODY] for c in columns]


class Everyone:
    """Fold of all distances, which go out as they are found."""

    def start(self, x: Rows) -> None:
        return None

    def meet(self, x: Rows, y: Rows, state: None) -> list[np.ndarray]:
        d = np.concatenate([np.sqrt(((x[1][at : at + 64, None] - y[1]) ** 2).sum(axis=2)) for at in range(0, len(x[0]), 64)])
        d[x[0][:, None] == y[0]] = 0.0
        return [np.repeat(x[0], len(y[0])), np.tile(y[0], len(x[0])), d.ravel(), np.tile(y[2], len(x[0]))]

    def rows(self, x: Rows, state: None) -> list[np.ndarray]:
        return [np.zeros(0, t) for t in (int, int, float, int)]


def nearest(rows: DataFrame, k: int, id_col: str = "id", vector_col: str = "v", group_col: str | None = None, metric: str = "euclidean") -> DataFrame:
    """(id, nbr, distance): the k nearest rows of each, itself at distance 0 included; ties to the smaller id.

    ``group_col``: k for each group of the neighbours. Blocks of rows go past groups of others, which keep
    their best k so far; a matrix product finds what can be among them and exact differences decide. Of larger tables without
    groups each block first meets those beside it, then only those that can hold a nearer row, by distances to a few pivots.
    """
    group = F.dense_rank().over(Window.orderBy("name")).cast("long").alias("g")
    names = rows.select(F.col(group_col).cast("string").alias("name")).distinct().select("name", group) if group_col else None
    table = rows.select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: x.cast("double")).alias("v"), *([F.col(group_col).cast("string").alias("name")] if group_col else [F.lit(0).cast("long").alias("g")]))
    if group_col:
        table = table.join(F.broadcast(names.withColumnRenamed("name", "__group")), F.col("name").eqNullSafe(F.col("__group"))).select("id", "v", "g")  # a row for each group

    schema, fold = "id long, nbr long, distance double, g long", Nearest(k, metric)
    if not group_col and metric == "euclidean" and k >= table.count():
        blocks = grid.packed(table)
        return grid.sweep(blocks, blocks, Everyone(), schema).select("id", "nbr", "distance")
    if group_col or metric == "cosine" or table.count() <= FEW_BLOCKS * grid.BLOCK:
        blocks = grid.packed(table)
        out = grid.sweep(blocks, blocks, fold, schema)
    else:
        # rows near by first; a block's reach is then the largest distance to a k-th neighbour that its rows have so far
        rings = grid.Rings(table)
        first = grid.sweep(rings.blocks, rings.blocks, fold, schema, rings.beside())
        enough = F.when(F.count("*") >= k, F.get(F.sort_array(F.collect_list("distance")), F.lit(k - 1))).otherwise(F.lit(float("inf")))
        reach = first.groupBy("id").agg(enough.alias("d")).join(rings.homes, "id").groupBy("block").agg(F.max("d").alias("d"))
        pairs = rings.within({r["block"]: r["d"] for r in reach.collect()})  # a number for each block
        out = grid.sweep(rings.blocks, rings.blocks, fold, schema, rings.beside().unionByName(pairs))
    best = Window.partitionBy("id", "g").orderBy("distance", (F.col("nbr") != F.col("id")).cast("int"), "nbr")
    ranked = out.withColumn("k", F.row_number().over(best)).where(F.col("k") <= k)
    if group_col:
        ranked = ranked.join(F.broadcast(names.withColumnRenamed("name", "nbr_group")), "g")
    return ranked.select("id", "nbr", "distance", *(["nbr_group"] if group_col else []))


#: Rows of a task, and distances that it holds at a time.
TASK_ROWS, HELD = 1024, 4 << 20


def all_weights(rows: DataFrame, share: float = 0.25, digits: int = 6) -> DataFrame:
    """(id, nbr, weight): exp(-distance / q) over its sum for all rows, itself included, to ``digits`` digits; q is the quantile ``share`` of the
    id's distances. ``rows`` (id, v); rows with a null id, vector or component take no part.

    A task weighs some ids, few at a time, against the vectors of all rows, 8 bytes a number and row, so no pair is dealt or sorted:
    what is sent is the table once for each ``TASK_ROWS`` rows. Pairs go out by their neighbour, so that files stay small.
    """
    table = rows.select(F.col("id").cast("long").alias("id"), F.transform("v", lambda x: x.cast("double")).alias("v"), F.lit(0).cast("long").alias("g"))
    blocks = grid.packed(table)
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-(blocks.agg(F.sum("n")).first()[0] or 0) // TASK_ROWS))
    # rows that repeat an id share a quantile and a sum
    own = grid.packed(table.withColumn("task", F.pmod(F.xxhash64("id"), F.lit(tasks)).cast("int")), "task").withColumnRenamed("block", "task")
    sent = blocks.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    names = ["task", "kind", "n", "width", "ids", "v", "g"]
    both = sent.withColumn("kind", F.lit(0)).select(*names).unionByName(own.withColumns({"kind": F.lit(1), "task": F.col("task").cast("int")}).select(*names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, own = [], None
        for batch in batches:
            kinds, n, width = (batch.column(k).to_pylist() for k in range(3))
            for row in range(batch.num_rows):
                x = grid._unpacked(n[row], width[row], *(batch.column(k)[row].as_buffer() for k in range(3, 6)))
                if kinds[row]:
                    own = x
                else:
                    seen.append((x[0], x[1].T))
        if own is None:
            return
        others, v = (np.concatenate(c, axis=-1) for c in zip(*seen))
        del seen
        ids, first, counts = np.unique(own[0], return_index=True, return_counts=True)
        order = np.argsort(own[0], kind="stable")
        starts = np.cumsum(counts) - counts
        for times in np.unique(counts).tolist():
            some = np.flatnonzero(counts == times)
            step = max(1, HELD // (times * len(others)))
            for at in range(0, len(some), step):
                part = some[at : at + step]
                a = own[1][order[starts[part][:, None] + np.arange(times)].ravel()]
                w = _weights(_distances(a, v).reshape(len(part), -1), share, digits).reshape(len(a), -1)
                named = np.repeat(ids[part], times)
                wide = max(1, (1 << 17) // len(a))
                for low in range(0, len(others), wide):
                    out = w[:, low : low + wide]
                    yield pa.RecordBatch.from_arrays([pa.array(np.tile(named, out.shape[1])), pa.array(np.repeat(others[low : low + wide], len(a))), pa.array(out.T.ravel())], ["id", "nbr", "weight"])

    both = both.repartitionById(tasks, "task").sortWithinPartitions("kind").drop("task")
    return both.mapInArrow(run, "id long, nbr long, weight double")


def _distances(a: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Of rows ``a`` to the columns of ``v``, by differences; some columns at a time, which stay in a core's cache."""
    d = np.zeros((len(a), v.shape[1]))
    step = max(256, (1 << 14) // len(a))
    for low in range(0, v.shape[1], step):
        total = np.zeros((len(a), min(step, v.shape[1] - low)))
        gap = np.empty_like(total)
        for x, y in zip(a.T, v[:, low : low + step]):
            np.subtract(x[:, None], y, out=gap)
            gap *= gap
            total += gap
        np.sqrt(total, out=d[:, low : low + step])
    return d


def _weights(d: np.ndarray, share: float, digits: int) -> np.ndarray:
    """Of each row's distances, which are lost; a quantile of 0 gives no numbers, as its quotients are none."""
    place = share * (d.shape[1] - 1)
    low, high = int(np.floor(place)), int(np.ceil(place))
    ends = np.partition(d, sorted({low, high}), axis=1)
    q = ends[:, low] + (ends[:, high] - ends[:, low]) * (place - low)
    del ends
    with np.errstate(divide="ignore", invalid="ignore"):
        d /= -q[:, None]
        np.exp(d, out=d)
        d /= d.sum(axis=1, keepdims=True)
    d *= 10.0**digits
    down = np.floor(d)
    d -= down
    down += d >= 0.5
    down[np.isnan(d)] = np.nan
    down /= 10.0**digits
    return down


def kernel_weights(neighbours: DataFrame) -> DataFrame:
    """(id, nbr, rank, weight): exp(-distance / q25) over the neighbours' sum; q25 is the lower quartile of all distances but
    those to oneself."""
    neighbours = materialise(neighbours, "neighbours")
    q = quantiles(neighbours.where("id <> nbr"), "distance", [0.25])[0]
    w = F.exp(-F.col("distance") / F.lit(q))
    among = Window.partitionBy("id")
    rank = F.row_number().over(among.orderBy("distance", (F.col("nbr") != F.col("id")).cast("int"), "nbr"))
    return neighbours.select("id", "nbr", rank.alias("rank"), (w / F.sum(w).over(among)).alias("weight"))


def balanced_weights(rows: DataFrame, k: int, batch_col: str, id_col: str = "id", vector_col: str = "v") -> DataFrame:
    """(id, nbr, weight): itself, and as many from each other batch as makes about k - 1 in all.

    Distances are divided by their mean over the pair of row and batch, cut to k by a seeded order, then weighed by exp(-d).
    """
    batches = rows.select(batch_col).distinct().count()
    each = -(-(k - 1) // max(1, batches - 1))
    near = nearest(rows, max(each, 1), id_col, vector_col, batch_col)
    own = rows.select(F.col(id_col).alias("id"), F.col(batch_col).cast("string").alias("own"))
    near = near.join(own, "id").withColumn("r", F.row_number().over(Window.partitionBy("id", "nbr_group").orderBy("distance", "nbr")))
    near = near.where((F.col("own") != F.col("nbr_group")) | (F.col("id") == F.col("nbr")))
    mean = F.avg("distance").over(Window.partitionBy("id", "nbr_group"))
    near = near.withColumn("d", F.when(mean > 0, F.col("distance") / mean).otherwise(F.lit(0.0)))
    order = F.md5(F.concat_ws(":", F.lit("balance"), "id", "nbr").cast("binary"))
    cut = near.withColumn("o", F.row_number().over(Window.partitionBy("id").orderBy((F.col("id") != F.col("nbr")).cast("int"), order, "nbr"))).where(F.col("o") <= k)
    w = F.exp(-F.col("d"))
    return cut.select("id", "nbr", (w / F.sum(w).over(Window.partitionBy("id"))).alias("weight"))


def surroundings(positives: DataFrame, reach: int = 1, n_bins: int | None = None) -> DataFrame:
    """(cell_id, chrom, bin1, bin2) of the ``reach`` neighbourhood of positives, once each.

    With ``n_bins`` the neighbourhood ends before the last bin, as a slice with an exclusive upper end does.
    """
    step = F.sequence(F.lit(-reach), F.lit(reach))
    around = positives.select("cell_id", "chrom", "bin1", "bin2", F.explode(step).alias("x")).select("*", F.explode(step).alias("y"))
    if n_bins is not None:
        around = around.where((F.col("bin1") < n_bins - 1) & (F.col("bin2") < n_bins - 1))
    return around.select("cell_id", "chrom", (F.col("bin1") + F.col("x")).alias("bin1"), (F.col("bin2") + F.col("y")).alias("bin2")).distinct()


def near_positive(candidates: DataFrame, positives: DataFrame, reach: int = 1, n_bins: int | None = None) -> DataFrame:
    """Candidates (cell_id, chrom, bin1, bin2) without a positive in the ``reach`` neighbourhood, as an anti join on offsets."""
    return candidates.join(surroundings(positives, reach, n_bins), ["cell_id", "chrom", "bin1", "bin2"], "left_anti")


def _uniform(*parts: Column) -> Column:
    """A seeded number in [0, 1) that any engine with md5 reproduces."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def negatives(positives: DataFrame, index: DataFrame, per: int, n_cells: int, max_gap: int, seed: int = 0, tries: int = 50, pair_ratio: float = 0.5) -> DataFrame:
    """(cell_id, chrom, bin1, bin2, t_cell, t_bin1, t_bin2): ``per`` pixels near each positive that no positive touches.

    A share ``pair_ratio`` changes one of cell, bin1, bin2; the rest draws both bins anew. Gaps must be over 1 and under
    ``max_gap``. Draws are hashes of the positive and the try, so they are the same on every run; the first that pass count.
    Few tries are drawn first and more only for positives that still lack; one whose ``per * tries`` draws are used up gets
    fewer rows, or none, as its surroundings are full.
    """
    target = ["t_cell", "chrom", "t_bin1", "t_bin2"]
    parts = ("mode", "which", "cell", "first", "second")
    key = lambda t: F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in ("cell_id", "chrom", "bin1", "bin2")], t.cast("string")).cast("binary"))
    number = lambda h, i: F.conv(F.substring(h, 1 + 6 * i, 6), 16, 10).cast("long") / F.lit(float(1 << 24))

    def drawn(some: DataFrame, low: int, high: int) -> DataFrame:
        # numbers are made inside the array, once for each try; filters would else repeat the hash wherever they name them
        hashes = F.transform(F.sequence(F.lit(low), F.lit(high - 1)), lambda t: F.struct(t.alias("t"), key(t).alias("h")))
        tries = F.transform(hashes, lambda x: F.struct(x["t"].alias("t"), *[number(x["h"], i).alias(p) for i, p in enumerate(parts)]))
        trial = some.select("cell_id", "chrom", "bin1", "bin2", F.explode(tries).alias("d")).select("cell_id", "chrom", "bin1", "bin2", "d.*").join(F.broadcast(index.select("chrom", "n_bins")), "chrom")
        one, which = F.col("mode") < pair_ratio, F.floor(F.col("which") * 3)
        a = F.when(~one | (which == 1), F.floor(F.col("first") * F.col("n_bins"))).otherwise(F.col("bin1"))
        b = F.when(~one | (which == 2), F.floor(F.col("second") * F.col("n_bins"))).otherwise(F.col("bin2"))
        cell = F.when(one & (which == 0), F.floor(F.col("cell") * n_cells)).otherwise(F.col("cell_id"))
        trial = trial.select(F.col("bin1").alias("t_bin1"), F.col("bin2").alias("t_bin2"), F.col("cell_id").alias("t_cell"), "t", "chrom", cell.alias("cell_id"), F.least(a, b).alias("bin1"), F.greatest(a, b).alias("bin2"))
        return trial.where((F.col("bin2") - F.col("bin1") > 1) & (F.col("bin2") - F.col("bin1") < max_gap)).join(around, ["cell_id", "chrom", "bin1", "bin2"], "left_anti")

    positives = materialise(positives.select("cell_id", "chrom", "bin1", "bin2"), "positives")
    around = materialise(surroundings(positives), "surroundings")
    kept, lacking, low = None, positives, 0
    for high in sorted({min(tries, n) * per for n in (2, 4, 8, 16, 32, tries)}):
        found = drawn(lacking, low, high)
        kept = materialise(found if kept is None else kept.unionByName(found), "negatives")
        low = high
        if high < tries * per:
            full = kept.groupBy(*target).agg(F.count("*").alias("n")).where(F.col("n") >= per).select(F.col("t_cell").alias("cell_id"), "chrom", F.col("t_bin1").alias("bin1"), F.col("t_bin2").alias("bin2"))
            lacking = materialise(positives.select("cell_id", "chrom", "bin1", "bin2").join(full, ["cell_id", "chrom", "bin1", "bin2"], "left_anti"), "lacking")
    rank = F.row_number().over(Window.partitionBy(*target).orderBy("t"))
    return kept.withColumn("r", rank).where(F.col("r") <= per).select("cell_id", "chrom", "bin1", "bin2", "t_cell", "t_bin1", "t_bin2")


def stencil(bins: DataFrame) -> DataFrame:
    """Each (i, j) of each chromosome with itself and its four neighbours."""
    cross = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))])
    return bins.select("chrom", "i", "j", F.explode(cross).alias("o")).select("chrom", "i", "j", (F.col("i") + F.col("o.x")).alias("ni"), (F.col("j") + F.col("o.y")).alias("nj"))


def masked_keys(triplets: DataFrame) -> DataFrame:
    """Three keys for each (cell_id, bin1, bin2), each with one place masked by -1: for membership tests with a wildcard."""
    row = [F.col(c) for c in ("cell_id", "bin1", "bin2")]
    keys = F.array(*[F.array(*[F.lit(-1).cast("long") if i == m else c.cast("long") for i, c in enumerate(row)]) for m in range(3)])
    return triplets.select(F.explode(keys).alias("k")).select(*[F.col("k")[i].alias(c) for i, c in enumerate(("cell_id", "bin1", "bin2"))]).distinct()


def holds_pair(rows: DataFrame, triplets: DataFrame) -> DataFrame:
    """``rows`` (cell_id, bin1, bin2, any of them -1 as a wildcard) with ``held``: whether a triplet fits."""
    keys = ["cell_id", "bin1", "bin2"]
    whole = triplets.select(*keys).distinct()
    known = whole.unionByName(masked_keys(triplets)).withColumn("__held", F.lit(True))
    return rows.join(known, keys, "left").withColumn("held", F.coalesce("__held", F.lit(False))).drop("__held")


def mini_batches(rows: DataFrame, keys: list[str], size: int, seed: int) -> DataFrame:
    """Column ``batch``: seeded order within each chromosome, cut in batches of ``size``."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), *keys).cast("binary"))
    return place(rows, ["chrom"], [order, *keys], "__place").withColumn("batch", F.floor(F.col("__place") / size)).drop("__place")


def row_mean_product(edges: DataFrame, features: DataFrame) -> DataFrame:
    """(chrom, i, k, v): features (chrom, j, k, x) averaged over the weighted edges (chrom, i, j, w) of each row."""
    total = edges.groupBy("chrom", "i").agg(F.sum("w").alias("t"))
    sums = edges.join(features, ["chrom", "j"]).groupBy("chrom", "i", "k").agg(F.sum(F.col("w") * F.col("x")).alias("s"))
    return sums.join(total, ["chrom", "i"]).select("chrom", "i", "k", (F.col("s") / F.col("t")).alias("v"))


def embedding_drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, change): squared change over the squared length of the new vector."""
    both = old.withColumnRenamed("v", "a").join(new.withColumnRenamed("v", "b"), "id")
    zero = F.lit(0.0)
    diff = F.aggregate(F.zip_with("a", "b", lambda x, y: (x - y).cast("double") * (x - y)), zero, lambda s, x: s + x)
    norm = F.aggregate(F.transform("b", lambda x: x.cast("double") * x), zero, lambda s, x: s + x)
    return both.select("id", (diff / norm).alias("change"))
