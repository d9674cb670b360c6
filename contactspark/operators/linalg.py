"""Linear algebra: dense for one map at a time (a cell's chromosome is a group of its own), by joins and sums for all cells."""

from __future__ import annotations

import bisect
import functools
import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from numpy.polynomial.chebyshev import chebvander
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contactspark.operators.grid import SCHEMA as blocks_schema, Rows, mapped, packed as blocks_of, sweep
from contactspark.operators.order import quantiles
from contactspark.operators.tables import materialise


def dense(table: pd.DataFrame, n: int, value: str = "v") -> np.ndarray:
    m = np.zeros((n, n))
    np.add.at(m, (table["i"].to_numpy(), table["j"].to_numpy()), table[value].to_numpy(float))
    return m


def per_map(sym: DataFrame, keys: list[str], index: DataFrame, f: Callable[[np.ndarray, pd.DataFrame], np.ndarray], upper: bool = False) -> DataFrame:
    """Apply ``f`` (matrix, rows) -> matrix to every map and return its non-zero cells (keys, i, j, v)."""
    sized = sym.join(F.broadcast(index.select("chrom", "n_bins")), "chrom").select(*keys, "i", "j", F.col("v").cast("double").alias("v"), "n_bins")
    kinds = {k: dict(sym.dtypes)[k] for k in keys}

    def run(table: pd.DataFrame) -> pd.DataFrame:
        out = f(dense(table, int(table["n_bins"].iloc[0])), table)
        i, j = np.nonzero(np.triu(out) if upper else out)
        return pd.DataFrame({**{k: [table[k].iloc[0]] * len(i) for k in keys}, "i": i, "j": j, "v": out[i, j]})

    return sized.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {t}" for k, t in kinds.items()) + ", i long, j long, v double")


def correlation(m: np.ndarray) -> np.ndarray:
    """Correlation of rows; 0 where a row is constant, 1 on the diagonal."""
    x = m - m.mean(axis=1, keepdims=True)
    norm = np.sqrt((x * x).sum(axis=1))
    with np.errstate(invalid="ignore", divide="ignore"):
        c = np.where(np.outer(norm, norm) > 0, x @ x.T / np.outer(norm, norm), 0.0)
    np.fill_diagonal(c, 1.0)
    return c


def row_correlation(sym: DataFrame, keys: list[str], index: DataFrame) -> DataFrame:
    return per_map(sym, keys, index, lambda m, _: correlation(m))


def coverage_and_oe(m: np.ndarray) -> np.ndarray:
    s = m.sum(axis=1)
    root = np.sqrt(np.where(s > 0, s, 1))
    v = np.where(np.outer(s > 0, s > 0), m / root[:, None] / root, 0.0)
    d = np.abs(np.subtract.outer(np.arange(len(m)), np.arange(len(m))))
    sums, counts = np.bincount(d.ravel(), v.ravel()), np.bincount(d.ravel(), (v != 0).ravel().astype(float))
    e = sums / (counts + 1e-15)
    out = np.where(e[d] != 0, v / np.where(e[d] != 0, e[d], 1), 0.0)
    np.fill_diagonal(out, 1.0)
    return out


def first_component(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scores, mean, axis) of the first principal component; the largest loading is positive."""
    mean = c.mean(axis=0)
    axis = np.linalg.svd(c - mean, full_matrices=False)[2][0]
    axis = axis * np.sign(axis[np.argmax(np.abs(axis))] or 1)
    return (c - mean) @ axis, mean, axis


def compartments(sym: DataFrame, keys: list[str], index: DataFrame, arms: DataFrame | None = None, bulk: DataFrame | None = None, least: float = 0.01) -> DataFrame:
    """(keys, arm, bin, score): first component of the correlation of the observed over expected map of each arm.

    ``arms`` (chrom, split in bins or null) cuts chromosomes; rows need more than ``least`` of non-zero cells. ``bulk``
    (chrom, i, j, v): its component is the axis that every map is projected on, the map's rows by the bulk's good rows.
    """
    cut = sym.join(F.broadcast(arms), "chrom", "left") if arms is not None else sym.withColumn("split", F.lit(None).cast("long"))
    arm = lambda c: F.when(F.col(c) < F.col("split"), "p").otherwise("q")
    cut = cut.withColumn("arm", arm("i")).where(F.col("arm") == arm("j"))
    cols = [*keys, "arm", "i", "j", F.col("v").cast("double").alias("v")]
    kinds = ", ".join(f"{k} {dict(sym.dtypes)[k]}" for k in keys)
    schema = f"{kinds}, arm string, bin long, score double"

    def result(key: tuple, bins: np.ndarray, score: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({**{k: [v] * len(bins) for k, v in zip([*keys, "arm"], key)}, "bin": bins, "score": score})

    def packed(table: pd.DataFrame, bins: np.ndarray) -> np.ndarray:
        place = {b: i for i, b in enumerate(bins)}
        t = table[table["i"].isin(place) & table["j"].isin(place)]
        m = np.zeros((len(bins), len(bins)))
        np.add.at(m, (t["i"].map(place).to_numpy(int), t["j"].map(place).to_numpy(int)), t["v"].to_numpy())
        return m

    def good(table: pd.DataFrame) -> np.ndarray:
        n = table[table["v"] != 0].groupby("i").size()
        return np.sort(n.index[n > least * (table["i"].max() - table["i"].min() + 1)].to_numpy())

    def alone(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
        bins = good(table)
        return result(key, bins, first_component(correlation(coverage_and_oe(packed(table, bins))))[0]) if len(bins) > 1 else result(key, bins[:0], np.zeros(0))

    if bulk is None:
        return cut.select(*cols).groupBy(*keys, "arm").applyInPandas(alone, schema)

    model_rows = bulk.join(F.broadcast(arms), "chrom", "left") if arms is not None else bulk.withColumn("split", F.lit(None).cast("long"))
    model_rows = model_rows.withColumn("arm", arm("i")).where(F.col("arm") == arm("j")).select("chrom", "arm", "i", "j", F.col("v").cast("double").alias("v"))

    def fit(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
        bins = good(table)
        if len(bins) < 2:
            return pd.DataFrame({"chrom": [], "arm": [], "bins": [], "mean": [], "axis": []})
        _, mean, axis = first_component(correlation(coverage_and_oe(packed(table, bins))))
        return pd.DataFrame({"chrom": [key[0]], "arm": [key[1]], "bins": [bins.tolist()], "mean": [mean.tolist()], "axis": [axis.tolist()]})

    models = model_rows.groupBy("chrom", "arm").applyInPandas(fit, "chrom string, arm string, bins array<long>, mean array<double>, axis array<double>")

    def project(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
        bins = np.array(table["bins"].iloc[0])
        c = correlation(coverage_and_oe(packed(table, bins)))
        return result(key, bins, (c - np.array(table["mean"].iloc[0])) @ np.array(table["axis"].iloc[0]))

    return cut.select(*cols).join(F.broadcast(models), ["chrom", "arm"]).groupBy(*keys, "arm").applyInPandas(project, schema)


def balance(m: np.ndarray, tolerance: float = 1e-8, outer: int = 1000, inner: int = 10) -> np.ndarray:
    """Scaling vector x with x * (m @ x) = 1 by Newton steps whose systems are solved by conjugate gradients.

    It starts from the rows' sums, so that the size of the counts takes no steps. The step keeps x between a tenth and three times
    its last value; maps that can't be balanced end after ``outer`` steps. Empty rows get 0.
    """
    live = m.sum(axis=1) > 0
    a = m[np.ix_(live, live)]
    x = 1 / np.sqrt(a.sum(axis=1))
    for _ in range(outer):
        v = x * (a @ x)
        r = 1 - v
        if not len(a) or r @ r < tolerance**2:
            break
        y = np.ones(len(a))
        z = r / v
        p, rho = z.copy(), r @ z
        for _ in range(inner):
            q = x * (a @ (x * p)) + v * p
            alpha = rho / (p @ q)
            step = alpha * p
            new = y + step
            if new.min() <= 0.1 or new.max() >= 3:
                with np.errstate(divide="ignore", invalid="ignore"):
                    room = np.where(step < 0, (0.1 - y) / step, np.where(step > 0, (3 - y) / step, np.inf))
                y = y + max(0.0, np.nanmin(room)) * step
                break
            y, r = new, r - alpha * q
            if r @ r < (0.1**2) * ((1 - v) @ (1 - v)):
                break
            z = r / v
            rho, last = r @ z, rho
            p = z + rho / last * p
        x = np.abs(x * y)
    out = np.zeros(len(m))
    out[live] = x
    return out


def balanced(sym: DataFrame, keys: list[str], index: DataFrame) -> DataFrame:
    """Maps whose filled rows all sum to 1."""

    def f(m: np.ndarray, _: pd.DataFrame) -> np.ndarray:
        m = m + np.diag(np.where((np.diag(m) == 0) & (m.sum(axis=1) > 0), 1e-5, 0))
        x = balance(m)
        return m * x[:, None] * x

    return per_map(sym, keys, index, f)


def walked(m: np.ndarray, restart: float = 0.5, steps: int = 60, tolerance: float = 1e-6) -> np.ndarray:
    p = m.copy()
    np.fill_diagonal(p, 0)
    p += np.diag((p.sum(axis=0) == 0).astype(float))
    p = p / p.sum(axis=0)
    eye = np.eye(len(p))
    q = eye.copy()
    for _ in range(steps):
        new = (1 - restart) * eye + restart * q @ p
        done = np.linalg.norm(new - q) < tolerance
        q = new
        if done:
            break
    np.fill_diagonal(q, 0)
    return q


def random_walk(sym: DataFrame, keys: list[str], index: DataFrame, restart: float = 0.5) -> DataFrame:
    """Random walk with restart until it stands still, 60 steps at most."""
    return per_map(sym, keys, index, lambda m, _: walked(m, restart))


def _numbers(batch: pa.RecordBatch, at: int) -> np.ndarray:
    return np.column_stack([c.to_numpy() for c in batch.columns[at:]])


def _square(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, means, products of the columns): one small matrix from each partition."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum((m.T @ m for m in (np.column_stack([np.ones(b.num_rows), _numbers(b, 0)]) for b in batches if b.num_rows)), np.zeros((len(columns) + 1,) * 2))
        yield pa.RecordBatch.from_pydict({"m": pa.array([total.tobytes()], pa.binary())})

    parts = [np.frombuffer(r["m"]).reshape(len(columns) + 1, -1) for r in df.select(*columns).mapInArrow(part, "m binary").collect()]
    total = sum(parts, np.zeros((len(columns) + 1,) * 2))
    return int(total[0, 0]), total[0, 1:] / max(total[0, 0], 1), total[1:, 1:]


def _times(df: DataFrame, columns: list[str], mean: np.ndarray, m: np.ndarray, key: str = "id") -> tuple[DataFrame, list[str]]:
    """The rows' columns, less the means, times a small matrix."""
    to = [f"w{t}" for t in range(m.shape[1])]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = (_numbers(batch, 1) - mean) @ m
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[:, t]) for t in range(m.shape[1]))], [key, *to])

    return materialise(df.select(key, *columns).mapInArrow(part, ", ".join([f"{key} {dict(df.dtypes)[key]}", *(f"{c} double" for c in to)])), "svd-basis"), to


def _orthonormal(df: DataFrame, columns: list[str], centre: bool, key: str = "id") -> tuple[DataFrame, list[str]]:
    """Columns of unit length at right angles; directions without weight are left out."""
    df = materialise(df, "svd-ids")
    n, mean, products = _square(df, columns)
    mean = mean if centre else np.zeros(len(columns))
    values, vectors = np.linalg.eigh(products - n * np.outer(mean, mean))
    keep = np.flatnonzero(values > 1e-12 * max(values.max(initial=0.0), 1e-300))[::-1]
    return _times(df, columns, mean, vectors[:, keep] / np.sqrt(values[keep]), key) if len(keep) else (df, [])


def sparse_svd(rows: DataFrame, k: int, id_col: str = "id", feature: str = "feature", value: str = "v", centre: bool = False, extra: int = 20, rounds: int = 4) -> DataFrame:
    """(id, v array<double>): scores on the first k singular vectors of a sparse table (id, feature, value).

    Randomised subspace iteration: k + ``extra`` random directions, ``rounds`` further products with the table and its
    transpose, all of them joins and sums; only matrices of that few columns reach the driver. With no more ids than
    directions the result is exact, else close to it. ``centre`` takes each feature's mean off. The largest absolute score of each component is
    positive. Ids whose rows are all null or zero have scores of 0; an empty table gives no rows.
    """
    width = k + extra
    table = materialise(rows.where(F.col(value).isNotNull()).select(F.col(id_col).alias("id"), F.col(feature).alias("feature"), F.col(value).cast("double").alias("x")), "svd-table")
    names = [f"w{t}" for t in range(width)]
    drawn = [F.xxhash64("feature", F.lit(t)) / F.lit(float(1 << 63)) for t in range(width)]
    y = table.groupBy("id").agg(*[F.sum(F.col("x") * d).alias(n) for d, n in zip(drawn, names)])

    def across(df: DataFrame, key: str, other: str, columns: list[str]) -> DataFrame:
        return table.join(df, key).groupBy(other).agg(*[F.sum(F.col("x") * F.col(c)).alias(c) for c in columns])

    basis, columns = _orthonormal(y, names, centre)
    for _ in range(rounds):
        if len(columns) < width:  # the directions hold all there is
            break
        features = materialise(across(basis, "id", "feature", columns), "svd-features")
        basis, columns = _orthonormal(across(features, "feature", "id", columns), columns, centre)
    if columns:
        basis, columns = _orthonormal(basis, columns, centre)  # once more, for the rounding
    if not columns:
        return table.select("id").distinct().select("id", F.array_repeat(F.lit(0.0), k).alias("v"))
    _, _, products = _square(across(basis, "id", "feature", columns), columns)
    values, vectors = np.linalg.eigh(products)
    order = np.argsort(-values)[:k]
    scores, to = _times(basis, columns, np.zeros(len(columns)), vectors[:, order] * np.sqrt(np.maximum(values[order], 0)))
    top = scores.agg(*[F.max_by(c, F.struct(F.round(F.abs(F.col(c)), 9), -F.xxhash64("id"))) for c in to]).first()
    signed = [F.col(c) * (-1.0 if (x or 0.0) < 0 else 1.0) for c, x in zip(to, top or [])]
    return scores.select("id", F.array(*signed).alias("v"))


def principal_axes(rows: DataFrame, k: int, centre: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(mean, axes as columns) of the first ``k`` principal components of (id, v), fewer if the rows span less.

    For vectors of one length and few numbers: one pass sums them, one the products of what is left without the mean, a square
    matrix from each task. Rows must have no nulls; without rows both are empty.
    """

    def products(shift: np.ndarray | None) -> tuple[int, np.ndarray, np.ndarray]:
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, sums, total = 0, 0.0, 0.0
            for batch in batches:
                if batch.num_rows:
                    x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
                    x = x if shift is None else x - shift
                    n, sums, total = n + len(x), sums + x.sum(axis=0), total + (x.T @ x if shift is not None else 0.0)
            if n:
                yield pa.RecordBatch.from_pydict({"n": [n], "s": [np.asarray(sums).tobytes()], "t": [np.asarray(total).tobytes()]})

        parts = rows.select(F.transform("v", lambda x: x.cast("double")).alias("v")).mapInArrow(part, "n long, s binary, t binary").collect()  # one from each task
        sums = sum((np.frombuffer(r["s"]) for r in parts), np.zeros(1))
        return sum(r["n"] for r in parts), sums, sum((np.frombuffer(r["t"]) for r in parts), np.zeros(1))

    n, sums, _ = products(None)
    if not n:
        return np.zeros(0), np.zeros((0, 0))
    mean = sums / n if centre else np.zeros(len(sums))
    values, axes = np.linalg.eigh(products(mean)[2].reshape(len(mean), -1))
    return mean, axes[:, [c for c in np.argsort(-values)[:k] if values[c] > 1e-12 * max(values.max(), 1e-300)]]


def dense_components(rows: DataFrame, k: int, centre: bool = True) -> DataFrame:
    """(id, v array<double>): scores of (id, v) on the first ``k`` principal components, fewer if the rows span less.

    Rows with a null id, vector or component take no part; the largest absolute score of each component is positive. An empty
    table gives no rows.
    """
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))
    rows = rows.select("id", F.transform("v", lambda x: x.cast("double")).alias("v"))
    mean, axes = principal_axes(rows, k, centre)
    if not axes.shape[1]:
        return rows.select("id", F.expr("CAST(array() AS array<double>)").alias("v"))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = (batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1) - mean) @ axes
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.tolist(), pa.list_(pa.float64()))], ["id", "v"])

    scores = materialise(rows.mapInArrow(project, f"id {dict(rows.dtypes)['id']}, v array<double>"), "components")
    top = scores.agg(*[F.max_by(F.col("v")[c], F.struct(F.round(F.abs(F.col("v")[c]), 9), -F.xxhash64("id"))) for c in range(axes.shape[1])]).first()
    return scores.select("id", F.array(*[F.col("v")[c] * (-1.0 if (x or 0.0) < 0 else 1.0) for c, x in enumerate(top)]).alias("v"))


def binary_features(sym: DataFrame, index: DataFrame, percent: float, k: int, restart: float = 0.5) -> DataFrame:
    """(id, v): random walk of each map, its top ``percent`` of cells set to 1, principal components over all chromosomes."""

    def top(m: np.ndarray, _: pd.DataFrame) -> np.ndarray:
        q = walked(m, restart)
        return (q > np.percentile(q, 100 - percent)).astype(float)

    binary = per_map(sym, ["cell_id", "chrom"], index, top, upper=True)
    return sparse_svd(binary.withColumn("feature", F.concat_ws("-", "chrom", "i", "j")), k, "cell_id", centre=True)


#: Rows that ``scaling`` is fitted on at most, by the least hash of their id; every row is placed by its distances to them.
LANDMARKS = 1000


def scaling(rows: DataFrame, k: int = 2, landmarks: int = LANDMARKS) -> DataFrame:
    """(id, v): multidimensional scaling of (id, v) by landmarks: classical scaling of at most ``landmarks`` rows, and for
    every row the place that its distances to them give, which for a landmark is its own. An empty table gives no rows."""
    table = rows.select(F.col("id").cast("long").alias("id"), F.transform("v", lambda x: x.cast("double")).alias("v"))
    some = table.orderBy(F.xxhash64("id"), "id").limit(landmarks).toArrow()
    if not len(some):
        return rows.sparkSession.createDataFrame([], "id long, v array<double>")
    marks = np.array(some["v"].to_pylist())
    d2 = ((marks**2).sum(axis=1)[:, None] + (marks**2).sum(axis=1) - 2 * marks @ marks.T).clip(min=0)
    h = np.eye(len(marks)) - 1 / len(marks)
    values, vectors = np.linalg.eigh(-h @ d2 @ h / 2)
    order = np.argsort(-values)[:k]
    root = np.sqrt(np.maximum(values[order], 0))
    axes = vectors[:, order] / np.where(root > 1e-12, root, np.inf)
    places = vectors[:, order] * root
    axes = axes * np.sign(places[np.argmax(np.abs(places), axis=0), np.arange(places.shape[1])])
    sent = rows.sparkSession.sparkContext.broadcast((marks, d2.mean(axis=0), axes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, mean, axes = sent.value
        for batch in batches:
            x = np.array(batch.column(1).to_pylist()).reshape(batch.num_rows, marks.shape[1])
            d2 = (x**2).sum(axis=1)[:, None] + (marks**2).sum(axis=1) - 2 * x @ marks.T
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(-(d2 - mean) @ axes / 2), pa.list_(pa.float64()))], ["id", "v"])

    return table.mapInArrow(run, "id long, v array<double>")


#: Densities: sides of a box of points in bandwidths, terms of a series along a side (error of a kernel of 1: about 1e-14), box numbers along an axis.
BOX, TERMS, WIDE = 4.0, 28, 1 << 32


def series(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The Chebyshev polynomials along both sides of their boxes, a line for each of the places ``v``, which are in sides of a box."""
    t = 2 * (v - np.floor(v)) - 1
    return chebvander(t[:, 0], TERMS - 1), chebvander(t[:, 1], TERMS - 1)


def box_sums(v: np.ndarray) -> np.ndarray:
    """Sums of the products of the polynomials over the places of a box, or ``v`` where it has them already."""
    if v.shape[1] == TERMS:
        return v
    a, b = series(v)
    return a.T @ b


def shorter(*parts: np.ndarray) -> np.ndarray:
    """Places or sums of parts of a box as one: places as long as they are the shorter of both."""
    if all(v.shape[1] == 2 for v in parts) and sum(v.size for v in parts) < TERMS**2:
        return np.vstack(parts)
    return sum(map(box_sums, parts))


def kernel_series(apart: int) -> np.ndarray:
    """The normal kernel of places in intervals that lie ``apart`` sides from each other, as a series in the polynomials of both."""
    nodes = np.cos(np.pi * (np.arange(TERMS) + 0.5) / TERMS)
    fit = chebvander(nodes, TERMS - 1).T * 2 / TERMS
    fit[0] /= 2
    return fit @ np.exp(-(((nodes[:, None] - nodes - 2 * apart) * BOX / 2) ** 2) / 2) @ fit.T


class KernelSums:
    """Sums of the normal kernel over boxes near by: the series of a block's box is summed up first, then read at the block's places."""

    def __init__(self, reach: int) -> None:
        self.kernel = {d: kernel_series(d) for d in range(-reach, reach + 1)}
        self.last: tuple[Rows | None, np.ndarray | None] = None, None

    def start(self, x: Rows) -> np.ndarray:
        return np.zeros((TERMS, TERMS))

    def meet(self, x: Rows, y: Rows, total: np.ndarray) -> None:
        if self.last[0] is not y:  # meets all blocks of a group one after the other
            self.last = y, box_sums(y[1])
        i, j = divmod(int(y[2][0] - x[2][0]) + WIDE // 2, WIDE)
        total += self.kernel[i] @ self.last[1] @ self.kernel[j - WIDE // 2].T

    def rows(self, x: Rows, total: np.ndarray) -> list[np.ndarray]:
        a, b = series(x[1])
        return [x[0], (a @ total * b).sum(axis=1)]


def density(points: DataFrame, x: str = "x", y: str = "y", factor: float = 1.0) -> DataFrame:
    """(id, density): Gaussian kernel density of 2-D points at themselves; bandwidth n^(-1/6) times ``factor``.

    A fast Gauss transform: points lie in boxes of ``BOX`` bandwidths, and a point meets what the boxes near by sum up to in a series, not their
    points. Boxes so far off that all points there add less than the last bit of a point's own kernel don't meet. By the
    variances few boxes hold points: n^(2/3) at most and about n^(1/3) for one cloud, so the work grows as the points do.
    Ids must differ; points with a null take no part.
    """
    points = points.select(F.col("id").cast("long").alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    points = materialise(points.where("x is not null and y is not null"), "points")
    n, x0, y0, xx, yy, xy = points.agg(F.count("*"), F.avg("x"), F.avg("y"), F.var_samp("x"), F.var_samp("y"), F.covar_samp("x", "y")).first()
    h2 = (max(n, 1) ** (-1 / 6) * factor) ** 2
    det = (xx or 0.0) * (yy or 0.0) - (xy or 0.0) ** 2
    if not det > 0:
        return points.select("id", F.lit(None).cast("double").alias("density"))
    side, far = BOX * math.sqrt(h2), math.sqrt(2 * (math.log(n) + 53 * math.log(2))) / BOX
    dx, dy = F.col("x") - x0, F.col("y") - y0
    places = points.select("id", F.array(dx / (side * math.sqrt(xx)), (dy - dx * (xy / xx)) * (math.sqrt(xx / det) / side)).alias("v"))
    blocks = blocks_of(places.withColumn("g", F.floor(F.col("v")[0]) * WIDE + F.floor(F.col("v")[1])), apart=True)
    reach = math.ceil(far)
    steps = range(-reach, reach + 1)
    near = np.array([i * WIDE + j for i in steps for j in steps if math.hypot(max(abs(i) - 1, 0), max(abs(j) - 1, 0)) < far])

    def gather(each: Iterator[tuple[int, Rows]]) -> Iterator[pa.RecordBatch]:
        for box, some in itertools.groupby((rows for _, rows in each), lambda rows: int(rows[2][0])):
            v = functools.reduce(shorter, (rows[1] for rows in some), np.empty((0, 2)))
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (box, len(v), v.itemsize, b"", v.tobytes(), np.int64(box).tobytes())], ["block", "n", "width", "ids", "v", "g"])

    def beside(each: Iterator[tuple[int, Rows]]) -> Iterator[pa.RecordBatch]:
        for block, rows in each:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), block)), pa.array(rows[2][0] + near)], ["a", "b"])

    boxes = materialise(mapped(blocks, gather, blocks_schema), "boxes")
    sums = sweep(blocks, boxes, KernelSums(reach), "id long, s double", mapped(blocks, beside, "a long, b long"))
    return sums.groupBy("id").agg((F.sum("s") / (n * 2 * math.pi * h2 * math.sqrt(det))).alias("density"))


def zinb(rows: DataFrame, x: str, mean: str, dispersion: str, dropout: str) -> DataFrame:
    """``log_likelihood`` of zero-inflated negative binomials; ``dropout`` is a logit. The log-gamma function is the only
    part that isn't built in."""
    lgamma = np.vectorize(math.lgamma, otypes=[float])

    @F.pandas_udf("double")
    def log_gamma(v: pd.Series) -> pd.Series:
        return pd.Series(lgamma(v.to_numpy()))

    from contactspark.operators.metrics import softplus

    eps = 1e-8
    k, mu, theta, pi = (F.col(c).cast("double") for c in (x, mean, dispersion, dropout))
    ratio = theta * (F.log(theta + eps) - F.log(theta + mu + eps))
    zero = softplus(-pi + ratio) - softplus(-pi)
    more = -softplus(-pi) - pi + ratio + k * (F.log(mu + eps) - F.log(theta + mu + eps)) + log_gamma(k + theta) - log_gamma(theta) - log_gamma(k + 1)
    return rows.withColumn("log_likelihood", F.when(k < eps, zero).otherwise(more))


def calibrate(scores: DataFrame, own: DataFrame, bulk: DataFrame, seed: int = 0, rounds: int = 50) -> DataFrame:
    """(chrom, bin, members, settled): shared boundaries of a population, by alternating assignment and placing.

    ``scores`` (cell_id, chrom, bin, score), ``own`` (cell_id, chrom, bin) and ``bulk`` (chrom, bin). It starts from the bulk's
    boundaries and further ones in a seeded order, 1.5 times as many in all. In each round every boundary of a cell goes to the
    nearest shared one by score distance, and each shared one moves to the bin of least summed distance within the range of
    its members. A cell's chromosome is a piece of work; the driver holds the shared bins of a chromosome only. ``settled`` is
    false for a chromosome that still moved after ``rounds``. Bins of a cell must be 0, 1, 2 and so on.
    """
    spark = scores.sparkSession
    packed = scores.groupBy("chrom", "cell_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "score"))), lambda t: t["score"]).alias("s"))
    mine = own.groupBy("chrom", "cell_id").agg(F.array_sort(F.collect_set("bin")).alias("b"))
    cells = materialise(packed.join(mine, ["chrom", "cell_id"]), "calibrate")
    known = bulk.select("chrom", "bin").distinct()
    size = known.groupBy("chrom").agg(F.floor(1.5 * F.count("*")).alias("want"), F.count("*").alias("have"))
    rest = own.select("chrom", "bin").distinct().join(known, ["chrom", "bin"], "left_anti").join(F.broadcast(size), "chrom")
    order = Window.partitionBy("chrom").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "chrom", "bin").cast("binary")), "bin")  # bins of the index
    more = rest.withColumn("r", F.row_number().over(order)).where(F.col("r") <= F.col("want") - F.col("have")).select("chrom", "bin")
    shared: dict[str, list[int]] = {}
    for r in known.unionByName(more).collect():
        shared.setdefault(r["chrom"], []).append(r["bin"])
    shared = {c: sorted(b) for c, b in shared.items()}
    stable = dict.fromkeys(shared, 0)
    members: dict[tuple[str, int], int] = {}

    def assign(sent: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shared = sent.value
            for batch in batches:
                out: list[tuple] = []
                for chrom, s, b in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    if chrom not in shared:
                        continue
                    s, places = np.array(s), shared[chrom]
                    cum = np.cumsum(s)
                    for x in b:
                        k = bisect.bisect_left(places, x)
                        low, high = max(0, (places[k - 2] if k > 1 else 0)), min(len(s) - 1, places[k + 1] if k + 1 < len(places) else len(s) - 1)
                        y = np.arange(low, high + 1)
                        least = np.concatenate([np.minimum.accumulate(s[low : x + 1][::-1])[::-1], np.minimum.accumulate(s[x : high + 1])[1:]])
                        d = np.abs(cum[x] - cum[low : high + 1] - (x - y) * least)
                        best = min(places[max(0, k - 1) : k + 1], key=lambda p: (d[p - low], p))
                        out += [(chrom, best, x, int(p), float(v)) for p, v in zip(y, d)]
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["chrom", "shared", "x", "y", "d"])

        return run

    for _ in range(rounds):
        if all(n == 2 for n in stable.values()):
            break
        moving = [c for c, n in stable.items() if n < 2]
        sent = spark.sparkContext.broadcast({c: shared[c] for c in moving})
        found = cells.where(F.col("chrom").isin(moving)).select("chrom", "s", "b").mapInArrow(assign(sent), "chrom string, shared long, x long, y long, d double")
        by_place = found.groupBy("chrom", "shared", "y").agg(F.sum("d").alias("d"), F.min("x").alias("low"), F.max("x").alias("high"), F.sum((F.col("x") == F.col("y")).cast("int")).alias("here"))
        group = Window.partitionBy("chrom", "shared")
        in_range = by_place.withColumns({"first": F.min("low").over(group), "last": F.max("high").over(group), "members": F.sum("here").over(group)}).where("y BETWEEN first AND last")
        # every member reaches over the whole range, so sums at its places are complete
        new = in_range.groupBy("chrom", "shared").agg(F.min_by("y", F.struct(F.round("d", 9), "y")).alias("to"), F.max("members").alias("members")).collect()
        for c in moving:
            moved = sorted({r["to"] for r in new if r["chrom"] == c})
            stable[c] = stable[c] + 1 if moved == shared[c] else 0
            shared[c] = moved
            members = {k: v for k, v in members.items() if k[0] != c} | {(c, r["shared"]): r["members"] for r in new if r["chrom"] == c}
    rows = [(c, b, members.get((c, b), 0), stable[c] == 2) for c in shared for b in shared[c]]
    return spark.createDataFrame(rows, "chrom string, bin long, members long, settled boolean")


def quantile_normal(table: DataFrame, value: str, n: int = 250) -> DataFrame:
    """``value`` by interpolation between ``n`` quantiles of all values, in [0, 1]; equal knots count by their middle."""
    knots = quantiles(table, value, [k / (n - 1) for k in range(n)])
    if knots[0] is None:
        return table.withColumn(value, F.lit(None).cast("double"))

    @F.pandas_udf("double")
    def place(v: pd.Series) -> pd.Series:
        up = np.interp(v, knots, np.linspace(0, 1, n))
        down = 1 - np.interp(-v, -np.array(knots)[::-1], np.linspace(0, 1, n))
        return pd.Series((up + down) / 2)

    return table.withColumn(value, place(F.col(value).cast("double")))
