"""Maps too large for one task, as square blocks: products join blocks on the inner index, vectors join on the column.

A block is a row (keys, bi, bj, m) of size x size doubles; blocks without any cell are not there. A task holds a block of the
result and a pair of factors, and of a vector one block; no task has a whole map. ``maps.symmetric`` gives the cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactspark.operators.tables import materialise

#: Bins on a side of a block: 2 MB.
SIZE = 512


def _kinds(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"{k} {dict(df.dtypes)[k]}" for k in keys)


def _streamed(rows: DataFrame, by: list[str], order: list, schema: str, step: Callable[[tuple, Iterator[tuple]], Iterator[tuple]], columns: list[str]) -> DataFrame:
    """``step`` (group, its rows of ``columns``) -> rows of ``schema``, group by group; rows come one by one, so none is held for long."""
    dealt = rows.repartition(*by).sortWithinPartitions(*by, *order).select(*by, *columns)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flat() -> Iterator[tuple]:
            for batch in batches:
                for n in range(batch.num_rows):
                    yield tuple(c[n].as_py() for c in batch.columns)

        source = flat()
        row = next(source, None)
        while row is not None:
            key = row[: len(by)]

            def group() -> Iterator[tuple]:
                nonlocal row
                while row is not None and row[: len(by)] == key:
                    here = row
                    yield here[len(by) :]
                    row = next(source, None)

            own = group()
            for out in step(key, own):
                yield pa.RecordBatch.from_pylist([dict(zip(names, out))], schema=to_arrow)
            for _ in own:  # what the step left
                pass

    from pyspark.sql.pandas.types import to_arrow_schema

    to_arrow = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)
    return dealt.mapInArrow(run, schema)


def cut(sym: DataFrame, keys: list[str], size: int = SIZE) -> DataFrame:
    """(keys, bi, bj, m) of cells (keys, i, j, v); cells that are named twice add up."""
    at = lambda c: F.floor(F.col(c) / size).cast("long")
    cells = sym.select(*keys, at("i").alias("bi"), at("j").alias("bj"), (F.col("i") % size).cast("long").alias("i"), (F.col("j") % size).cast("long").alias("j"), F.col("v").cast("double").alias("v"))

    def fill(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        m = np.zeros((size, size))
        for i, j, v in rows:
            m[i, j] += v
        yield (*key, m.tobytes())

    return materialise(_streamed(cells, [*keys, "bi", "bj"], [], f"{_kinds(sym, keys)}, bi long, bj long, m binary", fill, ["i", "j", "v"]), "blocks")


def cells(blocks: DataFrame, keys: list[str], size: int = SIZE) -> DataFrame:
    """(keys, i, j, v): the cells of blocks that aren't 0."""
    schema = f"{_kinds(blocks, keys)}, i array<long>, j array<long>, v array<double>"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                *key, bi, bj, m = (c[n].as_py() for c in batch.columns)
                m = np.frombuffer(m).reshape(size, size)
                i, j = np.nonzero(m)
                yield pa.RecordBatch.from_arrays([*(pa.array([k]) for k in key), *(pa.array([x.tolist()]) for x in (i + bi * size, j + bj * size)), pa.array([m[i, j].tolist()], pa.list_(pa.float64()))], names)

    packed = blocks.select(*keys, "bi", "bj", "m").mapInArrow(run, schema)
    return packed.select(*keys, F.explode(F.arrays_zip("i", "j", "v")).alias("c")).select(*keys, "c.i", "c.j", "c.v")


def product(a: DataFrame, b: DataFrame, keys: list[str], size: int = SIZE) -> DataFrame:
    """Blocks of the matrix product: blocks meet on the inner index, and the products of one place are summed as they come."""
    left = a.select(*keys, "bi", F.col("bj").alias("inner"), F.col("m").alias("x"))
    right = b.select(*keys, F.col("bi").alias("inner"), "bj", F.col("m").alias("y"))

    def add(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        total = np.zeros((size, size))
        for x, y in rows:
            total += np.frombuffer(x).reshape(size, size) @ np.frombuffer(y).reshape(size, size)
        yield (*key, total.tobytes())

    pairs = left.join(right, [*keys, "inner"])
    return materialise(_streamed(pairs, [*keys, "bi", "bj"], ["inner"], f"{_kinds(a, keys)}, bi long, bj long, m binary", add, ["x", "y"]), "blocks")


def combined(a: DataFrame, b: DataFrame, keys: list[str], f: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int = SIZE) -> DataFrame:
    """Blocks of ``f`` of two maps' blocks, a block that isn't there as zeros."""
    both = a.select(*keys, "bi", "bj", F.col("m").alias("x")).join(b.select(*keys, "bi", "bj", F.col("m").alias("y")), [*keys, "bi", "bj"], "full")

    def step(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        none = np.zeros((size, size))
        for x, y in rows:
            yield (*key, f(*(none if m is None else np.frombuffer(m).reshape(size, size) for m in (x, y))).tobytes())

    return materialise(_streamed(both, [*keys, "bi", "bj"], [], f"{_kinds(a, keys)}, bi long, bj long, m binary", step, ["x", "y"]), "blocks")


def times(blocks: DataFrame, vectors: DataFrame, keys: list[str], size: int = SIZE) -> DataFrame:
    """(keys, b, x): maps times vectors (keys, b, x binary); parts of a vector that aren't there count as 0."""
    pairs = blocks.join(vectors.withColumnRenamed("b", "bj"), [*keys, "bj"]).select(*keys, F.col("bi").alias("b"), "m", "x", "bj")

    def add(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        total = None
        for m, x in rows:
            part = np.frombuffer(m).reshape(size, size) @ np.frombuffer(x).reshape(size, -1)
            total = part if total is None else total + part
        yield (*key, total.tobytes())

    return materialise(_streamed(pairs, [*keys, "b"], ["bj"], f"{_kinds(blocks, keys)}, b long, x binary", add, ["m", "x"]), "vectors")


def spots(blocks: DataFrame, keys: list[str], index: DataFrame, size: int = SIZE) -> DataFrame:
    """(keys, b, n_bins): the blocks of a vector of each map; ``index`` (chrom, n_bins), chrom among the keys."""
    maps = blocks.select(*keys).distinct().join(index.select("chrom", "n_bins"), "chrom")
    return maps.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n_bins") / size).cast("long") - 1)).alias("b"), "n_bins")


def _vectors(rows: DataFrame, by: list[str], columns: list[str], f: Callable[..., np.ndarray]) -> DataFrame:
    """(by, x): a vector's block from each row's columns."""

    def step(key: tuple, group: Iterator[tuple]) -> Iterator[tuple]:
        for row in group:
            yield (*key, f(*row).tobytes())

    return materialise(_streamed(rows, by, [], f"{_kinds(rows, by)}, x binary", step, columns), "vectors")


def _scaled(blocks: DataFrame, vectors: DataFrame, keys: list[str], f: Callable[[np.ndarray | None, np.ndarray, np.ndarray, int, int], np.ndarray], size: int, every: bool = False) -> DataFrame:
    """Blocks of ``f`` (block, the vector's block of its rows, of its columns, bi, bj); with ``every`` of all places, none where no block is."""
    rows, columns = vectors.select(*keys, F.col("b").alias("bi"), F.col("x").alias("x")), vectors.select(*keys, F.col("b").alias("bj"), F.col("x").alias("y"))
    if every:
        both = rows.join(columns, keys).join(blocks.select(*keys, "bi", "bj", "m"), [*keys, "bi", "bj"], "left")
    else:
        both = blocks.select(*keys, "bi", "bj", "m").join(rows, [*keys, "bi"]).join(columns, [*keys, "bj"])

    def step(key: tuple, group: Iterator[tuple]) -> Iterator[tuple]:
        for m, x, y in group:
            here = None if m is None else np.frombuffer(m).reshape(size, size)
            yield (*key, f(here, np.frombuffer(x).reshape(size, -1), np.frombuffer(y).reshape(size, -1), key[-2], key[-1]).tobytes())

    return materialise(_streamed(both, [*keys, "bi", "bj"], [], f"{_kinds(blocks, keys)}, bi long, bj long, m binary", step, ["m", "x", "y"]), "blocks")


def row_correlation(sym: DataFrame, keys: list[str], index: DataFrame, size: int = SIZE) -> DataFrame:
    """Blocks of the correlation of the rows of symmetric maps; 0 where a row is constant, 1 on the diagonal."""
    m = cut(sym, keys, size)
    gram = product(m, m, keys, size)
    at = materialise(spots(m, keys, index, size), "spots")
    ones = _vectors(at, [*keys, "b"], ["n_bins"], lambda n: np.ones(size))
    sums = times(m, ones, keys, size).withColumnRenamed("x", "s")
    squares = gram.where("bi = bj").select(*keys, F.col("bi").alias("b"), "m")

    def stats(b: int, n: int, s: bytes | None, g: bytes | None) -> np.ndarray:
        """(mean, norm about the mean, whether the map has the row, bins) of each row of the block."""
        total = np.zeros(size) if s is None else np.frombuffer(s)
        square = np.zeros(size) if g is None else np.diag(np.frombuffer(g).reshape(size, size))
        left = square - total**2 / n
        norm = np.where(left > 1e-12 * np.maximum(square, 1e-300), np.sqrt(np.maximum(left, 0)), 0.0)
        return np.column_stack([total / n, norm, np.arange(size) + b * size < n, np.full(size, float(n))])

    known = at.join(sums, [*keys, "b"], "left").join(squares, [*keys, "b"], "left").withColumn("b0", F.col("b"))
    table = _vectors(known, [*keys, "b"], ["b0", "n_bins", "s", "m"], stats)

    def correlate(g: np.ndarray | None, x: np.ndarray, y: np.ndarray, bi: int, bj: int) -> np.ndarray:
        c = (0.0 if g is None else g) - x[0, 3] * np.outer(x[:, 0], y[:, 0])
        norm = np.outer(x[:, 1], y[:, 1])
        out = np.where(norm > 0, c / np.where(norm > 0, norm, 1), 0.0)
        if bi == bj:
            np.fill_diagonal(out, x[:, 2])
        return out

    return _scaled(gram, table, keys, correlate, size, every=True)


def random_walk(sym: DataFrame, keys: list[str], index: DataFrame, restart: float = 0.5, doublings: int = 6, size: int = SIZE) -> DataFrame:
    """Blocks of where a random walk with restart ends, without the diagonal: the sum of its first 2^doublings steps.

    Columns of the map without its diagonal are made to sum to 1, a bin without contacts stays where it is. With S the sum of m
    steps, that of 2m is S + (restart P)^m S, so each doubling takes two products.
    """
    m = cut(sym.where("i <> j"), keys, size)
    m = materialise(m, "blocks")
    at = materialise(spots(cut(sym, keys, size), keys, index, size), "spots")
    ones = _vectors(at, [*keys, "b"], ["n_bins"], lambda n: np.ones(size))
    sums = times(m, ones, keys, size).withColumnRenamed("x", "s")  # symmetric: of columns as of rows
    known = at.join(sums, [*keys, "b"], "left").withColumn("b0", F.col("b"))

    def total(b: int, n: int, s: bytes | None) -> np.ndarray:
        return np.column_stack([np.zeros(size) if s is None else np.frombuffer(s), np.arange(size) + b * size < n])

    table = _vectors(known, [*keys, "b"], ["b0", "n_bins", "s"], total)
    diagonal = at.select(*keys, F.col("b").alias("bi"), F.col("b").alias("bj"))
    zeros = np.zeros((size, size)).tobytes()
    base = diagonal.join(m, [*keys, "bi", "bj"], "left").select(*keys, "bi", "bj", F.coalesce("m", F.lit(bytearray(zeros))).alias("m")).unionByName(m.where("bi <> bj"))

    def step(g: np.ndarray | None, x: np.ndarray, y: np.ndarray, bi: int, bj: int) -> np.ndarray:
        out = g / np.where(y[:, 0] > 0, y[:, 0], 1)
        return restart * (out + np.diag(((y[:, 0] == 0) & (y[:, 1] > 0)).astype(float)) if bi == bj else out)

    power = _scaled(base, table, keys, step, size)
    start = _vectors(at.select(*keys, F.col("b").alias("bi"), F.col("b").alias("bj"), F.col("b").alias("b0"), "n_bins"), [*keys, "bi", "bj"], ["b0", "n_bins"], lambda b, n: np.diag((np.arange(size) + b * size < n) * (1 - restart)))
    walked = start.withColumnRenamed("x", "m")
    for turn in range(doublings):
        walked = combined(walked, product(power, walked, keys, size), keys, np.add, size)
        if turn + 1 < doublings:
            power = product(power, power, keys, size)
    return _scaled(walked, table, keys, lambda g, x, y, bi, bj: g - np.diag(np.diag(g)) if bi == bj else g, size)


def balanced(sym: DataFrame, keys: list[str], index: DataFrame, tolerance: float = 1e-8, most: int = 1000, size: int = SIZE) -> DataFrame:
    """Blocks of maps whose filled rows all sum to 1: x_i m_ij x_j with x found by matrix-vector joins.

    Each round takes x to x / sqrt(x (m x)); rounds end when no row of any map is off by more than ``tolerance``. As elsewhere a
    filled row with a zero on the diagonal gets 1e-5 there.
    """
    filled = sym.groupBy(*keys, "i").agg(F.sum("v").alias("s"), F.sum(F.when(F.col("i") == F.col("j"), F.col("v")).otherwise(0)).alias("d")).where("s > 0 AND d = 0")
    m = cut(sym.select(*keys, "i", "j", F.col("v").cast("double").alias("v")).unionByName(filled.select(*keys, "i", F.col("i").alias("j"), F.lit(1e-5).alias("v"))), keys, size)
    x = _vectors(spots(m, keys, index, size), [*keys, "b"], ["n_bins"], lambda n: np.ones(size))

    def move(x: bytes, y: bytes | None) -> np.ndarray:
        x, y = np.frombuffer(x), np.zeros(size) if y is None else np.frombuffer(y)
        v = x * y
        return np.where(v > 0, x / np.sqrt(np.where(v > 0, v, 1)), 0.0)

    def off(key: tuple, group: Iterator[tuple]) -> Iterator[tuple]:
        for x, y in group:
            v = np.frombuffer(x) * (np.zeros(size) if y is None else np.frombuffer(y))
            yield (*key, float(np.abs(v[v > 0] - 1).max(initial=0.0)))

    for _ in range(most):
        both = materialise(x.join(times(m, x, keys, size).withColumnRenamed("x", "y"), [*keys, "b"], "left"), "vectors")
        worst = _streamed(both, [*keys, "b"], [], f"{_kinds(both, [*keys, 'b'])}, w double", off, ["x", "y"]).agg(F.max("w")).first()[0] or 0.0
        if worst < tolerance:
            break
        x = _vectors(both, [*keys, "b"], ["x", "y"], move)
    return _scaled(m, x, keys, lambda g, a, b, bi, bj: g * a * b.T, size)


def first_component(correlations: DataFrame, keys: list[str], index: DataFrame, size: int = SIZE, width: int = 6, tolerance: float = 1e-10, most: int = 100) -> DataFrame:
    """(keys, bin, score): scores of the rows of maps on their first principal component, the largest loading positive.

    Directions go through the blocks and back by joins; each map's vectors, n x width numbers, are made orthonormal in a task.
    """
    at = materialise(spots(correlations, keys, index, size), "spots")
    ones = _vectors(at.withColumn("b0", F.col("b")), [*keys, "b"], ["b0", "n_bins"], lambda b, n: (np.arange(size) + b * size < n).astype(float))
    turned = materialise(correlations.select(*keys, F.col("bj").alias("bi"), F.col("bi").alias("bj"), "m"), "blocks")

    def transpose(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        for (m,) in rows:
            yield (*key, np.ascontiguousarray(np.frombuffer(m).reshape(size, size).T).tobytes())

    schema = f"{_kinds(correlations, keys)}, bi long, bj long, m binary"
    turned = materialise(_streamed(turned, [*keys, "bi", "bj"], [], schema, transpose, ["m"]), "blocks")
    columns = times(turned, ones, keys, size).withColumnRenamed("x", "s")  # sums of columns: n times the means
    joined = lambda x: at.join(columns, [*keys, "b"], "left").join(x, [*keys, "b"], "left")
    draw = _vectors(at.withColumn("b0", F.col("b")), [*keys, "b"], ["b0", "n_bins"], lambda b, n: np.random.default_rng(b).normal(size=(size, width)) * (np.arange(size) + b * size < n)[:, None])
    kinds = _kinds(correlations, keys)

    def collected(key: tuple, rows: Iterator[tuple]) -> tuple[list[int], np.ndarray, np.ndarray, int]:
        got = list(rows)
        parts = [np.zeros((size, width)) if x is None else np.frombuffer(x).reshape(size, width) for _, _, _, x in got]
        sums = [np.zeros(size) if s is None else np.frombuffer(s) for _, _, s, _ in got]
        return [r[0] for r in got], np.concatenate(parts), np.concatenate(sums), got[0][1]

    def orthonormal(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        numbers, x, sums, n = collected(key, rows)
        q, r = np.linalg.qr(x)
        shift = sums @ q / n  # what the means of the columns take from each row's score
        for k, b in enumerate(numbers):
            yield (*key, b, np.ascontiguousarray(q[k * size : (k + 1) * size]).tobytes(), shift.tobytes(), np.abs(np.diag(r)).tobytes())

    def orth(x: DataFrame) -> DataFrame:
        rows = joined(x).withColumn("b0", F.col("b"))
        return materialise(_streamed(rows, keys, ["b"], f"{kinds}, b long, x binary, shift binary, size binary", orthonormal, ["b0", "n_bins", "s", "x"]), "vectors")

    def centred(b: int, n: int, y: bytes | None, shift: bytes) -> np.ndarray:
        y = np.zeros((size, width)) if y is None else np.frombuffer(y).reshape(size, width)
        return (y - np.frombuffer(shift)) * (np.arange(size) + b * size < n)[:, None]

    def scores(q: DataFrame) -> DataFrame:
        y = times(correlations, q.select(*keys, "b", "x"), keys, size).withColumnRenamed("x", "y")
        return _vectors(at.join(y, [*keys, "b"], "left").join(q.select(*keys, "b", "shift"), [*keys, "b"]).withColumn("b0", F.col("b")), [*keys, "b"], ["b0", "n_bins", "y", "shift"], centred)

    q, last = orth(draw), None
    for _ in range(most):
        y = scores(q)
        back = times(turned, y, keys, size)  # scores sum to 0, so the means need not be taken off again
        q = orth(back)
        sizes = {tuple(r[k] for k in keys): np.frombuffer(r["size"])[0] for r in q.select(*keys, "size").dropDuplicates(keys).toLocalIterator()}  # a number a map
        if last is not None and all(abs(v - last[k]) <= tolerance * abs(v) for k, v in sizes.items()):
            break
        last = sizes

    def best(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        got = list(rows)
        y = np.concatenate([np.frombuffer(r[2]).reshape(size, width) for r in got])
        axes = np.concatenate([np.frombuffer(r[3]).reshape(size, width) for r in got])
        _, _, vt = np.linalg.svd(y, full_matrices=False)
        axis = axes @ vt[0]
        sign = np.sign(axis[np.abs(axis).argmax()]) or 1.0
        score = sign * (y @ vt[0])
        for k, r in enumerate(got):
            yield (*key, r[0], r[1], score[k * size : (k + 1) * size].tolist())

    rows = at.join(scores(q).withColumnRenamed("x", "y"), [*keys, "b"]).join(q.select(*keys, "b", "x"), [*keys, "b"]).withColumn("b0", F.col("b"))
    out = _streamed(rows, keys, ["b"], f"{kinds}, b long, n long, v array<double>", best, ["b0", "n_bins", "y", "x"])
    return out.select(*keys, "b", "n", F.posexplode("v").alias("at", "score")).select(*keys, (F.col("b") * size + F.col("at")).alias("bin"), "n", "score").where("bin < n").drop("n")
