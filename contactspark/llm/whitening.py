"""Whitening of embeddings by the leading eigenvectors of their covariance, which is never formed.

Each Spark pass takes a block of directions Q (dimensions x width) to the tasks and brings back the sum of X'(XQ) over the
centred rows. On the driver, matrices of that few columns only: the block is made orthonormal by QR against the blocks before
it, whose images are known, and a Rayleigh-Ritz step in their span gives the leading pairs and, from the same images, their
residuals. The next block are the residuals of all pairs sought and of some more; it ends when each of the k pairs has a
residual within rounding of zero, or the blocks span all dimensions. Beyond ``SPAN`` directions the iteration starts anew from
its best pairs, so that the driver's matrices stay narrow however many passes it takes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactspark.llm.common import materialise

#: Rows of a written block, further directions of a Spark pass beyond k, and directions that are kept before a new start.
ROWS, MORE, SPAN = 4096, 8, 160
#: A pair's residual over the largest eigenvalue, and passes at most.
TOLERANCE, PASSES = 2e-15, 500
#: An eigenvalue below this share of the trace is that of a direction without spread.
FLAT = 1e-13


def whole_numbers(embedding: str = "embedding", scale: int = 1024, shift: int = 100_000) -> F.Column:
    """floor(scale * component) + shift as long, the component as double; null if the vector or a component is null or not finite.

    Products beyond 4e18 on either side count as that.
    """
    limit = F.lit(4e18)
    good = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(good, F.transform(embedding, lambda x: F.floor(F.greatest(F.least(scale * x.cast("double"), limit), -limit)) + shift))


def packed(rows: DataFrame) -> DataFrame:
    """(n, ids, x): blocks of up to ``ROWS`` rows of (id long, x array<long>), vectors of one length, as bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, min(ROWS, (1 << 21) // len(batch.column(1)[0]))) if batch.num_rows else 1
            for at in range(0, batch.num_rows, step):
                some = batch.slice(at, step)
                x = some.column(1).flatten().to_numpy()
                yield pa.RecordBatch.from_pydict({"n": pa.array([some.num_rows], pa.int64()), "ids": pa.array([some.column(0).to_pylist()], pa.list_(pa.int64())), "x": pa.array([x.tobytes()], pa.binary())})

    return materialise(rows.select("id", "x").mapInArrow(pack, "n long, ids array<long>, x binary"), "whitening-rows")


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray]]:
    """(ids, exact numbers) of each block."""
    for batch in batches:
        for ids, n, x in zip(batch.column("ids") if "ids" in batch.schema.names else [None] * batch.num_rows, batch.column("n"), batch.column("x")):
            yield ids, np.frombuffer(x.as_py(), np.int64).reshape(n.as_py(), -1)


def _sum(blocks: DataFrame, tasks: int, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """Sum of ``part`` over all blocks: one small matrix from each task; of very many tasks' matrices the driver gets sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for _, x in _numbers(batches):
            total += part(x)
        yield pa.RecordBatch.from_pydict({"m": pa.array([total.tobytes()], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for m in batch.column(0):
                total += np.frombuffer(m.as_py()).reshape(shape)
        yield pa.RecordBatch.from_pydict({"m": pa.array([total.tobytes()], pa.binary())})

    parts = blocks.select("n", "x").mapInArrow(run, "m binary")
    if tasks > 256:
        parts = parts.repartition(int(tasks**0.5)).mapInArrow(add, "m binary")
    return sum((np.frombuffer(r["m"]).reshape(shape) for r in parts.collect()), np.zeros(shape))


def moments(blocks: DataFrame) -> tuple[int, list[int], list[int], int]:
    """(rows, sums, sums of squares, tasks that had rows) of the numbers, exact, as Python integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, squares = 0, np.zeros(1, object), np.zeros(1, object)
        for _, x in _numbers(batches):
            y = x if int(np.abs(x).max(initial=0)) < 1 << 24 else x.astype(object)  # squares of a block stay within 64 bits
            n, sums, squares = n + len(x), sums + y.sum(axis=0).astype(object), squares + (y * y).sum(axis=0).astype(object)
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "s": pa.array([list(map(str, sums))]), "q": pa.array([list(map(str, squares))])})

    rows = blocks.select("n", "x").mapInArrow(run, "n long, s array<string>, q array<string>").collect()  # one from each task
    sums, squares = ([sum(map(int, c)) for c in zip(*(r[name] for r in rows))] for name in ("s", "q"))
    return sum(r["n"] for r in rows), sums, squares, len(rows)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums / n: the whole part of the mean is taken off exactly."""
    whole = np.array([s // n for s in sums], dtype=object)
    rest = np.array([(s % n) / n for s in sums])
    if max(map(abs, whole.tolist()), default=0) < 1 << 61 and int(np.abs(x).max(initial=0)) < 1 << 61:
        return (x - whole.astype(np.int64)).astype(float) - rest
    return (x.astype(object) - whole).astype(float) - rest


def orthonormal(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Directions of ``block`` at right angles to ``basis`` and each other; those that are left by rounding alone go."""
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
        size = np.linalg.norm(block, axis=0)
        block = block[:, size > 1e-8] / size[size > 1e-8] if _ == 0 else block
        if not block.shape[1]:
            return block
        block, r = np.linalg.qr(block)
        block = block[:, np.abs(np.diag(r)) > 1e-10 * max(np.abs(np.diag(r)).max(), 1e-300)]
    return block


def leading(image: Callable[[np.ndarray], np.ndarray], dims: int, k: int, seed: int = 0, more: int = MORE, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, int]:
    """(eigenvalues, eigenvectors as columns, passes) of the k largest pairs of a symmetric ``image`` Q -> VQ.

    Raises if the residuals are not within ``TOLERANCE`` after ``PASSES`` passes.
    """
    k = min(k, dims)
    width, span = min(k + more, dims), max(span, 3 * (k + more))
    r = np.random.default_rng(seed)
    basis, images = np.zeros((dims, 0)), np.zeros((dims, 0))
    block = orthonormal(r.normal(size=(dims, width)), basis)
    for done in range(1, PASSES + 1):
        basis, images = np.hstack([basis, block]), np.hstack([images, image(block)])
        small = basis.T @ images
        values, turn = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-values)[:width]
        values, turn = values[order], turn[:, order]
        pairs = basis @ turn
        residuals = images @ turn - pairs * values
        size = np.linalg.norm(residuals, axis=0)
        if basis.shape[1] == dims or size[:k].max() <= TOLERANCE * dims * max(abs(values[0]), 1e-300):
            return values[:k], pairs[:, :k], done
        if basis.shape[1] + width > min(span, dims + width):
            basis, images = pairs, images @ turn
        block = orthonormal(residuals / np.where(size > 0, size, 1), basis)
        if not block.shape[1]:
            block = orthonormal(r.normal(size=(dims, width)), basis)
    raise RuntimeError(f"residuals {size[:k].tolist()} after {PASSES} passes")


def whiten(rows: DataFrame, k: int = 8) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each row of (id long, x array<long>) and component.

    Null vectors take no part, nor do vectors of another length than most have (of equally frequent lengths the longest) or
    empty ones. Components without spread (``FLAT``) are left out, so there are fewer than k where the rows span less, and none
    if all rows are equal or there is only one. Rows that repeat count each time; null ids are kept. ``deviation`` is exact; one
    beyond a long is given as the largest long. An empty table gives no rows.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = rows.sparkSession
    good = rows.where(F.col("x").isNotNull() & (F.size("x") > 0)).select(F.col("id").cast("long").alias("id"), "x")
    lengths = good.groupBy(F.size("x").alias("dims")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("dims")).first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    dims = lengths["dims"]
    blocks = packed(good.where(F.size("x") == dims))
    n, sums, squares, tasks = moments(blocks)
    spread = sum(n * q - s * s for q, s in zip(squares, sums))  # n^2 times the trace, exact
    trace = spread / n**2
    if not spread:
        return spark.createDataFrame([], schema)

    def image(directions: np.ndarray) -> np.ndarray:
        sent = spark.sparkContext.broadcast(directions)  # dimensions x width

        def part(x: np.ndarray) -> np.ndarray:
            c = centred(x, n, sums)
            return c.T @ (c @ sent.value)

        out = _sum(blocks, tasks, part, directions.shape) / n
        sent.destroy()
        return out

    values, vectors, _ = leading(image, dims, k)
    keep = values > FLAT * trace
    values, vectors = values[keep], vectors[:, keep]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    projection, width = vectors / np.sqrt(values), int(keep.sum())

    def product(x: np.ndarray) -> np.ndarray:
        w = np.hstack([np.ones((len(x), 1)), centred(x, n, sums) @ projection])
        return w.T @ w

    total = _sum(blocks, tasks, product, (width + 1, width + 1)) / n
    error = float(np.abs(total[1:, 1:] - np.outer(total[0, 1:], total[0, 1:]) - np.eye(width)).max(initial=0.0))
    explained = values / trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = (1 << 63) - 1
        for ids, x in _numbers(batches):
            w = centred(x, n, sums) @ projection
            reach = n * max(int(np.abs(x).max()), 1) + max(map(abs, sums))
            if reach < 1 << 62:
                d = n * x - np.array(sums)
                high = int(np.abs(d).max())
                d = (d * d).sum(axis=1).tolist() if high * high * dims < 1 << 62 else [min(most, sum(v * v for v in row)) for row in d.tolist()]
            else:
                d = [min(most, sum((n * v - s) ** 2 for v, s in zip(row, sums))) for row in x.tolist()]
            m = len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([i for i in ids.as_py() for _ in range(width)], pa.int64()),
                    pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * width, n, np.int64)),
                    pa.array([v for v in d for _ in range(width)], pa.int64()),
                    pa.array(w.ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * width, error)),
                ],
                [c.split()[0] for c in schema.split(", ")],
            )

    return blocks.mapInArrow(run, schema)
