"""Exact top-k inner products, with vectors in descending order of length.

Candidates are range-partitioned by length and packed, longest first, in chunks. The first chunk gives each query a first
k-th best score; queries are packed in blocks as well. A chunk meets a block only if its longest vector can still score: by
Cauchy-Schwarz no product exceeds the product of the lengths. Inside such a cell, vectors go on in descending length, and
after the first coordinates of an SVD rotation a pair is dropped if its partial sum plus the product of the lengths of what
is left stays below the query's k-th best. Only survivors are multiplied out, in exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contactspark.llm.common import materialise

CHUNK, BLOCK = 4096, 2048  # candidates and queries that meet in one cell at most
STEP = 1024  # candidates that are bounded at once
HEAD = 16  # rotated coordinates in the partial sums
MOST = (1 << 63) - 1
_FLOAT_MAX = float(np.finfo(np.float64).max)
PACKED = "dims int, n int, wide int, ids binary, data binary"


def quantised(vectors: DataFrame, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v array<double>, length) of the vectors, each component floor(scale * x) as a whole number.

    Null and empty vectors, those with a null or non-finite component, and rows without id take no part. Every finite
    vector stays, however large (a double that overflows when scaled counts as the largest double). Repeated rows stay;
    further columns are ignored.
    """
    scaled = F.transform(F.col(vector_col), lambda x: F.greatest(F.least(x.cast("double") * scale, F.lit(_FLOAT_MAX)), F.lit(-_FLOAT_MAX)))
    v = F.transform(scaled, lambda y: F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y))
    ok = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    good = vectors.where(F.col(id_col).isNotNull() & (F.size(vector_col) > 0) & ok).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    return good.withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _pack(ids: np.ndarray, vectors: np.ndarray) -> tuple[int, int, int, bytes, bytes]:
    """(dims, n, bytes of a number, ids, numbers); four bytes where they hold every number exactly."""
    wide = 4 if not len(vectors) or np.abs(vectors).max() <= 1 << 24 else 8
    return vectors.shape[1], len(ids), wide, ids.astype("<i8").tobytes(), vectors.astype(f"<f{wide}").tobytes()


def _unpack(dims: int, n: int, wide: int, ids: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(data, f"<f{wide}").astype(np.float64).reshape(n, dims)


def _packs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (id, v) of one number of components each, in their order, ``most`` at a time."""
    held: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {}
    for batch in batches:
        sizes = batch.column(1).value_lengths().to_numpy()
        for dims in np.unique(sizes).tolist():
            some = batch.filter(pa.array(sizes == dims))
            ids, vectors = held.setdefault(dims, ([], []))
            ids.append(some.column(0).to_numpy())
            vectors.append(_matrix(some.column(1), dims))
            while sum(map(len, ids)) >= most:
                i, x = np.concatenate(ids), np.concatenate(vectors)
                yield i[:most], x[:most]
                ids[:], vectors[:] = [i[most:]], [x[most:]]
    for ids, vectors in held.values():
        if sum(map(len, ids)):
            yield np.concatenate(ids), np.concatenate(vectors)


def _lengths(vectors: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt((vectors**2).sum(axis=1))


def rotation_of(vectors: np.ndarray) -> np.ndarray:
    """The leading right singular vectors, HEAD columns at most."""
    most = np.abs(vectors).max() if vectors.size else 0.0
    if not most:
        return np.eye(vectors.shape[1])[:, :HEAD]
    return np.linalg.svd(vectors / most, full_matrices=False)[2][:HEAD].T


class Search:
    """Best k candidates of each query; vectors are float64 with whole numbers."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, rotation: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.ids, self.queries, self.rotation, self.k = ids, queries, rotation, k
        self.length, self.largest = _lengths(queries), np.abs(queries).max(axis=1, initial=0.0)
        self.head, self.rest = self._turn(queries, self.length)
        self.floor = np.full(len(ids), -np.inf) if floor is None else floor.copy()
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        self.beyond: dict[tuple[int, int], list[int]] = {}
        self.held = 0

    def _turn(self, vectors: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First coordinates and the length of the others; the slack of the bounds covers the rounding."""
        with np.errstate(over="ignore", invalid="ignore"):
            head = vectors @ self.rotation
            return head, np.sqrt(np.maximum(length**2 - (head**2).sum(axis=1), 0.0))

    def _exact(self, q: np.ndarray, ids: np.ndarray, vectors: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whole-number products of the pairs (q, j); those beyond a long are kept apart and given as its limits."""
        size = self.largest[q] * np.abs(vectors).max(axis=1, initial=0.0)[j] * vectors.shape[1]
        out = np.zeros(len(q), np.int64)
        for at in range(0, len(q), 65536):
            part = slice(at, at + 65536)
            exact = size[part] < 2.0**53
            i, c = q[part], j[part]
            out[part][exact] = np.einsum("ij,ij->i", self.queries[i[exact]], vectors[c[exact]]).astype(np.int64)
            fits = ~exact & (size[part] < 2.0**62)
            out[part][fits] = np.einsum("ij,ij->i", self.queries[i[fits]].astype(np.int64), vectors[c[fits]].astype(np.int64))
            for m in np.flatnonzero(~exact & ~fits).tolist():
                score = sum(int(a) * int(b) for a, b in zip(self.queries[i[m]].tolist(), vectors[c[m]].tolist()))
                out[at + m] = max(-MOST, min(MOST, score))
                if abs(score) >= MOST:
                    self.beyond.setdefault((int(i[m]), int(ids[c[m]])), []).append(score)
        return out

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Candidates in descending length; stops when no query can gain from shorter ones."""
        lengths = _lengths(vectors)
        for at in range(0, len(ids), STEP):
            part = slice(at, at + STEP)
            if not self._step(ids[part], vectors[part], lengths[part]):
                return

    def _step(self, ids: np.ndarray, vectors: np.ndarray, length: np.ndarray) -> bool:
        head, rest = self._turn(vectors, length)
        largest = np.abs(vectors).max(initial=0.0)
        with np.errstate(over="ignore", invalid="ignore"):
            slack = 1e-6 * (1 + length.max() * self.length)
            live = np.flatnonzero(~(self.length * length.max() + slack < self.floor))
            for at in range(0, len(live), 256):
                q = live[at : at + 256]
                bound = self.head[q] @ head.T + self.rest[q][:, None] * rest + slack[q][:, None]
                open_ = ~(bound < self.floor[q][:, None]) & (self.ids[q][:, None] != ids)
                many = 8 * np.count_nonzero(open_) > open_.size and self.largest[q].max() * largest * vectors.shape[1] < 2.0**53
                if many:  # one exact product of matrices costs less than the pairs one by one
                    scores = self.queries[q] @ vectors.T
                    open_ &= scores >= self.floor[q][:, None]
                i, j = np.nonzero(open_)
                if len(i):
                    score = scores[i, j].astype(np.int64) if many else self._exact(q[i], ids, vectors, j)
                    good = score >= self.floor[q[i]]
                    self.found.append((q[i[good]], ids[j[good]], score[good]))
                    self.held += int(good.sum())
                    if self.held > 4 * self.k * len(self.ids) + 100_000:
                        self._trim()
        self._trim()
        return len(live) > 0

    def _trim(self) -> None:
        q, ids, score = (np.concatenate(x) for x in zip(*self.found))
        if self.beyond:
            left = {key: list(scores) for key, scores in self.beyond.items()}
            exact = [left[key].pop() if abs(s) >= MOST and left.get(key := (a, b)) else s for a, b, s in zip(q.tolist(), ids.tolist(), score.tolist())]
            order = np.array(sorted(range(len(q)), key=lambda m: (q[m], -exact[m], ids[m])), int)
        else:
            order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, int)
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        last = rank == self.k - 1
        self.floor[q[last]] = np.maximum(self.floor[q[last]], np.nextafter(score[last].astype(np.float64), -np.inf))
        keep = rank < self.k
        self.found, self.held = [(q[keep], ids[keep], score[keep])], int(keep.sum())

    def rows(self) -> list[pa.Array]:
        """(query_id, vec_id, score, order): ``order`` sorts the scores beyond a long."""
        self._trim()
        q, ids, score = self.found[0]
        left = {key: list(scores) for key, scores in self.beyond.items()}
        order = [None] * len(q)
        if left:
            for m, key in enumerate(zip(q.tolist(), ids.tolist())):
                if abs(int(score[m])) >= MOST and left.get(key):
                    order[m] = (left[key].pop() + (1 << 2207)).to_bytes(277, "big")
        return [pa.array(self.ids[q], pa.int64()), pa.array(ids, pa.int64()), pa.array(score, pa.int64()), pa.array(order, pa.binary())]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query, ties to the smaller id.

    Both tables are as ``quantised`` gives them. A candidate with the query's id is its own and doesn't count; vectors of
    another number of components are not compared; of rows that repeat a query's id the least vector asks, while repeated
    candidates each count. A query gets all candidates if there are fewer than k; an empty table gives no rows. Scores beyond
    a long are ranked exactly and given as the least or greatest long but one. Nothing of the tables passes the driver: chunks
    and blocks meet in cells of a fixed size, by a shuffle join.
    """
    spark = vectors.sparkSession
    ranges = max(1, -(-vectors.count() // CHUNK))
    ordered = vectors.select("id", "v", "length").repartitionByRange(ranges, F.desc("length"), F.col("id")).sortWithinPartitions(F.desc("length"), "id")

    def pack_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for seq, (ids, x) in enumerate(_packs(batches, CHUNK)):
            yield pa.RecordBatch.from_pylist([dict(zip(chunk_names, (part << 32 | seq, float(_lengths(x).max()), *_pack(ids, x))))], chunk_schema)

    kinds = [("dims", pa.int32()), ("n", pa.int32()), ("wide", pa.int32()), ("ids", pa.binary()), ("data", pa.binary())]
    chunk_schema = pa.schema([("chunk", pa.int64()), ("top", pa.float64()), *kinds])
    chunk_names = chunk_schema.names
    chunks = materialise(ordered.select("id", "v").mapInArrow(pack_chunks, f"chunk long, top double, {PACKED}"), "by-length")
    seeds = chunks.join(chunks.groupBy("dims").agg(F.min("chunk").alias("chunk")), ["dims", "chunk"])
    seeds = seeds.select("dims", F.struct("dims", "n", "wide", "ids", "data").alias("seed"))

    def pack_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _packs(batches, BLOCK):
            yield pa.RecordBatch.from_pylist([dict(zip(names, _pack(ids, x)))], schema)

    schema = pa.schema(kinds)
    names = schema.names
    block_schema = pa.schema([("block", pa.int64()), ("need", pa.float64()), *kinds, ("floor", pa.binary()), ("rotation", pa.binary())])
    block_names = block_schema.names

    def first_floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            for row in batch.to_pylist():
                packed = [row[c] for c in names]
                ids, x = _unpack(*packed)
                seed_ids, seed = _unpack(*[row["seed"][c] for c in names])
                search = Search(ids, x, rotation_of(seed), k)
                search.add(seed_ids, seed)
                with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
                    # a hair less, as lengths are rounded; NaN and minus infinity ask for every chunk
                    need = float(np.nan_to_num(np.where(search.length > 0, search.floor / search.length, np.where(search.floor > 0, np.inf, -np.inf)) * (1 - 1e-6) - 1e-6, nan=-np.inf).min())
                yield pa.RecordBatch.from_pylist([dict(zip(block_names, (part << 32 | seq, need, *packed, search.floor.tobytes(), search.rotation.tobytes())))], block_schema)
                seq += 1

    asked = queries.groupBy("id").agg(F.min("v").alias("v")).mapInArrow(pack_blocks, PACKED).join(seeds, "dims")
    blocks = materialise(asked.select(*names, "seed").mapInArrow(first_floors, f"block long, need double, {PACKED}, floor binary, rotation binary"), "queries")

    # which chunks and blocks meet: a few numbers of each, the blocks repeated over salts so that no task has all pairs
    salts = max(1, ranges // 64)
    left = chunks.select("chunk", "dims", "top", F.pmod(F.xxhash64("chunk"), F.lit(salts)).alias("salt"))
    right = blocks.select("block", F.col("dims").alias("b_dims"), "need", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("b_salt"))
    cells = left.join(right, (F.col("dims") == F.col("b_dims")) & (F.col("salt") == F.col("b_salt")) & (F.col("top") >= F.col("need"))).select("chunk", "block")
    tasks = max(32, int(spark.conf.get("spark.sql.shuffle.partitions")), ranges)
    chunk_side = cells.join(chunks, "chunk").select("chunk", "block", F.struct(*names).alias("candidates")).repartition(tasks, "chunk", "block")
    block_side = cells.join(blocks, "block").select("chunk", "block", F.struct(*names, "floor", "rotation").alias("queries")).repartition(tasks, "chunk", "block")

    def search_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                c, q = batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
                ids, x = _unpack(*[q[name] for name in names])
                search = Search(ids, x, np.frombuffer(q["rotation"]).reshape(x.shape[1], -1), k, np.frombuffer(q["floor"]))
                search.add(*_unpack(*[c[name] for name in names]))
                yield pa.RecordBatch.from_arrays(search.rows(), ["query_id", "vec_id", "score", "order"])

    found = chunk_side.join(block_side, ["chunk", "block"]).select("candidates", "queries").mapInArrow(search_cell, "query_id long, vec_id long, score long, order binary")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("order"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
