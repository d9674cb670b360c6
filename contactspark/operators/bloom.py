"""Bloom sets of rows: bit arrays built by partition, merged by OR, sent as a filter before an exact join.

A set grows by layers: rows that are added to a full one go to a new layer of twice the size and half the error, so the errors sum
to less than what was asked for. No row that is in the set is ever missed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a slice that is merged by itself, and of all layers that may be sent to the tasks.
SLICE, MOST_BYTES = 1 << 16, 64 << 20


def _hashes(keys: dict[str, str]) -> list[Column]:
    """Two hashes of a row with its keys as the given types; nulls of different columns are told apart by their place."""
    parts = [p for k, kind in keys.items() for p in (F.col(k).isNull(), F.col(k).try_cast(kind))]
    return [F.xxhash64(F.lit(seed), *parts) for seed in (1, 2)]


def _places(a: np.ndarray, b: np.ndarray, bits: int, hashes: int) -> np.ndarray:
    """The bits of each row: ``hashes`` steps of one hash from the other."""
    a, b = a.view(np.uint64), b.view(np.uint64) | np.uint64(1)
    return (a[:, None] + np.arange(hashes, dtype=np.uint64) * b[:, None]) % np.uint64(bits)


class BloomSet:
    """Rows of ``keys``, with at most the share ``error`` of other rows taken for members."""

    def __init__(self, keys: list[str], error: float = 1e-3) -> None:
        self.keys, self.error, self.kinds = keys, error, {}
        self.layers: list[tuple[np.ndarray, int, int, int]] = []  # (bytes, bits, hashes, rows it is made for)
        self.held = 0  # rows in the last layer

    @property
    def size(self) -> int:
        return sum(len(layer[0]) for layer in self.layers)

    def add(self, rows: DataFrame) -> BloomSet:
        """Put rows in. Raises if the layers would be larger than ``MOST_BYTES``, before any is built."""
        self.kinds = self.kinds or {k: dict(rows.dtypes)[k] for k in self.keys}
        distinct = rows.select(*self.keys).distinct()
        count = distinct.count()
        if not count:
            return self
        if not self.layers or self.held + count > self.layers[-1][3]:
            room = max(count, 2 * self.layers[-1][3] if self.layers else 0, 1024)
            bits = math.ceil(-room * math.log(self.error / 2 ** (len(self.layers) + 1)) / math.log(2) ** 2 / 8 / SLICE) * 8 * SLICE
            if self.size + bits // 8 > MOST_BYTES:
                raise ValueError(f"{room} rows need {bits // 8} bytes: join without a filter")
            self.layers.append((np.zeros(bits // 8, np.uint8), bits, max(1, round(bits / room * math.log(2))), room))
            self.held = 0
        data, bits, hashes, room = self.layers[-1]

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = np.zeros(bits // 8, np.uint8)
            for batch in batches:
                at = _places(batch.column(0).to_numpy(), batch.column(1).to_numpy(), bits, hashes).ravel()
                np.bitwise_or.at(own, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
            for n, part in enumerate(own.reshape(-1, SLICE)):
                if part.any():
                    yield pa.RecordBatch.from_pydict({"slice": [n], "part": [part.tobytes()]})

        def merge(key: tuple, table: pa.Table) -> pa.Table:
            parts = np.stack([np.frombuffer(p.as_buffer(), np.uint8) for p in table["part"].combine_chunks()])
            return pa.table({"slice": [key[0].as_py()], "part": [np.bitwise_or.reduce(parts, axis=0).tobytes()]})

        parts = distinct.select(*_hashes(self.kinds)).mapInArrow(build, "slice long, part binary")
        for r in parts.groupBy("slice").applyInArrow(merge, "slice long, part binary").toLocalIterator():
            data[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] |= np.frombuffer(r["part"], np.uint8)
        self.held += count
        return self

    def might_hold(self, rows: DataFrame) -> Column:
        """Whether each row may be in the set; the layers are sent to the tasks, ``MOST_BYTES`` at most."""
        sent = rows.sparkSession.sparkContext.broadcast([layer[:3] for layer in self.layers])

        @F.pandas_udf("boolean")
        def probe(a: pd.Series, b: pd.Series) -> pd.Series:
            found = np.zeros(len(a), bool)
            for data, bits, hashes in sent.value:
                at = _places(a.to_numpy(), b.to_numpy(), bits, hashes)
                found |= (data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).all(axis=1)
            return pd.Series(found)

        return probe(*_hashes(self.kinds))


def held(rows: DataFrame, members: DataFrame, keys: list[str], error: float = 1e-3) -> DataFrame:
    """``rows`` with ``held``: whether ``members`` has the row's keys, nulls as values. Exact: only rows that pass the filter are joined.

    Without a filter, if the members' would be larger than ``MOST_BYTES``.
    """
    try:
        bloom = BloomSet(keys, error).add(members)
    except ValueError:
        maybe, never = rows, None
    else:
        marked = rows.withColumn("__maybe", bloom.might_hold(rows))
        maybe, never = marked.where("__maybe").drop("__maybe"), marked.where("NOT __maybe").drop("__maybe")
    known = members.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct().withColumn("__held", F.lit(True))
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    joined = maybe.join(known, on, "left").withColumn("held", F.coalesce("__held", F.lit(False))).drop("__held", *[f"__{k}" for k in keys])
    return joined if never is None else joined.unionByName(never.withColumn("held", F.lit(False)))
