"""Maps as blocks against the same maps whole, in blocks that don't divide the map and in ones larger than it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from contactspark.operators import blocks as B
from contactspark.operators import contacts as C
from contactspark.operators import linalg as L


def random_map(n, seed):
    r = np.random.default_rng(seed)
    m = np.triu(r.integers(1, 9, (n, n)) * (r.random((n, n)) < 0.5)).astype(float)
    m = m + m.T
    m[3] = m[:, 3] = 0  # an empty row
    return m


@pytest.fixture(scope="module")
def given(spark):
    maps = {"a": random_map(40, 1), "b": random_map(23, 2)}
    rows = [(c, int(i), int(j), float(m[i, j])) for c, m in maps.items() for i, j in zip(*np.nonzero(m))]
    index = C.bin_index(spark.createDataFrame([("a", 40), ("b", 23)], "chrom string, size long"), 1)
    return spark.createDataFrame(rows, "chrom string, i long, j long, v double").persist(), maps, index


def back(df, maps):
    out = {c: np.zeros_like(m) for c, m in maps.items()}
    for r in df.collect():
        out[r.chrom][r.i, r.j] += r.v
    return out


@pytest.mark.parametrize("size", [16, 64])
def test_cut_and_product(given, size):
    sym, maps, _ = given
    m = B.cut(sym, ["chrom"], size)
    assert m.agg(F.max(F.length("m"))).first()[0] == 8 * size**2
    for c, got in back(B.cells(m, ["chrom"], size), maps).items():
        assert np.array_equal(got, maps[c])
    for c, got in back(B.cells(B.product(m, m, ["chrom"], size), ["chrom"], size), maps).items():
        assert np.allclose(got, maps[c] @ maps[c])


def test_row_correlation(given):
    sym, maps, index = given
    whole = back(L.row_correlation(sym, ["chrom"], index), maps)
    for c, got in back(B.cells(B.row_correlation(sym, ["chrom"], index, 16), ["chrom"], 16), maps).items():
        assert np.allclose(got, whole[c], atol=1e-9)


def test_random_walk(given):
    sym, maps, index = given
    whole = back(L.random_walk(sym, ["chrom"], index), maps)
    for c, got in back(B.cells(B.random_walk(sym, ["chrom"], index, size=16), ["chrom"], 16), maps).items():
        assert np.allclose(got, whole[c], atol=2e-6)


def test_balanced(given):
    sym, maps, index = given
    whole = back(L.balanced(sym, ["chrom"], index), maps)
    for c, got in back(B.cells(B.balanced(sym, ["chrom"], index, 1e-7, size=16), ["chrom"], 16), maps).items():
        assert np.allclose(got, whole[c], atol=1e-5)
        filled = maps[c].sum(axis=1) > 0
        assert np.allclose(got.sum(axis=1)[filled], 1, atol=1e-6)


def test_first_component(given):
    sym, maps, index = given
    c = B.row_correlation(sym, ["chrom"], index, 16)
    scores = {(r.chrom, r.bin): r.score for r in B.first_component(c, ["chrom"], index, 16).collect()}
    for chrom, m in maps.items():
        want = L.first_component(L.correlation(m))[0]
        got = np.array([scores[chrom, b] for b in range(len(m))])
        assert np.allclose(got, want, atol=1e-4) or np.allclose(got, -want, atol=1e-4)
