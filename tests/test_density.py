"""Densities by series over boxes: the same as direct sums, and what is sent doesn't grow as the rows do."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from contactspark.operators import grid
from contactspark.operators import linalg as L

FIELDS = "id long, x double, y double"


def frame(spark, x, extra=()):
    return spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)] + list(extra), FIELDS)


def direct(x, at):
    """Sums over ``x`` at the points ``at``."""
    cov, h2 = np.cov(x.T), len(x) ** (-1 / 3)
    d = at[:, None] - x[None]
    return np.exp(-np.einsum("ijk,kl,ijl->ij", d, np.linalg.inv(cov), d) / 2 / h2).sum(axis=1) / (len(x) * 2 * np.pi * h2 * np.sqrt(np.linalg.det(cov)))


def cloud(kind, n, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 2)) @ [[2, 1], [0, 0.3]] + [100, -7]
    if kind == "one place":
        x[: n // 3] = x[0]
    if kind == "far rows":
        x[: n // 20] += 30 * r.standard_cauchy(size=(n // 20, 2))
    return x


@pytest.mark.parametrize("kind", ["cloud", "one place", "far rows"])
def test_like_direct_sums(spark, monkeypatch, kind):
    monkeypatch.setattr(grid, "BLOCK", 64)
    x = cloud(kind, 1500)
    out = {r.id: r.density for r in L.density(frame(spark, x)).collect()}
    assert sorted(out) == list(range(1500))
    assert np.allclose([out[i] for i in range(1500)], direct(x, x), rtol=1e-11, atol=0)


def test_odd_rows(spark):
    """Rows without id count for the bandwidth only, rows with a null coordinate not at all; rows of one id are summed up."""
    x = cloud("cloud", 300)
    extra = [(None, 101.0, -7.0), (700, None, 1.0), (701, 1.0, None), (5, 99.0, -7.0)]
    out = {r.id: r.density for r in L.density(frame(spark, x, extra)).collect()}
    seen = np.vstack([x, [[101.0, -7.0], [99.0, -7.0]]])
    cov, h2 = np.cov(seen.T), len(seen) ** (-1 / 3)
    kernel = lambda a: np.exp(-np.einsum("ij,jk,ik->i", a - with_id, np.linalg.inv(cov), a - with_id) / 2 / h2).sum() / (len(seen) * 2 * np.pi * h2 * np.sqrt(np.linalg.det(cov)))
    with_id = np.delete(seen, 300, axis=0)
    want = {i: kernel(x[i]) for i in range(300)}
    want[5] += kernel(seen[301])
    assert out.keys() == want.keys() and all(out[i] == pytest.approx(want[i], rel=1e-11) for i in want)
    line = frame(spark, [(i, 1.0) for i in range(4)], [(None, 9.0, 1.0), (9, None, 1.0)])
    assert sorted(L.density(line).collect(), key=str) == sorted([(i, None) for i in range(4)] + [(None, None)], key=str)
    assert L.density(frame(spark, [(1.0, 2.0)])).collect() == [(0, None)] and L.density(spark.createDataFrame([], FIELDS)).collect() == []


def test_what_meets_does_not_grow_with_the_rows(spark, monkeypatch):
    """Boxes send their sums, 6 kB at most, and a block meets the boxes near by."""
    seen = []

    def sweep(own, others, fold, schema, pairs=None):
        bytes_sent = others.agg(F.sum(F.length("v"))).first()[0]
        met = pairs.groupBy("a").count().agg(F.max("count")).first()[0] if pairs else own.count()
        seen.append((bytes_sent, met))
        return grid.sweep(own, others, fold, schema, pairs)

    monkeypatch.setattr(L, "sweep", sweep)
    monkeypatch.setattr(grid, "BLOCK", 128)
    for n in (8_000, 64_000):
        assert L.density(frame(spark, cloud("one place", n))).count() == n
    (small, few), (large, many) = seen
    assert large < 5 * small < 5 * 16 * 8_000 and few <= 49 and many <= 49


def test_blocks_apart(spark, monkeypatch):
    """A block has rows of one g only, and a g that most rows have is cut into many."""
    monkeypatch.setattr(grid, "BLOCK", 16)
    rows = spark.range(0, 700, 1, 5).selectExpr("id", "array(cast(id AS double)) AS v", "IF(id % 4 = 0, id % 40, 7L) AS g")
    blocks = []
    for r in grid.packed(rows, apart=True).collect():
        ids, v, g = grid._unpacked(r["n"], r["width"], r["ids"], r["v"], r["g"])
        assert len(set(g.tolist())) == 1 and len(ids) <= 16 and (v[:, 0] == ids).all()
        blocks.append((r["block"], int(g[0]), ids.tolist()))
    assert len({b for b, _, _ in blocks}) == len(blocks) and [g for _, g, _ in sorted(blocks)] == sorted(g for _, g, _ in blocks)
    assert sorted(i for *_, ids in blocks for i in ids) == list(range(700))
