"""Queries without SQL against plain numpy over the same tables."""

import numpy as np
import pytest

import __spark_entry__ as entry
from contactspark.plans import fixtures as X


def cells(spark, sf):
    """{(cell, chromosome): full map}, {(cell, chromosome, bin1, bin2): count}."""
    maps, pixels = {}, {}
    for r in X.pixels(spark, sf).collect():
        m = maps.setdefault((r.cell_id, r.chrom), np.zeros((X.N_BINS, X.N_BINS)))
        m[r.bin1, r.bin2] += r["count"]
        m[r.bin2, r.bin1] += r["count"]
        pixels[(r.cell_id, r.chrom, r.bin1, r.bin2)] = float(r["count"])
    return maps, pixels


def walked(m, restart=0.5):
    """Where a random walk with restart ends, solved as linear equations."""
    p = m - np.diag(np.diag(m))
    p += np.diag((p.sum(axis=0) == 0).astype(float))
    p /= p.sum(axis=0)
    q = (1 - restart) * np.linalg.inv(np.eye(len(m)) - restart * p)
    np.fill_diagonal(q, 0)
    return q


def same_scores(got, matrix, k):
    u, s, _ = np.linalg.svd(matrix, full_matrices=False)
    want = np.abs(u[:, :k] * s[:k])
    assert np.allclose(np.abs(got), want, rtol=1e-3, atol=1e-3 * want.max())


def test_random_walk_pairs(spark, sf):
    maps, _ = cells(spark, sf)
    ends = {k: walked(m) for k, m in maps.items()}
    rows = entry.queries()["n9_random_walk_pairs"](spark, sf).collect()
    assert len(rows) == len(maps) * sum(X.N_BINS - d for d in range(1, 11))
    assert all(r.v == pytest.approx(ends[(r.cell_id, r.chrom)][r.bin1, r.bin2], abs=1e-4) for r in rows)


def test_cell_features(spark, sf):
    from test_factors import plain_features, same_up_to_signs

    _, pixels = cells(spark, sf)
    ids = sorted({k[0] for k in pixels})
    off = np.array([sum(1 for k in pixels if k[0] == c and k[2] != k[3]) for c in ids])
    got = {r.id: r.v for r in entry.queries()["n15_cell_features"](spark, sf).collect()}
    assert sorted(got) == ids
    named = {(c, (chrom, a), (chrom, b)): v for (c, chrom, a, b), v in pixels.items()}
    same_up_to_signs(np.array([got[i] for i in ids]), plain_features(named, ids, 4, off >= 0.9 * off.mean()), 1e-3)


def test_projection(spark, sf):
    rows = X.table(spark, sf, "embeddings").collect()
    m = np.array([r.embedding for r in rows], float)
    got = {r.id: r.v for r in entry.queries()["n22_projection"](spark, sf).collect()}
    m -= m.mean(axis=0)
    u, s, _ = np.linalg.svd(m, full_matrices=False)
    mine = np.array([got[r.vec_id] for r in rows])
    assert np.allclose(np.linalg.norm(mine, axis=0), s[:3], rtol=1e-9)
    assert np.allclose(mine.T @ mine, np.diag(np.diag(mine.T @ mine)), atol=1e-6 * s[0] ** 2)


def test_density_sums_and_landmarks(spark, sf):
    rows = X.table(spark, sf, "embeddings").collect()
    x = np.array([r.embedding for r in rows], float)
    got = {r.id: np.array(r.v) for r in entry.queries()["n21_scaling"](spark, sf).collect()}
    assert sorted(got) == sorted(r.vec_id for r in rows)
    mine = np.array([got[r.vec_id] for r in rows])
    u, s, _ = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    if len(rows) <= 1000:  # all are landmarks: classical scaling of distances is the projection
        assert np.allclose(np.abs(mine), np.abs(u[:, :2] * s[:2]), rtol=1e-3, atol=1e-3 * s[0])


def test_quantiles_and_members(spark, sf):
    rows = entry.queries()["n28_calibrated_boundaries"](spark, sf).collect()
    assert rows and all(r.members >= 0 and 0 <= r.bin < X.N_BINS for r in rows) and sum(r.members for r in rows) > 0


def component(m):
    """First component of the correlation of the observed over expected map, by definition, on rows with enough filled cells."""
    filled = np.flatnonzero(m.any(axis=1))
    good = [i for i in range(len(m)) if (m[i] != 0).sum() > 0.01 * (filled[-1] - filled[0] + 1)]
    m = m[np.ix_(good, good)]
    root = np.sqrt(np.where(m.sum(axis=1) > 0, m.sum(axis=1), 1))
    v = m / root / root[:, None]
    out = np.zeros_like(v)
    for d in range(len(v)):
        for i in range(len(v) - d):
            on = [v[k, k + d] for k in range(len(v) - d)]
            count = sum(x != 0 for x in on)
            if count:
                out[i, i + d] = out[i + d, i] = v[i, i + d] / (sum(on) / count)
    np.fill_diagonal(out, 1)
    c = np.nan_to_num(np.corrcoef(out))
    np.fill_diagonal(c, 1)
    c = c - c.mean(axis=0)
    axis = np.linalg.svd(c)[2][0]
    axis = axis * np.sign(axis[np.abs(axis).argmax()])
    return dict(zip(good, c @ axis))


def half(maps, chrom, k):
    return sum(m for (cell, c), m in maps.items() if c == chrom and cell % 2 == k)


def test_component_pearson(spark, sf):
    maps, _ = cells(spark, sf)
    for r in entry.queries()["c2_component_pearson"](spark, sf).collect():
        a, b = (component(half(maps, r.chrom, k)) for k in (0, 1))
        both = sorted(a.keys() & b.keys())
        assert r.pearson == pytest.approx(abs(np.corrcoef([a[i] for i in both], [b[i] for i in both])[0, 1]), abs=1e-4)


def test_compartment_tracks(spark, sf):
    rows = entry.queries()["l3_compartment_tracks"](spark, sf).toPandas()
    for _, one in rows.groupby("cell_id"):
        raw = one["raw"].to_numpy()
        assert np.allclose(one["z"], (raw - raw.mean()) / raw.std(), atol=2e-5) or np.allclose(one["z"], (raw - raw.mean()) / raw.std(ddof=1), atol=2e-5)
        order = one.sort_values("raw")
        assert (np.diff(order["quantile"]) >= -1e-9).all() and 0 <= order["quantile"].min() and order["quantile"].max() <= 1
    assert rows.groupby("cell_id")["chrom"].nunique().max() == 3


@pytest.mark.parametrize("name", ["n22_umap", "n22_tsne"])
def test_layout_queries(spark, sf, name):
    out = entry.queries()[name](spark, sf).toPandas()
    assert sorted(out["id"]) == sorted(r.vec_id for r in X.table(spark, sf, "embeddings").collect()) and np.isfinite(out[["x", "y"]].to_numpy()).all()
