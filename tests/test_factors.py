"""Factor models, cell features and co-assay codes against plain numpy."""

import numpy as np
import pytest

import __spark_entry__ as entry
from contactspark.operators import factors as K
from contactspark.plans import fixtures as X


def frame(spark, m, name="f"):
    i, j = np.nonzero(m)
    return spark.createDataFrame([(int(a), f"{name}{b}", float(m[a, b])) for a, b in zip(i, j)], "id long, feature string, v double")


def dense(df, n):
    rows = {r.id: r.v for r in df.collect()}
    width = max((len(v) for v in rows.values()), default=0)
    return np.array([rows.get(i, [0.0] * width) for i in range(n)])


def same_up_to_signs(got, want, tolerance=1e-6):
    assert got.shape == want.shape
    assert np.allclose(np.abs(got), np.abs(want), atol=tolerance * max(1e-12, np.abs(want).max()))


def test_model_of_some_rows_places_others(spark):
    r = np.random.default_rng(0)
    m = r.poisson(1.0, (30, 40)).astype(float)
    table = frame(spark, m)
    model = K.svd_model(table.where("id < 18"), 4)
    _, _, vt = np.linalg.svd(m[:18], full_matrices=False)
    same_up_to_signs(dense(K.folded(table, model), 30), m @ vt[:4].T, 1e-6)
    odd = spark.createDataFrame([(1, "unknown", 5.0), (2, "f0", None)], "id long, feature string, v double")
    assert {x.id: x.v for x in K.folded(odd, model).collect()} == {1: [0.0] * 4, 2: [0.0] * 4}


def plain_features(pixels, ids, k, good=None, least=5):
    n, parts = len(ids), []
    for off in (True, False):
        places = {}
        for (c, a, b), v in pixels.items():
            if (a != b) == off:
                places.setdefault((a, b), {})[c] = v
        kept = sorted(p for p, cells in places.items() if len(cells) > min(least, n - 2))
        if not kept:
            continue
        m = np.array([[places[p].get(c, 0.0) for p in kept] for c in ids], float)
        filled = m[m > 0]
        parts.append(np.minimum(m, filled.mean() + 10 * filled.std()))
    size = min([k, *(p.shape[1] - 2 for p in parts)])
    total = sum(p.sum(axis=1) for p in parts)[:, None]
    parts = [p / np.where(total > 0, total, 1) for p in parts]
    fit = np.ones(n, bool) if good is None or (~good).sum() <= 10 else good
    return np.hstack([p @ np.linalg.svd(p[fit], full_matrices=False)[2][:size].T for p in parts])


def pixel_frame(spark, pixels):
    return spark.createDataFrame([(c, "a", x, y, v) for (c, x, y), v in pixels.items()], "cell_id long, chrom string, bin1 long, bin2 long, count long")


def random_pixels(n, bins, seed, share=0.6):
    r = np.random.default_rng(seed)
    return {(c, a, b): int(r.integers(1, 9)) for c in range(n) for a in range(bins) for b in range(a, bins) if r.random() < share}


@pytest.mark.parametrize("bad", [0, 8, 14])
def test_cell_features(spark, bad):
    pixels = random_pixels(30, 9, 1)
    good = np.arange(30) >= bad
    quality = spark.createDataFrame([(i, bool(g)) for i, g in enumerate(good)], "cell_id long, good boolean")
    got = dense(K.cell_features(pixel_frame(spark, pixels), 4, quality), 30)
    same_up_to_signs(got, plain_features(pixels, list(range(30)), 4, good), 1e-4)
    assert got.shape[1] == 8


def test_cell_features_of_odd_tables(spark):
    pixels = {(c, 0, 1): 3 for c in range(3)}
    assert {r.id: r.v for r in K.cell_features(pixel_frame(spark, pixels), 4).collect()} == {0: [1.0, 0, 0], 1: [0, 1.0, 0], 2: [0, 0, 1.0]}
    diagonal = {k: v for k, v in random_pixels(12, 9, 2).items() if k[1] == k[2]}
    same_up_to_signs(dense(K.cell_features(pixel_frame(spark, diagonal), 3), 12), plain_features(diagonal, list(range(12)), 3), 1e-5)
    rare = {(c, c, c + 1): 2 for c in range(8)}  # no pixel that enough cells have
    assert {r.id: r.v for r in K.cell_features(pixel_frame(spark, rare), 3).collect()} == {c: [] for c in range(8)}
    assert K.cell_features(pixel_frame(spark, pixels).limit(0), 3).collect() == []


def test_sizes():
    assert K.feature_size(620, {"a": 249.0, "b": 243.0}, 10**6) == {"a": int(310 / 492 * 249) + 1, "b": int(310 / 492 * 243) + 1}
    assert K.feature_size(100, {"a": 249.0}, 50) == {"a": 41} and sum(K.feature_size(10**5, {"a": 100.0, "b": 100.0}, 1).values()) <= 2402


def test_cross_covariance(spark):
    r = np.random.default_rng(4)
    x = r.poisson(0.8, (25, 30)) * r.random((25, 30))
    y = np.where(r.random((25, 12)) < 0.5, x[:, :12] + 0.2 * r.normal(size=(25, 12)), 0)
    fit = K.CrossCovariance(frame(spark, x, "x"), frame(spark, y, "y"), 3, extra=9, rounds=12)
    cx, cy = x - x.mean(axis=0), y - y.mean(axis=0)
    u, s, vt = np.linalg.svd(cx.T @ cy, full_matrices=False)
    assert np.allclose(fit.values, s[:3], rtol=1e-8)
    left, right = ({q.feature: q.v for q in t.collect()} for t in (fit.left, fit.right))
    same_up_to_signs(np.array([left.get(f"x{j}", [0] * 3) for j in range(30)]), u[:, :3])
    same_up_to_signs(np.array([right.get(f"y{j}", [0] * 3) for j in range(12)]), vt[:3].T)
    codes = {q.id: (q.x, q.y) for q in fit.codes.collect()}
    same_up_to_signs(np.array([codes[i][0] for i in range(25)]), cx @ u[:, :3])
    same_up_to_signs(np.array([codes[i][1] for i in range(25)]), cy @ vt[:3].T)
    both = np.array([np.dot(*codes[i]) for i in range(25)])  # signs go together on both sides
    assert both.sum() == pytest.approx(s[:3].sum(), rel=1e-6)


def test_cross_covariance_of_odd_tables(spark):
    a = frame(spark, np.ones((3, 2)))
    assert [sorted(t.collect()) for t in (K.CrossCovariance(a, a, 2).left,)] == [[]]  # constant features have no covariance
    apart = K.CrossCovariance(a, a.selectExpr("id + 10 AS id", "feature", "v"), 2)
    assert apart.codes.collect() == [] and len(apart.values) == 0


def test_coassay_query(spark, sf):
    pixels, signals = X.pixels(spark, sf).collect(), X.signals(spark, sf).collect()
    per = {}
    for r in signals:
        per.setdefault(r.signal, []).append(r.value)
    ids = sorted({r.cell_id for r in pixels} & {r.cell_id for r in signals})

    def matrix(entries):
        names = sorted({f for _, f, _ in entries})
        m = np.zeros((len(ids), len(names)))
        for c, f, v in entries:
            if c in ids:
                m[ids.index(c), names.index(f)] = v
        return m - m.mean(axis=0)

    x = matrix([(r.cell_id, (r.chrom, r.bin1, r.bin2), np.log1p(r["count"])) for r in pixels])
    y = matrix([(r.cell_id, (r.signal, r.chrom, r.bin), (r.value - np.mean(per[r.signal])) / np.std(per[r.signal])) for r in signals])
    u, s, vt = np.linalg.svd(x.T @ y, full_matrices=False)
    got = {r.id: (r.x, r.y) for r in entry.queries()["h11_coassay_codes"](spark, sf).collect()}
    assert sorted(got) == ids
    same_up_to_signs(np.array([got[i][0] for i in ids]), x @ u[:, :4], 1e-5)
    same_up_to_signs(np.array([got[i][1] for i in ids]), y @ vt[:4].T, 1e-5)
