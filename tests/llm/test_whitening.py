"""Whitening against numpy's eigenvectors of the covariance, and its contract on odd rows."""

from fractions import Fraction
from math import floor

import numpy as np
import pytest

from contactspark.llm import whitening


def run(spark, rows, k=8):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS x", "2 AS id", "3 AS n")
    out = whitening.whiten(df.select(F.col("vec_id").alias("id"), whitening.whole_numbers("embedding").alias("x")), k)
    return out.toPandas()


def numbers(rows):
    return np.array([[floor(1024 * Fraction(float(np.float32(c)))) + 100_000 for c in v] for _, v in rows], dtype=object)


def compare(out, good, k=8, tolerance=1e-7):
    x = numbers(good)
    n, sums = len(x), x.sum(axis=0)
    centred = ((n * x - sums) / n).astype(float)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:k]
    assert set(out["n"]) == {n} and len(out) == n * len(order)
    deviation = {}
    for (vec_id, _), row in zip(good, x):
        deviation.setdefault(vec_id, []).append(min(2**63 - 1, sum(int(n * c - s) ** 2 for c, s in zip(row, sums))))
    for c, e in enumerate(order, 1):
        mine = out[out["component"] == c]
        assert np.allclose(mine["explained"], values[e] / values.sum(), rtol=1e-10)
        want = centred @ vectors[:, e] / np.sqrt(values[e])
        got = mine.set_index("vec_id")["whitened"].loc[[i for i, _ in good]].to_numpy() if mine["vec_id"].is_unique else None
        if got is not None:
            sign = np.sign(got @ want)
            assert np.abs(sign * got - want).max() < tolerance
            assert {i: [v] for i, v in zip(mine["vec_id"], mine["deviation"])} == deviation
    w = out.pivot_table(index=out.groupby("component").cumcount(), columns="component", values="whitened").to_numpy()
    assert abs(np.abs(w.T @ w / n - np.outer(w.mean(axis=0), w.mean(axis=0)) - np.eye(len(order))).max() - out["identity_error"].iloc[0]) < 1e-9
    assert out["identity_error"].max() < 1e-9


def test_given_table(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    rows = [(r.vec_id, list(r.embedding)) for r in table]
    compare(run(spark, rows), rows)


def test_wide_vectors_take_several_passes_and_new_starts(spark):
    r = np.random.default_rng(1)
    base = r.normal(size=(600, 300)) * (1 + 4 * np.exp(-np.arange(300) / 9))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    compare(run(spark, rows), rows)
    x = base - base.mean(axis=0)
    v = x.T @ x / len(x)
    for span in (40, 160):
        values, vectors, passes = whitening.leading(lambda q: v @ q, 300, 8, span=span)
        truth, exact = np.linalg.eigh(v)
        assert passes > 3 and np.allclose(values, truth[::-1][:8], rtol=1e-12)
        assert np.abs(np.abs(np.sum(vectors * exact[:, ::-1][:, :8], axis=0)) - 1).max() < 1e-12


def test_odd_rows(spark):
    r = np.random.default_rng(2)
    good = [(i, r.normal(size=5).tolist()) for i in range(40)] + [(None, r.normal(size=5).tolist())]
    bad = [(100, None), (101, []), (102, [1.0, None, 0.0, 0.0, 0.0]), (103, [float("nan")] * 5), (104, [float("inf")] * 5), (105, [1.0, 2.0])]
    out = run(spark, good + bad)
    assert set(out["component"]) == {1, 2, 3, 4, 5} and len(out) == 5 * 41 and out["vec_id"].isna().sum() == 5
    assert not set(out["vec_id"].dropna()) & {i for i, _ in bad}
    repeated = [(i % 7, good[i % 7][1]) for i in range(30)]
    out = run(spark, repeated)
    assert (out.groupby("vec_id").size() == [25, 25, 20, 20, 20, 20, 20]).all()  # five rows for ids 0 and 1, four for the others
    compare(out, repeated, 5)


def test_rows_that_span_less(spark):
    flat = [(i, [float(i % 5), float(i % 5), 1.0]) for i in range(20)]
    out = run(spark, flat)
    assert set(out["component"]) == {1} and np.allclose(out["explained"], 1)
    assert len(run(spark, [(1, [1.0, 2.0])])) == 0 and len(run(spark, [(1, [1.0, 2.0])] * 3)) == 0 and len(run(spark, [])) == 0


@pytest.mark.parametrize("scale", [3e6, 3e37])
def test_large_components(spark, scale):
    r = np.random.default_rng(3)
    rows = [(i, (scale * r.normal(size=3)).tolist()) for i in range(12)]
    out = run(spark, rows)
    assert len(out) == 36 and np.isfinite(out["whitened"]).all()
    if scale < 1e7:
        compare(out, rows, tolerance=1e-6)
    else:
        assert set(out["deviation"]) == {2**63 - 1}
