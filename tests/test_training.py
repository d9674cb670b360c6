"""Training by passes over a table: gradients against differences, results against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from contactspark.operators import linalg as L
from contactspark.operators import neural as H
from contactspark.operators import training as T
from contactspark.operators.tables import materialise


def check_gradients(losses, w, a):
    for k, (_, g) in enumerate(losses(w, a)):
        for name, value in w.items():
            shape = np.shape(value)
            for at in [np.unravel_index(i, shape) if shape else () for i in np.random.default_rng(1).integers(0, max(1, np.size(value)), 4)]:
                sides = []
                for e in (1e-6, -1e-6):
                    new = np.array(value, float)
                    new[at] += e
                    sides.append(losses(w | {name: new}, a)[k][0])
                assert (sides[0] - sides[1]) / 2e-6 == pytest.approx(float(np.asarray(g[name])[at]), rel=1e-4, abs=1e-5), (k, name, at)


@pytest.mark.parametrize("linear", [True, False])
@pytest.mark.parametrize("widths", [[6, 3], [6, 5, 2], [6, 5, 4, 2]])
def test_gradients_of_the_auto_encoder(linear, widths):
    model = H.TiedAutoEncoder(widths, linear)
    r = np.random.default_rng(0)
    w = {k: v + 0.1 * r.normal(size=v.shape) for k, v in model.start().items()}
    check_gradients(model.losses, w, {"v": r.normal(size=(7, 6))})


def test_gradients_of_the_scorer():
    model = H.Scorer(3, 5, 2, code=4, heads=2, width=3)
    r = np.random.default_rng(0)
    w = {k: v + 0.1 * r.normal(size=v.shape) for k, v in model.start().items()}
    a = {"cell_v": r.normal(size=(5, 3)), "a_v": r.normal(size=(5, 5)), "b_v": r.normal(size=(5, 5)), "side": r.normal(size=(5, 2)), "label": np.array([1, 0, 1, 0, 0])}
    check_gradients(model.losses, w, a)


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(400, 4)) @ r.normal(size=(4, 10)) + 0.3 * r.normal(size=(400, 10))
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(5)
    return materialise(df, "test-rows"), x


def rest(x, k):
    """Mean squared error of the k principal components."""
    c = x - x.mean(axis=0)
    s = np.linalg.svd(c, compute_uv=False)
    return (s[k:] ** 2).sum() / x.size


@pytest.mark.parametrize("batch", [0, 16])
def test_linear_codes_are_as_good_as_principal_components(rows, monkeypatch, batch):
    monkeypatch.setattr(T, "DIRECT", 2)  # sums of tasks on the way
    table, x = rows
    model = H.TiedAutoEncoder([10, 4], linear=True)
    weights, history = T.train(table, model.start(), model.losses, 30 if batch else 120, rate=0.01 if batch else 0.05, batch=batch)
    assert history[-1].losses[0] == pytest.approx(rest(x, 4), rel=0.02) and history[0].losses[0] > 2 * history[-1].losses[0]
    out = model.encoded(table, weights).toPandas().set_index("id").loc[range(400)]
    assert out["error"].mean() == pytest.approx(history[-1].losses[0], rel=1e-9)
    assert np.allclose(np.array(out["v"].tolist()), x @ weights["w0"] + weights["b0"])


def test_a_step_is_that_of_the_whole_table(rows):
    table, x = rows
    model = H.TiedAutoEncoder([10, 6, 3])
    start = model.start(2)
    weights, history = T.train(table, start, model.losses, 3, rate=0.02)
    plain, adam = T.flat(start), T.Adam(len(T.flat(start)), 0.02)
    for _ in range(3):
        (loss, g), = model.losses(T.shaped(plain, start), {"v": x})
        plain = adam.step(plain, T.flat(g) / len(x))
    assert np.allclose(T.flat(weights), plain) and len(history) == 4


def test_deep_codes_begin_as_components_and_improve(rows):
    table, x = rows
    model = H.TiedAutoEncoder([10, 8, 3])
    mean, axes = L.principal_axes(table, 8)
    assert np.allclose(mean, x.mean(axis=0)) and np.allclose(np.abs(axes), np.abs(np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][:8].T))
    start = model.start(axes=axes)
    assert np.allclose(start["w0"], axes)
    _, history = T.train(table, start, model.losses, 25, rate=0.01, batch=16, patience=10)
    assert min(r.losses[0] for r in history) < 0.7 * history[0].losses[0]


def test_held_out_rows_measure_only_and_stop(rows):
    table, x = rows
    some = materialise(table.withColumn("held", F.col("id") % 4 == 0), "test-held")
    model = H.TiedAutoEncoder([10, 4], linear=True)
    for batch, rounds in ((16, 60), (0, 200)):
        weights, history = T.train(some, model.start(), model.losses, rounds, rate=0.05, batch=batch, held="held", patience=4)
        out = x[::4]
        assert all(r.rows == 300 for r in history) and len(history) < rounds
        assert model.losses(weights, {"v": out})[0][0] / len(out) == pytest.approx(min(r.losses[0] for r in history), rel=1e-9)


def test_no_rows(spark):
    model = H.TiedAutoEncoder([3, 2])
    none = spark.createDataFrame([], "id long, v array<double>")
    weights, history = T.train(none, model.start(), model.losses, 5)
    assert history == [] and weights.keys() == model.start().keys() and model.encoded(none, weights).collect() == []
    assert H.standardised(none).collect() == [] and L.principal_axes(none, 2)[1].shape == (0, 0)


def test_standardised(spark):
    df = spark.createDataFrame([(1, [1.0, 5.0]), (2, [3.0, 5.0]), (3, None)], "id long, v array<double>")
    assert sorted((r.id, [round(v, 6) for v in r.v]) for r in H.standardised(df).collect()) == [(1, [-0.267261, 0.707107]), (2, [1.336306, 0.707107]), (3, [-1.069045, -1.414214])]


def test_balanced_losses_agree(spark, sf):
    out = entry.queries()["h8_balanced_losses"](spark, sf).collect()
    assert len(out) > 5 and all(abs(r.agreement - 1) < 0.05 for r in out) and len({round(r.share, 6) for r in out}) > 3


def test_codes_query(spark, sf):
    out = entry.queries()["h1_tied_codes"](spark, sf).toPandas()
    raw = np.array(spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()["embedding"].tolist(), float)
    x = (raw - raw.mean(axis=0)) / raw.std(axis=0)
    assert len(out) == len(x) and {len(v) for v in out["v"]} == {8} and out["error"].mean() < 1.05 * rest(x, 8)
