"""Ward's tree by rounds of mutual pairs against merging the closest pair again and again."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from contactspark.operators import trees as W


def plain(rows):
    """[(left, right, size, height)] of greedy agglomeration with Lance-Williams updates of a full table of distances."""
    ids = [i for i, _ in rows]
    x = np.array([v for _, v in rows])
    d = ((x[:, None] - x[None]) ** 2).sum(axis=-1)
    np.fill_diagonal(d, np.inf)
    n, live, out = dict.fromkeys(range(len(ids)), 1), list(range(len(ids))), []
    while len(live) > 1:
        part = d[np.ix_(live, live)]
        a, b = divmod(int(part.argmin()), len(live))
        i, j = sorted((live[a], live[b]), key=lambda k: ids[k])
        height = d[i, j]
        for k in live:
            if k not in (i, j):
                d[i, k] = d[k, i] = ((n[i] + n[k]) * d[i, k] + (n[j] + n[k]) * d[j, k] - n[k] * height) / (n[i] + n[j] + n[k])
        n[i] += n[j]
        live.remove(j)
        out.append((ids[i], ids[j], n[i], height**0.5))
    return out


def labels(merges, ids, k):
    up = {r: left for left, r, _, _ in sorted(merges, key=lambda m: m[3])[: len(ids) - k]}

    def top(i):
        while i in up:
            i = up[i]
        return i

    return {i: top(i) for i in ids}


def run(spark, rows):
    df = spark.createDataFrame(rows, "id long, v array<double>")
    return df, W.ward(df)


@pytest.mark.parametrize("last", [512, 20, 1])
def test_same_tree(spark, sf, monkeypatch, last):
    monkeypatch.setattr(W, "LAST", last)
    table = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").limit(500 if last == 512 else 150).collect()
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in table]
    df, merges = run(spark, rows)
    want = plain(rows)
    got = sorted(((r.left, r.right, r.size, r.height) for r in merges.collect()), key=lambda m: m[:3])
    want = sorted(want, key=lambda m: m[:3])
    assert [m[:3] for m in got] == [m[:3] for m in want] and np.allclose([m[3] for m in got], [m[3] for m in want], rtol=1e-9)
    for k in (1, 2, 10, len(rows)):
        assert {r.id: r.cluster for r in W.cut(merges, df.select("id"), k).collect()} == labels(want, [i for i, _ in rows], k)


def test_equal_rows_and_equal_distances(spark, monkeypatch):
    monkeypatch.setattr(W, "LAST", 4)
    rows = [(i, [0.0, 0.0]) for i in range(40)] + [(100 + i, [float(i % 6), 10.0 + i // 6]) for i in range(36)] + [(300, None), (None, [1.0, 1.0])]
    df, merges = run(spark, rows)
    out = merges.collect()
    assert sorted(r.right for r in out) == [*range(1, 40), *range(100, 136)] and max(r.size for r in out) == 76  # id 0 is the last left
    assert sum(r.height == 0 for r in out) == 39 and max(r.turn for r in out) < 25
    cut = {r.id: r.cluster for r in W.cut(merges, df.where("id < 200").select("id"), 2).collect()}
    assert set(list(cut.values())) == {0, 100} and all(cut[i] == (0 if i < 100 else 100) for i in cut)


def test_one_and_none(spark):
    assert run(spark, [])[1].collect() == [] and run(spark, [(3, [1.0])])[1].collect() == []
    df, merges = run(spark, [(3, [1.0]), (1, [2.0])])
    assert [(r.left, r.right, r.size) for r in merges.collect()] == [(1, 3, 2)] and W.cut(merges, df.select("id"), 5).count() == 2


def test_only_clusters_that_lost_their_nearest_look_again(spark, monkeypatch):
    monkeypatch.setattr(W, "LAST", 60)
    met, whole = [], W.sweep

    def sweep(own, others, *rest):
        met.append(tuple(x.agg(F.sum("n")).first()[0] for x in (own, others)))
        return whole(own, others, *rest)

    monkeypatch.setattr(W, "sweep", sweep)
    r = np.random.default_rng(0)
    run(spark, [(i, r.normal(size=8).tolist()) for i in range(150)])
    assert met[0] == (150, 150) and len(met) > 1 and all(a < b for a, b in met[1:])


def test_a_list_of_nearest_saves_looking_again(monkeypatch):
    """New clusters meet all others; of the rest only those whose list is used up. Looking anew at each loss takes 3 n^2 pairs."""
    met, whole = [], W.Closest.meet

    def meet(self, x, y, state):
        met.append(len(x[0]) * len(y[0]))
        return whole(self, x, y, state)

    monkeypatch.setattr(W.Closest, "meet", meet)
    x = np.random.default_rng(1).normal(size=(700, 64))
    got = sorted(m[1:4] for m in W._finish(np.arange(700), np.ones(700, int), x.copy(), 1))
    assert got == sorted(m[:3] for m in plain([(i, v) for i, v in enumerate(x)])) and sum(met) < 2.4 * 700**2


@pytest.mark.parametrize("shape", ["plain", "offset", "tiny", "copies"])
def test_products_of_short_floats_lose_no_neighbour(shape):
    r = np.random.default_rng(2)
    x = r.normal(size=(900, 12)) * (1e-30 if shape == "tiny" else 1) + (1e6 if shape == "offset" else 0)
    x[:300] = x[0] if shape == "copies" else x[:300]
    n, ids, new = r.integers(1, 9, 900), np.arange(900) * 7, np.arange(900) % 2
    want = n[:, None] * n / (n[:, None] + n) * ((x[:, None] - x[None]) ** 2).sum(axis=-1)
    np.fill_diagonal(want, np.inf)
    reach = np.where(np.arange(900) % 3, np.sort(want, axis=1)[:, 20], -1.0)
    x[5, 3] = np.nan
    want[5], want[:, 5] = np.inf, np.inf
    fold, own, told = W.Closest(), (ids, np.column_stack([x, new]), n), set()
    state = fold.start(own)
    for at in range(0, 900, 300):
        out = fold.meet(own, (ids[at : at + 300], np.column_stack([x, reach])[at : at + 300], n[at : at + 300]), state)
        told |= set(zip((out[0] // 7).tolist(), (out[1] // 7).tolist())) if out else set()
    best, nearest, far, _ = state
    assert np.allclose(far, np.sort(want, axis=1)[:, : W.LIST], rtol=1e-9, atol=0) and np.isinf(best[5])
    some = [i for i in range(0, 900, 29) if i != 5]
    assert all(nearest[i] == min(ids[want[i] == want[i].min()].tolist(), key=lambda k: W._order(int(ids[i]), k)) for i in some)
    i, j = np.nonzero((want <= reach[:, None]) & np.isfinite(want) & (new > 0))
    assert told == set(zip(i.tolist(), j.tolist()))
