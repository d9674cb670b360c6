from fractions import Fraction
from math import floor

import numpy as np
import pytest

from contactspark.llm import topk


def run(spark, rows, k=5, every=3):
    v = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS v", "2 AS id", "3 AS length"), 64)
    return sorted(tuple(r) for r in topk.top_k(v, v.where(f"id % {every} = 0"), k).collect())


def truth(rows, k=5, every=3):
    good = [(i, [floor(64 * Fraction(float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q % every == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q and len(b) == len(a))[:k]
            out += [(q, r, i, max(-topk.MOST, min(topk.MOST, -s))) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("chunk", [4096, 23])
def test_like_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(topk, "CHUNK", chunk)
    monkeypatch.setattr(topk, "BLOCK", chunk // 2)
    monkeypatch.setattr(topk, "STEP", 16)
    r = np.random.default_rng(0)
    rows = [(i, (r.normal(size=24) * r.exponential() * (1 + np.arange(24) % 5)).tolist()) for i in range(160)]
    rows += [(200 + i, rows[7][1]) for i in range(30)] + [(300, None), (301, []), (303, [1.0, None]), (306, [float("nan")] * 24), (309, [float("inf")] * 24), (None, rows[0][1]), (312, [0.5, -0.25]), (315, [0.0] * 24)]
    assert run(spark, rows) == truth(rows)


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(3, [1.0])]) == []


def test_large_components(spark):
    rows = [(0, [1.0, -2.0]), (1, [200_000.0, 0.0]), (2, [3e9, -1e9]), (3, [-7e18, 1.5]), (4, [3e38, 3e38]), (5, [3.1e38, 3e38]), (6, [-3e38, 1.0]), (9, [0.3, 4e12]), (12, [0.0, 0.0])]
    assert run(spark, rows, 5, 1) == truth(rows, 5, 1)


def test_rows_that_repeat(spark):
    rows = [(0, [1.0, 0.0])] + [(1, [0.5, 0.0])] * 3 + [(2, [0.5, 1.0])] * 2
    assert run(spark, rows) == [(0, 1, 1, 2048), (0, 2, 1, 2048), (0, 3, 1, 2048), (0, 4, 2, 2048), (0, 5, 2, 2048)]
