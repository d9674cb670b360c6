import hashlib
import random

import brute
import numpy as np
import pytest

from contactspark.llm import suffix


def run(spark, rows, length=200):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS low", "1 AS doc", "2 AS cuts")
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffix.without_repeats(docs, length).collect()), key=str)


@pytest.mark.parametrize("n,letters", [(1, 3), (2, 1), (60, 2), (900, 3), (700, 1)])
def test_suffix_array_and_prefixes(n, letters):
    data = np.random.default_rng(n).integers(0, letters, n).astype(np.uint8)
    raw = data.tobytes()
    order = suffix.suffix_array(data)
    assert order.tolist() == sorted(range(n), key=lambda i: raw[i:])

    def common(a, b):
        k = 0
        while max(a, b) + k < n and raw[a + k] == raw[b + k]:
            k += 1
        return k

    assert suffix.common_prefixes(data, order).tolist() == [0] + [common(order[i - 1], order[i]) for i in range(1, n)]


def corpus(seed=1):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdéfgh", k=r.randint(2, 9))) for _ in range(300)]
    text = lambda n: " ".join(r.choices(words, k=n))
    shared = [text(60), text(33), text(200), text(25)]
    rows = [(i, text(r.randint(1, 80))) for i in range(20)]
    rows += [(20 + i, text(20) + " " + shared[i % 4] + " " + text(15)) for i in range(24)]
    rows += [(50, "a" * 1500), (51, "ab" * 500), (52, (text(7) + "\n") * 40), (53, shared[2]), (54, shared[2]), (55, None), (56, ""), (None, shared[0]), (57, "x" * 199), (58, "x" * 199)]
    rows += [(60, shared[1] + shared[2][:150]), (60, text(40)), (61, text(40)), (61, text(40))]
    return rows + [rows[0]]


@pytest.mark.parametrize("split", [400, 2])
def test_like_brute_force(spark, monkeypatch, split):
    monkeypatch.setattr(suffix, "SPLIT", split)
    assert run(spark, corpus()) == brute.repeated(corpus())


@pytest.mark.parametrize("split", [400, 7, 1])
def test_one_passage_in_many_documents(spark, monkeypatch, split):
    """Every document has the passage between texts of its own: as many different blocks of one name, and some of them twice."""
    monkeypatch.setattr(suffix, "SPLIT", split)
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdefgh", k=7))
    passage = "".join(r.choices("ijklmnop", k=260))
    rows = [(i, " ".join(word() for _ in range(30)) + passage + " ".join(word() for _ in range(30))) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(3)] + [(-(2**63), passage), (None, passage + "!"), (0, "!" + passage)]
    got = run(spark, rows)
    assert got == brute.repeated(rows)
    assert {n for d, n, *_ in got if d == -(2**63)} == {260}


def test_lists_are_looked_up_in_all(monkeypatch):
    lists = [np.array([[1, 5, 0, 0, 0, 0], [2, 1, 0, 0, 0, 0]]), np.array([[1, 6, 0, 0, 0, 0], [2, 1, 0, 0, 0, 0], [-1, 0, 0, 0, 0, 0]])]
    high, low, count = suffix._distinct(lists)
    assert high.tolist() == [1, 1, 2, 2**64 - 1] and low.tolist() == [5, 6, 1, 0] and count.tolist() == [1, 1, 2, 1]


def test_empty_table(spark):
    assert run(spark, []) == []
