import random

import brute
import pytest

from contactspark.llm import minhash

SCHEMA = "doc_id long, text string"


def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS rep", "1 AS a", "2 AS digest", "3 AS bucket")


def corpus(seed=4, copies=25):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [[r.choice(words) for _ in range(n)] for n in (120, 80, 300, 40)]
    rows = []
    for i in range(copies):
        for b in base:
            t = list(b)
            for _ in range(r.randint(0, max(1, len(t) // 40))):
                t[r.randrange(len(t))] = r.choice(words)
            rows.append(" ".join(t))
    rows += [" ".join(r.choice(words) for _ in range(60)) for _ in range(30)]
    rows += ["one two", "One TWO", "one", "", "  \n", "É é", "é É", "a b c", "A B c"] * 2
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_like_brute_force(spark, words, percent, monkeypatch):
    monkeypatch.setattr(minhash, "CHUNK", 8)
    rows = corpus()
    out = minhash.near_duplicates(docs(spark, rows), words, percent).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == brute.near(rows, words, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_nulls_repeats_and_empty(spark):
    rows = [(None, "a b c d"), (1, None), (2, "a b c d"), (2, "a b c d"), (3, "A b c d"), (None, None)]
    out = sorted((tuple(r) for r in minhash.near_duplicates(docs(spark, rows), 3, 85).collect()), key=str)
    assert out == sorted([(None, 2, None, True), (1, 0, 1, True), (2, 2, 2, True), (2, 2, 2, True), (3, 2, 2, False), (None, 0, None, True)], key=str)
    assert minhash.near_duplicates(docs(spark, []), 3, 85).collect() == []
    kept = minhash.drop_near_duplicates(docs(spark, rows), 3, 85)
    assert kept.columns == ["doc_id", "text", "rep", "a", "digest", "bucket"] and kept.count() == 4


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40) if i != 20] + [(100, 100)], "a long, b long")
    out = {r.node: r.component for r in minhash.components(edges).collect()}
    assert out == {i: 0 if i <= 20 else 21 for i in range(41)}


def test_rows_of_one_id_go_by_their_own_text(spark):
    rows = [(1, "a b c d e f"), (5, "a b c d e f"), (5, "quite another text of six"), (5, "quite another text of six"), (6, "Quite another text of six")]
    kept = minhash.drop_near_duplicates(docs(spark, rows), 3, 85)
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, "a b c d e f"), (5, "quite another text of six")]
