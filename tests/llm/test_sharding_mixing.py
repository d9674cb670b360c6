import random
import zlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from contactspark.llm import mixing, sharding


def test_byte_shards(spark):
    rows = [(i, "é" * (i * 7 % 53)) for i in range(400)] + [(5, "x")] * 3 + [(None, None), (None, ""), (9, "long " * 2000)]
    out = sharding.byte_shards(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS part", "2 AS size", "3 AS row"), 16).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in out if r.doc_id is not None) == sorted((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows if d is not None)
    out.sort(key=lambda r: r.start_byte)
    ids = [-1 if r.doc_id is None else r.doc_id for r in out]
    assert ids == sorted(ids) and [r.shard for r in out] == sorted(r.shard for r in out)
    assert all(b.start_byte == a.start_byte + a.size for a, b in zip(out, out[1:]))
    total, top = sum(r.size for r in out), max(r.size for r in out)
    for s in range(16):
        mine = [r for r in out if r.shard == s]
        assert [r.slot for r in mine] == list(range(len(mine)))
        assert abs(sum(r.size for r in mine) - total / 16) <= top
    assert sharding.byte_shards(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def mixed(spark, rows, budget, epochs, weights=()):
    docs = spark.createDataFrame(rows, "doc_id long, domain string, lang string, source string, text string").selectExpr("*", "1 AS budget", "2 AS tokens", "3 AS weight")
    w = spark.createDataFrame(list(weights), "path string, weight long")
    plan = mixing.plan(docs, w, budget=F.lit(budget), max_epochs=epochs)
    return {tuple(r[c] for c in mixing.LEVELS): r for r in plan.collect()}, mixing.mix(docs, plan)


def test_shortage_stays_among_siblings(spark):
    rows = [(i, "web", "en", "a", "w " * 10) for i in range(2)] + [(10 + i, "web", "en", "b", "w " * 10) for i in range(30)] + [(100 + i, "books", "en", "c", "w " * 10) for i in range(40)]
    plan, out = mixed(spark, rows, 400, 1)
    got = {k[2]: v.budget for k, v in plan.items()}
    assert got == {"a": 20, "b": 180, "c": 200}  # a lacks 80, which its sibling takes
    plan, out = mixed(spark, rows, 680, 1)
    assert {k[2]: v.budget for k, v in plan.items()} == {"a": 20, "b": 300, "c": 360}  # both web leaves are full: the rest goes up
    taken = out.groupBy("source").agg(F.sum("copies").alias("n")).collect()
    assert {r.source: r.n for r in taken} == {"a": 2, "b": 30, "c": 36}


def test_epochs_weights_nulls(spark):
    rows = [(i, None, "en", "s", "one two three") for i in range(7)] + [(8, "web", None, None, None), (None, "web", "x", "y", "a b"), (9, "web", "x", "y", "a b"), (9, "web", "x", "y", "a b"), (11, "web", "x", "z", "")]
    plan, out = mixed(spark, rows, 60, 3, [("(none)", 3), ("web", 1)])
    assert plan[("(none)", "en", "s")].budget == 45 and plan[("(none)", "en", "s")].epochs == 2
    rows_out = out.collect()
    assert sum(r.copies for r in rows_out if r.source == "s") == 15 and {r.copies for r in rows_out if r.source == "s"} == {2, 3}
    assert [r.copies for r in rows_out if r.doc_id == 8] == [0] and plan[("web", "x", "y")].budget == 15
    assert {r.copies for r in rows_out if r.source == "y"} <= {2, 3} and len(rows_out) == len(rows)
    assert mixed(spark, [], 10, 1)[1].count() == 0


@pytest.mark.parametrize("budget", [1, 100, 977, 1500])
def test_prefix_by_buckets(spark, budget):
    rows = [(i, "d", "l", "s", "w " * (i % 4)) for i in range(1000)]
    _, out = mixed(spark, rows, budget, 1)
    chosen = [r for r in out.collect() if r.copies]
    tokens = sum(r.doc_id % 4 for r in chosen)
    assert min(budget, 1500) <= tokens < budget + 3


def share(budget, nodes):
    """{name: tokens}: shares by weight, the full ones fixed and the rest shared again, until none is over; largest fractions last."""
    got, live = {n: Fraction(0) for n in nodes}, {n for n, (w, c) in nodes.items() if w > 0}
    left = Fraction(min(budget, sum(nodes[n][1] for n in live)))
    while live:
        part = {n: left * nodes[n][0] / sum(nodes[m][0] for m in live) for n in live}
        full = {n for n in live if part[n] >= nodes[n][1]}
        got |= {n: Fraction(nodes[n][1]) for n in full} if full else part
        left -= sum(nodes[n][1] for n in full)
        live = live - full if full else set()
    out = {n: int(x) for n, x in got.items()}
    over = min(budget, sum(c for w, c in nodes.values() if w > 0)) - sum(out.values())
    for n in sorted(got, key=lambda n: (out[n] - got[n], n))[:over]:
        out[n] += 1
    return out


def down(budget, leaves, weights, path=()):
    """Budgets of the leaves {(domain, lang, source): capacity} below ``path``, by recursion."""
    if path in leaves:
        return {path: budget}

    def room(p):
        if weights.get("/".join(p), 1) <= 0:
            return 0
        return leaves[p] if p in leaves else sum(room(c) for c in {k[: len(p) + 1] for k in leaves if k[: len(p)] == p})

    below = {k[: len(path) + 1] for k in leaves if k[: len(path)] == path}
    parts = share(budget, {p: (weights.get("/".join(p), 1), room(p)) for p in below})
    return {k: v for p in below for k, v in down(parts[p], leaves, weights, p).items()}


def test_budgets_of_random_trees(spark):
    r = random.Random(3)
    for case in range(5):
        leaves = {(r.choice("ab"), r.choice("xyz"), r.choice("pqrs")): r.choice([0, 1, 7, 90, 400, 10**12]) for _ in range(r.randint(1, 9))}
        paths = {"/".join(k[:d]) for k in leaves for d in (1, 2, 3)}
        weights = {p: r.choice([0, 1, 2, 3, 7]) for p in sorted(paths) if r.random() < 0.6}
        budget = r.choice([0, 1, 99, 100, 401, 3 * 10**12 + 1])
        table = spark.createDataFrame([(*k, c) for k, c in leaves.items()], "domain string, lang string, source string, tokens long")
        named = spark.createDataFrame(list(weights.items()), "path string, weight long")
        got = {tuple(x[c] for c in mixing.LEVELS): x.budget for x in mixing.allocate(table, named, F.lit(budget), mixing.LEVELS, 1).collect()}
        assert got == down(budget, leaves, weights)
        live = sum(c for k, c in leaves.items() if all(weights.get("/".join(k[:d]), 1) > 0 for d in (1, 2, 3)))
        assert sum(got.values()) == min(budget, live)


def test_shut_branches_lose_nothing(spark):
    rows = [(i, "web", "en", "a", "w " * 10) for i in range(40)] + [(100 + i, "web", "en", "b", "w " * 10) for i in range(40)] + [(200 + i, "books", "en", "c", "w " * 10) for i in range(40)]
    plan, _ = mixed(spark, rows, 400, 1, [("web/en/a", 0)])
    assert {k[2]: v.budget for k, v in plan.items()} == {"a": 0, "b": 200, "c": 200}
    plan, _ = mixed(spark, rows, 100, 1, [("web/en", 0)])
    assert {k[2]: v.budget for k, v in plan.items()} == {"a": 0, "b": 0, "c": 100}
    plan, _ = mixed(spark, [(i, "d", "l", "pqr"[i % 3], "w " * 10) for i in range(60)], 100, 1)
    assert sorted(v.budget for v in plan.values()) == [33, 33, 34]


def test_columns_of_any_name(spark):
    rows = spark.createDataFrame([(i, "en", f"s{i % 3}", "web", "some words here", i, i, i) for i in range(30)], "doc_id long, lang string, source string, domain string, text string, __epochs long, __cut long, __leaf_lang long")
    plan = mixing.plan(rows, spark.createDataFrame([], "path string, weight long"), budget=F.expr("all_tokens div 2"), max_epochs=1)
    out = mixing.mix(rows, plan)
    assert out.columns == [*rows.columns, "copies"] and out.where("copies > 0").count() == 15 and out.where("__cut = doc_id AND __epochs = doc_id").count() == 30
