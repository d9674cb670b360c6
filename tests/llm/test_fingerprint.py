"""Fingerprints against plain sums, and what they promise: order, insertion, deletion, likeness, neighbours."""

import hashlib
import random

import numpy as np
import pytest

from contactspark.llm import fingerprint as f


def one(text):
    """The vector of a text, member by member, in plain Python."""
    exact, lanes = [0] * f.EXACT, [0] * f.LANES
    for p in text.split("\n"):
        d = hashlib.shake_256(p.encode()).digest(8 * f.EXACT)
        exact = [(e + int.from_bytes(d[8 * i : 8 * i + 8], "little")) % 2**64 for i, e in enumerate(exact)]
        words = [w[i : i + 24] for w in p.split() for i in range(0, len(w), 24)]
        for i in range(0, len(words), 5):
            bits = hashlib.blake2b(" ".join(words[i : i + 5]).encode(), digest_size=f.LANES // 8).digest()
            lanes = [(x + (1 if bits[k // 8] >> (7 - k % 8) & 1 else -1)) % 2**32 for k, x in enumerate(lanes)]
    return np.array([exact], np.uint64), np.array([lanes], np.uint32)


def truth(rows):
    rows = [(d, t or "") for d, t in rows]
    out = []
    for (d, t), (_, u) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        e = t[: len(t) - half] + u[:half]
        a, b, c = one(t), one(e), one(u)
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), *f.written(a), *f.written(b), float(f.likeness(a, b)[0]), float(f.likeness(a, c)[0])))
    return sorted(out, key=str)


def run(spark, rows, buckets=None):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS tie", "2 AS bucket", "3 AS key", "4 AS n_chars")
    return sorted((tuple(r) for r in f.fingerprints(docs, buckets=buckets).collect()), key=str)


def texts(n, seed):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdeéß漢", k=r.randint(1, 9))) for _ in range(400)]
    return ["\n".join(" ".join(r.choices(words, k=r.randint(0, 25))) for _ in range(r.randint(1, 6))) for _ in range(n)]


@pytest.mark.parametrize("buckets", [1, 3, 17, 500])
def test_like_plain_sums(spark, buckets):
    rows = [(3 * i, t) for i, t in enumerate(texts(60, 1))] + [(500, None), (501, ""), (502, "漢" * 500), (503, "\n\n"), (2**53 + 1, "x"), (2**53 + 2, "a " * 30_000 + "\n" + "b" * 1000)]
    random.Random(2).shuffle(rows)
    assert run(spark, rows, buckets) == truth(sorted(rows))


def test_long_chunks(spark, monkeypatch):
    monkeypatch.setattr(f, "CHUNK", 50)
    rows = list(enumerate(texts(25, 3)))
    assert run(spark, rows, 2) == truth(rows)


def test_order_insertion_deletion():
    a, b, extra = "one two\nthree\n\nfour", "four\n\nthree\none two", "five six seven"
    x, y, z = (f.multisets([f.paragraphs(t)]) for t in (a, b, a + "\n" + extra))
    assert f.written(x) == f.written(y) != f.written(z)
    more = f.multisets([[extra]])
    assert f.written(f.insert(x, more)) == f.written(z) and f.written(f.delete(z, more)) == f.written(x)
    assert all((p == q).all() for p, q in zip(f.read(f.written(z)), z))
    assert f.written(x) != f.written(f.multisets([f.paragraphs(a + "\n")])) and f.written(f.multisets([["a"] * 2])) != f.written(f.multisets([["a"]]))


def test_likeness():
    r = random.Random(4)
    words = [f"w{r.randrange(10**6)}" for _ in range(2000)]
    base = [" ".join(words[i : i + 20]) for i in range(0, 2000, 20)]
    for shared in (0, 25, 50, 90, 100):
        other = base[:shared] + [" ".join(f"v{r.randrange(10**6)}" for _ in range(20)) for _ in range(100 - shared)]
        near = float(f.likeness(f.multisets([base]), f.multisets([other]))[0])
        assert abs(near - shared / 100) < 4 / f.LANES**0.5 and (near == 1) == (shared == 100)


def test_repeated_ids_nulls_one_and_none(spark):
    rows = [(None, t) for t in texts(60, 5)] + [(7, t) for t in texts(50, 6)] + [(8, "z"), (8, "z")]
    out = run(spark, rows, 9)
    assert sorted((d is None, d or 0) for d, *_ in out) == sorted((d is None, d or 0) for d, _ in rows)
    assert len({r[3] for r in out if r[0] == 7}) == 50 and out == run(spark, rows[::-1], 4)  # the same neighbours however rows are dealt
    assert run(spark, [(1, "Only\nrow of its kind")]) == truth([(1, "Only\nrow of its kind")])
    assert run(spark, []) == []


def test_neighbours_are_told_apart(spark, sf):
    from contactspark.llm.queries import QUERIES

    out = QUERIES["op13_fingerprints"](spark, sf).where("n_chars >= 200").toPandas()
    assert (out["near_edited"] > out["near_next"]).mean() > 0.97 and out["near_edited"].mean() > 0.4 and out["near_next"].mean() < 0.1
