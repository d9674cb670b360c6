"""Figures and hashed words of passages, by plain loops."""

import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from contactspark.llm import quality

ODD, WHOLE = 0x9E3779B97F4A7C15, 1 << 64


def kind(byte):
    groups = (range(65, 91), range(97, 123), range(48, 58), b" ", b".", b",", b"!?", b"|", b"*", b"%$&#")
    return next((i for i, g in enumerate(groups) if byte in g), 10 if byte < 128 else 11)


def plain_passages(text):
    words = (text or "").split()
    if not words:
        return [[0.0] * 17], [], [0]
    single = [(zlib.crc32(w.lower().encode("utf-8", "replace")) + 1) * ODD % WHOLE for w in words]
    after = np.append(np.array(single[1:], np.uint64), 0).astype(np.uint64).tolist()
    buckets = [b >> 52 for s, a in zip(single, after) for b in (s, (s ^ a >> 7) * ODD % WHOLE)]
    runs = [tuple(single[i : i + 6]) for i in range(len(words) - 5)] if len(words) > 5 else [tuple(single)] if len(words) == 6 else []
    times = Counter(runs)
    figures = []
    for at in range(0, len(words), 80):
        g = words[at : at + 80]
        raw = " ".join(g).encode("utf-8", "replace")
        counts = Counter(map(kind, raw))
        again = sum(times[runs[i]] > 1 for i in range(at, min(at + 80, len(runs))))
        figures.append([counts[k] / len(raw) for k in range(12)] + [len(set(g)) / len(g), sum(a == b for a, b in zip(g, g[1:])) / len(g), math.log(len(raw) / len(g)), len(g) / 80, again / len(g)])
    return figures, buckets, [2 * len(words[at : at + 80]) for at in range(0, len(words), 80)]


def odd_texts():
    r = random.Random(3)
    letters = "abAB12  \t\n\x1c\x85  ΣσςΑİıßÉ'́​.,!?|*%$&#\ud800\U0001f600"
    words = ["Word", "word", "ΑΣ", "Σ", "Α'Σ", "x1", "end."]
    lengths = [1, 2, 5, 6, 7, 79, 80, 81, 159, 160, 161, 400]
    return [None, "", " \n ", *("".join(r.choices(letters, k=r.randint(1, 900))) for _ in range(60)), *(" ".join(r.choices(words, k=n)) for n in lengths), *("same " * n for n in lengths)]


def test_passages_like_plain_loops():
    for text in odd_texts():
        figures, buckets, sizes = quality.passages(text)
        want = plain_passages(text)
        assert buckets.tolist() == want[1] and sizes.tolist() == want[2] and buckets.dtype == np.int32
        assert figures.shape == (len(sizes), quality.N_FEATURES) and np.allclose(figures, want[0], rtol=1e-13, atol=0), text


def test_no_words_are_kept():
    """Texts full of new words leave nothing in the worker."""
    r = random.Random(5)
    texts = [" ".join(str(r.getrandbits(80)) for _ in range(500)) for _ in range(60)]
    quality.passages(texts[0])
    tracemalloc.start()
    for text in texts:
        quality.passages(text)
    kept, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert kept < 500_000


def test_a_passage_does_not_touch_the_next():
    """Words with huge numbers in one document leave all digits of the following ones; documents without words stand between them."""
    model = quality.new_model()
    model.weights["embed"][:8] *= 1e12
    r = np.random.default_rng(2)
    bag = lambda low, high, n: (r.normal(size=(len(n), quality.N_FEATURES)), r.integers(low, high, sum(n)).astype(np.int32), np.array(n))
    bags = [quality.passages(""), bag(0, 8, [4, 0, 6]), quality.passages(None), bag(8, 4096, [160, 0, 7]), bag(8, 4096, [1]), quality.passages("")]
    _, s = model.bags(*quality.joined(bags))
    rows, want = s["z"][:, quality.N_FEATURES :], []
    for _, buckets, sizes in bags:
        for part in np.split(buckets, np.cumsum(sizes)[:-1]):
            want.append([math.fsum(model.weights["embed"][part, i]) / max(len(part), 1) for i in range(quality.EMBED)])
    assert rows.shape == (len(want), quality.EMBED) and np.allclose(rows, want, rtol=1e-10, atol=1e-15)
    assert np.isfinite(model.scores(bags)).all() and model.scores(bags[:1]) == model.scores(bags[2:3])


def test_texts_at_once_as_one_by_one():
    """The same numbers however many texts are read together; short ones go together, long ones alone."""
    texts = odd_texts()
    for many in (2, 9, len(texts)):
        for i in range(0, len(texts), many):
            some = texts[i : i + many]
            for a, b in zip(quality.all_passages(some), quality.joined([quality.passages(t) for t in some])):
                assert a.dtype == b.dtype and a.shape == b.shape and (a == b).all()
    sizes = lambda *texts: quality.at_once(pa.array(texts, pa.string()))
    long = "w " * quality.AT_ONCE
    assert sizes(*["a b"] * 50, long) == 50 and sizes(long, "a") == 1 and sizes(None, "", long) == 2 and sizes(None) == 1


def test_scores_do_not_hang_on_neighbours(spark):
    """Long and short, empty and null texts in one batch get the scores that each has alone."""
    texts = ["w%d " % i * quality.AT_ONCE for i in range(2)] + [t for t in odd_texts() if not t or "\ud800" not in t]
    rows = [(i, t) for i, t in enumerate(texts[2:] + texts[:1] + texts[2:5] + texts[1:2])]
    model = quality.new_model()
    out = {r.doc_id: r for r in quality.score(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), model).collect()}
    for i, t in rows:
        bag = quality.passages(t)
        assert out[i].passages == len(bag[0]) and abs(out[i].score - model.scores([bag])[0]) < 1e-12
