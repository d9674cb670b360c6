import math
import random
from collections import Counter

import numpy as np

from contactspark.llm import quality, toxicity


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, t in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != t)))
        row = new
    return row[-1]


def test_automaton_like_brute_force():
    r = random.Random(0)
    terms = [("abcab", False, 1), ("bcabcabca", False, 2), ("cab", False, 0), ("aabb", True, 0), ("abcb", False, 1)]
    machine = toxicity.LexiconAutomaton(terms)
    for _ in range(3000):
        word = "".join(r.choices("abcx", k=r.randint(0, 10)))
        found = [(edits(t, word), i) for i, (t, p, k) in enumerate(terms) if not p and edits(t, word) <= k]
        found += [(0, i) for i, (t, p, _) in enumerate(terms) if p and word.startswith(t)]
        assert machine.match(word) == (min(found)[::-1] if found else None)


def test_context():
    reader = toxicity.Reader([("idiot", False, 1)], [4.0])
    hit = lambda text: reader.hits(text)[1]
    assert [h[1:3] for h in hit("You IDIOT, an idi0t!")] == [(0, 0), (0, 1)]
    assert hit('a man said "what an idiot" to all')[0][3] and not hit("what an idiot of a man")[0][3]
    assert hit("you are an idiot")[0][4] and hit("") == [] and hit("clean words only") == []


def labelled(spark, seed=0, n=400):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefghijklm", k=r.randint(3, 8))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        text, toxic, good = [r.choice(words) for _ in range(r.randint(20, 300))], r.random() < 0.3, r.random() < 0.6
        if toxic:
            for _ in range(3):
                text[r.randrange(len(text))] = r.choice(["zqvidiot", "zqvmoron", "zqxxscum"]) + r.choice(["", ".", "!"])
        text = " ".join(text) if good else " ".join(w.upper() + "!!" for w in text)
        docs.append((i, text))
        labels.append((i, int(good), int(toxic)))
    docs += [(None, None), (n, ""), (n + 1, None), (0, docs[0][1]), (n + 2, "word " * 30_000)]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS label", "2 AS score", "3 AS quality")
    return d, spark.createDataFrame(labels + labels[:3] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int"), labels


def test_toxicity_held_out(spark):
    docs, labels, truth = labelled(spark)
    out = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    toxic = {i: t for i, _, t in truth}
    held = [r for r in out if r.doc_id in toxic and r.held_out]
    assert held and all(r.held_out == (toxicity.crc_remainder(r.doc_id, 4) == 2) for r in out if r.doc_id is not None)
    assert np.mean([r.predicted == toxic[r.doc_id] for r in held]) > 0.95
    assert len({r.score for r in out if r.doc_id == 0}) == 1 and Counter(r.predicted for r in out if r.doc_id in (400, 401, None))[1] == 0


def test_quality_held_out(spark):
    docs, labels, truth = labelled(spark, 1)
    out = quality.score(docs, quality.fit(docs, labels)).collect()
    good = {i: q for i, q, _ in truth}
    held = [r for r in out if r.doc_id in good and r.held_out]
    assert held and np.mean([r.predicted == good[r.doc_id] for r in held]) > 0.95
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)


def test_without_labels(spark):
    docs, labels, _ = labelled(spark, 2, 20)
    assert {r.predicted for r in toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).collect()} == {0}
    assert {r.score for r in quality.score(docs, quality.fit(docs, labels.limit(0))).collect()} == {0.5}
    assert toxicity.score(docs.limit(0), toxicity.Model()).count() == 0


def some_bags(r, passages):
    sizes = [r.integers(0, 6, n) for n in passages]
    return [(r.normal(size=(n, quality.N_FEATURES)), r.integers(0, quality.BUCKETS, int(k.sum())).astype(np.int32), k) for n, k in zip(passages, sizes)]


def test_gradient_of_attention():
    r = np.random.default_rng(0)
    model, y = quality.new_model(), np.array([1.0, 0.0, 1.0])
    data = quality.joined(some_bags(r, (1, 4, 2)))

    def loss():
        z, _ = model.bags(*data)
        return np.mean(np.log1p(np.exp(z)) - z * y)

    g = model.gradient(*data, y)
    for name, w in model.weights.items():
        places = [tuple(r.integers(0, s) for s in w.shape) for _ in range(4)] if name != "embed" else [(int(data[1][0]), 3), (int(data[1][-1]), 0)]
        for at in places:
            flat, values = np.atleast_1d(w), []
            for e in (1e-5, -1e-5):
                new = flat.copy()
                new[at or 0] += e
                model.weights[name] = new.reshape(np.shape(w))
                values.append(loss())
            model.weights[name] = w
            assert abs((values[0] - values[1]) / 2e-5 - np.atleast_1d(g[name])[at or 0]) < 1e-6


def plain_score(model, bag):
    """The forward pass in loops."""
    w, (x, buckets, sizes) = model.weights, bag
    codes, marks, at = [], [], 0
    for row, n in zip(x, sizes):
        words = [sum(w["embed"][b][i] for b in buckets[at : at + n]) / max(n, 1) for i in range(quality.EMBED)]
        at += n
        z = [(a - m) / s for a, m, s in zip(row, model.mean, model.scale)] + words
        h = [math.tanh(sum(z[i] * w["encode"][i][j] for i in range(len(z))) + w["encode_0"][j]) for j in range(quality.CODE)]
        t = [math.tanh(sum(h[i] * w["attend"][i][j] for i in range(quality.CODE))) for j in range(quality.GATE)]
        g = [1 / (1 + math.exp(-sum(h[i] * w["gate"][i][j] for i in range(quality.CODE)))) for j in range(quality.GATE)]
        codes.append(h)
        marks.append(sum(a * b * c for a, b, c in zip(t, g, w["weigh"])))
    e = [math.exp(m) for m in marks]
    logit = sum(sum(ei * h[j] for ei, h in zip(e, codes)) / sum(e) * w["score"][j] for j in range(quality.CODE)) + w["score_0"]
    return 1 / (1 + math.exp(-logit))


def test_scores_like_plain_loops():
    r = np.random.default_rng(1)
    model, bags = quality.new_model(), some_bags(r, (1, 3, 5)) + [quality.passages(t) for t in (None, "One two two. One two two. 5%", "word " * 200)]
    model.mean, model.scale, model.weights["score_0"] = r.normal(size=17), r.random(17) + 0.5, np.array(0.3)
    assert np.allclose(model.scores(bags), [plain_score(model, b) for b in bags])


def test_words_tell(spark):
    """Two kinds of words with the same letters: only the embedding can tell them apart."""
    r = random.Random(4)
    good, bad = [["".join(r.sample("abcdefgh", 6)) for _ in range(30)] for _ in range(2)]
    docs, labels = [], []
    for i in range(300):
        y = r.random() < 0.5
        docs.append((i, " ".join(r.choices(good if y else bad, k=60))))
        labels.append((i, int(y)))
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    out = quality.score(d, quality.fit(d, lab)).where("held_out").collect()
    assert np.mean([r.predicted == dict(labels)[r.doc_id] for r in out]) > 0.95


def test_large_ids_beside_nulls(spark):
    big = 2**53 + 1
    docs = spark.createDataFrame([(big, "idiot here", None), (None, None, big), (big + 2, "fine", big)], "doc_id long, text string, other long")
    model = toxicity.Model([("idiot", False, 1)], [6.0], coefficients=[1.0] * 9)
    out = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert set(out) == {big, None, big + 2} and out[big].predicted == 1 and out[big].held_out == (toxicity.crc_remainder(big, 4) == 2)
    left = toxicity.keep_clean(docs, model)
    assert left.schema == docs.schema and {tuple(r) for r in left.collect()} == {(None, None, big), (big + 2, "fine", big)}
    out = {r.doc_id: r for r in quality.score(docs, quality.new_model()).collect()}
    assert set(out) == {big, None, big + 2} and out[big].held_out == (toxicity.crc_remainder(big, 3) == 1)
    assert quality.score(docs.limit(0), quality.new_model()).collect() == [] and toxicity.keep_clean(docs.limit(0), model).collect() == []


def test_every_term_may_be_misspelled():
    counts = [(f"zq{a}{b}xv{c}w", 9, 0, 3.0) for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"]
    terms, weights = toxicity.lexicon(counts)
    assert len(terms) == len(counts) == 512 and all(t[2] == 1 for t in terms)
    terms, _ = toxicity.lexicon([("scum", 9, 0, 3.0), ("insult*", 9, 0, 3.0), ("worthless", 9, 0, 3.0)])
    assert terms == [("scum", False, 0), ("insult", True, 1), ("worthless", False, 2)]


def plain_features(text, terms, weights):
    """The nine figures of a text, each word held against each term by the edit distance."""
    words = (text or "").lower().split()
    strip = [w.strip(toxicity.EDGES) for w in words]
    hits = []
    for i, s in enumerate(strip):
        found = []
        for at, (term, prefix, most) in enumerate(terms):
            if prefix:
                found += [(edits(term, s[:n]), at) for n in range(1, len(s) + 1)]  # some beginning of the word
            else:
                found.append((edits(term, s), at))
            found = [f for f in found if f[0] <= terms[f[1]][2]]
        if found:
            e, at = min(found)
            marks = lambda ws: sum(w.count(q) for w in ws for q in toxicity.QUOTES)
            low, high = max(0, i - toxicity.WINDOW), i + toxicity.WINDOW + 1
            inside = marks(words[low:i]) % 2 == 1 or any(q in words[i][:1] for q in toxicity.QUOTES)
            near = set(strip[low:high])
            hits.append((weights[at], e, (inside and marks(words[i:high]) > 0) or bool(near & toxicity.REPORTING), bool(near & toxicity.ADDRESS), at))
    plain = [h for h in hits if not h[1] and not h[2]]
    total = lambda exact, quoted: math.log1p(sum(h[0] for h in hits if (not h[1]) == exact and h[2] == quoted))
    exact = [h for h in hits if not h[1]]
    return [max((h[0] for h in plain), default=0.0), total(True, False), total(True, True), total(False, False), total(False, True), float(len({h[4] for h in plain}) > 1), min(1.0, 20 * len(exact) / max(1, len(words))), math.log1p(sum(h[3] for h in hits)), float(bool(exact))]


def test_features_like_plain_loops():
    r = random.Random(7)
    terms, weights = [("idiot", False, 1), ("moronic", True, 1), ("worthless", False, 2), ("scum", False, 0), ("trash", False, 1)], [4.0, 3.0, 2.5, 2.0, 1.0]
    words = ["idiot", "idi0t!", "iddiot", "moronical", "morxnic", "worthles", "wrthlss", "scum", "scun", "trash.", "said", "you", '"the', 'end"', "„alt“", "fine", "words", "of", "no", "account"]
    reader = toxicity.Reader(terms, weights)
    for _ in range(200):
        text = " ".join(r.choices(words, k=r.randint(0, 40)))
        assert np.allclose(reader.features(text), plain_features(text, terms, weights)), text


def test_a_text_beyond_the_bytes_is_skipped(spark):
    from contactspark.llm import quality

    rows = [(i, ("good words stand here in order " if i % 2 else "x1 !! zz ") * 3) for i in range(120)] + [(500 + i, "long " * 4000) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(d, d % 2, 0) for d, _ in rows], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels, most_bytes=15_000)
    assert model is not None
    out = quality.score(docs, model).where("doc_id < 500").collect()
    assert sum(r.predicted == r.doc_id % 2 for r in out) >= 115
    assert quality.fit(docs, labels, most_bytes=10) is None
