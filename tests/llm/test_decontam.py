import random

import pytest

from contactspark.llm import decontam


def least(item, text):
    """Least edit distance of the item to any substring, by the plain recurrence."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != t)))
        row = new
    return min(row)


def edited(r, text, n):
    t = list(text)
    for _ in range(n):
        i = r.randrange(len(t))
        kind = r.randrange(3)
        if kind == 0:
            t[i] = r.choice("abcdefghé")
        elif kind == 1:
            del t[i]
        else:
            t.insert(i, r.choice("abcdefgh"))
    return "".join(t)


@pytest.mark.parametrize("seed", range(4))
def test_matcher_like_brute_force(seed):
    r = random.Random(seed)
    items = [(i, decontam.normalise("".join(r.choices("abcdefgh  ", k=r.randint(20, 90))))) for i in range(12)]
    matcher = decontam.Matcher(items, 0.1)
    for _ in range(40):
        _, item = r.choice(items)
        text = decontam.normalise("".join(r.choices("abcdefgh  ", k=50)) + edited(r, item, r.randint(0, 12)) + "".join(r.choices("abcdefgh ", k=60)))
        got = {i: d for i, d, *_ in matcher.find(text)}
        want = {i: d for i, t in items if (d := least(t, text)) <= int(0.1 * len(t))}
        assert got == want
        for i, d, a, b, n in matcher.find(text):
            assert least(dict(items)[i], text[a:b]) == d and n == len(dict(items)[i])


def test_table(spark):
    item = "the quick brown fox jumps over the lazy dog and runs away from it all"
    docs = [(1, f"so, THE quick  brown-fox jumps over the lazy dog; and runs\naway from it all! yes"), (2, None), (3, ""), (None, item), (4, "the quick brown fix jumps over the lazy dog and runs away from it oll"), (5, "clean text of no account"), (2**53 + 1, "cut short."), (1, item), (6, "x" * 100_000 + item)]
    bench = [(7, item), (8, "Short!"), (9, None), (None, item), (10, item), (11, " ?")]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id")
    b = spark.createDataFrame(bench, "item_id long, text string").selectExpr("*", "2 AS doc_id")
    for block in (10, 8_000_000):
        got = sorted(((r.doc_id, r.item_id, r.distance) for r in decontam.leaks(d, b, block_bytes=block).collect()), key=str)
        assert got == sorted([(x, i, e) for x, e in ((1, 0), (None, 0), (4, 2), (1, 0), (6, 0)) for i in (7, 10)] + [(2**53 + 1, 8, 0)], key=str)
    left = decontam.decontaminate(d, b)
    assert left.columns == d.columns and sorted(r.doc_id for r in left.collect()) == [2, 3, 5]
    assert decontam.leaks(d, b.limit(0)).count() == 0 and decontam.decontaminate(d.limit(0), b).count() == 0


def test_other_columns_come_back_as_they_are(spark):
    rows = [(2**53 + 1, "fine", None, [1, None]), (None, "has an item here", 2**53 + 1, None), (3, None, 2**53 + 1, []), (3, "", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id long, item array<long>")
    bench = spark.createDataFrame([(1, "An  item"), (2, "another")], "item_id long, text string")
    for block in (5, 8_000_000):
        left = decontam.decontaminate(docs, bench, block_bytes=block)
        assert left.schema == docs.schema and sorted(map(str, left.collect())) == sorted(str(r) for r in docs.collect() if r.text != "has an item here")


def test_short_items_are_whole_words(spark):
    matcher = decontam.Matcher([(1, "the"), (2, decontam.normalise("東京"))], 0.06)
    found = lambda t: [h[0] for h in matcher.find(decontam.normalise(t))]
    assert found("Weather report, other theory") == [] and found("weather: THE report") == [1] and found("the") == [1]
    assert found("wether the") == [1] and found("lathe the") == [1] and found("私は東京に住む") == [2]
    docs = spark.createDataFrame([(1, "weather report"), (2, "in the end")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "the"), (8, "!")], "item_id long, text string")
    assert [r.doc_id for r in decontam.decontaminate(docs, items).collect()] == [1]


def test_blocks_one_after_another(spark):
    docs = spark.createDataFrame([(i, f"some words before passage number {i} of the exam and after") for i in range(9)], "doc_id long, text string")
    items = spark.createDataFrame([(i, f"passage number {i} of the exam") for i in range(7)], "item_id long, text string")
    whole = sorted(tuple(r) for r in decontam.leaks(docs, items).collect())
    assert sorted(tuple(r) for r in decontam.leaks(docs, items, block_bytes=40).collect()) == whole and len(whole) > 7
    assert [r.doc_id for r in decontam.decontaminate(docs, items, block_bytes=40).collect()] == [r.doc_id for r in decontam.decontaminate(docs, items).collect()]
