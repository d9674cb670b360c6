"""The manifest against a plain tree, on sizes around every border of a level and of a block."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from contactspark.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def siblings(tree, at):
    """[(before, after)] of each level."""
    out = []
    for nodes in tree[:-1]:
        low = at // 16 * 16
        out.append((nodes[low:at], nodes[at + 1 : low + 16]))
        at //= 16
    return out


def truth(rows, shown=lambda r: None):
    groups = defaultdict(list)
    for r in rows:
        leaf = h(*map(field, r))
        other = shown(r)
        groups[r[1]].append((r[0] is not None, r[0] or 0, leaf, leaf if other is None else h(*map(field, (*r[:4], other))), r[0]))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(groups[s])]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for at, (_, _, leaf, seen, doc_id) in enumerate(sorted(groups[s])):
            path = siblings(trees[s], at) + siblings(top, k)
            folded = seen
            for before, after in path:
                folded = h(*before, folded, *after)
            proof = h(*(x for before, after in path for x in before + after))
            out.append((doc_id, leaf, trees[s][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return sorted(out, key=str)


def lowered(r):
    tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
    return r[4].translate({c: c + 32 for c in range(65, 91)}) if tampered and r[4] is not None else None


def run(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS tree", "1 AS n", "2 AS at", "'y' AS leaf", "3 AS level")
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    shown = docs.withColumn("__shown", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, low))
    return sorted((tuple(r) for r in merkle.manifest(docs, shown).collect()), key=str)


def test_sizes_of_every_kind(spark):
    sizes = {"one": 1, "two": 2, "sixteen": 16, "seventeen": 17, "many": 257, "é": 300, "block": 4097, None: 33}
    rows = [(1000 * k + i, s, None if i % 7 == 0 else "en", None if i % 5 == 0 else i, [f"Text {i} É", "", None, "lower only"][i % 4]) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    out = run(spark, rows)
    assert out == truth(rows, lowered)
    assert any(r[-1] for r in out) and not all(r[-1] for r in out)


def test_many_groups_repeats_and_null_ids(spark):
    rows = [(i % 40, f"s{i % 300}", "en", 3, f"T{i % 9}") for i in range(900)] + [(None, "s1", None, None, None)] * 20 + [(2**53 + 1, "S1", "", 0, "\n:-")] * 3
    assert run(spark, rows) == truth(rows, lowered)


def test_partial_parents_meet_over_rounds(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 1)
    rows = [(i, "a" if i % 3 else "b", "en", 1, f"t{i}") for i in range(700)]
    assert run(spark, rows) == truth(rows, lowered)


def test_children_in_any_order_and_a_full_memory(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(merkle, "MOST_OPEN", 3)
    leaves = [h(str(i)) for i in range(300)]
    rows = [("t", 300, 1, i // 16, [None] * (i % 16) + [leaves[i]]) for i in sorted(range(300), key=lambda i: h("o", str(i)))]
    links, state = {}, rows
    for _ in range(60):
        batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in state], t) for k, t in enumerate(merkle.NODE_SCHEMA.types[1:])], merkle.NODE_SCHEMA.names[1:])
        out = list(merkle.rows_of(merkle.combine(iter([batch]))))
        links |= {(r[3], r[4]): r[5] for r in out if r[0] == merkle.LINK}
        roots = [r for r in out if r[0] == merkle.ROOT]
        state = sorted((r[1:] for r in out if r[0] == merkle.PARTIAL), key=lambda r: r[:4])
        if roots:
            break
    tree = levels(leaves)
    assert roots[0][5] == tree[-1]
    assert all(kids == tree[level - 1][16 * at : 16 * at + 16] for (level, at), kids in links.items()) and len(links) == 19 + 2 + 1


@pytest.mark.parametrize("rows", [[], [(5, "a", None, None, "Only")]])
def test_none_and_one(spark, rows):
    out = run(spark, rows)
    assert out == truth(rows, lowered)
    if rows:
        assert out[0][1] == out[0][2] == out[0][3] and out[0][4] == h("")
