"""Long texts, empty tables, large ids beside nulls, and columns with clashing names, for every operator on documents."""

import random
import zlib

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from contactspark.llm import minhash, mixing, sharding, suffix

BIG = 2**53 + 1


@pytest.fixture(scope="module")
def rows():
    r = random.Random(2)
    words = ["".join(r.choices("abcdefgh", k=r.randint(2, 8))) for _ in range(500)]
    long = r.choices(words, k=30_000)
    other = list(long)
    other[7_000:7_050] = [f"changed{i}" for i in range(50)]
    return [(BIG, " ".join(long)), (None, " ".join(long)), (BIG + 2, " ".join(other)), (BIG + 4, "x " * 40_000), (3, ""), (4, None)]


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS size", "2 AS rep", "3 AS low", "'en' AS lang", "'s' AS source", "4 AS n_tokens")


def test_shards(spark, rows):
    out = {r.doc_id: r for r in sharding.byte_shards(table(spark, rows), 3).collect()}
    assert {d: (r.size, r.text_crc32) for d, r in out.items()} == {d: (len(t or "") + 1, zlib.crc32((t or "").encode())) for d, t in rows}


def test_near_duplicates(spark, rows):
    out = {r.doc_id: tuple(r) for r in minhash.near_duplicates(table(spark, rows), 3, 85).collect()}
    sizes = {d: n for d, n, _ in brute.near([r for r in rows if r[0] is not None], 3, 85)}
    assert {d: r[1] for d, r in out.items()} == sizes | {None: sizes[BIG]}
    assert out[BIG + 2][2] == BIG and out[BIG + 4][2] == BIG + 4 and out[None][2] is None and out[None][3]


def test_repeats(spark, rows):
    out = {r.doc_id: r for r in suffix.without_repeats(table(spark, rows), 200).collect()}
    assert out[BIG].n_removed == out[BIG].n_bytes == len(rows[0][1]) and out[None].n_spans == 1
    changed = out[BIG + 2]
    assert changed.n_spans == 2 and 0 < changed.n_bytes - changed.n_removed <= 11 * 50 and bytes(changed.kept).count(b"changed") >= 49
    assert out[BIG + 4].n_removed == 80_000 and out[3].n_bytes == out[4].n_bytes == 0


def test_mixture(spark, rows):
    docs = mixing.with_domain(table(spark, rows))
    plan = mixing.plan(docs, spark.createDataFrame([], "path string, weight long"), budget=F.col("all_tokens"), max_epochs=1)
    out = mixing.mix(docs, plan).collect()
    assert len(out) == len(rows) and {r.copies for r in out if r.text} == {1}
    assert sum(r.tokens for r in plan.collect()) == sum(len((t or "").split()) for _, t in rows)


def test_pipeline_of_nothing(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
