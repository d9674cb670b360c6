import random
import zlib

import brute
import numpy as np
import pytest

import corpus_pipeline
from contactspark.llm import toxicity
from test_decontam import least
from contactspark.llm.decontam import normalise

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(8)
    words = ["".join(r.choices("abcdefghijklmnop", k=r.randint(3, 9))) for _ in range(400)]
    text = lambda n: " ".join(r.choices(words, k=n))
    items = [text(30) for _ in range(5)]
    docs, labels = [], []
    for i in range(300):
        t, toxic = text(r.randint(5, 150)), r.random() < 0.3
        if toxic:
            t += " zqvidiot you zqvmoron " + text(3)
        if i % 17 == 0:
            t = text(10) + " " + items[i % 5] + " " + text(10)
            toxic = False
        docs.append((i, t, r.choice(["en", "de", None]), f"src{r.randrange(5)}", len(t)))
        labels.append((i, 1, int(toxic)))
    for i in range(300, 360):
        of = docs[r.randrange(300)]
        w = of[1].split()
        if i % 2 and len(w) > 60:
            w[r.randrange(len(w))] = "changed"
        docs.append((i, " ".join(w), of[2], of[3], of[4]))
    docs += [(400, None, "en", "src1", None), (401, "", None, None, 0), (402, "word " * 20_000, "en", "src2", 100_000)]
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, items


def rows(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_stages_like_plain_versions(spark, folder):
    at, items = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near-duplicates", "decontamination", "mixture", "token-ids"]

    model = toxicity.fit(docs, spark.read.parquet(f"{at}/labels.parquet"))
    reader = toxicity.Reader(model.terms, model.weights)
    clean = stage["toxicity"](spark, docs, at).persist()
    want = {i: t for i, t in rows(docs).items() if model.score(np.array([reader.features(t)]))[0] < 0.3}
    assert clean.columns == docs.columns and rows(clean) == want
    assert all("zqv" not in (t or "") for t in want.values()) and len(want) > 200

    unique = stage["near-duplicates"](spark, clean, at).persist()
    kept = {d for d, _, c in brute.near(list(rows(clean).items()), 5, 80) if d == c}
    assert unique.columns == docs.columns and set(rows(unique)) == kept

    without = stage["decontamination"](spark, unique, at).persist()
    norm = [normalise(x) for x in items]
    short = {i: t for i, t in rows(unique).items() if len(t or "") < 5000}
    free = {i for i, t in short.items() if all(least(x, normalise(t)) > int(0.06 * len(x)) for x in norm)}
    assert without.columns == docs.columns and set(rows(without)) - {402} == free and len(free) < len(short)

    mixed = stage["mixture"](spark, without, at).persist()
    count = lambda d: sum(len((t or "").split()) for t in d.values())
    have, got = rows(without), rows(mixed)
    assert mixed.columns == docs.columns and got.items() <= have.items() and mixed.count() == len(got)
    assert 0.8 * count(have) <= count(got) <= count(have)

    from tokenizers import Tokenizer

    tokenizer, start, ids_of = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for i, t in sorted(got.items()):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        ids_of.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in stage["token-ids"](spark, mixed, at).collect()) == ids_of
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, at).collect()) == ids_of


def test_mixture_keeps_columns_of_any_name(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", "doc_id AS Domain", "1 AS __domain", "2 AS __copies", "3 AS copies")
    out = corpus_pipeline.mixture(spark, docs, sf)
    assert out.columns == docs.columns and 0 < out.where("Domain = doc_id").count() == out.count() < docs.count()
