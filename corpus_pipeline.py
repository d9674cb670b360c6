"""Training-data pipeline: toxicity, near duplicates, benchmark decontamination, mixture, packed token ids.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; stages are written as Parquet in the
shared folder and read again, so a lost executor costs the running stage at most.

Null and empty texts are kept by every stage (they have no hits, no shingles, no items, no words; in the mixture they follow
their neighbours in the seeded order, and a leaf without any token goes) and end with the end id only. Rows without doc_id pass the first four stages. Further
columns stay up to the last stage, whatever their names. Of rows that repeat an id and a text one is kept. Empty tables give
no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactspark.llm import decontam, minhash, mixing, tokens, toxicity
from contactspark.llm.common import documents, materialise, small_batches

#: Not expressible in SQL (learned scores, edit distances, a tokenizer); tests compare with plain versions.
ORACLE_SQL = None

# The mixture's tree weights (other nodes weigh 1), its share of the tokens left, and its seed.
MIX_WEIGHTS = [("web", 2), ("web/en", 2), ("books/en", 2), ("code/en", 2)]
MIX_BUDGET, MIX_SEED = "all_tokens * 9 div 10", 11


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.3."""
    small_batches(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model, 0.3)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least id, of each group linked by five-word shingles at a similarity of 0.8 or more."""
    small_batches(spark)
    return minhash.drop_near_duplicates(docs, words=5, percent=80)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its error budget."""
    small_batches(spark)
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A token-prefix of one seeded epoch of each domain, language and source, nine tenths of all tokens in sum."""
    own = next((c for c in docs.columns if c.lower() == "domain"), None)  # a column of that name is kept aside
    aside, copies = f"domain_{uuid.uuid4().hex}", f"copies_{uuid.uuid4().hex}"
    named = mixing.with_domain(docs.withColumnRenamed(own, aside) if own else docs)
    weights = spark.createDataFrame(MIX_WEIGHTS, "path string, weight long")
    plan = mixing.plan(named, weights, budget=F.expr(MIX_BUDGET), max_epochs=1, seed=MIX_SEED)
    kept = mixing.mix(named, plan, seed=MIX_SEED, copies=copies).where(F.col(copies) > 0).drop("domain")
    return (kept.withColumnRenamed(aside, own) if own else kept).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed ids, written and read back: (doc_id, start, n_tokens, ids_crc32)."""
    import public_tokenizers

    small_batches(spark)
    return tokens.written(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("near-duplicates", without_near_duplicates),
    ("decontamination", without_leaks),
    ("mixture", mixture),
    ("token-ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
