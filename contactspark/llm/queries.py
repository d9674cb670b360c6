"""The corpus operators as registered queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactspark.llm import decontam, fingerprint, licenses, merkle, minhash, mixing, quality, sharding, suffix, tokens, topk, toxicity, whitening
from contactspark.llm.common import documents


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir), licenses.known_digests(spark))


def sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.byte_shards(documents(spark, sf_dir), 16)


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mixing.with_domain(documents(spark, sf_dir))
    weights = spark.createDataFrame(mixing.WEIGHTS, "path string, weight long")
    plan = mixing.plan(docs, weights, budget=F.expr("all_tokens * 6 div 10"), max_epochs=mixing.EPOCHS, seed=mixing.SEED)
    out = mixing.mix(docs.withColumn("n_tokens", mixing.word_count(F.col("text"))).drop("text"), plan, seed=mixing.SEED)
    level = lambda c: F.coalesce(F.col(c), F.lit(mixing.NONE)).alias(c)
    return out.select("doc_id", "domain", level("lang"), level("source"), "n_tokens", "copies")


def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.written(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), words=3, percent=85)


def repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffix.without_repeats(documents(spark, sf_dir), 200)
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def best_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 64)
    return topk.top_k(vectors, vectors.where("id % 20 = 0"), 20)


def good_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.score(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return merkle.manifest(docs, docs.withColumn("__shown", F.when(tampered, lowered)))


def whitened(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return whitening.whiten(rows.select(F.col("vec_id").alias("id"), whitening.whole_numbers("embedding").alias("x")), 8)


def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": decontamination,
    "op2_exact_top_k": best_products,
    "op3_license_scan": license_scan,
    "op4_byte_shards": sharded,
    "op5_token_ids": token_ids,
    "op6_toxicity": toxic,
    "op7_near_duplicates": near_duplicates,
    "op8_quality": good_text,
    "op9_repeated_passages": repeated_passages,
    "op10_mixture": mixed,
    "op11_merkle_manifest": merkle_manifest,
    "op12_whitening": whitened,
    "op13_fingerprints": document_fingerprints,
}

_FIELD = "coalesce(strlen({0}) || ':' || {0}, '-')"

ORACLE_SQL: dict[str, str] = {
    "op2_exact_top_k": """
WITH good AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM good q JOIN good c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 20""",
    "op3_license_scan": licenses.oracle(),
    "op4_byte_shards": """
WITH steps AS (SELECT list(c ORDER BY i) AS steps FROM (SELECT i, list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c FROM range(256) r(i))),
bytes AS (SELECT doc_id, list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::UBIGINT)) AS b FROM documents),
sized AS (SELECT doc_id, len(b)::BIGINT AS size, xor(list_reduce(b, lambda c, y: xor(c >> 8, steps[(xor(c, y) & 255)::INT + 1])), 4294967295::UBIGINT)::BIGINT AS text_crc32 FROM bytes, steps),
placed AS (SELECT *, (sum(size) OVER o - size)::BIGINT AS start_byte, row_number() OVER o AS r, sum(size) OVER ()::BIGINT AS total FROM sized WINDOW o AS (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING)),
cut AS (SELECT *, ((2 * start_byte + size) * 16 // (2 * total))::INT AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY r) - 1 AS slot, NULL::INT AS grown_shard, start_byte FROM cut""",
    "op7_near_duplicates": """
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, ways.b FROM reach JOIN ways ON ways.a = reach.r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY 1) LEFT JOIN sizes USING (doc_id)""",
    "op9_repeated_passages": """
WITH hexed AS (SELECT doc_id, row_number() OVER () AS id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT id, h, unnest(range(0, len(h) // 2 - 199, 1000)) AS c FROM hexed WHERE len(h) >= 400),
pieces AS (SELECT id, c, substring(h, 2 * c + 1, 2398) AS s FROM starts),
places AS (SELECT id, c, s, unnest(range(least(1000, len(s) // 2 - 199))) AS q FROM pieces),
marked AS (SELECT id, c + q AS p, md5(substring(s, 2 * q + 1, 400)) AS m FROM places),
again AS (SELECT id, p FROM (SELECT *, count(*) OVER (PARTITION BY m) AS n FROM marked) WHERE n > 1),
runs AS (SELECT id, p, sum(CASE WHEN p <= before + 200 THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY p) AS g FROM (SELECT *, lag(p) OVER (PARTITION BY id ORDER BY p) AS before FROM again)),
spans AS (SELECT id, min(p) AS low, max(p) + 200 AS high FROM runs GROUP BY id, g),
gaps AS (SELECT id, coalesce(lag(high) OVER (PARTITION BY id ORDER BY low), 0) AS a, low AS b FROM spans UNION ALL SELECT id, max(high), NULL FROM spans GROUP BY id),
kept AS (SELECT id, string_agg(substring(h, 2 * a + 1, 2 * (coalesce(b, len(h) // 2) - a)), '' ORDER BY a) AS k FROM gaps JOIN hexed USING (id) GROUP BY id),
counts AS (SELECT id, sum(high - low) AS removed, count(*) AS spans FROM spans GROUP BY id)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256 FROM hexed LEFT JOIN kept USING (id) LEFT JOIN counts USING (id)""",
    "op10_mixture": mixing.oracle(),
    "op11_merkle_manifest": """
WITH RECURSIVE steps AS (SELECT list(c ORDER BY i) AS steps FROM (SELECT i, list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c FROM range(256) r(i))),
crcs AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda h: ('0x' || h)::UBIGINT)), lambda c, y: xor(c >> 8, steps[(xor(c, y) & 255)::INT + 1])), 4294967295::UBIGINT) AS crc FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), steps),
shown AS (SELECT d.*, CASE WHEN crc % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other FROM documents d LEFT JOIN crcs USING (doc_id)),
parts AS (SELECT doc_id, source, text, other, f(doc_id::VARCHAR) || f(source) || f(lang) || f(n_chars::VARCHAR) AS head FROM shown),
leaves AS (SELECT doc_id, source, sha256(head || f(text)) AS leaf, sha256(head || f(other)) AS altered FROM parts),
placed AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p FROM leaves),
nodes AS (SELECT g, 0 AS level, p, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM placed
  UNION ALL SELECT g, level + 1, p // 16, sha256(string_agg(h, '' ORDER BY p)), (any_value(n) + 15) // 16 FROM nodes WHERE n > 1 GROUP BY g, level, p // 16),
subroots AS (SELECT g, level AS top, h AS subroot, count(*) OVER () AS groups FROM nodes WHERE n = 1),
above AS (SELECT 0 AS level, g AS p, subroot AS h, groups AS n FROM subroots
  UNION ALL SELECT level + 1, p // 16, sha256(string_agg(h, '' ORDER BY p)), (any_value(n) + 15) // 16 FROM above WHERE n > 1 GROUP BY level, p // 16),
links AS (SELECT g, level + 1 AS level, p // 16 AS p, list(h ORDER BY p) AS kids FROM nodes WHERE n > 1 GROUP BY g, level, p // 16),
tops AS (SELECT level + 1 AS level, p // 16 AS p, list(h ORDER BY p) AS kids FROM above WHERE n > 1 GROUP BY level, p // 16),
ways AS (SELECT g, level, p, NULL::BIGINT AS spot, kids FROM links
  UNION ALL SELECT g, top + o.level, -1, (g // (16 ** (o.level - 1))::BIGINT) % 16, o.kids FROM subroots JOIN tops o ON o.p = g // (16 ** o.level)::BIGINT),
paths AS (SELECT g, p, p AS at, 0 AS level, altered AS h, '' AS beside FROM placed
  UNION ALL SELECT g, p, up, level, sha256(array_to_string(kids[1:spot] || [h] || kids[spot + 2:], '')), beside || array_to_string(kids[1:spot] || kids[spot + 2:], '')
    FROM (SELECT x.g, x.p, x.at // 16 AS up, k.level, x.h, x.beside, k.kids, coalesce(k.spot, x.at % 16) AS spot FROM paths x JOIN ways k ON k.g = x.g AND k.level = x.level + 1 AND k.p IN (-1, x.at // 16))),
ends AS (SELECT g, p, arg_max(h, level) AS folded_root, sha256(arg_max(beside, level)) AS proof_sha256 FROM paths GROUP BY g, p)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM placed JOIN subroots USING (g) JOIN ends USING (g, p), (SELECT h AS root FROM above WHERE n = 1)""".replace("f(doc_id::VARCHAR)", _FIELD.format("doc_id::VARCHAR")).replace("f(n_chars::VARCHAR)", _FIELD.format("n_chars::VARCHAR")).replace("f(source)", _FIELD.format("source")).replace("f(lang)", _FIELD.format("lang")).replace("f(text)", _FIELD.format("text")).replace("f(other)", _FIELD.format("other")),
}
