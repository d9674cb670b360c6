"""Queries over similarity, quality metrics, losses, neighbours and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from contactspark.operators import graph as G
from contactspark.operators import metrics as Q
from contactspark.operators.bloom import held
from contactspark.plans import fixtures as X
from contactspark.plans.fixtures import r6, sql

QUERIES, ORACLE = {}, {}


def query(name: str, text: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if text:
            ORACLE[name] = text
        return f

    return keep


def _halves(spark, d):
    """Bulk maps of even and odd cells."""
    p = X.pixels(spark, d)
    half = lambda k: p.where(f"cell_id % 2 = {k}").groupBy("chrom", F.col("bin1").alias("i"), F.col("bin2").alias("j")).agg(F.sum("count").alias("v"))
    return Q.align(half(0), half(1), X.index(spark))


AL = """,
al AS (SELECT c.chrom, c.i, c.j, c.j - c.i AS d, CAST(coalesce(a.v, 0) AS DOUBLE) AS x, CAST(coalesce(b.v, 0) AS DOUBLE) AS y FROM (SELECT a.chrom, a.bin AS i, b.bin AS j FROM bins a JOIN bins b ON a.chrom = b.chrom AND a.bin <= b.bin) c
LEFT JOIN (SELECT chrom, bin1 AS i, bin2 AS j, sum(count) AS v FROM pixels WHERE cell_id % 2 = 0 GROUP BY ALL) a USING (chrom, i, j) LEFT JOIN (SELECT chrom, bin1 AS i, bin2 AS j, sum(count) AS v FROM pixels WHERE cell_id % 2 = 1 GROUP BY ALL) b USING (chrom, i, j))"""


def _aligned(body: str) -> str:
    return sql("@" + body, "pixels", "bins").replace("\n@", AL + "\n", 1)


_RANK = "rank() OVER (PARTITION BY {p} ORDER BY {c}) + (count(*) OVER (PARTITION BY {p}, {c}) - 1) / 2"


@query("j11_aligned_maps", _aligned("SELECT * FROM al"))
def _(spark, d):
    return _halves(spark, d)


@query("c1_flat_correlation", _aligned(f"SELECT chrom, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM (SELECT *, {_RANK.format(p='chrom', c='x')} AS rx, {_RANK.format(p='chrom', c='y')} AS ry FROM al) GROUP BY chrom"))
def _(spark, d):
    return r6(Q.flat(_halves(spark, d)), "pearson", "spearman")


_DIAG = "SELECT chrom, d, CASE WHEN count(*) >= 5 AND stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN round(corr(x, y), 6) END AS pearson, CASE WHEN count(*) >= 5 AND stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN round(corr(rx, ry), 6) END AS spearman FROM (SELECT *, {a} AS rx, {b} AS ry FROM al WHERE d > 0 {w}) GROUP BY chrom, d".replace("{a}", _RANK.format(p="chrom, d", c="x")).replace("{b}", _RANK.format(p="chrom, d", c="y"))


@query("c3_diagonal_correlation", _aligned(_DIAG.replace("{w}", "")))
def _(spark, d):
    return r6(Q.by_diagonal(_halves(spark, d)), "pearson", "spearman")


@query("c4_diagonal_correlation_positive", _aligned(_DIAG.replace("{w}", "AND y > 0")))
def _(spark, d):
    return r6(Q.by_diagonal(_halves(spark, d), positive_only=True), "pearson", "spearman")


@query("c5_stratum_adjusted", _aligned("SELECT chrom, round(sum(n * c) / sum(n * sx * sy), 6) AS scc FROM (SELECT chrom, d, count(*) AS n, stddev_pop(x) AS sx, stddev_pop(y) AS sy, covar_pop(x, y) AS c FROM al GROUP BY chrom, d) GROUP BY chrom"))
def _(spark, d):
    return r6(Q.stratum_adjusted(_halves(spark, d)), "scc")


@query("c6_stratum_adjusted_stable", _aligned("SELECT chrom, round(sum(CASE WHEN ok THEN n * (n + 1) / (12 * n) * r END) / sum(CASE WHEN ok THEN n * (n + 1) / (12 * n) END), 6) AS scc, count(*) FILTER (WHERE NOT ok) AS skipped FROM (SELECT chrom, d, count(*)::DOUBLE AS n, CASE WHEN stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN corr(x, y) END AS r, stddev_pop(x) > 0 AND stddev_pop(y) > 0 AS ok FROM al WHERE d > 0 GROUP BY chrom, d) GROUP BY chrom"))
def _(spark, d):
    return r6(Q.stratum_adjusted_stable(_halves(spark, d)), "scc")


@query("a22_auroc", sql("SELECT round((sum(CASE WHEN label = 1 THEN r END) - p * (p + 1) / 2) / (p * n), 6) AS auroc, CAST(p AS BIGINT) AS positives, CAST(n AS BIGINT) AS negatives FROM (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM scored), (SELECT sum(label)::DOUBLE AS p, sum(1 - label)::DOUBLE AS n FROM scored) GROUP BY p, n", "scored"))
def _(spark, d):
    return r6(Q.auroc(X.scored(spark, d), "label", "score"), "auroc")


@query("a22_aupr", sql("SELECT round(sum(p * prec) / sum(p), 6) AS aupr FROM (SELECT p, sum(p) OVER (ORDER BY score DESC) / sum(n) OVER (ORDER BY score DESC) AS prec FROM (SELECT score, sum(label) AS p, count(*) AS n FROM scored GROUP BY 1))", "scored"))
def _(spark, d):
    return r6(Q.aupr(X.scored(spark, d), "label", "score"), "aupr")


@query("a22_accuracy", sql("SELECT round(avg(CASE WHEN CAST(score >= 0.3 AS INT) = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM scored", "scored"))
def _(spark, d):
    return r6(Q.accuracy(X.scored(spark, d), "label", "score", 0.3), "accuracy")


@query("a22_continuous_fit", sql("SELECT round(corr(weight, score), 6) AS pearson, round(corr(rw, rs), 6) AS spearman FROM (SELECT *, rank() OVER (ORDER BY weight) + (count(*) OVER (PARTITION BY weight) - 1) / 2 AS rw, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS rs FROM scored)", "scored"))
def _(spark, d):
    return r6(Q.continuous_fit(X.scored(spark, d), "weight", "score"), "pearson", "spearman")


@query("a21_rand_index", "WITH t AS (SELECT label AS a, vec_id % 10 AS b, count(*) AS n FROM embeddings GROUP BY ALL), s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM t) AS ij, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM t GROUP BY a)) AS i, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM t GROUP BY b)) AS j, (SELECT sum(n) FROM t) AS n) SELECT round((ij - i * j / (n * (n - 1) / 2)) / ((i + j) / 2 - i * j / (n * (n - 1) / 2)), 6) AS ari FROM s")
def _(spark, d):
    rows = X.table(spark, d, "embeddings").select(F.col("label").alias("a"), (F.col("vec_id") % 10).alias("b"))
    return r6(Q.rand_index(rows, "a", "b"), "ari")


@query("a21_confusion", "SELECT label AS a, vec_id % 10 AS b, count(*) AS n FROM embeddings GROUP BY ALL")
def _(spark, d):
    return Q.confusion(X.table(spark, d, "embeddings").select(F.col("label").alias("a"), (F.col("vec_id") % 10).alias("b")), "a", "b")


@query("n33_losses", sql("""SELECT round(avg(weight * (greatest(score, 0) + ln(1 + exp(-abs(score))) - score * label)), 6) AS bce, round(avg((label - score) ** 2), 6) AS mse, round(avg(ln((exp(label - score) + exp(score - label)) / 2)), 6) AS log_cosh,
round(avg(2 * (label - score) / (1 + exp(score - label)) - (label - score)), 6) AS x_sigmoid, round(avg((label - score) * tanh(label - score)), 6) AS x_tanh FROM scored""", "scored"))
def _(spark, d):
    return r6(Q.losses(X.scored(spark, d), "label", "score", "weight"), "bce", "mse", "log_cosh", "x_sigmoid", "x_tanh")


@query("n33_rank_loss", sql("SELECT round(avg(ln(1 + exp(b.score - a.score))), 6) AS rank_loss, count(*) AS pairs FROM scored a JOIN scored b ON a.id // 64 = b.id // 64 AND a.weight > b.weight", "scored"))
def _(spark, d):
    rows = X.scored(spark, d).withColumn("block", F.floor(F.col("id") / 64))
    return r6(Q.rank_loss(rows, "weight", "score", "block"), "rank_loss")


@query("n34_activations", sql("SELECT id, round(score / (1 + exp(-score)), 6) AS swish, round(ln(1 + exp(score)), 6) AS softplus, round(1 / (1 + exp(-score)), 6) AS sigmoid, round(ln(score + sqrt(score * score + 1)), 6) AS asinh FROM scored", "scored"))
def _(spark, d):
    s = F.col("score")
    return X.scored(spark, d).select("id", *[F.round(f(s), 6).alias(n) for n, f in (("swish", Q.swish), ("softplus", Q.softplus), ("sigmoid", Q.sigmoid), ("asinh", Q.arcosh_like))])


@query("n35_weight_transform", sql("WITH l AS (SELECT id, log2(weight + 1) AS w FROM scored), c AS (SELECT id, least(w, (SELECT quantile_cont(w, 0.99) FROM l)) AS w FROM l) SELECT id, round(w / (SELECT avg(w) FROM c) * 3, 6) AS weight FROM c", "scored").replace("\nWITH l AS", ", l AS"))
def _(spark, d):
    return r6(Q.weight_transform(X.scored(spark, d).select("id", "weight"), "weight", 3), "weight")


@query("n20_regress_out", sql("SELECT chrom, cell_id, bin, signal, round(value - (regr_intercept(value, bin) OVER p + regr_slope(value, bin) OVER p * bin), 5) AS value FROM signals WINDOW p AS (PARTITION BY signal)", "signals"))
def _(spark, d):
    rows = X.signals(spark, d).withColumn("b", F.col("bin").cast("double"))
    return Q.regress_out(rows, "value", "b", ["signal"]).select("chrom", "cell_id", "bin", "signal", F.round("value", 5).alias("value"))


@query("n25_clip_scale", sql("SELECT id, round((greatest(least(score, b), a) - a) / (b - a), 6) AS score FROM scored, (SELECT quantile_cont(score, 0.05) AS a, quantile_cont(score, 0.95) AS b FROM scored)", "scored"))
def _(spark, d):
    return r6(Q.clip_scale(X.scored(spark, d).select("id", "score"), "score"), "score")


def _cells(spark, d):
    return X.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), (F.col("vec_id") % 3).alias("batch"))


_DIST = "SELECT a.vec_id AS id, b.vec_id AS nbr, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS distance FROM embeddings a, embeddings b"


@query("j9_nearest", f"SELECT id, nbr, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, nbr <> id, nbr) AS k FROM ({_DIST})) WHERE k <= 6")
def _(spark, d):
    return r6(G.nearest(_cells(spark, d), 6), "distance")


@query("k1_kernel_weights", f"WITH n AS (SELECT id, nbr, distance, k FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, nbr <> id, nbr) AS k FROM ({_DIST})) WHERE k <= 6) SELECT id, nbr, CAST(k AS INT) AS rank, round(exp(-distance / q) / sum(exp(-distance / q)) OVER (PARTITION BY id), 6) AS weight FROM n, (SELECT quantile_cont(distance, 0.25) AS q FROM n WHERE id <> nbr)")
def _(spark, d):
    return r6(G.kernel_weights(G.nearest(_cells(spark, d), 6)), "weight")


@query("k2_balanced_weights", f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY id, nbr % 3 ORDER BY distance, nbr <> id, nbr) AS k FROM ({_DIST})), m AS (SELECT id, nbr, CASE WHEN avg(distance) OVER p > 0 THEN distance / avg(distance) OVER p ELSE 0 END AS d FROM n WHERE k <= 2 AND (id % 3 <> nbr % 3 OR id = nbr) WINDOW p AS (PARTITION BY id, nbr % 3)),
c AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY id <> nbr, md5('balance:' || id || ':' || nbr), nbr) AS o FROM m) SELECT id, nbr, round(exp(-d) / sum(exp(-d)) OVER (PARTITION BY id), 6) AS weight FROM c WHERE o <= 5""")
def _(spark, d):
    return r6(G.balanced_weights(_cells(spark, d), 5, "batch"), "weight")


@query("k3_nearest_to_point", "SELECT vec_id AS id, round(d, 6) AS distance FROM (SELECT vec_id, sqrt(power(CAST(embedding[1] AS DOUBLE) - 0.1, 2) + power(CAST(embedding[2] AS DOUBLE) + 0.2, 2)) AS d FROM embeddings) ORDER BY d, vec_id LIMIT 10")
def _(spark, d):
    e = lambda i: F.col("embedding")[i].cast("double")
    rows = X.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.sqrt(F.pow(e(0) - 0.1, 2) + F.pow(e(1) + 0.2, 2)).alias("distance"))
    return r6(rows.orderBy("distance", "id").limit(10), "distance")


@query("j6_no_near_positive", sql("SELECT cell_id, chrom, bin1, bin2, count FROM pixels WHERE count >= 40 AND NOT EXISTS (SELECT 1 FROM pixels q WHERE q.count < 40 AND q.cell_id = pixels.cell_id AND q.chrom = pixels.chrom AND abs(q.bin1 - pixels.bin1) <= 1 AND abs(q.bin2 - pixels.bin2) <= 1)", "pixels"))
def _(spark, d):
    p = X.pixels(spark, d)
    return G.near_positive(p.where("count >= 40"), p.where("count < 40")).select("cell_id", "chrom", "bin1", "bin2", "count")


_U = "('0x' || substring(h, {}, 6))::BIGINT / 16777216.0::DOUBLE"


@query("u8_negatives", sql(f"""SELECT cell_id, chrom, bin1, bin2, t_cell, t_bin1, t_bin2 FROM (SELECT *, row_number() OVER (PARTITION BY t_cell, chrom, t_bin1, t_bin2 ORDER BY t) AS r FROM (SELECT CAST(c AS BIGINT) AS cell_id, chrom, CAST(least(a, b) AS BIGINT) AS bin1, CAST(greatest(a, b) AS BIGINT) AS bin2, cell_id AS t_cell, bin1 AS t_bin1, bin2 AS t_bin2, t FROM (
SELECT *, CASE WHEN one AND which = 0 THEN floor({_U.format(13)} * 20) ELSE cell_id END AS c, CASE WHEN NOT one OR which = 1 THEN floor({_U.format(19)} * 40) ELSE bin1 END AS a, CASE WHEN NOT one OR which = 2 THEN floor({_U.format(25)} * 40) ELSE bin2 END AS b
FROM (SELECT *, {_U.format(1)} < 0.5 AS one, floor({_U.format(7)} * 3) AS which FROM (SELECT *, md5(concat_ws(':', '9', cell_id, chrom, bin1, bin2, t)) AS h FROM pos, range(100) r(t))))) x WHERE bin2 - bin1 > 1 AND bin2 - bin1 < 12 AND NOT EXISTS (SELECT 1 FROM near q WHERE q.cell_id = x.cell_id AND q.chrom = x.chrom AND q.bin1 = x.bin1 AND q.bin2 = x.bin2)) WHERE r <= 2""", "pixels").replace("\nSELECT cell_id, chrom, bin1, bin2, t_cell", ", pos AS (SELECT * FROM pixels WHERE bin2 - bin1 >= 2), near AS (SELECT DISTINCT cell_id, chrom, bin1 + x AS bin1, bin2 + y AS bin2 FROM pos, range(-1, 2) a(x), range(-1, 2) b(y))\nSELECT cell_id, chrom, bin1, bin2, t_cell", 1))
def _(spark, d):
    return G.negatives(X.pixels(spark, d).where("bin2 - bin1 >= 2"), X.index(spark), 2, 20, 12, 9)


@query("u9_stencil", sql("SELECT chrom, i, j, i + x AS ni, j + y AS nj FROM bulk, (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) o(x, y)", "bulk"))
def _(spark, d):
    return G.stencil(X.bulk(spark, d))


@query("u4_membership", sql("SELECT o.cell_id, o.bin1, o.bin2, EXISTS (SELECT 1 FROM pixels p WHERE (o.cell_id = -1 OR p.cell_id = o.cell_id) AND (o.bin1 = -1 OR p.bin1 = o.bin1) AND (o.bin2 = -1 OR p.bin2 = o.bin2)) AS held FROM (SELECT c.cell_id, i.bin1, j.bin2 FROM range(-1, 20) c(cell_id), range(-1, 40, 4) i(bin1), range(-1, 40, 5) j(bin2) WHERE (c.cell_id = -1)::INT + (i.bin1 = -1)::INT + (j.bin2 = -1)::INT < 2) o", "pixels"))
def _(spark, d):
    """Whether pairs are in a set, one place of three left open or none."""
    asked = spark.range(-1, 20).select(F.col("id").alias("cell_id"), F.explode(F.sequence(F.lit(-1).cast("long"), F.lit(39), F.lit(4))).alias("bin1")).select("cell_id", "bin1", F.explode(F.sequence(F.lit(-1).cast("long"), F.lit(39), F.lit(5))).alias("bin2"))
    asked = asked.where("int(cell_id = -1) + int(bin1 = -1) + int(bin2 = -1) < 2")
    return G.holds_pair(asked, X.pixels(spark, d))


@query("u4_bloom_membership", sql("SELECT cell_id, bin1, bin2, EXISTS (SELECT 1 FROM pixels p WHERE p.cell_id = o.cell_id AND p.bin1 = o.bin1 AND p.bin2 = o.bin2) AS held FROM (SELECT DISTINCT cell_id, bin1, CASE WHEN bin1 % 2 = 0 THEN bin2 ELSE 39 - bin2 END AS bin2 FROM pixels) o", "pixels"))
def _(spark, d):
    """Exact membership behind a Bloom filter: half of the pairs asked for are mirrored in the chromosome."""
    p = X.pixels(spark, d)
    asked = p.select("cell_id", "bin1", F.when(F.col("bin1") % 2 == 0, F.col("bin2")).otherwise(39 - F.col("bin2")).alias("bin2")).distinct()
    return held(asked, p, ["cell_id", "bin1", "bin2"])


@query("u4_masked_keys", sql("SELECT DISTINCT * FROM (SELECT -1 AS cell_id, bin1, bin2 FROM pixels UNION ALL SELECT cell_id, -1, bin2 FROM pixels UNION ALL SELECT cell_id, bin1, -1 FROM pixels)", "pixels"))
def _(spark, d):
    return G.masked_keys(X.pixels(spark, d))


@query("u7_mini_batches", sql("SELECT cell_id, chrom, bin1, bin2, (row_number() OVER (PARTITION BY chrom ORDER BY md5('2:' || concat_ws(':', cell_id, bin1, bin2)), cell_id, bin1, bin2) - 1) // 256 AS batch FROM pixels", "pixels"))
def _(spark, d):
    return G.mini_batches(X.pixels(spark, d), ["cell_id", "bin1", "bin2"], 256, 2).select("cell_id", "chrom", "bin1", "bin2", "batch")


@query("j12_row_mean_product", sql("SELECT chrom, i, k, round(s / t, 6) AS v FROM (SELECT e.chrom, e.i, e.j % 4 AS k, sum(e.v * (e.j + 1)) AS s FROM bulk e GROUP BY 1, 2, 3) JOIN (SELECT chrom, i, sum(v) AS t FROM bulk GROUP BY 1, 2) USING (chrom, i)", "bulk"))
def _(spark, d):
    edges = X.bulk(spark, d).select("chrom", "i", "j", F.col("v").alias("w"))
    features = X.index(spark).select("chrom", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bins") - 1)).alias("j")).select("chrom", "j", (F.col("j") % 4).alias("k"), (F.col("j") + 1).alias("x"))
    return r6(G.row_mean_product(edges, features), "v")


@query("c7_embedding_drift", "SELECT a.vec_id AS id, round(list_sum(list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), lambda x: (x[1] - x[2]) ** 2)) / list_sum(list_transform(CAST(b.embedding AS DOUBLE[]), lambda x: x * x)), 4) AS change FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(spark, d):
    e = X.table(spark, d, "embeddings")
    return G.embedding_drift(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), e.select((F.col("vec_id") - 1).alias("id"), F.col("embedding").alias("v"))).withColumn("change", F.round("change", 4))
