"""Queries over dense algebra, clustering and density."""

from __future__ import annotations

from pyspark.sql import functions as F

from contactspark.operators import blocks as B
from contactspark.operators import factors as K
from contactspark.operators import graph as G
from contactspark.operators import layout as Y
from contactspark.operators import linalg as L
from contactspark.operators import maps as M
from contactspark.operators import norms as N
from contactspark.operators import tracks as T
from contactspark.operators import trees as W
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


CHROM, CELL = ["chrom"], ["cell_id", "chrom"]


@query("n3_row_correlation", sql("""SELECT chrom, i, j, c AS v FROM (SELECT a.chrom, a.i, b.i AS j, CASE WHEN a.i = b.i THEN 1 ELSE round((sum(a.v * b.v) / 40 - avg(a.v) * avg(b.v)) / nullif(sqrt(sum(a.v * a.v) / 40 - avg(a.v) ** 2) * sqrt(sum(b.v * b.v) / 40 - avg(b.v) ** 2), 0), 5) END AS c
FROM full_map a JOIN full_map b ON a.chrom = b.chrom AND a.j = b.j GROUP BY a.chrom, a.i, b.i) WHERE abs(c) > 1e-4""", "bulk", "bins").replace("\nSELECT chrom, i, j, c", ", full_map AS (SELECT c.chrom, c.i, c.j, CAST(coalesce(v, 0) AS DOUBLE) AS v FROM (SELECT a.chrom, a.bin AS i, b.bin AS j FROM bins a JOIN bins b USING (chrom)) c LEFT JOIN bulk USING (chrom, i, j))\nSELECT chrom, i, j, c", 1))
def _(spark, d):
    return L.row_correlation(X.bulk(spark, d), CHROM, X.index(spark)).select("chrom", "i", "j", F.round("v", 5).alias("v")).where("abs(v) > 1e-4")


ORACLE["n3_row_correlation_blocks"] = ORACLE["n3_row_correlation"]


@query("n3_row_correlation_blocks")
def _(spark, d):
    out = B.cells(B.row_correlation(X.bulk(spark, d), CHROM, X.index(spark), 16), CHROM, 16)
    return out.select("chrom", "i", "j", F.round("v", 5).alias("v")).where("abs(v) > 1e-4")


@query("n4_compartment_bulk")
def _(spark, d):
    arms = M.split_arms(X.cytoband(spark)).withColumn("split", F.floor(F.col("split") / X.RES))
    return r6(L.compartments(X.bulk(spark, d), CHROM, X.index(spark), arms), "score")


@query("n4_compartment_cells")
def _(spark, d):
    return r6(L.compartments(M.symmetric(X.pixels(spark, d)), CELL, X.index(spark), bulk=X.bulk(spark, d)), "score")


@query("n5_balanced_map")
def _(spark, d):
    return r6(L.balanced(X.bulk(spark, d), CHROM, X.index(spark)), "v")


@query("n5_balanced_rows", sql("SELECT chrom, i, 1.0::DOUBLE AS total FROM bulk GROUP BY chrom, i HAVING sum(v) > 0", "bulk"))
def _(spark, d):
    """Every filled row of a balanced map sums to 1."""
    return L.balanced(X.bulk(spark, d), CHROM, X.index(spark)).groupBy("chrom", "i").agg(F.round(F.sum("v"), 5).alias("total"))


@query("n8_random_walk")
def _(spark, d):
    return r6(L.random_walk(M.symmetric(X.pixels(spark, d)), CELL, X.index(spark)), "v")


@query("n9_random_walk_pairs")
def _(spark, d):
    walked = L.random_walk(M.symmetric(X.pixels(spark, d)), CELL, X.index(spark)).withColumnsRenamed({"i": "bin1", "j": "bin2"})
    pairs = X.pixels(spark, d).select(*CELL).distinct().join(M.bin_pairs(X.index(spark), 1, 11), "chrom")
    return pairs.join(walked, [*CELL, "bin1", "bin2"], "left").select(*CELL, "bin1", "bin2", F.round(F.coalesce("v", F.lit(0.0)), 6).alias("v"))


@query("n10_binary_features")
def _(spark, d):
    return L.binary_features(M.symmetric(X.pixels(spark, d)), X.index(spark), 20, 4)


@query("n15_cell_features")
def _(spark, d):
    counts = X.pixels(spark, d).groupBy("cell_id").agg(F.count_if(F.col("bin1") != F.col("bin2")).alias("n"))
    mean = counts.agg(F.avg("n")).first()[0] or 0.0
    return K.cell_features(X.pixels(spark, d), 4, counts.select("cell_id", (F.col("n") >= 0.9 * mean).alias("good")))


@query("h11_coassay_codes")
def _(spark, d):
    p = X.pixels(spark, d)
    x = p.select(F.col("cell_id").alias("id"), F.concat_ws("-", "chrom", "bin1", "bin2").alias("feature"), F.log1p("count").alias("v"))
    return K.CrossCovariance(x, K.standard_signals(X.signals(spark, d)), 4).codes


@query("n17_bin_features", sql("SELECT chrom, i, j, round((v - m) / s, 6) AS v FROM (SELECT chrom, i, j, v / sum(v) OVER (PARTITION BY chrom, i) AS v FROM bulk), (SELECT sum(v) / 4800 AS m, sqrt(sum(v * v) / 4800 - (sum(v) / 4800) ** 2) AS s FROM (SELECT v / sum(v) OVER (PARTITION BY chrom, i) AS v FROM bulk))", "bulk"))
def _(spark, d):
    return r6(N.bin_features(X.bulk(spark, d), X.index(spark)), "v")


@query("n18_node_attributes", sql("SELECT chrom, CAST(bin AS BIGINT) AS bin, CAST(chrom = 'chr1' AS INT) AS is1, CAST(chrom = 'chr2' AS INT) AS is2, CAST(chrom = 'chr3' AS INT) AS is3, round(bin / n_bins, 6) AS place FROM seen_bins", "seen_bins"))
def _(spark, d):
    return r6(N.node_attributes(X.seen_index(spark, d)), "place").select("chrom", "bin", *[F.col("hot")[k].alias(f"is{k + 1}") for k in range(3)], "place")


@query("n19_cell_covariates", sql("SELECT cell_id, round(ln(1 + sum(count)), 6) AS reads, CAST(batch = 'batch0' AS INT) AS batch0, CAST(batch = 'batch1' AS INT) AS batch1 FROM pixels JOIN labels_cells USING (cell_id) GROUP BY cell_id, batch", "pixels", "labels_cells"))
def _(spark, d):
    return r6(N.cell_covariates(X.pixels(spark, d), X.cell_labels(spark, d)), "reads").select("cell_id", "reads", F.col("hot")[0].alias("batch0"), F.col("hot")[1].alias("batch1"))


def _points(spark, d):
    e = F.col("embedding")
    return X.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), e[0].cast("double").alias("x"), e[1].cast("double").alias("y"))


@query("n24_density", """WITH p AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings), s AS (SELECT count(*) AS n, var_samp(x) AS xx, var_samp(y) AS yy, covar_samp(x, y) AS xy, count(*) ** (-1.0::DOUBLE / 3) AS h2 FROM p)
SELECT a.id, round(sum(exp(-((a.x - b.x) ** 2 * yy - 2 * (a.x - b.x) * (a.y - b.y) * xy + (a.y - b.y) ** 2 * xx) / (xx * yy - xy * xy) / (2 * h2))) / max(n * 2 * pi() * h2 * sqrt(xx * yy - xy * xy)), 5) AS density FROM p a, p b, s GROUP BY a.id""")
def _(spark, d):
    return L.density(_points(spark, d)).withColumn("density", F.round("density", 5))


@query("n32_zinb", sql("SELECT id, round(CASE WHEN k = 0 THEN sp(t * (ln(t + 1e-8) - ln(t + m + 1e-8)) - p) - sp(-p) ELSE -sp(-p) - p + t * (ln(t + 1e-8) - ln(t + m + 1e-8)) + k * (ln(m + 1e-8) - ln(t + m + 1e-8)) + lgamma(k + t) - lgamma(t) - lgamma(k + 1) END, 5) AS log_likelihood FROM (SELECT id, weight - 1 AS k, 0.5 + score * 4 AS m, 1.5::DOUBLE AS t, score - 0.5 AS p FROM scored)", "scored").replace("sp(t * (ln(t + 1e-8) - ln(t + m + 1e-8)) - p)", "ln(1 + exp(t * (ln(t + 1e-8) - ln(t + m + 1e-8)) - p))").replace("sp(-p)", "ln(1 + exp(-p))"))
def _(spark, d):
    rows = X.scored(spark, d).select("id", (F.col("weight") - 1).alias("k"), (0.5 + F.col("score") * 4).alias("m"), F.lit(1.5).alias("t"), (F.col("score") - 0.5).alias("p"))
    return L.zinb(rows, "k", "m", "t", "p").select("id", F.round("log_likelihood", 5).alias("log_likelihood"))


@query("n21_scaling")
def _(spark, d):
    return L.scaling(X.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 2)


def _vectors(spark, d):
    return X.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


@query("n21_distances", """WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT a.id, round(list_distance(a.v, b.v), 4) AS distance FROM v a JOIN v b ON b.id = a.id + 1""")
def _(spark, d):
    """Scaling in as many dimensions as the vectors have keeps distances: from each row to the next."""
    rows = _vectors(spark, d)
    placed = L.scaling(rows, rows.agg(F.max(F.size("v"))).first()[0], 1000).select("id", "v")
    following = placed.select((F.col("id") - 1).alias("id"), F.col("v").alias("w"))
    gap = F.aggregate(F.zip_with("v", "w", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x)
    return placed.join(following, "id").select("id", F.round(F.sqrt(gap), 4).alias("distance"))


@query("n22_projection")
def _(spark, d):
    return L.dense_components(_vectors(spark, d), 3)


@query("n22_umap")
def _(spark, d):
    return Y.umap(_vectors(spark, d)).select("id", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


@query("n22_tsne")
def _(spark, d):
    return Y.tsne(_vectors(spark, d)).select("id", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


_DISTANCES = """v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
near AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, nbr) AS r FROM (SELECT a.id, b.id AS nbr, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS d FROM v a JOIN v b ON a.id <> b.id))"""


@query("n22_fuzzy_views", f"""WITH {_DISTANCES}, kept AS (SELECT id, d FROM near WHERE r < 15)
SELECT id, CAST(count(*) AS BIGINT) AS n, round(min(d), 6) AS rho, round(log2(15), 4) AS total FROM kept GROUP BY id""")
def _(spark, d):
    # each row's own views of its 14 neighbours sum to log2(15): the views are taken back from the bandwidths that they were made with
    near = G.nearest(_vectors(spark, d), 15)
    views = Y.views(near, 15)
    return views.groupBy(F.col("i").alias("id")).agg(F.count("*").alias("n"), F.round(F.min("distance"), 6).alias("rho"), F.round(F.sum("w"), 4).alias("total"))


@query("n22_fuzzy_graph", f"""WITH {_DISTANCES}, kept AS (SELECT id, nbr FROM near WHERE r < 15) SELECT i, j FROM (SELECT id AS i, nbr AS j FROM kept UNION SELECT nbr, id FROM kept)""")
def _(spark, d):
    return Y.fuzzy_graph(G.nearest(_vectors(spark, d), 15), 15).where("w > 0 AND w <= 1 + 1e-12").select("i", "j")


@query("n23_clusters")
def _(spark, d):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    e = X.table(spark, d, "embeddings").select("vec_id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
    return KMeans(k=10, seed=1, maxIter=30).fit(e).transform(e).select("vec_id", F.col("prediction").alias("cluster"))


@query("n23_hierarchical_clusters")
def _(spark, d):
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.functions import array_to_vector

    e = X.table(spark, d, "embeddings").select("vec_id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
    return BisectingKMeans(k=10, seed=1).fit(e).transform(e).select("vec_id", F.col("prediction").alias("cluster"))


_WARD = """WITH RECURSIVE v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE len(embedding) > 0),
alike AS (SELECT min(id) AS id, count(*) AS n, v FROM v GROUP BY v),
doubles AS (SELECT 0 AS turn, a.id AS "left", v.id AS "right", row_number() OVER (PARTITION BY a.id ORDER BY v.id) + 1 AS size, 0.0::DOUBLE AS d FROM alike a JOIN v ON a.v = v.v AND a.id <> v.id),
steps AS (SELECT 1 AS turn, id, n, v, NULL::BIGINT AS gone, 0.0::DOUBLE AS d FROM alike
  UNION ALL SELECT * FROM (WITH live AS (SELECT turn, id, n, v FROM steps WHERE gone IS NULL),
    pairs AS (SELECT a.id, b.id AS nbr, a.n::DOUBLE * b.n / (a.n + b.n) * list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM live a JOIN live b ON a.id <> b.id),
    best AS (SELECT id, arg_min(nbr, (d, md5(concat(least(id, nbr), ':', greatest(id, nbr))))) AS nbr, min(d) AS d FROM pairs GROUP BY id),
    mutual AS (SELECT a.id, a.nbr, a.d FROM best a JOIN best b ON b.id = a.nbr AND b.nbr = a.id)
    SELECT x.turn + 1, x.id, CASE WHEN m.id IS NULL THEN x.n ELSE x.n + y.n END, CASE WHEN m.id IS NULL THEN x.v ELSE list_transform(list_zip(x.v, y.v), lambda p: (x.n * p[1] + y.n * p[2]) / (x.n + y.n)) END, CASE WHEN m.id > m.nbr THEN m.nbr END, coalesce(m.d, 0)
    FROM live x LEFT JOIN mutual m ON m.id = x.id LEFT JOIN live y ON y.id = m.nbr WHERE (SELECT count(*) FROM live) > 1)),
merges AS (SELECT * FROM doubles UNION ALL SELECT turn - 1, gone, id, n, d FROM steps WHERE gone IS NOT NULL)
"""


@query("n23_ward_tree", _WARD + 'SELECT "left" AS left_id, "right" AS right_id, CAST(size AS BIGINT) AS size, round(sqrt(2 * d), 6) AS height FROM merges')
def _(spark, d):
    return W.ward(_vectors(spark, d)).select(F.col("left").alias("left_id"), F.col("right").alias("right_id"), "size", F.round("height", 6).alias("height"))


@query("n23_ward_clusters", _WARD + """, kept AS (SELECT * FROM merges ORDER BY d DESC, turn DESC, "left" DESC, "right" DESC OFFSET 9),
up AS (SELECT id, id AS cluster, 0 AS k FROM v UNION ALL SELECT up.id, kept."left", k + 1 FROM up JOIN kept ON kept."right" = up.cluster)
SELECT id, arg_max(cluster, k) AS cluster FROM up GROUP BY id""")
def _(spark, d):
    rows = _vectors(spark, d)
    return W.cut(W.ward(rows), rows.select("id"), 10)


def _cell_scores(spark, d):
    return T.insulation(M.symmetric(X.pixels(spark, d)), CELL, X.index(spark), 3)


@query("n28_calibrated_boundaries")
def _(spark, d):
    scores = _cell_scores(spark, d)
    own = T.local_minima(scores, CELL, 2).where("boundary").select(*CELL, "bin")
    bulk = T.local_minima(T.insulation(X.bulk(spark, d), CHROM, X.index(spark), 3), CHROM, 2).where("boundary").select("chrom", "bin")
    return L.calibrate(scores, own, bulk)


_KNOTS = ", ".join(f"{k / 249!r}::DOUBLE" for k in range(250))


@query("w10_quantile_normal", sql(f"""SELECT chrom, i, j, round((CASE WHEN up >= 249 THEN 1 ELSE (up + (v - k[up + 1]) / (k[up + 2] - k[up + 1])) / 249 END + CASE WHEN down <= 0 THEN 0 ELSE (down - (k[down + 1] - v) / (k[down + 1] - k[down])) / 249 END) / 2, 6) AS v
FROM (SELECT chrom, i, j, v, k, len(list_filter(k, lambda x: x <= v)) - 1 AS up, len(list_filter(k, lambda x: x < v)) AS down FROM (SELECT chrom, i, j, CAST(v AS DOUBLE) AS v FROM bulk), (SELECT quantile_cont(CAST(v AS DOUBLE), [{_KNOTS}]) AS k FROM bulk))""", "bulk"))
def _(spark, d):
    return r6(L.quantile_normal(X.bulk(spark, d), "v"), "v")
