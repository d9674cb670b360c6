"""Queries over policies, node tables, set operations, scalar functions and compound pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from contactspark.operators import contacts as C
from contactspark.operators import graph as G
from contactspark.operators import linalg as L
from contactspark.operators import maps as M
from contactspark.operators import metrics as Q
from contactspark.operators import norms as N
from contactspark.operators import tracks as T
from contactspark.operators.order import place
from contactspark.plans import fixtures as X
from contactspark.plans.features import _MIN, _scored, _scores
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


@query("a18_negatives_policy", sql("SELECT cell_id, CAST(CASE WHEN s > 0.3 THEN 1 WHEN s > 0.2 THEN 2 WHEN s > 0.15 THEN 3 WHEN s > 0.1 THEN 4 ELSE 5 END AS INT) AS negatives FROM (SELECT cell_id, count(*) / 600.0::DOUBLE AS s FROM (SELECT DISTINCT cell_id, chrom, bin1 // 2, bin2 // 2 FROM pixels) GROUP BY 1)", "pixels"))
def _(spark, d):
    return C.negatives_policy(M.occupancy(X.pixels(spark, d), X.index(spark), 2))


@query("w2_node_ranges", sql("SELECT 'cell' AS node_type, CAST(1 AS BIGINT) AS start_id, CAST(1 + n AS BIGINT) AS end_id FROM (SELECT count(DISTINCT cell_id) AS n FROM contacts) UNION ALL SELECT chrom, 1 + n + start_bin, 1 + n + end_bin FROM seen_idx, (SELECT count(DISTINCT cell_id) AS n FROM contacts)", "seen_idx"))
def _(spark, d):
    return C.node_ranges(X.contacts(spark, d).select("cell_id").distinct().count(), X.seen_index(spark, d))


@query("w5_merge_close_boundaries", _scored(f"""SELECT chrom, bin FROM (SELECT chrom, bin, n, lead(bin) OVER w - bin AS gap_r, lead(n) OVER w AS n_r, bin - lag(bin) OVER w AS gap_l, lag(n) OVER w AS n_l FROM (SELECT chrom, bin, bin * 7 % 5 AS n FROM ({_MIN}) WHERE boundary) WINDOW w AS (PARTITION BY chrom ORDER BY bin)) WHERE NOT (coalesce(gap_r <= 4 AND n_r > n, false) OR coalesce(gap_l <= 4 AND n_l >= n, false))"""))
def _(spark, d):
    """Of boundaries closer than five bins the one with more members stays, the left one at a tie."""
    return T.merge_close(T.local_minima(_scores(spark, d), CHROM, 2).where("boundary").select("chrom", "bin", (F.col("bin") * 7 % 5).alias("n")), CHROM)


@query("w11_position_rank", sql("SELECT chrom, i, j, row_number() OVER (PARTITION BY chrom ORDER BY v, i, j) - 1 AS r FROM bulk", "bulk"))
def _(spark, d):
    return place(X.bulk(spark, d).select("chrom", "i", "j", "v"), ["chrom"], ["v", "i", "j"], "r").drop("v")


@query("a16_expected_mean", sql("SELECT chrom, j - i AS d, round(avg(v), 6) AS expected FROM bulk GROUP BY ALL", "bulk"))
def _(spark, d):
    return r6(M.expected(X.bulk(spark, d), CHROM, nonzero=False), "expected")


@query("c2_component_pearson")
def _(spark, d):
    """Correlation of the first components of the maps of even and odd cells."""
    p = X.pixels(spark, d)
    half = lambda k: L.compartments(M.symmetric(p.where(f"cell_id % 2 = {k}").groupBy("chrom", "bin1", "bin2").agg(F.sum("count").alias("count"))), CHROM, X.index(spark)).select("chrom", "bin", F.col("score").alias(f"s{k}"))
    return half(0).join(half(1), ["chrom", "bin"]).groupBy("chrom").agg(F.round(F.abs(Q.pearson("s0", "s1")), 6).alias("pearson"))


@query("n36_all_cell_weights", "WITH p AS (SELECT a.vec_id AS id, b.vec_id AS nbr, list_distance(CAST(a.embedding[2:15] AS DOUBLE[]), CAST(b.embedding[2:15] AS DOUBLE[])) AS d FROM embeddings a, embeddings b), q AS (SELECT id, quantile_cont(d, 0.25) AS q FROM p GROUP BY 1) SELECT id, nbr, round(exp(-d / q) / sum(exp(-d / q)) OVER (PARTITION BY id), 6) AS weight FROM p JOIN q USING (id)")
def _(spark, d):
    return G.all_weights(X.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.slice("embedding", 2, 14).alias("v")))


@query("k4_near_with_cut", "SELECT id, nbr, round(d, 6) AS distance FROM (SELECT a.vec_id AS id, b.vec_id AS nbr, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), b.vec_id <> a.vec_id, b.vec_id) AS k FROM embeddings a, embeddings b) WHERE k <= 8 AND d < 1")
def _(spark, d):
    cells = X.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return r6(G.nearest(cells, 8).where("distance < 1"), "distance")


@query("h6_edge_drop_out", sql("SELECT * FROM pixels WHERE ('0x' || substring(md5('drop:' || concat_ws(':', cell_id, chrom, bin1, bin2)), 1, 8))::BIGINT / 4294967296.0::DOUBLE >= 0.4", "pixels"))
def _(spark, d):
    return X.pixels(spark, d).where(G._uniform(F.lit("drop"), *[F.col(c).cast("string") for c in ("cell_id", "chrom", "bin1", "bin2")]) >= 0.4)


@query("u1_union_all", sql("SELECT cell_id, chrom1, chrom2, bin1, bin2, count FROM (SELECT cell_id, chrom AS chrom1, chrom AS chrom2, bin1, bin2, count FROM pixels UNION ALL SELECT cell_id, chrom1, chrom2, pos1 // 1000000, pos2 // 1000000, CAST(sum(count) AS BIGINT) FROM contacts WHERE chrom1 <> chrom2 GROUP BY 1, 2, 3, 4, 5)", "pixels", "contacts"))
def _(spark, d):
    intra = X.pixels(spark, d).select("cell_id", F.col("chrom").alias("chrom1"), F.col("chrom").alias("chrom2"), "bin1", "bin2", "count")
    return intra.unionByName(C.inter_pixels(X.contacts(spark, d), X.RES))


@query("u2_distinct_pairs", sql("SELECT DISTINCT chrom, bin1, bin2 FROM pixels", "pixels"))
def _(spark, d):
    return X.pixels(spark, d).select("chrom", "bin1", "bin2").distinct()


@query("u3_unseen_pairs", sql("SELECT a.chrom, a.bin AS bin1, b.bin AS bin2 FROM bins a JOIN bins b ON a.chrom = b.chrom AND b.bin > a.bin EXCEPT SELECT chrom, bin1, bin2 FROM pixels", "bins", "pixels"))
def _(spark, d):
    return M.bin_pairs(X.index(spark), 1, X.N_BINS).join(X.pixels(spark, d).select("chrom", "bin1", "bin2").distinct(), ["chrom", "bin1", "bin2"], "left_anti")


@query("n1_coverage_sqrt_cells", sql("SELECT cell_id, chrom, i, j, round(v / sqrt(s) / sqrt(t), 6) AS v FROM sym JOIN (SELECT cell_id, chrom, i, sum(v) AS s FROM sym GROUP BY ALL) a USING (cell_id, chrom, i) JOIN (SELECT cell_id, chrom, i AS j, sum(v) AS t FROM sym GROUP BY ALL) b USING (cell_id, chrom, j)", "sym"))
def _(spark, d):
    return r6(N.coverage_sqrt(M.symmetric(X.pixels(spark, d)), CELL), "v")


@query("x_scalar_functions", """SELECT p_partkey, round(ln(1 + p_size), 6) AS log1p, round(log2(p_size), 6) AS log2, round(log10(p_size), 6) AS log10, round(exp(-p_size / 10.0::DOUBLE), 6) AS exp, round(sqrt(p_size), 6) AS sqrt, CAST(floor(p_size / 7.0::DOUBLE) AS BIGINT) AS floor, CAST(ceil(p_size / 7.0::DOUBLE) AS BIGINT) AS ceil, greatest(least(p_size, 40), 10) AS clip,
round(exp(-(p_size / 10.0::DOUBLE) * (p_size / 10.0::DOUBLE) / 2) / sqrt(2 * pi()), 6) AS density, round(tanh(p_size / 30.0::DOUBLE), 6) AS tanh, split_part(p_name, ' ', 1) AS first_word, substring(p_name, 1, 3) AS head, length(p_name) AS n FROM part""")
def _(spark, d):
    x = F.col("p_size").cast("double")
    return X.table(spark, d, "part").select("p_partkey", F.round(F.log1p(x), 6).alias("log1p"), F.round(F.log2(x), 6).alias("log2"), F.round(F.log10(x), 6).alias("log10"), F.round(F.exp(-x / 10), 6).alias("exp"), F.round(F.sqrt(x), 6).alias("sqrt"), F.floor(x / 7).alias("floor"), F.ceil(x / 7).alias("ceil"), F.greatest(F.least("p_size", F.lit(40)), F.lit(10)).alias("clip"), F.round(F.exp(-(x / 10) * (x / 10) / 2) / 2.5066282746310002, 6).alias("density"), F.round(F.tanh(x / 30), 6).alias("tanh"), F.split("p_name", " ").getItem(0).alias("first_word"), F.substring("p_name", 1, 3).alias("head"), F.length("p_name").cast("long").alias("n"))


@query("l1_ingestion", sql("SELECT p.cell_id, p.chrom, p.bin1, p.bin2, count, qc, round(w, 6) AS weight FROM pixels p JOIN (SELECT cell_id, chrom, count(*) FILTER (WHERE bin1 <> bin2) AS qc FROM pixels GROUP BY ALL) c USING (cell_id, chrom) JOIN (SELECT cell_id, avg(count) AS w FROM pixels GROUP BY 1) w USING (cell_id) WHERE bin2 - bin1 >= 2", "pixels"))
def _(spark, d):
    """Contacts to training pixels with the cell's quality count and mean weight."""
    p = X.pixels(spark, d)
    qc = M.cell_counts(p).select(*CELL, "qc")
    return r6(C.trainable(p).join(qc, CELL).join(M.cell_weight(p), "cell_id"), "weight").select("cell_id", "chrom", "bin1", "bin2", "count", "qc", "weight")


@query("l3_compartment_tracks")
def _(spark, d):
    """Bulk axis by arm, cells projected, oriented by the calibration, with z-scores and quantiles of each cell."""
    from contactspark.sources.readers import on_bins

    index = X.index(spark)
    arms = M.split_arms(X.cytoband(spark)).withColumn("split", F.floor(F.col("split") / X.RES))
    masked = M.without_bins(X.bulk(spark, d), M.centromere_bins(X.cytoband(spark), X.RES, 0))
    cells = L.compartments(M.symmetric(X.pixels(spark, d)), CELL, index, arms, masked)
    bulk = L.compartments(masked, CHROM, index, arms).withColumnRenamed("score", "value")
    sign = T.orientation(bulk, on_bins(X.calibration(spark, d), index, X.RES).withColumnRenamed("value", "cal"), ["chrom", "arm"], "value").select("chrom", "arm", "sign")
    raw = cells.join(F.broadcast(sign), ["chrom", "arm"]).select("cell_id", "chrom", "bin", (F.col("score") * F.col("sign")).alias("raw"))
    z = T.z_score(raw.withColumn("z", F.col("raw")), ["cell_id"], "z")
    return r6(T.quantile_ranks(z.withColumn("quantile", F.col("raw")), ["cell_id"], "quantile"), "raw", "z", "quantile")


@query("l4_group_maps", sql("SELECT cell_type, chrom, bin1, bin2, round(sum(count) / n, 6) AS v FROM pixels JOIN labels_cells USING (cell_id) JOIN (SELECT cell_type, count(*) AS n FROM labels_cells GROUP BY 1) s USING (cell_type) WHERE NOT EXISTS (SELECT 1 FROM cytoband c WHERE c.type = 'acen' AND c.chrom = pixels.chrom AND ((bin1 >= c.start // 1000000 AND bin1 < ceil(c.stop / 1000000)) OR (bin2 >= c.start // 1000000 AND bin2 < ceil(c.stop / 1000000)))) GROUP BY cell_type, chrom, bin1, bin2, n", "pixels", "labels_cells", "cytoband"))
def _(spark, d):
    merged = M.merge_cells(X.pixels(spark, d), X.cell_labels(spark, d).select("cell_id", "cell_type"), "cell_type")
    gone = M.centromere_bins(X.cytoband(spark), X.RES, 0)
    for side in ("bin1", "bin2"):
        merged = merged.join(F.broadcast(gone.select("chrom", F.col("bin").alias(side))), ["chrom", side], "left_anti")
    return r6(merged, "v")
