"""Queries over ingestion, maps, statistics, masks and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from contactspark.operators import contacts as C
from contactspark.operators import maps as M
from contactspark.operators import order as O
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


@query("w1_bin_index", sql("SELECT * FROM seen_idx", "seen_idx"))
def _(spark, d):
    """Bins of the chromosomes, as long as the contacts show them to be."""
    return X.seen_index(spark, d)


@query("f1_not_short", sql("SELECT * FROM kept", "kept"))
def _(spark, d):
    return C.not_short(X.contacts(spark, d))


@query("f2_not_short_intra", sql("SELECT * FROM contacts WHERE chrom1 = chrom2 AND abs(pos2 - pos1) >= 2500", "contacts"))
def _(spark, d):
    return C.not_short_intra(X.contacts(spark, d))


@query("f3_f4_global_bins", sql(f"SELECT cell_id, a.chrom_idx AS chrom_idx1, b.chrom_idx AS chrom_idx2, pos1 // {X.RES} + a.start_bin AS bin1, pos2 // {X.RES} + b.start_bin AS bin2, count FROM contacts JOIN idx a ON a.chrom = chrom1 JOIN idx b ON b.chrom = chrom2", "contacts", "idx"))
def _(spark, d):
    return C.to_global_bins(X.contacts(spark, d), X.index(spark), X.RES).select("cell_id", "chrom_idx1", "chrom_idx2", "bin1", "bin2", "count")


@query("a1_pixels", sql("SELECT * FROM pixels", "pixels"))
def _(spark, d):
    return X.pixels(spark, d)


@query("a1_pixels_raw_order", sql(f"SELECT cell_id, chrom1 AS chrom, least(a, b) AS bin1, greatest(a, b) AS bin2, count FROM (SELECT cell_id, chrom1, pos1 // {X.RES} AS a, pos2 // {X.RES} AS b, CAST(sum(count) AS BIGINT) AS count FROM swapped WHERE chrom1 = chrom2 GROUP BY ALL)", "swapped"))
def _(spark, d):
    return C.intra_pixels(X.contacts(spark, d, swapped=True), X.RES, canonical=False)


@query("f5_pixels_canonical", sql(f"SELECT cell_id, chrom1 AS chrom, least(pos1 // {X.RES}, pos2 // {X.RES}) AS bin1, greatest(pos1 // {X.RES}, pos2 // {X.RES}) AS bin2, CAST(sum(count) AS BIGINT) AS count FROM swapped WHERE chrom1 = chrom2 GROUP BY ALL", "swapped"))
def _(spark, d):
    return C.intra_pixels(X.contacts(spark, d, swapped=True), X.RES)


@query("f5_pixels_inter", sql(f"SELECT cell_id, chrom1, chrom2, pos1 // {X.RES} AS bin1, pos2 // {X.RES} AS bin2, CAST(sum(count) AS BIGINT) AS count FROM contacts WHERE chrom1 <> chrom2 GROUP BY ALL", "contacts"))
def _(spark, d):
    return C.inter_pixels(X.contacts(spark, d), X.RES)


@query("f6_distance_filter", sql("SELECT * FROM pixels WHERE bin2 - bin1 > 1 AND bin2 - bin1 < 6", "pixels"))
def _(spark, d):
    return C.distance_filter(X.pixels(spark, d), 1, 6)


@query("f7_trainable", sql("SELECT * FROM pixels WHERE bin2 - bin1 >= 2", "pixels"))
def _(spark, d):
    return C.trainable(X.pixels(spark, d))


@query("f8_rescale", sql("SELECT cell_id, chrom, bin1 // 4 AS bin1, bin2 // 4 AS bin2, CAST(sum(count) AS BIGINT) AS count FROM pixels GROUP BY ALL", "pixels"))
def _(spark, d):
    return C.rescale(X.pixels(spark, d), 4)


KEYS = ["cell_id", "chrom", "bin1", "bin2"]
_HASH = "md5('{}:' || concat_ws(':', cell_id, chrom, bin1, bin2))"


@query("u5_downsample", sql(f"SELECT cell_id, chrom, bin1, bin2, count FROM (SELECT *, row_number() OVER (ORDER BY {_HASH.format(3)}, cell_id, chrom, bin1, bin2) AS r, count(*) OVER () AS n FROM pixels) WHERE r <= floor(0.3::DOUBLE * n)", "pixels"))
def _(spark, d):
    return C.exact_share(X.pixels(spark, d), 0.3, KEYS, 3).where("chosen").drop("chosen")


@query("u6_train_test_split", sql(f"SELECT cell_id, chrom, bin1, bin2, count, r <= floor(0.85::DOUBLE * n) AS chosen FROM (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY {_HASH.format(5)}, cell_id, chrom, bin1, bin2) AS r, count(*) OVER (PARTITION BY chrom) AS n FROM pixels WHERE bin2 - bin1 >= 2)", "pixels"))
def _(spark, d):
    return C.exact_share(C.trainable(X.pixels(spark, d)), 0.85, KEYS, 5, ["chrom"])


@query("a2_symmetric_map", sql("SELECT * FROM sym", "sym"))
def _(spark, d):
    return M.symmetric(X.pixels(spark, d))


@query("a3_gcn_map", sql("""SELECT f.cell_id, f.chrom, i, j, round(v * reads / (s + 1e-15::DOUBLE), 6) AS v FROM (
SELECT cell_id, chrom, i, j, CAST(v AS DOUBLE) AS v, sum(v) OVER (PARTITION BY cell_id, chrom) AS s FROM (SELECT cell_id, chrom, i, j, v FROM sym WHERE i <> j UNION ALL
SELECT c.cell_id, c.chrom, bin, bin, 1 FROM (SELECT DISTINCT cell_id, chrom FROM pixels) c JOIN bins USING (chrom) ANTI JOIN (SELECT cell_id, chrom, i AS bin FROM sym WHERE i <> j) e USING (cell_id, chrom, bin))) f
JOIN (SELECT chrom, sum(count) / 20.0::DOUBLE AS reads FROM pixels GROUP BY chrom) r USING (chrom)""", "sym", "bins"))
def _(spark, d):
    return r6(M.gcn_map(X.pixels(spark, d), X.index(spark), 20), "v")


@query("a4_cell_counts", sql("SELECT cell_id, chrom, CAST(sum(count) AS BIGINT) AS reads, count(*) FILTER (WHERE bin1 <> bin2) AS qc FROM pixels GROUP BY ALL", "pixels"))
def _(spark, d):
    return M.cell_counts(X.pixels(spark, d))


@query("a7_quality_flag", sql("""SELECT cell_id, qc, greatest(0.25::DOUBLE * size - 5, 0.0::DOUBLE) AS threshold, qc >= greatest(0.25 * size - 5, 0.0) AS good
FROM (SELECT cell_id, count(*) FILTER (WHERE bin1 <> bin2) AS qc FROM pixels GROUP BY 1), (SELECT count(*) AS size FROM (SELECT chrom, i, count(DISTINCT j) AS n FROM bulk GROUP BY ALL) WHERE n > 4)""", "bulk"))
def _(spark, d):
    return M.quality_flag(X.pixels(spark, d), X.index(spark))


@query("a5_a6_sparsity", sql("""SELECT cell_id, filled, possible, round(filled / possible, 6) AS sparsity FROM (SELECT cell_id, count(*) AS filled FROM (SELECT DISTINCT cell_id, chrom, bin1 // 2, bin2 // 2 FROM pixels) GROUP BY 1), (SELECT CAST(sum(floor((n_bins / 2) * (n_bins / 2) / 2)) AS BIGINT) AS possible FROM idx)""", "pixels", "idx"))
def _(spark, d):
    return r6(M.occupancy(X.pixels(spark, d), X.index(spark), 2), "sparsity")


@query("a6_median_sparsity", sql("""SELECT round(median(filled / 600.0::DOUBLE), 6) AS median_sparsity FROM (SELECT cell_id, count(*) AS filled FROM (SELECT DISTINCT cell_id, chrom, bin1 // 2, bin2 // 2 FROM pixels) GROUP BY 1)""", "pixels"))
def _(spark, d):
    middle = O.quantiles(M.occupancy(X.pixels(spark, d), X.index(spark), 2), "sparsity", [0.5])
    return spark.createDataFrame([tuple(middle)], "median_sparsity double").select(F.round("median_sparsity", 6).alias("median_sparsity"))


@query("a8_pseudo_bulk", sql("""SELECT chrom, i, j, round(v / sum(v) OVER (PARTITION BY chrom, i), 6) AS v FROM (SELECT chrom, i, j, least(v, top) AS v FROM
(SELECT chrom, i, j, CAST(sum(v) AS DOUBLE) AS v FROM (SELECT * FROM bulk UNION ALL SELECT chrom, bin, bin, 1 FROM bins ANTI JOIN (SELECT chrom, bin1 AS bin FROM sums) u USING (chrom, bin)) GROUP BY ALL) f JOIN
(SELECT chrom, s / 1600 + 10 * sqrt(q / 1600 - (s / 1600) ** 2) AS top FROM (SELECT chrom, CAST(sum(v) AS DOUBLE) AS s, CAST(sum(v * v) AS DOUBLE) AS q FROM (SELECT chrom, i, j, sum(v) AS v FROM (SELECT * FROM bulk UNION ALL SELECT chrom, bin, bin, 1 FROM bins ANTI JOIN (SELECT chrom, bin1 AS bin FROM sums) u USING (chrom, bin)) GROUP BY ALL) GROUP BY chrom)) m USING (chrom))""", "bulk", "bins"))
def _(spark, d):
    return r6(M.pseudo_bulk(X.pixels(spark, d), X.index(spark)), "v")


@query("a9_distance_decay", sql("SELECT chrom, bin2 - bin1 AS distance, round(avg(count), 6) AS mean FROM pixels GROUP BY ALL", "pixels"))
def _(spark, d):
    return r6(M.distance_decay(X.pixels(spark, d)), "mean")


@query("a10_cell_weight", sql("SELECT cell_id, round(avg(count), 6) AS weight FROM pixels GROUP BY ALL", "pixels"))
def _(spark, d):
    return r6(M.cell_weight(X.pixels(spark, d)), "weight")


@query("a11_arm_length", sql("SELECT chrom, name[1] AS arm, CAST(sum(stop - start) AS BIGINT) AS length FROM bands GROUP BY ALL", "bands"))
def _(spark, d):
    return M.arm_lengths(X.seen_bands(spark, d))


@query("n31_arm_split", sql("SELECT chrom, CAST(max(CASE WHEN len >= 15000000 THEN len END) AS BIGINT) AS split FROM (SELECT chrom, sum(stop - start) AS len FROM bands WHERE name[1] = 'p' GROUP BY chrom) GROUP BY chrom", "bands"))
def _(spark, d):
    return M.split_arms(X.seen_bands(spark, d), 15_000_000)


@query("a12_group_merge", sql("SELECT cell_type, chrom, bin1, bin2, round(sum(count) / n, 6) AS v FROM pixels JOIN labels_cells USING (cell_id) JOIN (SELECT cell_type, count(*) AS n FROM labels_cells GROUP BY 1) s USING (cell_type) GROUP BY cell_type, chrom, bin1, bin2, n", "pixels", "labels_cells"))
def _(spark, d):
    return r6(M.merge_cells(X.pixels(spark, d), X.cell_labels(spark, d).select("cell_id", "cell_type"), "cell_type"), "v")


@query("a13_selection_merge", sql("SELECT chrom, bin1, bin2, round(sum(count) / 3, 6) AS v FROM pixels WHERE cell_id IN (1, 4, 7) GROUP BY ALL", "pixels"))
def _(spark, d):
    return r6(M.select_cells(X.pixels(spark, d), [1, 4, 7]), "v")


@query("a14_label_counts", sql("SELECT cell_type, count(*) AS n FROM labels_cells GROUP BY 1", "labels_cells"))
def _(spark, d):
    return M.label_counts(X.cell_labels(spark, d), "cell_type")


@query("a15_histogram", sql("""SELECT CAST(least(floor((score - a) / ((b - a) / 20)), 19) AS INT) AS bucket, round(a + least(floor((score - a) / ((b - a) / 20)), 19) * ((b - a) / 20), 6) AS low, round(a + (least(floor((score - a) / ((b - a) / 20)), 19) + 1) * ((b - a) / 20), 6) AS high, count(*) AS n FROM scored, (SELECT min(score) AS a, max(score) AS b FROM scored) GROUP BY 1, 2, 3""", "scored"))
def _(spark, d):
    return r6(M.histogram(X.scored(spark, d), "score"), "low", "high")


@query("a16_expected", sql("SELECT chrom, j - i AS d, round(sum(v) / (count(*) FILTER (WHERE v <> 0) + 1e-15::DOUBLE), 6) AS expected FROM bulk GROUP BY ALL", "bulk"))
def _(spark, d):
    return r6(M.expected(X.bulk(spark, d), ["chrom"]), "expected")


@query("a19_near_ratio", sql("SELECT cell_id, round((2 * sum(CASE WHEN bin2 - bin1 < 3 THEN count ELSE 0 END) - sum(CASE WHEN bin1 = bin2 THEN count ELSE 0 END)) / sum(CASE WHEN bin1 = bin2 THEN count ELSE 2 * count END), 6) AS ratio FROM pixels GROUP BY 1", "pixels"))
def _(spark, d):
    return r6(M.near_ratio(X.pixels(spark, d), 3), "ratio")


@query("a20_read_count", sql("SELECT cell_id, reads, round(CASE WHEN max(reads) OVER () > 120 THEN log10(reads + 1) ELSE reads END, 6) AS shown FROM (SELECT cell_id, CAST(sum(count) AS BIGINT) AS reads FROM pixels GROUP BY 1)", "pixels"))
def _(spark, d):
    return r6(M.read_counts(X.pixels(spark, d), 120), "shown")


@query("f9_centromere_mask", sql("SELECT DISTINCT chrom, CAST(b AS BIGINT) AS bin FROM bands, range(60) r(b) WHERE type = 'acen' AND b >= greatest(floor((start - 100000) / 1000000), 0) AND b < ceil((stop + 100000) / 1000000)", "bands"))
def _(spark, d):
    return M.centromere_bins(X.seen_bands(spark, d), X.RES, 100_000)


@query("j4_masked_map", sql("""SELECT chrom, i, j, v FROM bulk ANTI JOIN (SELECT chrom, b AS i FROM cytoband, range(60) r(b) WHERE type = 'acen' AND b >= greatest(floor((start - 1000000) / 1000000), 0) AND b < ceil((stop + 1000000) / 1000000)) USING (chrom, i)
ANTI JOIN (SELECT chrom, b AS j FROM cytoband, range(60) r(b) WHERE type = 'acen' AND b >= greatest(floor((start - 1000000) / 1000000), 0) AND b < ceil((stop + 1000000) / 1000000)) USING (chrom, j)""", "bulk", "cytoband"))
def _(spark, d):
    return M.without_bins(X.bulk(spark, d), M.centromere_bins(X.cytoband(spark), X.RES, 1_000_000))


@query("f10_gap_mask", sql("SELECT chrom, CAST(bin AS BIGINT) AS bin FROM bins ANTI JOIN (SELECT chrom, i AS bin FROM bulk WHERE v <> 0) USING (chrom, bin)", "bins", "bulk"))
def _(spark, d):
    return M.gap_bins(X.bulk(spark, d), X.index(spark))


@query("f11_band", sql("SELECT * FROM bulk WHERE abs(i - j) < 5", "bulk"))
def _(spark, d):
    return M.band(X.bulk(spark, d), 5)


@query("f15_drop_sparse_rows", sql("""SELECT chrom, a.n AS i, b.n AS j, v FROM bulk JOIN (SELECT chrom, bin AS i, row_number() OVER (PARTITION BY chrom ORDER BY bin) - 1 AS n FROM (SELECT chrom, i AS bin, row_number() OVER (PARTITION BY chrom ORDER BY sum(v), i) AS r, count(*) OVER (PARTITION BY chrom) AS c FROM bulk GROUP BY chrom, i) WHERE r > floor(c * 10 / 100)) a USING (chrom, i)
JOIN (SELECT chrom, bin AS j, row_number() OVER (PARTITION BY chrom ORDER BY bin) - 1 AS n FROM (SELECT chrom, i AS bin, row_number() OVER (PARTITION BY chrom ORDER BY sum(v), i) AS r, count(*) OVER (PARTITION BY chrom) AS c FROM bulk GROUP BY chrom, i) WHERE r > floor(c * 10 / 100)) b USING (chrom, j)""", "bulk"))
def _(spark, d):
    return M.drop_sparse_rows(X.bulk(spark, d), ["chrom"], 10)


@query("f13_feature_columns", sql("SELECT chrom, bin1, bin2, count(DISTINCT cell_id) AS n FROM pixels GROUP BY ALL HAVING count(DISTINCT cell_id) > 5", "pixels"))
def _(spark, d):
    return X.pixels(spark, d).groupBy("chrom", "bin1", "bin2").agg(F.countDistinct("cell_id").alias("n")).where("n > 5")


@query("f14_value_threshold", sql("SELECT chrom, i, j, CASE WHEN v - m <= 1e-5 THEN 0 ELSE v - m END AS v FROM bulk, (SELECT min(v) AS m FROM bulk)", "bulk"))
def _(spark, d):
    bulk = X.bulk(spark, d)
    low = bulk.agg(F.min("v").alias("m"))
    return bulk.join(F.broadcast(low)).select("chrom", "i", "j", F.when(F.col("v") - F.col("m") <= 1e-5, F.lit(0)).otherwise(F.col("v") - F.col("m")).alias("v"))


@query("j5_bin_pairs", sql("SELECT chrom, a.bin AS bin1, b.bin AS bin2 FROM seen_bins a JOIN seen_bins b USING (chrom) WHERE b.bin >= a.bin + 2 AND b.bin < a.bin + 7", "seen_bins"))
def _(spark, d):
    return M.bin_pairs(X.seen_index(spark, d), 2, 7)


@query("j2_label_join", sql("SELECT cell_id, cell_type, batch, CAST(sum(count) AS BIGINT) AS reads FROM pixels JOIN labels_cells USING (cell_id) GROUP BY ALL", "pixels", "labels_cells"))
def _(spark, d):
    return X.pixels(spark, d).groupBy("cell_id").agg(F.sum("count").alias("reads")).join(X.cell_labels(spark, d), "cell_id")


@query("j3_semi_join", sql("SELECT * FROM pixels WHERE cell_id IN (SELECT cell_id FROM labels_cells WHERE cell_type = 'type1')", "pixels", "labels_cells"))
def _(spark, d):
    return X.pixels(spark, d).join(X.cell_labels(spark, d).where("cell_type = 'type1'"), "cell_id", "left_semi")


@query("j7_neighbour_map", sql("""SELECT cell AS cell_id, chrom, bin1, bin2, round(sum(w * count), 6) AS v FROM (SELECT a.cell_id AS cell, b.cell_id AS nbr, 1.0::DOUBLE / (1 + abs(a.cell_id - b.cell_id)) AS w FROM labels_cells a JOIN labels_cells b ON abs(a.cell_id - b.cell_id) <= 2) n JOIN pixels p ON p.cell_id = n.nbr GROUP BY ALL""", "pixels", "labels_cells"))
def _(spark, d):
    cells = X.cell_labels(spark, d).select(F.col("cell_id").alias("cell"))
    near = cells.select("cell", F.explode(F.sequence(F.col("cell") - 2, F.col("cell") + 2)).alias("nbr")).join(cells.withColumnRenamed("cell", "nbr"), "nbr", "left_semi")
    near = near.withColumn("weight", F.lit(1.0) / (1 + F.abs(F.col("cell") - F.col("nbr"))))
    return r6(M.neighbour_sum(X.pixels(spark, d), near), "v")
