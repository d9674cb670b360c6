"""Queries over exports, pipelines and extensions on the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from contactspark.operators import explorer as E
from contactspark.operators import linalg as L
from contactspark.operators import maps as M
from contactspark.operators import norms as N
from contactspark.operators import tracks as T
from contactspark.operators.tables import run_dir
from contactspark.plans import fixtures as X
from contactspark.plans.features import SCORES
from contactspark.plans.fixtures import r6, sql
from contactspark.sources import writers as W
from contactspark.streaming.pixels import event_counts

QUERIES, ORACLE = {}, {}


def query(name: str, text: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if text:
            ORACLE[name] = text
        return f

    return keep


@query("s18_cool_bins", sql('SELECT start_bin + bin AS bin_id, chrom, bin * 1000000 AS start, (bin + 1) * 1000000 AS "end" FROM seen_bins', "seen_bins"))
def _(spark, d):
    return W.cool_tables(X.pixels(spark, d), X.seen_index(spark, d), X.RES)[0]


@query("s18_cool_pixels", sql("SELECT cell_id, start_bin + bin1 AS bin1_id, start_bin + bin2 AS bin2_id, CAST(count AS FLOAT) AS count FROM pixels JOIN idx USING (chrom) WHERE bin2 >= bin1", "pixels", "idx"))
def _(spark, d):
    return W.cool_tables(X.pixels(spark, d), X.index(spark), X.RES)[1]


@query("s9_bulk_scaled", sql("SELECT chrom, i, j, round(v * 40 / sum(v) OVER (PARTITION BY chrom), 6) AS v FROM (SELECT chrom, bin1 AS i, bin2 AS j, count AS v FROM sums UNION ALL SELECT chrom, bin2, bin1, count FROM sums WHERE bin1 <> bin2)", "sums"))
def _(spark, d):
    from contactspark.sources.readers import bulk_map

    bins, rows = W.cool_tables(X.pixels(spark, d).groupBy("chrom", "bin1", "bin2").agg(F.sum("count").alias("count")).withColumn("cell_id", F.lit(0)), X.index(spark), X.RES)
    return r6(bulk_map(bins, rows.withColumn("count", F.col("count").cast("double")), X.index(spark), X.bulk(spark, d), X.RES), "v")


def _imputed(spark, d):
    return N.mean3(M.symmetric(X.pixels(spark, d)), ["cell_id", "chrom"], X.index(spark)).where("i <= j").withColumnRenamed("v", "p")


_IMP = ", imputed AS (SELECT cell_id, chrom, i + x AS i, j + y AS j, sum(v) / 9 AS p FROM sym, (VALUES (-1), (0), (1)) a(x), (VALUES (-1), (0), (1)) b(y) WHERE i + x BETWEEN 0 AND 39 AND j + y BETWEEN 0 AND 39 AND i + x <= j + y GROUP BY cell_id, chrom, 3, 4)\nSELECT"


@query("s17_linked_parts", sql("SELECT cell_id, chrom, i, j, round(p / m + coalesce(q / n, 0), 6) AS p FROM imputed JOIN (SELECT cell_id, chrom, avg(p) AS m FROM imputed GROUP BY ALL) USING (cell_id, chrom) LEFT JOIN (SELECT cell_id, chrom, i, j, count AS q, avg(count) OVER (PARTITION BY cell_id, chrom) AS n FROM (SELECT cell_id, chrom, bin1 AS i, bin2 AS j, count FROM pixels)) USING (cell_id, chrom, i, j)", "sym").replace("\nSELECT", _IMP, 1))
def _(spark, d):
    second = X.pixels(spark, d).select("cell_id", "chrom", F.col("bin1").alias("i"), F.col("bin2").alias("j"), F.col("count").alias("p"))
    return r6(W.linked(_imputed(spark, d), second), "p")


@query("s23_fetch_map", sql("SELECT 'raw' AS stage, bin1 AS i, bin2 AS j, round(count, 6) AS p FROM pixels WHERE cell_id = 3 AND chrom = 'chr2' UNION ALL SELECT 'imputed', i, j, round(p, 6) FROM imputed WHERE cell_id = 3 AND chrom = 'chr2'", "sym").replace("\nSELECT", _IMP, 1))
def _(spark, d):
    raw = X.pixels(spark, d).select(F.lit("raw").alias("stage"), "cell_id", "chrom", F.col("bin1").alias("i"), F.col("bin2").alias("j"), F.col("count").cast("double").alias("p"))
    both = raw.unionByName(_imputed(spark, d).withColumn("stage", F.lit("imputed")))
    return r6(both.where("cell_id = 3 and chrom = 'chr2'").select("stage", "i", "j", "p"), "p")


def _written(spark, rows, index, append=None):
    """Rows written as a table of cell maps in this run's folder; its path."""
    path = f"{run_dir(spark)}/cellmaps-{uuid.uuid4().hex}"
    W.cell_maps(rows, index, X.RES, path)
    if append is not None:
        W.cell_maps(append, index, X.RES, path, append=True)
    return path


@query("s19_imputed_export", sql("SELECT cell_id, chrom, i AS bin1, j AS bin2, round(CAST(p AS FLOAT), 3) AS count FROM imputed WHERE cell_id IN (3, 17)", "sym").replace("\nSELECT", _IMP, 1))
def _(spark, d):
    """Imputed maps written in two goes and two cells read back."""
    rows = _imputed(spark, d).select("cell_id", "chrom", F.col("i").alias("bin1"), F.col("j").alias("bin2"), F.col("p").alias("count"))
    path = _written(spark, rows.where("cell_id < 10"), X.index(spark), rows.where("cell_id >= 10"))
    return W.read_cell_maps(spark, path, [3, 17]).withColumn("count", F.round("count", 3))


@query("s19_walked_export", sql("SELECT cell_id, chrom, CAST(count(*) AS BIGINT) AS pixels FROM (SELECT DISTINCT cell_id, chrom, bin1, bin2 FROM pixels) GROUP BY ALL", "pixels"))
def _(spark, d):
    """Walked maps written and read back; of each cell's map how many of its own pixels came back, as a walk reaches all of them."""
    walked = L.random_walk(M.symmetric(X.pixels(spark, d)), ["cell_id", "chrom"], X.index(spark)).where("i <= j")
    diagonal = X.pixels(spark, d).where("bin1 = bin2").select("cell_id", "chrom", F.col("bin1").alias("i"), F.col("bin2").alias("j"), F.lit(1.0).alias("v"))
    rows = walked.unionByName(diagonal).select("cell_id", "chrom", F.col("i").alias("bin1"), F.col("j").alias("bin2"), F.col("v").alias("count"))
    back = W.read_cell_maps(spark, _written(spark, rows, X.index(spark)))
    return back.join(X.pixels(spark, d).select("cell_id", "chrom", "bin1", "bin2"), ["cell_id", "chrom", "bin1", "bin2"]).groupBy("cell_id", "chrom").agg(F.count("*").alias("pixels"))


@query("s20_merged_export", sql("SELECT CAST(0 AS BIGINT) AS cell_id, chrom, bin1, bin2, round(CAST(sum(count) / 4.0::DOUBLE AS FLOAT), 3) AS count FROM pixels WHERE cell_id IN (1, 4, 9, 16) GROUP BY chrom, bin1, bin2", "pixels"))
def _(spark, d):
    """The mean map of a selection written and read back."""
    path = _written(spark, W.merged(M.select_cells(X.pixels(spark, d), [1, 4, 9, 16])), X.index(spark))
    return W.read_cell_maps(spark, path).withColumn("count", F.round("count", 3))


_CELLS = "cells AS (SELECT vec_id AS cell_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, 'type' || CAST(vec_id % 4 AS VARCHAR) AS label, reads AS value FROM embeddings JOIN (SELECT cell_id AS vec_id, CAST(sum(count) AS DOUBLE) AS reads FROM pixels GROUP BY 1) USING (vec_id))"


@query("l5_selection", sql(f"""@SELECT 'cell' AS part, NULL::VARCHAR AS chrom, cell_id AS a, NULL::BIGINT AS b, NULL::VARCHAR AS name, 1.0::DOUBLE AS value FROM picked
UNION ALL SELECT 'label', NULL, NULL, NULL, label, count(*) FROM cells JOIN picked USING (cell_id) GROUP BY label
UNION ALL SELECT 'histogram', NULL, CAST(least(floor((value - lo) / ((hi - lo) / 20)), 19) AS BIGINT), NULL, NULL, count(*) FROM cells JOIN picked USING (cell_id), (SELECT min(value) AS lo, max(value) AS hi FROM cells) GROUP BY 3
UNION ALL SELECT 'map', chrom, bin1, bin2, NULL, round(sum(count) / 6.0::DOUBLE, 6) FROM pixels JOIN picked USING (cell_id) GROUP BY chrom, bin1, bin2""", "pixels").replace("\n@", f",\n{_CELLS},\npicked AS (SELECT c.cell_id FROM cells c, (SELECT x AS cx, y AS cy FROM cells WHERE cell_id = 3) ORDER BY (x - cx) ** 2 + (y - cy) ** 2, cell_id LIMIT 6)\n", 1))
def _(spark, d):
    """A picked cell grown to its six nearest: their labels, a histogram of their reads on the edges of all, their mean map."""
    p, e = X.pixels(spark, d), F.col("embedding")
    reads = p.groupBy("cell_id").agg(F.sum("count").cast("double").alias("value"))
    places = X.table(spark, d, "embeddings").select(F.col("vec_id").alias("cell_id"), e[0].cast("double").alias("x"), e[1].cast("double").alias("y"), F.concat(F.lit("type"), F.col("vec_id") % 4).alias("label"))
    return r6(E.selection(places.join(reads, "cell_id"), p, [3], 6), "value")


@query("s12_signal_matrix", sql("SELECT cell_id, c.chrom, CAST(c.bin AS BIGINT) AS bin, c.signal, round(coalesce(z, 0), 6) AS value FROM (SELECT l.cell_id, b.chrom, b.bin, s.signal FROM labels_cells l, bins b, (SELECT DISTINCT signal FROM signals) s) c LEFT JOIN (SELECT *, (value - avg(value) OVER (PARTITION BY signal)) / stddev_pop(value) OVER (PARTITION BY signal) AS z FROM signals) z USING (cell_id, chrom, bin, signal)", "labels_cells", "bins", "signals"))
def _(spark, d):
    signals = X.signals(spark, d)
    z = T.z_score(signals, ["signal"], "value")
    cells = X.cell_labels(spark, d).select("cell_id").crossJoin(F.broadcast(M.grid(X.index(spark)))).crossJoin(F.broadcast(signals.select("signal").distinct()))
    return cells.join(z, ["cell_id", "chrom", "bin", "signal"], "left").select("cell_id", "chrom", "bin", "signal", F.round(F.coalesce("value", F.lit(0.0)), 6).alias("value"))


@query("l2_boundaries_bulk", (sql("@", "bulk", "bins").replace("\n@", SCORES.replace("FROM bulk JOIN bins b ON b.chrom = bulk.chrom", "FROM nb JOIN bins b ON b.chrom = nb.chrom") + "\nSELECT chrom, bin, round(score, 6) AS score, coalesce(score < min(score) OVER (PARTITION BY chrom ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AND score < min(score) OVER (PARTITION BY chrom ORDER BY bin ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AND score > 0 AND score < 0.999, false) AS boundary FROM ins", 1).replace(",\nins AS", ",\nnb AS (SELECT chrom, i, j, v / sqrt(s) / sqrt(t) AS v FROM bulk JOIN (SELECT chrom, i, sum(v) AS s FROM bulk GROUP BY ALL) a USING (chrom, i) JOIN (SELECT chrom, i AS j, sum(v) AS t FROM bulk GROUP BY ALL) b USING (chrom, j)),\nins AS", 1)))
def _(spark, d):
    """Coverage norm, insulation, boundaries of the summed map."""
    scores = T.insulation(N.coverage_sqrt(X.bulk(spark, d), ["chrom"]), ["chrom"], X.index(spark), 3)
    return r6(T.local_minima(scores, ["chrom"], 2), "score")


_CELLS = """, nb AS (SELECT s.cell_id, s.chrom, s.i, s.j, s.v / sqrt(a.s) / sqrt(b.s) AS v FROM sym s JOIN (SELECT cell_id, chrom, i, sum(v) AS s FROM sym GROUP BY ALL) a USING (cell_id, chrom, i) JOIN (SELECT cell_id, chrom, i, sum(v) AS s FROM sym GROUP BY ALL) b ON b.cell_id = s.cell_id AND b.chrom = s.chrom AND b.i = s.j),
boxes AS (SELECT n.cell_id, b.chrom, b.bin, sum(CASE WHEN i >= bin - 3 AND i < bin AND j > bin AND j < least(39, bin + 4) THEN v ELSE 0 END) AS x, sum(v) AS y FROM nb n JOIN bins b ON b.chrom = n.chrom AND i BETWEEN bin - 3 AND bin + 3 AND j BETWEEN bin - 3 AND bin + 3 GROUP BY ALL),
ins AS (SELECT c.cell_id, c.chrom, CAST(b.bin AS BIGINT) AS bin, round(coalesce(x / nullif(y, 0), 1), 9) AS score FROM (SELECT DISTINCT cell_id, chrom FROM sym) c JOIN bins b USING (chrom) LEFT JOIN boxes USING (cell_id, chrom, bin))
SELECT cell_id, chrom, bin, round(score, 6) AS score, coalesce(score < min(score) OVER (PARTITION BY cell_id, chrom ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AND score < min(score) OVER (PARTITION BY cell_id, chrom ORDER BY bin ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AND score > 0 AND score < 0.999, false) AS boundary FROM ins"""


@query("l2_boundaries_cells", sql("@", "sym", "bins").replace("\n@", _CELLS, 1))
def _(spark, d):
    """The same for each cell; scores are compared to nine decimals, so that equal boxes summed in another order stay equal."""
    keys = ["cell_id", "chrom"]
    scores = T.insulation(N.coverage_sqrt(M.symmetric(X.pixels(spark, d)), keys), keys, X.index(spark), 3)
    return r6(T.local_minima(scores.withColumn("score", F.round("score", 9)), keys, 2), "score")


@query("x_event_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def _(spark, d):
    out = event_counts(X.table(spark, d, "events"))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))
