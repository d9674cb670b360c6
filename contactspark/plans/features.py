"""Queries over normalisations, convolutions, tracks and sequence composition."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from contactspark.operators import maps as M
from contactspark.operators import norms as N
from contactspark.operators import tracks as T
from contactspark.operators.order import tie_ranked
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


@query("n1_coverage_sqrt", sql("SELECT chrom, i, j, round(v / sqrt(s) / sqrt(t), 6) AS v FROM bulk JOIN (SELECT chrom, i, sum(v) AS s FROM bulk GROUP BY ALL) a USING (chrom, i) JOIN (SELECT chrom, i AS j, sum(v) AS t FROM bulk GROUP BY ALL) b USING (chrom, j)", "bulk"))
def _(spark, d):
    return r6(N.coverage_sqrt(X.bulk(spark, d), CHROM), "v")


@query("n2_observed_expected", sql("SELECT chrom, i, j, round(CASE WHEN i = j THEN 1 ELSE v / e END, 6) AS v FROM bulk JOIN (SELECT chrom, j - i AS d, sum(v) / (count(*) + 1e-15::DOUBLE) AS e FROM bulk GROUP BY ALL) x USING (chrom) WHERE x.d = j - i", "bulk"))
def _(spark, d):
    return r6(N.observed_expected(X.bulk(spark, d), CHROM), "v")


@query("n6_signed_log", sql("SELECT chrom, i, j, round(log2(1 + abs(v)) * sign(v), 6) AS l2, round(log10(v), 6) AS l10 FROM bulk", "bulk"))
def _(spark, d):
    return X.bulk(spark, d).select("chrom", "i", "j", F.round(N.signed_log2(F.col("v")), 6).alias("l2"), F.round(F.log10("v"), 6).alias("l10"))


@query("n7_mean3", sql("SELECT chrom, i + x AS i, j + y AS j, round(sum(v) / 9, 6) AS v FROM bulk, (VALUES (-1), (0), (1)) a(x), (VALUES (-1), (0), (1)) b(y) WHERE i + x BETWEEN 0 AND 39 AND j + y BETWEEN 0 AND 39 GROUP BY chrom, 2, 3", "bulk"))
def _(spark, d):
    return r6(N.mean3(X.bulk(spark, d), CHROM, X.index(spark)), "v")


_G = "(VALUES (-1, exp(-0.5) / (1 + 2 * exp(-0.5))), (0, 1 / (1 + 2 * exp(-0.5))), (1, exp(-0.5) / (1 + 2 * exp(-0.5))))"


@query("n11_gauss3", sql(f"""SELECT chrom, i, j, round(v / sum(v) OVER (PARTITION BY chrom), 6) AS v FROM (SELECT chrom, CASE WHEN i + x < 0 THEN -1 - i - x WHEN i + x > 39 THEN 79 - i - x ELSE i + x END AS i, CASE WHEN j + y < 0 THEN -1 - j - y WHEN j + y > 39 THEN 79 - j - y ELSE j + y END AS j, sum(v * w * u) AS v FROM bulk, {_G} a(x, w), {_G} b(y, u) GROUP BY chrom, 2, 3)""", "bulk"))
def _(spark, d):
    return r6(N.gauss3(X.bulk(spark, d), CHROM, X.index(spark)), "v")


@query("n12_row_moving_average", sql("SELECT chrom, bin AS i, j, round(sum(v * exp(0 - k * k / 2) / sqrt(2 * pi())), 6) AS v FROM bins JOIN range(-2, 3) r(k) ON true JOIN bulk USING (chrom) WHERE bulk.i = greatest(least(bin + k, 39), 0) GROUP BY chrom, bin, j", "bulk", "bins"))
def _(spark, d):
    return r6(N.row_moving_average(X.bulk(spark, d), CHROM, X.index(spark), 1), "v")


@query("n13_log_rows", sql("SELECT cell_id, chrom, i, j, round(ln(1 + v) / sum(ln(1 + v)) OVER (PARTITION BY cell_id, chrom, i), 6) AS v FROM sym", "sym"))
def _(spark, d):
    return r6(N.log_rows(M.symmetric(X.pixels(spark, d)), CELL), "v")


@query("n16_pool_columns", sql("SELECT chrom, i, j // 4 AS j, round(sum(v) / 4, 6) AS v FROM bulk GROUP BY chrom, i, j // 4", "bulk"))
def _(spark, d):
    return r6(N.pool_columns(X.bulk(spark, d), CHROM, 4), "v")


@query("n8_walk_two_steps", sql("""SELECT chrom, i, j, round(v, 6) AS v FROM (SELECT chrom, i, j, sum(v) AS v FROM (
SELECT a.chrom, a.i, b.j, 0.5 * a.v * b.v AS v FROM q1 a JOIN p b ON a.chrom = b.chrom AND a.j = b.i UNION ALL SELECT chrom, bin, bin, 0.5 FROM bins) GROUP BY ALL) WHERE i <> j""", "bulk", "bins").replace("\nSELECT chrom, i, j, round", """,
off AS (SELECT chrom, i, j, CAST(v AS DOUBLE) AS v FROM bulk WHERE i <> j UNION ALL SELECT chrom, bin, bin, 1 FROM bins ANTI JOIN (SELECT chrom, j AS bin FROM bulk WHERE i <> j) e USING (chrom, bin)),
p AS (SELECT chrom, i, j, v / sum(v) OVER (PARTITION BY chrom, j) AS v FROM off),
q1 AS (SELECT chrom, i, j, sum(v) AS v FROM (SELECT chrom, i, j, 0.5 * v AS v FROM p UNION ALL SELECT chrom, bin, bin, 0.5 FROM bins) GROUP BY ALL)
SELECT chrom, i, j, round""", 1))
def _(spark, d):
    return r6(N.walk(X.bulk(spark, d), CHROM, X.index(spark), 2), "v")


@query("n14_batch_coverage", sql("""SELECT chrom, batch, i, round(correlation, 6) AS correlation, round(CASE WHEN correlation < 0.8 THEN CASE WHEN s > 0 THEN t / s ELSE 0 END ELSE 1 END, 6) AS scale FROM
(SELECT chrom, batch, i, s, t FROM f) JOIN (SELECT chrom, batch, corr(rs, rt) AS correlation FROM (SELECT chrom, batch, rank() OVER (PARTITION BY chrom, batch ORDER BY s) + (count(*) OVER (PARTITION BY chrom, batch, s) - 1) / 2 AS rs, rank() OVER (PARTITION BY chrom, batch ORDER BY t) + (count(*) OVER (PARTITION BY chrom, batch, t) - 1) / 2 AS rt FROM f) GROUP BY ALL) USING (chrom, batch)""", "sym", "labels_cells").replace("\nSELECT chrom, batch, i, round", """,
b AS (SELECT chrom, batch, i, sum(v) AS v FROM sym JOIN labels_cells USING (cell_id) GROUP BY ALL),
g AS (SELECT chrom, i, sum(v) / sum(sum(v)) OVER (PARTITION BY chrom) AS t FROM sym GROUP BY chrom, i),
f AS (SELECT g.chrom, x.batch, g.i, coalesce(s, 0) AS s, t FROM g JOIN (SELECT DISTINCT chrom, batch FROM b) x USING (chrom) LEFT JOIN (SELECT chrom, batch, i, v / sum(v) OVER (PARTITION BY chrom, batch) AS s FROM b) y ON y.chrom = g.chrom AND y.batch = x.batch AND y.i = g.i)
SELECT chrom, batch, i, round""", 1))
def _(spark, d):
    return r6(N.match_coverage(M.symmetric(X.pixels(spark, d)), X.cell_labels(spark, d).select("cell_id", "batch")), "correlation", "scale")


SCORES = """,
ins AS (SELECT chrom, bin, coalesce(x / nullif(y, 0), 1) AS score FROM bins LEFT JOIN (SELECT b.chrom, b.bin, sum(CASE WHEN i >= bin - 3 AND i < bin AND j > bin AND j < least(39, bin + 4) THEN v ELSE 0 END) AS x, sum(v) AS y
  FROM bulk JOIN bins b ON b.chrom = bulk.chrom AND i BETWEEN bin - 3 AND bin + 3 AND j BETWEEN bin - 3 AND bin + 3 GROUP BY ALL) s USING (chrom, bin))"""


def _scored(body: str, *parts: str) -> str:
    return sql("@" + body, "bulk", "bins", *parts).replace("\n@", SCORES + "\n", 1)


def _scores(spark, d):
    return T.insulation(X.bulk(spark, d), CHROM, X.index(spark), 3)


@query("n26_insulation", _scored("SELECT chrom, bin, round(score, 6) AS score FROM ins"))
def _(spark, d):
    return r6(_scores(spark, d), "score")


_MIN = "SELECT chrom, bin, score, coalesce(score < min(score) OVER (PARTITION BY chrom ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AND score < min(score) OVER (PARTITION BY chrom ORDER BY bin ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AND score > 0 AND score < 0.999, false) AS boundary FROM ins"


@query("w6_boundaries", _scored(f"SELECT chrom, bin, round(score, 6) AS score, boundary FROM ({_MIN})"))
def _(spark, d):
    return r6(T.local_minima(_scores(spark, d), CHROM, 2), "score")


@query("f12_reliable_rows", sql("SELECT chrom, i AS bin, s > 0.01 * sum(s) OVER (PARTITION BY chrom) / 40 AS reliable FROM (SELECT chrom, i, sum(v) AS s FROM bulk GROUP BY ALL)", "bulk"))
def _(spark, d):
    return T.reliable_rows(X.bulk(spark, d), CHROM, X.index(spark))


@query("w3_cumulative", _scored("SELECT chrom, bin, round(score, 6) AS score, round(sum(score) OVER (PARTITION BY chrom ORDER BY bin), 6) AS cum FROM ins"))
def _(spark, d):
    return r6(T.cumulative(_scores(spark, d), CHROM), "score", "cum")


_CUM = ", cums AS (SELECT *, sum(score) OVER (PARTITION BY chrom ORDER BY bin) AS cum FROM ins)"
_DIST = "abs(x.cum - y.cum - (a - b) * (SELECT min(score) FROM ins z WHERE z.chrom = x.chrom AND z.bin BETWEEN least(a, b) AND greatest(a, b)))"


@query("n27_score_distance", _scored(f"SELECT p.chrom, a, b, round({_DIST}, 6) AS distance FROM (SELECT chrom, bin AS a, bin + 3 AS b FROM bins WHERE bin < 37) p JOIN cums x ON x.chrom = p.chrom AND x.bin = a JOIN cums y ON y.chrom = p.chrom AND y.bin = b").replace(SCORES, SCORES + _CUM))
def _(spark, d):
    pairs = M.grid(X.index(spark)).where("bin < 37").select("chrom", F.col("bin").alias("a"), (F.col("bin") + 3).alias("b"))
    return r6(T.score_distance(_scores(spark, d), pairs, CHROM), "distance")


@query("j8_nearest_shared", _scored(f"""SELECT chrom, a AS bin, b AS shared, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY chrom, a ORDER BY distance, b) AS k FROM (SELECT p.chrom, a, b, {_DIST} AS distance FROM (
SELECT DISTINCT o.chrom, o.bin AS a, CASE WHEN u.s = 0 THEN (SELECT max(bin) FROM shared s WHERE s.chrom = o.chrom AND s.bin <= o.bin) ELSE (SELECT min(bin) FROM shared s WHERE s.chrom = o.chrom AND s.bin >= o.bin) END AS b FROM own o, (VALUES (0), (1)) u(s)) p
JOIN cums x ON x.chrom = p.chrom AND x.bin = a JOIN cums y ON y.chrom = p.chrom AND y.bin = b)) WHERE k = 1""").replace(SCORES, SCORES + _CUM + f", own AS (SELECT chrom, bin FROM ({_MIN}) WHERE boundary), shared AS (SELECT chrom, bin FROM bins WHERE bin % 7 = 0)"))
def _(spark, d):
    scores = _scores(spark, d)
    own = T.local_minima(scores, CHROM, 2).where("boundary").select("chrom", "bin")
    return r6(T.nearest_shared(own, M.grid(X.index(spark)).where("bin % 7 = 0"), scores, CHROM), "distance")


@query("w4_boundary_gaps", _scored(f"SELECT chrom, bin, bin - lag(bin) OVER (PARTITION BY chrom ORDER BY bin) AS gap, coalesce(bin - lag(bin) OVER (PARTITION BY chrom ORDER BY bin) <= 3, false) AS close FROM ({_MIN}) WHERE boundary"))
def _(spark, d):
    return T.boundary_gaps(T.local_minima(_scores(spark, d), CHROM, 2).where("boundary").select("chrom", "bin"), CHROM, 3)


@query("w8_z_score", _scored("SELECT chrom, bin, round((score - avg(score) OVER (PARTITION BY chrom)) / stddev_pop(score) OVER (PARTITION BY chrom), 6) AS score FROM ins"))
def _(spark, d):
    return r6(T.z_score(_scores(spark, d), CHROM, "score"), "score")


@query("w9_quantile_ranks", sql("SELECT chrom, i, j, round((2 * rank() OVER (PARTITION BY chrom ORDER BY v) + count(*) OVER (PARTITION BY chrom, v) - 3) / 2 / (count(*) OVER (PARTITION BY chrom) - 1), 6) AS v FROM bulk", "bulk"))
def _(spark, d):
    return r6(T.quantile_ranks(X.bulk(spark, d), CHROM, "v"), "v")


@query("w12_tie_rank", sql("SELECT chrom, i, j, v, rank() OVER (PARTITION BY chrom ORDER BY v) + (count(*) OVER (PARTITION BY chrom, v) - 1) / 2 AS r FROM bulk", "bulk"))
def _(spark, d):
    return tie_ranked(X.bulk(spark, d), CHROM, {"r": "v"})


@query("w13_rank_match", _scored("SELECT a.chrom, a.bin, round(b.s, 6) AS score FROM (SELECT chrom, bin, row_number() OVER (PARTITION BY chrom ORDER BY score, bin) AS r FROM ins) a JOIN (SELECT chrom, s, row_number() OVER (PARTITION BY chrom ORDER BY s, i) AS r FROM (SELECT chrom, i, CAST(sum(v) AS DOUBLE) AS s FROM bulk GROUP BY ALL)) b USING (chrom, r)"))
def _(spark, d):
    rows = X.bulk(spark, d).groupBy("chrom", F.col("i").alias("bin")).agg(F.sum("v").cast("double").alias("score"))
    return r6(T.rank_match(_scores(spark, d), rows, CHROM, "score"), "score")


@query("w7_smooth", _scored("""SELECT t.chrom, t.place, round(sum(w * score), 6) AS score FROM (SELECT chrom, place, w, CASE WHEN place + k < 4 THEN 4 - place - k WHEN place + k < 44 THEN place + k - 4 ELSE 82 - place - k END AS b FROM idx, range(44) r(place), (SELECT k, (0.54 - 0.46 * cos(2 * pi() * k / 4)) / 2.24 AS w FROM range(5) s(k))) t JOIN ins ON ins.chrom = t.chrom AND ins.bin = t.b GROUP BY ALL"""))
def _(spark, d):
    return r6(T.smooth(_scores(spark, d), CHROM, "score", 5, "hamming"), "score")


@query("s7_calibration", sql("SELECT chrom, CAST(b.bin AS BIGINT) AS bin, CASE WHEN c.chrom IS NULL THEN 0 WHEN value = -1 THEN NULL ELSE value END AS value FROM bins b LEFT JOIN (SELECT chrom, bin // 1000000 AS bin, value FROM calibration) c USING (chrom, bin)", "bins", "calibration"))
def _(spark, d):
    from contactspark.sources.readers import on_bins

    return on_bins(X.calibration(spark, d), X.index(spark), X.RES)


@query("n30_orientation", _scored("""SELECT chrom, round(avg(value) FILTER (WHERE score > hi), 6) AS high, round(avg(value) FILTER (WHERE score < lo), 6) AS low, CASE WHEN avg(value) FILTER (WHERE score > hi) < avg(value) FILTER (WHERE score < lo) THEN -1 ELSE 1 END AS sign
FROM ins JOIN (SELECT chrom, bin // 1000000 AS bin, CASE WHEN value <> -1 THEN value END AS value FROM calibration) USING (chrom, bin) JOIN (SELECT chrom, quantile_cont(score, 0.9) AS hi, quantile_cont(score, 0.1) AS lo FROM ins GROUP BY 1) USING (chrom) GROUP BY chrom""", "calibration"))
def _(spark, d):
    from contactspark.sources.readers import on_bins

    cal = on_bins(X.calibration(spark, d), X.index(spark), X.RES).withColumnRenamed("value", "cal")
    return r6(T.orientation(_scores(spark, d), cal, CHROM, "score"), "high", "low")


@query("n29_cpg_windows", sql("""SELECT chrom, w * 1000 AS start, w * 1000 + 1000 AS "end", round(CASE WHEN pairs > 0 THEN cg / pairs ELSE 0 END, 6) AS rate FROM (SELECT chrom, w, len(regexp_extract_all(s, 'CG'))::DOUBLE AS cg,
999 - 2 * n + (n - len(regexp_extract_all(s, 'N+'))) + CASE WHEN s[1] = 'N' OR s[-1] = 'N' THEN 1 ELSE 0 END AS pairs FROM (SELECT chrom, w, substring(sequence, (w * 1000 + 1)::INT, 1000) AS s, len(regexp_extract_all(substring(sequence, (w * 1000 + 1)::INT, 1000), 'N')) AS n FROM (SELECT chrom, sequence, unnest(range(len(sequence) // 1000)) AS w FROM genome)))""", "genome"))
def _(spark, d):
    return r6(T.cpg_windows(X.genome(spark, d), 1000), "rate")


@query("w15_standard_scale", sql("SELECT cell_id, chrom, bin, signal, round((value - avg(value) OVER p) / nullif(stddev_pop(value) OVER p, 0), 6) AS value FROM signals WINDOW p AS (PARTITION BY signal)", "signals"))
def _(spark, d):
    p = Window.partitionBy("signal")
    sd = F.stddev_pop("value").over(p)
    return X.signals(spark, d).withColumn("value", F.round((F.col("value") - F.avg("value").over(p)) / F.when(sd != 0, sd), 6))


@query("w16_outlier_clip", sql("SELECT cell_id, chrom, bin1, bin2, round(least(count, m + 1.5 * s), 6) AS count FROM pixels, (SELECT avg(count) AS m, stddev_pop(count) AS s FROM pixels)", "pixels"))
def _(spark, d):
    p = X.pixels(spark, d)
    top = p.agg((F.avg("count") + 1.5 * F.stddev_pop("count")).alias("top"))
    return p.join(F.broadcast(top)).select("cell_id", "chrom", "bin1", "bin2", F.round(F.least(F.col("count").cast("double"), "top"), 6).alias("count"))


@query("k5_top_percent", sql("SELECT cell_id, chrom, bin1, bin2, CAST(count > c AS INT) AS v FROM pixels JOIN (SELECT cell_id, chrom, quantile_cont(count, 0.8) AS c FROM pixels GROUP BY ALL) USING (cell_id, chrom)", "pixels"))
def _(spark, d):
    p = X.pixels(spark, d)
    cut = p.groupBy(*CELL).agg(F.percentile("count", F.lit(0.8)).alias("c"))
    return p.join(cut, CELL).select(*CELL, "bin1", "bin2", (F.col("count") > F.col("c")).cast("int").alias("v"))


@query("w14_coverage_deciles", sql("SELECT chrom, quantile_cont(s, 0.9) AS top, quantile_cont(s, 0.1) AS low FROM (SELECT chrom, i, sum(v) AS s FROM bulk GROUP BY ALL) GROUP BY chrom", "bulk"))
def _(spark, d):
    rows = X.bulk(spark, d).groupBy("chrom", "i").agg(F.sum("v").alias("s"))
    return rows.groupBy("chrom").agg(F.percentile("s", F.lit(0.9)).alias("top"), F.percentile("s", F.lit(0.1)).alias("low"))
