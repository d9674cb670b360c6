"""Contact fixtures made of the test tables by integer arithmetic, once as DataFrames and once as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactspark.operators import contacts as C
from contactspark.operators import maps as M

RES = 1_000_000
N_BINS = 40
CHROMS = ["chr1", "chr2", "chr3"]
CYTOBAND = [("chr1", 0, 12_000_000, "p11", "gneg"), ("chr1", 12_000_000, 14_000_000, "p10", "acen"), ("chr1", 14_000_000, 16_000_000, "q10", "acen"), ("chr1", 16_000_000, 40_000_000, "q11", "gneg"), ("chr2", 0, 20_500_000, "p11", "gneg"), ("chr2", 20_500_000, 22_000_000, "p10", "acen"), ("chr2", 22_000_000, 40_000_000, "q11", "gneg")]

# Expressions that both engines read alike.
CONTACT = [
    ("CAST(l_suppkey % 20 AS BIGINT)", "cell_id"),
    ("CASE WHEN l_linenumber % 3 = 0 THEN 'chr1' WHEN l_linenumber % 3 = 1 THEN 'chr2' ELSE 'chr3' END", "chrom1"),
    ("CASE WHEN l_orderkey % 10 = 0 THEN 'chr1' WHEN l_linenumber % 3 = 0 THEN 'chr1' WHEN l_linenumber % 3 = 1 THEN 'chr2' ELSE 'chr3' END", "chrom2"),
    ("CAST((l_partkey*7919 + l_suppkey*104729 + l_linenumber*15485863) % 31000000 AS BIGINT)", "pos1"),
    ("CAST((l_partkey*7919 + l_suppkey*104729 + l_linenumber*15485863) % 31000000 + ((l_orderkey*6151) % 3000) * ((l_orderkey*6151) % 3000) AS BIGINT)", "pos2"),
    ("CAST(l_quantity AS BIGINT)", "count"),
]
SWAPPED = [(e if a not in ("pos1", "pos2") else f"CASE WHEN l_partkey % 2 = 1 THEN {dict((x, y) for y, x in CONTACT)['pos2' if a == 'pos1' else 'pos1']} ELSE {e} END", a) for e, a in CONTACT]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contacts(spark: SparkSession, sf_dir: str, swapped: bool = False) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} AS {a}" for e, a in (SWAPPED if swapped else CONTACT)])


def chrom_sizes(spark: SparkSession, size: int = 40_000_000) -> DataFrame:
    return spark.createDataFrame([(c, size) for c in CHROMS], "chrom string, size long")


def index(spark: SparkSession) -> DataFrame:
    return C.bin_index(chrom_sizes(spark), RES, CHROMS)


def seen_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chrom, size): sizes that the contacts' largest places give."""
    c = contacts(spark, sf_dir)
    ends = c.select(F.col("chrom1").alias("chrom"), F.col("pos1").alias("p")).unionByName(c.select(F.col("chrom2").alias("chrom"), F.col("pos2").alias("p")))
    return ends.groupBy("chrom").agg((F.max("p") + 1).alias("size"))


def seen_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.bin_index(seen_sizes(spark, sf_dir), RES, CHROMS)


def seen_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bands of chromosomes of 40 megabases, drawn out to the sizes seen."""
    to = lambda c: F.expr(f"CAST({c} * size DIV 40000000 AS BIGINT)").alias(c)
    return cytoband(spark).join(seen_sizes(spark, sf_dir), "chrom").select("chrom", to("start"), to("end"), "name", "type")


def cytoband(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CYTOBAND, "chrom string, start long, end long, name string, type string")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.intra_pixels(C.not_short(contacts(spark, sf_dir)), RES)


def bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summed symmetric map (chrom, i, j, v)."""
    return M.symmetric(pixels(spark, sf_dir).groupBy("chrom", "bin1", "bin2").agg(F.sum("count").alias("count")))


def cell_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = contacts(spark, sf_dir).select("cell_id").distinct()
    return cells.select("cell_id", F.concat(F.lit("type"), F.col("cell_id") % 4).alias("cell_type"), F.concat(F.lit("batch"), F.col("cell_id") % 2).alias("batch"))


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("p_partkey") % 40
    value = F.when(b % 13 == 0, F.lit(-1.0)).otherwise((b * 37 % 101) / F.lit(100.0))
    chrom = F.concat(F.lit("chr"), (F.lit(1) + F.floor(F.col("p_partkey") / 40)).cast("string"))
    return table(spark, sf_dir, "part").where("p_partkey < 120").select(chrom.alias("chrom"), (b * 1_000_000).cast("long").alias("bin"), value.alias("value"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "CAST(o_orderstatus = 'F' AS INT) AS label", "CAST(o_totalprice AS DOUBLE) / 500000.0 AS score", "CAST(1 + o_orderkey % 7 AS DOUBLE) AS weight")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    keys = [(F.col("user_id") % 20).cast("long").alias("cell_id"), F.concat(F.lit("chr"), (F.col("event_id") % 3 + 1).cast("string")).alias("chrom"), (F.floor(F.col("event_id") / 3).cast("long") % 40).alias("bin"), F.col("event_type").alias("signal")]
    return events.groupBy(*keys).agg(F.round(F.avg("value"), 6).alias("value"))


def genome(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = F.translate(F.lower(F.regexp_replace("text", "[^A-Za-z]", "")), "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTNN")
    return table(spark, sf_dir, "documents").where("lang = 'en'").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("chrom"), letters.alias("sequence"))


def r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) for c in cols})


def sql(body: str, *parts: str) -> str:
    """A query over the named common parts, in the order of PARTS."""
    need: set[str] = set()

    def add(name: str) -> None:
        if name not in need:
            need.add(name)
            for other in NEEDS.get(name, ()):
                add(other)

    for p in parts:
        add(p)
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in PARTS.items() if k in need) + "\n" + body


PARTS = {
    "contacts": f"SELECT {', '.join(f'{e} AS {a}' for e, a in CONTACT)} FROM lineitem",
    "swapped": f"SELECT {', '.join(f'{e} AS {a}' for e, a in SWAPPED)} FROM lineitem",
    "kept": "SELECT * FROM contacts WHERE chrom1 <> chrom2 OR abs(pos2 - pos1) >= 2500 OR pos1 = pos2",
    "pixels": f"SELECT cell_id, chrom1 AS chrom, least(pos1 // {RES}, pos2 // {RES}) AS bin1, greatest(pos1 // {RES}, pos2 // {RES}) AS bin2, CAST(sum(count) AS BIGINT) AS count FROM kept WHERE chrom1 = chrom2 GROUP BY ALL",
    "idx": f"SELECT * FROM (VALUES (0, 'chr1', {N_BINS}, 0, 40), (1, 'chr2', {N_BINS}, 40, 80), (2, 'chr3', {N_BINS}, 80, 120)) t(chrom_idx, chrom, n_bins, start_bin, end_bin)",
    "seen": "SELECT chrom, max(p) + 1 AS size FROM (SELECT chrom1 AS chrom, pos1 AS p FROM contacts UNION ALL SELECT chrom2, pos2 FROM contacts) GROUP BY chrom",
    "seen_idx": f"SELECT CAST(row_number() OVER (ORDER BY chrom) - 1 AS INTEGER) AS chrom_idx, chrom, n_bins, CAST(sum(n_bins) OVER (ORDER BY chrom) - n_bins AS BIGINT) AS start_bin, CAST(sum(n_bins) OVER (ORDER BY chrom) AS BIGINT) AS end_bin FROM (SELECT chrom, CAST(ceil(size / {RES}) AS BIGINT) AS n_bins FROM seen)",
    "seen_bins": "SELECT chrom, n_bins, start_bin, unnest(range(n_bins)) AS bin FROM seen_idx",
    "bins": f"SELECT chrom, b AS bin FROM idx, range({N_BINS}) r(b)",
    "sums": "SELECT chrom, bin1, bin2, CAST(sum(count) AS BIGINT) AS count FROM pixels GROUP BY ALL",
    "bulk": "SELECT chrom, bin1 AS i, bin2 AS j, CASE WHEN bin1 = bin2 THEN 2 * count ELSE count END AS v FROM sums UNION ALL SELECT chrom, bin2, bin1, count FROM sums WHERE bin1 <> bin2",
    "sym": "SELECT cell_id, chrom, bin1 AS i, bin2 AS j, CASE WHEN bin1 = bin2 THEN 2 * count ELSE count END AS v FROM pixels UNION ALL SELECT cell_id, chrom, bin2, bin1, count FROM pixels WHERE bin1 <> bin2",
    "labels_cells": "SELECT cell_id, 'type' || CAST(cell_id % 4 AS VARCHAR) AS cell_type, 'batch' || CAST(cell_id % 2 AS VARCHAR) AS batch FROM (SELECT DISTINCT cell_id FROM contacts)",
    "cytoband": "SELECT * FROM (VALUES " + ", ".join(map(str, CYTOBAND)) + ") t(chrom, start, stop, name, type)",
    "bands": "SELECT chrom, start * size // 40000000 AS start, stop * size // 40000000 AS stop, name, type FROM cytoband JOIN seen USING (chrom)",
    "calibration": "SELECT 'chr' || CAST(1 + p_partkey // 40 AS VARCHAR) AS chrom, p_partkey % 40 * 1000000 AS bin, CASE WHEN p_partkey % 40 % 13 = 0 THEN -1.0::DOUBLE ELSE (p_partkey % 40 * 37 % 101) / 100.0::DOUBLE END AS value FROM part WHERE p_partkey < 120",
    "scored": "SELECT o_orderkey AS id, CAST(o_orderstatus = 'F' AS INT) AS label, CAST(o_totalprice AS DOUBLE) / 500000.0::DOUBLE AS score, CAST(1 + o_orderkey % 7 AS DOUBLE) AS weight FROM orders",
    "signals": "SELECT CAST(user_id % 20 AS BIGINT) AS cell_id, 'chr' || CAST(event_id % 3 + 1 AS VARCHAR) AS chrom, event_id // 3 % 40 AS bin, event_type AS signal, round(avg(value), 6) AS value FROM events GROUP BY ALL",
    "genome": "SELECT 'doc' || CAST(doc_id AS VARCHAR) AS chrom, translate(lower(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTNN') AS sequence FROM documents WHERE lang = 'en'",
}
NEEDS = {"kept": ["contacts"], "seen": ["contacts"], "seen_idx": ["seen"], "seen_bins": ["seen_idx"], "bands": ["cytoband", "seen"], "pixels": ["kept"], "bins": ["idx"], "sums": ["pixels"], "bulk": ["sums"], "sym": ["pixels"], "labels_cells": ["contacts"]}
