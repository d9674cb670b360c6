import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from contactspark.operators import contacts as C
from contactspark.operators import graph as G
from contactspark.operators import grid
from contactspark.operators import linalg as L
from contactspark.operators import maps as M
from contactspark.operators import order
from contactspark.operators import tracks as T
from contactspark.sources import readers, writers
from contactspark.streaming import pixels as P


@pytest.fixture(scope="module")
def index(spark):
    return C.bin_index(spark.createDataFrame([("a", 11_500_000), ("b", 6_000_000)], "chrom string, size long"), 1_000_000)


def random_map(n, seed=0):
    r = np.random.default_rng(seed)
    m = np.triu(r.integers(0, 6, (n, n)) * (r.random((n, n)) < 0.7)).astype(float)
    return m + m.T


def as_frame(spark, m, chrom="a"):
    i, j = np.nonzero(m)
    return spark.createDataFrame([(chrom, int(x), int(y), float(m[x, y])) for x, y in zip(i, j)], "chrom string, i long, j long, v double")


def back(df, n):
    m = np.zeros((n, n))
    for r in df.collect():
        m[r["i"], r["j"]] = r["v"]
    return m


def test_diagonal_is_doubled(spark):
    p = spark.createDataFrame([(0, "a", 3, 3, 5)], "cell_id long, chrom string, bin1 long, bin2 long, count long")
    assert [(r.i, r.j, r.v) for r in M.symmetric(p).collect()] == [(3, 3, 10)]


def test_mirrored_pairs(spark):
    rows = [(0, "a", 2_500_000, "a", 7_500_000, 1), (0, "a", 7_500_000, "a", 2_500_000, 4)]
    c = spark.createDataFrame(rows, "cell_id long, chrom1 string, pos1 long, chrom2 string, pos2 long, count long")
    assert [r["count"] for r in C.intra_pixels(c, 1_000_000).collect()] == [5]
    assert sorted(r["count"] for r in C.intra_pixels(c, 1_000_000, canonical=False).collect()) == [1, 4]


def test_last_column_never_counts_as_across(spark):
    index = C.bin_index(spark.createDataFrame([("a", 6)], "chrom string, size long"), 1)
    m = np.zeros((6, 6))
    m[:5, 5] = m[5, :5] = 1
    assert all(r.score == 0 or r.score == 1 for r in T.insulation(as_frame(spark, m), ["chrom"], index, 2).collect())


def test_minima_never_at_the_edge(spark):
    rows = [("a", b, 0.9 - b / 100) for b in range(10)]
    assert not any(r.boundary for r in T.local_minima(spark.createDataFrame(rows, "chrom string, bin long, score double"), ["chrom"], 2).collect())


@pytest.mark.parametrize("text", ["N", "NN", "NACG", "ACGN", "NNNN", "CGCG", "", "ACGT" * 5, "NCGNNCGN"])
def test_cpg_rate(spark, text):
    n, unknown = len(text), text.count("N")
    double = sum(text[i : i + 2] == "NN" for i in range(n - 1))
    pairs = n - 1 - 2 * unknown + double + int(n > 0 and (text[0] == "N" or text[-1] == "N"))
    want = text.count("CG") / pairs if pairs > 0 else 0.0
    assert spark.createDataFrame([(text,)], "s string").select(T.cpg_rate(F.col("s")).alias("r")).first()["r"] == pytest.approx(want)


def test_balanced_rows_sum_to_one(spark, index):
    out = back(L.balanced(as_frame(spark, random_map(12)), ["chrom"], index), 12)
    assert np.allclose(out.sum(axis=1), 1, atol=1e-6) and np.allclose(out, out.T)


@pytest.mark.parametrize("count", [1e2, 3e4, 1e6])
def test_balanced_whatever_the_size_of_the_counts(count):
    i = np.arange(40)
    m = np.where((abs(i[:, None] - i) < 9) & (np.minimum(i[:, None], i) < 31), count, 0.0) + np.diag(np.where(i < 31, 0, 1e-5))
    x = L.balance(m)
    assert np.allclose((m * x[:, None] * x).sum(axis=1), 1, rtol=0, atol=1e-7)


def test_random_walk(spark, index):
    m = random_map(12, 3)
    p = m - np.diag(np.diag(m))
    p += np.diag((p.sum(axis=0) == 0).astype(float))
    p /= p.sum(axis=0)
    q = 0.5 * np.linalg.inv(np.eye(12) - 0.5 * p)  # where the walk ends
    np.fill_diagonal(q, 0)
    assert np.allclose(back(L.random_walk(as_frame(spark, m), ["chrom"], index), 12), q, atol=1e-5)


def test_compartment_finds_two_blocks(spark):
    index = C.bin_index(spark.createDataFrame([("a", 20)], "chrom string, size long"), 1)
    side = np.arange(20) // 5 % 2
    m = np.where(side[:, None] == side, 8.0, 2.0) / (1 + np.abs(np.subtract.outer(np.arange(20), np.arange(20))))
    score = {r.bin: r.score for r in L.compartments(as_frame(spark, m), ["chrom"], index).collect()}
    signs = np.sign([score[b] for b in range(20)])
    assert abs(np.corrcoef(signs, side)[0, 1]) > 0.9
    again = {r.bin: r.score for r in L.compartments(as_frame(spark, m), ["chrom"], index, bulk=as_frame(spark, m)).collect()}
    assert all(again[b] == pytest.approx(score[b]) for b in score)


def test_svd_scores(spark):
    x = np.random.default_rng(1).normal(size=(9, 5))
    rows = [(i, str(j), float(x[i, j])) for i in range(9) for j in range(5)]
    got = {r.id: r.v for r in L.sparse_svd(spark.createDataFrame(rows, "id long, feature string, v double"), 3).collect()}
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(np.abs([got[i] for i in range(9)]), np.abs(u[:, :3] * s[:3]))


@pytest.mark.parametrize("landmarks", [1000, 6])
def test_scaling_keeps_distances(spark, landmarks):
    x = np.random.default_rng(2).normal(size=(12, 2))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = {r.id: np.array(r.v) for r in L.scaling(rows, 2, landmarks).collect()}
    assert all(np.linalg.norm(got[i] - got[j]) == pytest.approx(np.linalg.norm(x[i] - x[j]), abs=1e-6) for i in range(12) for j in range(12))
    assert L.scaling(rows.limit(0)).collect() == []


def test_calibration_moves_to_the_common_place(spark):
    score = [0.5] * 20
    score[6] = score[13] = 0.1
    scores = [(c, "a", b, s) for c in range(5) for b, s in enumerate(score)]
    own = [(c, "a", b) for c in range(5) for b in (6, 13)]
    out = L.calibrate(spark.createDataFrame(scores, "cell_id long, chrom string, bin long, score double"), spark.createDataFrame(own, "cell_id long, chrom string, bin long"), spark.createDataFrame([("a", 6), ("a", 13)], "chrom string, bin long"))
    assert {(r.bin, r.members) for r in out.collect()} == {(6, 5), (13, 5)}


def test_files(spark, index, tmp_path):
    (tmp_path / "sizes").write_text("a\t11500000\nb\t6000000\n")
    assert {r.chrom: r.size for r in readers.chrom_sizes(spark, str(tmp_path / "sizes")).collect()} == {"a": 11500000, "b": 6000000}
    paths = []
    for k in range(3):
        (tmp_path / f"cell{k}.tsv").write_text(f"#note\na\t1\ta\t{k + 5}\t2\na\t1\tb\t9\t\n")
        paths.append(str(tmp_path / f"cell{k}.tsv"))
    (tmp_path / "list").write_text("\n".join(paths) + "\n")
    rows = readers.cell_contacts(spark, str(tmp_path / "list")).collect()
    assert sorted((r.cell_id, r.pos2, r["count"]) for r in rows) == sorted((k, p, c) for k in range(3) for p, c in ((k + 5, 2.0), (9, 1.0)))
    (tmp_path / "x.fa").write_text(">a one\nacgt\nNN\n>b\n\n>c\nCG\n")
    assert sorted((r.chrom, r.offset, r.sequence) for r in readers.fasta(spark, str(tmp_path / "x.fa")).collect()) == [("a", 0, "ACGT"), ("a", 4, "NN"), ("b", 0, ""), ("c", 0, "CG")]
    done = spark.createDataFrame([("one", "a", 3, 1, 2, 0.5), ("one", "b", 3, 1, 2, 0.25)], "stage string, chrom string, cell_id long, i long, j long, p double")
    for part in ("x", "x", "y"):
        writers.imputed(done.withColumn("cell_id", F.lit(ord(part))), str(tmp_path / "imputed"), part)
    assert spark.read.parquet(str(tmp_path / "imputed")).count() == 4
    assert [tuple(r) for r in writers.fetch_map(spark, str(tmp_path / "imputed"), "b", ord("x"), ["one", "two"]).collect()] == [("one", 1, 2, 0.25)]
    p = spark.createDataFrame([(0, "a", 1, 2, 3), (1, "b", 0, 4, 5)], "cell_id long, chrom string, bin1 long, bin2 long, count long")
    writers.pixels(p, str(tmp_path / "px"))
    assert spark.read.parquet(str(tmp_path / "px")).count() == 2
    writers.upsert(p.where("cell_id = 1").withColumn("count", F.lit(9)), str(tmp_path / "px"), ["chrom"])
    assert sorted(r["count"] for r in spark.read.parquet(str(tmp_path / "px")).collect()) == [3, 9]
    writers.write_cool_tables(p, index, 1_000_000, str(tmp_path / "cool"))
    assert spark.read.parquet(str(tmp_path / "cool/bins")).count() == 18


def test_stream_is_the_batch(spark, tmp_path):
    head = "cell_name\tcell_id\tchrom1\tpos1\tchrom2\tpos2\tcount\n"
    for k in range(3):
        (tmp_path / f"{k}.tsv").write_text(head + f"c\t{k % 2}\ta\t1000000\ta\t5000000\t{k + 1}\nc\t0\ta\t1\ta\t900\t7\n")
    stream = P.contact_stream(spark, str(tmp_path), 1)
    P.start(stream, 1_000_000, str(tmp_path / "px"), str(tmp_path / "ck")).awaitTermination(120)
    batch = P.pixel_stream(readers.contacts(spark, f"{tmp_path}/*.tsv"), 1_000_000)
    assert sorted(map(tuple, P.latest(spark, str(tmp_path / "px")).select(*batch.columns).collect())) == sorted(map(tuple, batch.collect())) != []


def test_smooth_length_and_mass(spark):
    rows = [("a", b, float(b)) for b in range(9)]
    out = T.smooth(spark.createDataFrame(rows, "chrom string, bin long, v double"), ["chrom"], "v", 4, "flat").orderBy("place").collect()
    x = np.arange(9.0)
    padded = np.r_[x[3:0:-1], x, x[-2:-5:-1]]
    assert [r.v for r in out] == pytest.approx(np.convolve(np.ones(4) / 4, padded, mode="valid").tolist())


def test_entry(spark):
    assert entry.entry(spark).count() == 120


@pytest.mark.parametrize("name", ["n4_compartment_bulk", "n28_calibrated_boundaries", "n23_clusters", "h3_held_out_auroc", "h9_imputed_pairs"])
def test_queries_without_sql(name, spark, sf):
    rows = entry.queries()[name](spark, sf).collect()
    assert rows and (name != "h3_held_out_auroc" or rows[0]["auroc"] > 0.95)


def test_zinb_sums_to_one(spark):
    rows = spark.createDataFrame([(float(k),) for k in range(200)], "k double").selectExpr("k", "2.5D AS m", "1.7D AS t", "-0.4D AS p")
    assert sum(math.exp(r.log_likelihood) for r in L.zinb(rows, "k", "m", "t", "p").collect()) == pytest.approx(1, abs=1e-4)


def test_running_sums_over_ties_and_nulls(spark):
    r = random.Random(1)
    data = [(r.choice(["a", "b", None]), r.choice([1, 2, 3, 3, 3]), i, r.randint(0, 9)) for i in range(300)]
    rows = spark.createDataFrame(data, "k string, x long, id long, w long")
    got = {x.id: (x.s, x.p) for x in order.running(rows, ["k"], ["x", "id"], {"s": F.col("w"), "p": F.lit(1)}).collect()}
    for k, x, i, _ in data:
        before = [w for k2, x2, i2, w in data if k2 == k and (x2, i2) < (x, i)]
        assert got[i] == (sum(before), len(before))
    ranks = {x.id: x.t for x in order.tie_ranked(rows, ["k"], {"t": "x"}).collect()}
    for k, x, i, _ in data:
        same = [x2 for k2, x2, *_ in data if k2 == k]
        assert ranks[i] == sum(v < x for v in same) + (same.count(x) + 1) / 2
    assert order.quantiles(rows, "w", [0.0, 0.1, 0.37, 1.0]) == pytest.approx(np.quantile([d[3] for d in data], [0.0, 0.1, 0.37, 1.0]))
    assert order.quantiles(rows.limit(0), "w", [0.5]) == [None] and order.running(rows.limit(0), ["k"], ["x"], {"s": F.col("w")}).collect() == []


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_nearest_block_by_block(spark, monkeypatch, metric):
    monkeypatch.setattr(grid, "BLOCK", 7)
    r = np.random.default_rng(3)
    x = np.vstack([r.normal(size=(30, 4)), np.tile(r.normal(size=4), (6, 1))])
    rows = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)] + [(None, x[0].tolist(), 0), (99, None, 0)], "id long, v array<double>, b long")
    length = np.linalg.norm(x, axis=1)
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) if metric == "euclidean" else np.round(1 - x @ x.T / length[:, None] / length, 9)
    np.fill_diagonal(dist, 0)
    for group in (None, "b"):
        got = {}
        for row in G.nearest(rows, 3, group_col=group, metric=metric).collect():
            got.setdefault((row.id, row.nbr_group if group else ""), []).append((round(row.distance, 6), row.nbr))
        for i in range(len(x)):
            for g in ("0", "1", "2") if group else ("",):
                near = sorted((round(float(dist[i, j]), 6), j != i, j) for j in range(len(x)) if not group or str(j % 3) == g)[:3]
                want, have = [(d, j) for d, _, j in near], sorted(got[(i, g)])
                assert have == sorted(want) if metric == "euclidean" else [d for d, _ in have] == pytest.approx([d for d, _ in sorted(want)])


def test_svd_with_more_rows_than_directions(spark):
    r = np.random.default_rng(5)
    m = r.normal(size=(60, 8)) @ np.diag([9, 7, 5, 3, 1, 1, 1, 1]) @ r.normal(size=(8, 30))
    rows = spark.createDataFrame([(i, f"f{j}", float(m[i, j])) for i in range(60) for j in range(30)], "id long, feature string, v double")
    c = m - m.mean(axis=0)
    u, s, _ = np.linalg.svd(c, full_matrices=False)
    got = {x.id: x.v for x in L.sparse_svd(rows, 2, centre=True, extra=4).collect()}
    assert np.allclose(np.abs([got[i] for i in range(60)]), np.abs(u[:, :2] * s[:2]), rtol=1e-4, atol=1e-3)  # an iteration, not exact


def test_cpg_windows_of_pieces(spark):
    r = random.Random(2)
    text = "".join(r.choices("ACGTN", k=1234))
    cuts = [0, 1, 77, 100, 512, 900, 1234]
    pieces = spark.createDataFrame([("c", a, text[a:b]) for a, b in zip(cuts, cuts[1:])] + [("e", 0, "")], "chrom string, offset long, sequence string")
    whole = spark.createDataFrame([("c", text), ("e", "")], "chrom string, sequence string")
    for tail in (False, True):
        want = sorted((x.start, x.end, x.rate) for x in T.cpg_windows(whole, 100, tail).collect())
        assert sorted((x.start, x.end, x.rate) for x in T.cpg_windows(pieces, 100, tail).collect()) == want and len(want) == 12 + tail


def test_negatives_use_all_tries(spark, index):
    full = [(0, "a", i, j) for i in range(11) for j in range(i, 11) if (i, j) not in ((0, 5), (5, 9))]
    positives = spark.createDataFrame(full[:8], "cell_id long, chrom string, bin1 long, bin2 long")
    few, many = (G.negatives(positives, index, 3, 2, 9, 1, tries=t) for t in (2, 50))
    count = lambda df: {tuple(r)[4:]: 0 for r in df.collect()}
    assert many.count() == 3 * positives.count() >= few.count() and set(count(few)) <= set(count(many))
    touched = {(c, i + x, j + y) for c, _, i, j in full[:8] for x in (-1, 0, 1) for y in (-1, 0, 1)}
    assert not touched & {(r.cell_id, r.bin1, r.bin2) for r in many.collect()}
