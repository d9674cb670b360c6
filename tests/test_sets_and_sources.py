"""Bloom sets, the explorer's selection, cell maps as a data source, and readers and sinks on files."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from contactspark.operators import bloom, explorer
from contactspark.operators import contacts as C
from contactspark.sources import cellmaps, readers, writers


def numbers(spark, low, high):
    return spark.range(low, high).select(F.col("id").alias("a"), (F.col("id") * 7 % 1000).cast("int").alias("b"))


@pytest.mark.parametrize("error", [0.05, 0.001])
def test_no_member_is_missed_and_few_others_pass(spark, error):
    s = bloom.BloomSet(["a", "b"], error).add(numbers(spark, 0, 5000))
    assert numbers(spark, 0, 5000).where(~s.might_hold(spark.range(1))).count() == 0
    wrong = numbers(spark, 10**6, 10**6 + 20000).where(s.might_hold(spark.range(1))).count()
    assert wrong <= 1.5 * error * 20000


def test_layers_grow(spark):
    s = bloom.BloomSet(["a", "b"], 0.01).add(numbers(spark, 0, 1000))
    for k in range(1, 6):
        s.add(numbers(spark, 1000 * k, 1000 * (k + 1)))
    assert len(s.layers) > 1 and numbers(spark, 0, 6000).where(~s.might_hold(spark.range(1))).count() == 0
    assert numbers(spark, 10**6, 10**6 + 20000).where(s.might_hold(spark.range(1))).count() <= 0.015 * 20000


def test_held_is_exact(spark, monkeypatch):
    members = spark.createDataFrame([(1, "x"), (None, "y"), (3, None), (1, "x")], "a int, b string")
    rows = spark.createDataFrame([(1, "x"), (1, "y"), (None, "y"), (None, None), (3, None), (2**40, "x")], "a long, b string")
    want = {(1, "x"): True, (1, "y"): False, (None, "y"): True, (None, None): False, (3, None): True, (2**40, "x"): False}
    for most in (bloom.MOST_BYTES, 10):  # with a filter, and with one that would be too large
        monkeypatch.setattr(bloom, "MOST_BYTES", most)
        out = bloom.held(rows, members, ["a", "b"])
        assert {(r.a, r.b): r.held for r in out.collect()} == want and out.columns == ["a", "b", "held"]
    monkeypatch.undo()
    assert not any(r.held for r in bloom.held(rows, members.limit(0), ["a", "b"]).collect()) and bloom.held(rows.limit(0), members, ["a", "b"]).collect() == []


def test_selection_of_odd_cells(spark):
    cells = spark.createDataFrame([(1, 0.0, 0.0, "s", 1.0), (2, None, 1.0, "s", 1.0), (3, 5.0, float("nan"), None, None), (4, 1.0, 1.0, "t", 1.0)], "cell_id long, x double, y double, label string, value double")
    pixels = spark.createDataFrame([(1, "a", 0, 1, 4), (2, "a", 0, 1, 2), (9, "a", 0, 1, 7)], "cell_id long, chrom string, bin1 long, bin2 long, count long")
    picked = lambda chosen, n: sorted(r.cell_id for r in explorer.grown(cells, chosen, n).collect())
    assert picked([1], 3) == [1, 2, 4] and picked([1], 99) == [1, 2, 3, 4] and picked([3], 1) == [3] and picked([4, 2], 3) == [2, 4] and picked([7], 3) == [] and picked([], 3) == []
    out = {(r.part, r.a, r.name): r.value for r in explorer.selection(cells, pixels, [1, 2, 3]).collect()}
    assert out == {("cell", 1, None): 1, ("cell", 2, None): 1, ("cell", 3, None): 1, ("label", None, "s"): 2, ("label", None, None): 1, ("histogram", 0, None): 2, ("map", 0, None): 2}
    assert explorer.selection(cells, pixels, []).collect() == [] and explorer.selection(cells.limit(0), pixels, [1]).collect() == []


@pytest.fixture(scope="module")
def index(spark):
    return C.bin_index(spark.createDataFrame([("a", 5_500_000), ("b", 3_000_000)], "chrom string, size long"), 1_000_000)


def pixels(spark, cells):
    rows = [(c, chrom, i, j, float(c + i + j) / 4) for c in cells for chrom, n in (("a", 6), ("b", 3)) for i in range(n) for j in range(i, n)]
    return spark.createDataFrame(rows, "cell_id long, chrom string, bin1 long, bin2 long, count double")


def same(df, other):
    columns = ["cell_id", "chrom", "bin1", "bin2", "count"]
    return sorted(map(tuple, df.select(columns).collect())) == sorted(map(tuple, other.select(columns).collect()))


def test_cell_maps_come_back(spark, index, tmp_path):
    path = f"{tmp_path}/maps"
    writers.cell_maps(pixels(spark, range(30)), index, 1_000_000, path)
    assert same(writers.read_cell_maps(spark, path), pixels(spark, range(30)))
    assert same(writers.read_cell_maps(spark, path, [3, 29, 77]), pixels(spark, [3, 29]))
    writers.cell_maps(pixels(spark, [50]), index, 1_000_000, path, append=True)
    assert same(writers.read_cell_maps(spark, path), pixels(spark, [*range(30), 50]))
    writers.cell_maps(pixels(spark, [7]), index, 1_000_000, f"file://{path}")  # replaces, by another name of the folder
    assert same(writers.read_cell_maps(spark, path), pixels(spark, [7]))
    known = cellmaps.manifest(path)
    assert sorted(os.listdir(path)) == sorted([cellmaps.MANIFEST, *(p["name"] for p in known["parts"])])
    assert [tuple(b) for b in known["bins"]][:2] == [("a", 0, 1_000_000), ("a", 1_000_000, 2_000_000)] and len(known["bins"]) == 9
    writers.cell_maps(pixels(spark, [7]).limit(0), index, 1_000_000, path)
    assert writers.read_cell_maps(spark, path).collect() == [] and writers.read_cell_maps(spark, path, [7]).collect() == []


def test_point_reads_open_few_parts(spark, index, tmp_path):
    path = f"{tmp_path}/maps"
    writers.cell_maps(pixels(spark, range(200)), index, 1_000_000, path, parts=4)
    reader = lambda cells: cellmaps.CellMapReader({"path": path} | ({"cells": cells} if cells else {}))
    every = [p for q in reader(None).partitions() for p in q.value]
    assert len(every) > 2 and 1 <= sum(len(q.value) for q in reader("150").partitions()) <= 2 and reader("900").partitions()[0].value == []
    got = [b for q in reader("150").partitions() for b in reader("150").read(q)]
    assert sum(b.num_rows for b in got) == 27 and {c for b in got for c in b.column(0).to_pylist()} == {150}


def test_what_was_not_committed_is_not_read(spark, index, tmp_path):
    path = f"{tmp_path}/maps"
    writers.cell_maps(pixels(spark, [1, 2]), index, 1_000_000, path)
    import pyarrow as pa

    writer = cellmaps.CellMapWriter(path, False)
    batch = pa.RecordBatch.from_pydict({"cell_id": [9], "bin1_id": [0], "bin2_id": [0], "count": [1.0]})
    lost = writer.write(iter([batch]))  # a task that was repeated elsewhere
    assert same(writers.read_cell_maps(spark, path), pixels(spark, [1, 2]))
    kept = writer.write(iter([batch]))
    writer.commit([kept, None, writer.write(iter([]))])
    assert {r.cell_id for r in writers.read_cell_maps(spark, path).collect()} == {1, 2, 9}
    writer.abort([lost])
    assert lost.parts[0]["name"] not in os.listdir(path)
    assert json.load(open(f"{path}/{cellmaps.MANIFEST}"))["parts"][-1]["rows"] == 1


def test_merged_map(spark, index, tmp_path):
    from contactspark.operators import maps

    merged = writers.merged(maps.select_cells(pixels(spark, range(4)), [1, 3]))
    writers.cell_maps(merged, index, 1_000_000, f"{tmp_path}/m")
    out = {(r.chrom, r.bin1, r.bin2): r["count"] for r in writers.read_cell_maps(spark, f"{tmp_path}/m").collect()}
    assert out == {(chrom, i, j): (4 + 2 * (i + j)) / 8 for chrom, n in (("a", 6), ("b", 3)) for i in range(n) for j in range(i, n)}


def test_small_readers(spark, tmp_path):
    (tmp_path / "bands").write_text("#chrom\na\t0\t10\tp11\tgneg\na\t10\t12\tp10\tacen\n")
    assert [tuple(r) for r in readers.cytoband(spark, str(tmp_path / "bands")).collect()] == [("a", 0, 10, "p11", "gneg"), ("a", 10, 12, "p10", "acen")]
    m = np.array([[0, 2.5], [1, 0]])
    np.save(tmp_path / "m.npy", m)
    assert sorted(tuple(r) for r in readers.npy(spark, str(tmp_path / "m.npy")).collect()) == [(0, 1, 2.5), (1, 0, 1.0)]
    (tmp_path / "labels.csv").write_text("cell_id,cell_type\n0,x\n1,y\n")
    assert [tuple(r) for r in readers.labels(spark, str(tmp_path / "labels.csv")).collect()] == [(0, "x"), (1, "y")]
    kinds = "cell_id long, chrom string, bin long, signal string, value double"
    spark.createDataFrame([(1, "a", 2, "m", 0.5)], kinds).write.parquet(f"{tmp_path}/signals.parquet")
    assert [tuple(r) for r in readers.signals(spark, f"{tmp_path}/signals.parquet").collect()] == [(1, "a", 2, "m", 0.5)]
    spark.createDataFrame([("insulation", None, "a", 0, 10, 0.5)], "track string, cell_id long, chrom string, start long, end long, value double").write.parquet(f"{tmp_path}/given")
    writers.tracks(spark.read.parquet(f"{tmp_path}/given"), f"{tmp_path}/tracks")
    assert [(r.track, r.chrom, r.cell_id, r.value) for r in spark.read.parquet(f"{tmp_path}/tracks").collect()] == [("insulation", "a", None, 0.5)]
    writers.embeddings(spark.createDataFrame([(1, [0.5, 1.0], "x")], "id long, v array<double>, more string"), f"{tmp_path}/e")
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/e").collect()] == [(1, [0.5, 1.0])]


def test_cell_files_in_several_folders(spark, tmp_path):
    for k, folder in enumerate(("x", "y z")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "same.tsv").write_text(f"a\t1\ta\t{9000 + k}\t2\na\t1\ta\t5\t1\na\t1\tb\t9000\t\n")
    (tmp_path / "list").write_text(f"{tmp_path}/y z/same.tsv\nfile://{tmp_path}/x/same.tsv\n")
    rows = readers.cell_contacts(spark, str(tmp_path / "list")).collect()
    assert sorted((r.cell_id, r.cell_name, r.pos2, r["count"]) for r in rows) == sorted((c, "same.tsv", p, n) for c in (0, 1) for p, n in ((9001 - c, 2.0), (5, 1.0), (9000, 1.0)))
    assert sorted((r.cell_id, r.pos2) for r in readers.cell_contacts_intra(spark, str(tmp_path / "list")).collect()) == [(0, 9001), (1, 9000)]
    (tmp_path / "list").write_text(f"{tmp_path}/x/same.tsv\n\n{tmp_path}/x/same.tsv\n")
    with pytest.raises(ValueError):
        readers.cell_contacts(spark, str(tmp_path / "list"))
