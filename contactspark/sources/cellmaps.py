"""A data source for maps of many cells: bins, pixels of each cell, and point reads of cells.

``cellmaps`` is a folder of Parquet parts sorted by cell, a table of bins and a manifest. Tasks write parts under new names; the
commit writes the manifest, which alone says what belongs to the table, so a failed or repeated task leaves nothing that is read.
The manifest has each part's first and last cell: a read of some cells, by the option ``cells``, opens only parts that can have
them, and in these only row groups that do. Paths go through pyarrow's file systems (local, HDFS, S3).

    spark.dataSource.register(CellMaps)
    writers.cell_maps(pixels, index, resolution, path)
    spark.read.format("cellmaps").option("cells", "3,17").load(path)
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "cell_id long, bin1_id long, bin2_id long, count float"
PIXELS = pa.schema([("cell_id", pa.int64()), ("bin1_id", pa.int64()), ("bin2_id", pa.int64()), ("count", pa.float32())])
MANIFEST = "manifest.json"
#: Rows of a row group, and parts that one read task opens.
GROUP, PARTS = 1 << 16, 16


def located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def manifest(path: str) -> dict:
    """{parts: [{name, first, last, rows}], bins: [[chrom, start, end], ...]}; empty if nothing was ever committed."""
    system, base = located(path)
    if system.get_file_info(f"{base}/{MANIFEST}").type == fs.FileType.NotFound:
        return {"parts": [], "bins": []}
    with system.open_input_stream(f"{base}/{MANIFEST}") as f:
        return json.loads(f.read())


def write_manifest(path: str, content: dict) -> None:
    """Under a new name, then moved, so that a reader finds the old or the new one."""
    system, base = located(path)
    system.create_dir(base, recursive=True)
    name = f"{base}/.{uuid.uuid4().hex}"
    with system.open_output_stream(name) as f:
        f.write(json.dumps(content).encode())
    system.move(name, f"{base}/{MANIFEST}")


@dataclass
class Written(WriterCommitMessage):
    parts: list[dict]


class CellMaps(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cellmaps"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> CellMapReader:
        return CellMapReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> CellMapWriter:
        return CellMapWriter(dict(self.options)["path"], overwrite)


class CellMapWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """One part for the task's rows, which come sorted by cell; none for no rows."""
        system, base = located(self.path)
        name, writer, first, last, rows = f"part-{uuid.uuid4().hex}.parquet", None, None, None, 0
        for batch in iterator:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]).select(PIXELS.names).cast(PIXELS)
            if writer is None:
                system.create_dir(base, recursive=True)
                writer = pq.ParquetWriter(system.open_output_stream(f"{base}/{name}"), PIXELS, compression="zstd")
            writer.write_table(table, row_group_size=GROUP)
            ends = pc.min_max(table["cell_id"]).as_py()
            first = ends["min"] if first is None else min(first, ends["min"])
            last = ends["max"] if last is None else max(last, ends["max"])
            rows += len(table)
        if writer is not None:
            writer.close()
        return Written([{"name": name, "first": first, "last": last, "rows": rows}] if rows else [])

    def commit(self, messages: list[Written | None]) -> None:
        old = manifest(self.path)
        parts = sorted((p for m in messages if m for p in m.parts), key=lambda p: (p["first"], p["last"], p["name"]))
        write_manifest(self.path, old | {"parts": parts if self.overwrite else old["parts"] + parts})
        if self.overwrite:
            self._delete(old["parts"])

    def abort(self, messages: list[Written | None]) -> None:
        self._delete([p for m in messages if m for p in m.parts])

    def _delete(self, parts: list[dict]) -> None:
        system, base = located(self.path)
        for p in parts:
            system.delete_file(f"{base}/{p['name']}")


class CellMapReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.cells = [int(c) for c in options["cells"].split(",")] if options.get("cells") else None

    def partitions(self) -> list[InputPartition]:
        parts = manifest(self.path)["parts"]
        if self.cells is not None:
            parts = [p for p in parts if any(p["first"] <= c <= p["last"] for c in self.cells)]
        return [InputPartition([p["name"] for p in parts[i : i + PARTS]]) for i in range(0, len(parts), PARTS)] or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        system, base = located(self.path)
        for name in partition.value:
            keep = None if self.cells is None else [("cell_id", "in", self.cells)]
            table = pq.read_table(f"{base}/{name}", filesystem=system, filters=keep) if keep else None
            if table is not None:
                yield from table.cast(PIXELS).to_batches()
            else:
                with system.open_input_file(f"{base}/{name}") as f:
                    for batch in pq.ParquetFile(f).iter_batches(GROUP):
                        yield batch.cast(PIXELS)
