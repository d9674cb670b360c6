"""Tables written in the shared folder, to cut lineage and to fix what is used twice."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one of our own where that is unset, in local mode only, as in tests.

    On a cluster a folder of the driver's machine would lose every executor's rows, so there the setting is required.
    """
    context = spark.sparkContext._jsc.sc()
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and context.getCheckpointDir().isDefined():
        found = context.getCheckpointDir().get()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="contactspark-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    elif not context.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Run folders that are marked to go when the driver's JVM ends.
_MARKED: set[str] = set()


def run_dir(spark: SparkSession) -> str:
    """The folder of this application's tables in the shared folder; it goes when the driver's JVM ends, or by ``clear``."""
    path = f"{shared_dir(spark).rstrip('/')}/contactspark/{spark.sparkContext.applicationId}"
    if path not in _MARKED:
        folder, system = _folder(spark, path)
        system.mkdirs(folder)
        system.deleteOnExit(folder)
        _MARKED.add(path)
    return path


def _folder(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def clear(spark: SparkSession) -> None:
    """Delete this application's tables, once nothing that was made from them is read any more."""
    path = run_dir(spark)
    folder, system = _folder(spark, path)
    system.delete(folder, True)
    _MARKED.discard(path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)
