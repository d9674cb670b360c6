import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

PROGRAM = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
from contactspark.operators import tables
first = tables.materialise(spark.range(5), "numbers")
assert first.count() == 5 and tables.run_dir(spark).startswith(sys.argv[1])
if sys.argv[2] == "clear":
    tables.clear(spark)
    print("left", sum(len(f) for *_, f in __import__("os").walk(sys.argv[1])))
    assert tables.materialise(spark.range(7), "numbers").count() == 7
spark.stop()
"""


def test_tables_of_a_run_go_with_it(tmp_path):
    for how in ("clear", "exit"):
        folder = tmp_path / how
        folder.mkdir()
        out = subprocess.run([sys.executable, "-c", PROGRAM, str(folder), how], env=os.environ | {"PYTHONPATH": ROOT}, capture_output=True, text=True, timeout=200)
        assert out.returncode == 0, out.stderr[-2000:]
        assert how == "exit" or "left 0" in out.stdout
        assert not [f for *_, files in os.walk(folder) for f in files if "numbers" in f or f.endswith(".parquet")]
