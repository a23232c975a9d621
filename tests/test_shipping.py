"""The package reaches the Python workers when the driver runs elsewhere."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

PROGRAM = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2")
spark = spark.config("spark.checkpoint.dir", sys.argv[3]).getOrCreate()
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as entry
for name in ("forecast_arma_gd", "resample_spline", "stream_forecast"):
    print(name, entry.queries()[name](spark, sys.argv[2]).count())
print("archives", sum(p.endswith(".zip") for p in spark.sparkContext.listFiles))
"""


def test_queries_run_from_another_folder(tmp_path, sf_dir):
    empty, checkpoints = tmp_path / "empty", tmp_path / "checkpoints"
    empty.mkdir()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run(
        [sys.executable, "-c", PROGRAM, REPO, sf_dir, str(checkpoints)], cwd=empty, env=env, capture_output=True, text=True, timeout=300
    )
    assert run.returncode == 0, run.stderr[-2000:]
    said = dict(line.split() for line in run.stdout.splitlines() if line.strip())
    assert all(int(said[n]) > 0 for n in ("forecast_arma_gd", "resample_spline", "stream_forecast")) and said["archives"] == "1"
