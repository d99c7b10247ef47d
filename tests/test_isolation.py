"""The core stands without the llm folders, whether corpus_pipeline.py is left or not."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROBE = """
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
assert q and o and set(o) <= set(q), (len(q), len(o))
assert "pipeline" not in q and not any(k.startswith("op") and k[2].isdigit() for k in q)
import bench
assert set(bench.NAMES) <= set(q)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert e.entry(spark).count() > 0
assert q["join_inner"](spark, "/root/testdata/sf0.001").count() > 0
print("stands")
"""


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_the_llm_folders(tmp_path, pipeline):
    own = tmp_path / "repo"
    shutil.copytree(ROOT, own, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *([] if pipeline else ["corpus_pipeline.py"])))
    run = subprocess.run([sys.executable, "-c", PROBE], cwd=own, capture_output=True, text=True, timeout=300, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert "stands" in run.stdout, run.stderr[-2000:]
