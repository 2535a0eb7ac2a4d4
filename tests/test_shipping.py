"""Queries with a Python stage run from any folder, whoever made the session."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
SCRIPT = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
print("ROWS", len(__spark_entry__.queries()["elo_accuracy"](spark, {sf!r}).collect()))
"""


def test_package_reaches_the_workers(tmp_path, sf):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    made = subprocess.run([sys.executable, "-c", SCRIPT.format(root=str(ROOT), sf=sf)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 1" in made.stdout, made.stderr[-2000:]
