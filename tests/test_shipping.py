"""Workers get the package from the session, whatever folder the driver was started in."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("rows", entry.queries()["gradient_histograms"](spark, sys.argv[2]).limit(5).count())
"""


def test_queries_run_from_an_empty_folder(tmp_path, sf):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT, str(ROOT), sf], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 5" in done.stdout, done.stderr[-2000:]


def test_no_machine_local_folders():
    for path in (ROOT / "cinestat").rglob("*.py"):
        text = path.read_text()
        assert "tempfile" not in text and "localCheckpoint" not in text, path
