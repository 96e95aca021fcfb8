"""Queries that run Python on executors must not need the package importable there (driver-only sys.path)."""
import os
import subprocess
import sys
import tempfile

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()
import __spark_entry__ as E
n = E.queries()['fisher_exact_segment'](spark, '/root/testdata/sf0.001').count()
print('ROWS', n)
spark.stop()
"""


def test_fisher_runs_from_foreign_cwd():
    cwd = tempfile.mkdtemp(prefix="cohortlab-cwd-")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    r = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, env=env, capture_output=True, text=True, timeout=600)
    assert "ROWS" in r.stdout, r.stderr[-2000:]
