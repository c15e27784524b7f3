"""The entry imports without Spark's bundled jars and without a session."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_queries_import_without_jars(tmp_path):
    code = (f"import pyspark; pyspark.__path__.insert(0, {str(tmp_path)!r}); import __spark_entry__ as e; "
            "q, s = e.queries(), e.oracle_sql(); assert len(q) >= 130 and set(s) <= set(q); "
            "from pyspark.sql import SparkSession; assert SparkSession.getActiveSession() is None")
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
