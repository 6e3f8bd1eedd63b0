import subprocess
import sys
from pathlib import Path

ROOT = str(Path(__file__).parent.parent)


def test_queries_can_be_listed_without_a_session():
    code = (
        "import __spark_entry__ as e; q = e.queries(); from pyspark import SparkContext; "
        "assert SparkContext._active_spark_context is None; print(len(q))"
    )
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) > 100


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
