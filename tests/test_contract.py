"""The contract module imports without a session, a JVM or any file beside the package."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]

PROBE = """
import builtins, io, pathlib, zipfile
def refuse(*a, **b):
    raise AssertionError("file access at import")
zipfile.ZipFile = pathlib.Path.glob = refuse
import pyspark.core.context as context
context.SparkContext.__init__ = refuse
import __spark_entry__ as e
assert len(e.queries()) > 100 and e.oracle_sql()
"""


def test_import_needs_no_file_and_no_session():
    done = subprocess.run([sys.executable, "-c", PROBE], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]
