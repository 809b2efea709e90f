"""Python workers need not import the package from the working directory.

Runs, in a fresh process started outside the repository with a plain session,
a pandas-UDF query and a transformWithStateInPandas query: both must work
because the package is shipped (addPyFile) and pickled by value.
"""

import os
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false") \\
    .config("spark.sql.shuffle.partitions", "2").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
import __spark_entry__ as E
q = E.queries()
print("RESULT", q["txt01_extract_code"](spark, "/root/testdata/sf0.001").count(),
      q["str06_admit"](spark, "/root/testdata/sf0.001").count())
"""


def test_queries_run_from_another_directory():
    cwd = tempfile.mkdtemp(prefix="shelfwise-cwd-")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, env=env, capture_output=True,
                         text=True, timeout=600)
    line = [ln for ln in out.stdout.splitlines() if ln.startswith("RESULT")]
    assert line, out.stderr[-3000:]
    _, gate, admit = line[0].split()
    assert int(gate) > 0 and int(admit) > 0
