"""A session of its own process: no defaults, another working directory, settings left as they were."""

import os
import subprocess
import sys

from conftest import SMALL

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import sys
from pyspark.sql import SparkSession
from ledgerspark.catalogue import QUERIES
from ledgerspark.session import tune
from ledgerspark.storage import shared_folder

spark = tune(SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate())
assert spark.conf.get("spark.checkpoint.dir", None) is None
settings = dict(spark.conf.getAll)
folder = shared_folder(spark)
for name in ("amount_percentile", "errors_by_store"):
    assert QUERIES[name](spark, sys.argv[1]).count() > 0
assert dict(spark.conf.getAll) == settings
assert shared_folder(spark) == folder
print("fine")
"""


def test_runs_without_defaults_in_another_folder(tmp_path):
    (tmp_path / "conf").mkdir()
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path / "conf"), "PYTHONPATH": REPO}
    done = subprocess.run([sys.executable, "-c", SCRIPT, SMALL], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.stdout.strip().endswith("fine"), done.stderr[-2000:]
