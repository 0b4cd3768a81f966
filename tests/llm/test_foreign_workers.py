"""The corpus queries where Python workers can't import this package: driver and workers start in a foreign folder."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]
SCRIPT = """
import importlib.util, sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.checkpoint.dir", "file://" + sys.argv[3]).getOrCreate()
spark.sparkContext.setLogLevel("OFF")
spec = importlib.util.spec_from_file_location("__spark_entry__", sys.argv[1] + "/__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
found = spark.range(1).mapInPandas(lambda parts: (p.assign(id=int(importlib.util.find_spec("sylvaframe") is not None)) for p in parts), "id long").first()[0]
print("importable", found)
for name, query in entry.queries().items():
    if name.startswith("op") and name[2].isdigit():
        print(name, query(spark, sys.argv[2]).count() > 0)
"""


def test_workers_without_the_package(sf, tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT, str(ROOT), sf, str(tmp_path)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    said = done.stdout.split("\n")
    assert done.returncode == 0, done.stderr[-3000:]
    assert "importable 0" in said and len([x for x in said if x.endswith(" True")]) >= 13
