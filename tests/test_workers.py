"""Python workers must not need the package on their path."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]

SCRIPT = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__ as entry_points
from playmetry.streaming import ordered
queries = entry_points.queries()
for name in ("match_fifo", "items_for_users"):
    assert queries[name](spark, {os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")!r}).count() > 0, name
folder = sys.argv[1]
spark.createDataFrame([(1, 5), (1, 90_000_000), (9, 900_000_000_000)], "user_id long, ms long").coalesce(1).write.json(folder + "/in")
plays = spark.readStream.schema("user_id long, ms long").json(folder + "/in").select("user_id", F.timestamp_millis("ms").alias("ts"))
query = ordered.streaks_stream(plays).writeStream.format("memory").queryName("out").outputMode("append").option("checkpointLocation", folder + "/ck").trigger(availableNow=True).start()
query.awaitTermination(120)
assert [r["current_streak"] for r in spark.table("out").orderBy("last_ms").collect()] == [1, 2]
print("workers fine")
"""


def test_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT, str(tmp_path)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300
    )
    assert "workers fine" in done.stdout, done.stderr[-2000:]
