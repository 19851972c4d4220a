import os
import subprocess
import sys
import time
from pathlib import Path

SCRIPT = """
import sys
from pyspark.sql import SparkSession
from modlens.session import scratch_path
spark = (SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", sys.argv[1]).getOrCreate())
a, b = scratch_path(spark, "t"), scratch_path(spark, "t")
assert a != b and a.split("://")[-1].removeprefix("file:").startswith(sys.argv[1])
spark.range(3).write.parquet(a)
assert spark.read.parquet(a).count() == 3
print(a)
"""


def test_written_tables_end_with_the_session(tmp_path):
    """They lie in the folder that the session names, and only what it wrote there is removed."""
    (tmp_path / "other").write_text("kept")
    root = str(Path(__file__).resolve().parent.parent)
    env = {**os.environ, "PYTHONPATH": root}
    done = subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path)], env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
    table = Path(done.stdout.strip().removeprefix("file:"))
    until = time.time() + 30  # the JVM ends a little after Python
    while table.exists() and time.time() < until:
        time.sleep(0.2)
    assert not table.exists() and (tmp_path / "other").read_text() == "kept"
