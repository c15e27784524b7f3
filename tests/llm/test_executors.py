"""Python operators on workers that cannot import the package."""

import os
import subprocess
import sys
from pathlib import Path

REPOSITORY = Path(__file__).resolve().parents[2]
SCRIPT = """
import sys
sys.path.insert(0, {repository!r})
from lexweave.session import build_session
spark = build_session("away", 4, memory="2g", shuffle_partitions=4)
spark.sparkContext.setLogLevel("ERROR")

def importable(_):
    try:
        import lexweave
        return [True]
    except ModuleNotFoundError:
        return [False]

assert spark.sparkContext.parallelize([0], 1).mapPartitions(importable).collect() == [False]
from lexweave.llm.queries import LLM_QUERIES
for name, query in LLM_QUERIES.items():
    if name.split("_")[0] in ("op2", "op4", "op5", "op6", "op7", "op8", "op11", "op12", "op13"):
        assert query(spark, "/root/testdata/sf0.001").count() > 0, name
        print("done", name)
"""


def test_operators_travel_to_workers_without_the_package(tmp_path):
    script = tmp_path / "away.py"
    script.write_text(SCRIPT.format(repository=str(REPOSITORY)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert run.returncode == 0, run.stdout[-500:] + run.stderr[-2000:]
    assert run.stdout.count("done") == 9
