"""Queries on workers that cannot import this package."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
PROGRAM = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false")
    .config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate())
spark.sparkContext.setLogLevel("ERROR")

def importable(batches):
    import importlib.util
    for batch in batches:
        yield batch.assign(id=int(importlib.util.find_spec("tallyshop") is not None))

assert spark.range(4).mapInPandas(importable, "id long").distinct().first()[0] == 0
from tallyshop.llm.queries import QUERIES
for name in ("op2_language", "op4_toxicity", "op8_pseudo_likelihood", "op12_ngram_join", "op13_filter_audit"):
    print(name, QUERIES[name](spark, {folder!r}).count())
"""


def test_executors_need_no_copy_of_the_package(star_dir, tmp_path):
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    ran = subprocess.run(
        [sys.executable, "-c", PROGRAM.format(root=ROOT, folder=star_dir)],
        cwd=tmp_path, env=environment, capture_output=True, text=True,
    )
    assert ran.returncode == 0, ran.stderr[-3000:]
    counts = dict(line.split() for line in ran.stdout.splitlines() if line.startswith("op"))
    assert len(counts) == 5 and all(int(n) > 0 for n in counts.values())
