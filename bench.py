"""Time every report on ``$BENCH_SF_DIR`` and print one JSON line.

Each query is planned and run from the files, the best of three runs counts; nothing is
kept between queries. The plain dumps of the mapping are left out.
The first run of a session compiles and warms the JVM, so a few reports run
untimed before the clock starts.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tallyshop.catalogue import OPERATORS, queries

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 3
WARM_UP = ("best_sellers", "store_scorecard", "clv_tiers", "discount_tiers_category")


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("tallyshop-bench")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.shuffle.accurateBlockSkewedFactor", "5.0")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(spark: SparkSession, query) -> float:
    start = time.perf_counter()
    query(spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = session()
    by_name = queries()
    for name in WARM_UP:
        timed(spark, by_name[name])
    seconds = {
        name: round(min(timed(spark, query) for _ in range(RUNS)), 4)
        for name, query in by_name.items()
        if not (name in OPERATORS and name.startswith("table_"))
    }
    print(
        json.dumps(
            {
                "metric": "total_report_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
