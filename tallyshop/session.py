"""Session settings that depend on the size of the input or on the cluster."""

from __future__ import annotations

import math
import re
import warnings
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

# A shuffle holds (scan tasks x shuffle partitions) blocks, so both are bounded:
# beyond these numbers tasks get larger and spill, instead of blocks getting tiny.
# They are the defaults of ``tune``; a larger cluster gives larger ones. What a task sorts and
# hashes takes up to 20 times the shuffled bytes it reads, so those are bounded as well.
SHUFFLE_PARTITION_BYTES = 16 << 20
SHUFFLE_PARTITIONS = 16_384
SCAN_TASKS = 200_000
SCAN_BYTES = 1 << 30
TASK_BYTES = 16 << 20
# Without it, blocks of a hot key are reported by the average of all small blocks once a
# shuffle has thousands of partitions, and adaptive execution does not see the key.
ACCURATE_BLOCKS = "spark.shuffle.accurateBlockSkewedFactor"

_INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
_SCAN_BYTES = "spark.sql.files.maxPartitionBytes"
_TASK_BYTES = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
_SKEWED_BYTES = "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes"

_UNITS = {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}


def parse_bytes(setting: str) -> int:
    """Bytes in a Spark size setting such as ``10485760b`` or ``64MB``."""
    number, unit = re.fullmatch(r"(-?\d+)\s*([bkmgt]?)b?", setting.strip().lower()).groups()
    return int(number) * _UNITS[unit]


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files and local rows a plan reads, from Catalyst's own leaf
    statistics. No job is run."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    return sum(
        int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())
    )


def tune(
    spark: SparkSession,
    largest: DataFrame | None = None,
    max_shuffle_partitions: int = SHUFFLE_PARTITIONS,
    max_scan_tasks: int = SCAN_TASKS,
    max_scan_bytes: int = SCAN_BYTES,
    max_task_bytes: int = TASK_BYTES,
) -> None:
    """Prepare a session for adaptive execution on skewed and large inputs.

    * A skewed join is split even where a later aggregation would have reused
      its partitioning; that costs one more exchange, and only when skew is seen.
    * Adaptive execution merges shuffle partitions, and splits skewed ones, to tasks that read
      ``max_task_bytes``; a partition counts as skewed from four times that. Smaller settings
      of the session stay.
    * Shuffles start with enough partitions for the input ``largest`` to be near
      16 MB each; adaptive execution merges the small ones afterwards. The
      session's own ``spark.sql.shuffle.partitions`` is the floor.
      At most ``max_shuffle_partitions`` are asked for.
    * Scans that would have more than ``max_scan_tasks`` tasks read larger splits, up to
      ``max_scan_bytes``.

    Hot keys are found by block sizes, so the application should start with
    ``spark.shuffle.accurateBlockSkewedFactor`` (5.0, say; with more than a hundred hot keys a
    larger ``spark.shuffle.maxAccurateSkewedBlockNumber`` too). A warning says so on a cluster
    where it is off.
    """
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    for key, most in ((_TASK_BYTES, max_task_bytes), (_SKEWED_BYTES, 4 * max_task_bytes)):
        if parse_bytes(spark.conf.get(key)) > most:
            spark.conf.set(key, str(most))
    context = spark.sparkContext
    if not context.master.startswith("local") and float(context.getConf().get(ACCURATE_BLOCKS, "-1")) <= 0:
        warnings.warn(f"{ACCURATE_BLOCKS} is off: hot join keys may stay unsplit", stacklevel=2)
    if largest is None:
        return
    size = input_bytes(largest)
    split = min(max_scan_bytes, math.ceil(size / max_scan_tasks))
    if split > parse_bytes(spark.conf.get(_SCAN_BYTES)):
        spark.conf.set(_SCAN_BYTES, str(split))
    wanted = min(max_shuffle_partitions, math.ceil(size / SHUFFLE_PARTITION_BYTES))
    floor = int(spark.conf.get("spark.sql.shuffle.partitions"))
    current = int(spark.conf.get(_INITIAL_PARTITIONS, str(floor)) or floor)
    if wanted > max(floor, current):
        spark.conf.set(_INITIAL_PARTITIONS, str(wanted))


def tuned(
    openers: Mapping[str, Callable[[], DataFrame]], facts: Iterable[str]
) -> dict[str, Callable[[], DataFrame]]:
    """Openers of tables that prepare the session (``tune``) when one of the ``facts`` is first
    opened, so that a report on dimensions opens no fact table for it."""

    def with_tune(opener: Callable[[], DataFrame]) -> Callable[[], DataFrame]:
        def opened() -> DataFrame:
            df = opener()
            tune(df.sparkSession, df)
            return df

        return opened

    large = set(facts)
    return {name: with_tune(x) if name in large else x for name, x in openers.items()}


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    A cluster names a shared folder in ``spark.checkpoint.dir``. Where that is unset, a
    folder in the warehouse is taken, which all executors share as well.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        configured = spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"
    context.setCheckpointDir(configured)
    return configured
