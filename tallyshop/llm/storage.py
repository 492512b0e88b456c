"""What all executors share: the folder in which lineage is cut, and models."""

from __future__ import annotations

import pickle

from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only where it is unset, a folder in the
    warehouse, which all executors share as well."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(folder or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints")
    return context.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, where it outlives executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows in a partition of a small table, at least while it has more than ``FEWEST`` partitions.
ROWS, FEWEST = 4_096, 8


def fitted(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of at most ``rows`` rows in no more partitions than they need. Shuffles write files
    per partition that feeds them, however few the rows."""
    return df.coalesce(max(FEWEST, -(-rows // ROWS)))


def saved_small(df: DataFrame) -> tuple[DataFrame, int]:
    """``saved`` and ``fitted``, with the number of rows."""
    out = saved(df)
    rows = out.count()
    return fitted(out, rows), rows


def shared(spark: SparkSession, model) -> Broadcast:
    """A broadcast that ``opened`` reads in tasks. Spark pickles broadcasts by reference; this one
    carries its classes with it, so executors need no copy of this package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(model))


def opened(model: Broadcast):
    return pickle.loads(model.value)
