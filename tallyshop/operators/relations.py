"""Unmatched rows, hierarchies and counts looked up per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unmatched(parent: DataFrame, child: DataFrame, key: str) -> DataFrame:
    """Parent rows no child row refers to.

    The child's keys are made distinct before the shuffle: a popular key is one
    row per task, and an anti join could not be split on the child's side.
    """
    return parent.join(child.select(key).distinct(), key, "left_anti")


def with_manager(staffs: DataFrame) -> DataFrame:
    """Each staff member with the name of their manager, null at the top."""
    managers = staffs.select(
        F.col("staff_id").alias("manager_id"),
        F.col("first_name").alias("manager_first_name"),
        F.col("last_name").alias("manager_last_name"),
    )
    return staffs.join(managers, "manager_id", "left")


def team_rollup(staff_metric: DataFrame, staffs: DataFrame, metric: str) -> DataFrame:
    """``metric`` of the direct reports of each manager, the manager's own left
    out. ``staff_metric`` has one row per staff member with ``manager_id``."""
    teams = staff_metric.groupBy("manager_id").agg(
        F.count("staff_id").alias("num_direct_reports"),
        F.sum(metric).alias(f"team_{metric}"),
    )
    managers = staffs.select(
        F.col("staff_id").alias("manager_id"),
        F.col("first_name").alias("manager_first_name"),
        F.col("last_name").alias("manager_last_name"),
    )
    return teams.join(managers, "manager_id")


def count_lookup(
    parent: DataFrame, child: DataFrame, key: str, pred: Column, out: str = "n"
) -> DataFrame:
    """``parent`` with the number of ``child`` rows of the same key that satisfy
    ``pred``; 0 where there are none."""
    counts = child.where(pred).groupBy(key).agg(F.count("*").alias(out))
    return parent.join(counts, key, "left").withColumn(out, F.coalesce(out, F.lit(0)))
