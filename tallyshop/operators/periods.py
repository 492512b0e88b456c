"""Growth and running totals over a frame with one row per period.

The window has no partition: a calendar has few periods, whatever the number of
facts behind them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyshop.functions import rounded


def growth_pct(df: DataFrame, order_col: str, value: str, out: str = "growth_pct") -> DataFrame:
    """Change against the previous period in percent, from unrounded values.
    Null for the first period and after a period of zero."""
    previous = F.lag(value).over(Window.orderBy(order_col)).cast("double")
    change = (F.col(value).cast("double") - previous) / F.nullif(previous, F.lit(0.0))
    return df.withColumn(out, rounded(change * 100))


def running_total(
    df: DataFrame,
    order_col: str,
    value: str,
    partition: str | None = None,
    out: str = "running_total",
) -> DataFrame:
    """Sum of ``value`` up to and including the current period."""
    window = (
        Window.partitionBy(partition).orderBy(order_col)
        if partition
        else Window.orderBy(order_col)
    ).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.sum(value).over(window))
