"""Top-n, rank and quantile buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyshop.session import ensure_checkpoint_dir

# monotonically_increasing_id keeps the partition above this many bits of row index.
_ROW_BITS = 33


def top_n(df: DataFrame, order: Sequence[Column], n: int, tie: Sequence[str]) -> DataFrame:
    """First ``n`` rows by ``order``; ``tie`` makes the choice among equals
    repeatable. Each task keeps ``n`` rows, so nothing is sorted as a whole."""
    return df.orderBy(*order, *tie).limit(n)


def _sorted_rows(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``df`` in range partitions of the global order, with ``_part``, the partition, and
    ``_at``, the position in it, from 1.

    The sorted rows are checkpointed: they are read twice, and both reads must
    see the same partitions even if executors are lost in between.
    """
    ensure_checkpoint_dir(df.sparkSession)
    ranged = df.orderBy(*order).checkpoint()
    row = F.monotonically_increasing_id()
    return ranged.withColumns(
        {
            "_part": F.shiftright(row, _ROW_BITS),
            "_at": row.bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + 1,
        }
    )


def place(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``df`` in range partitions of the global order, with ``_part``, the
    partition, ``_end``, the position in the global order from 1, and ``_total``, the
    number of rows.

    A window without partitions would sort all rows in one task. Here the rows
    are range-partitioned and sorted, and a row's position is that inside its
    partition plus the sizes of the partitions before it. ``order`` must be
    unique for the result to be repeatable.
    """
    placed = _sorted_rows(df, order)
    # One row per partition from here to the join.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .agg(F.count("*").alias("_size"))
        .select(
            "_part",
            F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"),
            F.sum("_size").over(Window.partitionBy()).alias("_total"),
        )
    )
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn("_end", F.col("_offset") + F.col("_at"))
        .drop("_at", "_offset")
    )


def global_row_number(df: DataFrame, order: Sequence[Column], out: str = "rn") -> DataFrame:
    """Position of every row in the global order, from 1, without gathering all
    rows in one task."""
    return place(df, order).withColumnRenamed("_end", out).drop("_part", "_total")


def ntile_global(
    df: DataFrame, n: int, order: Sequence[Column], out: str = "ntile"
) -> DataFrame:
    """``NTILE(n) OVER (ORDER BY order)`` without gathering all rows in one task.

    Buckets differ by at most one row; the first ``count % n`` take the extra.
    """
    sized = place(df, order).withColumns(
        {"_q": F.expr(f"_total div {n}"), "_r": F.expr(f"_total % {n}")}
    )
    bucket = F.expr(
        "CASE WHEN _end <= _r * (_q + 1) THEN (_end - 1) div (_q + 1) + 1 "
        "ELSE _r + (_end - 1 - _r * (_q + 1)) div greatest(_q, 1) + 1 END"
    )
    return sized.withColumn(out, bucket.cast("bigint")).drop(
        "_part", "_total", "_end", "_q", "_r"
    )


def _boundaries(placed: DataFrame) -> DataFrame:
    """One row per range partition but the first: the group and value of the last row before
    it, ``_before``, and how many rows of that group (``_rows``) and how many of them ahead of
    that value (``_ahead``) lie in the partitions before it.

    ``placed`` has ``_part``, ``_at``, ``_key`` (group and value), and the window's ``_rank`` and
    ``_row`` in the group, inside the partition.
    """
    ends = placed.groupBy("_part").agg(
        F.count("*").alias("n"),
        F.min_by("_key", "_at").alias("first"),
        F.max_by(F.struct("_key", "_rank", "_row"), "_at").alias("last"),
    )
    # What a partition ends with may have begun in an earlier one, if all of it is of that
    # group, or of that group and value. Its size up to here is then that of the last
    # partition where it did not, and all rows since.
    order = Window.orderBy("_part")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    previous = F.lag("last._key").over(order)
    rows = F.sum("n").over(so_far)
    group_began = ~(
        F.col("first.group").eqNullSafe(F.col("last._key.group"))
        & F.coalesce(previous["group"].eqNullSafe(F.col("first.group")), F.lit(False))
    )
    value_began = group_began | ~(
        F.col("first").eqNullSafe(F.col("last._key")) & F.coalesce(previous.eqNullSafe(F.col("first")), F.lit(False))
    )
    started = ends.select(
        "_part",
        "last._key",
        rows.alias("rows"),
        # rows of the whole table before the last row's group, and before its value
        F.when(group_began, rows - F.col("last._row")).alias("group_at"),
        F.when(value_began, rows - F.col("last._row") + F.col("last._rank") - 1).alias("value_at"),
    )
    known = started.withColumns(
        {c: F.last(c, ignorenulls=True).over(so_far) for c in ("group_at", "value_at")}
    )
    return known.select(
        F.lead("_part").over(order).alias("_part"),
        F.col("_key").alias("_before"),
        (F.col("rows") - F.col("group_at")).alias("_rows"),
        (F.col("value_at") - F.col("group_at")).alias("_ahead"),
    ).where("_part IS NOT NULL")


def rank_within(
    df: DataFrame, part: Sequence[str], by: str, tie: Sequence[str], out: str = "rank"
) -> DataFrame:
    """``RANK() OVER (PARTITION BY part ORDER BY by DESC)``, without gathering a
    group in one task. ``tie`` makes rows unique; it does not affect the rank.

    Rows are range-partitioned by group and value. A window ranks them inside their
    partition; one row per partition says which group and value the partitions before it end
    with and how many rows of these they hold, which is added where a group reaches across.
    """
    part, tie = list(part), list(tie)
    key = F.struct(F.struct(*part).alias("group"), F.col(by).alias("value"))
    inside = Window.partitionBy("_part", *part).orderBy(F.col(by).desc())
    # up to and with all equal values: at the end of a partition, all rows of its group
    so_far = inside.rangeBetween(Window.unboundedPreceding, 0)
    placed = _sorted_rows(df, [*map(F.col, part), F.col(by).desc(), *map(F.col, tie)]).withColumns(
        {
            "_key": key,
            "_rank": F.rank().over(inside),
            "_row": F.count("*").over(so_far),
        }
    )
    crossing = placed.join(F.broadcast(_boundaries(placed)), "_part", "left")
    same_group = F.col("_key.group").eqNullSafe(F.col("_before.group"))
    across = F.coalesce(F.col("_before").isNotNull() & same_group, F.lit(False))
    rank = (
        F.when(across & F.col("_key.value").eqNullSafe(F.col("_before.value")), F.col("_ahead") + 1)
        .when(across, F.col("_rows") + F.col("_rank"))
        .otherwise(F.col("_rank"))
    )
    return crossing.withColumn(out, rank.cast("bigint")).drop(
        "_part", "_at", "_key", "_rank", "_row", "_before", "_rows", "_ahead"
    )
