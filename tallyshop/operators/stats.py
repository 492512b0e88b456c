"""Shares, medians, segments and metric bundles over groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyshop.functions import count_if, mean, rate_pct, rounded, share_pct
from tallyshop.operators.facts import is_shipped

# Order status codes and the columns of the status pivot.
STATUS_COLUMNS = {"pending": 1, "processing": 2, "rejected": 3, "completed": 4}


def pct_of_total(
    df: DataFrame,
    num: str,
    out: str,
    base: str | None = None,
    total_df: DataFrame | None = None,
) -> DataFrame:
    """``num`` as a percentage of the sum of ``base`` (``num`` itself by default)
    over ``df``, or of the single value in ``total_df``.

    ``df`` is an aggregated frame with one row per status, tier or store. Adding
    up those few rows reads the facts once, where a total of its own reads them
    again.
    """
    if total_df is not None:
        whole = total_df.scalar()
    else:
        whole = F.sum(base or num).over(Window.partitionBy())
    return df.withColumn(out, share_pct(F.col(num), whole))


# Ranges of values between one power of two and the next, in the first pass of a median.
_RANGES = 64
# The range of nulls, below all others.
_NULLS = -1.0e6


def _value_range(v: Column, ranges: int = _RANGES) -> Column:
    """Number of the range that holds ``v``: it never falls as ``v`` grows. Powers of two are
    cut into ``ranges`` parts, so a group has a few hundred ranges whatever its rows."""
    size = F.abs(v.cast("double")) + 1
    power = F.floor(F.log2(size))
    part = F.floor((size / F.pow(F.lit(2.0), power) - 1) * ranges)
    return F.coalesce(F.signum(v.cast("double")) * (power * ranges + part), F.lit(_NULLS))


def group_median(
    df: DataFrame,
    keys: Sequence[str],
    col: str,
    out: str = "median",
    weight: str | None = None,
    also: Sequence[Column] = (),
) -> DataFrame:
    """Exact median per group: the mean of the one or two middle rows. ``weight`` says how
    often a row counts, for a frame that is already counted by value. ``also`` are named
    aggregates of the same groups, worked out on the way.

    Nulls take part in the ordering, first, and are left out of the mean.

    The middle is found by narrowing, in two passes that add up before their only shuffle, on
    the group: the first counts rows per range of values, and only ranges, so it holds a few
    hundred counts per group. The second keeps exact values inside the middle's range; all below
    and all above count as one value each, which leaves the middle where it is. If the two
    middle rows lie in different ranges, no row is between them: they are the largest value
    below and the smallest above. No group's rows, nor all its values, meet in one task.
    """
    keys = list(keys)
    value, n = F.col(col), F.col(weight) if weight else F.lit(1)
    ranged = df.withColumn("_range", _value_range(value))
    # null keys are groups too, so they are compared as structs
    grouped = ranged.withColumn("_group", F.struct(*keys)) if keys else ranged.withColumn("_group", F.lit(0))
    middle = grouped.groupBy("_group").agg(F.percentile("_range", 0.5, n).alias("_middle"))
    at, mid = F.col("_range"), F.col("_middle")
    narrowed = F.when(at < mid, float("-inf")).when(at > mid, float("inf")).otherwise(value.cast("double"))
    below = F.max(F.when((at < mid) & (at > _NULLS), value)).cast("double")
    above = F.min(F.when(at > mid, value)).cast("double")
    found = (
        grouped.join(middle, "_group")
        .groupBy("_group")
        .agg(
            F.max(at == mid).alias("_inside"),
            F.percentile(narrowed, 0.5, n).alias("_value"),
            F.max(F.when(mid > _NULLS, True)).alias("_valued"),
            below.alias("_below"),
            above.alias("_above"),
            *also,
        )
    )
    between = F.coalesce((F.col("_below") + F.col("_above")) / 2, "_below", "_above")
    median = F.when(F.col("_inside"), F.when(F.col("_valued"), F.col("_value"))).otherwise(between)
    own = [c for c in found.columns if not c.startswith("_")]
    return found.select(*(F.col(f"_group.{k}").alias(k) for k in keys), *own, median.alias(out))


def count_distinct_ids(
    df: DataFrame, keys: Sequence[str], id_col: str, out: str = "n_ids"
) -> DataFrame:
    """``COUNT(DISTINCT id_col)`` per group, for integer ids, nulls left out.

    Ids are set in bitmaps of 32,768 neighbours each, which tasks fill before the shuffle and
    which are merged after it: where a group holds many ids of a stretch, a bit travels for
    each, not a row. A stretch with a single id travels as one mostly empty, well compressed
    bitmap.
    """
    bits = F.bitmap_construct_agg(F.bitmap_bit_position(id_col))
    stretches = df.groupBy(*keys, F.bitmap_bucket_number(id_col).alias("_stretch")).agg(bits.alias("_bits"))
    return stretches.groupBy(*keys).agg(F.sum(F.bitmap_count("_bits")).alias(out))


def segment_by_count(
    df: DataFrame, key: str, band: Column, out: str = "segment"
) -> DataFrame:
    """Rows per ``key``, then keys per band. ``band`` is an expression over
    ``n_rows``. ``n_keys`` counts a null key as one; ``n_known`` leaves it out."""
    per_key = df.groupBy(key).agg(F.count("*").alias("n_rows"))
    return per_key.groupBy(band.alias(out)).agg(
        F.count("*").alias("n_keys"), F.count(key).alias("n_known")
    )


def status_pivot(orders: DataFrame, keys: Sequence[str | Column]) -> DataFrame:
    """Orders per status in columns, their total and the rejected share."""
    code = F.col("order_status")
    return orders.groupBy(*keys).agg(
        *(count_if(code == v).alias(name) for name, v in STATUS_COLUMNS.items()),
        F.count("*").alias("total_orders"),
        rate_pct(code == STATUS_COLUMNS["rejected"]).alias("rejection_rate_pct"),
    )


def fulfilment(orders: DataFrame, keys: Sequence[str | Column] = ()) -> DataFrame:
    """Shipping speed of completed, shipped orders. Unused metrics are pruned."""
    days = F.datediff("shipped_date", "order_date")
    against_promise = F.datediff("shipped_date", "required_date")
    late = F.col("shipped_date") > F.col("required_date")
    return (
        orders.where(is_shipped())
        .groupBy(*keys)
        .agg(
            F.count("*").alias("num_completed_orders"),
            rounded(mean(days)).alias("avg_days_to_ship"),
            F.min(days).cast("bigint").alias("fastest_fulfillment_days"),
            F.max(days).cast("bigint").alias("slowest_fulfillment_days"),
            rounded(mean(against_promise)).alias("avg_days_early_or_late"),
            F.sum(F.when(late, 1).otherwise(0)).alias("num_late_orders"),
            rate_pct(late).alias("pct_late"),
        )
    )
