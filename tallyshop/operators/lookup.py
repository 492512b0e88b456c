"""Join a large frame to a dimension, broadcasting only what is checked to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyshop.session import input_bytes, parse_bytes


def fits_broadcast(dim: DataFrame) -> bool:
    """Whether everything ``dim`` is built from is within the session's
    ``spark.sql.autoBroadcastJoinThreshold``.

    Catalyst multiplies the sizes of both sides when it estimates a join, so it
    would refuse a dimension that is itself a lookup in a smaller one. The bytes
    of the inputs bound such a dimension: it has no more rows than its first input.
    """
    limit = parse_bytes(dim.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold"))
    return input_bytes(dim) <= limit


def lookup(facts: DataFrame, dim: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """``facts`` with the columns of the dimension ``dim``, by broadcast within
    the limit. Beyond it both are shuffled, and adaptive execution splits hot keys (see
    ``session.tune``)."""
    return facts.join(F.broadcast(dim) if fits_broadcast(dim) else dim, on, how)
