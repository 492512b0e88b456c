"""Row keys where ids are null or repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys made from hashes begin here, behind the ids.
FIRST_MADE = 1 << 62


def keyed(docs: DataFrame, id_col: str, columns: list[str], name: str) -> tuple[DataFrame, bool]:
    """``docs`` with the column ``name``, never null and equal only in rows that are equal in
    the id and ``columns``, and whether any two rows have the same key.

    The key is the id itself where all rows of the id are equal in ``columns``, so keys sort as
    ids do. Rows with a null id, and different rows that share an id, have a 64-bit hash of all
    of it, from 2**62 up. One pass over ``docs`` and a shuffle of ids and hashes decide.
    """
    value = F.xxhash64(*(F.struct(F.col(c).isNull(), F.col(c)) for c in (id_col, *columns)))
    made = F.shiftrightunsigned(value, 2).bitwiseOR(F.lit(FIRST_MADE))
    own = F.col(id_col).cast("long")
    rows = docs.select(own.alias("id"), value.alias("v"))
    # a null id has no key of its own: its rows are counted by their hash
    counts = rows.groupBy("id", F.when(F.col("id").isNull(), F.col("v")).alias("u")).agg(
        F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most")
    )
    mixed = F.col("id").isNotNull() & (F.col("least") != F.col("most"))
    found = counts.agg(F.max("n").alias("n"), F.count_if(mixed).alias("mixed")).first()
    repeated = (found["n"] or 0) > 1
    if not found["mixed"]:
        return docs.withColumn(name, F.coalesce(own, made)), repeated
    shared = counts.where(mixed).select(F.col("id").alias(name))
    out = docs.withColumn(f"{name}_made", made).withColumn(name, F.coalesce(own, made)).join(
        shared.withColumn(f"{name}_shared", F.lit(True)), name, "left"
    )
    key = F.when(F.col(f"{name}_shared"), F.col(f"{name}_made")).otherwise(F.col(name))
    return out.select(*docs.columns, key.alias(name)), repeated
