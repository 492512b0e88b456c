"""Declared constraints as data-quality jobs that return what violates them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyshop.functions import count_if
from tallyshop.schema import PRIMARY_KEYS, REFERENCES, REQUIRED, Reference, RetailTables


def pk_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once or have a null part, with their row count."""
    any_null = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
    return (
        df.groupBy(*keys)
        .agg(F.count("*").alias("n_rows"))
        .where((F.col("n_rows") > 1) | any_null)
    )


def null_violations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Nulls per column, in one pass: ``column_name``, ``violations``."""
    counts = df.agg(*(count_if(F.col(c).isNull()).alias(c) for c in cols))
    return counts.unpivot([], list(cols), "column_name", "violations")


# Places of the filter of unknown references: 256 rows of 4 KB, however many references there are.
_PLACES = 1 << 23


def _marked(place: Column, marks: Column) -> Column:
    """Whether the bitmap ``marks`` of the bucket of ``place`` holds it."""
    position = F.bitmap_bit_position(place)
    byte = F.substring(marks, (position / 8).cast("int") + 1, F.lit(1))
    value = F.conv(F.hex(byte), 16, 10).cast("int")
    return F.call_function("getbit", value, (position % 8).cast("int")) == 1


def fk_violations(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Child rows whose non-null ``fk`` does not exist in the parent.

    The unknown references are found first, over distinct values. Hashed into a bitmap of fixed
    size, which is broadcast, they pick the child rows where these lie; only rows picked are
    shuffled for the exact answer. A valid reference held by many rows costs no shuffle of these.
    """
    known = parent.select(F.col(pk).alias(fk))
    unknown = child.select(fk).where(F.col(fk).isNotNull()).distinct().join(known, fk, "left_anti")
    place = F.xxhash64(fk).bitwiseAND(_PLACES - 1) + 1
    marks = (
        unknown.select(place.alias("_place"))
        .groupBy(F.bitmap_bucket_number("_place").alias("_bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_marks"))
    )
    picked = (
        child.withColumn("_place", place)
        .withColumn("_bucket", F.bitmap_bucket_number("_place"))
        .join(F.broadcast(marks), "_bucket")
        .where(_marked(F.col("_place"), F.col("_marks")))
    )
    # unknown references are distinct, and an inner join, unlike a semi join, stays above the filter
    return picked.join(unknown, fk).select(child.columns)


def _key_type(t: Mapping[str, DataFrame], domains: Sequence[tuple[str, tuple[str, ...]]]) -> str:
    kinds = {t[table].schema[k].dataType.simpleString() for table, keys in domains for k in keys}
    return "bigint" if kinds <= {"tinyint", "smallint", "int", "bigint"} else "string"


def validate(
    t: RetailTables,
    primary_keys: Mapping[str, Sequence[str]] = PRIMARY_KEYS,
    required: Mapping[str, Sequence[str]] = REQUIRED,
    references: Sequence[Reference] = REFERENCES,
) -> DataFrame:
    """Violations of every declared key, not-null column and reference:
    ``table_name``, ``constraint_name``, ``violations``.

    Each table is read once. A row becomes one tagged key for its own primary key, which also
    answers for the references to it and carries the row's missing values, and one for each
    reference that it holds. Keys of all tables meet in a single shuffle, counted before it, so
    a key held by many rows is one row per task. A key is violated if it is repeated or has a
    null part; a reference, once per row that holds one without a parent; nulls refer to nothing.
    """
    domains = [(table, tuple(keys)) for table, keys in primary_keys.items()]
    domains += sorted({(r.parent, (r.key,)) for r in references} - set(domains))
    number = {domain: i for i, domain in enumerate(domains)}
    referring = {d: [r for r in references if (r.parent, (r.key,)) == d] for d in domains}
    width = max(len(keys) for _, keys in domains)
    kind = _key_type(t, domains)
    keys = [f"key{i}" for i in range(width)]
    missing = [f"missing{i}" for i in range(max((len(c) for c in required.values()), default=0))]
    strays = [f"stray{i}" for i in range(max(map(len, referring.values())))]

    def tag(domain, columns, side: Column, nulls: Sequence[str] = ()) -> Column:
        parts = [F.col(c).cast(kind) for c in columns]
        parts += [F.lit(None).cast(kind)] * (width - len(parts))
        flags = [F.col(c).isNull().cast("int") for c in nulls]
        flags += [F.lit(0)] * (len(missing) - len(flags))
        return F.struct(
            F.lit(number[domain]).alias("domain"),
            side.alias("side"),
            *(x.alias(name) for x, name in zip([*parts, *flags], [*keys, *missing])),
        )

    def tagged(table: str) -> DataFrame:
        own = [d for d in domains if d[0] == table]
        primary = (table, tuple(primary_keys.get(table, ())))
        tags = [tag(d, d[1], F.lit(0), required.get(table, ()) if d == primary else ()) for d in own]
        for domain, refs in referring.items():
            for side, r in enumerate(refs, 1):
                if r.child == table:
                    held = F.when(F.col(r.column).isNotNull(), side)
                    tags.append(tag(domain, [r.column], held))
        return t[table].select(F.inline(F.array(*tags))).where("side IS NOT NULL")

    incomplete = reduce(
        Column.__or__,
        (
            (F.col("domain") == number[d]) & F.col(key).isNull()
            for d in domains
            for key in keys[: len(d[1])]
        ),
    )
    names = {d[0] for d in domains} | {r.child for r in references}
    per_key = (
        reduce(DataFrame.unionByName, map(tagged, sorted(names)))
        .groupBy("domain", *keys)
        .agg(
            count_if(F.col("side") == 0).alias("own"),
            *(count_if(F.col("side") == i).alias(name) for i, name in enumerate(strays, 1)),
            *(F.sum(name).alias(name) for name in missing),
        )
    )
    broken = (F.col("own") > 1) | ((F.col("own") > 0) & incomplete)
    found = per_key.groupBy("domain").agg(
        count_if(broken).alias("own"),
        *(F.sum(F.when(F.col("own") == 0, F.col(name)).otherwise(0)).alias(name) for name in strays),
        *(F.sum(name).alias(name) for name in missing),
    )

    def constraint(table: str, kind: str, columns: Sequence[str], domain, measure: str) -> Column:
        values = (table, f"{kind} ({', '.join(columns)})", number[domain], measure)
        return F.struct(*map(F.lit, values))

    declared = [constraint(table, "primary key", d, (table, tuple(d)), "own") for table, d in primary_keys.items()]
    declared += [
        constraint(table, "not null", [c], (table, tuple(primary_keys[table])), name)
        for table, columns in required.items()
        for c, name in zip(columns, missing)
    ]
    declared += [
        constraint(r.child, "foreign key", [r.column], d, name)
        for d, refs in referring.items()
        for r, name in zip(refs, strays)
    ]
    everything = t.spark.range(1).select(F.inline(F.array(*declared)))
    everything = everything.toDF("table_name", "constraint_name", "domain", "measure")
    counted = found.unpivot("domain", ["own", *strays, *missing], "measure", "violations")
    return everything.join(counted, ["domain", "measure"], "left").select(
        "table_name", "constraint_name", F.coalesce("violations", F.lit(0)).cast("bigint").alias("violations")
    )
