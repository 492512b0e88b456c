"""What filters of a corpus remove in every order they can be applied in.

A document matters only by the set of filters that it fails, so documents are first counted by
that set (and by part and label); a part has at most 2 ** filters * 4 such counts. All orders
are then worked out on the counts at once: with ``M`` (patterns x filters, 0 where a pattern
fails a filter, else infinite) and ``P`` (filters x orders, the place of a filter in an order,
which is the inverse of its permutation), the min-plus product ``min over f of M[p, f] + P[f, o]``
is the step at which order ``o`` removes pattern ``p``. Counts are scattered by that step.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Each filter adds a factor to the number of orders; seven have 5,040.
MOST_FILTERS = 7

_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")

# The bounds of the five filters.
LEAST_WORDS = 100
LEAST_DISTINCT_PERCENT = 80
MOST_CAPITALS_PERCENT = 10
SYMBOLS = "[#$%&*|]"


def text_failures(docs: DataFrame, text_col: str = "text", out: str = "failed") -> DataFrame:
    """``docs`` with ``out``, the letters of the filters that look at one text and that it
    fails: ``A`` too few words, ``B`` too few distinct words, ``C`` too many capitals, ``D`` a
    symbol of markup. Null is an empty text. No column of ``docs`` may begin
    with ``_audit_``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    spaced = text
    for space in "\t\n\x0b\x0c\r":
        spaced = F.replace(spaced, F.lit(space), F.lit(" "))
    # the words are cut once: a projection of their own keeps them from being planned twice
    cut = docs.withColumns(
        {
            "_audit_words": F.array_remove(F.split(spaced, " "), ""),
            "_audit_capitals": F.regexp_count(text, F.lit("[A-Z]")),
        }
    )
    n, capitals = F.col("_audit_n"), F.col("_audit_capitals")
    measured = cut.withColumns(
        {
            "_audit_n": F.size("_audit_words"),
            "_audit_distinct": F.size(F.array_distinct("_audit_words")),
        }
    )
    fails = {
        "A": n < LEAST_WORDS,
        "B": 100 * F.col("_audit_distinct") < LEAST_DISTINCT_PERCENT * n,
        "C": 100 * capitals > MOST_CAPITALS_PERCENT * F.length(text),
        "D": text.rlike(SYMBOLS),
    }
    letters = F.concat(*(F.when(x, letter).otherwise("") for letter, x in fails.items()))
    return measured.select(*docs.columns, letters.alias(out))


def patterns(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "lang",
) -> DataFrame:
    """``(part, failed, good, toxic, n)``: documents counted by part (null: empty string), the
    letters of the filters ``A`` to ``E`` that they fail, and their labels.

    ``E`` is a text identical to that of any smaller id in the whole table. Rows that share the
    smallest id of a text all pass it. A null id comes after all others: such a row fails ``E``
    where a row with an id has its text, and passes where none has. A document is good or toxic
    if any of its label rows says so; a null id has no label. Repeated rows count each. Other
    columns are not read, so their names do not clash. An empty table gives no rows.

    Texts are compared by SHA-256. Rows are counted per id, text and part before the first
    shuffle and per text, part and label before the second, so copies of one text are at most
    one row per task and combination, and no text is shuffled.
    """
    read = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    rows = (
        text_failures(read)
        .select("id", "part", F.unhex(F.sha2("text", 256)).alias("sha"), "failed")
        .groupBy("id", "part", "sha", "failed")
        .agg(F.count("*").alias("n"))
    )
    marks = labels.groupBy(F.col(id_col).alias("id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    )
    # rows without an id match no label; the salt keeps them from meeting in one task
    salt = F.when(F.col("id").isNull(), F.xxhash64("sha")).otherwise(F.lit(0).cast("long"))
    known = (
        rows.withColumn("salt", salt)
        .join(marks.withColumn("salt", F.lit(0).cast("long")), ["id", "salt"], "left")
        .na.fill({"good": False, "toxic": False})
    )
    group = ["part", "failed", "good", "toxic"]
    # an id has one row here, so the least row of a group holds all of its least id
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "n")).alias("least")
    per_text = known.groupBy("sha", *group).agg(F.sum("n").alias("n"), least)
    own = F.struct("least.none", "least.id")
    first = F.min(own).over(Window.partitionBy("sha"))
    counted = (
        per_text.withColumn("passing", F.when(own == first, F.col("least.n")).otherwise(0))
        .groupBy(*group)
        .agg(F.sum("passing").alias("passing"), F.sum("n").alias("n"))
    )
    split = F.array(
        F.struct(F.col("failed").alias("failed"), F.col("passing").alias("n")),
        F.struct(F.concat("failed", F.lit("E")).alias("failed"), (F.col("n") - F.col("passing")).alias("n")),
    )
    return (
        counted.select("part", F.explode(split).alias("x"), "good", "toxic")
        .select("part", "x.failed", "good", "toxic", "x.n")
        .where("n > 0")
    )


def _places(filters: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """All orders, the filter at each step of an order, and the step of each filter in it."""
    order = np.array(list(permutations(range(len(filters)))))
    return ["".join(filters[f] for f in row) for row in order], order, np.argsort(order, axis=1)


def removal_steps(masks: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Step (from 0) at which each order removes each pattern, the number of filters where it
    never does: the min-plus product of masks and places. ``masks`` is patterns x filters, true
    where a pattern fails; ``places`` orders x filters."""
    cost = np.where(masks, 0, masks.shape[1])
    steps = np.full((len(masks), len(places)), masks.shape[1])
    for f in range(masks.shape[1]):
        np.minimum(steps, cost[:, f, None] + places[None, :, f], out=steps)
    return steps


def audit(counts: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """One row per part, order of ``filters`` and step, from ``patterns`` or any frame
    ``(part, failed, good, toxic, n)``: ``part, filter_order, step`` and, within the part,

    * ``kept``: documents left after the step, ``removed``: those that go in it;
    * ``redundant``: documents that fail the step's filter and went earlier;
    * ``unique_fails``: documents that fail this filter and no other;
    * ``good_lost``, ``toxic_lost``: good and toxic ones among the removed;
    * ``shapley``: what the filter removes, added up over all orders.

    Repeated combinations are added up. ``failed`` may hold letters in any order and must hold
    none but those of ``filters`` (at most ``MOST_FILTERS``, a filter more multiplies the
    orders). A part without rows has none in the result, so no rows give none.
    """
    if len(set(filters)) != len(filters) or not 0 < len(filters) <= MOST_FILTERS:
        raise ValueError(f"need 1 to {MOST_FILTERS} different letters, not {filters!r}")

    def orders(rows: pd.DataFrame) -> pd.DataFrame:
        names, order, places = _places(filters)
        known = set(filters)
        if not all(known.issuperset(x) for x in rows["failed"]):
            raise ValueError(f"failed holds letters other than {filters!r}")
        masks = np.array([[f in x for f in filters] for x in rows["failed"]])
        n = rows["n"].to_numpy(np.int64)
        steps = removal_steps(masks, places)
        n_orders, n_steps = order.shape
        which = np.broadcast_to(np.arange(n_orders), steps.shape)

        def scattered(weight: np.ndarray) -> np.ndarray:
            out = np.zeros((n_orders, n_steps + 1), np.int64)
            np.add.at(out, (which, steps), weight[:, None])
            return out[:, :n_steps]

        removed = scattered(n)
        fails = n @ masks
        only = n @ (masks & (masks.sum(1) == 1)[:, None])
        by_filter = np.zeros(n_steps, np.int64)
        np.add.at(by_filter, order, removed)
        columns = {
            "kept": n.sum() - np.cumsum(removed, axis=1),
            "removed": removed,
            "redundant": fails[order] - removed,
            "unique_fails": only[order],
            "good_lost": scattered(np.where(rows["good"], n, 0)),
            "toxic_lost": scattered(np.where(rows["toxic"], n, 0)),
            "shapley": by_filter[order],
        }
        return pd.DataFrame(
            {
                "part": rows["part"].iloc[0],
                "filter_order": np.repeat(names, n_steps),
                "step": np.tile(np.arange(1, n_steps + 1, dtype=np.int32), n_orders),
            }
            | {name: columns[name].ravel() for name in _COUNTS}
        )

    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _COUNTS)
    added = counts.groupBy("part", "failed", "good", "toxic").agg(F.sum("n").alias("n"))
    return added.groupBy("part").applyInPandas(orders, schema)
