"""A Merkle manifest of a dataset: one tree of digests per group of rows, one tree over the groups.

A node is labelled with the interval of leaf ranks that it covers in its tree, so ancestry is
containment of intervals. All nodes of a level but the last of a tree cover the same number of
ranks, so that number's multiples are buckets in which a node meets its parent: the join that
attaches ancestors is one of equal buckets, checked by containment, and there is one per level.
A parent keeps the digests of its children in rank order; what is left of its interval without a
child's own is where the child's siblings are. Nothing but one number (the largest tree)
reaches the driver, and no task holds more than ``arity`` nodes of a run at a time, whatever the
size of a tree or the number of trees.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from functools import reduce

from tallyshop.llm.storage import saved
from tallyshop.operators.ordering import place

ARITY = 16
#: Characters of a digest in hexadecimal.
WIDTH = 64

_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z, and nothing beyond ASCII, in lower case."""
    return F.translate(text, _CAPITALS, _CAPITALS.lower())


def digest_of(values: Sequence[Column]) -> Column:
    """SHA-256, in hexadecimal, of ``-`` for each null and ``length:value`` for each other value,
    with the length in UTF-8 bytes. Integers count as their decimal digits."""
    texts = [v.cast("string") for v in values]
    parts = (F.coalesce(F.concat(F.octet_length(t), F.lit(":"), t), F.lit("-")) for t in texts)
    return F.sha2(F.concat(*parts), 256)


def _key(group: Column) -> Column:
    """A text that is never null, equal where groups are equal, and sorts as they do bytewise,
    null first."""
    text = group.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.lit(":"), text))


def _ranked(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``tree``, a number per ``key`` that sorts as keys do, ``lo``, the rank from 0
    in the tree by ``order`` (nulls first), and ``n``, the size of the tree.

    Ranks come from sorted range partitions and their counts, so one tree may span them all.
    """
    placed = place(rows, [F.col(c).asc_nulls_first() for c in ("key", *order)])
    # one row per range partition and tree in it
    runs = placed.groupBy("_part", "key").agg(F.min("_end").alias("least"), F.count("*").alias("n"))
    trees = runs.groupBy("key").agg(F.min("least").alias("tree"), F.sum("n").alias("n"))
    starts = runs.select("_part", "key").join(trees, "key")
    return (
        placed.join(starts, ["_part", "key"])
        .withColumn("lo", F.col("_end") - F.col("tree"))
        .drop("_part", "_end", "_total", "key")
    )


def _joined(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: x["digest"]), "")


def _runs(leaves: DataFrame) -> DataFrame:
    """The first level over leaves ``(tree, n, lo, digest, payload)``: nodes ``(tree, n, lo, hi,
    children, digest, members)``, ``members`` being their leaves. A lone leaf is its own node."""
    members = F.sort_array(F.collect_list(F.struct("lo", "digest", "payload")))
    return saved(
        leaves.groupBy("tree", "n", F.expr(f"lo div {ARITY}").alias("bucket"))
        .agg(F.min("lo").alias("lo"), F.max("lo").alias("hi"), members.alias("members"))
        .withColumn("children", _joined(F.col("members")))
        .withColumn("digest", F.when(F.col("n") == 1, F.col("children")).otherwise(F.sha2("children", 256)))
        .drop("bucket")
    )


def _levels(runs: DataFrame) -> list[DataFrame]:
    """Nodes ``(tree, n, lo, hi, children, digest)`` of each level, the first one first. A level
    has those trees that had several nodes in the one before."""
    largest = runs.agg(F.max("n")).first()[0] or 0
    levels, covers = [runs], ARITY
    while covers < largest:
        below, covers = levels[-1].where(F.col("n") > covers), covers * ARITY
        nodes = F.sort_array(F.collect_list(F.struct("lo", "digest")))
        levels.append(
            below.groupBy("tree", "n", F.expr(f"lo div {covers}").alias("bucket"))
            .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), _joined(nodes).alias("children"))
            .withColumn("digest", F.sha2("children", 256))
            .drop("bucket")
        )
    return levels


def _is_top() -> Column:
    return (F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1)


def _step(children: str, own: str, first: str, covers: int) -> Column:
    """Siblings of a child that begins at rank ``own`` of a parent that begins at ``first``:
    what the parent's interval holds before and after the child's, at a digest for each
    ``covers`` ranks (the last may cover fewer)."""
    left = ((F.col(own) - F.col(first)) / covers).cast("int") * WIDTH
    return F.struct(
        F.substring(F.col(children), F.lit(1), left).alias("before"),
        F.substring(F.col(children), left + WIDTH + 1, F.lit(ARITY * WIDTH)).alias("after"),
    )


def _attach(levels: list[DataFrame], seeds: DataFrame) -> DataFrame:
    """The nodes of the first level with ``path``, the siblings of the node and of its ancestors
    up to the top, continued by the path that ``seeds`` ``(tree, path, above)`` give for
    the tree; ``above`` is handed down as it is."""
    parents = None
    for depth in range(len(levels), 0, -1):
        nodes, covers = levels[depth - 1], ARITY**depth
        tops = nodes.where(_is_top()).join(seeds, "tree")
        if parents is not None:
            held = parents.select(
                "tree",
                F.expr(f"lo div {covers * ARITY}").alias("bucket"),
                F.col("lo").alias("p_lo"),
                F.col("hi").alias("p_hi"),
                F.col("children").alias("p_children"),
                F.col("path").alias("p_path"),
                "above",
            )
            step = _step("p_children", "lo", "p_lo", covers)
            inner = (
                nodes.where(~_is_top())
                .withColumn("bucket", F.expr(f"lo div {covers * ARITY}"))
                .join(held, ["tree", "bucket"])
                .where("lo >= p_lo AND hi <= p_hi")
                .withColumn("path", F.concat(F.array(step), "p_path"))
            )
            tops = tops.unionByName(inner.select(tops.columns))
        parents = tops
    return parents


def _tops(levels: list[DataFrame]) -> DataFrame:
    """``(tree, digest)`` of the top node of each tree."""
    return reduce(DataFrame.union, (x.where(_is_top()).select("tree", "digest") for x in levels))


def _leaves(first: DataFrame) -> DataFrame:
    """Leaves ``(payload, digest, path, above)`` of nodes of the first level with their paths."""
    out = first.select("n", "lo", "children", "path", "above", F.explode("members").alias("leaf"))
    out = out.withColumn("own", F.col("leaf.lo"))
    step = F.when(F.col("n") > 1, F.array(_step("children", "own", "lo", 1)))
    path = F.coalesce(F.concat(step, "path"), "path")
    return out.select("leaf.payload", "leaf.digest", path.alias("path"), "above")


_NO_PATH = "CAST(array() AS array<struct<before:string,after:string>>)"


def manifest(
    rows: DataFrame, id_col: str = "doc_id", group_col: str = "source", leaf_col: str = "leaf"
) -> DataFrame:
    """All columns of ``rows`` with ``subroot``, the root of the row's group, ``root``, that of
    the dataset, and ``path``, the siblings ``(before, after)`` on the way from the leaf to
    the root, which ``fold`` and ``siblings_digest`` take.

    ``leaf_col`` holds a digest per row. In a group leaves ascend by id (nulls first, equal ids by
    digest); while several nodes remain, each ``ARITY`` consecutive ones, or what the last run
    has, become the SHA-256 of their digests. Groups ascend bytewise, null first, and their
    roots are the leaves of a like tree. A lone leaf is its own root, with an empty path.

    Repeated rows are leaves of their own, each with its path. Any further columns are kept,
    whatever their names, but for those of the result. No rows give no rows.
    """
    own = rows.select(
        _key(F.col(group_col)).alias("key"),
        F.col(id_col).alias("id"),
        F.col(leaf_col).alias("digest"),
        F.struct(*rows.columns).alias("payload"),
    )
    # texts are hashed once: sorting reads what is saved
    levels = _levels(_runs(_ranked(saved(own), ["id", "digest"])))
    groups = _tops(levels).select(
        F.lit("").alias("key"), F.col("tree").alias("id"), "digest", F.struct("tree").alias("payload")
    )
    upper = _levels(_runs(_ranked(groups, ["id"])))
    top = _tops(upper).select(
        "tree", F.expr(_NO_PATH).alias("path"), F.struct(F.col("digest").alias("root")).alias("above")
    )
    above = _leaves(_attach(upper, top)).select(
        "payload.tree", "path", F.struct(F.col("digest").alias("subroot"), "above.root").alias("above")
    )
    return _leaves(_attach(levels, above)).select("payload.*", "above.subroot", "above.root", "path")


def fold(path: str, leaf: str) -> Column:
    """The root that a leaf and the siblings of a path give."""
    return F.aggregate(
        path, F.col(leaf), lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256)
    )


def siblings_digest(path: str) -> Column:
    """SHA-256 of all digests of a path, from the leaf to the root, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)
