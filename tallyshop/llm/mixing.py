"""Mixing overlapping sources to target weights by a min-cost flow.

Documents that belong to the same set of sources are alike to the mix, so only token sums
per membership pattern enter the flow: pattern to source to sink, with each source's target
as capacity and convex costs per repetition (the first use of a token costs nothing, the
second one unit, and so on). The flow says how many tokens of each pattern are used once,
twice, ...; seeded documents fill these numbers.

The flow runs over patterns, never over documents; ``MAX_PATTERNS`` bounds it, and more
patterns raise an error. Documents are picked by a seeded order whose sums are taken over
buckets of the order, so neither a hot source nor the whole table is gathered in one task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyshop.llm.storage import saved

MAX_PATTERNS = 100_000
#: Quotas are broadcast up to this size, by their names' lengths.
QUOTA_BYTES = 32 << 20
WORDS = r"[^\x20\x09-\x0D]+"
BUCKET_BITS = 10
LEVELS = 3


def fill_targets(sizes: dict, weights: dict, total: float, most: float) -> dict:
    """Share ``total`` by ``weights``; a share stops at ``most`` times its size, and the excess
    is shared anew by weight among the others until none is above."""
    targets, open_, left = {}, [s for s in sizes if weights[s] > 0], float(total)
    while open_:
        weight = sum(weights[s] for s in open_)
        share = {s: left * weights[s] / weight for s in open_}
        full = [s for s in open_ if share[s] > most * sizes[s]]
        if not full:
            targets |= share
            break
        for s in full:
            targets[s] = float(most * sizes[s])
            left -= targets[s]
        open_ = [s for s in open_ if s not in targets]
    return {s: targets.get(s, 0.0) for s in sizes}


def min_cost_flow(tokens: dict, targets: dict, repeats: int) -> dict:
    """Tokens each pattern (a tuple of sources) gives to each of its sources.

    Every unit of a pattern can be used ``repeats`` times, the i-th time at cost i - 1; targets
    are met as far as possible at least cost. Successive cheapest augmenting paths between
    the patterns; patterns of a single source take no part in re-routing, so the network that
    is searched holds the overlapping ones only.
    """
    flow: dict = {}
    need = dict(targets)
    used = dict.fromkeys(tokens, 0.0)
    by_source: dict = {}
    for p in tokens:
        for s in p:
            by_source.setdefault(s, []).append(p)

    def path(level: int):
        """A shortest chain of moves from a pattern with free tokens of a cost up to ``level``
        to a source with need."""
        start = [p for p in tokens if len(p) and tokens[p] * (level + 1) - used[p] > 1e-9]
        queue, came = [(0, i, ("p", p)) for i, p in enumerate(start)], {("p", p): None for p in start}
        heapq.heapify(queue)
        order = len(queue)
        while queue:
            d, _, (kind, x) = heapq.heappop(queue)
            if kind == "s" and need[x] > 1e-9:
                chain = [(kind, x)]
                while came[chain[-1]] is not None:
                    chain.append(came[chain[-1]])
                return chain[::-1]
            if kind == "p":
                nexts = [("s", s) for s in x]
            else:
                nexts = [("p", p) for p in by_source[x] if flow.get((p, x), 0.0) > 1e-9]
            for n in nexts:
                if n not in came:
                    came[n] = (kind, x)
                    order += 1
                    heapq.heappush(queue, (d + 1, order, n))
        return None

    for level in range(repeats):
        for p in tokens:  # what needs no re-routing
            for s in p:
                x = min(tokens[p] * (level + 1) - used[p], need[s])
                if len(p) == 1 and x > 0:
                    flow[p, s] = flow.get((p, s), 0.0) + x
                    used[p] += x
                    need[s] -= x
        while chain := path(level):
            pattern, source = chain[0][1], chain[-1][1]
            amount = min(tokens[pattern] * (level + 1) - used[pattern], need[source])
            for (kind, a), (_, b) in zip(chain[1:], chain[2:], strict=False):
                if kind == "s":
                    amount = min(amount, flow[b, a])
            for (kind, a), (_, b) in zip(chain, chain[1:], strict=False):
                key, sign = ((a, b), 1) if kind == "p" else ((b, a), -1)
                flow[key] = flow.get(key, 0.0) + sign * amount
            used[pattern] += amount
            need[source] -= amount
    return {k: v for k, v in flow.items() if v > 0}


def _bucket(level: int, seed: int, id_col: str) -> Column:
    """Ten bits of the seeded order, the highest first."""
    order = F.xxhash64(F.lit(seed), F.col(id_col))
    return F.shiftrightunsigned(order, 64 - BUCKET_BITS * (level + 1)).bitwiseAND(2**BUCKET_BITS - 1)


def _select(sized: DataFrame, quota: DataFrame, id_col: str, seed: int) -> DataFrame:
    """``(pattern, id, size, taken)``: in the seeded order, documents are used once more than
    ``base`` times until ``extra`` words are reached, ``base`` times after that.

    ``quota`` has one row per pattern. Level by level, sums over at most 1024 buckets of each
    pattern find the bucket in which ``extra`` is reached; only its documents go on, and a
    window sees those of the last level's bucket: about one in 2**30 documents of a pattern.
    """
    done = None
    rest = sized.join(quota.withColumnsRenamed({"extra": "left"}), "pattern")
    for level in range(LEVELS):
        rest = rest.withColumn("bucket", _bucket(level, seed, id_col))
        sums = rest.groupBy("pattern", "bucket").agg(F.sum("size").alias("words"), F.first("left").alias("left"))
        upto = Window.partitionBy("pattern").orderBy("bucket")
        ends = sums.withColumn("end", F.sum("words").over(upto)).select(
            "pattern", "bucket", (F.col("end") - F.col("words")).alias("begin"), "end"
        )
        # dealt by both keys: the window's partitioning alone would send a pattern to one task
        placed = rest.join(ends.repartition("pattern", "bucket"), ["pattern", "bucket"])
        inside = (F.col("begin") < F.col("left")) & (F.col("end") > F.col("left"))
        settled = placed.where(~inside).select(
            "pattern", id_col, "size",
            (F.col("size") * (F.col("base") + (F.col("end") <= F.col("left")).cast("int"))).alias("taken"),
        )
        done = settled if done is None else done.union(settled)
        rest = placed.where(inside).withColumn("left", F.col("left") - F.col("begin")).drop("bucket", "begin", "end")
        rest = saved(rest) if level == 0 else rest
    order = Window.partitionBy("pattern").orderBy(F.xxhash64(F.lit(seed), F.col(id_col)), id_col)
    end = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # the document in which the quota ends is taken when the nearer end is behind it
    last = rest.withColumn("end", end).select(
        "pattern", id_col, "size",
        (F.col("size") * (F.col("base") + (F.col("end") - F.col("size") / 2 <= F.col("left")).cast("int"))).alias("taken"),
    )
    return done.union(last)


def mix(
    docs: DataFrame,
    sources: Column,
    weights: dict | Iterable[float],
    id_col: str = "doc_id",
    text_col: str = "text",
    total_share: float = 1.5,
    repeats: int = 2,
    seed: int = 17,
) -> DataFrame:
    """``(id, size, pattern, pattern_size, pattern_target, taken)`` for every document.

    ``sources`` is an array of the sources a document belongs to (a null source is a source of
    its own). ``weights`` maps sources to weights; a sequence is dealt to the sources in code
    point order, null last, and repeats. Targets share ``total_share`` of all sizes by weight
    and stop at ``repeats`` times a source's size. ``size`` counts the words of the whole text
    (null: 0), ``taken`` the words the mix uses, repeats counted: whole documents only, 0 to
    ``repeats`` times each, within half a document of what the flow gives the pattern. The
    same rows and seed give the same mix.

    An empty array gives a document to no source and takes nothing; empty tables and tables
    without words take nothing; ids are unique; other columns are not read.
    """
    sized = saved(
        docs.select(
            F.col(id_col).cast("long").alias(id_col),
            F.array_sort(F.array_distinct(sources.cast("array<string>"))).alias("pattern"),
            F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
        )
    )
    rows = sized.groupBy("pattern").agg(F.sum("size").alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    tokens = {tuple(r.pattern): r.n for r in rows}
    sizes: dict = {}
    for pattern, n in tokens.items():
        for s in pattern:
            sizes[s] = sizes.get(s, 0) + n
    ordered = sorted(sizes, key=lambda s: (s is None, s or ""))
    if not isinstance(weights, dict):
        dealt = list(weights)
        weights = {s: dealt[i % len(dealt)] for i, s in enumerate(ordered)}
    targets = fill_targets({s: sizes[s] for s in ordered}, weights, total_share * sum(tokens.values()), repeats)
    flow = min_cost_flow(tokens, targets, repeats)
    given = dict.fromkeys(tokens, 0.0)
    for (p, _), x in flow.items():
        given[p] += x
    spark = docs.sparkSession
    quota = spark.createDataFrame(
        [
            (list(p), int(given[p] // n) if n else 0, float(given[p] - (given[p] // n) * n) if n else 0.0,
             int(n), float(sum(targets[s] for s in p)))
            for p, n in tokens.items()
        ],
        "pattern array<string>, base int, extra double, pattern_size long, pattern_target double",
    )
    # at most MAX_PATTERNS rows, counted above: sent to all tasks while their names are not too
    # long, so that no task gets all documents of a pattern
    if sum(64 + sum(len(s or "") for s in p) for p in tokens) <= QUOTA_BYTES:
        quota = F.broadcast(quota)
    picked = _select(sized, quota.select("pattern", "base", "extra"), id_col, seed)
    return picked.join(quota.select("pattern", "pattern_size", "pattern_target"), "pattern").select(
        id_col, "size", "pattern", "pattern_size", "pattern_target", F.col("taken").cast("long").alias("taken")
    )
