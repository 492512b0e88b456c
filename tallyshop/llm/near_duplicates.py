"""Near-duplicate documents by bottom-k sketches of their shingle sets.

One hash function orders all shingles; a document's sketch is its ``k`` smallest hashes.

1. Documents with equal sets form a class (128-bit sum over the set, and its size); only one
   representative per class goes on, so thousands of copies cost one row.
2. Inverted lists: a value held by two or more sketches lists their representatives. Two
   sets of similarity ``t`` share at least ``shared_at_least`` values of their joint sketch
   (but for a chance below ``MISS``), so of each sketch only the rarest ``size - shared + 1``
   values need a list: a passage that thousands of documents share drops out by itself
   wherever a document has rarer values. Of lists with the same members one is kept.
3. Each representative meets the first of each of its lists, then, where a list still spans
   several components, a seeded one: a list of ``n`` similar texts costs ``n`` pairs.
   Representatives of lists that span several components even then get lists of their full
   sets in the same way, of values that span components, which leaves only those that share
   ``percent`` of their shingles with other components. There all members of different
   components are compared by size and bitmap, in cells of at most two blocks of a list.
4. The joint-sketch estimate filters the pairs, the full sets decide them. The sets are made
   again from the texts; a bitmap of the wanted ids, of fixed size, spares the other texts
   the shuffle (were it full, all sets would be shuffled, and the join decide).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyshop.llm import words as W
from tallyshop.llm.graph import components
from tallyshop.llm.keys import FIRST_MADE, keyed
from tallyshop.llm.storage import fitted, saved, saved_small

MISS = 1e-6


def shared_at_least(k: int, percent: int) -> int:
    """Values that a joint sketch of ``k`` shares at similarity ``percent``, but for a chance
    of ``MISS`` (drawing without replacement strays less than the binomial used here)."""
    p, tail = percent / 100, 0.0
    for c in range(k + 1):
        tail += math.comb(k, c) * p**c * (1 - p) ** (k - c)
        if tail > MISS:
            return c
    return k


def shingle_sets(data, offsets, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct 63-bit shingle hashes of each text of a slice."""
    found = W.find_words(data, offsets, W.LOWER)
    hashes = found.hashes(W.LOWER)
    whole = W.grams(hashes, n)
    for a, b in zip(found.first[:-1], found.first[1:], strict=True):
        if b - a >= n:
            values = whole[a : b - n + 1]
        elif b > a:
            values = W.mix(W.grams(hashes[a:b], int(b - a)), int(b - a))
        else:
            values = whole[:0]
        yield np.unique(values >> np.uint64(1))


SIGNATURE = 8
_BITS = [f"s{i}" for i in range(SIGNATURE)] + ["loose"]
WHOLE_SIGNATURE = 32
_WHOLE_BITS = [f"f{i}" for i in range(WHOLE_SIGNATURE)] + ["over"]
_SKETCH_NAMES = ["id", "own", "n_shingles", "sum1", "sum2", "sketch", *_BITS]


def _signatures(values: np.ndarray, held: np.ndarray, longs: int) -> list[np.ndarray]:
    """Sets as bitmaps of ``longs`` longs, and how many values share a bit: two sets share at
    most their common bits and the smaller of those numbers."""
    bit = (values % (64 * longs)).astype(np.uint64)
    out = np.zeros((len(held), longs), np.uint64)
    row = np.repeat(np.arange(len(held)), held)
    np.bitwise_or.at(out, (row, bit >> np.uint64(6)), np.uint64(1) << (bit & np.uint64(63)))
    return [*out.view(np.int64).T, held - np.bitwise_count(out).sum(1, dtype=np.int64)]


def _sketch(n: int, k: int):
    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in W.slices(batch.column("text")):
                sizes, sums, bottom = [], ([], []), []
                for s in shingle_sets(data, offsets, n):
                    sizes.append(len(s))
                    for i in (0, 1):
                        sums[i].append(W.mix(s, i + 1).sum(dtype=np.uint64))
                    bottom.append(s[:k])
                held = np.array([len(b) for b in bottom])
                values = np.concatenate(bottom).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(lo, hi - lo),
                        batch.column("own").slice(lo, hi - lo),
                        pa.array(sizes, pa.int64()),
                        *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in sums),
                        W.list_array(pa.array(values), held),
                        *map(pa.array, _signatures(values, held, SIGNATURE)),
                    ],
                    _SKETCH_NAMES,
                )

    return run


BITMAP_BITS = 25


def _bit(id_col: str = "id") -> Column:
    return F.xxhash64(id_col).bitwiseAND(2**BITMAP_BITS - 1)


def _bitmap(ids: DataFrame) -> np.ndarray:
    """The ids as a bitmap of 2 ** ``BITMAP_BITS`` bits (4 MB, however many ids there are)."""
    place, bit = F.shiftright("bit", 6), F.expr("shiftleft(1L, int(bit & 63))")
    rows = ids.select(_bit().alias("bit")).groupBy(place.alias("place")).agg(F.bit_or(bit).alias("bits"))
    found = rows.toPandas()
    out = np.zeros(2 ** (BITMAP_BITS - 6), np.int64)
    out[found["place"]] = found["bits"]
    return out


def _sets(n: int, wanted):
    """Shingle sets of the texts whose ids may be among the wanted ones."""

    def run(batches):
        bitmap = wanted.value
        for batch in batches:
            bit = batch.column("bit").to_numpy(zero_copy_only=False)
            some = bitmap[bit >> 6] >> (bit & 63) & 1
            batch = batch.filter(pa.array(some.astype(bool)))
            for lo, hi, data, offsets in W.slices(batch.column("text")):
                sets = list(shingle_sets(data, offsets, n))
                values = np.concatenate(sets).astype(np.int64)
                held = np.array([len(s) for s in sets])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(lo, hi - lo),
                        W.list_array(pa.array(values), held),
                        *map(pa.array, _signatures(values, held, WHOLE_SIGNATURE)),
                    ],
                    ["id", "shingles", *_WHOLE_BITS],
                )

    return run


def _possible(k: int, percent: int) -> Column:
    """Whether sizes and bitmaps of two sketches allow the similarity."""
    bits = sum(F.bit_count(F.col(f"{c}_a").bitwiseAND(F.col(f"{c}_b"))) for c in _BITS[:-1])
    sizes = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    least = F.when(F.greatest("n_a", "n_b") <= k, percent * F.greatest("n_a", "n_b") / 100)
    return sizes & (bits + F.least("loose_a", "loose_b") >= least.otherwise(shared_at_least(k, percent)))


#: Members of a list in one block, on average.
BLOCK = 1024
_STRIP = 1 << 15
_CELL = ["v", "i", "j"]


def _cells(members: DataFrame, rows: int) -> DataFrame:
    """Lists in blocks, and a cell ``(v, i, j)`` with the members of both blocks for each pair of
    blocks; ``low`` marks those of block ``i``."""
    members = saved(fitted(members, rows))
    blocks = members.groupBy("v").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    block, other = F.col("block"), F.col("other")
    return (
        members.join(fitted(blocks, rows), "v")
        .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "v", F.least(block, other).alias("i"), F.greatest(block, other).alias("j"),
            (block <= other).alias("low"), "id", "c", "n", *_WHOLE_BITS,
        )
    )


def _compare(percent: int):
    """Pairs of members of a cell, of different components, whose sizes and bitmaps allow the
    similarity: ``n`` shared of ``n_a + n_b - n`` are enough. Cells come sorted."""

    def pairs(cell: pa.RecordBatch):
        col = {name: cell.column(name).to_numpy(zero_copy_only=False) for name in ("id", "c", "n", "over")}
        bits = np.stack([cell.column(f).to_numpy() for f in _WHOLE_BITS[:-1]], axis=1).view(np.uint64)
        low = cell.column("low").to_numpy(zero_copy_only=False)
        within = cell.column("i")[0] == cell.column("j")[0]
        x, y = np.flatnonzero(low), np.arange(len(low)) if within else np.flatnonzero(~low)
        if len(y) == 0:
            return
        step = max(1, _STRIP // len(y))
        for a in range(0, len(x), step):
            some = x[a : a + step, None]
            n, m = col["n"][some], col["n"][y]
            fit = (col["c"][some] != col["c"][y]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
            if within:
                fit &= some < y
            p, q = np.nonzero(fit)
            p, q = some[p, 0], y[q]
            shared = np.bitwise_count(bits[p] & bits[q]).sum(1, dtype=np.int64) + np.minimum(col["over"][p], col["over"][q])
            near = (100 + percent) * shared >= percent * (col["n"][p] + col["n"][q])
            one, two = col["id"][p[near]], col["id"][q[near]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two))], ["a", "b"]
            )

    def run(batches):
        rest = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if rest is not None:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            new = np.zeros(batch.num_rows - 1, bool)
            for name in _CELL:
                value = batch.column(name).to_numpy()
                new |= value[1:] != value[:-1]
            begin = [0, *(np.flatnonzero(new) + 1).tolist()]
            for a, b in zip(begin[:-1], begin[1:], strict=True):
                yield from pairs(batch.slice(a, b - a))
            rest = batch.slice(begin[-1])
        if rest is not None:
            yield from pairs(rest)

    return run


def _alike(pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs whose joint sketch allows the similarity; sketches that hold whole sets give no
    estimate but the similarity itself."""
    joint = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, k)
    within = F.size(F.array_intersect(F.array_intersect("sketch_a", "sketch_b"), joint))
    whole = F.greatest("n_a", "n_b") <= k
    total = F.col("n_a") + F.col("n_b") - F.col("shared")
    counted = pairs.withColumn(
        "shared", F.when(whole, F.size(F.array_intersect("sketch_a", "sketch_b"))).otherwise(within)
    )
    enough = F.when(whole, 100 * F.col("shared") >= percent * total)
    return counted.where(enough.otherwise(F.col("shared") >= shared_at_least(k, percent)))


def _named_columns(name: str, columns: list[str]) -> list[Column]:
    return [F.col(x).alias(y) for x, y in (("id", name), *((c, f"{c}_{name}") for c in ("n", *columns)))]


def _lists(held: DataFrame, sizes: DataFrame) -> tuple[DataFrame, int]:
    """Inverted lists ``(v, id)`` of two members at least, and their rows, in which any two sets of different
    components ``c`` meet that share the ``needed`` number of values: the rarest ``size - needed
    + 1`` values of each set, among which those of one component alone come first and need no
    list."""
    spread = F.count("*").alias("df"), F.min("c").alias("x"), F.max("c").alias("y")
    often = held.groupBy("v").agg(*spread).where("x < y").select("v", "df")
    rarest = (
        held.join(often, "v")
        .groupBy("id")
        .agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("shared"))
        .join(sizes, "id")
        .withColumn("take", F.expr("size(shared) - needed + 1"))
        .where("take > 0")
        .select("id", F.explode(F.expr("slice(shared, 1, take)")).alias("x"))
        .select("id", F.col("x.v").alias("v"))
    )
    rarest, rows = saved_small(rarest)
    # lists with the same members give the same pairs, so one of them is enough
    members = rarest.groupBy("v").agg(
        F.count("*").alias("n"), *(F.bit_xor(F.xxhash64(F.lit(i), "id")).alias(f"x{i}") for i in (1, 2))
    )
    kept = fitted(members.where("n > 1"), rows).groupBy("n", "x1", "x2").agg(F.min("v").alias("v"))
    return saved_small(fitted(rarest.join(fitted(kept.select("v"), rows), "v", "left_semi"), rows))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 5,
    percent: int = 80,
    sketch_size: int = 64,
) -> DataFrame:
    """``(id, n_shingles, component_id, kept)`` for every document.

    Documents are linked when ``100 * |A & B| >= percent * |A | B|`` over their sets of
    distinct shingles (words cut at ASCII space, A-Z lower-cased); ``component_id`` is the
    smallest id reachable over links, ``kept`` marks that one.

    A text with fewer words than a shingle is one shingle; an empty or null text has none and
    is linked with nothing. Rows equal in id and text are one document and give one row.
    Different texts under one id are documents of their own. So is each text with a null id:
    it is no smallest id unless its component has no other (then ``component_id`` is null and
    the document with the smallest key is kept). Other columns are not read, so names do not
    clash. An empty table gives no rows.
    """
    k, sure = sketch_size, shared_at_least(sketch_size, percent)
    plain = docs.select(F.col(id_col).cast("long").alias("own"), F.col(text_col).cast("string").alias("text"))
    texts, _ = keyed(plain, "own", ["text"], "id")
    sketched = saved(
        texts.mapInArrow(
            _sketch(shingle_words, k),
            "id long, own long, n_shingles long, sum1 long, sum2 long, sketch array<long>, "
            + ", ".join(f"{c} long" for c in _BITS),
        )
    )
    key = ["n_shingles", "sum1", "sum2"]
    # sets of equal sums are equal, so any sketch of a class is that of all
    classes = saved(
        sketched.where("n_shingles > 0").groupBy(*key)
        .agg(F.min("id").alias("id"), *(F.first(c).alias(c) for c in ("sketch", *_BITS)))
    )
    all_reps = classes.withColumnRenamed("n_shingles", "n")

    size = F.size("sketch")
    needed = F.when(
        F.col("n") * 100 <= k * percent, F.ceil(F.col("n") * percent / 100).cast("int")
    ).otherwise(F.least(F.lit(sure), size))
    lists, listed = _lists(
        all_reps.select("id", F.col("id").alias("c"), F.explode("sketch").alias("v")),
        all_reps.select("id", size.alias("size"), needed.alias("needed")),
    )
    ids = fitted(lists.select("id").distinct(), listed)
    reps, open_reps = saved_small(all_reps.join(ids, "id", "left_semi").select("id", "n", "sketch", *_BITS))

    def confirmed(pairs: DataFrame, rows: int) -> DataFrame:
        """Of at most ``rows`` pairs ``(a, b)``, those whose full sets are similar enough."""
        one = fitted(fitted(pairs, rows).join(reps.select(*_named_columns("a", ["sketch", *_BITS])), "a"), rows)
        both = one.join(reps.select(*_named_columns("b", ["sketch", *_BITS])), "b")
        close = _alike(both.where(_possible(k, percent)), k, percent)
        return exact(*saved_small(fitted(close.select("a", "b", "n_a", "n_b"), rows)))

    def full_sets(ids: DataFrame) -> DataFrame:
        wanted = docs.sparkSession.sparkContext.broadcast(_bitmap(ids))
        return (
            texts.withColumn("bit", _bit()).mapInArrow(
                _sets(shingle_words, wanted),
                "id long, shingles array<long>, " + ", ".join(f"{c} long" for c in _WHOLE_BITS),
            )
            .join(ids, "id", "left_semi").dropDuplicates(["id"])
        )

    def exact(close: DataFrame, rows: int) -> DataFrame:
        involved = close.select(F.col("a").alias("id")).union(close.select(F.col("b").alias("id")))
        sets = full_sets(fitted(involved.distinct(), 2 * rows)).select("id", "shingles")
        both = F.size(F.array_intersect("shingles_a", "shingles_b"))
        one = close.join(sets.toDF("a", "shingles_a"), "a")
        return saved(
            fitted(one, rows).join(sets.toDF("b", "shingles_b"), "b")
            .where(100 * both >= percent * (F.col("n_a") + F.col("n_b") - both))
            .select("a", "b")
        )

    def labelled(of: DataFrame) -> DataFrame:
        return fitted(lists.join(of, "id", "left"), listed).select(
            "v", "id", F.coalesce("component", "id").alias("c")
        )

    def open_lists(marked: DataFrame, rows: int) -> tuple[DataFrame, int]:
        """Lists that span several components, saved. What is known of a list gets a shuffle of its
        own, so that adaptive execution can split the members of a large one."""
        torn = marked.groupBy("v").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x < y")
        return saved_small(fitted(marked.join(fitted(torn.select("v"), rows), "v", "left_semi"), rows))

    def with_leader(marked: DataFrame, leader: Column, rows: int) -> DataFrame:
        head = marked.groupBy("v").agg(leader.alias("head")).select("v", "head.id", "head.c").toDF("v", "b", "cb")
        met = fitted(marked.join(fitted(head, rows), "v"), rows)
        return (
            met.where("id <> b AND c <> cb")
            .select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b"))
            .distinct()
        )

    first = with_leader(lists.withColumn("c", F.col("id")), F.min(F.struct("id", "c")), listed)
    of = components(confirmed(first, listed))
    left, torn = open_lists(labelled(of), listed)
    if torn:
        seeded = F.min_by(F.struct("id", "c"), F.xxhash64("v", "id"))
        # components hang on their smallest id, so what joins them later starts from stars
        of = components(_tied(of).union(confirmed(with_leader(left, seeded, torn), torn)))
        placed, torn = open_lists(labelled(of), listed)
    if torn:
        placed = saved(fitted(placed.select("id", "c"), torn).distinct())
        open_ids = placed.select("id")
        sizes = F.col("n").alias("size"), F.ceil(F.col("n") * percent / 100).cast("int").alias("needed")
        sets = saved(full_sets(open_ids))
        whole, rows = _lists(
            sets.join(placed, "id").select("id", "c", F.explode("shingles").alias("v")),
            reps.join(open_ids, "id", "left_semi").select("id", *sizes),
        )
        left, rows = open_lists(fitted(whole.join(placed, "id"), rows), rows)
        left = left.join(reps.select("id", "n"), "id").join(sets.select("id", *_WHOLE_BITS), "id")
        rest = (
            _cells(left, rows).repartition(*_CELL).sortWithinPartitions(*_CELL)
            .mapInArrow(_compare(percent), "a long, b long").distinct()
        )
        rest, pairs = saved_small(rest)
        of = components(_tied(of).union(confirmed(rest, pairs)))

    # classes are named by their smallest key, so a component's smallest class is its smallest key
    counts = sketched.agg(F.count("*").alias("n"), F.max("id").alias("last")).first()
    named = classes.select(*key, "id").join(of, "id", "left").select(
        *key, F.coalesce("component", "id").alias("c")
    )
    once = sketched.select("id", "own", *key).dropDuplicates(["id"])
    out = once.join(fitted(named, counts.n), key, "left").withColumn("c", F.coalesce("c", "id"))
    if counts.n and counts.last >= FIRST_MADE:
        smallest = out.groupBy("c").agg(F.min("own").alias("component_id"))
        out = out.join(fitted(smallest, counts.n), "c")
    else:
        out = out.withColumn("component_id", F.col("c"))
    return out.select(
        F.col("own").alias(id_col),
        "n_shingles",
        "component_id",
        F.coalesce(F.col("own") == F.col("component_id"), F.col("id") == F.col("c")).alias("kept"),
    )


def _tied(of: DataFrame) -> DataFrame:
    return of.select(F.col("id").alias("a"), F.col("component").alias("b"))
