"""Documents whose n-gram sets are similar, joined exactly through tries of ordered sets.

All n-grams have one order: rarest first, by the counts of ``2 ** TABLE_BITS`` buckets of hashes
over the whole corpus (the counts steer work only, any order gives the same result). Two sets
of similarity ``t`` share one of the first ``n - ceil(t * n) + 1`` n-grams of each, so these are
listed, and sets that no list holds together need no comparison.

1. Documents with equal sets form a class; only one set per class goes on.
2. In each list, pairs whose sizes and bitmaps (a bit per n-gram, of the whole set) leave the
   similarity possible are tied together. Bitmaps bound the overlap from above, so no link is
   lost; sets that merely share a passage come apart here.
3. What hangs together forms a cluster, to which each set is sent once. There the sets are stored
   in a trie, ordered by their frequency in the cluster, frequent first, so that what many
   sets share is one path. A walk of the trie keeps the overlap of its path with all sets at once:
   sets below a node share the partial overlap, and a subtree is left where not even all that
   remains below it makes a similar pair of different components.
4. Components of the links found give the result.

Lists and clusters of any size are dealt into chunks of bounded size, by another seed in each of
``DEALS`` rounds; after a round only those go on that still hold several components, and
at last every pair of their chunks is compared. Copies of a text by the million thus cost rounds,
not pairs, while a large cluster of different texts that are nearly, but not quite, similar costs the
square of its chunks: that is the price of an exact join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyshop.llm import words as W
from tallyshop.llm.graph import components
from tallyshop.llm.keys import keyed
from tallyshop.llm.near_duplicates import shingle_sets
from tallyshop.llm.storage import saved

#: Buckets of the table of counts that orders the n-grams: 4 MB, whatever the corpus.
TABLE_BITS = 20
_BLOCK = 4096
#: Sets, and values of their sets or bitmaps, in one chunk of a list or cluster.
CHUNK_SETS = 4096
CHUNK_VALUES = 1 << 21
DEALS = 3
#: Bits of the filter of wanted sets, per wanted set and at most.
FILTER_BITS, MOST_FILTER_BITS = 16, 1 << 28

_CELL = ["g", "i", "j"]


def needed(size, percent: int):
    """The least overlap of a set of ``size`` with any set that is similar enough."""
    return (percent * size + 99) // 100


def _bucket(values: np.ndarray) -> np.ndarray:
    return (values & np.uint64(2**TABLE_BITS - 1)).astype(np.int64)


def _count(n_words: int):
    def run(batches):
        table = np.zeros(2**TABLE_BITS, np.int64)
        for batch in batches:
            for _, _, data, offsets in W.slices(batch.column("text")):
                values = np.concatenate(list(shingle_sets(data, offsets, n_words)))
                at, times = np.unique(_bucket(values), return_counts=True)
                table[at] += times
        blocks = table.reshape(-1, _BLOCK)
        some = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), pa.array([blocks[b].tobytes() for b in some], pa.binary())], ["block", "counts"]
        )

    return run


def _add_up(batches):
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts"), strict=True):
            new = np.frombuffer(counts.as_buffer(), np.int64)
            sums[block] = sums[block] + new if block in sums else new
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())],
        ["block", "counts"],
    )


def bucket_counts(texts: DataFrame, n_words: int) -> np.ndarray:
    """Documents per bucket of n-gram hashes, over all documents."""
    schema = "block long, counts binary"
    added = texts.select("text").mapInArrow(_count(n_words), schema).repartition("block")
    table = np.zeros((2**TABLE_BITS // _BLOCK, _BLOCK), np.int64)
    for row in added.mapInArrow(_add_up, schema).collect():
        table[row["block"]] = np.frombuffer(row["counts"], np.int64)
    return table.ravel()


def bitmap(values: np.ndarray) -> np.ndarray:
    """A set as a bitmap of one to two bits per value, in words of 64 bits; their number is a
    power of two, so a bitmap can be folded to half its size."""
    longs = 1 << max(0, int(len(values) - 1).bit_length() - 6)
    bit = values & np.uint64(64 * longs - 1)
    out = np.zeros(longs, np.uint64)
    np.bitwise_or.at(out, bit >> np.uint64(6), np.uint64(1) << (bit & np.uint64(63)))
    return out


def _described(n_words: int, percent: int, table):
    def run(batches):
        counts = table.value
        for batch in batches:
            for lo, hi, data, offsets in W.slices(batch.column("text")):
                sizes, sums, first, maps = [], ([], []), [], []
                for s in shingle_sets(data, offsets, n_words):
                    sizes.append(len(s))
                    for i in (0, 1):
                        sums[i].append(W.mix(s, i + 1).sum(dtype=np.uint64))
                    # values are sorted, so a stable sort breaks ties by value
                    order = np.argsort(counts[_bucket(s)], kind="stable")
                    first.append(s[order[: len(s) - needed(len(s), percent) + 1]] if len(s) else s)
                    maps.append(bitmap(s))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(lo, hi - lo) for c in ("k", "id")),
                        pa.array(sizes, pa.int64()),
                        *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in sums),
                        *(
                            W.list_array(
                                pa.array(np.concatenate(x).view(np.int64)), np.array([len(y) for y in x])
                            )
                            for x in (first, maps)
                        ),
                    ],
                    ["k", "id", "n", "sum1", "sum2", "first", "bits"],
                )

    return run


def _sets(n_words: int, wanted):
    """Sets of the texts that the filter lets through."""

    def run(batches):
        bits = wanted.value
        for batch in batches:
            at = batch.column("at").to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array((bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
            for lo, hi, data, offsets in W.slices(batch.column("text")):
                sets = list(shingle_sets(data, offsets, n_words))
                held = np.array([len(s) for s in sets])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("k").slice(lo, hi - lo),
                        W.list_array(pa.array(np.concatenate(sets).view(np.int64)), held),
                    ],
                    ["k", "items"],
                )

    return run


def _whole_cells(batches) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Sorted rows regrouped into batches of whole cells, with the first row of each cell."""
    rest = None

    def cut(batch):
        new = np.ones(batch.num_rows, bool)
        new[1:] = False
        for name in _CELL:
            value = batch.column(name).to_numpy()
            new[1:] |= value[1:] != value[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if batch.num_rows == 0:
            continue
        if rest is not None:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        begin = cut(batch)
        if begin[-1]:
            yield batch.slice(0, int(begin[-1])), begin[:-1]
        rest = batch.slice(int(begin[-1]))
    if rest is not None:
        yield rest, np.zeros(1, np.int64)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column as unsigned numbers, and where each row begins."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    return values.view(np.uint64), offsets - offsets[0]


def _pairs(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


class _Overlap:
    """Upper bounds of the overlap of sets from bitmaps of different sizes."""

    def __init__(self, column: pa.Array, sizes: np.ndarray):
        values, offsets = _lists(column)
        self.longs, self.sizes = np.diff(offsets), sizes
        self.place, self.whole, self.half = np.zeros(len(sizes), np.int64), {}, {}
        for longs in np.unique(self.longs):
            rows = np.flatnonzero(self.longs == longs)
            self.place[rows] = np.arange(len(rows))
            table = values[offsets[rows][:, None] + np.arange(longs)]
            self.whole[longs] = self._with_rest(table, rows)
            if longs > 1:
                folded = table[:, : longs // 2] | table[:, longs // 2 :]
                self.half[longs // 2] = self._with_rest(folded, rows)

    def _with_rest(self, table, rows):
        return table, self.sizes[rows] - np.bitwise_count(table).sum(1, dtype=np.int64)

    def most(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For rows ``a`` and ``b``; 0 where bitmaps differ by more than one folding, which
        similar sets do not."""
        out = np.zeros(len(a), np.int64)
        la, lb = self.longs[a], self.longs[b]
        for longs in np.unique(np.minimum(la, lb)):
            for x, y, some in (
                (self.whole, self.whole, (la == longs) & (lb == longs)),
                (self.half, self.whole, (la == 2 * longs) & (lb == longs)),
                (self.whole, self.half, (la == longs) & (lb == 2 * longs)),
            ):
                if some.any():
                    (s, rest_s), (t, rest_t) = x[longs], y[longs]
                    p, q = self.place[a[some]], self.place[b[some]]
                    common = np.bitwise_count(s[p] & t[q]).sum(1, dtype=np.int64)
                    out[some] = common + np.minimum(rest_s[p], rest_t[q])
        return out


def _possible(percent: int):
    """Pairs of a cell, enough to tie together all whose sizes and bitmaps allow the similarity."""

    def run(batches):
        for batch, begin in _whole_cells(batches):
            col = {x: batch.column(x).to_numpy(zero_copy_only=False) for x in ("k", "c", "n", "own", "i", "j")}
            overlap = _Overlap(batch.column("bits"), col["n"])
            end = np.repeat(np.append(begin[1:], batch.num_rows), np.diff(np.append(begin, batch.num_rows)))
            names, label = np.unique(col["c"], return_inverse=True)
            root = np.arange(len(names))
            within = col["i"] == col["j"]
            one, two = [], []
            rows, shift = np.arange(batch.num_rows), 0
            while True:
                shift += 1
                rows = rows[rows + shift < end[rows]]
                if len(rows) == 0:
                    break
                a = rows[(label[rows] != label[rows + shift]) & (within[rows] | (col["own"][rows] != col["own"][rows + shift]))]
                b = a + shift
                n, m = col["n"][a], col["n"][b]
                fit = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
                a, b = a[fit], b[fit]
                near = (100 + percent) * overlap.most(a, b) >= percent * (n[fit] + m[fit])
                for x, y in zip(a[near].tolist(), b[near].tolist(), strict=True):
                    p, q = root[label[x]], root[label[y]]
                    if p != q:
                        root[root == q] = p
                        one.append(col["k"][x])
                        two.append(col["k"][y])
                if near.any():
                    label = root[label]
            yield _pairs(one, two)

    return run


class _Trie:
    """Sets as ordered sequences side by side, walked as a trie against other sets."""

    def __init__(self, values: np.ndarray, offsets: np.ndarray, stored: np.ndarray, asked: np.ndarray):
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        _, item = np.unique(values, return_inverse=True)
        held, probed = (np.bincount(item[some[row]], minlength=item.max() + 1) for some in (stored, asked))
        both = bool((stored & asked).any())
        useful = (held > both) & (probed > 0)
        # frequent first: what many sets share becomes one path
        rank = np.empty(len(held), np.int64)
        rank[np.argsort(-(held * useful), kind="stable")] = np.arange(len(held))
        keep = useful[item]
        row, item = row[keep], rank[item[keep]]
        order = np.lexsort((item, row))
        row, item = row[order], item[order]
        bounds = np.searchsorted(row, np.arange(len(offsets)))
        self.probes = np.flatnonzero(asked)
        number = np.full(len(offsets) - 1, -1)
        number[self.probes] = np.arange(len(self.probes))
        self.probe_length = np.diff(bounds)[self.probes]
        # sets that hold each item, as runs of one array
        by_item = np.argsort(item, kind="stable")
        by_item = by_item[number[row[by_item]] >= 0]
        self.holders = number[row[by_item]]
        self.runs = np.searchsorted(item[by_item], np.arange(len(held) + 1))
        sequences = [item[bounds[x] : bounds[x + 1]] for x in np.flatnonzero(stored)]
        sort = sorted(range(len(sequences)), key=lambda x: sequences[x].astype(">u4").tobytes())
        self.sets = np.flatnonzero(stored)[sort]
        self.sequences = [sequences[x] for x in sort]
        self.length = np.array([len(x) for x in self.sequences])
        self.common = np.zeros(len(sort), np.int64)
        for x in range(1, len(sort)):
            s, t = self.sequences[x - 1], self.sequences[x]
            k = min(len(s), len(t))
            differ = np.flatnonzero(s[:k] != t[:k])
            self.common[x] = differ[0] if len(differ) else k

    def _holders(self, path: np.ndarray) -> np.ndarray:
        return np.concatenate([self.holders[self.runs[i] : self.runs[i + 1]] for i in path])

    def links(self, sizes: np.ndarray, label: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
        """Similar pairs of rows, enough to join the components ``label`` of all similar ones;
        labels are brought up to date on the way."""
        asked, overlap = self.probes, np.zeros(len(self.probes), np.int64)
        least = percent * sizes[asked]
        todo: list[tuple] = [(0, len(self.sets), 0)]
        while todo:
            step = todo.pop()
            if len(step) == 2:
                np.subtract.at(overlap, step[0], 1)
                continue
            lo, hi, depth = step
            to = int(self.common[lo + 1 : hi].min()) if hi - lo > 1 else int(self.length[lo])
            if to > depth:
                gained = self._holders(self.sequences[lo][depth:to])
                np.add.at(overlap, gained, 1)
                todo.append((gained, None))
            below = self.sets[lo:hi]
            remains = int(self.length[lo:hi].max()) - to
            reach = overlap + np.minimum(remains, self.probe_length - overlap)
            hope = (100 + percent) * reach >= percent * int(sizes[below].min()) + least
            own = label[below]
            if (own == own[0]).all():
                hope &= label[asked] != own[0]
            if not hope.any():
                continue
            if hi - lo == 1:
                x = int(below[0])
                for y in asked[hope].tolist():
                    if label[x] != label[y]:
                        label[label == label[y]] = label[x]
                        yield x, y
            else:
                cuts = [lo, *(lo + 1 + np.flatnonzero(self.common[lo + 1 : hi] == to)).tolist(), hi]
                todo.extend((a, b, to) for a, b in zip(cuts[:-1], cuts[1:], strict=True))


def trie_links(values, offsets, sizes, label, stored, asked, percent) -> Iterator[tuple[int, int]]:
    """Similar pairs ``(x, y)`` of a stored and an asked row, enough to join ``label``."""
    if stored.any() and asked.any():
        yield from _Trie(values, offsets, stored, asked).links(sizes, label, percent)


def _similar(percent: int):
    """Pairs of a cell, enough to tie together all that are similar."""

    def run(batches):
        for batch, begin in _whole_cells(batches):
            k, c, n, own, i, j = (
                batch.column(x).to_numpy(zero_copy_only=False) for x in ("k", "c", "n", "own", "i", "j")
            )
            values, offsets = _lists(batch.column("items"))
            one, two = [], []
            for a, b in zip(begin, np.append(begin[1:], batch.num_rows), strict=True):
                if b - a < 2:
                    continue
                stored, asked = own[a:b] == i[a], own[a:b] == j[a]
                part = offsets[a : b + 1]
                for x, y in trie_links(
                    values[part[0] : part[-1]], part - part[0], n[a:b],
                    np.unique(c[a:b], return_inverse=True)[1], stored, asked, percent,
                ):
                    one.append(k[a + x])
                    two.append(k[a + y])
            yield _pairs(one, two)

    return run


def _joined(groups: DataFrame, members: DataFrame, match: Callable) -> DataFrame:
    """Pairs ``(a, b)`` that ``match`` finds among the members ``k`` of each group ``g``, enough
    to tie together all that match. ``members`` has ``k``, ``n``, ``weight`` and what ``match``
    reads."""
    weights = members.select("k", "weight")
    edges, pending = None, groups.withColumn("c", F.col("k"))
    for deal in range(DEALS + 1):
        chunks = F.greatest(F.sum("weight") / CHUNK_VALUES, F.count("*") / CHUNK_SETS)
        many = saved(
            pending.join(weights, "k").groupBy("g").agg(F.ceil(chunks).cast("int").alias("chunks")).where("chunks > 1")
        )
        last = many.isEmpty()
        own = F.pmod(F.xxhash64("k", "g", F.lit(deal)), F.col("chunks")).cast("int")
        dealt = (
            pending.join(many, "g", "left").na.fill({"chunks": 1}).withColumn("own", own)
        )
        if deal < DEALS:
            dealt = dealt.withColumn("i", F.col("own")).withColumn("j", F.col("own"))
        else:
            other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
            dealt = dealt.withColumn("other", other).withColumns(
                {"i": F.least("own", "other"), "j": F.greatest("own", "other")}
            ).drop("other")
        placed = dealt.drop("chunks").join(members.drop("weight"), "k")
        found = saved(
            placed.repartition(*_CELL).sortWithinPartitions(*_CELL).mapInArrow(match, "a long, b long").distinct()
        )
        edges = found if edges is None else edges.union(found)
        if last or deal == DEALS:
            break
        # a group that was one chunk is settled, and so is one that became one component
        marked = (
            pending.drop("c").join(many.select("g"), "g", "left_semi")
            .join(components(edges).withColumnRenamed("id", "k"), "k", "left")
            .select("g", "k", F.coalesce("component", "k").alias("c"))
        )
        torn = marked.groupBy("g").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x < y")
        pending = saved(marked.join(torn.select("g"), "g", "left_semi"))
        if pending.isEmpty():
            break
    return edges


def _listed(classes: DataFrame) -> DataFrame:
    """Lists ``(g, k)``: the first n-grams of sets, those held by two sets at least. Of lists with
    the same members one is enough."""
    held = classes.select("k", F.explode("first").alias("g"))
    often = held.groupBy("g").agg(F.count("*").alias("n")).where("n > 1")
    entries = saved(held.join(often.select("g"), "g", "left_semi"))
    same = [F.bit_xor(F.xxhash64(F.lit(x), "k")).alias(f"x{x}") for x in (1, 2)]
    kept = entries.groupBy("g").agg(F.count("*").alias("n"), *same).groupBy("n", "x1", "x2").agg(F.min("g").alias("g"))
    return saved(entries.join(kept.select("g"), "g", "left_semi"))


def _filter_of(keys: DataFrame) -> tuple[np.ndarray, int]:
    """Keys as a bitmap of ``FILTER_BITS`` bits each, up to ``MOST_FILTER_BITS`` (32 MB). It spares
    other sets the shuffle; the join that follows decides."""
    bits = min(MOST_FILTER_BITS, 1 << max(10, (keys.count() * FILTER_BITS - 1).bit_length()))
    marks = F.bit_or(F.expr("shiftleft(1, int(x & 7))"))
    rows = (
        keys.select(_place("k", bits).alias("x"))
        .groupBy(F.shiftright("x", 3).alias("place"))
        .agg(marks.alias("marks"))
    )
    found = rows.toPandas()
    out = np.zeros(bits // 8, np.uint8)
    out[found["place"]] = found["marks"].astype(np.uint8)
    return out, bits


def _place(key: str, bits: int) -> Column:
    return F.xxhash64(key).bitwiseAND(F.lit(bits - 1))


def similar_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 4,
    percent: int = 85,
) -> DataFrame:
    """``(id, n_shingles, component_id)`` for every row of ``docs``.

    Rows are linked when ``100 * |A & B| >= percent * |A | B|`` over their sets of distinct
    n-grams (words cut at ASCII space, A-Z lower-cased); ``component_id`` is the smallest id
    reachable over links, the row's own included. Links are not counted: among the copies of
    a text there are as many as the square of their number.

    A text with fewer words than an n-gram is one n-gram; an empty or null text has none and is
    linked with nothing, its component is its id. Rows with a null id, repeated rows, and
    different texts under one id are documents of their own; nulls are no smallest id unless
    a component has no other. N-grams are compared by 63-bit hashes, sets by 128 bits. Other
    columns are not read, so names do not clash. No rows give no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows, _ = keyed(texts, "id", ["text"], "k")
    table = spark.sparkContext.broadcast(bucket_counts(texts, shingle_words).astype(np.int32))
    id_type = docs.schema[id_col].dataType.simpleString()
    described = saved(
        rows.mapInArrow(
            _described(shingle_words, percent, table),
            f"k long, id {id_type}, n long, sum1 long, sum2 long, first array<long>, bits array<long>",
        )
    )
    same = ["n", "sum1", "sum2"]
    filled = described.where("n > 0")
    classes = filled.groupBy(*same).agg(
        F.min("k").alias("k"), F.first("first").alias("first"), F.first("bits").alias("bits")
    )
    lists = _listed(classes)
    listed = saved(
        classes.join(lists.select("k").distinct(), "k", "left_semi").select(
            "k", "n", "bits", F.size("bits").alias("weight")
        )
    )
    clusters = components(_joined(lists, listed, _possible(percent))).select(
        F.col("component").alias("g"), F.col("id").alias("k")
    )
    bits, length = _filter_of(clusters.select("k"))
    wanted = spark.sparkContext.broadcast(bits)
    sets = rows.select("k", "text", _place("k", length).alias("at")).mapInArrow(
        _sets(shingle_words, wanted), "k long, items array<long>"
    )
    members = (
        sets.join(clusters.select("k"), "k", "left_semi").dropDuplicates(["k"])
        .select("k", F.size("items").cast("long").alias("n"), F.size("items").alias("weight"), "items")
    )
    links = components(_joined(clusters, saved(members), _similar(percent)))

    named = filled.groupBy(*same).agg(F.min("k").alias("k"), F.min("id").alias("least"))
    linked = links.withColumnRenamed("id", "k").join(named, "k")
    smallest = linked.groupBy("component").agg(F.min("least").alias("smallest"))
    linked = linked.join(smallest, "component").select(*same, "smallest")
    of = named.join(linked, same, "left").select(*same, F.coalesce("smallest", "least").alias("component_id"))
    return described.join(of, same, "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
    )
