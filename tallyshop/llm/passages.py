"""Substring deduplication with repeated phrases.

1. Phrases: of each window of words, the phrase (``PHRASE`` words) with the smallest hash
   represents it, so equal windows have the same phrase at the same place. Phrases that
   occur once in the corpus cannot lie in a repeated window and drop out.
2. Suspects: documents are dealt in slices, and the recurring phrases of a slice are compiled
   into an Aho-Corasick automaton, which reads the slice and tells where they stand. A window
   whose own phrase is at one of these places may repeat, and no other one can.
3. Suspects are confirmed: per slice only the first of equal windows goes on, the others are
   known repeats already. The firsts are sorted by window and read in that order; all but the
   earliest are repeats.

Texts are shuffled once, for both joins on the id. Words are compared by 64-bit hashes, windows
by a 64-bit hash of their words.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from tallyshop.llm import words as W
from tallyshop.llm.decontamination import lowest
from tallyshop.llm.keys import keyed

PHRASE = 8
_RESULT = [
    StructField("id", LongType()),
    StructField("n_words", LongType()),
    StructField("n_removed", LongType()),
    StructField("kept_text", StringType()),
    StructField("kept_sha256", StringType()),
    StructField("spans", ArrayType(ArrayType(IntegerType()))),
]
_DIGIT = 6  # words are numbered within a slice and written as characters of this many bits


def _phrases(found: W.Words, hashes: np.ndarray, window: int):
    """The places of windows, the hashes of phrases, and the place of each window's phrase
    (places ascend within a text, so equal ones are neighbours)."""
    grams = W.grams(hashes, PHRASE)
    places = W.gram_places(found.first, window)
    return places, grams, lowest(grams, window - PHRASE + 1)[places] if len(places) else places


def _phrase_rows(window: int):
    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in W.slices(batch.column("text")):
                found = W.find_words(data, offsets, W.PLAIN)
                _, grams, at = _phrases(found, found.hashes(W.PLAIN), window)
                at = np.unique(at)
                owner = np.searchsorted(found.first, at, side="right") - 1
                value = grams[at].view(np.int64)
                order = np.lexsort((value, owner))
                value, owner = value[order], owner[order]
                new = np.ones(len(value), bool)
                new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
                times = np.diff(np.append(np.flatnonzero(new), len(value)))
                ids = batch.column("id").slice(lo, hi - lo).take(pa.array(owner[new]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value[new]), ids, pa.array(times, pa.int64())], ["phrase", "id", "n"]
                )

    return run


def _located(hashes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """All places at which one of the phrases beginning at ``places`` begins, by an
    Aho-Corasick automaton over the words' numbers written in a small alphabet."""
    _, number = np.unique(hashes, return_inverse=True)
    digits = max(1, -(-int(number.max()).bit_length() // _DIGIT))
    # each digit has an alphabet of its own, so a match begins at a word
    code = np.stack(
        [(number >> (_DIGIT * i) & (2**_DIGIT - 1)) + ((i + 1) << 8) for i in range(digits)], axis=1
    )
    stream = code.astype("<u4").tobytes().decode("utf-32-le")
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for at in places.tolist():
        automaton.add_word(stream[at * digits : (at + PHRASE) * digits])
    automaton.make_automaton()
    ends = np.fromiter((end for end, _ in automaton.iter(stream)), np.int64)
    return (ends + 1) // digits - PHRASE


def _suspects(window: int):
    """Rows ``(key, id, at)``: windows that may repeat one of another slice, by their hash and
    where they start, and word ranges that repeat one of this slice for certain, packed."""

    def run(batches):
        for batch in batches:
            listed = batch.column("phrases")
            all_ids = batch.column("id").to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in W.slices(batch.column("text")):
                found = W.find_words(data, offsets, W.PLAIN)
                hashes = found.hashes(W.PLAIN)
                places, grams, at = _phrases(found, hashes, window)
                part = listed.slice(lo, hi - lo)
                wanted = np.unique(part.flatten().to_numpy(zero_copy_only=False).view(np.uint64))
                chosen = np.unique(at)
                value, one = np.unique(grams[chosen], return_index=True)
                one = one[np.isin(value, wanted, assume_unique=True)]
                if len(one) == 0:
                    continue
                stands = np.zeros(len(hashes), bool)
                stands[_located(hashes, chosen[one])] = True
                places = places[stands[at]]
                value = W.grams(hashes, window)[places].view(np.int64)
                owner = np.searchsorted(found.first, places, side="right") - 1
                ids, start = all_ids[lo:hi][owner], places - found.first[owner]
                order = np.lexsort((start, ids, value))
                value, ids, start = value[order], ids[order], start[order]
                # repeated rows have the same windows: each counts once
                once = np.ones(len(value), bool)
                once[1:] = (value[1:] != value[:-1]) | (ids[1:] != ids[:-1]) | (start[1:] != start[:-1])
                value, ids, start = value[once], ids[once], start[once]
                first = np.ones(len(value), bool)
                first[1:] = value[1:] != value[:-1]
                own, begin, end = _ranges(ids[~first], start[~first], window)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([value[first], W.mix(own.view(np.uint64)).view(np.int64)])),
                        pa.array(np.concatenate([ids[first], own])),
                        pa.array(np.concatenate([start[first], _packed(begin, end)])),
                    ],
                    ["key", "id", "at"],
                )

    return run


def _packed(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Word ranges as negative numbers, which no window's start is."""
    return -1 - (start << 31 | (end - start))


def _unpacked(at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of windows and of packed ranges."""
    start = np.where(at >= 0, at, (-1 - at) >> 31)
    return start, start + np.where(at >= 0, window, (-1 - at) & (2**31 - 1))


def _ranges(ids: np.ndarray, start: np.ndarray, window: int):
    """Windows merged into word ranges per document: ``(id, start, end)``."""
    order = np.lexsort((start, ids))
    ids, start = ids[order], start[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (start[1:] > start[:-1] + window)
    last = np.append(np.flatnonzero(new)[1:], len(ids)) - 1 if len(ids) else np.zeros(0, np.int64)
    return ids[new], start[new], start[last] + window


def _later(batches):
    """Of sorted suspects, all but the first of each window (and what equals it: a repeated
    row's), and all that is known."""
    before = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        key, ids, at = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "id", "at"))
        again = at < 0
        fresh = np.flatnonzero(~again)
        if len(fresh):
            k, i, a = key[fresh], ids[fresh], at[fresh]
            head = np.ones(len(fresh), bool)
            head[1:] = k[1:] != k[:-1]
            if before is not None and before[0] == k[0]:
                head[0] = False
            # the first of each window, from this batch or from the one before
            group = np.cumsum(head)
            first_id, first_at = np.append(0, i[head]), np.append(0, a[head])
            if group[0] == 0:
                first_id[0], first_at[0] = before[1:]
            again[fresh] = (i != first_id[group]) | (a != first_at[group])
            before = k[-1], first_id[group[-1]], first_at[group[-1]]
        yield batch.select(["id", "at"]).filter(pa.array(again))


def _cut(window: int, further: list[str]):
    """Rows of the result; columns named in ``further`` follow as they came."""

    def run(batches):
        for batch in batches:
            removed = batch.column("removed")
            for lo, hi, data, offsets in W.slices(batch.column("text")):
                found = W.find_words(data, offsets, W.PLAIN)
                counts, gone, texts, spans = found.counts(), [], [], []
                for i in range(lo, hi):
                    a, b = found.first[i - lo], found.first[i - lo + 1]
                    out = np.zeros(b - a, bool)
                    if removed[i].is_valid:
                        steps = np.zeros(b - a + 1, np.int64)
                        begin, end = _unpacked(removed[i].values.to_numpy(zero_copy_only=False), window)
                        np.add.at(steps, begin, 1)
                        np.add.at(steps, end, -1)
                        out = np.cumsum(steps[:-1]) > 0
                    gone.append(int(out.sum()))
                    spans.append(np.flatnonzero(np.diff(np.concatenate([[0], out.view(np.int8), [0]]))).reshape(-1, 2).tolist())
                    text = bytes(data[offsets[i - lo] : offsets[i - lo + 1]])
                    base = offsets[i - lo]
                    kept = np.flatnonzero(~out) + a
                    texts.append(b" ".join([text[x:y] for x, y in zip((found.starts[kept] - base).tolist(), (found.ends[kept] - base).tolist(), strict=True)]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("own").slice(lo, hi - lo),
                        pa.array(counts, pa.int64()),
                        pa.array(gone, pa.int64()),
                        pa.array(texts, pa.binary()).cast(pa.string()),
                        pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                        pa.array(spans, pa.list_(pa.list_(pa.int32()))),
                        *(batch.column(c).slice(lo, hi - lo) for c in further),
                    ],
                    ["id", "n_words", "n_removed", "kept_text", "kept_sha256", "spans", *further],
                )

    return run


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, whole: bool = False
) -> DataFrame:
    """``(id, n_words, n_removed, kept_text, kept_sha256, spans)`` for every document.

    Words are runs of anything but ASCII space, as they stand. Each word covered by ``window``
    consecutive words that also begin earlier (in a document with a smaller id, or before in
    the same one) is removed; windows are judged on the input. ``kept_text`` joins the other
    words by one space, ``spans`` are the removed word ranges ``[from, to)``.

    Null and empty texts have no words; fewer words than a window are never removed. Rows equal
    in id and text are one document, which repeats nothing of itself: each of them has its
    result. Documents with a null id, and different texts under one id, come after all others
    (ids are below 2**62), in an order by hash. Empty tables give no rows; other columns are
    not read, unless ``whole`` asks for the rows of ``docs`` as well: as structs in a column
    ``row``, without another join. ``window`` is at least ``PHRASE`` words.
    """
    if window < PHRASE:
        raise ValueError(f"a window has {PHRASE} words at least")
    rows = docs.select(
        F.col(id_col).cast("long").alias("own"),
        F.col(text_col).cast("string").alias("text"),
        *([F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col)).alias("rest")] if whole else []),
    )
    texts, _ = keyed(rows, "own", ["text"], "id")
    phrases = texts.select("id", "text").mapInArrow(_phrase_rows(window), "phrase long, id long, n long")
    recurring = phrases.groupBy("phrase").agg(F.sum("n").alias("n")).where("n > 1").select("phrase")
    listed = (
        phrases.select("phrase", "id").join(recurring, "phrase")
        .groupBy("id").agg(F.collect_list("phrase").alias("phrases"))
    )
    # with all columns of ``texts``, so that the join below reads the same shuffle again
    suspects = texts.join(listed, "id").mapInArrow(_suspects(window), "key long, id long, at long")
    removed = (
        suspects.repartition("key").sortWithinPartitions("key", "id", "at")
        .mapInArrow(_later, "id long, at long")
        .groupBy("id").agg(F.collect_list("at").alias("removed"))
    )
    further = ["text", "rest"] if whole else []
    fields = [f for f in texts.schema.fields if f.name in further]
    out = texts.join(removed, "id", "left").mapInArrow(
        _cut(window, [f.name for f in fields]), StructType([*_RESULT, *fields])
    )
    if whole:
        row = F.struct(
            *(F.col("text") if c == text_col else F.col("rest").getField(c) for c in docs.columns)
        )
        out = out.withColumn("row", row).drop(*further)
    return out.withColumnRenamed("id", id_col)
