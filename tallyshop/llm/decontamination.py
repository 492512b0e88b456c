"""Benchmark decontamination by winnowed fingerprints.

Of every ``window`` consecutive words, the k-gram with the smallest hash is kept. Any span
of ``window`` words that a document and an item share therefore has a kept k-gram in common;
joining kept k-grams finds every such pair. Items shorter than a window keep one fingerprint,
of the whole item, and documents are looked up at every place for the lengths that occur.
Each pair found is extended: every place of the document where a whole window of the item
occurs is marked, word by word.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyshop.llm import words as W

_SHORT = 1 << 40  # salts the fingerprints of short items apart from those of k-grams


def lowest(grams: np.ndarray, width: int) -> np.ndarray:
    """For each place, that of the smallest of the ``width`` grams from there (the first of equals)."""
    best = grams[: len(grams) - width + 1].copy()
    at = np.arange(len(best))
    for j in range(1, width):
        other = grams[j : j + len(best)]
        less = other < best
        best = np.where(less, other, best)
        at[less] = np.flatnonzero(less) + j
    return at


def winnow(grams: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
    """Places of the smallest of ``width`` consecutive grams (the first of equals), for the
    windows that begin at ``places``."""
    if len(places) == 0:
        return places
    kept = lowest(grams, width)[places]
    return kept[np.concatenate([[True], kept[1:] != kept[:-1]])]


def _fingerprints(data, offsets, window: int, k: int, lengths):
    """``(fingerprint, text)`` pairs of a slice. ``lengths``: of short spans, looked up at each
    place; None for items, where only a whole short text counts."""
    found = W.find_words(data, offsets, W.ALNUM)
    hashes, counts, owner = found.hashes(W.ALNUM), found.counts(), found.owner()
    g = W.grams(hashes, k)
    at = winnow(g, W.gram_places(found.first, window), window - k + 1)
    out, who = [g[at]], [owner[at]]
    for n in range(1, window) if lengths is None else lengths:
        places = W.gram_places(found.first, n)
        if lengths is None:
            places = places[counts[owner[places]] == n]
        out.append(W.mix(W.grams(hashes, n)[places], n + _SHORT))
        who.append(owner[places])
    out, who = np.concatenate(out), np.concatenate(who)
    order = np.lexsort((out, who))
    out, who = out[order], who[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (who[1:] != who[:-1])
    return out[new].view(np.int64), who[new]


def _fingerprint_rows(window: int, k: int, lengths):
    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in W.slices(batch.column("text")):
                prints, who = _fingerprints(data, offsets, window, k, lengths)
                ids = batch.column("id").slice(lo, hi - lo).take(pa.array(who))
                yield pa.RecordBatch.from_arrays([pa.array(prints), ids], ["fp", "id"])

    return run


def _covered(places: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of ``size`` words lie in the ``n`` words from one of ``places``."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, places, 1)
    np.add.at(steps, places + n, -1)
    return np.cumsum(steps[:-1]) > 0


def _word_hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return W.find_words(data, np.array([0, len(data)]), W.ALNUM).hashes(W.ALNUM)


def _extend(window: int):
    """For each text with its candidate items: the words hit and the items that occur."""

    def one(hashes, items):
        hit, found, grams = np.zeros(len(hashes), bool), [], {}
        for item_id, text in items:
            wanted = _word_hashes(text or "")
            n = min(window, len(wanted))
            if n == 0 or len(hashes) < n:
                continue
            if n not in grams:
                grams[n] = W.grams(hashes, n)
            places = np.flatnonzero(np.isin(grams[n], W.grams(wanted, n)))
            if len(places):
                found.append(item_id)
                hit |= _covered(places, n, len(hashes))
        return hit, sorted(set(found), key=str)

    def run(batches):
        for batch in batches:
            candidates = batch.column("items")
            for lo, hi, data, offsets in W.slices(batch.column("text")):
                found = W.find_words(data, offsets, W.ALNUM)
                hashes = found.hashes(W.ALNUM)
                hits, items, spans = [], [], []
                for i in range(lo, hi):
                    own = hashes[found.first[i - lo] : found.first[i - lo + 1]]
                    listed = candidates[i].as_py() or []
                    hit, ids = one(own, [(x["item_id"], x["item"]) for x in listed])
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
                    hits.append(int(hit.sum()))
                    items.append(ids)
                    spans.append(edges.reshape(-1, 2).tolist())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("own").slice(lo, hi - lo),
                        pa.array(found.counts(), pa.int64()),
                        pa.array(hits, pa.int64()),
                        pa.array(items, pa.list_(pa.int64())),
                        pa.array(spans, pa.list_(pa.list_(pa.int32()))),
                    ],
                    ["id", "n_words", "n_hit", "items", "spans"],
                )

    return run


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    k: int = 5,
) -> DataFrame:
    """``(id, n_words, n_hit, items, spans)`` for every document.

    Words are runs of ASCII letters and digits and of anything beyond ASCII, A-Z lower-cased.
    An item's windows are its runs of ``window`` words; an item of fewer words, but not none,
    is one window. ``n_hit`` counts the document's words inside any occurrence of a window,
    ``spans`` are their word ranges ``[from, to)``, ``items`` the ids of the items with an
    occurrence, sorted as strings.

    Null and empty texts have no words; documents with a null id are checked as others, items
    with one are left out; repeated items count once; empty tables give no hits or no rows. Each
    row is judged by its own text, also where ids repeat. Other columns are not read.
    """
    # where ids are null, texts find their candidates by a hash; each text is then looked through
    own, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    texts = docs.select(own.alias("own"), F.coalesce(own, F.xxhash64(text)).alias("id"), text.alias("text"))
    tests = items.select(
        F.col(item_id_col).cast("long").alias("id"), F.col(item_text_col).cast("string").alias("text")
    ).where("id IS NOT NULL")
    item_prints = tests.mapInArrow(_fingerprint_rows(window, k, None), "fp long, id long")
    lengths = _short_lengths(tests, window)
    pairs = (
        texts.select("id", "text").mapInArrow(_fingerprint_rows(window, k, lengths), "fp long, id long")
        .join(item_prints.select("fp", F.col("id").alias("item_id")).distinct(), "fp")
        .select("id", "item_id")
        .distinct()
    )
    listed = (
        pairs.join(tests.select(F.col("id").alias("item_id"), F.col("text").alias("item")), "item_id")
        .groupBy("id")
        .agg(F.collect_set(F.struct("item_id", "item")).alias("items"))
    )
    return texts.join(listed, "id", "left").mapInArrow(
        _extend(window),
        "id long, n_words long, n_hit long, items array<long>, spans array<array<int>>",
    ).withColumnRenamed("id", id_col)


def _short_lengths(tests: DataFrame, window: int) -> list[int]:
    """The word counts below ``window`` that occur among the items: fewer than ``window`` numbers."""
    words = F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    counts = tests.select(words.alias("n")).where(f"n > 0 AND n < {int(window)}").distinct()
    return sorted(r.n for r in counts.collect())


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns: the items as one SHA-256 of their ids."""
    return found.select(
        id_col,
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.col("items").cast("array<string>"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def sha256_of(ids: list[int]) -> str:
    """The digest of a list of item ids, for tests."""
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
