"""Toxicity by embeddings of subword bags.

A word is the mean of the vectors of its own hash and of its byte n-grams, a bag the mean of
``BAG`` consecutive words, and a linear softmax over the bag's vector says how toxic it is;
a text is as toxic as its worst bag. Vectors and softmax are trained together in numpy on a
bounded sample of labelled rows, each text through its worst bag of the moment. Misspelt
words share most n-grams, and with them their vectors.

Scoring needs one number per vector, its projection on the softmax, so a model is a table of
``2 ** BITS`` floats.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyshop.llm import words as W
from tallyshop.llm.storage import opened, shared

#: Bounds of the training sample.
FIT_TOXIC, FIT_CLEAN = 800, 2_000
BITS, SIZE, BAG = 16, 8, 4
RATE, FLOOR, DECAY = 1.0, 0.5, 0.002


@dataclass
class Model:
    """The projection of each vector, the bias, and the log-odds of a text without words."""

    weight: np.ndarray
    bias: float
    empty: float


def _subwords(found: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """Features of all words, and where each word's begin: its hash, and for each of its bytes
    the n-grams of three, four and five bytes around it, cut at the word's ends."""
    low = W.ALNUM[found.data]
    own = found.hashes(W.ALNUM) >> np.uint64(64 - BITS)
    size = found.ends - found.starts
    begin = np.cumsum(size) - size
    at = np.repeat(found.starts - begin, size) + np.arange(int(size.sum()))
    left = at - np.repeat(found.starts, size)
    right = np.repeat(found.ends, size) - 1 - at
    padded = np.concatenate([np.zeros(2, np.uint8), low, np.zeros(2, np.uint8)]).astype(np.uint64)
    around = [np.where((left >= -d) & (right >= d), padded[at + 2 + d], 0) for d in (-2, -1, 0, 1, 2)]
    b = [x << np.uint64(8 * i) for i, x in enumerate(around)]
    grams = (b[1] | b[2] | b[3], b[1] | b[2] | b[3] | b[4], b[0] | b[1] | b[2] | b[3] | b[4])
    out = np.empty((len(at), 3), np.int64)
    for i, g in enumerate(grams):
        out[:, i] = W.mix(g, i + 3) >> np.uint64(64 - BITS)
    starts = 3 * begin + np.arange(len(size))
    features = np.empty(3 * len(at) + len(size), np.int64)
    rest = np.ones(len(features), bool)
    rest[starts] = False
    features[starts] = own.astype(np.int64)
    features[rest] = out.ravel()
    return features, starts


def _bags(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where bags begin and to which text they belong; the last bag of a text may be short."""
    counts = np.diff(first)
    n = -(-counts // BAG)
    owner = np.repeat(np.arange(len(counts)), n)
    inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(first[:-1], n) + BAG * inside, owner


def _worst(logit: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """The bag of the highest logit of each text that has one, and these texts."""
    order = np.lexsort((np.arange(len(logit)), -logit, owner))
    full, at = np.unique(owner[order], return_index=True)
    return order[at], full


def train(texts: list[str], toxic: np.ndarray, rounds: int = 40, seed: int = 11) -> Model:
    """Train vectors and softmax by full-batch Adam. Without texts of both labels, the model
    scores everything by the share of toxic ones."""
    toxic = np.asarray(toxic, float)
    share = float(np.clip(toxic.mean() if len(toxic) else 0.5, 0.01, 0.99))
    empty = float(np.log(share / (1 - share)))
    if not 0 < toxic.sum() < len(toxic):
        return Model(np.zeros(2**BITS, np.float32), empty, empty)
    column = pa.array(texts, pa.string())
    parts = []
    words = 0
    for _, _, data, offsets in W.slices(column):
        found = W.find_words(data, offsets, W.ALNUM)
        hashes = found.hashes(W.ALNUM)
        _, one, number = np.unique(hashes, return_index=True, return_inverse=True)
        some = W.Words(found.data, found.starts[one], found.ends[one], np.array([0, len(one)]))
        features, starts = _subwords(some)
        parts.append((features, starts, number, found.first, words))
        words += len(one)
    rng = np.random.default_rng(seed)
    theta = {
        "e": rng.normal(0, 0.1, (2**BITS, SIZE)).astype(np.float32),
        "w": rng.normal(0, 1, SIZE).astype(np.float32),
        "b": np.zeros(1, np.float32),
    }
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in theta.items()}
    cost = np.where(toxic > 0, 0.5 / toxic.mean(), 0.5 / (1 - toxic.mean()))
    for step in range(1, rounds + 1):
        grad = {k: np.zeros_like(v) for k, v in theta.items()}
        base = 0
        for features, starts, number, first, _ in parts:
            texts_here = len(first) - 1
            y, c = toxic[base : base + texts_here], cost[base : base + texts_here]
            base += texts_here
            if len(number) == 0:
                continue
            size = np.diff(np.append(starts, len(features)))
            vector = np.add.reduceat(theta["e"][features], starts, axis=0) / size[:, None]
            begin, owner = _bags(first)
            held = np.diff(np.append(begin, len(number)))
            bag = np.add.reduceat((vector @ theta["w"])[number], begin) / held
            worst, full = _worst(bag, owner, texts_here)
            p = 1 / (1 + np.exp(-(bag[worst] + theta["b"][0])))
            g = (c[full] * (p - y[full])).astype(np.float32)
            grad["b"] += g.sum()
            used = np.concatenate([number[a : a + n] for a, n in zip(begin[worst], held[worst], strict=True)])
            per_word = np.repeat(g / held[worst], held[worst])
            pull = np.bincount(used, per_word, len(starts)).astype(np.float32)
            grad["w"] += pull @ vector
            feature_pull = np.repeat(pull / size, size)
            total = np.bincount(features, feature_pull, 2**BITS).astype(np.float32)
            grad["e"] += total[:, None] * theta["w"]
        for k in theta:
            g = grad[k] / len(toxic)
            m = moment[k]
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            spread = np.sqrt(m[1] / (1 - 0.99**step))
            # relative to the largest, so that a rare n-gram moves as little as its evidence says
            theta[k] -= RATE * (m[0] / (1 - 0.9**step)) / (spread + FLOOR * spread.max() + 1e-8)
        theta["e"] *= 1 - DECAY
    return Model((theta["e"] @ theta["w"]).astype(np.float32), float(theta["b"][0]), empty)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", fit_toxic: int = FIT_TOXIC, fit_clean: int = FIT_CLEAN, seed: int = 11) -> Model:
    """Train on the labelled documents, at most ``fit_toxic`` and ``fit_clean`` of them, in a
    seeded order of ids. A document with several labels is toxic if one says so."""
    known = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col)).alias("y"))
    )
    ids: dict = {}
    for y, most in ((1, fit_toxic), (0, fit_clean)):
        chosen = known.where(F.col("y") == y).orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(most)
        ids |= {r.id: y for r in chosen.select("id").collect()}
    rows = (
        docs.where(F.col(id_col).isin(list(ids))).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
        .orderBy("id").collect()
    )
    return train([r.text or "" for r in rows], np.array([ids[r.id] for r in rows]), seed=seed)


def _score(model: Model, batches):
    for batch in batches:
        for lo, hi, data, offsets in W.slices(batch.column("text")):
            found = W.find_words(data, offsets, W.ALNUM)
            logits = np.full(hi - lo, model.empty)
            spans = np.full((hi - lo), -1)
            if len(found.starts):
                features, starts = _subwords(found)
                size = np.diff(np.append(starts, len(features)))
                word = np.add.reduceat(model.weight[features], starts, dtype=np.float64) / size
                begin, owner = _bags(found.first)
                held = np.diff(np.append(begin, len(word)))
                bag = np.add.reduceat(word, begin) / held
                worst, full = _worst(bag, owner, hi - lo)
                logits[full] = bag[worst] + model.bias
                spans[full] = begin[worst] - found.first[:-1][full]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").slice(lo, hi - lo),
                    pa.array(1 / (1 + np.exp(-np.clip(logits, -40, 40)))),
                    pa.array(spans, pa.int64()),
                ],
                ["id", "score", "worst_word"],
            )


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score, worst_word)`` for every row: the probability of the worst bag of words and
    where it begins (-1 without words; the score is then the share of toxic training texts).

    Rows are taken one by one, so null ids, repeated rows, empty tables and other columns
    make no difference; texts are read whole.
    """
    held = shared(docs.sparkSession, model)

    def run(batches):
        yield from _score(opened(held), batches)

    return (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
        .mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, score double, worst_word long")
        .withColumnRenamed("id", id_col)
    )
