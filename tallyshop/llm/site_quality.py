"""Quality of documents from their text and from the sites they come from.

A logistic regression on measures of the text gives each document its own evidence. Labelled
documents of a host give the host a posterior that is shrunk towards the global share of
good ones, and those of a path of the host one that is shrunk towards the host's; the
strength of both priors is estimated from the spread between sites (method of moments).
Evidence and posterior are added as log-odds. All counts are grouped sums; a host with a third of
all documents is one row per task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyshop.llm import words as W

#: Bound of the training sample of the text classifier.
FIT_ROWS = 6_000
MEASURES = 9
_KEEP = 0.5


@dataclass
class Evidence:
    mean: np.ndarray
    spread: np.ndarray
    weight: np.ndarray
    bias: float


def _class(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, np.int64)
    for a, b in ranges:
        out[a : b + 1] = 1
    return out


_CAPITAL, _DIGIT = _class((0x41, 0x5A)), _class((0x30, 0x39))
_SYMBOL = _class((0x23, 0x26), (0x2A, 0x2A), (0x3C, 0x3E), (0x7C, 0x7C))
_MARK, _LINE = _class((0x21, 0x21), (0x2E, 0x2E), (0x3F, 0x3F)), _class((0x0A, 0x0A))


def measures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of ``MEASURES`` numbers for each text of a slice."""
    found = W.find_words(data, offsets, W.PLAIN)
    hashes, counts, size = found.hashes(W.PLAIN), found.counts(), np.diff(offsets)
    owner = found.owner()
    n, b = np.maximum(1, counts), np.maximum(1, size)

    def share(table):
        return np.diff(np.concatenate([[0], np.cumsum(table[data])])[offsets])

    def distinct(values, who):
        order = np.lexsort((values, who))
        values, who = values[order], who[order]
        new = np.ones(len(values), bool)
        new[1:] = (values[1:] != values[:-1]) | (who[1:] != who[:-1])
        return np.bincount(who[new], minlength=len(counts))

    places = W.gram_places(found.first, 3)
    triples = W.grams(hashes, 3)[places]
    length = np.concatenate([[0], np.cumsum(found.ends - found.starts)])[found.first]
    return np.stack(
        [
            np.log1p(counts),
            np.minimum(20, np.diff(length) / n),
            share(_CAPITAL) / b,
            share(_DIGIT) / b,
            np.minimum(1, share(_SYMBOL) / n),
            np.minimum(1, share(_MARK) / n),
            share(_LINE) / n,
            distinct(hashes, owner) / n,
            distinct(triples, owner[places]) / np.maximum(1, counts - 2),
        ],
        axis=1,
    )


def train(x: np.ndarray, y: np.ndarray, rounds: int = 400) -> Evidence:
    """Logistic regression on standardised measures, with a light ridge. Without both labels
    the text is no evidence."""
    share = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
    bias = float(np.log(share / (1 - share)))
    if not 0 < y.sum() < len(y):
        return Evidence(np.zeros(MEASURES), np.ones(MEASURES), np.zeros(MEASURES), bias)
    mean, spread = x.mean(0), x.std(0) + 1e-6
    z = np.clip((x - mean) / spread, -6, 6)
    z = np.concatenate([z, z**2], axis=1)
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(z @ w + bias)))
        w -= 0.5 * (z.T @ (p - y) / len(y) / 4 + 1e-4 * w)
        bias -= 0.5 * float((p - y).mean())
    return Evidence(mean, spread, w, bias)


def _known(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    return (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col)).cast("double").alias("y"))
    )


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", rows: int = FIT_ROWS, seed: int = 19) -> Evidence:
    """Train on at most ``rows`` labelled documents, in a seeded order of ids."""
    chosen = _known(labels, id_col, label_col).orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(rows)
    y = {r.id: r.y for r in chosen.collect()}
    texts = docs.where(F.col(id_col).isin(list(y))).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in W.slices(batch.column("text")):
                x = measures(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(lo, hi - lo), W.list_array(pa.array(x.ravel()), np.full(hi - lo, MEASURES))],
                    ["id", "x"],
                )

    got = sorted(texts.mapInArrow(run, "id long, x array<double>").collect())
    return train(np.array([r.x for r in got]).reshape(-1, MEASURES), np.array([y[r.id] for r in got]))


def _logits(model: Evidence):
    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in W.slices(batch.column("text")):
                z = np.clip((measures(data, offsets) - model.mean) / model.spread, -6, 6)
                if len(model.weight) == 2 * MEASURES:
                    z = np.concatenate([z, z**2], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(lo, hi - lo), pa.array(z @ model.weight + model.bias)], ["id", "evidence"]
                )

    return run


def _strength(groups: DataFrame, centre: Column) -> float:
    """Pseudo-counts of a beta prior: how little groups differ beyond what their sizes explain."""
    row = groups.where("n > 0").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - centre, 2)).alias("spread"),
        F.sum(centre * (1 - centre)).alias("chance"),
        F.avg(centre * (1 - centre)).alias("v"),
    ).first()
    if not row.n:
        return 1.0
    between = (row.spread - row.chance) / row.n
    return float(np.clip(row.v / between - 1 if between > 0 else 1e4, 1.0, 1e4))


def _log_odds(p: Column) -> Column:
    return F.log(p / (1 - p))


def site_quality(docs: DataFrame, labels: DataFrame, sites: DataFrame, evidence: Evidence,
                 id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``(id, host, path, evidence, host_posterior, path_posterior, score, kept)`` per document.

    ``sites`` has ``(id, host, path)``; documents it lacks, or with a null host, share the
    host and path null. ``labels`` are those to learn from. ``score`` is the probability of
    good quality, ``kept`` is a score of ``0.5`` or more. Null and empty texts have measures of 0.
    Without labels all posteriors are 0.5. Ids are unique; a document listed under several
    sites belongs to the first by name; empty tables give no rows; other columns are not read.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    where = sites.groupBy(F.col(id_col).alias("id")).agg(F.min(F.struct("host", "path")).alias("s"))
    known = _known(labels, id_col, label_col)
    site = ["host", "path"]
    placed = (
        texts.mapInArrow(_logits(evidence), "id long, evidence double")
        .join(where.select("id", "s.host", "s.path"), "id", "left")
    )
    counts = (
        known.join(where.select("id", "s.host", "s.path"), "id", "left")
        .groupBy(*site).agg(F.count("*").alias("n"), F.sum("y").alias("k"))
    )
    hosts = counts.groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    centre = (whole.k + 1.0) / (whole.n + 2.0) if whole.n else 0.5
    strength = _strength(hosts, F.lit(centre))
    hosts = hosts.withColumn("host_posterior", (F.col("k") + strength * centre) / (F.col("n") + strength))
    same_host = F.col("p.host").eqNullSafe(F.col("h.host"))
    paths = counts.alias("p").join(hosts.alias("h"), same_host).select("p.host", "p.path", "p.n", "p.k", "host_posterior")
    strength = _strength(paths, F.col("host_posterior"))
    posterior = (F.col("k") + strength * F.col("host_posterior")) / (F.col("n") + strength)
    paths = paths.select(*site, posterior.alias("path_posterior"))
    here = F.col("d.host").eqNullSafe(F.col("h.host"))
    out = placed.alias("d").join(hosts.select("host", "host_posterior").alias("h"), here, "left")
    out = out.select("d.*", F.coalesce("host_posterior", F.lit(centre)).alias("host_posterior"))
    there = F.col("d.host").eqNullSafe(F.col("p.host")) & F.col("d.path").eqNullSafe(F.col("p.path"))
    out = out.alias("d").join(paths.alias("p"), there, "left").select("d.*", F.coalesce("path_posterior", "host_posterior").alias("path_posterior"))
    odds = F.col("evidence") + _log_odds(F.col("path_posterior")) - _log_odds(F.lit(centre))
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), odds))))
    return out.withColumn("score", score).withColumn("kept", F.col("score") >= _KEEP).withColumnRenamed("id", id_col)
