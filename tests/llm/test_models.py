"""Operators that learn: accuracy on rows they have not seen, defined results on odd input."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyshop.llm import language, licenses, pseudo_likelihood, queries, site_quality, toxicity
from tallyshop.llm import words as W


@pytest.fixture(scope="module")
def tables(spark, star_dir):
    return {n: spark.read.parquet(f"{star_dir}/{n}.parquet") for n in ("documents", "labels", "pages")}


def test_language_held_out(spark, star_dir):
    got = queries.op2_language(spark, star_dir).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{star_dir}/documents.parquet").collect()}
    held = [r for r in got if r.held_out]
    assert len(got) == len(truth) and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_spans(spark):
    rng = random.Random(2)
    left, right = ["abra", "tabra", "kazam", "zaba"], ["olmen", "hulpe", "kinder", "ulmer"]

    def prose(words, n):
        return " ".join(rng.choice(words) for _ in range(n))

    rows = [(i, prose(left, 40), "x") for i in range(30)] + [(30 + i, prose(right, 40), "y") for i in range(30)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    mixed = spark.createDataFrame([(1, prose(left, 30) + " " + prose(right, 12), 9)], "doc_id long, text string, spans int")
    got = language.identify(mixed, model).first()
    assert got.lang_pred == "x"
    assert [(s.lang, s.first_word, s.n_words) for s in got.spans] == [("x", 0, 30), ("y", 30, 12)]


def test_viterbi_shortcut_equals_full_path():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 60, 40)
    first = np.concatenate([[0], np.cumsum(counts)])
    score = -rng.gamma(1.0, 2.0, (int(first[-1]), 3))
    score -= score.max(1, keepdims=True)
    got = language.label_words(score, first, 6.0)
    full = np.zeros(len(score), np.int64)
    language._viterbi(score, first, np.flatnonzero(counts), 6.0, full)

    def value(path, a, b):
        return score[np.arange(a, b), path[a:b]].sum() - 6.0 * np.count_nonzero(np.diff(path[a:b]))

    for a, b in zip(first[:-1], first[1:], strict=True):
        assert value(got, a, b) == pytest.approx(value(full, a, b))


def test_language_of_odd_input(docs, no_docs, clashing, texts):
    model = language.fit(docs)
    for table in (docs, clashing):
        got = {r.doc_id: r.lang_pred for r in language.identify(table, model).collect()}
        assert {i for i, x in got.items() if x == "und"} == {
            i for i, t in enumerate(texts) if not any(c.isalpha() for c in t or "")
        }
    assert language.identify(no_docs, model).collect() == []
    unlearned = language.identify(docs, language.fit(no_docs)).collect()
    assert {r.lang_pred for r in unlearned} == {"und"}


def test_toxicity_recognises_misspellings():
    rng = random.Random(6)
    clean = [a + b for a in "bcdfgklm" for b in ("ando", "erig", "ulm", "ista")]
    bad = ["grobblex", "snarfit"]
    texts, labels = [], []
    for i in range(400):
        words = [rng.choice(clean) for _ in range(rng.randrange(5, 80))]
        if i % 3 == 0:
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        texts.append(" ".join(words))
        labels.append(int(i % 3 == 0))
    model = toxicity.train(texts, np.array(labels))
    import pyarrow as pa

    def scores(xs):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(xs))), pa.array(xs, pa.string())], ["id", "text"])
        return np.concatenate([b.column("score").to_numpy() for b in toxicity._score(model, [batch])])

    filler = " ".join(clean[:20])
    assert (scores([f"{filler} grobblexx {filler}", f"{filler} snarfitt {filler}"]) >= 0.5).all()
    assert (scores([filler, clean[3], None, ""]) < 0.5).all()


def test_toxicity_of_odd_input(spark, docs, no_docs, clashing, texts):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 1), (None, 1), (4, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(clashing, model).collect()
    assert len(got) == len(texts) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(no_docs, model).collect() == []
    assert len(toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).collect()) == len(texts)


def test_site_quality(spark, docs, no_docs, texts):
    n = len(texts)
    sites = spark.createDataFrame([(i, "good" if i % 2 else "bad", "a" if i < 20 else None) for i in range(n - 3)], "doc_id long, host string, path string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, n, 3)], "doc_id long, quality int")
    flat = site_quality.Evidence(np.zeros(9), np.ones(9), np.zeros(9), 0.0)
    got = {r.doc_id: r for r in site_quality.site_quality(docs, labels, sites, flat).collect()}
    assert len(got) == n
    assert got[1].host_posterior > 0.6 > 0.4 > got[2].host_posterior
    assert got[n - 1].host is None
    # sparse hosts stay nearer to the global share
    sparse = sites.withColumn("host", F.concat("host", F.col("doc_id").cast("string")))
    shrunk = {r.doc_id: r for r in site_quality.site_quality(docs, labels, sparse, flat).collect()}
    assert abs(shrunk[3].host_posterior - 0.5) < abs(got[3].host_posterior - 0.5)
    assert site_quality.site_quality(no_docs, labels, sites, flat).collect() == []
    none = site_quality.site_quality(docs, labels.limit(0), sites, flat).collect()
    assert {round(r.path_posterior, 6) for r in none} == {0.5}


def test_site_quality_separates_labels(spark, star_dir, tables):
    got = {r.doc_id: r.kept for r in queries.op5_site_quality(spark, star_dir).collect()}
    labels = tables["labels"].collect()
    assert len(got) == tables["documents"].count()
    assert np.mean([got[r.doc_id] for r in labels if r.quality == 1]) > 0.95


def test_network_learns_context(spark):
    """Words that follow each other are likelier than the same words out of order."""
    rng = random.Random(9)
    pairs = [("ba", "na"), ("ki", "wi"), ("po", "me")]
    texts = [" ".join(w for _ in range(60) for w in rng.choice(pairs)) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    fitted = pseudo_likelihood.fit(docs)
    shuffled = []
    for t in texts[:20]:
        words = t.split()
        rng.shuffle(words)
        shuffled.append(" ".join(words))
    other = spark.createDataFrame(list(enumerate(shuffled)), "doc_id long, text string")
    there = [r.per_token for r in pseudo_likelihood.score(docs, fitted).collect()]
    here = [r.per_token for r in pseudo_likelihood.score(other, fitted).collect()]
    assert np.mean(there) > np.mean(here)


def test_pseudo_likelihood_of_odd_input(docs, no_docs, clashing, texts):
    fitted = pseudo_likelihood.fit(docs)
    got = {r.doc_id: r for r in pseudo_likelihood.score(clashing, fitted).collect()}
    assert len(got) == len(texts) and got[0].n_tokens == 0 and got[1].per_token is None
    assert all(r.pseudo_log_likelihood <= 1e-6 for r in got.values())
    assert pseudo_likelihood.score(no_docs, fitted).collect() == []
    assert len(pseudo_likelihood.score(docs, pseudo_likelihood.fit(no_docs)).collect()) == len(texts)


def test_fit_and_score_of_repeated_texts(docs, texts):
    """Equal texts, within and across slices, have equal scores; tokens are those of ``score``."""
    corpus = docs.select("doc_id", "text").union(docs.selectExpr("doc_id + 1000", "text")).repartition(2)
    got = {r.doc_id: r for r in pseudo_likelihood.fit_and_score(corpus).collect()}
    plain = {r.doc_id: r for r in pseudo_likelihood.score(docs, pseudo_likelihood.fit(docs)).collect()}
    assert len(got) == 2 * len(texts)
    for i, r in got.items():
        assert r.n_tokens == plain[i % 1000].n_tokens
        assert r.pseudo_log_likelihood == pytest.approx(got[i % 1000].pseudo_log_likelihood, abs=1e-6)


def test_word_scores_against_definition():
    """Softmax over classes times the share in the class, word by word."""
    words = "a b c a b d".split()
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    found = W.find_words(data, np.array([0, len(data)]), W.ALNUM)
    hashes = found.hashes(W.ALNUM)
    known = np.sort(np.unique(hashes)[:3])
    vocab = pseudo_likelihood.Vocabulary(known, np.arange(3), np.arange(3), np.log(np.array([0.5, 1.0, 0.25])), -1.5)
    net = pseudo_likelihood.initial()
    got = pseudo_likelihood.word_scores(pseudo_likelihood._numbers(hashes, vocab), found.first, vocab, net)
    number = {int(h): i for i, h in enumerate(known)}

    def vector(i):
        if not 0 <= i < len(words):
            return net["vectors"][pseudo_likelihood._EDGE]
        h = int(hashes[i])
        return net["vectors"][number[h] if h in number else pseudo_likelihood.VOCABULARY + 1 + h % 64]

    for i in range(len(words)):
        x = np.concatenate([vector(i + d) for d in (-2, -1, 1, 2)])
        z = np.tanh(x @ net["w1"] + net["b1"]) @ net["w2"] + net["b2"]
        h = int(hashes[i])
        c, share = (number[h], vocab.log_share[number[h]]) if h in number else (len(z) - 1, -1.5)
        assert got[i] == pytest.approx(z[c] - np.log(np.exp(z).sum()) + share, abs=1e-4)


def test_word_scores_do_not_depend_on_what_is_scored_beside():
    """The same words have the same scores to the last bit, wherever they stand in a task's words."""
    rng = np.random.default_rng(1)
    vocab = pseudo_likelihood.Vocabulary(np.arange(200, dtype=np.uint64), np.arange(200), np.arange(200) % 150, np.zeros(200), -3.0)
    net = pseudo_likelihood.initial()
    words = rng.integers(0, 200, 37)
    alone = pseudo_likelihood.word_scores(words, np.array([0, 37]), vocab, net)
    for n in range(2000, 2060):
        beside = np.concatenate([rng.integers(0, 200, n), words])
        got = pseudo_likelihood.word_scores(beside, np.array([0, n, n + 37]), vocab, net)[n:]
        assert (got == alone).all(), n


def test_licenses(spark, docs, no_docs, clashing, texts):
    notices = [
        (1, "Some text here.\nLicensed under the Apache License, Version 2.0.\nMore prose.", ["apache"]),
        (2, "Copyright 2011 Somebody. All rights reserved.\nReleased under the MIT License.", ["mit", "proprietary"]),
        (3, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
            "General Public License as published by the Free Software Foundation, either version 3", ["gpl"]),
        (4, "The licence of the driver was under review, he reserved the right to park.", []),
        (5, None, []),
    ]
    table = spark.createDataFrame([(i, t) for i, t, _ in notices], "doc_id long, text string")
    model = licenses.fit(docs)
    assert licenses.LEAST_PROBABILITY <= model.threshold < 0.99
    # notices in order are believed, their words in another order are not
    rng = random.Random(3)
    lines = [(t, copy) for ts in licenses.TEMPLATES.values() for t in ts if len(t.split()) > 12 for copy in (True, False)]
    made = [(i, t if copy else " ".join(rng.sample(t.split(), len(t.split())))) for i, (t, copy) in enumerate(lines)]
    believed = licenses.scan(docs.sparkSession.createDataFrame(made, "doc_id long, text string"), model).collect()
    assert {r.doc_id: r.n_notices for r in believed} == {i: int(copy) for i, (_, copy) in enumerate(lines)}
    got = {r.doc_id: r for r in licenses.scan(table, model).collect()}
    assert {i: got[i].families for i, _, _ in notices} == {i: f for i, _, f in notices}
    assert got[1].notices[0].paragraph == 1 and got[1].n_notices == 1
    assert licenses.scan(no_docs, model).collect() == []
    plain = licenses.scan(clashing, model)
    assert [r.n_notices for r in plain.collect()] == [0] * len(texts)
    explained = plain._jdf.queryExecution().toString()
    assert "Python" not in explained and "Arrow" not in explained
    assert len(licenses.scan(docs, licenses.fit(no_docs)).collect()) == len(texts)
