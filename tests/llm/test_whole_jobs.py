"""Input that operators once did less than the whole job on."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline as pipeline
from tallyshop.llm import decontamination, language, licenses, passages, pseudo_likelihood
from tests.llm.test_exact_operators import hits_of, repeats_of


@pytest.mark.parametrize(
    "item",
    ["NASA launched the rocket", "HELLO WORLD", "iPhone and eBay", "I saw A b", "X", "ÉTÉ À Paris", "a-B c_D"],
)
def test_short_items_with_capitals(spark, item):
    """One item at a time, so that no other one has its length."""
    texts = [f"before it {item} after it", item.lower(), item.upper(), "nothing of the kind", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = decontamination.digest(decontamination.contamination(docs, items)).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in got} == {
        i: (a, b, c, hashlib.sha256(d.encode()).hexdigest()) for i, (a, b, c, d) in hits_of(texts, [(7, item)], 10).items()
    }
    assert got and any(r.contaminated for r in got)


def test_mixed_languages_pass_the_stage(spark):
    """Half and half, and 60 to 40 with a majority whose words the other language has too."""
    rng = random.Random(8)
    left, right = ["abra", "tabra", "kazam", "zaba"], ["olmen", "hulpe", "kinder", "ulmer"]

    def prose(words, n):
        return " ".join(rng.choice(words) for _ in range(n))

    rows = [(2 * i, prose(left, 60), "x") for i in range(40)]
    rows += [(2 * i + 1, prose(right + left[:2], 60), "y") for i in range(40)]
    mixed = [(1000 + i, n, m) for i in range(20) for n, m in [((50, 50), (60, 40), (40, 60))[i % 3]]]
    rows += [(i, prose(left, n) + " " + prose(right, m), None) for i, n, m in mixed]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang for r in pipeline.identify_languages(spark, docs, "").collect()}
    assert {i for i, _, _ in mixed} <= set(got)
    assert all(got[i] == ("x" if n > m else "y") for i, n, m in mixed if n != m)
    model = language.fit(docs.where("doc_id < 1000"))
    found = {r.doc_id: r for r in language.identify(docs, model).collect()}
    for i, n, m in mixed:
        assert abs(found[i].score - max(n, m) / (n + m)) < 0.05


def test_passages_of_repeated_rows(docs, texts):
    """Equal rows are one document, in one slice or in several."""
    expected = sorted((i, *x[:3]) for i, x in repeats_of(texts, 20).items())
    for twice in (docs.union(docs), docs.union(docs).coalesce(1), docs.union(docs).repartition(7)):
        got = passages.remove_repeats(twice).collect()
        assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(expected * 2)


def test_passages_of_null_and_shared_ids(spark):
    rng = random.Random(5)
    one, two, three = (" ".join(rng.choice("abcdefgh") + str(rng.randrange(99)) for _ in range(n)) for n in (60, 40, 50))
    rows = [(1, one), (None, one), (2, two), (2, three + " " + two), (2, three + " " + two), (None, "few words")]
    got = passages.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and sorted(r.n_removed for r in got if r.doc_id is None) == [0, 60]
    assert [r.n_removed for r in got if r.doc_id == 1] == [0]
    # one of the two texts under id 2 keeps the shared words, both rows of the longer one alike
    removed = {(r.n_words, r.n_removed) for r in got if r.doc_id == 2}
    assert removed in ({(40, 0), (90, 40)}, {(40, 40), (90, 0)})


NOTICES = [
    (1, "Some text here.\nLICENSED UNDER THE MIT LICENSE.\nMore prose.", ["mit"]),
    (2, "ALL RIGHTS RESERVED.", ["proprietary"]),
    (3, "Released under the MIT License.\nsome prose", ["mit"]),
    (4, "THE LICENCE OF THE DRIVER WAS UNDER REVIEW", []),
    (None, "Licensed under the Mozilla Public License, version 2.0.", ["mozilla"]),
    (None, None, []),
    (5, "All rights reserved.", ["proprietary"]),
    (5, "Licensed under CC BY-SA 4.0.", ["creative_commons"]),
]


@pytest.mark.parametrize("copies", [1, 2, 5])
def test_licenses_of_capitals_and_repeated_rows(spark, docs, copies):
    # a third of its bigrams are the template's: no notice, however often the row is there
    part = "Released under the MIT terms which nobody there had read to the end"
    table = spark.createDataFrame([(i, t) for i, t, _ in NOTICES] * copies + [(9, part)] * copies, "doc_id long, text string")
    got = licenses.scan(table, licenses.fit(docs)).collect()
    assert sorted(str((r.doc_id, r.families)) for r in got) == sorted(
        [str((i, f)) for i, _, f in NOTICES] * copies + [str((9, []))] * copies
    )
    assert all(n.match <= 1 and n.probability <= 1 for r in got for n in r.notices or [])


def test_each_word_is_a_target_once(monkeypatch):
    """Over the rounds, the targets are the words of the corpus, none left out or taken twice."""
    texts = ["a b c d e f g h " * 40, "one", "", None, " ".join(f"w{i % 70}" for i in range(900))]
    count = sum(len((t or "").split()) for t in texts)
    vocab = pseudo_likelihood.Vocabulary(np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(0, int), np.zeros(0), -1.0)
    seen = []
    monkeypatch.setattr(pseudo_likelihood, "_learn", lambda net, context, target, rate: seen.append(len(target)))
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["id", "text"])
    (batch,) = pseudo_likelihood._numbered(vocab, [rows])
    for round_ in range(pseudo_likelihood.ROUNDS):
        list(pseudo_likelihood._train_copies(round_)((vocab, pseudo_likelihood.initial()), [batch]))
    assert sum(seen) == count
    hashes, inside = np.arange(5000, dtype=np.uint64), np.arange(5000) % 97
    assert set(pseudo_likelihood._round_of(hashes, inside)) == set(range(pseudo_likelihood.ROUNDS))


def test_rare_words_have_the_shares_of_their_counts(spark, monkeypatch):
    """Among the words beyond the vocabulary, the shares are counts over the sum of counts."""
    monkeypatch.setattr(pseudo_likelihood, "VOCABULARY", 4)
    often = {"alpha": 500, "beta": 400, "gamma": 300, "delta": 200}
    rare = {"seven": 7, "three": 3, "single": 1, "other": 1}
    text = " ".join(" ".join([w] * n) for w, n in (often | rare).items())
    vocab, counts = pseudo_likelihood.vocabulary(spark.createDataFrame([(text,)], "text string"))
    monkeypatch.undo()
    assert vocab.rare == pytest.approx(-np.log(12)) and len(vocab.hashes) == 4
    words = ["seven", "three", "single", "unseen", "alpha", "seven seven three", "", None]
    rows = list(enumerate(words)) + [(0, "seven"), (None, "seven"), (50, "seven seven three")]
    net = {k: np.zeros_like(v) for k, v in pseudo_likelihood.initial().items()}
    got = pseudo_likelihood.score(
        spark.createDataFrame(rows, "doc_id long, text string").repartition(3), (vocab, net, counts)
    ).collect()
    classes = float(np.log(pseudo_likelihood._CLASSES))
    share = {w: np.log(n / 12) for w, n in rare.items()} | {"unseen": np.log(1 / 12), "alpha": 0.0}
    expected = [sum(share[w] - classes for w in (t or "").split()) for _, t in rows]
    assert len(got) == len(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    for r, (i, x) in zip(
        sorted(((r.doc_id, r.pseudo_log_likelihood) for r in got), key=key),
        sorted(zip([i for i, _ in rows], expected, strict=True), key=key),
        strict=True,
    ):
        assert r[0] == i and r[1] == pytest.approx(x, abs=1e-4)
    for r in got:
        assert (r.per_token is None) == (r.n_tokens == 0)


def prose_of(rng, n):
    return " ".join(rng.choice("bcdfgklmnp") + rng.choice("aeiou") + str(rng.randrange(99)) for _ in range(n))


def test_contamination_of_null_ids(spark):
    rng = random.Random(3)
    item, clean = prose_of(rng, 30), prose_of(rng, 30)
    docs = spark.createDataFrame([(None, item), (None, clean), (None, None), (1, item), (1, clean)], "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = decontamination.contamination(docs, items).collect()
    assert sorted((r.doc_id is None, r.n_words, r.n_hit) for r in got) == [
        (False, 30, 0), (False, 30, 30), (True, 0, 0), (True, 30, 0), (True, 30, 30)
    ]


@pytest.fixture(scope="module")
def stages_dir(spark, tmp_path_factory):
    """Null ids, two documents under one id, repeated rows, a benchmark copy without an id."""
    rng = random.Random(12)
    item, shared = prose_of(rng, 30), prose_of(rng, 40)
    rows = [(i, prose_of(rng, 60)) for i in range(12)]
    rows += [(None, prose_of(rng, 60)), (None, prose_of(rng, 60)), (3, prose_of(rng, 60))]
    rows += [(None, rows[5][1]), (None, item + " " + prose_of(rng, 30))]
    rows += [(20, prose_of(rng, 50) + " " + shared), (None, shared + " " + prose_of(rng, 50))]
    rows += [(21, "under twenty words but a few"), (None, None), (22, " ")]
    folder = str(tmp_path_factory.mktemp("stages"))
    table = [(i, t, "en", "src0", len(t or "")) for i, t in rows]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, table


@pytest.mark.parametrize("copies", [1, 2])
def test_stages_of_null_and_repeated_ids(spark, stages_dir, copies):
    folder, table = stages_dir
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs = docs.union(docs) if copies == 2 else docs
    stages = dict(pipeline.STAGES)

    def rows_of(df):
        return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)

    def plain(rows, times=1):
        return sorted([(r[0], r[1]) for r in rows] * times, key=str)

    # one row of each document is left; the copy of document 5 without an id goes
    worded = [r for r in table if r[1] and r[1].strip()]
    kept = [r for r in worded if not (r[0] is None and r[1] == table[5][1])]
    blank = [r for r in table if r not in worded]
    near = stages["near_duplicates"](spark, docs, folder)
    assert rows_of(near) == sorted(plain(kept) + plain(blank, copies), key=str)

    # each row stays; the shared passage goes from the one without an id, as does document 5's copy
    cut = {}
    for r in stages["substrings"](spark, docs, folder).collect():
        cut.setdefault((r.doc_id, r.source, len((r.text or "").split())), []).append(r)
    assert sum(map(len, cut.values())) == copies * len(table)
    assert len(cut[None, "src0", 50]) == copies and len(cut[20, "src0", 90]) == copies
    clean = [r for r in table if not (r[0] is None and r[1] and len(r[1].split()) == 60 and r[1].startswith(item_of(spark, folder)))]
    assert rows_of(stages["decontamination"](spark, docs, folder)) == plain(clean, copies)

    # what is mixed is used one and a half times, null ids with it
    mixed = stages["mixing"](spark, docs, folder).collect()
    used, total = sum(r.copies * len(r.text.split()) for r in mixed), copies * sum(len((r[1] or "").split()) for r in table)
    assert abs(used - 1.5 * total) <= 100
    assert sorted(((r.doc_id, r.text) for r in mixed), key=str) == plain(worded)


def item_of(spark, folder):
    return spark.read.parquet(f"{folder}/benchmark.parquet").first().text


def test_pipeline_of_repeated_rows(spark, stages_dir, tmp_path):
    folder, _ = stages_dir
    for name, copies in (("once", 1), ("twice", 2)):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        (docs.union(docs) if copies == 2 else docs).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    # the model of the first stage sees other counts, so the texts are compared
    once, twice = (pipeline.run(spark, f"{tmp_path}/{n}").collect() for n in ("once", "twice"))
    assert {(r.doc_id, r.text) for r in once} == {(r.doc_id, r.text) for r in twice} and len(once) == len(twice)
    assert any(r.doc_id is None for r in once)
