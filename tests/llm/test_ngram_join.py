"""The n-gram join against comparing all pairs of sets."""

import random

import numpy as np
import pytest

from tallyshop.llm import ngram_join
from tallyshop.llm.queries import ORACLES, QUERIES
from tests.llm.conftest import PLAIN, SCHEMA, lowered


def shingles(text, n=4):
    words = PLAIN.findall(lowered(text))
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def brute(rows, percent=85):
    sets = [shingles(text) for _, text in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x] = root[root[x]]
        return x

    for x, a in enumerate(sets):
        for y in range(x):
            b = sets[y]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                if 100 * len(a & b) >= percent * len(a | b):
                    root[find(x)] = find(y)
    ids = {}
    for x, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            ids[find(x)] = min(doc_id, ids.get(find(x), doc_id))
    return sorted(
        ((doc_id, len(sets[x]), ids.get(find(x)) if sets[x] else doc_id) for x, (doc_id, _) in enumerate(rows)), key=str
    )


def found(docs, **options):
    result = ngram_join.similar_documents(docs, **options)
    assert result.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted(map(tuple, result.collect()), key=str)


def rows_of(docs):
    return [tuple(r) for r in docs.select("doc_id", "text").collect()]


def family(rng, n, words, changes, shared=0.0):
    """Texts that differ from one by a few words each, with a common passage in front."""
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    front = [f"common{i}" for i in range(int(words * shared))]
    for _ in range(n):
        text = list(base)
        for _ in range(rng.randrange(changes + 1)):
            text[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        yield " ".join(front + text)


def table(spark, texts):
    rows = [(i, t, None, None, len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_odd_texts(docs):
    assert found(docs) == brute(rows_of(docs))


def test_families_around_the_bound(spark):
    rng = random.Random(5)
    texts = [t for i in range(12) for t in family(rng, 8, rng.choice((9, 30, 120, 400)), 2 + i % 5, 0.4 * (i % 2))]
    texts += ["a b c d e", "a b c d e f", "b c d e f", "A  b\nc\td", "a b c", "a b c ", "A B C"]
    rng.shuffle(texts)
    docs = table(spark, texts)
    result = found(docs)
    assert result == brute(rows_of(docs))
    assert 20 < len({r[2] for r in result}) < len(texts) - 20


def test_exactly_the_bound(spark):
    # 17 of 20 shingles shared: 100 * 17 = 85 * 20; one less is too few
    def text(shared, own, name):
        return " ".join(f"s{i}" for i in range(shared + 3)) + " " + " ".join(f"{name}{i}" for i in range(own))

    assert found(table(spark, [text(17, 3, "a"), text(17, 0, "b")]))[1][2] == 0
    assert found(table(spark, [text(17, 4, "a"), text(17, 0, "b")]))[1][2] == 1


@pytest.mark.parametrize("sets", [2, 7])
def test_lists_and_clusters_in_chunks(spark, monkeypatch, sets):
    monkeypatch.setattr(ngram_join, "CHUNK_SETS", sets)
    rng = random.Random(sets)
    # similar and merely related texts in one cluster, so that rounds and the last cells run
    texts = [t for w in (40, 40, 60) for t in family(rng, 12, w, 6, 0.5)] + list(family(rng, 30, 60, 2))
    docs = table(spark, texts)
    assert found(docs) == brute(rows_of(docs))


def test_null_and_repeated_ids(spark, docs):
    odd = docs.selectExpr("if(doc_id % 4 = 0, null, doc_id % 9) AS doc_id", "text", "lang", "source", "n_chars")
    both = odd.union(odd.where("doc_id < 3"))
    assert found(both) == brute(rows_of(both))


def test_other_columns_and_no_rows(docs, clashing, no_docs):
    assert found(clashing) == found(docs)
    assert found(no_docs) == []


def test_bitmaps_never_understate_the_overlap(spark):
    import pyarrow as pa

    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 600, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool, rng.integers(1, 500))) for _ in range(60)]
    maps = [ngram_join.bitmap(s) for s in sets]
    column = pa.array([m.view(np.int64).tolist() for m in maps], pa.list_(pa.int64()))
    bound = ngram_join._Overlap(column, np.array([len(s) for s in sets]))
    a, b = map(np.ravel, np.meshgrid(range(60), range(60)))
    for x, y, most in zip(a, b, bound.most(a, b), strict=True):
        n, m = len(sets[x]), len(sets[y])
        if 100 * min(n, m) >= 85 * max(n, m):
            assert most >= len(np.intersect1d(sets[x], sets[y]))


def test_trie_of_stored_sets_against_others():
    rng = np.random.default_rng(2)
    base = np.arange(1000, 1060, dtype=np.uint64)
    sets = []
    for _ in range(40):
        s = base.copy()
        s[rng.integers(0, 60, rng.integers(0, 9))] = rng.integers(0, 900, 1, dtype=np.uint64)
        sets.append(np.unique(s))
    sizes = np.array([len(s) for s in sets])
    offsets = np.append(0, np.cumsum(sizes))
    stored = np.arange(40) < 25
    links = list(ngram_join.trie_links(np.concatenate(sets), offsets, sizes, np.arange(40), stored, ~stored, 85))
    near = {
        (x, y)
        for x in range(25)
        for y in range(25, 40)
        if 185 * len(np.intersect1d(sets[x], sets[y])) >= 85 * (sizes[x] + sizes[y])
    }

    def components(pairs):
        root = list(range(40))
        for x, y in pairs:
            root = [root[x] if r == root[y] else r for r in root]
        return [[root.index(r) for r in root]]

    assert near and set(links) <= near and components(links) == components(near)


def test_query_and_sql(spark, star_dir, star_db):
    star_db.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{star_dir}/documents.parquet'")
    rows = sorted(map(tuple, QUERIES["op12_ngram_join"](spark, star_dir).collect()))
    assert rows == sorted(star_db.execute(ORACLES["op12_ngram_join"]).fetchall())
