"""Operators with one right answer, against brute force."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyshop.llm import decontamination, graph, mixing, near_duplicates, passages, quality_rules
from tests.llm.conftest import ALNUM, PLAIN, lowered


def components_of(texts, n, percent):
    sets = {}
    for i, t in enumerate(texts):
        w = PLAIN.findall(lowered(t))
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sets, {i: find(i) for i in sets}


@pytest.mark.parametrize("n", [4, 5])
def test_near_duplicates(docs, texts, n):
    sets, component = components_of(texts, n, 80)
    got = near_duplicates.near_duplicates(docs, shingle_words=n).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {
        i: (len(s), component[i], component[i] == i) for i, s in sets.items()
    }


def test_near_duplicates_of_a_large_family(spark):
    """A base with many copies that differ pairwise, and many documents sharing one passage."""
    import random

    rng = random.Random(1)
    words = [f"w{i}" for i in range(900)]
    base, passage = [rng.choice(words) for _ in range(150)], [rng.choice(words) for _ in range(50)]
    texts = []
    for _ in range(60):
        copy = list(base)
        for _ in range(3):
            copy[rng.randrange(150)] = rng.choice(words)
        texts.append(" ".join(copy))
    for _ in range(60):
        texts.append(" ".join([rng.choice(words) for _ in range(25)] + passage + [rng.choice(words) for _ in range(9)]))
    sets, component = components_of(texts, 4, 80)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = near_duplicates.near_duplicates(df, shingle_words=4).collect()
    assert {r.doc_id: r.component_id for r in got} == component


def test_near_duplicates_of_odd_tables(docs, no_docs, clashing):
    assert near_duplicates.near_duplicates(no_docs).collect() == []
    plain = near_duplicates.near_duplicates(docs).select("doc_id", "component_id")
    twice = near_duplicates.near_duplicates(clashing.union(clashing)).select("doc_id", "component_id")
    assert sorted(plain.collect()) == sorted(twice.collect())


def test_near_duplicates_under_null_and_shared_ids(spark):
    """Rows equal in id and text are one; other rows are documents of their own."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    c = " ".join(f"c{i}" for i in range(60))
    rows = [(1, a), (1, b), (2, a), (3, b), (None, a), (None, c), (None, c + " more"), (7, "x y"), (7, "x y"), (8, None)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string")
        got = near_duplicates.near_duplicates(df, shingle_words=4).collect()
        found = sorted(((r.doc_id, r.component_id) for r in got), key=lambda r: (r[0] is None, r[0] or 0, r[1] or 0))
        assert found == [(1, 1), (1, 1), (2, 1), (3, 1), (7, 7), (8, 8), (None, None), (None, None), (None, 1)]
        assert sorted(r.doc_id for r in got if r.kept and r.doc_id is not None) == [1, 1, 7, 8]
        assert [r.component_id for r in got if r.kept and r.doc_id is None] == [None]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (200, 201), (200, 201)]
    got = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    expected = {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90, 200: 200, 201: 200}
    assert {r.id: r.component for r in got} == expected and len(got) == len(expected)
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def repeats_of(texts, window):
    seen, out = set(), {}
    for i, t in enumerate(texts):
        w, gone = PLAIN.findall(t or ""), set()
        for j in range(len(w) - window + 1):
            key = tuple(w[j : j + window])
            if key in seen:
                gone.update(range(j, j + window))
            seen.add(key)
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


@pytest.mark.parametrize("window", [8, 20])
def test_repeated_passages(docs, texts, window):
    got = passages.remove_repeats(docs, window=window).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in got} == repeats_of(texts, window)
    assert all(sum(b - a for a, b in r.spans) == r.n_removed for r in got)


def test_repeated_passages_of_odd_tables(no_docs, clashing, texts):
    assert passages.remove_repeats(no_docs).collect() == []
    got = passages.remove_repeats(clashing).collect()
    assert {r.doc_id: r.n_removed for r in got} == {i: x[1] for i, x in repeats_of(texts, 20).items()}


def test_passages_are_found_by_the_automata(docs, monkeypatch):
    """Without the places that the automata tell, nothing is found."""
    monkeypatch.setattr(passages, "_located", lambda hashes, places: places[:0])
    assert {r.n_removed for r in passages.remove_repeats(docs).collect()} == {0}


def test_passages_with_whole_rows(docs, texts):
    """Rows follow their result as they came, and texts are shuffled once."""
    got = passages.remove_repeats(docs, whole=True)
    assert sorted((r.doc_id, r.n_removed) for r in got.collect()) == [
        (i, x[1]) for i, x in sorted(repeats_of(texts, 20).items())
    ]
    assert sorted(map(str, got.select("row.*").collect())) == sorted(map(str, docs.collect()))


def hits_of(texts, items, window):
    windows = {}
    for item, text in items:
        w = ALNUM.findall(lowered(text))
        n = min(window, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[j : j + n]), set()).add(item)
    out = {}
    for i, t in enumerate(texts):
        w, hit, found = ALNUM.findall(lowered(t)), set(), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                key = tuple(w[j : j + n])
                if key in windows:
                    hit.update(range(j, j + n))
                    found |= windows[key]
        out[i] = (len(w), len(hit), len(found), ",".join(sorted(map(str, found))))
    return out


def test_contamination(spark, docs, no_docs, clashing, texts):
    words = texts[9].split()
    items = [(1, " ".join(words[5:40])), (2, "two words"), (11, " ".join(words[100:])), (3, None), (4, ""), (5, "one"),
             (6, "not in any document at all but long enough"), (7, " ".join(words[50:60]).upper()), (2, "two words"), (None, "one")]
    tests = spark.createDataFrame(items, "item_id long, text string")
    expected = hits_of(texts, [x for x in items if x[0] is not None], 10)
    for table in (docs, clashing):
        got = decontamination.digest(decontamination.contamination(table, tests)).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == {
            i: (a, b, c, hashlib.sha256(d.encode()).hexdigest(), b > 0) for i, (a, b, c, d) in expected.items()
        }
    assert decontamination.contamination(no_docs, tests).collect() == []
    none = decontamination.contamination(docs, tests.limit(0)).collect()
    assert len(none) == len(texts) and all(r.n_hit == 0 for r in none)


def measures_of(text):
    w = PLAIN.findall(text or "")
    grams = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
    times, covered = Counter(grams), set()
    for j, g in enumerate(grams):
        if times[g] > 1:
            covered.update((j, j + 1, j + 2))
    lines = [x for x in (text or "").split("\n") if PLAIN.search(x)]
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered), failed


def test_quality_measures(docs, no_docs, clashing, texts):
    for table in (docs, clashing):
        got = quality_rules.quality(table).collect()
        assert {
            r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got
        } == {i: measures_of(t) for i, t in enumerate(texts)}
        assert not any(r.kept and r.base_failed for r in got)
    assert quality_rules.quality(no_docs).collect() == []


def test_cascade_order_changes_nothing(docs):
    rows = quality_rules.measure(docs)
    rules = quality_rules.default_rules()
    one = quality_rules.cascade(rows, rules).select("doc_id", F.col("rejected_by").isNull().alias("k"))
    two = quality_rules.cascade(rows, rules[::-1]).select("doc_id", F.col("rejected_by").isNull().alias("k"))
    assert sorted(one.collect()) == sorted(two.collect())
    explained = quality_rules.quality(docs)._jdf.queryExecution().toString()
    assert "Python" not in explained and "Arrow" not in explained


def test_fill_targets():
    got = mixing.fill_targets({"a": 10, "b": 100, "c": 100}, {"a": 5, "b": 2, "c": 1}, 315, 2)
    assert got["a"] == 20 and got["b"] == pytest.approx(295 * 2 / 3) and got["c"] == pytest.approx(295 / 3)
    full = mixing.fill_targets({"a": 10, "b": 20}, {"a": 1, "b": 1}, 500, 2)
    assert full == {"a": 20, "b": 40}


def test_flow_reroutes_overlapping_patterns():
    tokens = {("a",): 10, ("a", "b"): 10, ("b",): 0}
    flow = mixing.min_cost_flow(tokens, {"a": 15.0, "b": 10.0}, 2)
    given = Counter()
    for (_, s), x in flow.items():
        given[s] += x
    assert given == {"a": 15.0, "b": 10.0}
    # nothing is repeated before everything is used once
    used = Counter()
    for (p, _), x in flow.items():
        used[p] += x
    assert used[("a",)] + used[("a", "b")] == 25 and min(used[("a",)], used[("a", "b")]) >= 10


def test_mix(docs, no_docs, clashing, texts):
    def mixed(table):
        return {r.doc_id: r for r in mixing.mix(table, F.array("source"), (5, 2, 1)).collect()}

    got = mixed(docs)
    assert {i: r["size"] for i, r in got.items()} == {i: len(PLAIN.findall(t or "")) for i, t in enumerate(texts)}
    sums = {}
    for r in got.values():
        x = sums.setdefault(r.pattern[0], [0, 0, r.pattern_target, r.pattern_size, 0])
        x[0] += r["size"]
        x[1] += r.taken
        x[4] = max(x[4], r["size"])
        assert r.taken in (0, r["size"], 2 * r["size"])
    for size, taken, target, pattern_size, largest in sums.values():
        assert size == pattern_size and abs(taken - target) <= largest / 2 + 1
    assert sum(x[2] for x in sums.values()) == pytest.approx(1.5 * sum(x[0] for x in sums.values()))
    assert {i: r.taken for i, r in mixed(clashing).items()} == {i: r.taken for i, r in got.items()}
    assert mixed(no_docs) == {}
