"""The filter audit against a brute-force replay of every order."""

import re
from collections import defaultdict
from itertools import permutations

import numpy as np
import pytest

from tallyshop.llm import filter_audit
from tests.llm.conftest import PLAIN, SCHEMA

LABELS = "doc_id long, quality int, toxic int"


def _failures(rows):
    smallest = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            smallest[text or ""] = min(doc_id, smallest.get(text or "", doc_id))
    for doc_id, text, *_ in rows:
        text = text or ""
        words = PLAIN.findall(text)
        first = smallest.get(text)
        yield {
            f
            for f, fails in {
                "A": len(words) < 100,
                "B": 100 * len(set(words)) < 80 * len(words),
                "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
                "D": re.search("[#$%&*|]", text),
                "E": first is not None and (doc_id is None or doc_id > first),
            }.items()
            if fails
        }


def replayed(rows, labels):
    """Every order applied to every document, one filter after the other."""
    marks = defaultdict(lambda: [False, False])
    for doc_id, quality, toxic in labels:
        marks[doc_id][0] |= quality == 1
        marks[doc_id][1] |= toxic == 1
    out, shapley = {}, defaultdict(int)
    docs = [
        (lang or "", fails, *(marks[doc_id] if doc_id is not None else (False, False)))
        for (doc_id, _, lang, *_), fails in zip(rows, _failures(rows), strict=True)
    ]
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                redundant = sum(f in d[1] for d in own) - len(gone)
                left = [d for d in left if f not in d[1]]
                out[part, "".join(order), step] = [
                    len(left), len(gone), redundant, sum(d[1] == {f} for d in own),
                    sum(d[2] for d in gone), sum(d[3] for d in gone),
                ]
                shapley[part, f] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def _found(spark, docs, labels):
    frame = filter_audit.audit(filter_audit.patterns(docs, spark.createDataFrame(labels, LABELS)))
    assert frame.columns[:3] == ["part", "filter_order", "step"]
    rows = frame.collect()
    found = {(r[0], r[1], r[2]): tuple(r)[3:] for r in rows}
    assert len(found) == len(rows)
    return found


def _rows(docs):
    return [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]


LABELLED = [(i, i % 2, i % 3 % 2) for i in range(0, 50, 2)] + [(4, 1, None), (4, None, 1), (None, 1, 1), (999, 1, 1)]


def test_audit_is_a_replay_of_all_orders(spark, docs):
    assert _found(spark, docs, LABELLED) == replayed(_rows(docs), LABELLED)


def test_null_and_repeated_ids(spark, docs):
    shared = docs.selectExpr("if(doc_id % 5 = 0, null, doc_id % 7) AS doc_id", "text", "lang", "source", "n_chars")
    both = shared.union(shared)
    assert _found(spark, both, LABELLED) == replayed(_rows(both), LABELLED)


def test_copies_in_other_parts_and_none(spark):
    rows = [(3, "one two", "en", None, 7), (2, "one two", "fr", None, 7), (9, None, "fr", None, 0), (8, "", None, None, 0)]
    found = _found(spark, spark.createDataFrame(rows, SCHEMA), [])
    assert found == replayed(rows, [])
    # step 5 is the copy filter: the smallest id passes it, in whatever part it is
    assert found["en", "BCDAE", 5][2] == 1 and found["fr", "BCDEA", 4][1] == 1


def test_other_columns_and_no_rows(spark, docs, clashing, no_docs):
    assert _found(spark, clashing, LABELLED) == _found(spark, docs, LABELLED)
    assert _found(spark, no_docs, LABELLED) == {}
    assert _found(spark, docs, [])["en", "ABCDE", 1][4:6] == (0, 0)


def test_steps_are_the_earliest_failed_filter():
    rng = np.random.default_rng(3)
    masks = rng.random((40, 4)) < 0.4
    _, order, places = filter_audit._places("abcd")
    steps = filter_audit.removal_steps(masks, places)
    for p, mask in enumerate(masks):
        for o, row in enumerate(order):
            assert steps[p, o] == next((i for i, f in enumerate(row) if mask[f]), 4)


def test_unknown_filters_are_refused(spark):
    counts = spark.createDataFrame([("en", "AZ", False, False, 1)], "part string, failed string, good boolean, toxic boolean, n long")
    with pytest.raises(Exception, match="other than"):
        filter_audit.audit(counts).collect()
    with pytest.raises(ValueError, match="different letters"):
        filter_audit.audit(counts, "AA")


def test_query_and_sql(spark, star_dir, star_db):
    from tallyshop.llm.queries import ORACLES, QUERIES

    for name in ("documents", "labels"):
        star_db.execute(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{star_dir}/{name}.parquet'")
    found = sorted(map(tuple, QUERIES["op13_filter_audit"](spark, star_dir).collect()))
    assert found == sorted(star_db.execute(ORACLES["op13_filter_audit"]).fetchall())
