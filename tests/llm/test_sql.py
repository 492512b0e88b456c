"""Corpus queries against their SQL on the driver's tables."""

import pytest

from tallyshop.llm.queries import ORACLES, QUERIES

TESTED_ELSEWHERE = {"op11_merkle", "op12_ngram_join", "op13_filter_audit"}


@pytest.mark.parametrize("name", sorted(set(ORACLES) - TESTED_ELSEWHERE))
def test_query_is_its_sql(spark, star_dir, star_db, name):
    for table in ("documents", "benchmark"):
        star_db.execute(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM '{star_dir}/{table}.parquet'")
    found = QUERIES[name](spark, star_dir)
    expected = star_db.execute(ORACLES[name])
    assert found.columns == [c[0] for c in expected.description]
    assert sorted(map(tuple, found.collect())) == sorted(expected.fetchall())
