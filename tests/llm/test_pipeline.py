"""The pipeline against its stages worked out by brute force."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tests.llm.conftest import ALNUM, PLAIN, lowered
from tests.llm.test_exact_operators import components_of, hits_of, repeats_of


def test_stages_on_driver_tables(spark, star_dir):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = spark.read.parquet(f"{star_dir}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{star_dir}/benchmark.parquet").collect()]
    rows = {r.doc_id: r for r in docs.collect()}
    table = docs
    for name, stage in pipeline.STAGES[:-1]:
        table = stage(spark, table, star_dir).cache()
        assert table.columns == columns
        after = {r.doc_id: r for r in table.collect()}
        ids = sorted(rows)
        texts = [rows[i].text for i in ids]
        if name == "language":
            assert set(after) == set(ids)
        elif name == "near_duplicates":
            _, component = components_of(texts, 5, 80)
            assert set(after) == {ids[i] for i, c in component.items() if c == i}
        elif name == "substrings":
            repeats = repeats_of(texts, 20)
            assert {i: r.text for i, r in after.items()} == {
                ids[i]: kept if gone else texts[i] for i, (_, gone, _, kept) in repeats.items()
            }
        else:
            hits = hits_of(texts, items, 10)
            assert set(after) == {ids[i] for i, x in hits.items() if x[1] == 0}
        rows = after
    mixed = pipeline.STAGES[-1][1](spark, table, star_dir).collect()
    assert {r.copies for r in mixed} <= {1, 2}
    used = sum(r.copies * len(PLAIN.findall(r.text)) for r in mixed)
    total = sum(len(PLAIN.findall(r.text or "")) for r in rows.values())
    assert abs(used - 1.5 * total) < 0.1 * total


@pytest.mark.parametrize("stage", [name for name, _ in pipeline.STAGES])
def test_stages_with_clashing_columns(spark, star_dir, stage):
    """Further columns keep their values, whatever they are called."""
    run = dict(pipeline.STAGES)[stage]
    docs = spark.read.parquet(f"{star_dir}/documents.parquet")
    names = ["_key", "kept_text", "copies", "lang_pred", "lang_score", "spans", "size", "taken", "row", "rest", "own", "id", "n"]
    wide = docs
    for name in names:
        wide = wide.withColumn(name, F.concat(F.lit(f"{name} of "), F.col("doc_id").cast("string")))
    out = run(spark, wide, star_dir)
    assert out.columns[: len(wide.columns)] == wide.columns
    rows = out.collect()
    assert rows and all(r[wide.columns.index(name)] == f"{name} of {r.doc_id}" for r in rows for name in names)
    assert {r.doc_id for r in rows} == {r.doc_id for r in run(spark, docs, star_dir).collect()}


def test_run_on_odd_tables(spark, docs, no_docs, tmp_path):
    for i, table in enumerate((docs, no_docs)):
        table.write.parquet(f"{tmp_path}/{i}/documents.parquet")
        spark.createDataFrame([(1, "nothing of this occurs in any of these documents")], "item_id long, text string").write.parquet(
            f"{tmp_path}/{i}/benchmark.parquet"
        )
    out = pipeline.run(spark, f"{tmp_path}/0").collect()
    assert out and all(ALNUM.findall(lowered(r.text)) for r in out)
    assert pipeline.run(spark, f"{tmp_path}/1").collect() == []
