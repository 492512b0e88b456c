"""The Merkle manifest against trees built in plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tallyshop.llm import merkle
from tallyshop.llm.queries import ORACLES, QUERIES
from tests.llm.conftest import SCHEMA, lowered


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    values = (*(row[c] for c in ("doc_id", "source", "lang", "n_chars")), text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climbed(digests):
    """The root of a run of digests, and for each the (before, after) of every level."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        runs = [level[i : i + 16] for i in range(0, len(level), 16)]
        for leaf, node in enumerate(at):
            run = runs[node // 16]
            paths[leaf].append(("".join(run[: node % 16]), "".join(run[node % 16 + 1 :])))
            at[leaf] = node // 16
        level = [sha("".join(run)) for run in runs]
    return level[0], paths


def brute(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row["source"], []).append(row)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees, out = {}, []
    for source in order:
        members = sorted(
            ((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"]), i) for i, r in enumerate(groups[source])),
        )
        trees[source] = members, *climbed([m[2] for m in members])
    root, upper = climbed([trees[s][1] for s in order]) if order else (None, [])
    for source, above in zip(order, upper, strict=True):
        members, subroot, paths = trees[source]
        for (_, _, leaf, i), path in zip(members, paths, strict=True):
            row, path = groups[source][i], path + above
            text, doc_id = row["text"], row["doc_id"]
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0 and text is not None:
                text = lowered(text)
            folded = leaf_of(row, text)
            for before, after in path:
                folded = sha(before + folded + after)
            proof = sha("".join(b + a for b, a in path))
            out.append((doc_id, leaf, subroot, root, proof, folded, folded == root))
    return sorted(out, key=str)


@pytest.fixture
def found(spark, tmp_path):
    def run(frame):
        frame.write.parquet(f"{tmp_path}/documents.parquet", mode="overwrite")
        result = QUERIES["op11_merkle"](spark, str(tmp_path))
        assert result.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        return sorted(map(tuple, result.collect()), key=str)

    return run


def test_query_is_the_definition(docs, found):
    titled = docs.withColumn("text", F.initcap("text"))
    rows = found(titled)
    assert rows == brute(titled.collect())
    assert {r[6] for r in rows} == {True, False}


def test_deep_and_shallow_trees(spark, found):
    rng = random.Random(9)
    sizes = {"a": 1, "b": 16, "c": 17, "d": 256, "é": 257, "B": 700, "": 2, None: 33}
    rows = [(s, n) for s, k in sizes.items() for n in range(k)] + [(f"s{i:03}", 0) for i in range(30)]
    ids = rng.sample(range(10**6), len(rows))
    data = [(i, f"Text {n}", None, s, n) for i, (s, n) in zip(ids, rows, strict=True)]
    frame = spark.createDataFrame(data, SCHEMA).repartition(7)
    assert found(frame) == brute(frame.collect())


def test_null_and_repeated_rows(docs, found):
    odd = docs.selectExpr("if(doc_id % 4 = 0, null, doc_id % 9) AS doc_id", "text", "lang", "source", "n_chars")
    both = odd.union(odd)
    assert found(both) == brute(both.collect())


def test_one_row_is_its_own_root(spark, found):
    frame = spark.createDataFrame([(1, None, None, None, None)], SCHEMA)
    [row] = found(frame)
    assert row[1] == row[2] == row[3] == row[5] and row[4] == sha("") and row[6]


def test_no_rows(no_docs, found):
    assert found(no_docs) == []


def test_other_columns_are_kept(docs):
    rows = docs.select("doc_id", "source", F.lit("x").alias("lo"), F.lit("y").alias("digest"), F.lit(1).alias("key"))
    rows = rows.withColumn("leaf", merkle.digest_of([F.col("doc_id")]))
    proved = merkle.manifest(rows)
    assert proved.columns == [*rows.columns, "subroot", "root", "path"]
    got = proved.select("lo", "digest", "key", (merkle.fold("path", "leaf") == F.col("root")).alias("ok")).distinct().collect()
    assert [tuple(r) for r in got] == [("x", "y", 1, True)]


def test_query_and_sql(spark, star_dir, star_db):
    star_db.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{star_dir}/documents.parquet'")
    rows = sorted(map(tuple, QUERIES["op11_merkle"](spark, star_dir).collect()))
    assert rows == sorted(star_db.execute(ORACLES["op11_merkle"]).fetchall())
