"""A corpus from raw documents: one operator after the other, each over all that is left.

The stages after the first work by an internal key of each row (``keyed``), so documents with a
null id, and different documents under one id, are checked, kept or dropped as any other;
they come after those with an id of their own. Rows equal in all columns are one document.
Further columns are kept as they are, whatever their names.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyshop.llm import decontamination, language, mixing, near_duplicates, passages
from tallyshop.llm.keys import keyed
from tallyshop.llm.storage import shared_folder

KEY = "_key"
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")

#: Below this score a language is a guess between the runner-ups.
LEAST_LANGUAGE_SCORE = 0.05


def plain_names(stage: Callable) -> Callable:
    """The stage with the further columns of its documents under names that no operator uses.
    A column that the stage adds has underscores appended where the documents have its name."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        inside = [c if c in DOCUMENT else f"_further_{i}" for i, c in enumerate(docs.columns)]
        out = stage(spark, docs.toDF(*inside), sf_dir)
        names = list(docs.columns)
        for added in out.columns[len(names) :]:
            while added in names:
                added += "_"
            names.append(added)
        return out.toDF(*names)

    return run


@plain_names
def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; the label column takes the prediction. Documents
    without a letter, and those scored below ``LEAST_LANGUAGE_SCORE``, go."""
    model = language.fit(docs.where(~language.held_out()))
    found = language.identify_rows(docs, model).where(
        (F.col("lang_pred") != "und") & (F.col("lang_score") >= LEAST_LANGUAGE_SCORE)
    )
    return found.withColumn("lang", F.col("lang_pred")).select(docs.columns)


def with_keys(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows with their key, and one row of ``(key, text)`` per key."""
    rows, repeated = keyed(docs, "doc_id", [c for c in docs.columns if c != "doc_id"], KEY)
    once = rows.select(KEY, "text")
    return rows, once.dropDuplicates([KEY]) if repeated else once


@plain_names
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id, null ids last) of each group of near duplicates, in one
    row; documents without a word are no duplicates and stay, in all their rows."""
    rows, repeated = keyed(docs, "doc_id", [c for c in docs.columns if c != "doc_id"], KEY)
    gone = near_duplicates.near_duplicates(rows, id_col=KEY).where("NOT kept").select(KEY)
    left = rows.join(gone, KEY, "left_anti").select(docs.columns)
    if repeated:
        worded = F.coalesce(F.col("text").rlike(mixing.WORDS), F.lit(False))
        left = left.where(worded).dropDuplicates().union(left.where(~worded))
    return left


@plain_names
def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; in those that repeat a passage of another one, the remaining words,
    joined by spaces."""
    rows, _ = keyed(docs, "doc_id", [c for c in docs.columns if c != "doc_id"], KEY)
    found = passages.remove_repeats(rows, id_col=KEY, whole=True)
    changed, row = F.col("n_removed") > 0, F.col("row")
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return found.select(
        *(
            (F.when(changed, new[c]).otherwise(row[c]) if c in new else row[c]).alias(c)
            for c in docs.columns
        )
    )


@plain_names
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows, once = with_keys(docs)
    hit = decontamination.contamination(once, items, id_col=KEY).where("n_hit > 0").select(KEY)
    return rows.join(hit, KEY, "left_anti").select(docs.columns)


@plain_names
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with ``copies``, the times each is used. Rows equal in all
    columns are mixed each, and those taken are one row with their copies added up."""
    rows, repeated = keyed(docs, "doc_id", [c for c in docs.columns if c != "doc_id"], KEY)
    mixed = mixing.mix(rows, F.array("source"), (5, 2, 1), id_col=KEY).where("taken > 0")
    taken = mixed.select(KEY, (F.col("taken") / F.col("size")).cast("int").alias("copies"))
    if repeated:
        taken = taken.groupBy(KEY).agg(F.sum("copies").cast("int").alias("copies"))
        rows = rows.dropDuplicates()
    return rows.join(taken, KEY).select(*docs.columns, "copies")


STAGES = [
    ("language", identify_languages),
    ("near_duplicates", drop_near_duplicates),
    ("substrings", drop_repeated_passages),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: Languages are learned, so SQL cannot express the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table through all stages, each written as Parquet in the shared folder
    and read again by the next one."""
    folder = os.path.join(shared_folder(spark), f"corpus-{uuid.uuid4().hex}")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
