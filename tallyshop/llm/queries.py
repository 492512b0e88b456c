"""The operators over the driver's tables, by name, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyshop.llm import (
    decontamination,
    filter_audit,
    language,
    licenses,
    merkle,
    mixing,
    near_duplicates,
    ngram_join,
    oracles,
    passages,
    pseudo_likelihood,
    quality_rules,
    site_quality,
    toxicity,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share 80% of their distinct 4-word shingles."""
    found = near_duplicates.near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=4)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = language.identify(docs, language.fit(docs.where(~language.held_out())))
    return found.select(
        "doc_id", F.coalesce(language.held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score"
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (_table(spark, sf_dir, name) for name in ("documents", "labels"))
    scored = toxicity.score(docs, toxicity.fit(docs, labels.where(~language.held_out())))
    return scored.select(
        "doc_id",
        F.coalesce(language.held_out(), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op5_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts and paths come from the pages whose address ends in the document's id; other
    documents belong to their source."""
    docs, labels, pages = (_table(spark, sf_dir, name) for name in ("documents", "labels", "pages"))
    address = r"^[a-z]+://([^/?#:]+)(?::\d+)?/(?:([^/?#]*)/)?(\d+)"
    found = pages.select(
        F.regexp_extract("url", address, 3).try_cast("long").alias("doc_id"),
        F.regexp_extract("url", address, 1).alias("host"),
        F.regexp_extract("url", address, 2).alias("path"),
    ).where("doc_id IS NOT NULL")
    listed = found.groupBy("doc_id").agg(F.min(F.struct("host", "path")).alias("s"))
    sites = docs.select("doc_id", "source", "lang").join(listed, "doc_id", "left").select(
        "doc_id",
        F.coalesce("s.host", "source").alias("host"),
        F.coalesce("s.path", "lang").alias("path"),
    )
    learned = labels.where(~language.held_out())
    return site_quality.site_quality(docs, learned, sites, site_quality.fit(docs, learned))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), F.array("source"), (5, 2, 1))
    return mixed.select(
        "doc_id",
        "size",
        F.col("pattern_size").alias("source_size"),
        F.col("pattern_target").alias("target"),
        "taken",
    )


def op8_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by the network fitted on all of them."""
    return pseudo_likelihood.fit_and_score(_table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (_table(spark, sf_dir, name) for name in ("documents", "benchmark"))
    return decontamination.digest(decontamination.contamination(docs, items))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return licenses.scan(docs, licenses.fit(docs))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the manifest, and whether the document as it is found, with
    one in five tampered with, still gives the root."""
    docs = _table(spark, sf_dir, "documents")
    columns = ["doc_id", "source", "lang", "n_chars"]
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    leaf, changed = (
        merkle.digest_of([*map(F.col, columns), text])
        for text in (F.col("text"), merkle.ascii_lower(F.col("text")))
    )
    rows = docs.select(
        "doc_id", "source", leaf.alias("leaf"), F.when(tampered, changed).alias("changed")
    )
    found = merkle.manifest(rows).withColumn("found", F.coalesce("changed", "leaf"))
    return found.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        merkle.siblings_digest("path").alias("proof_sha256"),
        merkle.fold("path", "found").alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share 85% of their distinct 4-word shingles."""
    return ngram_join.similar_documents(_table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters in all 120 orders over all documents, counted per language."""
    docs, labels = (_table(spark, sf_dir, name) for name in ("documents", "labels"))
    return filter_audit.audit(filter_audit.patterns(docs, labels))


QUERIES = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_language": op2_language,
    "op3_quality_rules": op3_quality_rules,
    "op4_toxicity": op4_toxicity,
    "op5_site_quality": op5_site_quality,
    "op6_substrings": op6_substrings,
    "op7_mix_sources": op7_mix_sources,
    "op8_pseudo_likelihood": op8_pseudo_likelihood,
    "op9_decontamination": op9_decontamination,
    "op10_licenses": op10_licenses,
    "op11_merkle": op11_merkle,
    "op12_ngram_join": op12_ngram_join,
    "op13_filter_audit": op13_filter_audit,
}
ORACLES: dict[str, str] = {
    "op1_near_duplicates": oracles.NEAR_DUPLICATES,
    "op3_quality_rules": oracles.QUALITY,
    "op6_substrings": oracles.PASSAGES,
    "op9_decontamination": oracles.DECONTAMINATION,
    "op11_merkle": oracles.MERKLE,
    "op12_ngram_join": oracles.NGRAM_JOIN,
    "op13_filter_audit": oracles.AUDIT,
}
