"""The queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, language, licences, near_duplicates, packing, quality, secrets, sharding, simhash, sql, urls
from .common import Scratch, documents


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_path())


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_documents(documents(spark, sf_dir))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.find_documents(documents(spark, sf_dir))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(documents(spark, sf_dir))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.overlaps(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), shortest=1)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_documents(documents(spark, sf_dir))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_documents(documents(spark, sf_dir))


def licences_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op10 that SQL can express."""
    return op10_licences(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def secrets_rescan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs of blob and rule version each of four scans with one ledger reads: all documents, the same again,
    the same and an edited version of each, and all of them once a rule has a new version."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    both = docs.unionByName(docs.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" edited"))))
    changed = tuple(dataclasses.replace(r, version=2) if r.kind == "hex" else r for r in secrets.RULES)
    ledger = secrets.Ledger(spark, f"{Scratch(spark).base}/ledger")
    done = [ledger.scan(docs), ledger.scan(docs), ledger.scan(both), ledger.scan(both, changed)]
    return spark.createDataFrame([*enumerate(done, 1)], "scan int, n_pairs long")


QUERIES = {f.__name__: f for f in (op1_quality, op2_packing, op3_sharding, op4_simhash, op5_near_duplicates, op6_secrets, op7_urls, op8_decontamination, op9_language, op10_licences, licences_base, secrets_rescan)}

# DuckDB has no hash that Spark has besides md5 and sha256, no trained models and no tokenizers: the other
# operators are tested against plain versions in tests/llm.
ORACLE_SQL = {"op3_sharding": sql.SHARDS, "op5_near_duplicates": sql.NEAR, "op6_secrets": sql.SECRETS, "op7_urls": sql.URLS, "op8_decontamination": sql.LEAKS, "licences_base": sql.LICENCES, "secrets_rescan": sql.RESCAN}
