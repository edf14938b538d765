"""The training-data queries that __spark_entry__ registers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, centroids, decontamination, langid, merkle, pii, quality_classifier, quality_rules, repeats, secret_scan, sharding, simhash, sql, token_files
from .common import documents, kept_after


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tidy(spark: SparkSession, name: str, query) -> DataFrame:
    """The rows of a query that saves tables on the way, which are deleted once it is done."""
    with kept_after(spark, name) as keep:
        return keep(query())


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.digests(documents(spark, sf_dir))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.digests(documents(spark, sf_dir))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digests(documents(spark, sf_dir))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(documents(spark, sf_dir))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(documents(spark, sf_dir))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(documents(spark, sf_dir))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tidy(spark, "manifest", lambda: merkle.digests(documents(spark, sf_dir)))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tidy(spark, "clusters", lambda: centroids.digests(_table(spark, sf_dir, "embeddings")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_decontamination,
        op3_quality_rules,
        op4_token_files,
        op5_simhash,
        op6_bpe,
        op7_pii,
        op8_sharding,
        op9_repeats,
        op10_langid,
        op11_secret_scan,
        op12_merkle_manifest,
        op13_centroids,
    )
}

#: The others hang on fingerprints, hashes, models or permutations; tests/llm holds them against brute force.
ORACLE_SQL = {"op12_merkle_manifest": sql.MANIFEST, "op13_centroids": sql.CLUSTERS}
