"""The corpus pipeline: rules, near-dedup, decontamination, personal data, tokens.

STAGES are run in order, each on the Parquet that its predecessor left. Each but
the last returns the columns of documents, whatever else they are named, with the
caller's values; the last the ids, lang, source and token ids.

Edge cases: null, empty and short texts fail the base rules; of exact copies and
of rows equal in all columns one stays, of the smallest id (nulls last); rows
that repeat an id with another text are documents of their own; very long texts
go through whole; an empty table, or an empty benchmark, gives what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkwell.llm import bpe, decontamination, pii, quality_rules, simhash
from inkwell.llm.common import documents, kept_after


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality rules reject."""
    return quality_rules.passed(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return simhash.representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark items."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data and what gives it away."""
    return pii.sanitise(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the token ids of each document."""
    return bpe.encode(docs.select("doc_id", "lang", "source", "text")).drop("text")


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("pii", sanitise),
    ("bpe", tokenise),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage gives of documents. What stages and operators save on the way is deleted when it is done."""
    docs = documents(spark, sf_dir)
    with kept_after(spark, "pipeline") as keep:
        for name, stage in STAGES[:-1]:
            with kept_after(spark, name) as keep_stage:
                docs = keep_stage(stage(spark, docs, sf_dir))
        return keep(STAGES[-1][1](spark, docs, sf_dir))


#: Fingerprints, templates and token ids have no SQL form; tests/llm/test_pipeline.py holds the stages and run() against the same by hand.
ORACLE_SQL = None
