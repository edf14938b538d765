"""Benchmark definitions: nested JSON to question and page tables.

Definitions are read as variants, since an option that is there wins over a default even where it is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LISTS = {"expected_answer_contains": "string", "expected_citation_pages": "int", "expected_citation_text_contains": "string"}


def read(spark: SparkSession, path: str) -> DataFrame:
    """A definition a file, as a variant."""
    return spark.read.option("multiLine", True).option("singleVariantColumn", "definition").json(path)


def field(v: Column | str, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def option(name: str, kind: str, default: Column, *places: Column) -> Column:
    """An option from the first of places (variants) that has it: a null that is there is null. The default if none has it."""
    first = F.coalesce(*(field(p, name) for p in places))
    return F.when(first.isNull(), default).otherwise(F.try_variant_get(first, "$", kind))


def _documents(definitions: DataFrame) -> DataFrame:
    return definitions.select("definition", F.posexplode(field("definition", "documents", "array<variant>")).alias("document_place", "d"))


def questions(definitions: DataFrame) -> DataFrame:
    """benchmark, filename, where the question stands, and its fields; options come from the question, else its document, else the benchmark."""
    each = _documents(definitions).select("definition", "document_place", "d", F.posexplode(field("d", "questions", "array<variant>")).alias("question_place", "q"))
    q = F.col("q")
    tier = F.lower(F.trim(option("regression_tier", "string", F.lit("gating"), q, field("d", "defaults"), field("definition", "defaults"))))
    checked = F.when(tier.isin("gating", "exploratory"), tier).otherwise(F.raise_error(F.concat(F.lit("unknown tier: "), F.coalesce(tier, F.lit("null")))).cast("string"))
    none = F.lit(None).cast("string")
    return each.select(
        field("definition", "name", "string").alias("benchmark"),
        field("d", "filename", "string").alias("filename"),
        "document_place",
        "question_place",
        field(q, "question", "string").alias("question"),
        field(q, "expected_supported", "boolean").alias("expected_supported"),
        *(field(q, name, f"array<{kind}>").alias(name) for name, kind in LISTS.items()),
        option("citation_match_mode", "string", F.lit("any"), q).alias("citation_match_mode"),
        option("citation_text_match_mode", "string", none, q).alias("citation_text_match_mode"),
        checked.alias("regression_tier"),
    )


def pages(definitions: DataFrame) -> DataFrame:
    """document_id, page_number (from 1), raw_text of the documents that hold their pages; those that name a PDF come from
    that. A document with neither is an error."""
    docs = _documents(definitions).select(field("d", "filename", "string").alias("document_id"), field("d", "source_pdf", "string").alias("pdf"), field("d", "pages", "array<string>").alias("own"))
    none = F.raise_error(F.concat(F.lit("neither pages nor source_pdf: "), F.coalesce("document_id", F.lit("?"))))
    own = F.when(F.col("pdf").isNotNull(), F.array().cast("array<string>")).when(F.col("own").isNull(), none.cast("array<string>")).otherwise(F.col("own"))
    each = docs.select("document_id", F.posexplode(own).alias("n", "raw_text"))
    return each.select("document_id", (F.col("n") + 1).alias("page_number"), "raw_text")
