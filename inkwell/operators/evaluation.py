"""Evaluation as tables: hits, summaries, comparisons, reports; and the status of ingestion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

HITS = ["retrieval_hit", "citation_hit", "citation_text_hit", "support_hit", "answer_hit"]
#: Metrics of quality; all but the evidence rate count as a regression when they fall.
QUALITY = ["retrieval_hit_rate", "citation_hit_rate", "citation_evidence_hit_rate", "gating_citation_evidence_hit_rate", "support_accuracy", "answer_match_rate", "unsupported_precision"]
GATING = [m for m in QUALITY if m != "citation_evidence_hit_rate"]
LATENCY = ["average_latency_ms", "latency_p50_ms", "latency_p95_ms"]
BUFFER_MS = 10.0
SUMMARY = [
    "questions", "gating_questions", "exploratory_questions", *QUALITY, *LATENCY,
    "predicted_unsupported_count", "expected_unsupported_count", "failure_count", "gating_failure_count", "exploratory_failure_count",
]


def failed() -> Column:
    return ~(F.col(HITS[0]) & F.col(HITS[1]) & F.col(HITS[2]) & F.col(HITS[3]) & F.col(HITS[4]))


def failures(results: DataFrame) -> DataFrame:
    return results.filter(failed())


def summary(results: DataFrame, *keys: str) -> DataFrame:
    """SUMMARY of result rows, by keys or of all: rates are 0 without rows, those over a part of them null."""
    rate = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    gating, other, no = F.col("tier") == "gating", F.col("tier") == "exploratory", ~F.col("supported")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    values = [
        F.count("*"), F.count_if(gating), F.count_if(other),
        rate(F.col("retrieval_hit")), rate(F.col("citation_hit")), rate(F.col("citation_text_hit")), F.avg(F.when(gating, F.col("citation_text_hit").cast("double"))),
        rate(F.col("support_hit")), rate(F.col("answer_hit")), F.count_if(no & ~F.col("expected_supported")) / F.nullif(F.count_if(no), F.lit(0)),
        zero(F.avg("latency_ms")), zero(F.percentile("latency_ms", 0.5)), zero(F.percentile("latency_ms", 0.95)),
        F.count_if(no), F.count_if(~F.col("expected_supported")), F.count_if(failed()), F.count_if(failed() & gating), F.count_if(failed() & other),
    ]
    return results.groupBy(*keys).agg(*(v.alias(n) for v, n in zip(values, SUMMARY, strict=True)))


def per_document(results: DataFrame) -> DataFrame:
    gating, other = F.col("tier") == "gating", F.col("tier") == "exploratory"
    counts = {"gating_questions": gating, "exploratory_questions": other, "gating_failures": gating & failed(), "exploratory_failures": other & failed()}
    return results.groupBy("document").agg(F.count("*").alias("questions"), *(F.count_if(c).alias(n) for n, c in counts.items()))


def compare(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """metric, current, baseline, delta and regressed of two summaries: quality must not fall, latency not rise by BUFFER_MS."""
    long = lambda df, name: df.select(*(F.col(c).cast("double").alias(c) for c in QUALITY + LATENCY)).unpivot([], QUALITY + LATENCY, "metric", name)
    both = long(current, "current").join(long(baseline, "baseline"), "metric").withColumn("delta", F.col("current") - F.col("baseline"))
    worse = F.when(F.col("metric").isin(LATENCY), F.col("delta") >= BUFFER_MS).when(F.col("metric").isin(GATING), F.col("delta") < 0).otherwise(False)
    return both.withColumn("regressed", F.coalesce(worse, F.lit(False)))


def best(summaries: DataFrame, name: str, place: str) -> DataFrame:
    """The name of the summary with the best quality, then the least latency, then the first place. A missing metric counts as the least."""
    quality = [F.coalesce(F.col(c), F.lit(float("-inf"))).alias(c) for c in GATING]
    return summaries.agg(F.max_by(name, F.struct(*quality, -F.col("average_latency_ms"), -F.col("latency_p95_ms"), -F.col(place))).alias(name))


def report(metrics: dict[str, Column]) -> Column:
    """Rows of a Markdown table: counts as they are, rates with three decimals."""
    one = lambda c: F.when(F.typeof(c) == "double", F.coalesce(tx.printed(c.cast("double"), 3), F.lit("null"))).otherwise(c.cast("string"))
    return F.concat_ws("\n", *(F.concat(F.lit(f"| {n} | "), one(c), F.lit(" |")) for n, c in metrics.items()))


def normal_excerpt(text: Column) -> Column:
    """An excerpt as it is compared: plain quotes and dashes, single blanks, without case, nothing within $ 1, 1 % or ( 1 )."""
    t = F.replace(F.lower(tx.collapse(F.translate(text, "‐‑‒–—―−‘’“”", "-------''\"\""))), F.lit("ß"), F.lit("ss"))
    for pattern, by in ((r"\s-+\s", " - "), (r"\$\s+", r"\$"), (r"\s+%", "%"), (r"\(\s+", "("), (r"\s+\)", ")")):
        t = F.regexp_replace(t, pattern, by)
    return t


def page_hit(expected: Column, actual: Column, mode: str) -> Column:
    """Whether any, or all, of the expected pages are there; none expected is a hit."""
    held = F.size(F.array_except(expected, actual)) == 0 if mode == "all" else F.arrays_overlap(expected, actual)
    return (F.size(expected) == 0) | held


def text_hit(expected: Column, actual: Column, mode: str) -> Column:
    """The same for normalised texts, by containment."""
    found = lambda t: F.exists(actual, lambda a: F.contains(a, t))
    return (F.size(expected) == 0) | (F.forall(expected, found) if mode == "all" else F.exists(expected, found))


def tier(raw: Column, strict: bool = True) -> Column:
    """gating or exploratory; of anything else an error, or null."""
    said = F.lower(F.trim(raw))
    other = F.raise_error(F.concat(F.lit("unknown tier: "), raw)).cast("string") if strict else F.lit(None).cast("string")
    return F.when(said.isin("gating", "exploratory"), said).otherwise(other)


def verdict(text: Column) -> Column:
    """supported and reason of an answer whose first line says SUPPORTED or UNSUPPORTED; nulls otherwise."""
    lines = F.filter(F.transform(F.split(text, r"\R"), lambda x: F.trim(x)), lambda x: x != "")

    def of(l: Column) -> Column:
        first = F.upper(F.coalesce(F.get(l, F.lit(0)), F.lit("")))
        yes, no = first.startswith("SUPPORTED"), first.startswith("UNSUPPORTED")
        reason = F.array_join(F.slice(l, 2, F.greatest(F.size(l), F.lit(1))), " ")
        return F.struct(F.when(yes, True).when(no, False).alias("supported"), F.when(yes | no, reason).alias("reason"))

    return tx.let(lines, of)


def ingested(documents: DataFrame, text: str, least_tokens: int = 1) -> DataFrame:
    """documents with status and error, in place of an exception: a text that gave nothing, and one that can't be embedded."""
    tokens = F.size(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))
    error = F.when(F.trim(F.coalesce(F.col(text), F.lit(""))) == "", "PDF extraction failed.").when(tokens < least_tokens, "Embedding generation failed.")
    return documents.withColumn("error", error).withColumn("status", F.when(F.col("error").isNull(), "ready").otherwise("failed"))
