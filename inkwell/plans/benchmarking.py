"""Evaluation of the engine by definitions: questions of known pages and texts, asked of chunk tables of one or more presets.

A run is one dataflow over a grid of presets and questions. Pages are cleaned once; each preset cuts its chunks from
them under document ids of its own, so that all questions of all presets are asked together, each of its document in its preset."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import chunks, evaluation
from ..sources import benchmarks
from ..sources.scratch import saved, tidied
from . import asking
from .registry import QUERIES


@dataclass(frozen=True)
class Run:
    """results: a row for each preset and question; summaries: one for each preset; traces: what failed, with its whole answer."""

    results: DataFrame
    summaries: DataFrame
    traces: DataFrame

    def per_document(self, preset: str) -> DataFrame:
        return evaluation.per_document(self.results.filter(F.col("preset") == preset))

    def recommended(self) -> DataFrame:
        """preset: the one with the best quality, then the least latency, then the first."""
        return evaluation.best(self.summaries, "preset", "place")


def cases(definitions: DataFrame) -> DataFrame:
    """number, document, question, its tier and what is expected of its answer, of benchmark definitions. An option of the
    question wins over its document's and the benchmark's; several expected texts must all be cited unless it says otherwise."""
    q = benchmarks.questions(definitions)
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>"))
    texts = F.filter(F.transform(none(F.col("expected_citation_text_contains"), "string"), F.trim), lambda t: t != "")
    return q.select(
        F.row_number().over(Window.orderBy("benchmark", "document_place", "question_place")).cast("long").alias("number"),  # a definition's questions are a short list
        F.col("filename").alias("document"),
        "question",
        F.col("regression_tier").alias("tier"),
        "expected_supported",
        none(F.col("expected_answer_contains"), "string").alias("answer_terms"),
        none(F.col("expected_citation_pages"), "int").alias("expected_pages"),
        texts.alias("expected_texts"),
        F.coalesce("citation_match_mode", F.lit("any")).alias("page_mode"),  # a null mode is not "all"
        F.coalesce("citation_text_match_mode", F.when(F.size(texts) > 1, "all").otherwise("any")).alias("text_mode"),
    )


def run(questions: DataFrame, pages: DataFrame, presets: dict[str, chunks.Chunking] | None = None, k: int = 5) -> Run:
    """questions: as of cases(); pages: document_id, page_number, raw_text of the documents that they name.

    Questions are answered together, so each has the mean of the run as its latency."""
    presets = presets or chunks.PRESETS
    clean = saved(chunks.normalise_pages(pages), "pages")
    own = lambda preset, c: F.concat(F.lit(f"{preset}/"), c)
    parts = None
    for preset, config in presets.items():
        cut = chunks.build_chunks(clean, config).withColumn("document_id", own(preset, F.col("document_id")))
        parts = cut if parts is None else parts.unionByName(cut)
    grid = F.explode(F.array(*(F.struct(F.lit(p).alias("preset"), F.lit(i).cast("long").alias("place")) for i, p in enumerate(presets)))).alias("g")
    asked = saved(questions.select("*", grid).select("*", "g.*", (F.col("number") * len(presets) + F.col("g.place")).alias("item_id")).drop("g"), "cases")
    began = time.perf_counter()
    got = asking.ask(asked.select("item_id", F.col("question").alias("text"), F.concat_ws("/", "preset", "document").alias("document_id")), parts, k)
    answers = saved(got.answers, "answers")
    each_ms = (time.perf_counter() - began) * 1000 / max(1, answers.count())
    spans = lambda xs: F.array_sort(F.array_distinct(F.flatten(F.transform(xs, lambda x: F.sequence(x["page_start"], x["page_end"])))))
    found = got.hits.groupBy("item_id").agg(F.collect_list(F.struct("page_start", "page_end")).alias("hits"))
    both = asked.join(answers, "item_id").join(found, "item_id", "left")
    both = both.withColumns({
        "retrieved_pages": spans(F.coalesce("hits", F.array().cast(found.schema["hits"].dataType))), "cited_pages": spans(F.col("citations")),
        "cited_texts": F.filter(F.transform("citations", lambda c: F.trim(c["text"])), lambda t: t != ""), "latency_ms": F.lit(each_ms),
    })
    results = saved(both.select(*RESULT, *judge(both)), "results")
    traces = evaluation.failures(results).select("preset", "number").join(both.select("preset", "number", "answer", "supported", "mode", "route", "outcome", "confidence", "support", "coverage", "citations", "claims"), ["preset", "number"])
    return Run(results, evaluation.summary(results, "preset", "place"), traces)


RESULT = ["preset", "place", "number", "document", "question", "tier", "expected_supported", "supported", "mode", "route", "coverage", "expected_pages", "expected_texts", "retrieved_pages", "cited_pages", "cited_texts", "latency_ms"]


def judge(rows: DataFrame) -> list[Column]:
    """The hits of each answer, and how it begins."""
    by_mode = lambda hit, expected, actual, mode: F.when(F.col(mode) == "all", hit(expected, actual, "all")).otherwise(hit(expected, actual, "any"))
    plain = lambda xs: F.transform(xs, evaluation.normal_excerpt)
    expected = F.col("expected_pages")
    said = F.exists("answer_terms", lambda t: F.contains(F.lower("answer"), F.lower(t)))
    return [
        by_mode(evaluation.page_hit, expected, F.col("retrieved_pages"), "page_mode").alias("retrieval_hit"),
        by_mode(evaluation.page_hit, expected, F.col("cited_pages"), "page_mode").alias("citation_hit"),
        by_mode(evaluation.text_hit, plain("expected_texts"), plain("cited_texts"), "text_mode").alias("citation_text_hit"),
        (F.col("supported") == F.col("expected_supported")).alias("support_hit"),
        ((F.size("answer_terms") == 0) | said).alias("answer_hit"),
        F.substring("answer", 1, 240).alias("answer_preview"),
    ]


def gate(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """passed, and the metrics that regressed, of a summary against an earlier one."""
    deltas = evaluation.compare(current, baseline)
    return deltas.agg((F.count_if("regressed") == 0).alias("passed"), F.array_sort(F.collect_list(F.when(F.col("regressed"), F.col("metric")))).alias("regressed"))


def comparison_report(made: Run, name: str, k: int, presets: dict[str, chunks.Chunking] | None = None) -> DataFrame:
    """The comparison of presets as one Markdown text (column report), presets in their order."""
    presets = presets or chunks.PRESETS
    config = F.create_map(*(x for p, c in presets.items() for x in (F.lit(p), F.lit(f'{{"target_words": {c.target}, "min_words": {c.least}, "overlap_words": {c.overlap}, "max_heading_words": {c.heading}}}'))))
    line = lambda said, c, form="%.3f": F.concat(F.lit(f"- {said}: `"), F.coalesce(F.format_string(form, c), F.lit("n/a")), F.lit("`"))
    rates = [line(m.replace("_", " ").capitalize(), F.col(m)) for m in evaluation.QUALITY]
    times = [line(said, F.col(m), "%.2f ms") for said, m in zip(("Average latency", "p50 latency", "p95 latency"), evaluation.LATENCY, strict=True)]
    section = F.concat_ws("\n", F.concat(F.lit("## "), "preset"), F.lit(""), F.concat(F.lit("- Chunking: `"), config[F.col("preset")], F.lit("`")), *rates, *times)
    sections = made.summaries.agg(F.array_sort(F.collect_list(F.struct("place", section.alias("said")))).alias("l"))
    best = made.recommended().first()["preset"]
    head = F.concat_ws("\n", F.lit(f"# Chunking Preset Comparison: {name}"), F.lit(""), F.lit(f"- Top k: `{k}`"), F.lit(f"- Recommended preset: `{best}`"), F.concat(F.lit("- Recommended chunking: `"), config[F.lit(best)], F.lit("`")))
    return sections.select(F.concat(F.concat_ws("\n\n", head, F.array_join(F.transform("l", lambda x: x["said"]), "\n\n")), F.lit("\n")).alias("report"))


def conversation_cases(c: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Questions and pages of conversations: a turn is a page, and each conversation is asked what its last turn begins with."""
    pages = c.select(F.col("conv_id").cast("string").alias("document_id"), (F.col("turn") + 1).cast("int").alias("page_number"), F.coalesce("text", F.lit("")).alias("raw_text"))
    last = pages.groupBy("document_id").agg(F.max_by(F.struct("page_number", "raw_text"), "page_number").alias("x"))
    words = F.slice(F.filter(F.split("x.raw_text", r"\s+"), lambda w: w != ""), 1, 12)
    known = last.filter(F.size(words) > 2).select(F.col("document_id").cast("long").alias("number"), F.col("document_id").alias("document"), F.array_join(words, " ").alias("question"), F.col("x.page_number").alias("page"))
    none = F.array().cast("array<string>")
    return (
        known.select(
            "number", "document", "question", F.when(F.col("number") % 5 == 0, "exploratory").otherwise("gating").alias("tier"), F.lit(True).alias("expected_supported"),
            none.alias("answer_terms"), F.array("page").alias("expected_pages"), none.alias("expected_texts"), F.lit("any").alias("page_mode"), F.lit("any").alias("text_mode"),
        ),
        pages,
    )


def gr18_preset_sweep(spark, sf_dir: str) -> DataFrame:
    """Every conversation asked for its last turn, by three presets: the summary of each, without its times."""
    questions, pages = conversation_cases(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return run(questions, pages).summaries.drop("place", *evaluation.LATENCY)


QUERIES["gr18_preset_sweep"] = lambda spark, sf_dir: tidied(spark, "gr18_preset_sweep", lambda: gr18_preset_sweep(spark, sf_dir))
