"""An evaluation run from a definition: hits of real retrieval, presets, gate and report."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from inkwell.operators import chunks, evaluation
from inkwell.plans import benchmarking
from inkwell.sources import benchmarks

PUMP = ["Pump care\n\nPrime the field pump before long night watches.", "Upkeep\n\nOil the pump gears after each muddy crossing."]
DEFINITION = {
    "name": "yard",
    "defaults": {"regression_tier": "gating"},
    "documents": [
        {
            "filename": "pump.pdf",
            "pages": PUMP,
            "questions": [
                {"question": "What should happen before long night watches?", "expected_supported": True, "expected_answer_contains": ["Prime the field pump"], "expected_citation_pages": [1], "expected_citation_text_contains": ["prime the  field pump"]},
                {"question": "What should be oiled after muddy crossings?", "expected_supported": True, "expected_answer_contains": ["oil the pump gears"], "expected_citation_pages": [1], "citation_match_mode": "all"},
                {"question": "What does the manual say about whale migration routes?", "expected_supported": False, "regression_tier": "exploratory"},
            ],
        },
        {"filename": "stars.pdf", "pages": ["Stars\n\nStars shine because of fusion in their cores."], "defaults": {"regression_tier": "exploratory"}, "questions": [{"question": "Stars shine because of what?", "expected_supported": True, "expected_citation_pages": [1]}]},
    ],
}
PRESETS = {"small": chunks.PRESETS["small"], "default": chunks.PRESETS["default"]}


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("definition") / "yard.json"
    path.write_text(json.dumps(DEFINITION))
    definition = benchmarks.read(spark, str(path))
    return benchmarking.run(benchmarking.cases(definition), benchmarks.pages(definition), PRESETS, 4)


def test_results(made):
    by = {(r.preset, r.question): r for r in made.results.collect()}
    assert len(by) == 8
    for preset in PRESETS:
        r = by[preset, "What does the manual say about whale migration routes?"]
        assert (r.supported, r.support_hit, r.retrieval_hit, r.tier) == (False, True, True, "exploratory")
        r = by[preset, "Stars shine because of what?"]
        assert r.supported and r.tier == "exploratory" and r.cited_pages == [1]


def test_hits_are_of_real_retrieval(made):
    by = {(r.preset, r.question): r for r in made.results.collect()}
    good, page = DEFINITION["documents"][0]["questions"][:2]
    for preset in PRESETS:
        r = by[preset, good["question"]]
        assert all(r[h] for h in evaluation.HITS) and 1 in r.retrieved_pages and r.latency_ms > 0 and "Prime the field pump" in r.answer_preview
        # The answer is of page 2, page 1 was expected.
        r = by[preset, page["question"]]
        assert (r.retrieval_hit, r.citation_hit, r.support_hit, r.answer_hit, r.cited_pages) == (True, False, True, True, [2])
    failed = made.traces.collect()
    assert {(r.preset, r.outcome) for r in failed} == {(p, "accepted") for p in PRESETS} and all("Oil the pump gears" in r.answer and r.citations for r in failed)


def test_summaries_and_gate(made):
    by = {r.preset: r for r in made.summaries.collect()}
    for r in by.values():
        assert (r.questions, r.gating_questions, r.exploratory_questions, r.citation_hit_rate, r.gating_failure_count, r.failure_count) == (4, 2, 2, 0.75, 1, 1)
        assert (r.support_accuracy, r.unsupported_precision, r.predicted_unsupported_count) == (1.0, 1.0, 1)
    assert {r.document: r.questions for r in made.per_document("small").collect()} == {"pump.pdf": 3, "stars.pdf": 1}
    assert made.recommended().first().preset == "small"  # all alike: the first
    one = made.summaries.filter("preset = 'small'")
    assert benchmarking.gate(one, one).first() == (True, [])
    worse = one.withColumns({"citation_hit_rate": F.lit(0.5), "citation_evidence_hit_rate": F.lit(0.0), "latency_p95_ms": F.col("latency_p95_ms") + 10.5})
    assert tuple(benchmarking.gate(worse, one).first()) == (False, ["citation_hit_rate", "latency_p95_ms"])


def test_report(made):
    text = benchmarking.comparison_report(made, "yard", 4, PRESETS).first().report
    assert text.startswith("# Chunking Preset Comparison: yard\n") and "- Recommended preset: `small`" in text and '"target_words": 420' in text
    assert text.index("## small") < text.index("## default") and "- Citation hit rate: `0.750`" in text and " ms`" in text


def test_quality_comes_before_latency(spark):
    row = lambda p, i, q, ms: (p, i, *([q] * 7), ms, ms, ms)
    schema = "preset string, place long, " + ", ".join(f"{m} double" for m in evaluation.QUALITY + evaluation.LATENCY)
    best = lambda rows: evaluation.best(spark.createDataFrame(rows, schema), "preset", "place").first().preset
    assert best([row("small", 0, 1.0, 120.0), row("default", 1, 1.0, 100.0), row("large", 2, 0.9, 90.0)]) == "default"
    assert best([row("small", 0, 1.0, 100.0), row("default", 1, 1.0, 100.0)]) == "small"


def test_options_by_presence(spark, tmp_path):
    """A null that is there wins over a default further out, and is no tier."""
    q = {"question": "Why?", "expected_supported": True}
    made = {"name": "n", "defaults": {"regression_tier": " Exploratory "}, "documents": [{"filename": "f", "pages": ["one"], "questions": [q, q | {"regression_tier": "gating"}]}, {"filename": "g", "pages": ["x"], "defaults": {"regression_tier": "gating"}, "questions": [q | {"citation_match_mode": None, "expected_citation_pages": [2, 3]}]}]}

    def read(name):
        (tmp_path / name).write_text(json.dumps(made))
        return benchmarks.questions(benchmarks.read(spark, str(tmp_path / name)))

    got = read("a").orderBy("document_place", "question_place").collect()
    assert [(r.filename, r.regression_tier, r.citation_match_mode) for r in got] == [("f", "exploratory", "any"), ("f", "gating", "any"), ("g", "gating", None)]
    assert (got[2].expected_citation_pages, got[0].expected_citation_pages, got[0].citation_text_match_mode) == ([2, 3], None, None)
    assert [(r.number, r.document, r.page_mode, r.text_mode) for r in benchmarking.cases(benchmarks.read(spark, str(tmp_path / "a"))).orderBy("number").collect()] == [(1, "f", "any", "any"), (2, "f", "any", "any"), (3, "g", "any", "any")]
    made["documents"][1]["questions"][0]["regression_tier"] = None
    with pytest.raises(Exception, match="unknown tier: null"):
        read("b").collect()
