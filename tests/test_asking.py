"""Questions answered end to end from a few documents, and citations of given answers, by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from inkwell.operators import chunks, retrieval
from inkwell.plans import asking
from inkwell.plans.evidence import Given

PAGES = {
    "pump": ["Pump care\n\nPrime the field pump before long night watches.", "Upkeep\n\nOil the pump gears after each muddy crossing."],
    "stars": ["Stars\n\nStars shine because of fusion in their cores."],
    "ferry": ["Departure\n\nCheck the ferry ropes before leaving harbour.", "Mooring\n\nRinse the ferry deck after each stormy passage."],
    "alpha": ["Alpha handbook\n\nshared keyword onlyalpha"],
    "beta": ["Beta handbook\n\nshared keyword onlybeta"],
}
QUESTIONS = [
    (1, "What should happen before long night watches?", "pump"),
    (2, "What should be oiled after muddy crossings?", "pump"),
    (3, "What does the book say about whale migration routes?", "stars"),
    (4, "What should the crew do before leaving harbour and after a stormy passage?", "ferry"),
    (5, "What should happen before long night watches?", None),
    (6, "shared keyword onlybeta", "alpha"),
    (7, "", None),
    (8, None, "pump"),
    (9, "What should happen before long night watches?", "no such document"),
]


@pytest.fixture(scope="module")
def parts(spark):
    rows = [(d, n + 1, t) for d, ts in PAGES.items() for n, t in enumerate(ts)]
    return chunks.build_chunks(chunks.normalise_pages(spark.createDataFrame(rows, "document_id string, page_number int, raw_text string")))


@pytest.fixture(scope="module")
def asked(spark, parts):
    return asking.ask(spark.createDataFrame(QUESTIONS, "item_id long, text string, document_id string"), parts, 4)


@pytest.fixture(scope="module")
def answers(asked):
    return {r.item_id: r for r in asked.answers.collect()}


def test_each_question_has_a_row(answers):
    assert sorted(answers) == [q[0] for q in QUESTIONS]


def test_grounded_answer(answers):
    r = answers[1]
    assert (r.supported, r.mode, r.outcome, r.route) == (True, "extractive", "accepted", "extractive")
    assert "prime the field pump" in r.answer.lower() and r.confidence > 0.35 and r.support > 0 and r.n_hits >= 1
    assert r.claims and all(c.supported for c in r.claims)
    assert (r.citations[0].document_id, r.citations[0].page_start) == ("pump", 1) and "prime the field pump" in r.citations[0].text.lower()
    # Without a document named, the same answer is found among all.
    assert (answers[5].answer, answers[5].citations[0].document_id) == (r.answer, "pump")


def test_citations_follow_the_answer(answers):
    assert "oil the pump gears" in answers[2].answer.lower()
    assert [c.page_start for c in answers[2].citations] == [2]


def test_unsupported_by_the_route(answers):
    r = answers[3]
    assert (r.supported, r.mode, r.route, r.outcome, r.answer) == (False, "unsupported", "unsupported", "route", asking.REFUSAL)
    assert (r.confidence, r.support, r.coverage, r.citations, r.claims) == (0.78, 0.0, None, [], [])
    for i in (7, 8, 9):
        assert (answers[i].outcome, answers[i].n_hits, answers[i].answer) == ("route", 0, asking.REFUSAL)


def test_parts_of_a_question(answers):
    r = answers[4]
    assert r.supported and "check the ferry ropes" in r.answer.lower() and "rinse the ferry deck" in r.answer.lower()
    assert {c.page_start for c in r.citations} == {1, 2} and len(r.claims) == 2


def test_search_keeps_to_the_document(asked):
    found = asked.hits.select("item_id", "document_id").collect()
    named = {i: d for i, _, d in QUESTIONS}
    assert all(named[r.item_id] in (None, r.document_id) for r in found)
    assert {r.document_id for r in found if r.item_id == 6} == {"alpha"}
    assert len({r.document_id for r in found if r.item_id == 5}) > 1


def test_headings_count(spark, parts):
    q = spark.createDataFrame([(1, "Tell me of the harbour mooring", "ferry")], "item_id long, text string, document_id string")
    p = asking.passages(parts)
    hits = retrieval.search(q, p, 4).join(p.select("doc_id", "page_start"), "doc_id").orderBy("rank").collect()
    bare = {r.doc_id: r for r in retrieval.search(q, p.drop("heading"), 4).collect()}
    best = next(r for r in hits if r.page_start == 2)
    assert best["head"] == 1 and best.lexical_score > bare[best.doc_id].lexical_score and bare[best.doc_id]["head"] == 0


def contexts(spark, rows):
    schema = "item_id long, place long, document_id string, chunk_index long, page_start int, page_end int, text string, score double, lexical_score double, rerank double, token_estimate int"
    return asking.given(spark.createDataFrame(rows, schema))


def cited(spark, question, answer, rows, main):
    asked, held = Given(spark.createDataFrame([(1, question)], "item_id long, text string")), contexts(spark, rows)
    claims = asking.units(spark.createDataFrame([(1, answer, main)], "item_id long, answer string, main long"))
    return asking.cite(asked, held, claims).orderBy("place").collect()


def test_a_cause_brings_a_second_excerpt_of_the_page(spark):
    first = "Harbour revenue fell to $11.2 billion, driven mainly by a yearly rise of $50.7 billion in purchases of cranes and machinery, net of grants."
    second = "This rise mainly reflects investments in automated loading infrastructure and wider berths."
    other = "Crane spending will grow again in 2026."
    rows = [(1, i + 1, "d", i + 1, p, p, t, s, s, s, 20) for i, (t, p, s) in enumerate([(first, 2, 0.95), (second, 2, 0.9), (other, 3, 0.88)])]
    answer = "Harbour revenue fell because purchases of cranes and machinery rose, mainly reflecting investments in automated loading infrastructure."
    got = cited(spark, "Why did harbour revenue fall in 2025?", answer, rows, 1001)
    assert [r.context_id for r in got] == [1001, 1002] and "investments in automated loading" in got[1].text
    # Not so where no cause is asked for or given.
    plain = cited(spark, "What did harbour revenue do in 2025?", "Harbour revenue fell as purchases of cranes and machinery rose.", rows, 1001)
    assert [r.context_id for r in plain] == [1001]


def test_three_citations_at_most_and_merged(spark):
    said = [f"The {w} gate opens at noon near the {w} tower." for w in ("northern", "southern", "eastern", "western")]
    rows = [(1, i + 1, "d", i + 1, i + 1, i + 1, t, 0.9 - i / 100, 0.5, 0.5, 9) for i, t in enumerate(said)]
    got = cited(spark, "Which gates open at noon?", " ".join(said), rows, 1001)
    assert [r.context_id for r in got] == [1001, 1002, 1003]
    one = [(1, 1, "d", 1, 1, 1, " ".join(said), 0.9, 0.5, 0.5, 40)]
    got = cited(spark, "Which gates open at noon?", f"{said[0]} {said[2]}", one, 1001)
    assert len(got) == 1 and "northern" in got[0].text and "eastern" in got[0].text


def test_siblings_of_a_page(spark, parts):
    more = spark.createDataFrame([("t", 1, "Net sales\n\nNet sales in Q1 2024 were $9,100.\n\nOutlook\n\nStaff met in the yard.\n\nTotals\n\nQ1 2024 net sales and returns stood at $9,050.")], "document_id string, page_number int, raw_text string")
    p = asking.passages(chunks.build_chunks(chunks.normalise_pages(more))).cache()
    hits = p.filter("chunk_index = 0").select("*", F.lit(1).cast("long").alias("item_id"), F.lit(1).alias("rank"), *(F.lit(0.5).alias(c) for c in ("score", "dense_score", "lexical_score", "hybrid", "rerank")))
    q = spark.createDataFrame([(1, "What were net sales in Q1 2024?")], "item_id long, text string")
    got = asking.expand(q, hits, p).orderBy("place").collect()
    assert [(r.chunk_index, r.score, r.hit) for r in got] == [(0, 0.5, True), (2, 0.46, False)]
