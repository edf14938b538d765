"""Plans of answers stay short: what search gave is not worked out again, and what is used several times is written once."""

from __future__ import annotations

import pytest

from inkwell.plans import evidence
from inkwell.plans.evidence import Given


@pytest.fixture(scope="module")
def given(spark):
    rows = [(1000, 1, 7, 1, 2, "The river rose after the storm. It fell in May.", 0.4, 0.3, 0.2), (1001, 1, 8, 2, 2, "", 0.0, 0.0, 0.0), (2000, 2, 7, 1, 1, None, 0.1, 0.0, 0.0), (3000, 3, 1, 1, 1, "No question asks for it.", 0.5, 0.5, 0.5)]
    held = spark.createDataFrame(rows, "doc_id long, item_id long, turn long, page_start int, page_end int, text string, ctx double, lex double, rerank double")
    return Given(spark.createDataFrame([(1, "When did the river rise?"), (2, "")], "item_id long, text string")), Given(held)


def joins(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


def test_given_contexts_are_those_that_are_measured(given):
    keys = evidence.PLACED
    assert sorted(map(str, evidence.placed(*given).select(keys).collect())) == sorted(map(str, evidence.contexts(*given).select(keys).collect()))


def test_spans_of_given_contexts_have_few_joins(given):
    assert joins(evidence.spans(*given)) <= 4
