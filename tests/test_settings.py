"""Settings and providers change the plan of a search."""

from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from inkwell.config import Settings
from inkwell.operators import retrieval, scores


@pytest.fixture(scope="module")
def tables(spark):
    words = "pump gears oil harbour ferry rope deck storm rinse noon valve hinge".split()
    passages = [(i, " ".join(words[(i * 5 + j * 7) % 12] for j in range(3 + i % 6))) for i in range(60)]
    return spark.createDataFrame([(1, "oil the pump gears"), (2, "ferry rope at noon")], "item_id long, text string"), spark.createDataFrame(passages, "doc_id long, text string")


def test_lexical_search_can_be_off(tables):
    both, dense = (retrieval.search(*tables, 3, replace(Settings(), enable_lexical=on)).collect() for on in (True, False))
    assert len(dense) == 6 and all(r.lexical_score == 0.0 and r.lexical_rank is None for r in dense) and any(r.lexical_score > 0 for r in both)


def test_multiplier_and_weights(tables):
    assert retrieval.search(*tables, 3, replace(Settings(), candidate_multiplier=1)).agg(F.max("fused_rank")).first()[0] == 3
    found = retrieval.search(*tables, 3, replace(Settings(), dense_weight=0.0, lexical_weight=1.0, rrf_k=1, rerank_weight=0.0)).collect()
    assert all(abs(r.rrf - (1 / (1 + r.lexical_rank) if r.lexical_rank else 0.0)) < 1e-9 for r in found)
    assert "0.0 * rerank" in scores.final(replace(Settings(), rerank_weight=0.0)) and "0.35 * hybrid + 0.65 * rerank" in scores.FINAL


def test_providers_by_name(tables, monkeypatch):
    monkeypatch.setitem(retrieval.RERANKERS, "longest", lambda pairs: retrieval.scored(pairs, rerank="CAST(dn AS DOUBLE)"))
    monkeypatch.setitem(retrieval.EMBEDDINGS, "first", lambda df, key, n: df.select(key, F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.when(i == F.length("text") % n + 1, 1.0).otherwise(0.0)).alias("v")))
    own = replace(Settings(), reranker="longest", embedding_provider="first", embedding_dimensions=4)
    found = retrieval.search(*tables, 3, own).collect()
    assert all(r.rerank == r.dn for r in found) and {r.dense_score for r in found} <= {0.0, 1.0}
    with pytest.raises(ValueError, match="unknown provider none"):
        retrieval.search(*tables, 3, replace(Settings(), reranker="none"))
