"""Search by the index against search by questions, on odd passages and questions."""

from __future__ import annotations

import random

import pytest

from inkwell.operators import postings, retrieval


@pytest.fixture(scope="module")
def tables(spark):
    rnd = random.Random(12)
    words = "pump gears oil harbour ferry rope deck storm does do notes note this rinse Anna 1999 March called the Great before noon valve hinge".split()
    line = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passages = [(i, line(rnd.randint(1, 30)), rnd.choice([None, "", line(2)])) for i in range(250)]
    passages += [(300, None, None), (301, "", "pump"), (302, "oscar redopump gearsx", None), (5, "pump gears again", None), (303, line(4000), "Long")]
    questions = [(i, line(rnd.randint(1, 9))) for i in range(12)] + [(20, "When did the ferry leave"), (21, "What nickname did Anna have"), (22, ""), (23, None), (24, "pump pump pump pump gears"), (25, "do this note"), (26, passages[7][1]), (27, "zzz")]
    return spark.createDataFrame(questions, "item_id long, text string"), spark.createDataFrame(passages, "doc_id long, text string, heading string").repartition(5)


@pytest.mark.parametrize("k", [1, 5, 400])
def test_same_rows(tables, k):
    questions, passages = tables
    rows = lambda df: sorted((r.item_id, r.rank, r.score) for r in df.collect())
    got = rows(postings.lexical(questions, postings.index(passages), k))
    assert got == rows(retrieval.lexical(questions, passages, k)) and len(got) >= 15


def test_no_exchange_of_counts_and_no_python(spark, tables):
    questions, passages = tables
    found = postings.index(passages).features
    keys = postings.question_keys(retrieval.question_features(questions))
    from pyspark.sql import functions as F

    counts = found.select("row", F.explode("keys").alias("key")).join(F.broadcast(keys), "key").groupBy("row", "item_id").agg(F.sum("n"))
    plan = counts._jdf.queryExecution().executedPlan().toString()
    over = plan.split("HashAggregate")[1:3]
    assert len(over) == 2 and "Exchange" not in over[0] and "Bucketed: true" in plan and "Python" not in plan


def test_lists_of_batches_are_those_of_expressions(spark, tables):
    from pyspark.sql import functions as F

    _, passages = tables
    odd = passages.filter("doc_id <> 5").unionByName(spark.createDataFrame([(400, "Ünïcode ISBN 123 printed;;\x03the ok", "The ISBN"), (401, "a b c the", "of"), (402, "\n\t ", None)], passages.schema))
    was = {r.doc_id: r for r in retrieval.passage_features(odd).collect()}
    own = postings.index(odd).features
    assert own.filter("doc_id = 400").count() == 1 and len(was) == own.count()
    for r in own.select("*", F.size("keys").alias("n_keys")).collect():
        w = was[r.doc_id]
        pairs = [f"{a} {b}" for a, b in zip(w.seq, w.seq[1:], strict=False)]
        heads = ["\x02" + t for t in w.head_terms]
        assert (r.said, r.said_full, r.dn, r.meta, r.text_meta, r.head_terms) == (" ".join(w.seq), " ".join(w.full), w.dn, w.meta, w.text_meta, w.head_terms)
        assert sorted(r["keys"]) == sorted([*({*w.seq} | {*pairs}), *heads])
        assert all(r[c] == w[c] for c in retrieval.FLAGS)
    empty = postings.index(odd.limit(0)).features
    assert empty.count() == 0
