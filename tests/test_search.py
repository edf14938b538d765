"""Search in tasks: what is left out there, and the plainer forms of terms and flags that tasks use."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkwell.functions import text as tx
from inkwell.operators import retrieval, scores

WORDS = "river storm harbour stories running planned boxes mission notes Anna Boston policy engines the of edition copyright stable hoping agreed bus".split()


def made(spark, n: int, copies: int = 0):
    rng = random.Random(3)
    text = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 40)))
    texts = [text() for _ in range(n)] + ["Anna planned the mission when the river ran"] * copies
    passages = [(i, t) for i, t in enumerate(texts)] + [(len(texts), None), (len(texts) + 1, "In May 2021 they call me Anna the Great of Boston")]
    questions = [(1, "When did Anna leave the river"), (2, "What nickname did Anna of Boston have"), (3, "planned mission engines"), (4, ""), (5, "mission planned the river ran")]
    return spark.createDataFrame(questions, "item_id long, text string"), spark.createDataFrame(passages, "doc_id long, text string").repartition(2)


@pytest.mark.parametrize("copies", [0, 3000])
def test_tasks_leave_out_what_cannot_be_among_the_best(spark, copies):
    """F3 to F21: each pair that shared a word went to the JVM, over two thirds of questions times passages."""
    questions, passages = made(spark, 400, copies)
    q, k = retrieval.question_features(questions).localCheckpoint(), 4
    sent = retrieval.match_counts(q, passages, k)
    assert sent.count() < 5 * 2 * 40
    pairs = retrieval.pair_features(passages.select("doc_id").crossJoin(questions.select("item_id")), questions, passages)
    every = retrieval.scored(pairs, score=scores.LEXICAL).filter("score > 0").select("item_id", "doc_id", "score")
    want = retrieval.top(every, "item_id", k, F.desc("score"), "doc_id")
    assert sorted(map(tuple, retrieval.lexical(questions, passages, k).collect())) == sorted(map(tuple, want.collect()))


def test_scores_in_tasks(spark):
    rng, names = random.Random(5), ["n", "na", "nc", "np", "ns", "qn", "qa", "qc", "qp", "qs", "dn", "run"]
    flags = ["phrase", "head", "date", "temporal", "year", "month", "alias", "is_when", "is_nick"]
    rows = [{**{c: rng.randint(0, 6) for c in names}, **{c: rng.randint(0, 1) for c in flags}, "meta": rng.choice([0.0, 0.3, 1.0])} for _ in range(2000)]
    df = spark.createDataFrame(rows)
    exact = df.select("*", F.expr(scores.LEXICAL).cast("double").alias("score")).toPandas()
    near = scores.lexical_near({c: exact[c].to_numpy() for c in (*names, *flags, "meta")})
    assert abs(near - exact["score"].to_numpy()).max() < 1e-9 and near.max() > 1


def test_terms_and_flags_in_tasks(spark):
    tokens = [*WORDS, *"ties flies running bed seed bees gas mission lions apple applied adding egging sses missed a is 2021 os0ies xxing".split()]
    df = spark.createDataFrame([(t.lower(),) for t in tokens], "t string")
    assert all(tx.term_of(r.t) == r.term for r in df.select("t", tx.term(F.col("t")).alias("term")).collect())
    texts = ["May", "x May 3", "maybe", "é2021", "2021é", "20211", "in 2021.", "3/4", "1-2-2021x", "at noon", "noonday", "before x", "abefore x", "Anna the Great", "éAnna the Great", "they call me ann the  great", "AUGUST\n", "_may_", "", "-may", "11/12/20"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    flat, t = tx.collapse(F.col("t")), F.col("t")
    plain = [t.rlike(tx.DATE_RE), t.rlike(tx.DATE_RE) | t.rlike(tx.TEMPORAL_RE) | t.rlike(tx.TIME_RE), t.rlike(tx.YEAR_RE), t.rlike(tx.MONTH_RE), flat.rlike(tx.ALIAS_RE) | (flat.rlike(tx.SELF_RE) & F.lower(flat).rlike(tx.THE_RE))]
    got = retrieval.flagged(d.withColumn("_text", t)).select("t", *retrieval.FLAGS, *(c.cast("int").alias(f"p{i}") for i, c in enumerate(plain))).collect()
    assert all(tuple(r[1:6]) == tuple(r[6:]) for r in got) and sum(r[1] for r in got) >= 6
    lists = retrieval.Terms()
    text = "The Stories of 12 planned missions, é harbour's I a engines running notes"
    own = retrieval.passage_features(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert lists.lists(text.lower()) == (own["seq"], own["full"])


def test_a_batch_is_counted_at_once(spark):
    """F4, F7 to F15, F20, F21: each passage was cut and counted on its own in Python; whole batches must give what that gave."""
    tokens = [*WORDS, *"ties flies running bed seed bees gas mission lions apple applied adding egging sses missed a is 2021 os0ies xxing ing ed es ions s".split()]
    assert retrieval.terms_of(pa.array(tokens)).to_pylist() == [tx.term_of(t) for t in tokens]
    rng = random.Random(7)
    texts = ["", None, "é2021x storm", "a", "xriver storm harbours", "copyright edition"] + [" ".join(rng.choice(tokens).lower() for _ in range(rng.randint(0, 30))) for _ in range(200)]
    of, code, each = retrieval.tokens_of(pa.array([None, "b", *texts]).slice(2))
    assert [(d, each[c].as_py()) for d, c in zip(of.tolist(), code.tolist(), strict=True)] == [(d, t) for d, x in enumerate(texts) for t in retrieval.TOKEN.findall(x or "")]
    assert [i for a, b in retrieval.pieces(pa.array(texts), 7) for i in range(a, b)] == list(range(len(texts)))

    asked = [(1, "When did Anna leave the river storm harbour stories"), (2, "What nickname did Anna of Boston have"), (3, ""), (4, "river storm"), (5, "storm"), (6, "mission notes Anna Boston policy engines")]
    rows = retrieval.question_features(spark.createDataFrame(asked, "item_id long, text string")).orderBy("item_id").collect()
    heads = ["" if i % 3 else "Anna storms the river".lower() for i in range(len(texts))]
    counts, dn, meta = retrieval.Questions(rows).count(pa.array(texts, pa.string()), pa.array(heads))
    known = retrieval.Terms()
    for d, text in enumerate(texts):
        (seq, full), head = known.lists(text or ""), known.lists(heads[d])[0]
        said, own = " ".join(seq), {f"{a} {b}" for a, b in zip(seq, seq[1:], strict=False)}
        assert dn[d] == len(set(seq)) and (meta[d] > 0) == any(t in retrieval.META for t in full)
        for k, r in enumerate(rows):
            sets = [(seq, r.q_terms), (seq, r.q_anchors), (seq, r.q_constraints), (own, r.q_pairs), (full, r.q_subjects if r.is_nick else []), (head, r.q_terms)]
            run = max([n for n, grams in enumerate(r.q_grams, 2) if any(g in said for g in grams)], default=0)
            assert counts[d, :, k].tolist() == [*(len(set(a) & set(b)) for a, b in sets), run, int(r.q_full != "" and r.q_full in " ".join(full))], (text, r.q_text)
    assert (counts.sum(axis=(0, 2)) > 0).all()


def test_pairs_are_counted_where_their_text_is(spark):
    """gr18_preset_sweep, F1: each pair was measured by expressions on each of its tokens, joined with its text; cut and counted by batches it must give the same."""
    rng = random.Random(5)
    tokens = [*WORDS, *"Ties running seed bees gas Mission lions storms ing a is 2021 ionic Xharbours copyright edition Anna".split()]
    texts = ["", None, "é2021x Storm", "copyright Edition", "bobcat River storms", "They call me Anna the Great.\nRiver storm harbour"] + [" ".join(rng.choice(tokens) for _ in range(rng.randint(0, 30))) + rng.choice(["", ".", " in March 2021"]) for _ in range(60)]
    asked = [(1, "When did Anna leave the river storm harbour stories"), (2, "What nickname did Anna of Boston have"), (3, ""), (4, "river storm river storm river"), (5, "storm"), (6, "mission notes Anna Boston policy engines")]
    q = spark.createDataFrame(asked, "item_id long, text string")
    p = spark.createDataFrame([(i, t, ["", None, "Anna storms the River", "Storm"][i % 4]) for i, t in enumerate(texts)], "doc_id long, text string, heading string")
    shown = ["item_id", "doc_id", "seq", F.array_join("full", " ").alias("said_full"), *retrieval.COUNTS, "dn", "meta", "text_meta", *retrieval.FLAGS, "q_subjects", "qn", "qa", "qc", "qp", "qs", "is_when", "is_nick"]
    for passages in (p, p.drop("heading")):
        pairs = passages.select("doc_id").crossJoin(q.select("item_id"))
        want = retrieval.pair_features(pairs, q, passages)
        near = tx.let(F.array_join("seq", " "), lambda j: F.size(F.filter(tx.pairs(F.col("q_seq")), lambda x: F.contains(j, x))))
        want = {(r.item_id, r.doc_id): r for r in want.select(*shown, near.alias("near")).collect()}
        own = passages.withColumnRenamed("text", "t_text").crossJoin(q.select("item_id"))
        names = [c if isinstance(c, str) else "said_full" for c in shown]
        got = {(r.item_id, r.doc_id): r for r in retrieval.text_pairs(own, q).select(*names, "near").collect()}
        assert got == want and all(any(r[c] for r in got.values()) for c in [*retrieval.COUNTS, "near", "meta"] if c != "nh" or "heading" in passages.columns)
        few = retrieval.text_pairs(own, q, asked_only=True).select("item_id", "doc_id", *retrieval.FLAGS).collect()
        assert all(r[c] == (want[r.item_id, r.doc_id][c] if r.item_id in (1, 2) else 0) for r in few for c in retrieval.FLAGS)
