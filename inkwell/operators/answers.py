"""From scored sentences to an answer: one sentence for each facet, whether these suffice, and the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import sentences as st
from ..functions import text as tx
from ..functions.dialect import CAUSES
from . import evidence

LEAST = 0.2
# What a sentence that explains the one before it says, a cause and what it refers to.
FOLLOWS = ["reflects", "because", "due to", "driven", "resulted", "as a result"]
REFERS = ["this ", "these ", "the increase", "increase ", "primarily"]
KEYS = ["exact", "nc", "na", "facet", "added", "later", "ctx", "short", "turn_", "span_"]


def eligible(pairs: DataFrame) -> DataFrame:
    """pairs of facets (item_id, question, no) and candidate sentences (doc_id) that pass the gates of the facet. A
    facet that asks when takes sentences with a date only if there are any, one that asks for a nickname those with one."""
    each = Window.partitionBy("item_id")
    wanted = lambda kind, has: (F.col(kind) == 0) | (F.max(has).over(each) == 0) | (F.col(has) == 1)
    marked = pairs.withColumns({"_w": wanted("is_when", "date"), "_a": wanted("is_nick", "alias")})
    scored = marked.filter("_w and _a").drop("_w", "_a").withColumns({"facet": F.round(F.expr(evidence.FACET), 9), "exact": F.round(F.expr(evidence.EXACT), 9)})
    return scored.filter(F.expr(evidence.GATE))


def select(pairs: DataFrame) -> DataFrame:
    """question, no and pick (null if there is none) of each facet, in turn: what earlier picks say counts less.

    pairs: all facets of each question with their eligible sentences, doc_id null where a facet has none."""
    term = F.array_distinct(F.coalesce("seq", F.array().cast("array<string>")))
    cand = F.struct("exact", "nc", "na", "facet", "score", "ctx", "dn", "turn", "doc_id", term.alias("terms"), "q_terms")
    per_facet = pairs.groupBy("question", "no").agg(F.collect_list(F.when(F.col("doc_id").isNotNull(), cand)).alias("cands"))
    lists = per_facet.groupBy("question").agg(F.sort_array(F.collect_list(F.struct("no", "cands"))).alias("l"))

    def keyed(c: Column, held: Column) -> Column:
        added = F.size(F.array_except(F.array_intersect(c["terms"], c["q_terms"]), held))
        later = F.round(c["score"] + F.when(added == 0, -0.2).otherwise(0.0), 9)
        return F.struct(c["exact"], c["nc"], c["na"], c["facet"], added, later, c["ctx"], -c["dn"], -c["turn"], -c["doc_id"], c["terms"].alias("terms"), c["doc_id"].alias("pick"))

    def step(s: Column, f: Column) -> Column:
        def took(best: Column) -> Column:
            held = F.array_union(s["held"], F.coalesce(best["terms"], F.array().cast("array<string>")))
            return F.struct(held.alias("held"), F.concat(s["out"], F.array(F.struct(f["no"].alias("no"), best["pick"].alias("pick")))).alias("out"))

        return tx.let(F.array_max(F.transform(f["cands"], lambda c: keyed(c, s["held"]))), took)

    start = F.struct(F.array().cast("array<string>").alias("held"), F.array().cast("array<struct<no:bigint,pick:bigint>>").alias("out"))
    return lists.select("question", F.inline(F.aggregate("l", start, step, lambda s: s["out"])))


def chosen(picks: DataFrame, candidates: DataFrame) -> DataFrame:
    """question, doc_id and place of the sentences of each answer: the picks in order, each once; none if a facet of
    several has no pick; the best candidate (question, doc_id, score, rank) of LEAST or more if the only facet has none."""
    all_of = Window.partitionBy("question")
    marked = picks.withColumns({"missing": F.count_if(F.col("pick").isNull()).over(all_of), "n": F.count("*").over(all_of)})
    some = marked.filter("missing = 0").groupBy("question", F.col("pick").alias("doc_id")).agg(F.min("no").alias("place"))
    best = candidates.filter((F.col("rank") == 1) & (F.col("score") >= LEAST)).select("question", "doc_id", F.lit(1).cast("long").alias("place"))
    lone = marked.filter("missing > 0 and n = 1").select("question")
    weak = candidates.filter((F.col("rank") == 1) & (F.col("score") < LEAST)).select("question")
    return some.unionByName(best.join(lone, "question", "left_semi")).join(weak, "question", "left_anti")


#: Of a facet and all chosen sentences that share a term with it: whether they say enough (see evidence for the counts).
PROBE = """(m_constraints >= {c} AND (n_long = 0 OR m_long > 0) AND (n_distinct = 0 OR m_distinct >= least(2, n_distinct)) AND (n_distinct < 2 OR run >= 2))"""
SUFFICIENT = f"""(matched > 0 AND (CASE WHEN is_nick = 1 AND alias = 1 THEN true
  WHEN qa = 0 THEN m_terms / CAST(greatest(qn, 1) AS DOUBLE) >= 0.5 OR (m_both > 0 AND m_terms / CAST(greatest(qn, 1) AS DOUBLE) >= 0.34)
  WHEN m_anchors < {evidence.required_anchors('qa')} AND m_constraints < {evidence.required_constraints('qc')} THEN false
  WHEN q_probe = 1 THEN {PROBE.format(c=evidence.required_constraints('qc'))} ELSE true END))"""


def sufficiency(pairs: DataFrame) -> DataFrame:
    """question, no and enough of each facet. pairs: measured facets with each chosen sentence of their question."""
    met = pairs.filter("n > 0")
    union = lambda a: F.array_distinct(F.flatten(F.collect_list(F.array_intersect("seq", a))))
    first = ["qa", "qc", "qn", "is_nick", "q_probe", "q_terms", "q_anchors", "q_constraints"]
    per = met.groupBy("question", "no").agg(
        F.count("*").alias("matched"), F.max("alias").alias("alias"), F.max("run").alias("run"), union("q_terms").alias("u"), union("q_anchors").alias("ua"), union("q_constraints").alias("uc"), *(F.first(c).alias(c) for c in first)
    )
    long = lambda xs: F.filter(xs, lambda t: F.length(t) >= 6)
    distinct = F.filter(F.array_union("q_anchors", "q_constraints"), lambda t: (F.length(t) >= 5) | t.rlike("[0-9]"))
    counted = per.withColumn("_d", distinct).withColumns({
        "m_terms": F.size("u"), "m_anchors": F.size("ua"), "m_constraints": F.size("uc"), "m_both": F.size(F.array_intersect("u", "q_constraints")),
        "n_long": F.size(long("q_constraints")), "m_long": F.size(F.array_intersect(long("q_constraints"), "uc")),
        "n_distinct": F.size("_d"), "m_distinct": F.size(F.array_intersect("_d", F.array_union("ua", "uc"))),
    })
    return counted.select("question", "no", F.expr(SUFFICIENT).alias("enough"))


def explained(sentences: Column, said: Column) -> Column:
    """said, with the sentence that follows it where that gives a cause. sentences: of its context."""
    flat = lambda xs: F.transform(xs, lambda x: F.lower(tx.collapse(x)))
    has = lambda t, words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(t), w))
    terms = lambda t: F.array_distinct(F.transform(F.filter(tx.terms(t), tx.is_content), lambda x: x["term"]))

    def of(all_: Column, own: Column) -> Column:
        at = F.array_min(F.filter(F.sequence(F.lit(1), F.greatest(F.size(all_) - F.size(own) + 1, F.lit(1))), lambda i: F.slice(flat(all_), i, F.size(own)) == flat(own)))
        after = F.get(all_, at - 1 + F.size(own))
        new = lambda x: F.size(F.array_except(terms(x), terms(said))) >= 2
        return tx.let(after, lambda x: F.when(has(x, FOLLOWS) & has(x, REFERS) & new(x), F.concat_ws(" ", said, x)).otherwise(said))

    return tx.let(sentences, lambda s: tx.let(st.sentences(said), lambda own: of(s, own)))


def ended(text: Column) -> Column:
    return F.when(text.rlike("[.!?]$"), text).otherwise(F.concat(text, F.lit(".")))


def may_need_more(answer: Column, question: Column) -> Column:
    """Whether one excerpt may be too little: a cause is asked for or given."""
    q = F.lower(question)
    return q.startswith("why ") | F.contains(q, F.lit(" why ")) | F.exists(F.array(*map(F.lit, CAUSES)), lambda w: F.contains(F.lower(answer), w))
