"""Answers: sentences for the facets of a question, whether they suffice, and their text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import sentences as st
from ..functions import sql
from ..functions.dialect import DUCK
from ..operators import answers, evidence, retrieval
from ..sources.scratch import saved
from .evidence import FACET_TABLE, SPANS, asked_features, facets, measured, measured_sql, spans, turns
from .registry import query

RANK = "row_number() OVER (PARTITION BY item_id ORDER BY score DESC, n DESC, dn, turn, doc_id) AS rank"
# Facets as prompts, beside the whole questions that SPANS has as q.
FACET_Q = sql.questions("fx", "g")
CANDIDATES = f"""{SPANS}, cand AS (SELECT *, {RANK} FROM (SELECT *, round({evidence.SENTENCE}, 9) AS score FROM spans WHERE n > 0)),
{FACET_TABLE}, {FACET_Q},
facets AS (SELECT fx.question, fx.no, g.* FROM g JOIN fx USING (item_id) WHERE qn > 0 QUALIFY row_number() OVER (PARTITION BY question, list_sort(q_terms) ORDER BY no) = 1),
fp AS (SELECT c.item_id AS question, c.context_id, c.turn, c.ctx, c.score, c.doc_id, c.t_text, f.no, f.* EXCLUDE (question, no), e.* EXCLUDE (doc_id, text) FROM cand c JOIN facets f ON f.question = c.item_id JOIN e ON e.doc_id = c.doc_id),
fm AS ({measured_sql(f"({sql.counts('fp')})")}),
fc AS (SELECT *, round({evidence.FACET}, 9) AS facet, round({evidence.EXACT}, 9) AS exact FROM (SELECT *, max(date) OVER (PARTITION BY item_id) AS any_date, max(alias) OVER (PARTITION BY item_id) AS any_alias FROM fm)
  WHERE (is_when = 0 OR any_date = 0 OR date = 1) AND (is_nick = 0 OR any_alias = 0 OR alias = 1)),
fe AS (SELECT * FROM fc WHERE {evidence.GATE}),
fk AS (SELECT question, no, item_id, row_number() OVER (PARTITION BY question ORDER BY no) AS k FROM facets),
pw AS (SELECT DISTINCT question, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS no, CAST([] AS VARCHAR[]) AS held, CAST(NULL AS BIGINT) AS pick FROM fk
  UNION ALL SELECT w.question, f.k, CAST(f.no AS BIGINT), list_distinct(list_concat(w.held, coalesce(p.terms, CAST([] AS VARCHAR[])))), p.doc_id FROM pw w JOIN fk f ON f.question = w.question AND f.k = w.k + 1
  LEFT JOIN LATERAL (SELECT doc_id, terms FROM (SELECT c.*, len(list_filter(list_intersect(c.terms, c.q_terms), lambda x: NOT list_contains(w.held, x))) AS added FROM fe c WHERE c.item_id = f.item_id)
    ORDER BY exact DESC, nc DESC, na DESC, facet DESC, added DESC, round(score + CASE WHEN added = 0 THEN -0.2 ELSE 0.0 END, 9) DESC, ctx DESC, dn, turn, doc_id LIMIT 1) p ON true),
picks AS (SELECT question, no, pick FROM pw WHERE k > 0),
pm AS (SELECT *, count(*) FILTER (pick IS NULL) OVER (PARTITION BY question) AS missing, count(*) OVER (PARTITION BY question) AS n FROM picks),
sel AS (SELECT * FROM (SELECT question, pick AS doc_id, min(no) AS place FROM pm WHERE missing = 0 GROUP BY 1, 2 UNION ALL SELECT item_id, doc_id, 1 FROM cand WHERE rank = 1 AND score >= {answers.LEAST} AND item_id IN (SELECT question FROM pm WHERE missing > 0 AND n = 1))
  WHERE question NOT IN (SELECT item_id FROM cand WHERE rank = 1 AND score < {answers.LEAST}))"""


def candidates(b: DataFrame, c: DataFrame) -> DataFrame:
    """The sentences that share a term with their question, with score and rank."""
    scored = spans(b, c).filter("n > 0").withColumn("score", F.round(F.expr(evidence.SENTENCE), 9))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.desc("n"), "dn", "turn", "doc_id"))
    return saved(scored.select(F.col("item_id").alias("question"), "doc_id", "context_id", "turn", "ctx", "t_text", "score", rank.alias("rank")), "candidates")


def facet_pairs(b: DataFrame, some: DataFrame) -> DataFrame:
    """Measured pairs of the facets of each question with some of its candidates."""
    parts = facets(b)
    own = parts.drop("question", "no") if "q_pack" in parts.columns else asked_features(parts.select("item_id", F.col("q_text").alias("text")))
    pairs = some.join(parts.select("item_id", "question", "no"), "question")
    return measured(retrieval.scored(retrieval.text_pairs(pairs, own, asked_only=True)))


def picks(b: DataFrame, cand: DataFrame) -> DataFrame:
    fit = answers.eligible(facet_pairs(b, cand.drop("rank")))
    every = facets(b).select("item_id", "question", "no")
    return saved(answers.select(every.join(fit.drop("question", "no"), "item_id", "left")), "picks")


@query("wn09_facet_best", f"{CANDIDATES} SELECT question, no, pick FROM picks", "benchmark", "conversations")
def _(b, c):
    return picks(b, candidates(b, c)).select("question", "no", "pick")


@query("gr07_selected_sentences", f"{CANDIDATES} SELECT question, doc_id, place FROM sel", "benchmark", "conversations")
def _(b, c):
    cand = candidates(b, c)
    return answers.chosen(picks(b, cand), cand).select("question", "doc_id", "place")


def united(a: str) -> str:
    return f"list_distinct(flatten(list(list_intersect(terms, {a}))))"


FIRST = ", ".join(f"any_value({x}) AS {x}" for x in ("qa", "qc", "qn", "is_nick", "q_probe", "q_terms", "q_anchors", "q_constraints"))
LONG = "list_filter(q_constraints, lambda t: length(t) >= 6)"
DISTINCT = "list_filter(list_distinct(list_concat(q_anchors, q_constraints)), lambda t: length(t) >= 5 OR regexp_matches(t, '[0-9]'))"
ENOUGH = f"""{CANDIDATES}, sm AS (SELECT fm.* FROM fm JOIN sel ON sel.question = fm.question AND sel.doc_id = fm.doc_id WHERE fm.n > 0),
sg AS (SELECT question, no, count(*) AS matched, max(alias) AS alias, max(run) AS run, {united('q_terms')} AS u, {united('q_anchors')} AS ua, {united('q_constraints')} AS uc, {FIRST} FROM sm GROUP BY 1, 2),
sc AS (SELECT *, len(u) AS m_terms, len(ua) AS m_anchors, len(uc) AS m_constraints, len(list_intersect(u, q_constraints)) AS m_both, len({LONG}) AS n_long, len(list_intersect({LONG}, uc)) AS m_long,
  len({DISTINCT}) AS n_distinct, len(list_intersect({DISTINCT}, list_distinct(list_concat(ua, uc)))) AS m_distinct FROM sg),
suf AS (SELECT question, no, {answers.SUFFICIENT} AS enough FROM sc),
ok AS (SELECT f.question FROM facets f LEFT JOIN suf USING (question, no) WHERE f.question IN (SELECT question FROM sel) GROUP BY 1 HAVING bool_and(coalesce(enough, false)))"""


def enough(b: DataFrame, cand: DataFrame, sel: DataFrame) -> DataFrame:
    """question of those whose chosen sentences suffice for every facet."""
    own = cand.drop("rank").join(sel.select("question", "doc_id"), ["question", "doc_id"])
    said = answers.sufficiency(facet_pairs(b, own))
    every = facets(b).select("question", "no").join(sel.select("question").distinct(), "question", "left_semi")
    return every.join(said, ["question", "no"], "left").groupBy("question").agg(F.bool_and(F.coalesce("enough", F.lit(False))).alias("ok")).filter("ok").select("question")


@query("gr08_sufficient", f"{ENOUGH} SELECT DISTINCT sel.question, sel.question IN (SELECT question FROM ok) AS sufficient FROM sel", "benchmark", "conversations")
def _(b, c):
    cand = candidates(b, c)
    sel = saved(answers.chosen(picks(b, cand), cand), "chosen")
    good = enough(b, cand, sel).withColumn("sufficient", F.lit(True))
    return sel.select("question").distinct().join(good, "question", "left").select("question", F.coalesce("sufficient", F.lit(False)).alias("sufficient"))


NEXT = f"""{ENOUGH}, an AS (SELECT sel.question, sel.place, cand.t_text, cand.context_id, s.sents, p.text AS q_text FROM sel JOIN ok USING (question) JOIN cand ON cand.item_id = sel.question AND cand.doc_id = sel.doc_id JOIN s ON s.doc_id = cand.context_id JOIN prompts p ON p.item_id = sel.question),
o1 AS (SELECT *, list_transform(sents, lambda x: lower(trim(regexp_replace(x, '\\s+', ' ', 'g')))) AS fl, lower(trim(regexp_replace(t_text, '\\s+', ' ', 'g'))) AS ft FROM an),
o2 AS (SELECT *, list_filter(range(1, len(sents) + 1), lambda i: array_to_string(fl[i:i], ' ') = ft OR array_to_string(fl[i:i + 1], ' ') = ft OR array_to_string(fl[i:i + 2], ' ') = ft)[1] AS at_ FROM o1),
o3 AS (SELECT *, CASE WHEN array_to_string(fl[at_:at_], ' ') = ft THEN sents[at_ + 1] WHEN array_to_string(fl[at_:at_ + 1], ' ') = ft THEN sents[at_ + 2] ELSE sents[at_ + 3] END AS nx FROM o2)"""
WHY = DUCK.starts("lower(q_text)", ["why "]) + " OR contains(lower(q_text), ' why ')"
GROWS = f"({WHY}) AND nx IS NOT NULL AND {DUCK.any('lower(nx)', answers.FOLLOWS)} AND {DUCK.any('lower(nx)', answers.REFERS)}"
# New terms of the sentence that follows: it is one of the spans (a single sentence), whose terms are known.
TOLD = f"""{NEXT}, o4 AS (SELECT o3.*, (SELECT any_value(e.terms) FROM u JOIN e USING (doc_id) WHERE u.context_id = o3.context_id AND lower(trim(u.text)) = lower(trim(nx))) AS nt, (SELECT any_value(e.terms) FROM u JOIN e USING (doc_id) WHERE u.context_id = o3.context_id AND u.text = t_text) AS tt FROM o3),
o5 AS (SELECT *, CASE WHEN {GROWS} AND len(list_filter(nt, lambda x: NOT list_contains(tt, x))) >= 2 THEN t_text || ' ' || nx ELSE t_text END AS said FROM o4),
answer AS (SELECT question, string_agg(CASE WHEN regexp_matches(said, '[.!?]$') THEN said ELSE said || '.' END, ' ' ORDER BY place) AS answer FROM o5 GROUP BY 1)"""


def replied(b: DataFrame, c: DataFrame) -> DataFrame:
    """question, answer, q_text and main of the questions that can be answered: the sentences in the order of their facets, and the context of the first."""
    from .evidence import prompts

    cand = candidates(b, c)
    sel = saved(answers.chosen(picks(b, cand), cand), "chosen")
    own = sel.join(enough(b, cand, sel), "question", "left_semi").join(cand.select("question", "doc_id", "context_id", "t_text"), ["question", "doc_id"])
    texts = turns(c).select(F.col("doc_id").alias("context_id"), st.sentences(F.col("text")).alias("sents"))
    asked = prompts(b).select(F.col("item_id").alias("question"), F.col("text").alias("q_text"))
    each = own.join(texts, "context_id").join(asked, "question")
    low = F.lower("q_text")
    said = F.when(low.startswith("why ") | F.contains(low, F.lit(" why ")), answers.explained(F.col("sents"), F.col("t_text"))).otherwise(F.col("t_text"))
    lines = each.select("question", "q_text", F.struct("place", answers.ended(said).alias("s"), "context_id").alias("x"))
    lists = lines.groupBy("question", "q_text").agg(F.array_sort(F.collect_list("x")).alias("l"))
    return lists.select("question", "q_text", F.array_join(F.transform("l", lambda x: x["s"]), " ").alias("answer"), F.element_at("l", 1)["context_id"].alias("main"))


@query("gr15_extractive_answer", f"{TOLD} SELECT question, answer FROM answer", "benchmark", "conversations")
def _(b, c):
    return replied(b, c).select("question", "answer")
