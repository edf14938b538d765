"""Whether an answer stands: its support, coverage and thresholds, and what is left of it without the claims that fail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import DUCK, SPARK, VALUE, prompt_measures
from ..operators import chunks, evidence
from ..sources.scratch import saved, tidied
from .citations import CLAIMS, cited, verified
from .evidence import RANKED as CHOSEN
from .evidence import chosen, exprs, facets, listed, prompts
from .records import sheets
from .registry import QUERIES, query

PLAIN_VALUES = "list_distinct(list_transform(regexp_extract_all({t}, '" + VALUE + "'), lambda x: trim(regexp_replace(x, '[$%,]', '', 'g'))))"
METRIC = "(CASE WHEN nq_metrics = 0 THEN 1.0 ELSE m_metrics / CAST(nq_metrics AS DOUBLE) END)"


def both(m: str) -> str:
    """Support of a facet by the terms of the answer and its citations (m: a), or of the citations alone (m: c)."""
    e = evidence.COVERAGE if m == "a" else evidence.QUESTION_SUPPORT
    return e.replace("m_all", f"{m}_all").replace("m_anchors", f"{m}_anchors").replace("m_constraints", f"{m}_constraints")


#: Per question, from its facets.
SUMS = {
    "facets": "count(*)",
    "met": "avg(CAST(CASE WHEN c_all >= greatest(1, least(2, k_all)) THEN 1 ELSE 0 END AS DOUBLE))",
    "coverage": f"avg({both('a')})",
    "least_facet": f"min({both('a')})",
    "base": f"avg({both('c')})",
    "any_constraints": "max(CASE WHEN qc > 0 THEN 1 ELSE 0 END)",
}
SUPPORT = "least(1.0, 0.5 * met + 0.25 * overlap + 0.15 * least(mean_ctx, 1.0) + least(cites, 3) / CAST(30 AS DOUBLE))"
COVERED = f"least(1.0, 0.65 * coverage + 0.2 * {METRIC} + 0.15 * (CASE WHEN q_numeric = 0 OR any_digit = 1 THEN 1.0 ELSE 0.0 END))"
CITED_SUPPORT = "least(1.0, 0.65 * base + 0.2 * least(mean_ctx, 1.0) + 0.15 * (CASE WHEN nq_metrics = 0 THEN 1.0 ELSE cm_metrics / CAST(nq_metrics AS DOUBLE) END))"
LOOKUP = "(cm_metrics = nq_metrics AND (q_numeric = 0 OR c_digit = 1) AND (nq_quarters = 0 OR c_quarters > 0) AND (q_ttm = 0 OR c_ttm = 1))"
STRICT = f"""(CASE WHEN NOT {evidence.STRICT} THEN true WHEN q_exact_value = 1 AND values_met < 0.85 THEN false WHEN q_exact_value = 1 AND facets = 1 AND q_exact = 1 THEN {LOOKUP}
  ELSE {CITED_SUPPORT} >= {evidence.CITATION_THRESHOLD} AND least_facet >= {evidence.FACET_THRESHOLD} END)"""
GATE = f"(support >= {evidence.THRESHOLD} AND covered >= {evidence.THRESHOLD} AND claims = supported AND {STRICT})"
QUARTERS = r"regexp_extract_all(lower({t}), 'q[1-4]\s+[0-9]{{4}}')"


def passing(p: str, source: str, weight: float) -> str:
    """CTEs p...: support, covered and whether the gate is passed, of the claims in source."""
    k = "list_distinct(list_concat(g.q_terms, list_concat(g.q_anchors, g.q_constraints)))"
    hits = lambda m, held: ", ".join(f"len(list_intersect({a}, {held})) AS {m}_{n}" for n, a in (("all", "k"), ("anchors", "q_anchors"), ("constraints", "q_constraints")))
    return f"""{p}a AS (SELECT item_id, list_distinct(flatten(list(a_terms))) AS a_every, list_distinct(flatten(list(terms))) AS c_terms, string_agg(a_text, ' ' ORDER BY r) AS a_text, string_agg(x, ' ' ORDER BY r) AS c_text,
  count(DISTINCT context_id) AS cites, list_sum(list_transform(list_distinct(list({{'c': context_id, 's': ctx}})), lambda e: e.s)) / count(DISTINCT context_id) AS mean_ctx, count(*) AS claims, count(*) FILTER (support >= 0.45) AS supported, avg(support) AS mean_claim FROM {source} GROUP BY 1),
{p}f AS (SELECT *, {hits('a', 'list_concat(a_every, c_terms)')}, {hits('c', 'c_terms')}, len(k) AS k_all FROM (SELECT {p}a.*, g.q_anchors, g.q_constraints, g.qa, g.qc, {k} AS k FROM {p}a JOIN ff ON ff.question = {p}a.item_id JOIN g ON g.item_id = ff.item_id)),
{p}s AS (SELECT item_id, {listed(SUMS)} FROM {p}f GROUP BY 1),
{p}m AS (SELECT {p}a.*, s.* EXCLUDE (item_id), p.text AS q_text, {listed(prompt_measures(DUCK, 'p.text'))}, CASE WHEN len(a_every) > 0 THEN len(list_intersect(a_every, c_terms)) / len(a_every)::DOUBLE ELSE 0.0 END AS overlap,
  {PLAIN_VALUES.format(t='a_text')} AS av, {PLAIN_VALUES.format(t='c_text')} AS cv FROM {p}a JOIN {p}s s USING (item_id) JOIN prompts p USING (item_id)),
{p}n AS (SELECT *, len(q_metrics) AS nq_metrics, len(q_quarters) AS nq_quarters, len(list_filter(q_metrics, lambda x: contains(lower(a_text || ' ' || c_text), x))) AS m_metrics, len(list_filter(q_metrics, lambda x: contains(lower(c_text), x))) AS cm_metrics,
  CASE WHEN regexp_matches(a_text || c_text, '[0-9]') THEN 1 ELSE 0 END AS any_digit, CASE WHEN regexp_matches(c_text, '[0-9]') THEN 1 ELSE 0 END AS c_digit, len(list_intersect(q_quarters, {QUARTERS.format(t='c_text')})) AS c_quarters,
  CASE WHEN contains(lower(c_text), 'trailing twelve months') OR contains(lower(c_text), 'ttm') THEN 1 ELSE 0 END AS c_ttm, CASE WHEN len(av) > 0 THEN len(list_intersect(av, cv)) / len(av)::DOUBLE ELSE 0.0 END AS values_met FROM {p}m),
{p}c AS (SELECT *, round({SUPPORT}, 9) AS plain, round({COVERED}, 9) AS covered FROM {p}n),
{p}w AS (SELECT *, round(least(1.0, 0.25 * plain + 0.15 * covered + {weight} * mean_claim), 9) AS support FROM {p}c),
{p} AS (SELECT *, {GATE} AS passed FROM {p}w)"""


FINAL = f"""{CLAIMS}, ff AS (SELECT fx.question, g.item_id FROM g JOIN fx USING (item_id) WHERE qn > 0 QUALIFY row_number() OVER (PARTITION BY question, list_sort(q_terms) ORDER BY no) = 1),
tc AS (SELECT t.*, u.a_text, vs.support FROM top t JOIN claims u ON u.unit = t.unit JOIN vs ON vs.unit = t.unit), tr AS (SELECT * FROM tc WHERE support >= 0.45),
{passing('w1', 'tc', 0.65)}, {passing('w2', 'tr', 0.6)},
fin AS (SELECT w1.item_id, w1.plain, w1.covered, w1.support AS support1, w1.passed AS passed1, w1.claims = w1.supported AS verified, w2.support AS support2, coalesce(w2.passed, false) AS passed2, w1.a_text AS text1, w2.a_text AS text2 FROM w1 LEFT JOIN w2 ON w2.item_id = w1.item_id)"""
OUTCOME = "CASE WHEN passed1 THEN 'answer' WHEN NOT verified AND passed2 THEN 'repaired' ELSE 'refusal' END"
CONFIDENCE = "CASE WHEN passed1 THEN least(0.98, greatest(0.35, 0.45 + 0.5 * support1)) WHEN NOT verified AND passed2 THEN least(0.94, greatest(0.32, 0.4 + 0.45 * support2)) ELSE 0.7 END"


def said(c: str) -> Column:
    """The texts of claims or citations in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", c))), lambda x: x[c]), " ")


def judged(b: DataFrame, rows: DataFrame, weight: float) -> DataFrame:
    """plain, covered, support and passed of the claims in rows, with a citation each."""
    every = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    scores = F.collect_set(F.struct("context_id", "ctx"))
    per = rows.groupBy("item_id").agg(
        every("a_terms").alias("a_every"), every("terms").alias("c_terms"), said("a_text").alias("a_text"), said("x").alias("c_text"), F.count_distinct("context_id").alias("cites"),
        (F.aggregate(scores, F.lit(0.0), lambda s, e: s + e["ctx"]) / F.size(scores)).alias("mean_ctx"), F.count("*").alias("claims"), F.count_if(F.col("support") >= 0.45).alias("supported"), F.avg("support").alias("mean_claim"),
    )
    return gated(b, per, weight)


def gated(b: DataFrame, per: DataFrame, weight: float) -> DataFrame:
    """per with plain, covered, support and passed. per: item_id, the terms and text of the answer (a_every, a_text) and of its
    citations (c_terms, c_text), how many these are and their mean score (cites, mean_ctx), claims, those supported, and their mean support."""
    parts = facets(b).select(F.col("question").alias("item_id"), "q_anchors", "q_constraints", "qa", "qc", F.array_distinct(F.concat("q_terms", "q_anchors", "q_constraints")).alias("k"))
    hits = lambda m, held: {f"{m}_{n}": F.size(F.array_intersect(a, held)) for n, a in (("all", "k"), ("anchors", "q_anchors"), ("constraints", "q_constraints"))}
    counted = per.join(parts, "item_id").withColumns({**hits("a", F.concat("a_every", "c_terms")), **hits("c", F.col("c_terms")), "k_all": F.size("k")})
    sums = counted.groupBy("item_id").agg(*exprs(SUMS))
    asked = prompts(b).withColumnRenamed("text", "q_text").select("item_id", "q_text", *exprs(prompt_measures(SPARK)))
    plain = lambda t: F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(VALUE), F.lit(0)), lambda v: F.trim(F.regexp_replace(v, "[$%,]", ""))))
    share = lambda a, held: F.when(F.size(a) > 0, F.size(F.array_intersect(a, held)) / F.size(a)).otherwise(0.0)
    text, cites = F.concat_ws(" ", "a_text", "c_text"), F.lower("c_text")
    named = lambda t: F.size(F.filter("q_metrics", lambda m: F.contains(t, m)))
    flag = lambda c: c.cast("int")
    full = per.join(sums, "item_id").join(asked, "item_id").withColumns({
        "overlap": share(F.col("a_every"), F.col("c_terms")), "nq_metrics": F.size("q_metrics"), "nq_quarters": F.size("q_quarters"), "m_metrics": named(F.lower(text)), "cm_metrics": named(cites),
        "any_digit": flag(text.rlike("[0-9]")), "c_digit": flag(cites.rlike("[0-9]")), "c_quarters": F.size(F.array_intersect("q_quarters", F.regexp_extract_all(cites, F.lit(r"q[1-4]\s+[0-9]{4}"), F.lit(0)))),
        "c_ttm": flag(F.contains(cites, F.lit("trailing twelve months")) | F.contains(cites, F.lit("ttm"))), "values_met": share(plain("a_text"), plain("c_text")),
    })
    full = full.select("*", F.round(F.expr(SUPPORT), 9).alias("plain"), F.round(F.expr(COVERED), 9).alias("covered"))
    full = full.withColumn("support", F.round(F.expr(f"least(1.0, 0.25 * plain + 0.15 * covered + {weight} * mean_claim)"), 9))
    return full.withColumn("passed", F.expr(GATE))


def finalised(b: DataFrame, c: DataFrame) -> DataFrame:
    """Each answer as it is, or without the claims that aren't supported, or a refusal."""
    from .citations import claims

    texts = claims(b, c).select("unit", "a_text")
    rows = saved(cited(b, c).join(verified(b, c).drop("item_id"), "unit").join(texts, "unit"), "claims")
    first = judged(b, rows, 0.65).select("item_id", "plain", "covered", F.col("support").alias("support1"), F.col("passed").alias("passed1"), (F.col("claims") == F.col("supported")).alias("verified"), F.col("a_text").alias("text1"))
    second = judged(b, rows.filter("support >= 0.45"), 0.6).select("item_id", F.col("support").alias("support2"), F.col("passed").alias("passed2"), F.col("a_text").alias("text2"))
    return first.join(second, "item_id", "left").fillna(False, ["passed2"])


@query("gr14_final_answers", f"{FINAL} SELECT item_id, {OUTCOME} AS outcome, round(support1, 6) AS support, round({CONFIDENCE}, 6) AS confidence, CASE {OUTCOME} WHEN 'answer' THEN text1 WHEN 'repaired' THEN text2 END AS answer FROM fin", "benchmark", "conversations")
def _(b, c):
    done = finalised(b, c).withColumn("outcome", F.expr(OUTCOME))
    text = F.when(F.col("outcome") == "answer", F.col("text1")).when(F.col("outcome") == "repaired", F.col("text2"))
    return done.select("item_id", "outcome", F.round("support1", 6).alias("support"), F.round(F.expr(CONFIDENCE), 6).alias("confidence"), text.alias("answer"))


@query("vc21_answer_support", f"{FINAL} SELECT item_id, round(plain, 6) AS support, round(covered, 6) AS coverage FROM fin", "benchmark", "conversations")
def _(b, c):
    return finalised(b, c).select("item_id", F.round("plain", 6).alias("support"), F.round("covered", 6).alias("coverage"))


# Contexts of a question in order of selection, without near copies, packed into a budget with their neighbours.
def packed(b: DataFrame, c: DataFrame) -> DataFrame:
    some = chosen(b, c).select("item_id", "doc_id", "turn", "page_start", "page_end", "rank", F.array_distinct("seq").alias("terms"), "q_terms", F.expr("-k14").cast("long").alias("cost"), F.regexp_extract_all(F.lower("t_text"), F.lit("[a-z0-9]+"), F.lit(0)).alias("raw"))
    return chunks.assemble(some, "item_id", budget=200)


@query("gr03_near_copies", f"""{CHOSEN}, z AS (SELECT item_id, doc_id, rank, terms FROM chosen) SELECT item_id, doc_id, rank FROM z a WHERE NOT EXISTS (SELECT 1 FROM z b WHERE b.item_id = a.item_id AND b.rank < a.rank AND
  CASE WHEN len(list_distinct(list_concat(a.terms, b.terms))) = 0 THEN true ELSE len(list_intersect(a.terms, b.terms)) / len(list_distinct(list_concat(a.terms, b.terms)))::DOUBLE >= 0.9 END)""", "benchmark", "conversations")
def _(b, c):
    """Near copies among the few contexts of a question don't form chains here, so the better of any two that are alike stays."""
    some = chosen(b, c).select("item_id", "doc_id", "rank", F.array_distinct("seq").alias("terms"))
    return chunks.suppress_near_copies(some, "item_id", "rank", "terms").select("item_id", "doc_id", "rank")


# What has no SQL: folds over pages and contexts; held by tests against the same by hand.
def rows_only(name: str, *tables: str):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: tidied(spark, name, lambda: f(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables)))
        return f

    return add


@rows_only("gr04_packed_contexts", "benchmark", "conversations")
def _(b, c):
    return packed(b, c)


@rows_only("tx17_cleaned_pages", "conversations")
def _(c):
    pages = sheets(c).select(F.col("document_id").cast("string").alias("document_id"), "page_number", "raw_text")
    return chunks.normalise_pages(pages)


@rows_only("gr02_chunks", "conversations")
def _(c):
    pages = sheets(c).select(F.col("document_id").cast("string").alias("document_id"), "page_number", "raw_text")
    return chunks.build_chunks(chunks.normalise_pages(pages), chunks.PRESETS["small"])
