"""Citations: the best excerpt of each context for each claim of an answer, their order, and how far they support it.

Claims are the last sentence of the best and the first of the second context of each question, so that every question has an answer to check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import sentences as st
from ..functions import sql
from ..functions import text as tx
from ..functions.dialect import CAUSES, DUCK
from ..operators import answers, evidence, retrieval, scores
from ..sources.scratch import saved
from .evidence import FACET_TABLE, SPANS, contexts, facets, features, measured, measured_sql, placed, spans
from .registry import query

NC, NA, N = (scores.share(a, b) for a, b in (("nc", "qc"), ("na", "qa"), ("n", "qn")))
MET = "len(list_intersect(terms, a_terms)) AS u_n, CASE WHEN a_full <> '' AND contains(joined_full, a_full) THEN 1 ELSE 0 END AS u_phrase"
CAUSE = f"({DUCK.starts('lower(q_text)', ['why '])} OR contains(lower(q_text), ' why ') OR {DUCK.any('lower(a_text)', CAUSES)})"
EXCERPT = st.EXCERPT_SQL.replace("text,", "x,", 1)


def level(name: str, source: str, p: str) -> str:
    """CTE name: rows of source (item_id, doc_id, text, ...) measured against their question and their claim."""
    return f"""{sql.passages(source, p)}, {name}_p AS (SELECT x.* EXCLUDE (text), x.text AS t_text, q.* EXCLUDE (item_id), {p}.* EXCLUDE (doc_id, text) FROM {source} x JOIN q ON q.item_id = x.item_id JOIN {p} ON {p}.doc_id = x.doc_id),
{name} AS (SELECT *, {MET} FROM ({measured_sql(f"({sql.counts(name + '_p')})")}))"""


SAID = "(CASE WHEN r = 1 THEN sents[-1] ELSE sents[1] END)"
EVIDENCE = f"""{SPANS},
cr AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY ctx DESC, context_id) AS r FROM cx WHERE ctx > 0),
c0 AS (SELECT item_id * 10 + r AS doc_id, item_id, r, context_id AS main, {SAID} AS text FROM cr JOIN s ON s.doc_id = context_id WHERE r <= 2 QUALIFY row_number() OVER (PARTITION BY item_id, lower({SAID}) ORDER BY r) = 1),
{sql.passages('c0', 'a')},
claims AS (SELECT c0.doc_id AS unit, c0.item_id, r, main, c0.text AS a_text, a.terms AS a_terms, a.joined_full AS a_full FROM c0 JOIN a USING (doc_id)),
best AS (SELECT * FROM (SELECT u.unit, u.r, u.main, u.a_text, u.a_terms, u.a_full, sp.*, {MET} FROM spans sp JOIN claims u USING (item_id) WHERE ctx > 0)
  QUALIFY row_number() OVER (PARTITION BY unit, context_id ORDER BY u_n DESC, round({NC}, 9) DESC, round({NA}, 9) DESC, round({N} + {evidence.TYPE_BONUS} + {evidence.ALIGNED}, 9) DESC, u_phrase DESC, dn, doc_id) = 1),
k0 AS (SELECT unit, r, main, a_text, a_terms, a_full, item_id, context_id, unnest(l) AS text, generate_subscripts(l, 1) AS i FROM (SELECT *, {st.CLAUSES_SQL.replace('text,', 't_text,', 1)} AS l FROM best WHERE u_n > 0 AND u_phrase = 0) WHERE len(l) > 1),
k1 AS (SELECT * EXCLUDE (a_full), unit || '-' || context_id || '-' || i AS doc_id, a_full FROM k0),
{level('kl', 'k1', 'kd')},
kb AS (SELECT * FROM kl QUALIFY row_number() OVER (PARTITION BY unit, context_id ORDER BY u_n DESC, u_phrase DESC, round({N}, 9) DESC, round({NA}, 9) DESC, round({NC}, 9) DESC, round({evidence.TYPE_BONUS}, 9) DESC, dn, i) = 1),
kf AS (SELECT kb.*, {CAUSE} AS cause, (SELECT min(i) FROM kl x WHERE x.unit = kb.unit AND x.context_id = kb.context_id AND x.t_text = kb.t_text) AS at_ FROM kb),
kn AS (SELECT kf.unit, kf.context_id, kf.u_n, kf.u_phrase, kf.t_text, kf.a_terms, kf.terms, kf.cause, pv.t_text AS pt, coalesce(pv.terms, {sql.EMPTY}) AS pterms, nx.t_text AS nt, coalesce(nx.terms, {sql.EMPTY}) AS nterms
  FROM kf LEFT JOIN kl pv ON pv.unit = kf.unit AND pv.context_id = kf.context_id AND pv.i = kf.at_ - 1 LEFT JOIN kl nx ON nx.unit = kf.unit AND nx.context_id = kf.context_id AND nx.i = kf.at_ + 1),
kp AS (SELECT *, cause AND len(list_filter(list_intersect(a_terms, pterms), lambda x: NOT list_contains(terms, x))) >= 2 AS with_p FROM kn),
kq AS (SELECT *, cause AND len(list_filter(list_intersect(a_terms, nterms), lambda x: NOT list_contains(terms, x) AND NOT (with_p AND list_contains(pterms, x)))) >= 2 AS with_n FROM kp),
cut AS (SELECT unit, context_id, CASE WHEN u_n = 0 AND u_phrase = 0 THEN NULL WHEN with_p OR with_n THEN CASE WHEN with_p THEN pt || ', ' ELSE '' END || t_text || CASE WHEN with_n THEN ', ' || nt ELSE '' END
  WHEN pt IS NOT NULL AND len(list_intersect(a_terms, pterms)) > 0 AND len(pterms) <= 3 THEN pt || ', ' || t_text ELSE t_text END AS cut FROM kq),
x0 AS (SELECT best.unit * 1000000000 + best.context_id AS doc_id, best.unit, best.r, best.main, best.a_text, best.a_terms, best.a_full, best.item_id, best.context_id, best.ctx, t.page_start, t.page_end, t.turn,
  CASE WHEN u_n = 0 THEN t.text ELSE {EXCERPT.replace('(x,', '(coalesce(cut, t_text),')} END AS text FROM best JOIN turns t ON t.doc_id = best.context_id LEFT JOIN cut ON cut.unit = best.unit AND cut.context_id = best.context_id),
{level('xl', 'x0', 'xd')}"""
SCORE = f"""u_n + ctx + 0.5 * u_phrase + 0.55 * {evidence.FACET} + 0.4 * {evidence.EXACT} + 0.22 * na + 0.26 * nc + least(0.18, 0.04 * n) + 0.5 * {evidence.TYPE_BONUS}
  - 0.2 * meta - 0.6 * {evidence.TYPE_PENALTY} - 0.05 * (page_end - page_start) + (CASE WHEN r = 1 AND main = context_id THEN 0.2 ELSE 0.0 END)"""
SHOWN = "((r = 1 AND main = context_id) OR (u_n > 0 AND (u_n >= (CASE WHEN na_terms <= 3 THEN 1 ELSE 2 END) OR u_phrase = 1)))"
RANKED = f"""{EVIDENCE}, sc AS (SELECT *, len(a_terms) AS na_terms, round({SCORE}, 9) AS score FROM xl),
rk AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY score DESC, ctx DESC, page_start, turn) AS rank FROM sc WHERE {SHOWN})"""


def claims(b: DataFrame, c: DataFrame) -> DataFrame:
    """unit, item_id, r, main and the text and terms of each claim."""
    held = contexts(b, c).filter("ctx > 0").select("item_id", F.col("doc_id").alias("main"), "ctx", "t_text")
    first = held.withColumn("r", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("ctx"), "main"))).filter("r <= 2")
    first = first.withColumn("a_text", F.element_at(st.sentences(F.col("t_text")), F.when(F.col("r") == 1, -1).otherwise(1)))
    return worded(first.select((F.col("item_id") * 10 + F.col("r")).alias("unit"), "item_id", "r", "main", "a_text"))


def worded(said: DataFrame) -> DataFrame:
    """said (unit, item_id, r, main, a_text) with the terms of each claim; what repeats an earlier one of its question goes."""
    own = said.withColumn("d", F.row_number().over(Window.partitionBy("item_id", F.lower("a_text")).orderBy("r"))).filter("d = 1")
    full = F.array_join(F.transform(tx.terms(F.col("a_text")), lambda t: t["term"]), " ")
    return own.select("unit", "item_id", "r", "main", "a_text", F.array_distinct(tx.sequence(F.col("a_text"))).alias("a_terms"), full.alias("a_full"))


def met(df: DataFrame) -> DataFrame:
    phrase = (F.col("a_full") != "") & F.contains("said_full", F.col("a_full"))
    return df.withColumns({"u_n": F.size(F.array_intersect("seq", "a_terms")), "u_phrase": phrase.cast("int")})


def judged(b: DataFrame, rows: DataFrame) -> DataFrame:
    """rows (item_id, doc_id, text, ...) measured against their question and their claim."""
    pairs = rows.withColumnRenamed("text", "t_text")
    return met(measured(retrieval.scored(retrieval.text_pairs(pairs, features(b), asked_only=True))))


def nine(e: str) -> Column:
    return F.round(F.expr(e), 9)


CLAIM = ["unit", "r", "main", "a_text", "a_terms", "a_full"]


def excerpts(b: DataFrame, c: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """The excerpt of each context with a score for each claim of its question: of its spans the one that says most of the
    claim, cut to the clause that does (with a neighbour where a cause is asked for or given, or a short lead); the whole
    context if it says nothing of it. own: the claims, if they are others than claims() makes."""
    own = claims(b, c) if own is None else own
    # Claims go with the contexts, so of spans no more than the best are exchanged; what else a claim has comes after.
    said = own.groupBy("item_id").agg(F.collect_list(F.struct("unit", "a_terms", "a_full")).alias("said"))
    each = met(spans(b, c, said).filter("ctx > 0").select("*", F.inline("said")))
    key = F.struct(F.col("u_n"), nine(NC), nine(NA), nine(f"{N} + {evidence.TYPE_BONUS} + {evidence.ALIGNED}"), F.col("u_phrase"), -F.col("dn"), -F.col("doc_id"))
    best = each.groupBy("unit", "item_id", "context_id").agg(F.max_by(F.struct("t_text", "u_n", "u_phrase", "ctx"), key).alias("x")).select("unit", "item_id", "context_id", "x.*")
    best = saved(best.join(own.drop("item_id"), "unit").join(features(b).select("item_id", "q_text"), "item_id"), "best")

    parts = best.filter("u_n > 0 and u_phrase = 0").select(*CLAIM, "item_id", "context_id", st.clauses(F.col("t_text")).alias("l")).filter(F.size("l") > 1)
    parts = parts.select(*CLAIM, "item_id", "context_id", F.posexplode("l").alias("i", "text")).withColumn("doc_id", F.concat_ws("-", F.col("unit").cast("string"), F.col("context_id").cast("string"), F.col("i").cast("string")))
    k = judged(b, parts)
    order = F.struct(F.col("u_n"), F.col("u_phrase"), nine(N), nine(NA), nine(NC), nine(evidence.TYPE_BONUS), -F.col("dn"), -F.col("i"))
    lists = k.groupBy("unit", "context_id").agg(
        F.max_by(F.struct("u_n", "u_phrase", "t_text"), order).alias("b"), F.sort_array(F.collect_list(F.struct("i", F.col("t_text").alias("text"), F.col("seq").alias("terms")))).alias("l"), F.first("a_terms").alias("a_terms"), F.first("a_text").alias("a_text"), F.first("q_text").alias("q_text")
    )
    cause = answers.may_need_more(F.col("a_text"), F.col("q_text"))
    none = F.array().cast("array<string>")

    def cut(at: Column) -> Column:
        one, before, after = F.get("l", at), F.get("l", at - 1), F.get("l", at + 1)
        new = lambda x, held: F.size(F.array_except(F.array_intersect("a_terms", F.coalesce(x["terms"], none)), held)) >= 2

        def joined(with_p: Column) -> Column:
            held = F.when(with_p, F.concat(one["terms"], F.coalesce(before["terms"], none))).otherwise(one["terms"])
            with_n = cause & new(after, held)
            both = F.array_join(F.filter(F.array(F.when(with_p, before["text"]), one["text"], F.when(with_n, after["text"])), lambda x: x.isNotNull()), ", ")
            lead = before["text"].isNotNull() & (F.size(F.array_intersect("a_terms", F.coalesce(before["terms"], none))) > 0) & (F.size(F.array_distinct(F.coalesce(before["terms"], none))) <= 3)
            return F.when(with_p | with_n, both).when(lead, F.concat_ws(", ", before["text"], one["text"])).otherwise(one["text"])

        return tx.let(cause & new(before, one["terms"]), joined)

    place = F.array_position(F.transform("l", lambda x: x["text"]), F.col("b.t_text")).cast("int") - 1
    trimmed = lists.select("unit", "context_id", F.when((F.col("b.u_n") > 0) | (F.col("b.u_phrase") == 1), tx.let(place, cut)).alias("cut"))
    held = placed(b, c).select(F.col("doc_id").alias("context_id"), "turn", "page_start", "page_end", F.col("t_text").alias("whole"))
    x = best.join(trimmed, ["unit", "context_id"], "left").join(held, "context_id")
    text = F.when(F.col("u_n") == 0, F.col("whole")).otherwise(st.excerpt(F.coalesce("cut", "t_text")))
    rows = x.select((F.col("unit") * 1000000000 + F.col("context_id")).alias("doc_id"), *CLAIM, "item_id", "context_id", "ctx", "page_start", "page_end", "turn", text.alias("text"))
    return judged(b, saved(rows, "excerpts")).withColumn("na_terms", F.size("a_terms")).withColumn("score", nine(SCORE))


def ranked(b: DataFrame, c: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """The excerpts that may be cited for a claim, best first."""
    order = Window.partitionBy("unit").orderBy(F.desc("score"), F.desc("ctx"), "page_start", "turn")
    return excerpts(b, c, own).filter(F.expr(SHOWN)).withColumn("rank", F.row_number().over(order))


@query("gr09_excerpts", f"{EVIDENCE} SELECT unit, context_id, t_text AS excerpt FROM xl", "benchmark", "conversations")
def _(b, c):
    return excerpts(b, c).select("unit", "context_id", F.col("t_text").alias("excerpt"))


@query("gr10_evidence_scores", f"{RANKED} SELECT unit, context_id, round(score, 6) AS score FROM rk", "benchmark", "conversations")
def _(b, c):
    return ranked(b, c).select("unit", "context_id", F.round("score", 6).alias("score"))


@query("wn10_evidence_order", f"{RANKED} SELECT unit, context_id, rank FROM rk", "benchmark", "conversations")
def _(b, c):
    return ranked(b, c).select("unit", "context_id", "rank")


# Of each claim the best excerpt; excerpts of one context come together, unless one has the other in it.
CITED = f"""{RANKED}, top AS (SELECT item_id, unit, r, context_id, ctx, trim(t_text) AS x, terms, a_terms, min(r) OVER (PARTITION BY item_id, context_id) AS first FROM rk WHERE rank = 1),
cl AS (SELECT item_id, context_id, min(first) AS place, list(x ORDER BY r) AS xs FROM top GROUP BY 1, 2),
cite AS (SELECT item_id, context_id, place, CASE WHEN len(xs) = 1 OR contains(lower(xs[1]), lower(xs[2])) THEN xs[1] WHEN contains(lower(xs[2]), lower(xs[1])) THEN xs[2] ELSE xs[1] || ' ' || xs[2] END AS text FROM cl)"""


def cited(b: DataFrame, c: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """The best excerpt of each claim, with its terms."""
    return ranked(b, c, own).filter("rank = 1").select("item_id", "unit", "r", "context_id", "ctx", F.trim("t_text").alias("x"), F.array_distinct("seq").alias("terms"), "a_terms")


def merged(a: Column, x: Column) -> Column:
    """Two excerpts of one context: the one that has the other in it, else both."""
    flat = lambda t: F.lower(tx.collapse(t))
    return F.when(a.isNull() | F.contains(flat(x), flat(a)), x).when(F.contains(flat(a), flat(x)), a).otherwise(F.concat_ws(" ", a, x))


@query("gr11_citations", f"{CITED} SELECT item_id, context_id, place, text FROM cite", "benchmark", "conversations")
def _(b, c):
    lists = cited(b, c).groupBy("item_id", "context_id").agg(F.min("r").alias("place"), F.sort_array(F.collect_list(F.struct("r", "x"))).alias("l"))
    keep = F.aggregate("l", F.lit(None).cast("string"), lambda a, e: F.when(a.isNotNull() & F.contains(F.lower(tx.collapse(a)), F.lower(tx.collapse(e["x"]))), a).otherwise(merged(a, e["x"])))
    return lists.select("item_id", "context_id", "place", keep.alias("text"))


# Support of each claim by its citation, and of the answer by its claims.
ALL = "list_distinct(list_concat(g.q_terms, list_concat(g.q_anchors, g.q_constraints)))"
CLAIMS = f"""{CITED}, {FACET_TABLE}, {sql.questions('fx', 'g')},
fa AS (SELECT fx.question, {ALL} AS k FROM g JOIN fx USING (item_id) WHERE qn > 0 QUALIFY row_number() OVER (PARTITION BY question, list_sort(q_terms) ORDER BY no) = 1),
fs AS (SELECT t.unit, avg(CASE WHEN len(list_intersect(k, t.terms)) >= greatest(1, least(2, len(k))) THEN 1.0 ELSE 0.0 END) AS covered FROM top t JOIN fa ON fa.question = t.item_id GROUP BY 1),
vs AS (SELECT t.item_id, t.unit, round(least(1.0, 0.5 * covered + 0.25 * (CASE WHEN len(a_terms) > 0 THEN len(list_intersect(a_terms, terms)) / len(a_terms)::DOUBLE ELSE 0.0 END) + 0.15 * least(ctx, 1.0) + 0.1 / 3), 9) AS support FROM top t JOIN fs USING (unit)),
ag AS (SELECT item_id, count(*) AS claims, count(*) FILTER (support >= 0.45) AS supported, avg(support) AS mean, min(support) AS least FROM vs GROUP BY 1)"""


def verified(b: DataFrame, c: DataFrame) -> DataFrame:
    """item_id, unit and support of each claim that has a citation."""
    return supported(b, cited(b, c))


def supported(b: DataFrame, top: DataFrame) -> DataFrame:
    """item_id, unit and support of each claim by its citation in top."""
    parts = facets(b).select(F.col("question").alias("item_id"), F.array_distinct(F.concat("q_terms", "q_anchors", "q_constraints")).alias("k"))
    enough = F.size(F.array_intersect("k", "terms")) >= F.greatest(F.lit(1), F.least(F.lit(2), F.size("k")))
    per = top.join(parts, "item_id").groupBy("item_id", "unit", "ctx", "a_terms", "terms").agg(F.avg(enough.cast("double")).alias("covered"))
    overlap = F.when(F.size("a_terms") > 0, F.size(F.array_intersect("a_terms", "terms")) / F.size("a_terms")).otherwise(0.0)
    support = F.least(F.lit(1.0), 0.5 * F.col("covered") + 0.25 * overlap + 0.15 * F.least("ctx", F.lit(1.0)) + F.lit(0.1) / 3)
    return per.select("item_id", "unit", F.round(support, 9).alias("support"))


@query("gr13_claim_support", f"{CLAIMS} SELECT item_id, unit, round(support, 6) AS support, support >= 0.45 AS supported FROM vs", "benchmark", "conversations")
def _(b, c):
    return verified(b, c).select("item_id", "unit", F.round("support", 6).alias("support"), (F.col("support") >= 0.45).alias("supported"))


@query("ag10_claim_rollup", f"{CLAIMS} SELECT item_id, claims, supported, round(mean, 6) AS mean, round(least, 6) AS least, 'heuristic' AS verifier, supported = claims AS verified FROM ag", "benchmark", "conversations")
def _(b, c):
    per = verified(b, c).withColumn("verifier", F.lit("heuristic")).groupBy("item_id")
    who = F.when(F.count_distinct("verifier") > 1, "mixed").otherwise(F.min("verifier"))
    rolled = per.agg(F.count("*").alias("claims"), F.count_if(F.col("support") >= 0.45).alias("supported"), F.round(F.avg("support"), 6).alias("mean"), F.round(F.min("support"), 6).alias("least"), who.alias("verifier"))
    return rolled.withColumn("verified", F.col("supported") == F.col("claims"))
