"""From contexts to answers: facets, spans, their scores and orders, support, routing and gates.

The given tables have no dates, figures or nicknames, so prompts are the benchmark's texts as questions of several
kinds, and contexts are the turns of the conversation of the same number with a sentence of one kind or another."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import sentences as st
from ..functions import sql
from ..functions import text as tx
from ..functions.dialect import DUCK, SPARK, Dialect, prompt_measures, text_measures
from ..operators import evidence, retrieval, scores
from .registry import query

KINDS = [
    "When did the river rise", "How many employees were there", "What was net sales in Q1 2024", "Why did the rest leave", "Where did Anna live", "What does the note say about the storm", "What nickname did Anna have and where did she live",
    "People call her Anna the Great",
]
EXTRA = [
    "On March 3, 2021 the river rose after the storm.",
    "Net sales in Q1 2024 were $1,234,567 and operating income fell 12%.",
    "People call her Anna the Great, who lived in Boston, Texas because of work.",
    "There were 45,000 employees, driven by the increase in trade; the rest left, but some stayed.",
    "",
]


def picked(key: str, values: list[str]) -> str:
    return f"(CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END)"


# Every third prompt is of its kind alone, the others go on with the benchmark's text.
PROMPT = f"{picked('item_id', KINDS)} || (CASE WHEN item_id % 3 = 0 THEN '' ELSE ' ' || text END)"
PROMPTS = f"prompts AS (SELECT item_id, {PROMPT} AS text FROM benchmark)"
TURNS = f"""turns AS (SELECT conv_id * 1000 + turn AS doc_id, conv_id AS item_id, turn, turn + 1 AS page_start, turn + 1 + CASE WHEN turn % 3 = 0 THEN 1 ELSE 0 END AS page_end,
  text || chr(10) || {picked('turn', EXTRA)} AS text FROM conversations)"""


@dataclass(frozen=True)
class Given:
    """A relation that has the shape of prompts() (item_id, text) or turns() already, as asking.py makes them of what search
    found. Contexts may have ctx, lex and rerank, the scores that search gave them; doc_id is their number, for one question each.
    features and facets: what asked_features() and facets() give for the questions, if it is written already."""

    rows: DataFrame
    features: DataFrame | None = None
    facets: DataFrame | None = None

    def only(self, ids: DataFrame) -> Given:
        """Of these questions those in ids (item_id)."""
        return Given(*(df and df.join(ids.select(F.col("item_id").alias(key)), key, "left_semi") for df, key in ((self.rows, "item_id"), (self.features, "item_id"), (self.facets, "question"))))


def prompts(b: DataFrame | Given) -> DataFrame:
    return b.rows.select("item_id", "text") if isinstance(b, Given) else b.select("item_id", F.expr(PROMPT).alias("text"))


def turns(c: DataFrame | Given) -> DataFrame:
    if isinstance(c, Given):
        return c.rows.select("doc_id", "item_id", "turn", "page_start", "page_end", "text")
    page = F.col("turn") + 1
    text = F.concat("text", F.lit("\n"), F.expr(picked("turn", EXTRA)))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.col("conv_id").alias("item_id"), "turn", page.alias("page_start"), (page + (F.col("turn") % 3 == 0).cast("int")).alias("page_end"), text.alias("text"))


def exprs(columns: dict[str, str]) -> list:
    return [F.expr(e).alias(n) for n, e in columns.items()]


def listed(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in columns.items())


def asked_features(p: DataFrame) -> DataFrame:
    """item_id and all features and measures of prompts (item_id, text)."""
    return retrieval.packed(retrieval.question_features(p)).select("*", *exprs(prompt_measures(SPARK)))


def features(b: DataFrame | Given) -> DataFrame:
    return b.features if isinstance(b, Given) and b.features is not None else asked_features(prompts(b))


NEAR = "len(list_filter(list_distinct(list_transform(range(1, len(q_seq)), lambda i: q_seq[i] || ' ' || q_seq[i + 1])), lambda p: contains(joined, p)))"


#: Prompts for whose pairs the measures of a text count.
MEASURED = "is_when = 1 OR is_many = 1 OR is_where = 1 OR q_numeric = 1 OR q_exact = 1 OR size(q_metrics) > 0 OR size(q_quarters) > 0 OR size(q_years) > 0"


def measured(pairs: DataFrame) -> DataFrame:
    """pairs of retrieval.text_pairs with ctx, and all measures of prompt and text. What no formula reads isn't looked for: a text is measured if its prompt asks for a number, a time or a place."""
    first = pairs if "q_numeric" in pairs.columns else pairs.select("*", *exprs(prompt_measures(SPARK)))
    first = first.withColumn("_read", F.expr(f"CASE WHEN {MEASURED} THEN t_text ELSE '' END"))
    return first.select("*", *exprs(text_measures(SPARK, "_read"))).select("*", *exprs(evidence.shared(SPARK))).drop("_read")


def measured_sql(source: str) -> str:
    return f"SELECT *, {NEAR} AS near, {listed(evidence.shared(DUCK))} FROM (SELECT *, {listed(prompt_measures(DUCK))}, {listed(text_measures(DUCK))} FROM {source})"


BASE = f"WITH RECURSIVE {PROMPTS}, {TURNS}, {sql.questions('prompts')}"
CONTEXTS = f"""{BASE}, {sql.passages('turns')},
cp AS (SELECT t.item_id, t.turn, t.page_start, t.page_end, t.text AS t_text, q.* EXCLUDE (item_id), d.* EXCLUDE (text) FROM turns t JOIN q USING (item_id) JOIN d USING (doc_id)),
cc AS (SELECT *, round({scores.LEXICAL}, 9) AS ctx, round({scores.LEXICAL}, 9) AS lex, round({scores.RERANK}, 9) AS rerank FROM ({sql.counts('cp')})),
contexts AS ({measured_sql('cc')})"""


def contexts(b: DataFrame, c: DataFrame) -> DataFrame:
    if isinstance(c, Given):
        return measured(retrieval.scored(retrieval.text_pairs(c.rows.withColumnRenamed("text", "t_text").select(*PLACED, "lex", "rerank"), features(b), asked_only=True)))
    full = retrieval.text_pairs(turns(c).withColumnRenamed("text", "t_text"), features(b))
    return measured(retrieval.scored(full, ctx=scores.LEXICAL, lex=scores.LEXICAL, rerank=scores.RERANK))


def placed(b: DataFrame, c: DataFrame) -> DataFrame:
    """item_id, doc_id, turn, page_start, page_end, t_text and ctx of contexts(). Those that search has scored have them already, so nothing is measured for it."""
    if not isinstance(c, Given):
        return contexts(b, c).select(*PLACED)
    return c.rows.withColumnRenamed("text", "t_text").select(*PLACED).join(prompts(b).select("item_id"), "item_id", "left_semi")


PLACED = ["item_id", "doc_id", "turn", "page_start", "page_end", "t_text", "ctx"]

# Spans: neighbouring sentences of a context, each as a passage of its own.
SPANS = f"""{BASE}, {sql.passages('turns')}, {st.sentences_sql('s', 'turns', 'doc_id')},
cp AS (SELECT t.item_id, t.turn, q.* EXCLUDE (item_id), d.* EXCLUDE (text) FROM turns t JOIN q USING (item_id) JOIN d USING (doc_id)),
cx AS (SELECT item_id, doc_id AS context_id, turn, round({scores.LEXICAL}, 9) AS ctx FROM ({sql.counts('cp')})),
u0 AS (SELECT doc_id AS context_id, l, unnest(l) AS text, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, {st.spans_sql('sents')} AS l FROM s)),
u AS (SELECT context_id * 1000 + i AS doc_id, context_id, text FROM u0 QUALIFY row_number() OVER (PARTITION BY context_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) ORDER BY i) = 1),
{sql.passages('u', 'e')},
sp AS (SELECT cx.*, u.doc_id, u.text AS t_text, q.* EXCLUDE (item_id), e.* EXCLUDE (doc_id, text) FROM u JOIN cx USING (context_id) JOIN q ON q.item_id = cx.item_id JOIN e ON e.doc_id = u.doc_id),
spans AS ({measured_sql(f"({sql.counts('sp')})")})"""


def spans(b: DataFrame, c: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """The spans of each context, measured. more: what else each question has (item_id, ...), if only those that have it are wanted."""
    held = placed(b, c).select("item_id", F.col("doc_id").alias("context_id"), "turn", "ctx", F.col("t_text").alias("_whole"))
    held = held if more is None else held.join(more, "item_id")
    held = held.repartition(int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")), "item_id")
    each = held.select("*", F.posexplode(st.spans(st.sentences(F.col("_whole")))).alias("i", "t_text")).drop("_whole")
    first = F.row_number().over(Window.partitionBy("item_id", "context_id", F.lower(tx.collapse(F.col("t_text")))).orderBy("i"))
    units = each.withColumn("_n", first).filter("_n = 1").drop("_n").withColumn("doc_id", F.col("context_id") * 1000 + F.col("i") + 1)
    return measured(retrieval.scored(retrieval.text_pairs(units, features(b), asked_only=True)))


def on_pairs(name: str, columns: dict[str, str], source=contexts, stage: str = f"{CONTEXTS} SELECT @COLUMNS FROM contexts") -> None:
    """The query of formulas on prompts and texts; both engines read the same formulas."""
    shown = "item_id, doc_id, " + ", ".join(f"round({e}, 6) AS {n}" for n, e in columns.items())
    query(name, stage.replace("@COLUMNS", shown), "benchmark", "conversations")(lambda b, c: source(b, c).select("item_id", "doc_id", *(F.round(F.expr(e), 6).alias(n) for n, e in columns.items())))


query("flt06_question_kinds", f"{BASE} SELECT item_id, {listed({k: v for k, v in prompt_measures(DUCK).items() if not k.endswith(('metrics', 'quarters', 'years'))})} FROM q", "benchmark")(
    lambda b: prompts(b).withColumnRenamed("text", "q_text").select("item_id", *exprs({k: v for k, v in prompt_measures(SPARK).items() if not k.endswith(("metrics", "quarters", "years"))}))
)
on_pairs("flt05_nickname_alias", {"alias": "CAST(alias AS DOUBLE)"})
on_pairs("vc18_support_parts", {"anchors": evidence.ANCHORS, "constraints": evidence.CONSTRAINTS})
on_pairs("vc19_answer_type", {"bonus": evidence.TYPE_BONUS, "penalty": evidence.TYPE_PENALTY})
on_pairs("vc20_numeric_scores", {"exact": evidence.EXACT, "aligned": evidence.ALIGNED, "temporal": evidence.TEMPORAL, "bonus": evidence.NUMERIC_BONUS, "penalty": evidence.NUMERIC_PENALTY})
GATES = {"vc17_sentence_scores": {"score": evidence.SENTENCE, "facet": evidence.FACET}, "flt13_gates": {"passes": f"CAST((CASE WHEN {evidence.GATE} THEN 1 ELSE 0 END) AS DOUBLE)"}}
for _name, _columns in GATES.items():
    on_pairs(_name, _columns, lambda b, c: spans(b, c).filter("dn > 0"), f"{SPANS} SELECT @COLUMNS FROM spans WHERE dn > 0")

ORDER = "score DESC, n DESC, dn, turn, doc_id"


@query("wn08_sentence_order", f"{SPANS}, o AS (SELECT *, round({evidence.SENTENCE}, 9) AS score FROM spans WHERE n > 0) SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY {ORDER}) AS rank FROM o", "benchmark", "conversations")
def _(b, c):
    scored = spans(b, c).filter("n > 0").withColumn("score", F.round(F.expr(evidence.SENTENCE), 9))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.desc("n"), "dn", "turn", "doc_id"))
    return scored.select("item_id", "doc_id", rank.alias("rank"))


#: The keys by which contexts are taken, best first.
def selection(d: Dialect) -> dict[str, str]:
    best = lambda x: f"max({x}) OVER (PARTITION BY item_id)"
    return {
        "k1": f"is_nick * alias * {best('alias')}",
        "k2": f"is_when * date * {best('date')}",
        "k3": f"round({evidence.TYPE_BONUS} - {evidence.TYPE_PENALTY}, 9)",
        "k4": "nc",
        "k5": "na",
        "k6": "n",
        "k7": f"round({scores.share('n', 'qn')}, 9)",
        "k8": f"round({scores.share('n', 'dn')}, 9)",
        "k9": "phrase",
        "k10": f"round({scores.run_bonus(0.2)}, 9)",
        "k11": "lex",
        "k12": "rerank",
        "k13": "-round(meta, 9)",
        "k14": f"-greatest({d.count('t_text', '[A-Za-z0-9]+')}, 1)",
    }


DESC = ", ".join(f"k{i} DESC" for i in range(1, 15))
RANKED = f"{CONTEXTS}, ordered AS (SELECT *, {listed(selection(DUCK))} FROM contexts), chosen AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY {DESC}, turn) AS rank FROM ordered)"


def chosen(b: DataFrame, c: DataFrame) -> DataFrame:
    keyed = contexts(b, c).select("*", *exprs(selection(SPARK)))
    return keyed.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*(F.desc(f"k{i}") for i in range(1, 15)), "turn")))


@query("wn07_selection_order", f"{RANKED} SELECT item_id, doc_id, rank FROM chosen", "benchmark", "conversations")
def _(b, c):
    return chosen(b, c).select("item_id", "doc_id", "rank")


@query("tx12_sentences", f"WITH RECURSIVE {TURNS}, {st.sentences_sql('s', 'turns', 'doc_id')} SELECT doc_id, unnest(sents) AS sentence, generate_subscripts(sents, 1) AS i FROM s", "conversations")
def _(c):
    each = turns(c).select("doc_id", F.posexplode(st.sentences(F.col("text"))).alias("p", "sentence"))
    return each.select("doc_id", "sentence", (F.col("p") + 1).cast("long").alias("i"))


@query("wn12_sliding_spans", f"WITH RECURSIVE {TURNS}, {st.sentences_sql('s', 'turns', 'doc_id')} SELECT doc_id, unnest(l) AS span, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, {st.spans_sql('sents')} AS l FROM s)", "conversations")
def _(c):
    each = turns(c).select("doc_id", F.posexplode(st.spans(st.sentences(F.col("text")))).alias("p", "span"))
    return each.select("doc_id", "span", (F.col("p") + 1).cast("long").alias("i"))


@query("tx14_clauses", f"WITH {TURNS} SELECT doc_id, unnest(l) AS clause, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, {st.CLAUSES_SQL} AS l FROM turns)", "conversations")
def _(c):
    each = turns(c).select("doc_id", F.posexplode(st.clauses(F.col("text"))).alias("p", "clause"))
    return each.select("doc_id", "clause", (F.col("p") + 1).cast("long").alias("i"))


@query("jn09_sentence_sequence", f"""WITH RECURSIVE {TURNS}, {st.sentences_sql('s', 'turns', 'doc_id')},
  n AS (SELECT doc_id, list_transform(sents, lambda x: lower(trim(regexp_replace(x, '\\s+', ' ', 'g')))) AS l FROM s), w AS (SELECT doc_id, l, l[2:3] AS target FROM n WHERE len(l) >= 3)
  SELECT doc_id, list_filter(range(1, len(l) - len(target) + 2), lambda i: l[i:i + len(target) - 1] = target)[1] AS at FROM w""", "conversations")
def _(c):
    """Where a run of sentences (the second and third of a text) first stands among the text's sentences."""
    flat = F.transform(st.sentences(F.col("text")), lambda x: F.lower(tx.collapse(x)))
    each = turns(c).select("doc_id", flat.alias("l")).filter(F.size("l") >= 3).withColumn("target", F.slice("l", 2, 2))
    starts = F.sequence(F.lit(1), F.size("l") - F.size("target") + 1)
    return each.select("doc_id", F.get(F.filter(starts, lambda i: F.slice("l", i, F.size("target")) == F.col("target")), F.lit(0)).cast("long").alias("at"))


# Facets: the parts of a question that asks for several things, as prompts of their own.
FLAT = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
MULTI = "(contains(lower(x), ' and ') OR contains(lower(x), 'both '))"
STRIP = "'^[ ,;:]+|[ ,;:]+$'"
FACET_TABLE = f"""f0 AS (SELECT item_id, {FLAT} AS x FROM prompts), f1 AS (SELECT item_id, x, list_filter(list_transform(string_split(regexp_replace(x, '\\s+(?i:and|or|then)\\s+', chr(31), 'g'), chr(31)), lambda p: regexp_replace(p, {STRIP}, '', 'g')), lambda p: p <> '') AS parts FROM f0),
f2 AS (SELECT item_id, unnest(l) AS text, generate_subscripts(l, 1) AS no FROM (SELECT item_id, CASE WHEN {MULTI} AND len(parts) >= 2 THEN parts ELSE [x] END AS l FROM f1)),
fx AS (SELECT item_id * 100 + no AS item_id, item_id AS question, no, text FROM f2)"""
FACETS = f"""WITH {PROMPTS}, {FACET_TABLE}, {sql.questions('fx')},
facets AS (SELECT fx.question, fx.no, q.* FROM q JOIN fx USING (item_id) WHERE qn > 0 QUALIFY row_number() OVER (PARTITION BY question, list_sort(q_terms) ORDER BY no) = 1)"""


def facets(b: DataFrame) -> DataFrame:
    """question, no and the features of each facet; parts of equal terms count once, those without terms not."""
    if isinstance(b, Given) and b.facets is not None:
        return b.facets
    x = tx.collapse(F.col("text"))
    parts = F.filter(F.transform(F.split(x, r"\s+(?i:and|or|then)\s+"), lambda p: F.regexp_replace(p, "^[ ,;:]+|[ ,;:]+$", "")), lambda p: p != "")
    several = F.contains(F.lower(x), F.lit(" and ")) | F.contains(F.lower(x), F.lit("both "))
    lists = prompts(b).select("item_id", tx.let(parts, lambda p: F.when(several & (F.size(p) >= 2), p).otherwise(F.array(x))).alias("l"))
    each = lists.select(F.col("item_id").alias("question"), F.posexplode("l").alias("p", "text")).withColumn("no", (F.col("p") + 1).cast("long"))
    each = each.select((F.col("question") * 100 + F.col("no")).alias("item_id"), "question", "no", "text")
    full = retrieval.question_features(each).join(each.select("item_id", "question", "no"), "item_id").filter("qn > 0")
    first = F.row_number().over(Window.partitionBy("question", F.array_sort("q_terms")).orderBy("no"))
    return full.withColumn("_n", first).filter("_n = 1").drop("_n")


@query("gr05_facets", f"{FACETS} SELECT question, no, q_text AS facet, qn, qa, qc FROM facets", "benchmark")
def _(b):
    return facets(b).select("question", "no", F.col("q_text").alias("facet"), F.col("qn").cast("long").alias("qn"), F.col("qa").cast("long").alias("qa"), F.col("qc").cast("long").alias("qc"))


# Support of a question by the terms of all its contexts.
ALL = "list_distinct(list_concat(q_terms, list_concat(q_anchors, q_constraints)))"
SUPPORT = f"""{FACETS}, {TURNS}, {sql.passages('turns')},
held AS (SELECT item_id AS question, list_distinct(flatten(list(terms))) AS held, count(*) AS n_contexts, bool_or(regexp_matches(d.text, '[0-9]')) AS any_digit, string_agg(lower(d.text), ' ') AS all_text FROM turns t JOIN d USING (doc_id) GROUP BY 1),
per AS (SELECT f.*, coalesce(h.held, {sql.EMPTY}) AS held, coalesce(n_contexts, 0) AS n_contexts, coalesce(any_digit, false) AS any_digit, coalesce(all_text, '') AS all_text FROM facets f LEFT JOIN held h USING (question)),
met AS (SELECT *, len({ALL}) AS k_all, len(list_intersect({ALL}, held)) AS m_all, len(list_intersect(q_anchors, held)) AS m_anchors, len(list_intersect(q_constraints, held)) AS m_constraints, len(list_intersect(q_terms, held)) AS m_terms FROM per)"""


def support(b: DataFrame, c: DataFrame) -> DataFrame:
    """facets() with what the contexts of their question hold of them."""
    t = turns(c)
    said = F.filter(F.split(retrieval.listed(F.lower(F.coalesce("text", F.lit(""))))["said"], " "), lambda x: x != "")
    held = t.withColumn("seq", said).groupBy(F.col("item_id").alias("question")).agg(
        F.array_distinct(F.flatten(F.collect_list("seq"))).alias("held"), F.count("*").alias("n_contexts"), F.bool_or(F.col("text").rlike("[0-9]")).alias("any_digit"), F.listagg(F.lower("text"), F.lit(" ")).alias("all_text")
    )
    per = facets(b).join(held, "question", "left").withColumns({"held": F.coalesce("held", F.array().cast("array<string>")), "n_contexts": F.coalesce("n_contexts", F.lit(0)), "any_digit": F.coalesce("any_digit", F.lit(False)), "all_text": F.coalesce("all_text", F.lit(""))})
    every = F.array_distinct(F.concat("q_terms", "q_anchors", "q_constraints"))
    met = lambda x: F.size(F.array_intersect(x, "held"))
    return per.withColumns({"k_all": F.size(every), "m_all": met(every), "m_anchors": met("q_anchors"), "m_constraints": met("q_constraints"), "m_terms": met("q_terms")})


@query("ag11_facet_support", f"{SUPPORT} SELECT question, round(avg(c), 6) AS mean, round(min(c), 6) AS least, count(*) AS facets FROM (SELECT question, {evidence.COVERAGE} AS c FROM met) GROUP BY 1", "benchmark", "conversations")
def _(b, c):
    each = support(b, c).select("question", F.expr(evidence.COVERAGE).alias("c"))
    return each.groupBy("question").agg(F.round(F.avg("c"), 6).alias("mean"), F.round(F.min("c"), 6).alias("least"), F.count("*").alias("facets"))


STRONG = f"(m_terms >= greatest(1, least(3, qn)) OR (m_anchors >= {evidence.required_anchors('qa')} AND m_constraints >= {evidence.required_constraints('qc')}))"


def summed(d: Dialect) -> dict[str, str]:
    """Per question, from its facets."""
    return {
        "facets": "count(*)",
        "strong": f"sum(CASE WHEN {STRONG} THEN 1 ELSE 0 END)",
        "base": f"avg({evidence.QUESTION_SUPPORT})",
        "coverage": f"avg({evidence.COVERAGE})",
        "any_constraints": "max(CASE WHEN qc > 0 THEN 1 ELSE 0 END)",
        "n_contexts": "max(n_contexts)",
        "any_digit": "max(CASE WHEN any_digit THEN 1 ELSE 0 END)",
        "all_text": "max(all_text)",
    }


QUESTIONS = f"""{SUPPORT}, per_q AS (SELECT question, {listed(summed(DUCK))} FROM met GROUP BY 1), best AS (SELECT 0),
judged AS (SELECT *, {listed(prompt_measures(DUCK))} FROM (SELECT per_q.*, p.text AS q_text FROM per_q JOIN prompts p ON p.item_id = question)),
rated AS (SELECT *, len(q_metrics) AS nq_metrics, len(list_filter(q_metrics, lambda x: contains(all_text, x))) AS m_metrics FROM judged)"""


def rated(b: DataFrame, c: DataFrame) -> DataFrame:
    """Each question with the counts of its facets, its kinds, and how many of its metrics its contexts name."""
    per = support(b, c).groupBy("question").agg(*exprs(summed(SPARK)))
    judged = per.join(prompts(b).select(F.col("item_id").alias("question"), F.col("text").alias("q_text")), "question").select("*", *exprs(prompt_measures(SPARK)))
    return judged.select("*", F.size("q_metrics").alias("nq_metrics"), F.size(F.filter("q_metrics", lambda x: F.contains(F.col("all_text"), x))).alias("m_metrics"))


METRIC_SHARE = "(CASE WHEN n_contexts = 0 THEN 0.0 WHEN nq_metrics = 0 THEN 1.0 ELSE m_metrics / CAST(nq_metrics AS DOUBLE) END)"
WEAK = "(n_contexts = 0 OR strong = 0 OR (facets > 1 AND strong < facets) OR (q_numeric = 1 AND any_digit = 0))"


def on_questions(name: str, columns: dict[str, str]) -> None:
    shown = lambda n, e: f"round({e}, 6) AS {n}" if n not in WORDS else f"{e} AS {n}"
    query(name, f"{QUESTIONS} SELECT question, {', '.join(shown(n, e) for n, e in columns.items())} FROM rated", "benchmark", "conversations")(
        lambda b, c: rated(b, c).select("question", *(F.expr(e).alias(n) if n in WORDS else F.round(F.expr(e), 6).alias(n) for n, e in columns.items()))
    )


WORDS = {"route", "weak", "strict"}
on_questions("vc21_question_support", {"metric": METRIC_SHARE, "coverage": f"least(1.0, 0.65 * coverage + 0.2 * {METRIC_SHARE} + 0.15 * (CASE WHEN q_numeric = 0 OR any_digit = 1 THEN 1.0 ELSE 0.0 END))", "support": f"least(1.0, 0.65 * base + 0.15 * {METRIC_SHARE})"})
on_questions("vc22_thresholds", {"answer": evidence.THRESHOLD, "citation": evidence.CITATION_THRESHOLD, "facet": evidence.FACET_THRESHOLD})
on_questions("gr12_router", {"route": f"CASE WHEN {WEAK} THEN 'unsupported' WHEN facets > 1 THEN 'synthesis' ELSE 'extractive' END", "weak": WEAK, "strict": evidence.STRICT})


# Siblings and neighbours among the turns of a conversation.
USEFUL = """(CASE WHEN nq_metrics > 0 THEN m_metrics > 0 WHEN q_exact = 1 AND (nt_quarters > 0 OR t_ttm = 1) AND n > 0 THEN true
  WHEN n >= 3 THEN true ELSE q_numeric = 1 AND n >= 2 AND t_digit = 1 END)"""


@query("flt10_useful_sibling", f"{CONTEXTS} SELECT item_id, doc_id, {USEFUL} AS useful FROM contexts", "benchmark", "conversations")
def _(b, c):
    return contexts(b, c).select("item_id", "doc_id", F.expr(USEFUL).alias("useful"))


@query("jn04_page_siblings", f"""{CONTEXTS}, x AS (SELECT item_id, doc_id AS parent, turn AS parent_turn, page_start AS a, page_end AS b, ctx FROM contexts WHERE turn % 2 = 0 AND page_start = page_end),
  y AS (SELECT item_id, doc_id, turn, page_start, page_end, {USEFUL} AS useful FROM contexts WHERE NOT (turn % 2 = 0 AND page_start = page_end))
  SELECT item_id, doc_id, parent, round(greatest(ctx - 0.04, 0.0), 6) AS score FROM (SELECT y.item_id, doc_id, parent, ctx, row_number() OVER (PARTITION BY y.item_id, doc_id ORDER BY parent_turn) AS r FROM y JOIN x ON x.item_id = y.item_id AND y.page_start <= x.b AND y.page_end >= x.a WHERE useful) WHERE r = 1""", "benchmark", "conversations")
def _(b, c):
    """Turns on the pages of a retrieved context (here: even turns of one page) that help: the first parent gives its score less 0.04."""
    every = contexts(b, c).select("item_id", "doc_id", "turn", "page_start", "page_end", "ctx", F.expr(USEFUL).alias("useful"))
    got = (F.col("turn") % 2 == 0) & (F.col("page_start") == F.col("page_end"))
    x = every.filter(got).select("item_id", F.col("doc_id").alias("parent"), F.col("turn").alias("parent_turn"), F.col("page_start").alias("a"), F.col("page_end").alias("b"), F.col("ctx").alias("score"))
    y = every.filter(~got & F.col("useful")).select("item_id", "doc_id", "page_start", "page_end")
    both = y.join(x, "item_id").filter((F.col("page_start") <= F.col("b")) & (F.col("page_end") >= F.col("a")))
    first = both.groupBy("item_id", "doc_id").agg(F.min_by(F.struct("parent", "score"), "parent_turn").alias("p"))
    return first.select("item_id", "doc_id", "p.parent", F.round(F.greatest(F.col("p.score") - 0.04, F.lit(0.0)), 6).alias("score"))


ADDED = "len(list_intersect(list_filter(b.terms, lambda x: NOT list_contains(a.terms, x)), a.q_terms))"
RAW_PAIR = "len(list_filter(range(1, len(b.raw)), lambda i: list_contains(a.q_terms, b.raw[i]) AND list_contains(a.q_terms, b.raw[i + 1]))) > 0"


@query("jn05_best_neighbour", f"""{CONTEXTS}, z AS (SELECT *, regexp_extract_all(lower(t_text), '[a-z0-9]+') AS raw FROM contexts),
  n AS (SELECT a.item_id, a.doc_id, b.doc_id AS neighbour, b.turn, {ADDED} AS added, round({scores.share('b.n', 'b.qn')}, 9) AS overlap, len(list_intersect(a.terms, b.terms)) AS shared, {RAW_PAIR} AS raw_pair, a.qn, b.n AS bn FROM z a JOIN z b ON a.item_id = b.item_id AND (b.turn = a.turn + 1 OR b.turn = a.turn - 1)),
  m AS (SELECT *, (qn = 0 OR added > 0 OR (qn >= 2 AND raw_pair) OR (shared >= 3 AND bn > 0)) AS useful FROM n QUALIFY row_number() OVER (PARTITION BY item_id, doc_id ORDER BY added DESC, overlap DESC, shared DESC, turn) = 1)
  SELECT item_id, doc_id, neighbour, added, shared, useful FROM m""", "benchmark", "conversations")
def _(b, c):
    """Of the turns next to a context the best by added question terms, overlap and shared terms, and whether it is worth adding (FLT11)."""
    z = contexts(b, c).select("item_id", "doc_id", "turn", F.array_distinct("seq").alias("terms"), "q_terms", "qn", "n", F.regexp_extract_all(F.lower("t_text"), F.lit("[a-z0-9]+"), F.lit(0)).alias("raw"))
    other = z.select("item_id", F.col("doc_id").alias("neighbour"), F.col("turn").alias("t2"), F.col("terms").alias("b_terms"), F.col("n").alias("bn"), F.col("raw").alias("b_raw"))
    beside = z.withColumn("t2", F.explode(F.array(F.col("turn") - 1, F.col("turn") + 1))).join(other, ["item_id", "t2"])
    held = lambda x: F.array_contains(F.col("q_terms"), x)
    raw = F.exists(F.zip_with(F.slice("b_raw", 1, F.greatest(F.size("b_raw") - 1, F.lit(0))), F.slice("b_raw", 2, F.size("b_raw")), lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda p: held(p["x"]) & held(p["y"]))
    each = beside.withColumns({"added": F.size(F.array_intersect(F.array_except("b_terms", "terms"), "q_terms")), "overlap": F.round(F.expr(scores.share("bn", "qn")), 9), "shared": F.size(F.array_intersect("terms", "b_terms")), "raw_pair": raw})
    useful = (F.col("qn") == 0) | (F.col("added") > 0) | ((F.col("qn") >= 2) & F.col("raw_pair")) | ((F.col("shared") >= 3) & (F.col("bn") > 0))
    best = F.row_number().over(Window.partitionBy("item_id", "doc_id").orderBy(F.desc("added"), F.desc("overlap"), F.desc("shared"), "t2"))
    long = lambda x: F.col(x).cast("long").alias(x)
    return each.withColumn("r", best).filter("r = 1").select("item_id", "doc_id", "neighbour", long("added"), long("shared"), useful.alias("useful"))


@query("flt12_same_location", f"WITH {TURNS} SELECT a.doc_id, count(b.doc_id) AS same FROM turns a LEFT JOIN turns b ON b.item_id = a.item_id AND b.page_start = a.page_start AND b.page_end = a.page_end AND b.doc_id <> a.doc_id GROUP BY 1", "conversations")
def _(c):
    t = turns(c)
    return t.select("doc_id", (F.count("*").over(Window.partitionBy("item_id", "page_start", "page_end")) - 1).alias("same"))
