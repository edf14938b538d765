"""From questions to final answers in one dataflow: search, page siblings, packing, route, answer, citations, claims, gate.

Each stage is a relation over all questions at once. Questions that a stage turns away take no part in the next ones,
and come back at the end with the refusal that the stage gives, so that the result has a row for each question."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Settings
from ..functions import sentences as st
from ..functions import text as tx
from ..functions.dialect import SPARK, prompt_measures
from ..operators import answers, chunks, retrieval, scores
from ..sources.scratch import saved, spread, tidied
from . import verdicts
from .citations import excerpts, merged, ranked, supported, worded
from .evidence import USEFUL, WEAK, Given, asked_features, chosen, exprs, facets, measured, prompts, rated
from .registry import QUERIES
from .replies import replied

# The text of a refusal.
REFUSAL = "I could not find enough support in the indexed document content to answer that question."
#: Confidence of a refusal by the stage that gives it.
REFUSED = {"route": 0.78, "answer": 0.74, "gate": 0.7}
CITATIONS, CLAIM_SUPPORT = 3, 0.45
#: What an answer's sentences are numbered by: more than an answer has.
UNITS = 100


@dataclass(frozen=True)
class Asked:
    """The stages' relations, each by item_id: hits, expanded and assembled contexts, and the final answers."""

    hits: DataFrame
    expanded: DataFrame
    assembled: DataFrame
    answers: DataFrame


def passages(parts: DataFrame) -> DataFrame:
    """chunks.build_chunks() as search reads them: doc_id puts ties in order of page, number and document."""
    key = F.format_string("%08d:%08d:%s", F.col("page_start").cast("int"), F.col("chunk_index").cast("int"), F.col("document_id").cast("string"))
    return parts.select(key.alias("doc_id"), *(c for c in ("document_id", "chunk_index", "page_start", "page_end", "heading", "text", "token_estimate") if c in parts.columns))


def expand(questions: DataFrame, hits: DataFrame, parts: DataFrame) -> DataFrame:
    """hits, and the passages on their pages that help: with the scores of the first hit they stand beside, and 0.04 less.

    Pages are joined one by one, so what is read of a document follows its hits. A hit of several pages brings none, unless an exact figure is asked for."""
    questions = questions if "q_exact" in questions.columns else asked_features(questions)
    asked = questions.select("item_id", "q_exact")
    pages = lambda df: df.withColumn("page", F.explode(F.sequence("page_start", "page_end")))
    own = hits.join(asked, "item_id").filter((F.col("page_start") == F.col("page_end")) | (F.col("q_exact") == 1))
    own = pages(own).select("item_id", "document_id", "page", F.struct("rank", "score", "dense_score", "lexical_score", "hybrid", "rerank").alias("parent"))
    there = parts.join(retrieval.small_side(own.select("document_id").distinct(), 64), "document_id", "left_semi")
    beside = pages(there).join(own, ["document_id", "page"]).groupBy("item_id", "doc_id").agg(F.min("parent").alias("parent"))
    beside = saved(beside.join(hits.select("item_id", "doc_id"), ["item_id", "doc_id"], "left_anti"), "beside")
    order = Window.partitionBy("item_id").orderBy("from_hit", "by", "page_start", "page_end", "chunk_index")
    every = hits.withColumns({"from_hit": F.lit(0), "by": F.col("rank")})
    kept = ["item_id", "doc_id", "document_id", "chunk_index", "page_start", "page_end", "text", "token_estimate", "dense_score", "lexical_score", "hybrid", "rerank", "score"]
    placed = lambda rows: rows.withColumn("place", F.row_number().over(order)).select(*kept, "place", (F.col("from_hit") == 0).alias("hit"))
    if beside.isEmpty():
        return placed(every)
    texts = there.join(retrieval.small_side(beside.select("doc_id").distinct(), 64), "doc_id", "left_semi")
    pairs = beside.join(texts, "doc_id").withColumn("t_text", F.col("text"))
    useful = measured(retrieval.scored(retrieval.text_pairs(pairs.select("item_id", "doc_id", "t_text"), questions, asked_only=True))).filter(F.expr(USEFUL)).select("item_id", "doc_id")
    more = pairs.join(useful, ["item_id", "doc_id"]).withColumns({"score": F.greatest(F.col("parent.score") - 0.04, F.lit(0.0)), **{c: F.col(f"parent.{c}") for c in ("dense_score", "lexical_score", "hybrid", "rerank")}})
    return placed(every.unionByName(more.withColumns({"from_hit": F.lit(1), "by": F.col("parent.rank")}), allowMissingColumns=True))


def given(rows: DataFrame, text: str = "text") -> Given:
    """Contexts in the shape of turns(): numbered by question and place. turn puts neighbours of a document side by side."""
    number = F.col("item_id") * 1000 + F.col("place")
    documents = F.dense_rank().over(Window.partitionBy("item_id").orderBy("document_id"))
    turn = documents.cast("long") * 1_000_000_000 + F.col("chunk_index")
    return Given(rows.select(number.alias("doc_id"), "item_id", turn.alias("turn"), "page_start", "page_end", F.col(text).alias("text"), F.col("score").alias("ctx"), F.col("lexical_score").alias("lex"), "rerank", "document_id", "chunk_index", "token_estimate"))


def pack(asked: Given, held: Given, budget: int = 1400) -> DataFrame:
    """doc_id and item_id of the contexts that an answer is made from, within the budget of tokens."""
    tokens = F.greatest(F.expr("-k14").cast("long"), F.coalesce(F.col("token_estimate").cast("long"), F.lit(0)), F.lit(1).cast("long"))
    some = chosen(asked, held).join(held.rows.select("doc_id", "token_estimate", "document_id"), "doc_id")
    # One of the same pages is of the same document as well: pages are numbered apart by document.
    apart = F.dense_rank().over(Window.partitionBy("item_id").orderBy("document_id")).cast("long") * 1_000_000
    raw = F.regexp_extract_all(F.lower("t_text"), F.lit("[a-z0-9]+"), F.lit(0))
    some = some.select("item_id", "doc_id", "turn", (apart + F.col("page_start")).alias("page_start"), (apart + F.col("page_end")).alias("page_end"), "rank", F.array_distinct("seq").alias("terms"), "q_terms", tokens.alias("cost"), raw.alias("raw"))
    some = saved(some, "chosen")
    return chunks.assemble(some, "item_id", budget).select("item_id", "doc_id")


def units(said: DataFrame) -> DataFrame:
    """The claims of each answer (item_id, answer, main): its sentences, each once, the first with the context it is from."""
    each = said.select("item_id", F.col("main").alias("first"), F.posexplode(st.sentences(F.col("answer"))).alias("p", "a_text"))
    r = (F.col("p") + 1).alias("r")
    return worded(each.select((F.col("item_id") * UNITS + F.col("p") + 1).alias("unit"), "item_id", r, F.when(F.col("p") == 0, F.col("first")).alias("main"), "a_text"))


CITATION = "struct<context_id:bigint,ctx:double,text:string>"


def cite(asked: Given, held: Given, claims: DataFrame) -> DataFrame:
    """item_id, place, context_id, ctx and text of the citations of each answer (claims as of units()), CITATIONS at most.

    Claims take turns: each brings its best excerpt, which joins that of the same context if there is one already, and, where a
    cause is asked for or given, one more of the same pages that has two or more of the terms still missing."""
    found = ranked(asked, held, claims).join(held.rows.select(F.col("doc_id").alias("context_id"), "document_id"), "context_id")
    subject = F.array_distinct(F.concat("a_terms", "q_anchors", "q_constraints", "q_named"))
    more = answers.may_need_more(F.col("a_text"), F.col("q_text"))
    named = tx.subjects(F.col("q_text"))
    one = F.struct("rank", "context_id", "ctx", "score", "document_id", "page_start", "page_end", F.trim("t_text").alias("text"), F.array_distinct("seq").alias("terms"))
    lists = found.withColumn("q_named", named).groupBy("item_id", "unit", "r").agg(F.sort_array(F.collect_list(one)).alias("l"), F.first(subject).alias("subject"), F.first(more).alias("more"))
    rows = lists.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("r", "l", "subject", "more"))).alias("u"))
    short = lambda e: F.struct(e["context_id"].cast("long").alias("context_id"), e["ctx"].cast("double").alias("ctx"), e["text"].alias("text"))

    def joined(out: Column, e: Column) -> Column:
        return F.transform(out, lambda c: F.when(c["context_id"] == e["context_id"], F.struct(c["context_id"], c["ctx"], merged(c["text"], e["text"]).alias("text"))).otherwise(c))

    def supplement(out: Column, u: Column, e: Column) -> Column:
        """out with one more excerpt of the pages of e, if one has two of the terms that e lacks."""

        def of(missing: Column) -> Column:
            new = lambda x: ~F.exists(out, lambda c: c["context_id"] == x["context_id"]) & (F.size(F.array_intersect(missing, x["terms"])) >= 2)
            same = lambda x: (x["document_id"] == e["document_id"]) & (x["page_start"] == e["page_start"]) & (x["page_end"] == e["page_end"])
            good = F.filter(F.slice(u["l"], F.lit(2), F.size(u["l"])), lambda x: new(x) & same(x) & (x["score"] + 0.35 >= F.greatest(e["ctx"], F.lit(0.01))))
            return F.when((F.size(missing) >= 2) & (F.size(good) > 0), F.concat(out, F.array(short(F.get(good, F.lit(0)))))).otherwise(out)

        return tx.let(F.array_except(u["subject"], e["terms"]), of)

    def step(out: Column, u: Column) -> Column:
        def of(e: Column) -> Column:
            there = F.exists(out, lambda c: c["context_id"] == e["context_id"])
            longer = tx.let(F.concat(out, F.array(short(e))), lambda o: F.when(u["more"] & (F.size(o) < CITATIONS), supplement(o, u, e)).otherwise(o))
            return F.when(F.size(out) >= CITATIONS, out).when(there, joined(out, e)).otherwise(longer)

        return tx.let(F.get(u["l"], F.lit(0)), of)

    kept = rows.select("item_id", F.posexplode(F.aggregate("u", F.array().cast(f"array<{CITATION}>"), step)).alias("place", "c")).select("item_id", "place", "c.*")
    # An answer that no excerpt speaks for has one of the context it is from.
    whole = claims.join(kept.select("item_id").distinct(), "item_id", "left_anti").groupBy("item_id").agg(F.max("main").alias("main"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "a_text"))), lambda x: x["a_text"]), " ").alias("a_text"))
    whole = saved(whole.filter("main IS NOT NULL"), "unspoken")
    if whole.isEmpty():
        return kept
    own = worded(whole.select((F.col("item_id") * UNITS).alias("unit"), "item_id", F.lit(1).alias("r"), "main", "a_text"))
    only = held.rows.join(whole.select("item_id", F.col("main").alias("doc_id")), ["item_id", "doc_id"], "left_semi")
    least = excerpts(asked, Given(only.withColumn("ctx", F.greatest("ctx", F.lit(1e-9)))), own)
    real = only.select(F.col("doc_id").alias("context_id"), F.col("ctx").alias("own"))
    last = least.join(real, "context_id").select("item_id", F.lit(0).alias("place"), "context_id", F.col("own").alias("ctx"), F.trim("t_text").alias("text"))
    return kept.unionByName(last)


def verify(asked: Given, held: Given, citations: DataFrame, claims: DataFrame) -> DataFrame:
    """claims with x, terms, context_id and ctx of what speaks best for each among the citations of its answer, and its support (0 if nothing does)."""
    pool = Given(citations.withColumnRenamed("context_id", "doc_id").join(held.rows.drop("ctx", "text", "item_id"), "doc_id"))
    top = ranked(asked, pool, claims.withColumn("main", F.lit(None).cast("long"))).filter("rank = 1")
    top = saved(top.select("item_id", "unit", "r", "context_id", "ctx", F.trim("t_text").alias("x"), F.array_distinct("seq").alias("terms"), "a_terms"), "spoken")
    rated_ = claims.join(top.select("unit", "context_id", "ctx", "x", "terms"), "unit", "left").join(supported(asked, top).select("unit", "support"), "unit", "left")
    return rated_.withColumn("support", F.coalesce("support", F.lit(0.0)))


def gate(asked: Given, claims: DataFrame, citations: DataFrame, weight: float) -> DataFrame:
    """plain, covered, support and passed of each answer by its claims (as of verify()) and citations."""
    every = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    said = claims.groupBy("item_id").agg(every("a_terms").alias("a_every"), verdicts.said("a_text").alias("a_text"), F.count("*").alias("claims"), F.count_if(F.col("support") >= CLAIM_SUPPORT).alias("supported"), F.avg("support").alias("mean_claim"))
    held = citations.withColumn("terms", F.array_distinct(tx.sequence(F.col("text")))).withColumnRenamed("place", "r").groupBy("item_id").agg(every("terms").alias("c_terms"), verdicts.said("text").alias("c_text"), F.count("*").alias("cites"), F.avg("ctx").alias("mean_ctx"))
    return verdicts.gated(asked, said.join(held, "item_id"), weight)


#: Answers by name: (asked, contexts) -> question, answer, main.
ANSWERERS = {"extractive": replied}


def ask(questions: DataFrame, parts: DataFrame, k: int = 5, settings: Settings = scores.DEFAULTS) -> Asked:
    """Answers each of questions (item_id, text, maybe document_id) from parts (chunks of ready documents), as settings say.

    answers: item_id, route, outcome, mode, answer, supported, confidence, support, coverage, n_hits, n_expanded, n_assembled,
    citations and claims. outcome tells the stage that decided: route, answer or gate (refused), accepted, repaired."""
    p = saved(passages(parts), "passages")
    plain = questions.select("item_id", tx.collapse(F.coalesce("text", F.lit(""))).alias("text"), *(["document_id"] if "document_id" in questions.columns else []))
    plain = saved(plain.join(asked_features(spread(plain)), "item_id"), "asked")
    asked = Given(plain.select("item_id", "text"), plain.drop("text", "document_id"))
    parts_of = saved(retrieval.packed(facets(Given(spread(asked.rows)))).select("*", *exprs(prompt_measures(SPARK))), "facets")
    asked = Given(asked.rows, asked.features, parts_of)
    reply = retrieval.named(ANSWERERS, settings.answer_provider)
    found = retrieval.search(plain, p, k, settings).select("item_id", "doc_id", "rank", "dense_score", "lexical_score", "hybrid", "rerank", "score")
    hits = saved(found.join(p, "doc_id"), "hits")
    expanded = saved(expand(plain, hits, p), "expanded")
    every = given(expanded)
    every = Given(saved(every.rows, "contexts"))
    taken = saved(pack(asked, every), "taken")
    assembled = Given(every.rows.join(taken, ["item_id", "doc_id"], "left_semi"))

    facts = rated(asked, assembled).select(F.col("question").alias("item_id"), F.expr(WEAK).alias("weak"))
    routed = saved(plain.select("item_id", "text").join(facts, "item_id", "left").select("item_id", "text", F.when(F.coalesce("weak", F.lit(True)), "unsupported").otherwise("extractive").alias("route")), "routed")
    open_ = asked.only(routed.filter("route = 'extractive'"))
    mine = Given(every.rows.join(open_.rows.select("item_id"), "item_id", "left_semi"))
    told = saved(reply(open_, mine).select(F.col("question").alias("item_id"), "answer", "main"), "told")
    claims = saved(units(told), "units")
    citations = saved(cite(open_, mine, claims), "cited")
    judged = saved(verify(open_, mine, citations, claims), "judged")
    first = saved(gate(open_, judged, citations, 0.65), "first")

    # Answers with some claims unsupported are tried again without these, by what spoke for the others.
    again = first.filter("NOT passed AND claims > supported AND supported > 0").select("item_id")
    left = judged.filter(F.col("support") >= CLAIM_SUPPORT).join(again, "item_id", "left_semi")
    texts = saved(left.groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "a_text"))), lambda x: answers.ended(x["a_text"])), " ").alias("answer"), F.lit(None).cast("long").alias("main")), "repaired")
    own = left.withColumn("n", F.row_number().over(Window.partitionBy("item_id", "context_id").orderBy("r"))).filter("n = 1")
    second_citations = own.select("item_id", F.col("r").alias("place"), "context_id", "ctx", F.col("x").alias("text"))
    if texts.isEmpty():
        second, second_judged = first.filter("false"), judged.filter("false")
    else:
        second_citations = saved(second_citations, "cited")
        second_judged = saved(verify(open_, mine, second_citations, units(texts)), "judged")
        second = saved(gate(open_, second_judged, second_citations, 0.6).filter("passed"), "second")

    return Asked(hits, expanded, assembled.rows, _final(routed, told, texts, first, second, (citations, second_citations), (judged, second_judged), every, {"n_hits": hits, "n_expanded": expanded, "n_assembled": taken}))


def _final(routed, told, texts, first, second, citations, judged, every, counted) -> DataFrame:
    """A row for each question, from what the stages left of it."""
    repaired = second.select("item_id", F.col("support").alias("support2"), F.col("covered").alias("covered2")).join(texts.select("item_id", F.col("answer").alias("answer2")), "item_id")
    per = routed.select("item_id", "route").join(told.select("item_id", "answer"), "item_id", "left").join(first.select("item_id", "support", "covered", "passed"), "item_id", "left").join(repaired, "item_id", "left")
    outcome = F.when(F.col("route") == "unsupported", "route").when(F.col("answer").isNull() | F.col("passed").isNull(), "answer").when(F.col("passed"), "accepted").when(F.col("support2").isNotNull(), "repaired").otherwise("gate")
    per = per.withColumn("outcome", outcome)
    by = lambda cases: F.coalesce(*(F.when(F.col("outcome") == o, v) for o, v in cases.items()))
    bound = lambda v, low, high: F.least(F.lit(high), F.greatest(F.lit(low), v))
    where = every.rows.select(F.col("doc_id").alias("context_id"), "document_id", "chunk_index", "page_start", "page_end")
    final = per.select("item_id", (F.col("outcome") == "repaired").alias("_again"), F.col("outcome").isin("accepted", "repaired").alias("_good"))

    def shown(tables: tuple[DataFrame, DataFrame], order: str, one: Column, name: str, needs: str) -> DataFrame:
        rows = tables[0].withColumn("_again", F.lit(False)).unionByName(tables[1].withColumn("_again", F.lit(True)), allowMissingColumns=True)
        rows = rows.join(final.filter(needs), ["item_id", "_again"])
        return rows.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), one.alias("x")))), lambda e: e["x"]).alias(name))

    cited_ = shown(tuple(c.join(where, "context_id") for c in citations), "place", F.struct("document_id", "chunk_index", "page_start", "page_end", "text"), "citations", "_good")
    claims_ = shown(judged, "r", F.struct(F.col("a_text").alias("text"), F.round("support", 6).alias("support"), (F.col("support") >= CLAIM_SUPPORT).alias("supported")), "claims", "true")
    for name, rows in counted.items():
        per = per.join(rows.groupBy("item_id").agg(F.count("*").alias(name)), "item_id", "left")
    good = F.col("outcome").isin("accepted", "repaired")
    return (
        per.join(cited_, "item_id", "left")
        .join(claims_, "item_id", "left")
        .select(
            "item_id",
            "route",
            "outcome",
            F.when(good, "extractive").otherwise("unsupported").alias("mode"),
            by({"accepted": F.col("answer"), "repaired": F.col("answer2"), **dict.fromkeys(REFUSED, F.lit(REFUSAL))}).alias("answer"),
            good.alias("supported"),
            F.round(by({"accepted": bound(0.45 + 0.5 * F.col("support"), 0.35, 0.98), "repaired": bound(0.4 + 0.45 * F.col("support2"), 0.32, 0.94), **{k: F.lit(v) for k, v in REFUSED.items()}}), 6).alias("confidence"),
            F.round(by({"accepted": F.col("support"), "repaired": F.col("support2"), "gate": F.col("support"), "route": F.lit(0.0), "answer": F.lit(0.0)}), 6).alias("support"),
            F.round(by({"accepted": F.col("covered"), "repaired": F.col("covered2"), "gate": F.col("covered")}), 6).alias("coverage"),
            *(F.coalesce(n, F.lit(0)).alias(n) for n in counted),
            F.coalesce("citations", F.array().cast(cited_.schema["citations"].dataType)).alias("citations"),
            F.coalesce("claims", F.array().cast(claims_.schema["claims"].dataType)).alias("claims"),
        )
    )


def document_pages(d: DataFrame) -> DataFrame:
    """Documents as pages: one each."""
    return d.select(F.col("doc_id").cast("string").alias("document_id"), F.lit(1).alias("page_number"), F.coalesce("text", F.lit("")).alias("raw_text"))


def gr17_answers(spark, sf_dir: str) -> DataFrame:
    """The benchmark's texts as questions of eight kinds (see evidence), answered from chunks of all documents."""
    b, d = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("benchmark", "documents"))
    parts = chunks.build_chunks(chunks.normalise_pages(document_pages(d)), chunks.PRESETS["small"])
    return ask(prompts(b), parts).answers


QUERIES["gr17_answers"] = lambda spark, sf_dir: tidied(spark, "gr17_answers", lambda: gr17_answers(spark, sf_dir))
