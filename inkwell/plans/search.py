"""Search queries: lexical, dense, fused and reranked, each with the whole of its formula."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sql
from ..functions import text as tx
from ..operators import cells, postings, retrieval, scores
from ..sources.scratch import spread, tidied
from .registry import FLAGSHIP, QUERIES, query

LIMIT, K = 20, 5

PAIRS = "p AS (SELECT q.*, d.* FROM q, d)"
LEXICAL = f"""{sql.questions()}, {sql.passages()}, {PAIRS},
lexical AS (SELECT item_id, doc_id, round({scores.LEXICAL}, 9) AS score FROM ({sql.counts('p')}))"""


def ranked(source: str, k: int, order: str, columns: str = "*", key: str = "item_id") -> str:
    return f"SELECT {columns}, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rank FROM {source} QUALIFY rank <= {k}"


DENSE = f"""dw AS ({sql.embedding('documents', 'doc_id')}), qw AS ({sql.embedding('benchmark', 'item_id')}),
dl AS (SELECT doc_id, sqrt(sum(weight * weight)) AS l FROM dw GROUP BY 1), ql AS (SELECT item_id, sqrt(sum(weight * weight)) AS l FROM qw GROUP BY 1),
dots AS (SELECT item_id, doc_id, sum(qw.weight * dw.weight) AS dot FROM qw JOIN dw USING (dim) GROUP BY 1, 2),
dense AS (SELECT b.item_id, x.doc_id, round(coalesce(dot / nullif(ql.l * dl.l, 0), 0.0), 9) AS score FROM benchmark b CROSS JOIN documents x
  LEFT JOIN ql USING (item_id) LEFT JOIN dl USING (doc_id) LEFT JOIN dots ON dots.item_id = b.item_id AND dots.doc_id = x.doc_id)"""
LISTS = f"""WITH {LEXICAL}, {DENSE},
r1 AS ({ranked('dense', LIMIT, 'score DESC, doc_id')}), r2 AS ({ranked('(SELECT * FROM lexical WHERE score > 0)', LIMIT, 'score DESC, doc_id')}),
u AS (SELECT coalesce(r1.item_id, r2.item_id) AS item_id, coalesce(r1.doc_id, r2.doc_id) AS doc_id, r1.rank AS dense_rank, r2.rank AS lexical_rank,
  coalesce(r1.score, 0.0) AS dense_score, coalesce(r2.score, 0.0) AS lexical_score FROM r1 FULL JOIN r2 ON r1.item_id = r2.item_id AND r1.doc_id = r2.doc_id)"""
CANDIDATES = f"""{LISTS},
cp AS (SELECT u.*, q.* EXCLUDE (item_id), d.* EXCLUDE (doc_id) FROM u JOIN q USING (item_id) JOIN d USING (doc_id)), cc AS ({sql.counts('cp')}),
met AS (SELECT item_id, doc_id, unnest(list_intersect(terms, q_terms)) AS term FROM cc),
df AS (SELECT item_id, term, count(*) AS df FROM met GROUP BY 1, 2), cn AS (SELECT item_id, count(*) AS cn FROM cc GROUP BY 1),
rare AS (SELECT item_id, doc_id, sum(ln((cn + 1.0) / df)) AS r FROM met JOIN df USING (item_id, term) JOIN cn USING (item_id) GROUP BY 1, 2),
cr AS (SELECT cc.*, round(least(1.0, coalesce(r, 0.0) / greatest(qn, 1)), 9) AS rarity FROM cc LEFT JOIN rare ON rare.item_id = cc.item_id AND rare.doc_id = cc.doc_id),
cf AS (SELECT *, round(least(1.0, {scores.LEXICAL}), 9) AS specificity, round({scores.FOCUS}, 9) AS focus, round({scores.INTENT}, 9) AS intent, round({scores.PENALTY}, 9) AS penalty, round({scores.FUSED}, 9) AS fused FROM cr),
cand AS (SELECT *, round(CASE WHEN max(fused) OVER (PARTITION BY item_id) > 0 THEN fused / max(fused) OVER (PARTITION BY item_id) ELSE 0.0 END, 9) AS hybrid FROM cf)"""
FUSED_ORDER = "hybrid DESC, lexical_score DESC, dense_score DESC, doc_id"
FINAL_ORDER = "score DESC, rerank DESC, hybrid DESC, lexical_score DESC, dense_score DESC, doc_id"
SEARCH = f"""{CANDIDATES},
fu AS ({ranked('cand', LIMIT, FUSED_ORDER)}),
re AS (SELECT *, round({scores.RERANK}, 9) AS rerank FROM (SELECT * EXCLUDE (rank), rank AS fused_rank FROM fu)),
fi AS (SELECT *, round({scores.FINAL}, 9) AS score FROM re),
hits AS ({ranked('fi', K, FINAL_ORDER)})"""


def found(b: DataFrame, d: DataFrame) -> DataFrame:
    return retrieval.search(b, d, K)


def columns(name: str, stage: str, source, wanted: list[str]) -> None:
    """The query of a stage's columns."""

    def run(b: DataFrame, d: DataFrame) -> DataFrame:
        return source(b, d).select("item_id", "doc_id", *(F.round(c, 6).alias(c) if c not in INTS else F.col(c) for c in wanted))

    shown = ", ".join(c if c in INTS else f"round({c}, 6) AS {c}" for c in wanted)
    with_, _, last = stage.rpartition(" FROM ")
    query(name, f"{with_} SELECT item_id, doc_id, {shown} FROM {last}", "benchmark", "documents")(run)


INTS = {"rank", "fused_rank", "dense_rank", "lexical_rank"}

query(FLAGSHIP, f"WITH {LEXICAL} SELECT item_id, doc_id, round(score, 6) AS score, rank FROM ({ranked('(SELECT * FROM lexical WHERE score > 0)', K, 'score DESC, doc_id')})", "benchmark", "documents")(
    lambda b, d: retrieval.lexical(b, d, K).select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank")
)
query("jn02_inverted_index", f"WITH {LEXICAL} SELECT item_id, doc_id, round(score, 6) AS score, rank FROM ({ranked('(SELECT * FROM lexical WHERE score > 0)', K, 'score DESC, doc_id')})", "benchmark", "documents")(
    lambda b, d: postings.lexical(b, postings.index(d), K).select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank")
)
columns("jn03_fused_lists", f"{LISTS} FROM u", lambda b, d: retrieval.fuse(retrieval.dense(retrieval.embedded(d), retrieval.embedded(b, "item_id"), "doc_id", "item_id", LIMIT), retrieval.lexical(b, d, LIMIT), "item_id", "doc_id"), ["dense_rank", "lexical_rank", "dense_score", "lexical_score"])
for name, wanted in {"vc07_rarity": ["rarity"], "vc08_focus": ["focus"], "vc09_intent": ["intent", "penalty"], "so02_candidate_union": ["dense_score", "lexical_score"], "ag03_max_normalised": ["hybrid"]}.items():
    columns(name, f"{CANDIDATES} FROM cand", retrieval.candidates, wanted)
columns("vc10_fused", f"{CANDIDATES}, fu AS ({ranked('cand', LIMIT, FUSED_ORDER)}) FROM fu", retrieval.fused, ["hybrid", "rank"])
columns("vc13_reranked", f"{SEARCH} FROM hits", found, ["rerank", "hybrid", "score"])
columns("vc14_search", f"{SEARCH} FROM hits", found, ["dense_score", "lexical_score", "score", "rank"])


@query("vc04_rrf", f"{LISTS} SELECT item_id, doc_id, round({scores.reciprocal('dense_rank', scores.DENSE_WEIGHT)} + {scores.reciprocal('lexical_rank', scores.LEXICAL_WEIGHT)}, 6) AS score FROM u", "benchmark", "documents")
def _(b, d):
    lists = retrieval.fuse(retrieval.dense(retrieval.embedded(d), retrieval.embedded(b, "item_id"), "doc_id", "item_id", LIMIT), retrieval.lexical(b, d, LIMIT), "item_id", "doc_id")
    return lists.select("item_id", "doc_id", F.round("rrf", 6).alias("score"))


# Explicit passages of a question: the messages of the conversation of the same number.
EXPLICIT = f"""WITH {sql.questions()}, turns AS (SELECT conv_id * 1000 + turn AS doc_id, conv_id AS item_id, text FROM conversations), {sql.passages('turns')},
pairs AS (SELECT t.item_id, q.* EXCLUDE (item_id), d.* FROM turns t JOIN q USING (item_id) JOIN d USING (doc_id))"""


@query("vc11_rerank", f"{EXPLICIT}, r AS (SELECT item_id, doc_id, round({scores.RERANK}, 9) AS rerank FROM ({sql.counts('pairs')})) SELECT item_id, doc_id, round(rerank, 6) AS rerank, rank FROM ({ranked('r', 1 << 30, 'rerank DESC, doc_id')})", "benchmark", "conversations")
def _(b, c):
    turns = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.col("conv_id").alias("item_id"), "text")
    pairs = turns.select("item_id", "doc_id").join(b.select("item_id"), "item_id", "left_semi")
    return retrieval.rerank(retrieval.pair_features(pairs, b, turns.select("doc_id", "text"))).select("item_id", "doc_id", F.round("rerank", 6).alias("rerank"), "rank")


@query("wn06_rerank_order", f"{EXPLICIT}, r AS (SELECT item_id, doc_id, round({scores.RERANK}, 9) AS rerank FROM ({sql.counts('pairs')})) SELECT item_id, list(doc_id ORDER BY rerank DESC, doc_id) AS passages FROM r GROUP BY 1", "benchmark", "conversations")
def _(b, c):
    turns = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.col("conv_id").alias("item_id"), "text")
    pairs = turns.select("item_id", "doc_id").join(b.select("item_id"), "item_id", "left_semi")
    order = F.array_sort(F.collect_list(F.struct((-F.col("rerank")).alias("r"), "doc_id")))
    return retrieval.rerank(retrieval.pair_features(pairs, b, turns.select("doc_id", "text"))).groupBy("item_id").agg(F.transform(order, lambda x: x["doc_id"]).alias("passages"))


@query("ag02_candidate_df", f"{CANDIDATES} SELECT item_id, term, df FROM df", "benchmark", "documents")
def _(b, d):
    pairs = retrieval.candidates(b, d)
    return pairs.select("item_id", F.explode(F.array_intersect("seq", "q_terms")).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("df"))


@query("vc16_overlap_share", f"{SEARCH} SELECT item_id, doc_id, round(CASE WHEN qn > 0 THEN n / qn::DOUBLE ELSE 0.0 END, 6) AS overlap FROM hits", "benchmark", "documents")
def _(b, d):
    return found(b, d).select("item_id", "doc_id", F.round(F.when(F.col("qn") > 0, F.col("n") / F.col("qn")).otherwise(0.0), 6).alias("overlap"))


def text_bonus(name: str, oracle: str, value) -> None:
    """A measure of each question on the text of each of its hits."""
    query(name, f"{SEARCH} SELECT item_id, doc_id, {oracle} AS value FROM hits", "benchmark", "documents")(lambda b, d: found(b, d).select("item_id", "doc_id", value().alias("value")))


text_bonus("tx05_phrase", "phrase = 1", lambda: F.col("phrase") == 1)
text_bonus("tx09_longest_run", "run", lambda: F.col("run"))


@query("vc01_hash_embedding", f"WITH w AS ({sql.embedding('documents', 'doc_id')}) SELECT doc_id, dim, round(weight / sqrt(sum(weight * weight) OVER (PARTITION BY doc_id)), 6) AS value FROM w QUALIFY weight <> 0", "documents")
def _(d):
    each = retrieval.embedded(d).select("doc_id", F.posexplode("v").alias("dim", "value"))
    return each.filter("value <> 0").select("doc_id", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value"))


VECTORS = "SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) / nullif(sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])), 0), 9) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0"


@query("wn01_dense_topk", f"SELECT query_id, vec_id, round(score, 6) AS score, rank FROM ({ranked(f'({VECTORS})', 5, 'score DESC, vec_id', key='query_id')})", "embeddings")
def _(v):
    vectors = v.select("vec_id", F.col("embedding").alias("v"))
    queries = vectors.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    return retrieval.dense(vectors, queries, "vec_id", "query_id", 5).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


def wn01_cells_topk(spark, sf_dir: str) -> DataFrame:
    """As wn01_dense_topk, in the cells nearest to each query; the exact search is the measure of what it finds."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").alias("v"))
    found = cells.search(cells.build(vectors, "vec_id"), vectors.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), "query_id")
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


QUERIES["wn01_cells_topk"] = lambda spark, sf_dir: tidied(spark, "wn01_cells_topk", lambda: wn01_cells_topk(spark, sf_dir))


@query("flt01_usable_vectors", "SELECT doc_id FROM documents JOIN embeddings ON vec_id = doc_id LEFT JOIN labels USING (doc_id) WHERE embedding IS NOT NULL AND len(embedding) = 64 AND coalesce(toxic, 0) = 0", "documents", "embeddings", "labels")
def _(d, v, lab):
    """Vectors of the right dimension whose document is ready (here: not rated toxic)."""
    usable = v.filter(F.col("embedding").isNotNull() & (F.size("embedding") == 64)).select(F.col("vec_id").alias("doc_id"))
    return usable.join(d.select("doc_id"), "doc_id").join(lab.filter("toxic = 1").select("doc_id"), "doc_id", "left_anti")


@query("vc03_cosine", "SELECT a.vec_id, b.vec_id AS other, round(coalesce(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / nullif(sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 0), 0.0), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.label = a.label AND b.vec_id > a.vec_id AND b.vec_id <= a.vec_id + 20", "embeddings")
def _(v):
    """Of vectors of one label that are at most 20 numbers apart, so each has a bounded number of partners."""
    x = v.select("vec_id", F.col("embedding").alias("x"), "label", F.explode(F.sequence(F.lit(1), F.lit(20))).alias("k")).withColumn("other", F.col("vec_id") + F.col("k"))
    y = v.select(F.col("vec_id").alias("other"), F.col("embedding").alias("y"), "label")
    return x.join(y, ["other", "label"]).select("vec_id", "other", F.round(retrieval.cosine("x", "y"), 6).alias("cosine"))


@query("jn07_term_semi", f"SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM ({sql.content('documents', 'doc_id')}) WHERE term IN (SELECT term FROM ({sql.content('benchmark', 'item_id')})))", "documents", "benchmark")
def _(d, b):
    """Documents that share any term with any question: found in the row, against the distinct question terms."""
    known = b.select(F.explode(tx.sequence(F.col("text"))).alias("term")).distinct()
    each = spread(d.select("doc_id", "text")).select("doc_id", F.explode(F.array_distinct(tx.sequence(F.col("text")))).alias("term"))
    return each.join(retrieval.small_side(known, 64), "term", "left_semi").select("doc_id").distinct()


@query("vc15_jaccard", f"{SEARCH}, x AS (SELECT item_id, doc_id, rank, terms FROM hits) SELECT a.item_id, a.doc_id, b.doc_id AS other, round(CASE WHEN len(list_distinct(list_concat(a.terms, b.terms))) = 0 THEN 1.0 ELSE len(list_intersect(a.terms, b.terms)) / len(list_distinct(list_concat(a.terms, b.terms)))::DOUBLE END, 6) AS jaccard FROM x a JOIN x b ON a.item_id = b.item_id AND a.rank < b.rank", "benchmark", "documents")
def _(b, d):
    """Of the hits of a question with one another: K of them, so a bounded number of pairs."""
    hits = found(b, d).select("item_id", "rank", "doc_id", F.array_distinct("seq").alias("t"))
    lists = hits.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id", "t"))).alias("l"))
    two = lists.select("item_id", F.posexplode("l").alias("i", "a"), "l").select("item_id", "a", F.explode(F.slice("l", F.col("i") + 2, F.size("l"))).alias("b"))
    union = F.size(F.array_union("a.t", "b.t"))
    return two.select("item_id", "a.doc_id", F.col("b.doc_id").alias("other"), F.round(F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect("a.t", "b.t")) / union), 6).alias("jaccard"))


@query("wn05_hit_order", f"{SEARCH} SELECT item_id, list(doc_id ORDER BY rank) AS docs FROM hits GROUP BY 1", "benchmark", "documents")
def _(b, d):
    order = F.array_sort(F.collect_list(F.struct("rank", "doc_id")))
    return found(b, d).groupBy("item_id").agg(F.transform(order, lambda x: x["doc_id"]).alias("docs"))


@query("wn04_fused_order", f"{CANDIDATES}, fu AS ({ranked('cand', LIMIT, FUSED_ORDER)}) SELECT item_id, list(doc_id ORDER BY rank) AS docs FROM fu GROUP BY 1", "benchmark", "documents")
def _(b, d):
    order = F.array_sort(F.collect_list(F.struct("rank", "doc_id")))
    return retrieval.fused(b, d, LIMIT).groupBy("item_id").agg(F.transform(order, lambda x: x["doc_id"]).alias("docs"))

