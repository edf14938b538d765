"""Lexical search by an inverted index: the terms of passages joined with those of questions, with bounds, and no Python but for the index.

Texts are read once, into an index: a row for each passage with its terms, pairs and measures, in buckets of its number,
so that what is counted for a passage needs no exchange. The work follows the matches, not questions by passages, and
questions are a table like any other, however many there are. The rows are those of retrieval.lexical(), which ships the
questions to the passages instead and does less for each match: that is the better way for some thousand questions, this
one for more, for passages that are searched again, and where few passages share terms with a question."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.scratch import saved, saved_by, spread
from . import scores
from .retrieval import BROADCAST_BYTES, FLAGS, QUESTION, flagged, listed, longest_run, pair_features, question_features, scored, small_side, top, whole_question


@dataclass(frozen=True)
class Index:
    """The features of passages, a row for each, in buckets of its number."""

    features: DataFrame

    def lists(self) -> DataFrame:
        """The features with the lists of terms, as passage_features() has them."""
        parts = lambda c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, " "))
        return self.features.withColumns({"seq": parts("said"), "full": parts("said_full")}).drop("row", "keys", "said", "said_full")


def index(passages: DataFrame) -> Index:
    """The index of passages (doc_id, text, maybe heading)."""
    rows = spread(passages).withColumn("row", F.monotonically_increasing_id())
    text, headed = F.coalesce("text", F.lit("")), "heading" in passages.columns
    head = F.coalesce("heading", F.lit("")) if headed else F.lit("")
    rows = rows.select("doc_id", "row", (F.trim(F.concat_ws(" ", head, text)) if headed else text).alias("_text"), *([text.alias("_own"), head.alias("_head")] if headed else []))
    # Texts are cut into terms whole batches at a time: as expressions that took most of the time of a search.
    rows = rows.select("*", listed(F.lower("_text")).alias("_l"), *([listed(F.lower("_own")).alias("_o"), listed(F.lower("_head")).alias("_h")] if headed else []))
    none = F.array().cast("array<string>")
    heads = F.when(F.col("_h.said") == "", none).otherwise(F.array_distinct(F.split("_h.said", " "))) if headed else none
    lists = flagged(rows.select("doc_id", "row", "_text", "_l.*", (F.col("_o.meta") if headed else F.col("_l.meta")).alias("text_meta"), heads.alias("head_terms")))
    marked = F.transform("head_terms", lambda t: F.concat(F.lit(MARK["nh"]), t))
    kept = lists.select("doc_id", "row", "dn", "meta", "text_meta", *FLAGS, "head_terms", "said", "said_full", F.concat("keys", marked).alias("keys") if headed else F.col("keys"))
    return Index(saved_by(kept, "passages", "row", codec="lz4"))


#: What a question and a passage may share, by kind: terms, anchors, constraints and pairs in its content, subjects among all its terms, terms in its heading.
SETS = {"n": "q_terms", "na": "q_anchors", "nc": "q_constraints", "np": "q_pairs", "ns": "q_subjects", "nh": "q_terms"}
MARK = {"ns": "\x01", "nh": "\x02"}


def question_keys(q: DataFrame) -> DataFrame:
    """key, item_id and, by kind, whether the key counts: a row for each different key of a question. Subjects matter to questions for a nickname only."""
    marked = lambda kind, column: F.transform(column, lambda t: F.concat(F.lit(MARK.get(kind, "")), t))
    lists = {kind: marked(kind, F.when((F.col("is_nick") == 1) if kind == "ns" else F.lit(True), F.col(c)).otherwise(F.array().cast("array<string>"))) for kind, c in SETS.items()}
    of_kind = lambda kind, xs: F.transform(xs, lambda t: F.struct(t.alias("key"), F.lit(kind).alias("kind")))
    each = q.select("item_id", F.explode(F.concat(*(of_kind(kind, xs) for kind, xs in lists.items()))).alias("e"))
    return each.groupBy("item_id", "e.key").agg(*(F.max((F.col("e.kind") == k).cast("int")).alias(k) for k in SETS))


def every_key() -> Column:
    return F.concat("keys", F.transform(F.array_distinct(F.split("said_full", " ")), lambda t: F.concat(F.lit(MARK["ns"]), t)))


def lexical(questions: DataFrame, passages: Index, k: int = 5) -> DataFrame:
    """item_id, doc_id, score and rank of the best k passages of each question, of those with a score.

    Counts of shared keys come from a join by key. With them a score is known but for the longest run and for whether the
    whole question is there: without these it is a lower bound, and with the most that they can add an upper one. What can't reach
    the k-th best lower bound of its question is left; run and phrase are looked for in the rest. Exact, as bounds only leave out what can't be among the best."""
    found, q = passages.features, saved(question_features(questions), "questions")
    size, named = q.agg(F.sum(F.octet_length("q_text") + 64), F.max("is_nick")).first()
    # What is made of a question's text is a few dozen times as long at most.
    few = F.broadcast if (size or 0) * 48 <= BROADCAST_BYTES else lambda df: df
    keys = few(question_keys(q))
    # Whether a term of the question follows itself: such a pair isn't counted, so a run may be long without one.
    twice = F.exists(tx.pairs(F.col("q_seq")), lambda p: F.substring_index(p, " ", 1) == F.substring_index(p, " ", -1)).cast("int")
    sizes = few(q.select("item_id", *QUESTION, F.size("q_seq").alias("length"), F.size("q_subjects").alias("named"), twice.alias("twice")))
    bits = sum((F.shiftleft(c, i) for i, c in enumerate(FLAGS)), F.lit(0)).alias("flags")

    def counted() -> DataFrame:
        each = found.select("row", "dn", "meta", bits, F.explode(every_key() if named else F.col("keys")).alias("key")).join(keys, "key")
        shared = each.groupBy("row", "item_id").agg(*(F.sum(c).alias(c) for c in SETS), *(F.max(c).alias(c) for c in ("dn", "meta", "flags")))
        own = {c: F.shiftright("flags", i).bitwiseAND(F.lit(1)) for i, c in enumerate(FLAGS)}
        both = shared.filter("n > 0").withColumns(own).join(sizes, "item_id").withColumns({"alias": F.expr("CASE WHEN alias_text = 1 AND (named = 0 OR ns > 0) THEN 1 ELSE 0 END"), "head": (F.col("nh") > 0).cast("int")})
        # All but the first and the last term of a run, or of the question, stand as they are in what has it.
        low = both.withColumns({"run": F.lit(0), "phrase": F.lit(0)}).withColumn("low", F.expr(scores.LEXICAL))
        most = {"run": F.expr("CASE WHEN length < 2 THEN 0 WHEN np = 0 AND twice = 0 THEN 3 ELSE 5 END"), "phrase": F.expr("CASE WHEN n >= qn - 5 THEN 1 ELSE 0 END")}
        return low.withColumns(most).withColumn("high", F.expr(scores.LEXICAL))

    # What the best by the lower bound really score is a better bound still.
    first = saved(top(counted().select("item_id", "row", "low"), "item_id", k, F.desc("low")).join(found.select("row", "doc_id"), "row").select("item_id", "doc_id"), "first")
    least = scored(pair_features(first, q, passages.lists()), score=scores.LEXICAL).groupBy("item_id").agg(F.min("score").alias("least"), F.count("*").alias("n_best"))
    least = few(saved(least.filter(F.col("n_best") >= k).select("item_id", "least"), "least"))
    near = counted().join(least, "item_id", "left").filter(F.col("high") >= F.coalesce("least", F.lit(0.0)) - 1e-6)
    near = small_side(saved(near.drop("low", "high", "least", "run", "phrase"), "near_best"), 192)
    words = found.select("row", "doc_id", "said", "said_full").join(near, "row").join(few(q.select("item_id", "q_grams", "q_full")), "item_id")
    last = F.struct(longest_run(F.col("said")).alias("run"), whole_question(F.col("said_full")).alias("phrase"))
    full = words.select("item_id", "doc_id", *near.drop("row", "item_id").columns, F.inline(F.array(last)))
    return top(full.select("item_id", "doc_id", F.round(F.expr(scores.LEXICAL), 9).alias("score")).filter("score > 0"), "item_id", k, F.desc("score"), "doc_id")
