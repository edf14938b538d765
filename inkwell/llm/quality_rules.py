"""Quality rules: how far a document's statistics are from its language's.

Two histograms of each document are compared with a reference of its language
by the Jensen-Shannon distance (base 2, 0 to 1): of character classes
(lower-case, upper-case and other letters, white space, digits, punctuation,
symbols) and of the language's most common words (each with its share of all
words, the rest as one). The references are counted over the whole corpus by
``lang``: of each class the median share, which junk hardly moves, and the
``common`` most frequent words that have a letter, with their shares.

A sample of n draws from a distribution of k bins is itself about
(k - 1) / (8 n ln 2) from it in divergence, so that much is taken off before
the root. Minimum lengths: a reference needs ``least`` words; under
``min_words`` words only the classes are compared, and under 50 the base rule
fails a document anyway. A document without ``lang`` is held against the
nearest reference; one whose language has none is judged by the base rules.

All of it is DataFrame expressions: no Python, and no shuffle but of the
references' partial counts.

Edge cases: null, empty and wordless texts have zeros everywhere, no distance,
and fail the base rule of 50 words; a distance just at its bound is kept; of
equally common words the one that the sketch names first counts; rows that
repeat an id are judged each for itself; very long texts are read whole; the
caller's columns come back as they were, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, once, words_of

KINDS = ("lower", "upper", "letter", "space", "digit", "point", "symbol")
#: White space, and what may stand before or after a word.
BREAKS = r"[\x20\x09-\x0D.,;:!?'\"()-]+"
COMMON, LEAST, MIN_WORDS = 50, 10_000, 75
#: Most distance of classes and of words.
MAX_CLASS, MAX_WORD = 0.18, 0.22
#: Items that the sketch of frequent words tracks: counts are right within about a 4000th of all words.
TRACKED = 20_000
REFERENCES = "array<struct<lang:string,classes:array<double>,words:array<string>,shares:array<double>>>"


def stripped(df: DataFrame) -> DataFrame:
    """df (with _text) and _rest, the text without lower-case letters, and _other, that without any letters. Both are
    short, so what is counted in them costs little."""
    rest = df.withColumn("_rest", F.regexp_replace("_text", r"\p{Ll}+", ""))
    return rest.withColumn("_other", F.regexp_replace("_rest", r"\p{L}+", "")).withColumn("_size", F.length("_text").cast("long"))


def class_counts() -> dict[str, Column]:
    """Characters of each class of what stripped() gives."""
    n = lambda c: F.length(c).cast("long")
    less = lambda c, what: n(c) - n(F.regexp_replace(c, what, ""))
    upper = less("_rest", r"\p{Lu}+")
    found = {"lower": F.col("_size") - n("_rest"), "upper": upper, "letter": n("_rest") - n("_other") - upper}
    return found | {"space": less("_other", r"[\x20\x09-\x0D]+"), "digit": less("_other", r"\p{N}+"), "point": less("_other", r"[.,;:!?'\"()-]+")}


def bare_words(text: Column) -> Column:
    """Lower-case words without the signs around them."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), BREAKS), lambda w: w != "")


def references(docs: DataFrame, common: int = COMMON, least: int = LEAST) -> list[dict]:
    """lang, classes, words and shares of each language that has ``least`` words: a row a language, so it is small."""
    docs = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = class_counts()
    shares = stripped(docs.select("lang", F.col("text").alias("_text")).filter("_text <> ''")).select("lang", *((c / F.col("_size")).alias(k) for k, c in counts.items()))
    middle = shares.groupBy("lang").agg(*(F.percentile_approx(k, 0.5, 1000).alias(k) for k in counts))
    each = docs.select("lang", F.explode(bare_words(F.col("text"))).alias("w"))
    # Twice as many as wanted, since some may be no words.
    words = each.groupBy("lang").agg(F.expr(f"approx_top_k(w, {2 * common}, {TRACKED})").alias("top"), F.count("*").alias("n")).filter(F.col("n") >= least)
    top = F.slice(F.filter("top", lambda t: t["item"].rlike(r"\p{L}")), 1, common)
    words = words.select("lang", F.transform(top, lambda t: t["item"]).alias("words"), F.transform(top, lambda t: t["count"] / F.col("n")).alias("shares"))
    classes = {r.lang: [float(r[k]) for k in counts] for r in middle.collect()}
    out = []
    for r in sorted(words.collect(), key=lambda r: r.lang):
        own = classes[r.lang]
        out.append({"lang": r.lang, "classes": [*own, max(0.0, 1 - sum(own))], "words": r.words, "shares": r.shares})
    return out


def _literal(known: list[dict]) -> Column:
    if not known:
        return F.array().cast(REFERENCES)
    array = lambda xs: F.array(*map(F.lit, xs))
    return F.array(*(F.struct(F.lit(r["lang"]).alias("lang"), array(r["classes"]).alias("classes"), array(r["words"]).alias("words"), array(r["shares"]).alias("shares")) for r in known)).cast(REFERENCES)


def _term(p: Column, q: Column) -> Column:
    """What a bin adds to twice the divergence: p log2(2p / (p + q)) + q log2(2q / (p + q))."""
    side = lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)
    return side(p, q) + side(q, p)


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def _distance(twice: Column, bins: Column, n: Column) -> Column:
    """From twice the divergence, less what chance makes of n draws."""
    return F.sqrt(F.greatest(F.lit(0.0), twice / 2 - (bins - 1) / (8 * math.log(2) * n)))


def class_distance(counts: Column, n: Column, ref: Column) -> Column:
    """counts: an array in the order of KINDS."""
    return _distance(_sum(F.zip_with(counts, ref["classes"], lambda c, q: _term(c / n, q))), F.lit(len(KINDS)), n)


def word_distance(runs: Column, n: Column, ref: Column) -> Column:
    """runs: word and n of the words that any reference has."""
    share = lambda w: F.get(ref["shares"], F.array_position(ref["words"], w).cast("int") - 1)
    pairs = F.filter(F.transform(runs, lambda r: F.struct((r["n"] / n).alias("p"), share(r["w"]).alias("q"))), lambda x: x["q"].isNotNull())

    def twice(ps: Column) -> Column:
        total, held = _sum(ref["shares"]), _sum(F.transform(ps, lambda x: x["q"]))
        other = F.greatest(1 - _sum(F.transform(ps, lambda x: x["p"])), F.lit(0.0))
        # A common word that the document lacks adds its whole share.
        return _sum(F.transform(ps, lambda x: _term(x["p"], x["q"]))) + total - held + _term(other, 1 - total)

    return _distance(let(pairs, twice), F.size(ref["words"]) + 1, n)


def _runs(words: Column) -> Column:
    """word and n of each run of equal words."""

    def bins(s: Column) -> Column:
        first = F.filter(F.transform(s, lambda w, i: F.when((i == 0) | (F.get(s, i - 1) != w), i)), lambda i: i.isNotNull())
        return let(first, lambda f: F.transform(f, lambda i, k: F.struct(F.get(s, i).alias("w"), (F.coalesce(F.get(f, k + 1), F.size(s)) - i).alias("n"))))

    return let(F.sort_array(words), bins)


def repeat_words(words: Column) -> Column:
    """Words within 3-word windows that are found twice or more."""
    hashes = F.transform(
        F.slice(words, 3, F.greatest(F.size(words), F.lit(1))),
        lambda w, i: F.xxhash64(F.get(words, i), F.get(words, i + 1), w),
    )

    def covered(h: Column) -> Column:
        order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def spots(s: Column) -> Column:
            again = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
            return F.sort_array(F.transform(again, lambda x: x["i"]))

        gaps = let(let(order, spots), lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(gaps)

    return let(hashes, covered).cast("long")


STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance"]


def rules(docs: DataFrame, known: list[dict], min_words: int = MIN_WORDS, max_class: float = MAX_CLASS, max_word: float = MAX_WORD) -> DataFrame:
    """_row (all columns of docs) and STATS of each document. known: see references()."""
    lang = docs["lang"] if "lang" in docs.columns else F.lit(None).cast("string")
    base = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"), lang.alias("_lang"), F.coalesce(docs["text"], F.lit("")).alias("_text"), words_of(docs["text"]).alias("_words"), bare_words(docs["text"]).alias("_bare"))
    text, size = F.col("_text"), lambda c: F.size(c).cast("long")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    names = sorted({w for r in known for w in r["words"]})
    step = stripped(base).withColumn("_counts", F.array(*class_counts().values())).select(
        "_row",
        size("_words").alias("n_words"),
        (F.col("_size") - F.col("_counts")[KINDS.index("space")]).alias("word_chars"),
        F.length(F.regexp_replace("_other", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("_words")).alias("n_repeat_words"),
        F.filter(_literal(known), lambda r: F.col("_lang").isNull() | (r["lang"] == F.col("_lang"))).alias("_refs"),
        size("_bare").alias("_n"),
        _runs(F.filter("_bare", lambda w: w.isin(names))).alias("_runs") if names else F.array().cast("array<struct<w:string,n:int>>").alias("_runs"),
        "_size",
        "_counts",
    )
    counts = F.concat("_counts", F.array(F.col("_size") - F.aggregate("_counts", F.lit(0).cast("long"), lambda a, x: a + x)))
    least = lambda f: F.array_min(F.transform("_refs", f))
    step = step.select(
        "_row",
        *STATS[:5],
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        F.when(F.col("_size") > 0, let(counts, lambda c: least(lambda r: class_distance(c, F.col("_size"), r)))).alias("class_distance"),
        F.when(F.col("_n") >= min_words, least(lambda r: word_distance(F.col("_runs"), F.col("_n"), r))).alias("word_distance"),
    )
    near = (F.coalesce("class_distance", F.lit(0.0)) <= max_class) & (F.coalesce("word_distance", F.lit(0.0)) <= max_word)
    return once(step, {c: F.col(c) if c != "kept" else ~F.col("base_failed") & near for c in STATS}, "_row")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and STATS."""
    docs = docs.select("doc_id", "text", "lang")
    return rules(docs, references(docs)).select("_row.doc_id", *STATS)


def passed(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, in their own columns."""
    known = references(docs.select("text", "lang")) if "lang" in docs.columns else []
    return rules(docs, known).filter("kept").select("_row.*")
