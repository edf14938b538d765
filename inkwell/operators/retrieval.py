"""Search over whole tables of questions: lexical, dense, fused, reranked.

Lexical and dense search read the passages once and exchange only each task's
best rows: the questions are shipped in blocks of a bounded size, matches are
counted for a batch of passages at a time, and the formulas are expressions on
the counts (scores.py). What follows works on a few candidates a question.
"""

from __future__ import annotations

import copy
import hashlib
import json
import re
from collections.abc import Callable
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Settings
from ..functions import text as tx
from ..sources.scratch import saved, spread
from . import scores

#: Questions that are shipped to the tasks at once, and their bytes at most.
BLOCK, BLOCK_BYTES = 4096, 32 << 20
#: Cells of questions by passages that a task counts at once.
CELLS = 1 << 17
#: Bytes of a side that may be broadcast.
BROADCAST_BYTES = 16 << 20


def top(df: DataFrame, key: str, k: int, *order) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("rank", rank).filter(F.col("rank") <= k)


def question_features(questions: DataFrame) -> DataFrame:
    """item_id, the terms of each question in the forms that scoring needs, and how many there are."""
    t = questions.select("item_id", F.coalesce("text", F.lit("")).alias("q_text"), tx.terms(F.coalesce("text", F.lit(""))).alias("_t"))
    t = t.withColumn("_c", F.filter("_t", tx.is_content))
    t = t.withColumn("q_seq", F.transform("_c", lambda x: x["term"]))
    full = F.transform("_t", lambda x: x["term"])
    lists = t.select(
        "item_id",
        "q_text",
        "q_seq",
        F.array_distinct("q_seq").alias("q_terms"),
        tx.anchors(F.col("_c")).alias("q_anchors"),
        tx.constraints(F.col("_c")).alias("q_constraints"),
        tx.unequal(tx.pairs(F.col("q_seq"))).alias("q_pairs"),
        F.array(*(tx.grams(F.col("q_seq"), n) for n in (2, 3, 4, 5))).alias("q_grams"),
        F.array_join(full, " ").alias("q_full"),
        tx.subjects(F.col("q_text")).alias("_s"),
        F.lower("q_text").startswith("when ").cast("int").alias("is_when"),
        F.contains(F.lower("q_text"), F.lit("nickname")).cast("int").alias("is_nick"),
    )
    # Whose nickname is asked for: the named subjects, or else the anchors.
    lists = lists.withColumn("q_subjects", F.when(F.size("_s") > 0, F.col("_s")).otherwise(F.col("q_anchors")))
    sizes = {"qn": "q_terms", "qa": "q_anchors", "qc": "q_constraints", "qp": "q_pairs", "qs": "_s"}
    return lists.select("*", *(F.size(c).alias(n) for n, c in sizes.items())).drop("_s")


def passage_features(passages: DataFrame, *extra: str) -> DataFrame:
    """doc_id, extra columns, seq (content terms in order), full (all terms in order), dn, meta and the flags of each passage.

    A passage is its heading, if the table has one, and its text; head_terms are the heading's, text_meta is of the text alone."""
    text, headed = F.coalesce("text", F.lit("")), "heading" in passages.columns
    head = F.coalesce("heading", F.lit("")) if headed else F.lit("")
    whole = F.trim(F.concat_ws(" ", head, text)) if headed else text
    t = spread(passages.select("doc_id", *extra, "text", *(["heading"] if headed else []))).select("doc_id", *extra, whole.alias("_text"), tx.normal(whole).alias("_t"), *([tx.normal(text).alias("_own"), tx.normal(head).alias("_head")] if headed else []))
    none = F.array().cast("array<string>")
    own = [tx.noise(tx.full_terms(F.col("_own"))).alias("text_meta"), F.array_distinct(tx.content_terms(F.col("_head"))).alias("head_terms")] if headed else [none.alias("head_terms")]
    t = t.select("doc_id", *extra, "_text", tx.content_terms(F.col("_t")).alias("seq"), tx.full_terms(F.col("_t")).alias("full"), *own)
    return flagged(t).select(
        "doc_id",
        *extra,
        "seq",
        "full",
        "head_terms",
        F.size(F.array_distinct("seq")).alias("dn"),
        tx.noise(F.col("full")).alias("meta"),
        *([F.col("text_meta")] if headed else [tx.noise(F.col("full")).alias("text_meta")]),
        *FLAGS,
    )


def flagged(t: DataFrame) -> DataFrame:
    """t with the FLAGS of its _text. A year or a month is a date, and a date is temporal."""
    text = F.col("_text")
    t = t.withColumns({"_year": text.rlike(tx.QUICK_YEAR), "_month": text.rlike(tx.QUICK_MONTH)})
    t = t.withColumn("_date", F.col("_year") | F.col("_month") | text.rlike(tx.QUICK_NUMERIC))
    found = {"date": F.col("_date"), "temporal": F.col("_date") | text.rlike(tx.QUICK_TEMPORAL) | text.rlike(tx.QUICK_TIME), "year": F.col("_year"), "month": F.col("_month"), "alias_text": tx.has_alias(text)}
    return t.withColumns({name: c.cast("int") for name, c in found.items()})


def passage_texts(passages: DataFrame, flags: bool) -> DataFrame:
    """doc_id, said and head_said (the lower-case text with its heading, and the heading) and FLAGS, zeros unless they are asked for. Terms are made of these in tasks."""
    text, headed = F.coalesce("text", F.lit("")), "heading" in passages.columns
    head = F.coalesce("heading", F.lit("")) if headed else F.lit("")
    whole = F.trim(F.concat_ws(" ", head, text)) if headed else text
    t = spread(passages.select("doc_id", "text", *(["heading"] if headed else []))).select("doc_id", whole.alias("_text"), F.lower(head).alias("head_said"))
    t = flagged(t) if flags else t.withColumns(dict.fromkeys(FLAGS, F.lit(0)))
    return t.select("doc_id", F.lower("_text").alias("said"), "head_said", *FLAGS)


FLAGS = ["date", "temporal", "year", "month", "alias_text"]
QUESTION = ["qn", "qa", "qc", "qp", "qs", "is_when", "is_nick"]
COUNTS = ["n", "na", "nc", "np", "ns", "nh", "run", "phrase"]
TOKEN = re.compile("[a-z0-9]+")
STOP, META = frozenset(tx.STOPWORDS), frozenset(tx.METADATA)


class Terms(dict):
    """The plain form of Questions.terms_in(), a token at a time; tests hold both together. Of each token its term, none if that is under two letters, and the same again, none for a stop word."""

    def __missing__(self, token: str) -> tuple[str | None, str | None]:
        if len(self) >= 1 << 17:
            self.clear()
        term = tx.term_of(token)
        out = (None, None) if len(term) < 2 else (term, None if token in STOP or term in STOP else term)
        self[token] = out
        return out

    def lists(self, lowered: str) -> tuple[list[str], list[str]]:
        """The content terms and all terms of a text, as passage_features() has them."""
        each = list(map(self.__getitem__, TOKEN.findall(lowered)))
        return [c for _, c in each if c], [t for t, _ in each if t]


#: Bytes of text that a task cuts into tokens at once, and which bytes of a lower-case text are in one.
PIECE = 2 << 20
IN_TOKEN = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz0123456789"))


def pieces(texts: pa.Array, rows: int):
    """Where pieces of texts begin and end, each of so many rows and of PIECE bytes at most, or of a single text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64)
    at = 0
    while at < len(texts):
        end = int(np.searchsorted(size, (size[at - 1] if at else 0) + PIECE, side="right"))
        end = min(max(end, at + 1), at + rows)
        yield at, end
        at = end


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.StringArray]:
    """The tokens of lower-case texts as TOKEN finds them, in order: of each the place of its text and its number among the different ones, and those.

    Found in the bytes of all texts at once: what isn't ASCII is in no token, so its bytes are between tokens as it is."""
    whole = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = whole.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[whole.offset : whole.offset + len(whole) + 1]
    raw = np.frombuffer(data or b"", dtype=np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    inside = IN_TOKEN[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = ends[:-1][ends[:-1] < ends[1:]]
    first[begins] = inside[begins]
    letters, at = raw[inside], np.flatnonzero(first)
    coded = strings(np.append(np.flatnonzero(first[inside]), len(letters)), letters).dictionary_encode()
    return np.repeat(np.arange(len(whole)), np.diff(np.searchsorted(at, ends))), coded.indices.to_numpy(), coded.dictionary


def strings(bounds: np.ndarray, letters: np.ndarray) -> pa.StringArray:
    return pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(letters))


def terms_of(tokens: pa.StringArray) -> pa.StringArray:
    """term_of() of many tokens at once, by their last letters."""
    bounds = np.frombuffer(tokens.buffers()[1], dtype=np.int32)[tokens.offset : tokens.offset + len(tokens) + 1].astype(np.int64)
    letters = np.frombuffer(tokens.buffers()[2] or b"", dtype=np.uint8)[bounds[0] : bounds[-1]].copy()
    bounds -= bounds[0]
    start, end, n = bounds[:-1], bounds[1:], np.diff(bounds)
    back = [None] + [np.where(n >= k, letters[np.maximum(end - k, 0)], 0) for k in range(1, 6)] if len(letters) else []
    if not back:
        return tokens
    ends = lambda suffix, over: (n > over) & np.logical_and.reduce([back[k] == ord(c) for k, c in enumerate(reversed(suffix), 1)])
    ies = ends("ies", 5)
    rules = [(ies, n - 2), (ends("ing", 4), n - 3 - (back[4] == back[5])), (ends("ed", 3), n - 2 - (back[3] == back[4])), (ends("es", 3), n - 2), (ends("s", 3), n - 1), (ends("ion", 5), n - 3)]
    size = np.select(*zip(*rules, strict=True), n)
    size -= (size > 5) & (letters[start + size - 1] == ord("e")) & ~ies
    letters[(start + size - 1)[ies]] = ord("y")
    kept = np.arange(len(letters)) < np.repeat(start + size, n)
    return strings(np.append(0, np.cumsum(size)), letters[kept])


def distinct(codes: np.ndarray) -> np.ndarray:
    codes = np.sort(codes)
    return codes[np.append(True, codes[1:] != codes[:-1])] if len(codes) else codes


def joined(words: pa.Array, of: np.ndarray, rows: int) -> pa.Array:
    """The words of each of rows, in order, with blanks between; of: the row of each word."""
    bounds = np.searchsorted(of, np.arange(rows + 1)).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(bounds, words), " ")


class Lists:
    """Of each of many keys, numbered from 0, a list of numbers, all in one array."""

    def __init__(self, of: list[list[int]]):
        self.sizes = np.array([len(own) for own in of], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.all = np.array([x for own in of for x in own], dtype=np.int64)

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places in keys of the numbers of all keys, and the numbers."""
        sizes = self.sizes[keys]
        place = np.repeat(np.arange(len(keys)), sizes)
        return place, self.all[np.repeat(self.starts[keys] - np.cumsum(sizes) + sizes, sizes) + np.arange(len(place))]


class Best:
    """Which cells of a task's passages by a block's questions may be among the best k of their question, by the scores seen so far."""

    def __init__(self, rows: list, k: int):
        self.k, self.top = k, np.zeros((len(rows), k))
        self.own = {c: np.array([r[c] for r in rows]) for c in QUESTION}
        self.anyone = np.array([not r["q_subjects"] for r in rows])

    def cells(self, counts: np.ndarray, there: dict[str, np.ndarray], place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Passages and questions of counts (passages by COUNTS by questions) that stay; place: the passages' order among equals."""
        c = {name: counts[:, i] for i, name in enumerate(COUNTS)} | {name: x[:, None] for name, x in there.items()} | self.own
        c |= {"head": c["nh"] > 0, "alias": (c["alias_text"] > 0) & (self.anyone | (c["ns"] > 0))}
        score = scores.lexical_near(c)
        self.top = np.partition(np.concatenate([self.top, score.T], axis=1), -self.k, axis=1)[:, -self.k :]
        d, q = np.nonzero((score > 0) & (score >= self.top.min(axis=1) - 1e-6))
        if len(d) > self.k * len(self.top):  # many copies: those that agree in all counts have one score, so the first k of them do
            same = np.stack([q, *counts[d, :, q].T, *(x[d].view(np.int64) if x.dtype == np.float64 else x[d] for x in there.values())])
            order = np.lexsort([place[d], *same])
            new = np.concatenate([[True], (np.diff(same[:, order]) != 0).any(axis=0)])
            at = np.arange(len(order))
            kept = np.sort(order[at - np.maximum.accumulate(np.where(new, at, 0)) < self.k])
            d, q = d[kept], q[kept]
        return d, q


class Questions:
    """A block of questions, by term, pair and run; terms are numbered, and what a term or pair counts for is in Lists of cells (COUNTS by questions)."""

    #: By kind, where it is counted: terms, anchors and constraints among a passage's content.
    CONTENT = {"q_terms": 0, "q_anchors": 1, "q_constraints": 2}

    def __init__(self, rows: list):
        self.n, self.terms = len(rows), {}
        content: dict[int, list[int]] = {}
        heads: dict[int, list[int]] = {}
        subjects: dict[int, list[int]] = {}
        inner: dict[int, list[int]] = {}
        pairs: dict[tuple[int, int], list[int]] = {}
        runs: dict[str, list[int]] = {}
        number = lambda t: self.terms.setdefault(t, len(self.terms))
        self.whole, self.loose = [(r["q_full"], r["q_full"].count(" ") + 1) for r in rows], []
        for k, r in enumerate(rows):
            for name, kind in self.CONTENT.items():
                for t in r[name]:
                    content.setdefault(number(t), []).append(kind * self.n + k)
            for t in r["q_terms"]:
                heads.setdefault(number(t), []).append(5 * self.n + k)
            for t in r["q_pairs"]:
                one, two = t.split(" ")
                pairs.setdefault((number(one), number(two)), []).append(3 * self.n + k)
            for t in r["q_subjects"] if r["is_nick"] else ():  # looked for among all terms of a passage
                subjects.setdefault(number(t), []).append(4 * self.n + k)
            for size, grams in enumerate(r["q_grams"], 2):
                for g in grams:
                    runs.setdefault(g, []).append(k * 8 + size)
            if r["q_full"]:
                # What stands within a question stands as a term in a text that has it whole; the ends may be parts of longer terms.
                between = r["q_full"].split(" ")[1:-1]
                if between:
                    inner.setdefault(number(max(between, key=len)), []).append(k)
                else:
                    self.loose.append(k)
        by_term = lambda found: Lists([found.get(i, []) for i in range(len(self.terms))])
        self.content, self.heads, self.subjects, self.inner = map(by_term, (content, heads, subjects, inner))
        codes = sorted((a * len(self.terms) + b, cells) for (a, b), cells in pairs.items())
        self.pairs, self.pair_codes = Lists([cells for _, cells in codes]), np.array([c for c, _ in codes], dtype=np.int64)
        self.runs, self.run_words = Lists(list(runs.values())), list(runs)
        self.found: ahocorasick.Automaton | None = None

    def __getstate__(self):
        return self.__dict__ | {"found": None}

    def search(self) -> ahocorasick.Automaton:
        """What finds the runs in a passage's content."""
        if self.found is None:
            self.found = ahocorasick.Automaton()
            for i, text in enumerate(self.run_words):
                self.found.add_word(text, i)
            self.found.make_automaton()
        return self.found

    def terms_in(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """The tokens of texts in order: the places of their texts, their terms' numbers (of these questions' terms as here, of others from there on; -1 if under two letters), whether they are content, and the terms' places in the last."""
        of, code, tokens = tokens_of(texts)
        coded = terms_of(tokens).dictionary_encode()
        term, words = coded.indices.to_numpy(), coded.dictionary
        own = pc.fill_null(pc.index_in(words, pa.array(self.terms, pa.string())), -1).to_numpy()
        number = np.where(own < 0, len(self.terms) + np.arange(len(words)), own)
        number[pc.less(pc.binary_length(words), 2).to_numpy(zero_copy_only=False)] = -1
        stop = among(tokens, STOP) | among(words, STOP)[term]
        return of, number[term][code], ~stop[code], term[code], words

    def count(self, texts: pa.Array, heads: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Passages by COUNTS by questions, and dn and meta of the passages, by their lower-case texts and headings."""
        rows, size = len(texts), len(COUNTS) * self.n
        of, full, content, word, words = self.terms_in(texts)
        every, own = full >= 0, (full >= 0) & content
        full_of, content_of, full, content = of[every], of[own], full[every], full[own]
        many = len(self.terms) + len(words) + 1
        n_full = np.bincount(full_of, minlength=rows)
        meta = noise_of(np.bincount(of[every & among(words, META)[word]], minlength=rows), n_full)

        there, term = np.divmod(distinct(content_of * many + content), many)
        dn = np.bincount(there, minlength=rows).astype(np.int32)
        cells = []

        def met(lists: Lists, passage: np.ndarray, key: np.ndarray) -> None:
            place, cell = lists.of(key)
            cells.append(passage[place] * size + cell)

        asked = term < len(self.terms)
        met(self.content, there[asked], term[asked])
        if len(self.pair_codes) and len(content):
            two = np.flatnonzero((content_of[:-1] == content_of[1:]) & (content[:-1] < len(self.terms)) & (content[1:] < len(self.terms)))
            code = content[two] * len(self.terms) + content[two + 1]
            at = np.minimum(np.searchsorted(self.pair_codes, code), len(self.pair_codes) - 1)
            same = self.pair_codes[at] == code
            met(self.pairs, *np.divmod(distinct(content_of[two][same] * len(self.pair_codes) + at[same]), len(self.pair_codes)))
        named = full < len(self.terms)
        full_there, full_term = np.divmod(distinct(full_of[named] * many + full[named]), many)
        met(self.subjects, full_there, full_term)
        if pc.any(pc.not_equal(heads, "")).as_py():
            head_of, head, good, _, _ = self.terms_in(heads)
            good &= (head >= 0) & (head < len(self.terms))
            met(self.heads, *np.divmod(distinct(head_of[good] * many + head[good]), many))
        counts = np.bincount(np.concatenate(cells), minlength=rows * size).astype(np.int32).reshape(rows, len(COUNTS), self.n)

        if len(self.run_words) and len(content):
            lines = joined(words.take(pa.array(word[own])), content_of, rows)
            ends = np.cumsum(pc.binary_length(lines).to_numpy() + 1)  # a line break is in no run
            found = np.array(list(self.search().iter("\n".join(lines.to_pylist()))), dtype=np.int64).reshape(-1, 2)
            passage, key = np.divmod(distinct(np.searchsorted(ends, found[:, 0], side="right") * len(self.run_words) + found[:, 1]), len(self.run_words))
            place, run = self.runs.of(key)
            for length in range(2, 6):
                some = run % 8 == length
                counts[passage[place[some]], 6, run[some] // 8] = length
        place, question = self.inner.of(full_term)
        passage = np.concatenate([full_there[place], np.repeat(np.arange(rows), len(self.loose))])
        question = np.concatenate([question, np.tile(np.array(self.loose, dtype=np.int64), rows)])
        long = n_full[passage] >= np.array([n for _, n in self.whole], dtype=np.int64)[question]
        if long.any():
            lines = joined(words.take(pa.array(word[every])), full_of, rows).to_pylist()
            for d, q in zip(passage[long].tolist(), question[long].tolist(), strict=True):
                if self.whole[q][0] in lines[d]:
                    counts[d, 7, q] = 1
        return counts, dn, meta


def among(words: pa.Array, some: frozenset) -> np.ndarray:
    return pc.is_in(words, pa.array(some, pa.string())).to_numpy(zero_copy_only=False)


def noise_of(about: np.ndarray, n_full: np.ndarray) -> np.ndarray:
    """tx.noise() by how many of a text's terms are about an edition, and how many it has."""
    return np.where(about > 0, np.minimum(1.0, about / np.maximum(n_full, 1) * 4 + np.where(about >= 2, 0.2, 0.0)), 0.0)


LISTED = "struct<said:string,said_full:string,keys:array<string>,dn:int,meta:double>"


def listed(lowered: Column) -> Column:
    """LISTED of lower-case texts: the content terms and all terms in order with blanks between, the different terms and pairs of neighbours in the content, how many terms that are, and noise. A batch at a time."""

    def run(texts: pa.Array) -> pa.Array:
        parts = [lists_of(texts.slice(at, end - at)) for at, end in pieces(texts, 1 << 14)]
        return pa.concat_arrays(parts) if parts else lists_of(texts)

    return F.arrow_udf(run, LISTED)(lowered)


def lists_of(texts: pa.Array) -> pa.StructArray:
    rows = len(texts)
    of, code, tokens = tokens_of(texts)
    coded = terms_of(tokens).dictionary_encode()
    term, words = coded.indices.to_numpy(), coded.dictionary
    word, many = term[code], max(1, len(words))
    every = ~pc.less(pc.binary_length(words), 2).to_numpy(zero_copy_only=False)[word]
    own = every & ~(among(tokens, STOP) | among(words, STOP)[term])[code]
    of_own, content = of[own], word[own].astype(np.int64)
    meta = noise_of(np.bincount(of[every & among(words, META)[word]], minlength=rows), np.bincount(of[every], minlength=rows))
    there, kept = np.divmod(distinct(of_own * many + content), many)
    two = np.flatnonzero(of_own[:-1] == of_own[1:])
    pair, number = np.unique(content[two] * many + content[two + 1], return_inverse=True)
    beside, which = np.divmod(distinct(of_own[two] * max(1, len(pair)) + number), max(1, len(pair)))
    text = pc.binary_join_element_wise(words.take(pa.array(pair // many)), words.take(pa.array(pair % many)), " ")
    place = np.concatenate([there, beside])
    order = np.argsort(place, kind="stable")
    keys = pa.concat_arrays([words, text]).take(pa.array(np.concatenate([kept, len(words) + which])[order]))
    keys = pa.ListArray.from_arrays(np.searchsorted(place[order], np.arange(rows + 1)).astype(np.int32), keys)
    said, full = (joined(words.take(pa.array(word[some])), of[some], rows) for some in (own, every))
    return pa.StructArray.from_arrays([said, full, keys, pa.array(np.bincount(there, minlength=rows).astype(np.int32)), pa.array(meta)], names=["said", "said_full", "keys", "dn", "meta"])


def blocks(df: DataFrame, order: str):
    """The rows of df in lists of a bounded size, in order of a key. A table of questions is what the user states; it is read by its blocks."""
    rows, size = [], 0
    for r in df.orderBy(order).toLocalIterator(prefetchPartitions=True):
        rows.append(r)
        size += 64 + sum(len(str(v)) for v in r)
        if len(rows) >= BLOCK or size >= BLOCK_BYTES:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def match_counts(questions: DataFrame, passages: DataFrame, k: int) -> DataFrame:
    """item_id, doc_id, COUNTS, dn, meta and FLAGS of each question and passage that may be among the best k of the question by LEXICAL.

    Counted where the passage is. Of each task those go on that reach the k-th best score there, so exchanged are a few rows a question and task, however many passages share a word."""
    spark = passages.sparkSession
    kinds = {"doc_id": passages.schema["doc_id"].dataType.simpleString(), "item_id": questions.schema["item_id"].dataType.simpleString()}
    out, texts = None, None
    for rows in blocks(questions, "item_id"):
        shared = spark.sparkContext.broadcast((Questions(rows), [r["item_id"] for r in rows], Best(rows, k)))

        def run(batches, shared=shared):
            index, ids, start = shared.value
            best = copy.copy(start)
            step = max(1, CELLS // max(1, index.n))
            for batch in batches:
                for at, end in pieces(batch.column(1), step):
                    part = batch.slice(at, end - at)
                    counts, dn, meta = index.count(part.column(1), part.column(2))
                    there = {"dn": dn, "meta": meta} | {c: part.column(c).to_numpy() for c in FLAGS}
                    place = np.empty(part.num_rows, dtype=np.int64)
                    place[pc.sort_indices(part.column(0), null_placement="at_start").to_numpy()] = np.arange(part.num_rows)
                    d, q = best.cells(counts, there, place)
                    if len(d):
                        cols = [part.column(0).take(pa.array(d)), pa.array([ids[x] for x in q.tolist()]).cast(kind)]
                        cols += [pa.array(counts[d, c, q]) for c in range(len(COUNTS))]
                        yield pa.RecordBatch.from_arrays(cols + [pa.array(x[d]) for x in there.values()], names=["doc_id", "item_id", *COUNTS, *there])

        kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kinds["item_id"]]
        schema = f"doc_id {kinds['doc_id']}, item_id {kinds['item_id']}, " + ", ".join(f"{c} int" for c in COUNTS) + ", dn int, meta double, " + ", ".join(f"{c} int" for c in FLAGS)
        if texts is None:  # flags matter to questions for a time or a nickname only
            texts = passage_texts(passages, bool(questions.agg(F.max(F.greatest("is_when", "is_nick"))).first()[0]))
        got = texts.mapInArrow(run, schema)
        out = got if out is None else out.unionByName(got)
    if out is None:
        cols = [f"CAST(NULL AS {kinds[c]}) AS {c}" for c in ("doc_id", "item_id")] + [f"0 AS {c}" for c in (*COUNTS, "dn", "meta", *FLAGS)]
        out = spark.sql("SELECT " + ", ".join(cols)).limit(0)
    return out


def scored(counts: DataFrame, **formulas: str) -> DataFrame:
    """counts with the flags that take both sides, and the formulas, rounded where both engines still agree."""
    both = counts.withColumns({"alias": F.expr("CASE WHEN alias_text = 1 AND (size(q_subjects) = 0 OR ns > 0) THEN 1 ELSE 0 END"), "head": (F.col("nh") > 0).cast("int")})
    return both.select("*", *(F.round(F.expr(f), 9).alias(name) for name, f in formulas.items()))


def small_side(df: DataFrame, bytes_a_row: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for broadcast if it was counted to be within the limit at so many bytes a row."""
    most = limit // bytes_a_row
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def lexical(questions: DataFrame, passages: DataFrame, k: int = 5) -> DataFrame:
    """item_id, doc_id, score and rank of the best k passages of each question, of those with a score."""
    q = saved(question_features(questions), "questions")
    counts = match_counts(q, passages, k).join(small_side(q.select("item_id", "q_subjects", *QUESTION), 512), "item_id")
    found = scored(counts, score=scores.LEXICAL).filter("score > 0").select("item_id", "doc_id", "score")
    return top(found, "item_id", k, F.desc("score"), "doc_id")


class Places(dict):
    """Where a token stands in a hashing embedding: its dimension, and as many more if it counts down."""

    def __init__(self, dimensions: int):
        self.dimensions = dimensions

    def __missing__(self, token: str) -> int:
        h = hashlib.sha256(token.encode()).digest()
        out = int.from_bytes(h[:4], "big") % self.dimensions + h[4] % 2 * self.dimensions
        if len(self) < 1 << 17:  # the frequent ones are met early
            self[token] = out
        return out


@lru_cache(maxsize=4)
def _places(dimensions: int) -> Places:
    return Places(dimensions)


def hashed(lowered: Column, dimensions: int = 128) -> Column:
    """The hashing embedding of a lower-cased text, as an array of unit length, or of zeros for a text without tokens. Worked out in the row, a batch at a time."""

    def run(texts: pa.Array) -> pa.Array:
        out, known = np.zeros((len(texts), dimensions)), _places(dimensions)
        for at, end in pieces(texts, 1024):
            of, code, tokens = tokens_of(texts.slice(at, end - at))
            place = np.array([known[t] for t in tokens.to_pylist()], dtype=np.int64)[code]
            each = np.bincount(of * (2 * dimensions) + place, minlength=(end - at) * 2 * dimensions).reshape(-1, 2, dimensions)
            out[at:end] = each[:, 0] - each[:, 1]
        return pa.ListArray.from_arrays(np.arange(0, out.size + 1, dimensions, dtype=np.int32), unit(out).ravel())

    return F.arrow_udf(run, "array<double>")(lowered)


def embedded(documents: DataFrame, key: str = "doc_id", dimensions: int = 128) -> DataFrame:
    """key and v, the hashing embedding."""
    return spread(documents.select(key, "text")).select(key, hashed(F.lower(F.coalesce("text", F.lit(""))), dimensions).alias("v"))


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 where a side is missing, empty, of another length, or zero."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm), F.lit(0.0))


def dense(vectors: DataFrame, queries: DataFrame, key: str, query: str, k: int = 5) -> DataFrame:
    """query, key, score and rank of the best k of vectors (key, v) for each of queries (query, v) by cosine.

    Vectors that are null or of another dimension are no candidates. Each task multiplies its vectors with a
    block of queries and keeps the best k of each query, so only those are exchanged."""
    spark = vectors.sparkSession
    kinds = (queries.schema[query].dataType.simpleString(), vectors.schema[key].dataType.simpleString())
    out = None
    for rows in blocks(queries.select(query, "v").filter("v is not null and size(v) > 0"), query):
        sizes = {len(r["v"]) for r in rows}
        for size in sizes:
            own = [r for r in rows if len(r["v"]) == size]
            shared = spark.sparkContext.broadcast(([r[query] for r in own], unit(np.array([r["v"] for r in own], dtype=np.float64))))

            def run(batches, shared=shared):
                ids, matrix = shared.value
                best: list[list[tuple[float, object]]] = [[] for _ in ids]
                for batch in batches:
                    batch = batch.filter(pc.equal(pc.list_value_length(batch.column(1)), matrix.shape[1]))  # here, as a filter would have the vectors made twice
                    names = batch.column(0).to_pylist()
                    there = unit(batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(names), -1))
                    for at in range(0, len(ids), max(1, CELLS // max(1, len(names)))):
                        step = max(1, CELLS // max(1, len(names)))
                        score = np.round(matrix[at : at + step] @ there.T, 9)
                        for q, row in enumerate(score, at):
                            # Of equal scores the least keys: all that reach the k-th best score are looked at.
                            least = np.partition(row, -k)[-k] if len(row) > k else -2.0
                            some = [(-row[i], names[i]) for i in np.flatnonzero(row >= least).tolist()]
                            best[q] = sorted([*best[q], *some])[:k]
                rows = [(i, name, -s) for i, own in zip(ids, best, strict=True) for s, name in own]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=[query + "_", key, "score"])

            got = vectors.select(key, "v").mapInArrow(run, f"{query}_ {kinds[0]}, {key} {kinds[1]}, score double").withColumnRenamed(query + "_", query)
            out = got if out is None else out.unionByName(got)
    if out is None:
        out = spark.sql(f"SELECT CAST(NULL AS {kinds[0]}) AS {query}, CAST(NULL AS {kinds[1]}) AS {key}, 0.0D AS score").limit(0)
    return top(out, query, k, F.desc("score"), key)


def unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def fuse(first: DataFrame, second: DataFrame, key: str, doc: str, settings: Settings = scores.DEFAULTS) -> DataFrame:
    """key, doc, both ranks and scores, and rrf: weighted reciprocal ranks. A list that lacks a document adds nothing."""
    a = first.select(key, doc, F.col("rank").alias("dense_rank"), F.col("score").alias("dense_score"))
    b = second.select(key, doc, F.col("rank").alias("lexical_rank"), F.col("score").alias("lexical_score"))
    both = a.join(b, [key, doc], "full_outer").fillna(0.0, ["dense_score", "lexical_score"])
    rrf = F.expr(f"{scores.reciprocal('dense_rank', settings.dense_weight, settings.rrf_k)} + {scores.reciprocal('lexical_rank', settings.lexical_weight, settings.rrf_k)}")
    return both.withColumn("rrf", F.round(rrf, 9))


def longest_run(said: Column) -> Column:
    """The longest run of question terms in a text's terms, 0 if there is none of two. A run can be there only if the two one shorter in it are."""

    def longer(n: int, shorter: Column) -> Column:
        """n, or more, if a run of n is there; shorter: which of those of n - 1 are."""
        there = F.transform(F.col("q_grams")[n - 2], lambda g, i: F.get(shorter, i) & F.get(shorter, i + 1) & F.contains(said, g))
        more = lambda own: F.when(F.exists(own, lambda x: x), F.lit(n) if n == 5 else F.greatest(F.lit(n), longer(n + 1, own))).otherwise(0)
        return tx.let(there, more)

    two = F.transform(F.col("q_grams")[0], lambda g: F.contains(said, g))
    return tx.let(two, lambda own: F.when(F.exists(own, lambda x: x), F.greatest(F.lit(2), longer(3, own))).otherwise(0))


def whole_question(said: Column) -> Column:
    return F.when((F.col("q_full") != "") & F.contains(said, F.col("q_full")), 1).otherwise(0)


def pair_features(pairs: DataFrame, questions: DataFrame, passages: DataFrame) -> DataFrame:
    """pairs (item_id, doc_id, ...) with all features of both sides and COUNTS, for a few pairs a question. questions and passages: as they are, or their features."""
    ids = small_side(pairs.select("doc_id").distinct(), 32)
    some = passages.join(ids, "doc_id", "left_semi")
    own = some if "seq" in passages.columns else passage_features(some)
    both = pairs.join(own, "doc_id").join(questions if "q_terms" in questions.columns else question_features(questions), "item_id")
    met = lambda a, b: F.size(F.array_intersect(a, b))
    return both.withColumns({
        "n": met("seq", "q_terms"),
        "na": met("seq", "q_anchors"),
        "nc": met("seq", "q_constraints"),
        "np": met(tx.pairs(F.col("seq")), "q_pairs"),
        "ns": met("full", "q_subjects"),
        "nh": met("head_terms", "q_terms"),
        "run": tx.let(F.array_join("seq", " "), longest_run),
        "phrase": whole_question(F.array_join("full", " ")),
    })


#: What of a question its pairs are counted by, and the text that has it all: each question of a batch is read once.
PACKED = ["q_terms", "q_anchors", "q_constraints", "q_pairs", "q_subjects", "q_grams", "q_full"]
PAIRED = "struct<seq:array<string>,said_full:string,dn:int,meta:double,text_meta:double,n:int,na:int,nc:int,np:int,ns:int,nh:int,run:int,phrase:int,near:int>"


def packed(features: DataFrame) -> DataFrame:
    """question_features() with q_pack, its PACKED as JSON."""
    return features.withColumn("q_pack", F.to_json(F.struct(*PACKED)))


class Asked:
    """The different questions of a batch of pairs, numbered, with the terms of each as keys: its number and those of the terms among some words."""

    def __init__(self, packs: pa.Array, words: pa.Array):
        coded = packs.dictionary_encode()
        self.of, self.rows = coded.indices.to_numpy(), [json.loads(p) for p in coded.dictionary.to_pylist()]
        self.words, self.many = words, max(1, len(words))

    def keys(self, name: str, parts: int = 1) -> np.ndarray:
        """Sorted; parts: how many terms each of the list has."""
        each = [t for r in self.rows for t in r[name]]
        key = np.repeat(np.arange(len(self.rows)), [len(r[name]) for r in self.rows])
        there = np.ones(len(each), dtype=bool)
        for column in zip(*(t.split(" ") for t in each), strict=True) if parts > 1 else [each]:
            at = pc.fill_null(pc.index_in(pa.array(column, pa.string()), self.words), -1).to_numpy().astype(np.int64)
            key, there = key * self.many + at, there & (at >= 0)
        return np.sort(key[there])

    def met(self, keys: np.ndarray, place: np.ndarray, *terms: np.ndarray) -> np.ndarray:
        """Of each pair how many of its question's keys are among its terms (place: the pair of each)."""
        wanted = np.zeros(self.many, dtype=bool)
        wanted[keys % self.many] = True
        some = np.flatnonzero(wanted[terms[-1]])
        if not len(some):
            return np.zeros(len(self.of), dtype=np.int32)
        place = place[some]
        key = self.of[place].astype(np.int64)
        for t in terms:
            key = key * self.many + t[some]
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        same = keys[at] == key
        return np.bincount(distinct(place[same] * len(keys) + at[same]) // len(keys), minlength=len(self.of)).astype(np.int32)


def worded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Of the terms of two letters or more of lower-case texts in order: the text of each, its number among words, and whether it is content; words; and the texts' noise."""
    rows = len(texts)
    of, code, tokens = tokens_of(texts)
    coded = terms_of(tokens).dictionary_encode()
    term, words = coded.indices.to_numpy(), coded.dictionary
    word = term[code].astype(np.int64)
    every = ~pc.less(pc.binary_length(words), 2).to_numpy(zero_copy_only=False)[word]
    content = ~(among(tokens, STOP) | among(words, STOP)[term])[code]
    meta = noise_of(np.bincount(of[every & among(words, META)[word]], minlength=rows), np.bincount(of[every], minlength=rows))
    return of[every], word[every], content[every], words, meta


def runs_of(said: str, grams: list[list[str]]) -> tuple[int, int]:
    """The longest run of a question in a text's content terms, as longest_run() has it, and how many of its different pairs of neighbours stand there."""
    own = [g in said for g in grams[0]]
    if True not in own:
        return 0, 0
    near, best = len({g for g, there in zip(grams[0], own, strict=True) if there}), 2
    for n in (3, 4, 5):
        own = [a and b and g in said for a, b, g in zip(own, own[1:], grams[n - 2], strict=False)]
        if True not in own:
            break
        best = n
    return best, near


def paired(texts: pa.Array, packs: pa.Array, heads: pa.Array | None = None, alone: pa.Array | None = None) -> pa.StructArray:
    """PAIRED of lower-case texts, each with its question. With headings, texts have them at their beginning, and alone has the texts without."""
    rows = len(texts)
    of, word, content, words, meta = worded(texts)
    asked, of_own, own = Asked(packs, words), of[content], word[content]
    counts = {n: asked.met(asked.keys(name), of_own, own) for n, name in (("n", "q_terms"), ("na", "q_anchors"), ("nc", "q_constraints"))}
    two = np.flatnonzero(of_own[:-1] == of_own[1:])
    counts["np"] = asked.met(asked.keys("q_pairs", 2), of_own[two], own[two], own[two + 1])
    counts["ns"] = asked.met(asked.keys("q_subjects"), of, word)
    counts["nh"], text_meta = np.zeros(rows, dtype=np.int32), meta
    if heads is not None:
        text_meta, (head_of, head, good, head_words, _) = worded(alone)[4], worded(heads)
        in_head = Asked(packs, head_words)
        counts["nh"] = in_head.met(in_head.keys("q_terms"), head_of[good], head[good])
    said, full = joined(words.take(pa.array(own)), of_own, rows), joined(words.take(pa.array(word)), of, rows)
    grams, phrases, at = [q["q_grams"] for q in asked.rows], [q["q_full"] for q in asked.rows], asked.of.tolist()
    runs = [runs_of(line, grams[q]) for q, line in zip(at, said.to_pylist(), strict=True)]
    counts["run"], counts["near"] = np.array(runs, dtype=np.int32).reshape(-1, 2).T
    counts["phrase"] = np.array([phrases[q] != "" and phrases[q] in line for q, line in zip(at, full.to_pylist(), strict=True)], dtype=np.int32)
    there = distinct(of_own * asked.many + own) // asked.many
    seq = pa.ListArray.from_arrays(np.searchsorted(of_own, np.arange(rows + 1)).astype(np.int32), words.take(pa.array(own)))
    cols = {"seq": seq, "said_full": full, "dn": np.bincount(there, minlength=rows).astype(np.int32), "meta": meta, "text_meta": text_meta}
    cols |= {c: counts[c] for c in ("n", "na", "nc", "np", "ns", "nh", "run", "phrase", "near")}
    return pa.StructArray.from_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in cols.values()], names=list(cols))


def counted(*columns: Column) -> Column:
    """PAIRED of columns as paired() takes them. A batch at a time, and not again for a filter on it: that is what it is marked nondeterministic for."""

    def plain(texts: pa.Array, packs: pa.Array) -> pa.Array:
        parts = [paired(texts.slice(at, end - at), packs.slice(at, end - at)) for at, end in pieces(texts, 1 << 14)]
        return pa.concat_arrays(parts) if parts else paired(texts, packs)

    def headed(texts: pa.Array, packs: pa.Array, heads: pa.Array, alone: pa.Array) -> pa.Array:
        parts = [paired(*(x.slice(at, end - at) for x in (texts, packs, heads, alone))) for at, end in pieces(texts, 1 << 14)]
        return pa.concat_arrays(parts) if parts else paired(texts, packs, heads, alone)

    return F.arrow_udf(headed if len(columns) > 2 else plain, PAIRED).asNondeterministic()(*columns)


def text_pairs(pairs: DataFrame, questions: DataFrame, asked_only: bool = False) -> DataFrame:
    """pair_features() of pairs (item_id, t_text, maybe heading) that carry their text, with said_full (all terms, blanks between) instead of full, and near.

    Made for texts of a bounded size, such as chunks and sentences: these are cut into terms where the pair is, so nothing is joined but
    the questions. asked_only: flags are worked out only where the question asks for a time or a nickname, and are 0 elsewhere."""
    features = questions if "q_pack" in questions.columns else packed(question_features(questions))
    both = pairs.join(features.select("item_id", *(c for c in features.columns if c.startswith(("q_", "is_")) or c in QUESTION)), "item_id")
    text, headed = F.coalesce("t_text", F.lit("")), "heading" in pairs.columns
    head = F.coalesce("heading", F.lit("")) if headed else None
    whole = F.trim(F.concat_ws(" ", head, text)) if headed else text
    read = F.when((F.col("is_when") == 1) | (F.col("is_nick") == 1), whole).otherwise("") if asked_only else whole
    more = [F.lower(head), F.lower(text)] if headed else []
    both = flagged(both.withColumns({"_c": counted(F.lower(whole), F.col("q_pack"), *more), "_text": read}))
    return both.select("*", "_c.*").drop("_c", "_text", "_year", "_month", "_date", "q_pack", "q_grams", "q_seq", "q_full", "q_pairs")


def rarity(pairs: DataFrame) -> DataFrame:
    """pairs (with seq and q_terms) with rarity: how rare a passage's question terms are among the question's candidates."""
    each = pairs.select("item_id", "doc_id", "qn", F.explode(F.array_intersect("seq", "q_terms")).alias("term"))
    df = each.groupBy("item_id", "term").agg(F.count("*").alias("df"))
    n = pairs.groupBy("item_id").agg(F.count("*").alias("_n"))
    share = F.sum(F.log((F.col("_n") + 1.0) / F.col("df"))) / F.first("qn")
    rare = each.join(df, ["item_id", "term"]).join(n, "item_id").groupBy("item_id", "doc_id").agg(F.round(F.least(F.lit(1.0), share), 9).alias("rarity"))
    return pairs.join(rare, ["item_id", "doc_id"], "left").fillna(0.0, ["rarity"])


#: What may be chosen by name: embeddings (documents, key, dimensions -> key and v), and rerankers (pairs with all features
#: of question and text -> the same with rerank). A name that is not here is an error when the plan is made.
EMBEDDINGS: dict[str, Callable[[DataFrame, str, int], DataFrame]] = {"hashing": embedded}
RERANKERS: dict[str, Callable[[DataFrame], DataFrame]] = {"token_overlap": lambda pairs: scored(pairs, rerank=scores.RERANK)}


def named(table: dict, name: str):
    if name not in table:
        raise ValueError(f"unknown provider {name}, known are {', '.join(sorted(table))}")
    return table[name]


def first_lists(questions: DataFrame, passages: DataFrame, limit: int, settings: Settings = scores.DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """The best of each question by dense and by lexical search; none by lexical search if settings turn it off.

    Questions with a document_id (a column they may have, as passages) look at that document alone: its passages are
    joined by it, so where passages are laid out by document only those of such documents are read."""
    embed = lambda df, key: named(EMBEDDINGS, settings.embedding_provider)(df, key, settings.embedding_dimensions)
    words = lambda q: lexical(q, passages, limit) if settings.enable_lexical else q.sparkSession.createDataFrame([], f"item_id {q.schema['item_id'].dataType.simpleString()}, doc_id {passages.schema['doc_id'].dataType.simpleString()}, score double, rank int")
    near = lambda q: dense(embed(passages, "doc_id"), embed(q, "item_id"), "doc_id", "item_id", limit)
    if "document_id" not in questions.columns:
        return near(questions), words(questions)
    free, bound = questions.filter("document_id IS NULL"), questions.filter("document_id IS NOT NULL")
    own = passages.join(small_side(bound.select("document_id").distinct(), 64), "document_id", "left_semi")
    pairs = saved(own.select("doc_id", "document_id").join(bound.select("item_id", "document_id"), "document_id").drop("document_id"), "scoped")
    both = pairs.join(embed(own, "doc_id").withColumnRenamed("v", "a"), "doc_id").join(embed(bound, "item_id").withColumnRenamed("v", "b"), "item_id")
    best = lambda df: top(df.select("item_id", "doc_id", "score"), "item_id", limit, F.desc("score"), "doc_id")
    first = best(both.withColumn("score", F.round(cosine("a", "b"), 9)))
    second = best(scored(candidate_features(pairs, bound, own), score=scores.LEXICAL).filter("score > 0")) if settings.enable_lexical else words(bound)
    if free.isEmpty():
        return first, second
    return near(free).unionByName(first), words(free).unionByName(second)


def candidate_features(pairs: DataFrame, questions: DataFrame, passages: DataFrame) -> DataFrame:
    """pair_features(); passages with headings are chunks, so their texts are cut where the pair is, and have flags if the question asks for them."""
    if "heading" not in passages.columns:
        return pair_features(pairs, questions, passages)
    return text_pairs(pairs.join(passages.select("doc_id", F.col("text").alias("t_text"), "heading"), "doc_id"), questions, asked_only=True).drop("t_text", "heading")


def candidates(questions: DataFrame, passages: DataFrame, limit: int = 20, settings: Settings = scores.DEFAULTS) -> DataFrame:
    """Features, scores, ranks and rarity of all that dense or lexical search finds, and hybrid: the fused score, 1 for the best of each question."""
    # A few rows a question, used several times from here on.
    both = saved(fuse(*first_lists(questions, passages, limit, settings), "item_id", "doc_id", settings), "fused")
    asked = questions.filter(tx.collapse(F.coalesce("text", F.lit(""))) != "").select("item_id")
    pairs = rarity(saved(candidate_features(both.join(asked, "item_id", "left_semi"), questions, passages), "pairs"))
    full = scored(pairs, specificity=f"least(1.0, {scores.LEXICAL})", focus=scores.FOCUS, intent=scores.INTENT, penalty=scores.PENALTY, fused=scores.fused(settings))
    best = F.max("fused").over(Window.partitionBy("item_id"))
    return full.withColumn("hybrid", F.round(F.when(best > 0, F.col("fused") / best).otherwise(0.0), 9))


def fused(questions: DataFrame, passages: DataFrame, limit: int = 20, settings: Settings = scores.DEFAULTS) -> DataFrame:
    """The best candidates of each question by the fused score, with their rank."""
    return top(candidates(questions, passages, limit, settings), "item_id", limit, F.desc("hybrid"), F.desc("lexical_score"), F.desc("dense_score"), "doc_id")


def search(questions: DataFrame, passages: DataFrame, k: int = 5, settings: Settings = scores.DEFAULTS) -> DataFrame:
    """The best k passages of each question: fused candidates by the reranked score, with all their scores. A blank question finds nothing."""
    rate = named(RERANKERS, settings.reranker)
    found = fused(questions, passages, max(k, k * settings.candidate_multiplier), settings).withColumnRenamed("rank", "fused_rank")
    if "heading" in passages.columns:  # the reranker reads the text alone
        found = saved(found, "found")
        alone = rate(text_pairs(found.select("item_id", "doc_id").join(passages.select("doc_id", F.col("text").alias("t_text")), "doc_id"), questions, asked_only=True))
        last = found.join(alone.select("item_id", "doc_id", "rerank"), ["item_id", "doc_id"])
    else:
        last = rate(found.drop("alias", "head"))
    last = last.withColumn("score", F.round(F.expr(scores.final(settings)), 9))
    return top(last, "item_id", k, *map(F.desc, ("score", "rerank", "hybrid", "lexical_score", "dense_score")), "doc_id")


def rerank(pairs: DataFrame) -> DataFrame:
    """item_id, doc_id, rerank and rank of explicit passages, from pair_features()."""
    return top(scored(pairs, rerank=scores.RERANK).select("item_id", "doc_id", "rerank"), "item_id", 1 << 30, F.desc("rerank"), "doc_id")
