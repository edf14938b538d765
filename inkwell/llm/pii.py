"""Personal data: patterns, and terms that give protected entities away.

Base spans are e-mail addresses, IP addresses, card and phone numbers. Each
stands for protected entities e: the value itself, and what it shares with
others, so that the corpus can say something of values that occur once: the
owner (the words of an e-mail's local part), its domain, an IP's block of 256,
the first six digits of a card or phone number. How strongly a term t reveals e
is estimated from the corpus: with n documents, pointwise mutual information
PMI(e; t) = log2(n * n(e, t) / (n(e) * n(t))) against the information of the
entity IC(e) = log2(n / n(e)), where n(e, t) counts documents that have t within
``window`` words of e. PMI / IC is 1 if t is always near e and nowhere else.
Small counts can be chance, so it counts only if that is unlikely: if t stood
near any of the n(e) documents with a probability of n(t) / n, the c different
contexts in which both stand would have at most C(n(e), c) * (n(t) / n)^c, and
that times the pairs of entity and term that were tested must be ``chance`` at
most. Two contexts can pass; contexts that share all words of one side are
copies and count once. In the documents that hold e, terms of a
disclosure of ``remove`` or more become [TERM]; those of ``generalise`` or more
become their kind ([NAME] if capitalised, else [WORD]).

Offsets are code points, ends exclusive.

Edge cases: null and empty texts have no spans; overlapping spans of different
kinds are all reported and masked as one; rows that repeat an id share the
terms found for that id and text; of a term's two levels the stronger counts;
very long texts are read whole, a window at a time; columns of any name and
value come back as they were; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed, packed, saved, small_side

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# What starts inside a run of digits can't match if the run's start doesn't.
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile(r"[^0-9]")
TERM = regex.compile(r"\p{L}{3,}")  # as terms_of() has it


def emails(text: str) -> list[tuple[int, int]]:
    """Of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, looked for at each @."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", at + 1)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """kind, start, end, by kind and start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
    for m in CARD.finditer(text):
        digits = DIGITS.sub("", m[0]) if len(m[0]) <= 40 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(DIGITS.sub("", m[0])) <= 15]
    return out


def entities(kind: str, value: str) -> list[str]:
    """What a value stands for: itself, and the owner and the class it shares with others."""
    digits = DIGITS.sub("", value)
    if kind == "email":
        local, _, domain = value.lower().rpartition("@")
        owner = " ".join(sorted(TERM.findall(local)))
        return [f"email:{local}@{domain}", f"domain:{domain}"] + ([f"owner:{owner}"] if owner else [])
    if kind == "ip":
        return [f"ip:{value}", f"block:{value.rpartition('.')[0]}"]
    return [f"{kind}:{digits}", f"{kind} prefix:{digits[:6]}"]


def words_before(text: str, end: int, window: int) -> str:
    """The last words of text[:end], looked for further back until there are enough."""
    reach = window * 16
    while True:
        start = max(0, end - reach)
        words = text[start:end].split()
        if start == 0 or len(words) > window + 1:
            return " ".join(words[-window:])
        reach *= 4


def words_after(text: str, start: int, window: int) -> str:
    reach = window * 16
    while True:
        words = text[start : start + reach].split()
        if start + reach >= len(text) or len(words) > window + 1:
            return " ".join(words[:window])
        reach *= 4


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def contexts(text: str, window: int):
    """Of each base span: its entities, a hash of what stands before it, the texts on both sides, and a hash of what stands after it.

    A side that the text's end cuts short says little of a copy, so its hash is that of both sides."""
    for kind, a, b in base_spans(text):
        sides = words_before(text, a, window), words_after(text, b, window)
        near = "\n".join(sides)
        before, after = (_hash(s if s.count(" ") == window - 1 else near) for s in sides)
        yield entities(kind, text[a:b]), before, near, after


def mentions(docs: DataFrame, window: int) -> DataFrame:
    """_id, _h, and the entities, the hash before, the text near and the hash after of each base span. docs: see keyed()."""

    def run(batches):
        for batch in batches:
            rows = [(i, h, *c) for i, h, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for c in contexts(t, window)]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            types = [batch.schema.field(0).type, pa.int64(), pa.list_(pa.string()), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["_id", "_h", "entities", "before", "near", "after"])

    kind = docs.schema["_id"].dataType.simpleString()
    return docs.filter(F.col("_text").rlike("[0-9@]")).mapInArrow(run, f"_id {kind}, _h long, entities array<string>, before long, near string, after long")


def terms_of(text) -> Column:
    """The different terms of a text: letters, three or more, without case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}{3,}"), F.lit(0)))


def disclosures(docs: DataFrame, seen: DataFrame, chance: float) -> DataFrame:
    """entity, term, disclosure of the terms that stand near an entity more often than by chance. docs and seen: as above."""
    each = seen.select("_h", "before", "after", "near", F.explode("entities").alias("entity"))
    n_e = each.groupBy("entity").agg(F.countDistinct("_h").alias("n_e"))
    near = each.select("_h", "before", "after", "entity", F.explode(terms_of(F.col("near"))).alias("term"))
    different = F.least(F.countDistinct("before"), F.countDistinct("after"), F.countDistinct("_h")).alias("contexts")
    pairs = saved(near.groupBy("entity", "term").agg(different, F.countDistinct("_h").alias("n_et")), "pairs")
    some = pairs.filter("contexts > 1")
    if some.isEmpty():
        return some.select("entity", "term", F.lit(0.0).alias("disclosure"))
    # Counted in each task before any join, so that a task sends a row for each different word.
    n_t = docs.select(F.explode(terms_of(F.col("_text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    n, tested = float(docs.count()), pairs.count()
    counted = some.join(n_e, "entity").join(n_t, "term", "left").withColumn("n_t", F.greatest(F.coalesce("n_t", F.lit(0)), "n_et"))
    pmi = F.log2(F.lit(n) * F.col("n_et") / (F.col("n_e") * F.col("n_t")))
    info = F.log2(F.lit(n) / F.col("n_e"))
    strong = (info > 0) & (by_chance(n) + math.log(tested) <= math.log(chance))
    return counted.filter(strong).select("entity", "term", (pmi / info).alias("disclosure"))


def by_chance(n: float) -> Column:
    """The logarithm of C(n_e, c) * (n_t / n)^c for c contexts, or a little more: n_e^c stands for n_e! / (n_e - c)!, and c! is Stirling's."""
    c = F.col("contexts")
    return c * (F.log(F.col("n_e") * F.col("n_t") / (c * n)) + 1) - F.log(c * (2 * math.pi)) / 2


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, last = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= last:
            out += [text[last:a], f"[{kind.upper()}]"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def find(docs: DataFrame, window: int = 8, chance: float = 0.05, generalise: float = 0.5, remove: float = 0.75) -> DataFrame:
    """_row (all columns of docs), _id, _h, and found: spans array<struct<kind, start, end>> and the sanitised text of each document.

    Kinds are those of the base, then term, name and word."""
    base = packed(docs)
    seen = saved(mentions(keyed(docs), window), "mentions")
    strong = disclosures(keyed(docs), seen, chance).filter(F.col("disclosure") >= generalise)
    strong = small_side(saved(strong, "strong"))
    level = F.when(F.col("disclosure") >= remove, F.concat(F.lit("-"), "term")).otherwise(F.concat(F.lit("~"), "term"))
    held = seen.select(F.col("_id").alias("_i"), F.col("_h").alias("_k"), F.explode("entities").alias("entity")).distinct()
    told = held.join(strong, "entity").groupBy("_i", "_k").agg(F.sort_array(F.collect_set(level)).alias("_terms"))
    told = small_side(saved(told, "told"))
    both = base.join(told, (base["_h"] == told["_k"]) & base["_id"].eqNullSafe(told["_i"]), "left")
    return both.select("_row", "_id", "_h", F.arrow_udf(sanitised, FOUND)("_text", "_terms").alias("found"))


FOUND = "struct<spans:array<struct<kind:string,start:bigint,end:bigint>>,text:string>"


def sanitised(texts: pa.Array, terms: pa.Array) -> pa.Array:
    spans, out = [], []
    for text, told in zip(texts, terms, strict=True):
        text, told = text.as_py(), told.as_py()
        own = base_spans(text) if text else []
        if text and told:
            how = {t[1:]: t[0] for t in reversed(told)}
            for m in TERM.finditer(text):
                if mark := how.get(m[0].lower()):
                    own.append(("term" if mark == "-" else "name" if m[0][0].isupper() else "word", *m.span()))
        spans.append([{"kind": k, "start": a, "end": b} for k, a, b in own])
        out.append(masked(text, own) if own else text)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    return pa.StructArray.from_arrays([pa.array(spans, pa.list_(span)), pa.array(out, pa.string())], ["spans", "text"])


def digests(docs: DataFrame) -> DataFrame:
    spans = F.col("found.spans")
    named = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    joined = F.concat_ws(",", F.transform(F.filter(spans, lambda s: s["kind"].isin(*KINDS)), named))
    return find(docs.select("doc_id", "text")).select(
        F.col("_id").alias("doc_id"),
        *(count(k) for k in KINDS),
        F.sha2(joined, 256).alias("base_sha256"),
        F.concat_ws(",", F.transform(spans, named)).alias("spans"),
        (F.size(spans) > 0).alias("private"),
        F.size(F.filter(spans, lambda s: ~s["kind"].isin(*KINDS))).cast("long").alias("n_terms"),
    )


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with sanitised texts, n_chars to match, in the same columns."""
    new = {"text": F.col("found.text")}
    if "n_chars" in docs.columns:
        length = F.length("found.text").cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(F.size("found.spans") > 0, length).otherwise(F.col("_row.n_chars"))
    return find(docs).select(*(new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns))
