"""Benchmark decontamination by template canonicalisation.

A text becomes a sequence of lower-cased tokens in which numbers, names and units
after numbers are typed placeholders. Whether a capital makes a name depends on
what stands before it and on how the text was set, so each window has three
templates, and two windows meet if any of theirs are equal: capitalised words
are names inside a sentence only, are names everywhere (but for PLAIN words), or
are words like any other, which meets texts in capitals or without them.
Windows of ``WINDOW`` template tokens are hash-joined with those of the
benchmark, so a question with other numbers and names still meets its source.
Items that differ in their slots' values only, with the same values equal, are one
class, and documents are joined with classes: 200 questions of one template give a
document one row, not 200. Matches are put together by alignment (offset between
document and class); in each, a slot's value must stand for one value of the
document wherever it recurs, and no two values for the same one (slot
consistency). A template with fewer than ``LEAST`` literal tokens says
too little; windows that have no other are met by the same tokens only, numbers
included, and items are of one class only if these are equal. A document is
contaminated by a class if consistent alignments cover ``coverage`` of its
windows, or of those that have a template (what differs only in its numbers can't
meet the others). If the document has all of an item's own values, that item is
named, else the class's least.

Two passes: the first looks up every window of every document, so that what is
met doesn't depend on where it stands; the second aligns the windows of the
documents found. Items under ``WHOLE`` = 11 tokens are looked up whole.

Edge cases: null and empty texts match nothing; an item of one token is met only
by a document that is no more than that; repeated items are of one class; rows
that repeat an id are told apart by their texts; very long texts are looked up
whole; of equal alignments all count, of items with equal values the least id is
named (ids that are null last); an empty table on either side gives an empty
result, and columns of any name come back from clean() as they were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed, let, packed, saved, small_side

WINDOW, WHOLE, LEAST = 8, 11, 4
COVERAGE, CONSISTENCY = 0.5, 0.8
#: HEAD marks a capital that may only be due to the start of a sentence.
NUMBER, UNIT, NAME, HEAD, END = "\ue000", "\ue001", "\ue002", "\ue003", "\ue004"
MARKS = f"{NUMBER}-{HEAD}"
UNITS = "mm cm m km in inch inches ft feet mile miles mg g kg lb lbs oz ml l litre litres liter liters s sec second seconds min minute minutes h hour hours day days week weeks month months year years percent degrees dollars euros usd eur kb mb gb tb hz khz mhz ghz w kw mw v kv kwh mph kmh"

#: Words that are no names, whatever their first letter.
PLAIN = "a an the this that these those what which who whom whose when where why how is are was were am be been do does did has have had can could will would shall should may might must if then so and or but nor not no yes of in on at to by for from with as than there here it its he she they we you i his her their our your my me him them us each every all some any many much more most one two"


def tokens(text: Column) -> Column:
    """Tokens of a text; those that stand for a slot begin with its mark."""
    text = F.coalesce(text, F.lit(""))
    units, plain = UNITS.replace(" ", "|"), PLAIN.replace(" ", "|")

    def numbers(t: Column) -> Column:
        t = F.regexp_replace(t, r"(?<=\p{N})[.,:/-](?=\p{N})", "")
        t = F.regexp_replace(t, r"(?<![\p{L}\p{N}" + MARKS + r"])(?=\p{N})", NUMBER)
        return F.regexp_replace(t, rf"(?i)(?<=\p{{N}} )(?=(?:{units})(?![\p{{L}}\p{{N}}]))", UNIT)

    counted = F.when(text.rlike(r"\p{N}"), numbers(text)).otherwise(text)
    capital = rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{N}}{MARKS}])(?!(?i:{plain})(?![\p{{L}}\p{{N}}]))"
    marked = F.regexp_replace(F.regexp_replace(counted, capital, HEAD), rf"{HEAD}(?<=[\p{{L}}\p{{N}},;:] {HEAD})", NAME)
    return F.filter(F.split(F.lower(marked), rf"[^\p{{L}}\p{{N}}{MARKS}]+"), lambda t: t != "")


def _mark(t: Column) -> Column:
    return F.substring(t, 1, 1)


def _word(t: Column) -> Column:
    return F.substring(t, 2, 1 << 30)


#: What a marked token becomes in each template.
FORMS = (
    lambda t: F.when(t < HEAD, _mark(t)).otherwise(_word(t)),
    lambda t: F.when(t < HEAD, _mark(t)).otherwise(F.lit(NAME)),
    lambda t: F.when(t < NAME, _mark(t)).otherwise(_word(t)),
)


def template(toks: Column, form) -> Column:
    return F.transform(toks, lambda t: F.when((t < NUMBER) | (t >= END), t).otherwise(form(t)))


def bare(tok: Column) -> Column:
    """The token without its mark."""
    return F.translate(tok, NUMBER + UNIT + NAME + HEAD, "")


def exact(toks: Column) -> Column:
    return F.transform(toks, bare)


def hashed(temps: Column) -> Column:
    """The hash of each token; a window's hash is that of these numbers, alike for an array and for its members."""
    return F.transform(temps, lambda t: F.xxhash64(t))


def _starts(n: Column, size: int) -> Column:
    return F.when(n >= size, F.sequence(F.lit(0), n - size)).otherwise(F.array().cast("array<int>"))


def _slot(t: Column) -> Column:
    return (t >= NUMBER) & (t < END)


def _same(toks: Column) -> Column:
    """The tokens of a window as one string, for those that are met by the same tokens only."""
    return F.array_join(exact(toks), " ")


def items(benchmark: DataFrame) -> DataFrame:
    """item_id, t (tokens), n, slots (for each: the first slot of the same value, and whether it counts), values (a hash of the slots' values) and class of each item.

    A capital at the start of a sentence counts as a slot only where its word recurs: it may be a word like any other."""
    t = benchmark.select("item_id", tokens(F.col("text")).alias("t")).filter(F.size("t") > 0).withColumn("n", F.size("t"))
    t = t.withColumn("told", F.transform(F.filter("t", _slot), bare))
    first = F.transform("told", lambda v: F.array_position("told", v).cast("int"))
    # Numbers and units have no form in which they are literals, capitals have one.
    size = F.when(F.col("n") >= WHOLE, WINDOW).otherwise(F.col("n"))
    poor = F.filter(F.transform(_starts(F.col("n"), size), lambda i: F.slice("t", i + 1, size)), lambda w: F.size(F.filter(w, lambda x: (x < NUMBER) | (x >= NAME))) < LEAST)
    said = F.transform("t", lambda x: F.when(_slot(x), _mark(x)).otherwise(x))
    key = [F.array_join(said, " "), F.array_join(F.transform(first, lambda k: k.cast("string")), " "), F.array_join(F.transform(poor, _same), "\n")]
    return t.withColumns({"first": first, "class": F.sha2(F.concat_ws("\n\n", *key), 256), "values": F.sha2(F.array_join("told", " "), 256)}).drop("told")


def index(known: DataFrame) -> DataFrame:
    """class, pos, size, whether it has a template (rich), slots and hash of each window of items(), once for each class.

    Slots are array<struct<i, own, counts>>: place in the window, number of its value, whether it counts."""
    each = known.withColumn("pos", F.explode(F.when(F.col("n") >= WHOLE, _starts(F.col("n"), WINDOW)).otherwise(F.array(F.lit(0))))).withColumn("size", F.when(F.col("n") >= WHOLE, WINDOW).otherwise(F.col("n")))
    cut = each.withColumn("own", F.slice("t", F.col("pos") + 1, F.col("size")))
    literals = lambda w: F.size(F.filter(w, lambda t: ~_slot(t)))
    said = F.filter(F.array(*(template(F.col("own"), f) for f in FORMS)), lambda w: literals(w) >= LEAST)
    cut = cut.withColumn("said", said).withColumn("rich", F.size("said") > 0)
    said = F.when(F.col("rich"), F.col("said")).otherwise(F.array(exact(F.col("own"))))
    passed = F.size(F.filter(F.slice("t", F.lit(1), F.col("pos")), _slot))
    places = F.filter(F.transform("own", lambda x, i: F.when(_slot(x), F.struct(i.alias("i"), (x < HEAD).alias("sure")))), lambda p: p.isNotNull())

    def slot(p: Column, k: Column) -> Column:
        own = F.get("first", F.col("passed") + k)
        recurs = F.size(F.filter("first", lambda x: x == own)) > 1
        return F.struct(p["i"].alias("i"), (F.col("passed") + k).alias("at"), own.alias("own"), (p["sure"] | recurs).alias("counts"))

    cut = cut.withColumn("passed", passed).withColumn("slots", F.transform(places, slot))
    return cut.withColumn("hash", F.explode(F.array_distinct(F.transform(said, lambda w: F.xxhash64(hashed(w)))))).select("class", "pos", "size", "rich", "slots", "hash").distinct()


def _windows(toks: Column, sizes: list[int]) -> list[Column]:
    """start, size and hash of the windows of a document, by template, then of the same tokens.

    The last template is taken of each window, the others and the tokens where they differ from it."""
    told, short = [s for s in sizes if s >= LEAST], [s for s in sizes if s < LEAST]
    cut = lambda temps, some, at=None: let(hashed(temps), lambda h: F.concat(*(_cut(h, s, at) for s in some)))
    inner, capital, number = (lambda t: t.startswith(NAME)), (lambda t: (t >= NAME) & (t < END)), (lambda t: t.startswith(NUMBER))
    none = F.array().cast("array<struct<i:int,size:int,hash:bigint>>")
    some = lambda temps, kind: F.when(F.exists(toks, kind), cut(temps, told, _places(toks, kind))).otherwise(none)
    same = [some(exact(toks), number)] + ([cut(exact(toks), short)] if short else [])
    return [some(template(toks, FORMS[0]), inner), some(template(toks, FORMS[1]), capital), cut(template(toks, FORMS[2]), told), *same]


def _places(toks: Column, kind) -> Column:
    at = F.transform(toks, lambda t, i: F.when(kind(t), i))
    return F.filter(at, lambda i: i.isNotNull())


def _cut(h: Column, size: int, at: Column | None = None) -> Column:
    """Windows of a size: all, or those that hold a place of at."""
    starts = _starts(F.size(h), size)
    if size == 1:
        starts = F.when(F.size(h) == 1, starts).otherwise(F.array().cast("array<int>"))
    if at is not None:
        around = lambda c: F.sequence(F.greatest(F.lit(0), c - (size - 1)), F.least(c, F.size(h) - size))
        starts = F.when(F.size(h) >= size, F.array_distinct(F.flatten(F.transform(at, around)))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(i.alias("i"), F.lit(size).alias("size"), F.xxhash64(*(F.get(h, i + k) for k in range(size))).alias("hash")))


def find(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, consistency: float = CONSISTENCY) -> DataFrame:
    """_id, _h, item_id, class_id, n_items, exact, n_windows, n_matched, coverage and consistency of each contaminated document and class of items.

    class_id is the class's least item, n_items their number; item_id the item whose very values the document has (exact), else class_id."""
    base = keyed(docs)
    bench = saved(items(benchmark), "items")
    known = saved(index(bench), "index")
    # At most the lengths 1 to 10: whole short items, and WINDOW for the others.
    sizes = sorted({WINDOW, *(r.size for r in known.select("size").distinct().collect())})
    hashes = small_side(saved(known.select("hash").distinct(), "hashes"))
    each = let(tokens(F.col("_text")), lambda t: F.array_distinct(F.concat(*(w["hash"] for w in _windows(t, sizes)))))
    first = base.select("_id", "_h", F.explode(each).alias("hash"))
    met = saved(first.join(hashes, "hash", "left_semi").select("_id", "_h").distinct(), "met").withColumnsRenamed({"_id": "_i", "_h": "_k"})
    some = base.join(small_side(met), (base["_h"] == met["_k"]) & base["_id"].eqNullSafe(met["_i"]), "left_semi")

    some = some.select("_id", "_h", tokens(F.col("_text")).alias("t"))
    every = some.withColumn("w", F.explode(F.concat(*_windows(F.col("t"), sizes)))).select("_id", "_h", "w.*", F.slice("t", F.col("w.i") + 1, F.col("w.size")).alias("there"))
    hits = every.join(small_side(known), ["hash", "size"])
    pairs = F.transform("slots", lambda s: F.struct(s["at"].alias("at"), s["own"].alias("own"), s["counts"].alias("counts"), bare(F.get("there", s["i"])).alias("there")))
    aligned = hits.groupBy("_id", "_h", "class", (F.col("i") - F.col("pos")).alias("offset")).agg(
        F.collect_set("pos").alias("places"), F.collect_set(F.when(F.col("rich"), F.col("pos"))).alias("told"), F.sort_array(F.array_distinct(F.flatten(F.collect_set(pairs)))).alias("slots")
    )
    number = lambda *names: F.size(F.array_distinct(F.transform(F.filter("slots", lambda p: p["counts"]), lambda p: F.struct(*(p[n] for n in names)))))
    held = F.when(number("own") == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 2 - number("own", "there") / F.least(number("own"), number("there"))))
    values = F.sha2(F.array_join(F.transform("slots", lambda p: p["there"]), " "), 256)
    different = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c)))).cast("long")
    aligned = aligned.withColumn("held", held).filter(F.col("held") >= consistency).withColumn("values", values)
    exact_items = small_side(saved(bench.groupBy("class", "values").agg(F.min("item_id").alias("exact_id"), F.first(F.size("first")).alias("n_slots")), "exact_items"))
    named = aligned.join(exact_items, ["class", "values"], "left")
    classes = bench.withColumn("w", F.when(F.col("n") >= WHOLE, F.col("n") - WINDOW + 1).otherwise(1)).groupBy("class").agg(F.min("item_id").alias("class_id"), F.count("*").alias("n_items"), F.first("w").cast("long").alias("n_windows"))
    rich = known.groupBy("class").agg(F.countDistinct(F.when(F.col("rich"), F.col("pos"))).alias("n_rich"))
    classes = small_side(saved(classes.join(rich, "class"), "classes"))
    # An item is named only where its whole text was met.
    counted = named.join(classes, "class").withColumn("whole", F.size("places") == F.col("n_windows"))
    matched = counted.groupBy("_id", "_h", "class", "class_id", "n_items", "n_windows", "n_rich").agg(
        different("places").alias("n_matched"), different("told").alias("n_told"), F.min("held").alias("consistency"), F.max(F.col("whole") & F.col("n_slots").isNotNull()).alias("exact"), F.min(F.when(F.col("whole"), F.col("exact_id"))).alias("exact_id")
    )
    share = F.col("n_matched") / F.col("n_windows")
    share = F.when(F.col("n_rich") > 0, F.greatest(share, F.col("n_told") / F.col("n_rich"))).otherwise(share).alias("coverage")
    out = matched.select("_id", "_h", F.coalesce("exact_id", "class_id").alias("item_id"), "class_id", "n_items", "exact", "n_windows", "n_matched", share, "consistency")
    return out.filter(F.col("coverage") >= coverage)


def members(benchmark: DataFrame) -> DataFrame:
    """item_id and class_id of each item that has tokens."""
    known = items(benchmark).select("item_id", "class")
    return known.join(known.groupBy("class").agg(F.min("item_id").alias("class_id")), "class").select("item_id", "class_id")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return find(docs, benchmark).drop("_h").withColumnRenamed("_id", "doc_id").distinct()


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that no item contaminates."""
    base = packed(docs)
    bad = small_side(saved(find(docs, benchmark).select(F.col("_id").alias("_i"), F.col("_h").alias("_k")).distinct(), "bad"))
    return base.join(bad, (base["_h"] == bad["_k"]) & base["_id"].eqNullSafe(bad["_i"]), "left_anti").select("_row.*")
