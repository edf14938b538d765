"""Tokens, terms and text predicates as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists of the scoring rules.
STOPWORDS = "a about an and are as at be by does for from how in is it need needs note notes of on or say says should that the this to what when where which who would with".split()
NON_ANCHOR = "appear article book call discuss happen mention nickname occur policy say tell thing use write".split()
METADATA = "copyright edition hardcover isbn library paperback print printed publish publisher renew reserv rights".split()


def let(value: Column, body) -> Column:
    """body(value) with value worked out once: what a lambda names isn't put in its place again, as a column used within a lambda is."""
    return F.element_at(F.transform(F.array(value), body), 1)


def printed(value: Column, places: int) -> Column:
    """A number from 0 up with 3 or 4 decimals as C's printf writes it: to the nearer side of its exact binary value, ties to an even digit.
    format_string() rounds the shortest decimal that names the number instead, and ties up."""
    by = 10**places

    def of(high: Column) -> Column:
        # A product of either part has no more bits than a double holds, so it is exact.
        return let(F.struct((high * by).alias("high"), ((value - high) * by).alias("low")), near)

    def near(x: Column) -> Column:
        return let(F.struct(F.floor(x["high"]).alias("n"), (x["high"] - F.floor(x["high"]) - 0.5 + x["low"]).alias("over")), written)

    def written(x: Column) -> Column:
        up = (x["over"] > 0) | ((x["over"] == 0) & (x["n"] % 2 == 1))
        return let(x["n"] + up.cast("long"), lambda n: F.concat(F.floor(n / by).cast("string"), F.lit("."), F.lpad((n % by).cast("string"), places, "0")))

    return let(F.floor(value * (1 << 26)) / float(1 << 26), of)


def collapse(text: Column) -> Column:
    """White space as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9]+"), F.lit(0))


def stem(token: Column) -> Column:
    """A lower-case token after the first suffix rule that fits."""
    n = F.length(token)
    cut = lambda k: F.substring(token, F.lit(1), n - k)
    ends = lambda s, over: (n > over) & token.endswith(s)

    def single(t: Column) -> Column:
        twice = (F.length(t) >= 2) & (F.right(t, F.lit(1)) == F.substring(t, F.length(t) - 1, F.lit(1)))
        return F.when(twice, F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t)

    return (
        F.when(ends("ies", 5), F.concat(cut(3), F.lit("y")))
        .when(ends("ing", 4), single(cut(3)))
        .when(ends("ed", 3), single(cut(2)))
        .when(ends("es", 3), cut(2))
        .when(ends("s", 3), cut(1))
        .when(ends("ion", 5), cut(3))
        .otherwise(token)
    )


def without_e(stem: Column) -> Column:
    return F.when((F.length(stem) > 5) & stem.endswith("e"), F.substring(stem, F.lit(1), F.length(stem) - 1)).otherwise(stem)


def term(token: Column) -> Column:
    """The normal form of a lower-case token: the first suffix rule that fits, then a final e."""
    return without_e(stem(token))


def term_of(token: str) -> str:
    """term() of one token, for what runs in tasks."""
    n, single = len(token), lambda t: t[:-1] if len(t) > 1 and t[-1] == t[-2] else t
    if n > 5 and token.endswith("ies"):
        token = token[:-3] + "y"
    elif n > 4 and token.endswith("ing"):
        token = single(token[:-3])
    elif n > 3 and token.endswith("ed"):
        token = single(token[:-2])
    elif n > 3 and token.endswith("es"):
        token = token[:-2]
    elif n > 3 and token.endswith("s"):
        token = token[:-1]
    elif n > 5 and token.endswith("ion"):
        token = token[:-3]
    return token[:-1] if len(token) > 5 and token.endswith("e") else token


# Patterns of dates, times and nicknames. Both engines read them; what \b stands for is written out.
MONTHS = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
NUMERIC_DATE = "[0-9]{1,2}[/-][0-9]{1,2}(?:[/-][0-9]{2,4})?"
TIMES = "morning|afternoon|evening|night|weekend|spring|summer|fall|autumn|winter|noon|midnight"
AFTER = r"(?:before|after|during|while|upon|once)\s+[A-Za-z0-9]"
ALIAS = r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?\s+the\s+[A-Z][a-z]+"
SELF = r"they\s+don't\s+call\s+me|they\s+call\s+me|call\s+me|known\s+as"
THE = r"[a-z]+(?:\s+[a-z]+)?\s+the\s+[a-z]+"


def bounded(pattern: str, end: bool = True, case: bool = False) -> str:
    """A pattern between word boundaries, in the words of both engines."""
    return ("" if case else "(?i)") + rf"(?:^|[^\p{{L}}\p{{N}}_])(?:{pattern})" + (r"(?:[^\p{L}\p{N}_]|$)" if end else "")


YEAR_RE, MONTH_RE = bounded("[0-9]{4}"), bounded(MONTHS)
DATE_RE = bounded(f"{MONTHS}|[0-9]{{4}}|{NUMERIC_DATE}")
TEMPORAL_RE, TIME_RE = bounded(AFTER, end=False), bounded(TIMES)
ALIAS_RE, SELF_RE, THE_RE = bounded(ALIAS, case=True), bounded(SELF), bounded(THE, case=True)


def quick(pattern: str, first: str, end: bool = True, case: bool = False) -> str:
    """What bounded() finds, for Spark: looks about instead of reading the neighbours, and only where a letter or digit can begin it."""
    return ("" if case else "(?i)") + rf"(?=[{first}])(?<![\p{{L}}\p{{N}}_])(?:{pattern})" + (r"(?![\p{L}\p{N}_])" if end else "")


QUICK_YEAR, QUICK_MONTH, QUICK_NUMERIC = quick("[0-9]{4}", "0-9"), quick(MONTHS, "jfmasond"), quick(NUMERIC_DATE, "0-9")
QUICK_TEMPORAL, QUICK_TIME = quick(AFTER, "abdouw", end=False), quick(TIMES, "aefmnsw")
QUICK_ALIAS, QUICK_SELF, QUICK_THE = quick(ALIAS, "A-Z", case=True), quick(SELF, "ckt"), quick(THE, "a-z", case=True)


def terms(text: Column) -> Column:
    """raw and term of each token in order; terms under two letters are left out."""
    stems = F.transform(tokens(text), lambda r: F.struct(r.alias("raw"), stem(F.lower(r)).alias("stem")))
    both = F.transform(stems, lambda s: F.struct(s["raw"].alias("raw"), without_e(s["stem"]).alias("term")))
    return F.filter(both, lambda s: F.length(s["term"]) > 1)


def is_content(t: Column) -> Column:
    """Whether an element of terms() is no stop word."""
    return ~F.lower(t["raw"]).isin(STOPWORDS) & ~t["term"].isin(STOPWORDS)


def has_date(text: Column) -> Column:
    return text.rlike(QUICK_YEAR) | text.rlike(QUICK_MONTH) | text.rlike(QUICK_NUMERIC)


def has_temporal(text: Column) -> Column:
    return has_date(text) | text.rlike(QUICK_TEMPORAL) | text.rlike(QUICK_TIME)


def has_alias(text: Column) -> Column:
    """A nickname in the text, whoever it belongs to."""
    return let(collapse(text), lambda flat: flat.rlike(QUICK_ALIAS) | (flat.rlike(QUICK_SELF) & F.lower(flat).rlike(QUICK_THE)))


def noise(full: Column) -> Column:
    """How much of a text's terms is about an edition or a copyright; full: all terms, stop words too."""

    def of(m: Column) -> Column:
        return F.when(m == 0, 0.0).otherwise(F.least(F.lit(1.0), m / F.size(full) * 4 + F.when(m >= 2, 0.2).otherwise(0.0)))

    return let(F.size(F.filter(full, lambda t: t.isin(METADATA))), of)


def pairs(seq: Column) -> Column:
    """Different neighbouring pairs, each as two terms with a blank between."""

    def both(s: Column) -> Column:
        two = F.zip_with(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), F.slice(s, 2, F.size(s)), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.when(F.size(s) > 1, F.array_distinct(two)).otherwise(F.array().cast("array<string>"))

    return let(seq, both)


def unequal(pairs: Column) -> Column:
    return F.filter(pairs, lambda p: F.substring_index(p, " ", 1) != F.substring_index(p, " ", -1))


def grams(seq: Column, n: int) -> Column:
    """The runs of n terms."""

    def runs(s: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(s) - (n - 1)), lambda i: F.array_join(F.slice(s, i, n), " "))
        return F.when(F.size(s) >= n, each).otherwise(F.array().cast("array<string>"))

    return let(seq, runs)


def anchors(terms: Column) -> Column:
    """Of the content terms of a question those that carry it: with a digit, long, or capitalised; else any of four letters."""
    strong = lambda t: t["raw"].rlike("[0-9]") | (F.length(t["raw"]) >= 6) | t["raw"].rlike("^[A-Z]")
    some = lambda good: F.when(F.exists(good, strong), F.filter(good, strong)).otherwise(F.filter(good, lambda t: F.length(t["raw"]) >= 4))
    return F.array_distinct(F.transform(let(F.filter(terms, lambda t: ~t["term"].isin(NON_ANCHOR)), some), lambda t: t["term"]))


def constraints(terms: Column) -> Column:
    small = lambda t: ~t["term"].isin(NON_ANCHOR) & t["raw"].rlike("^[a-z]") & (F.length(t["term"]) >= 4)
    return F.array_distinct(F.transform(F.filter(terms, lambda t: t["raw"].rlike("[0-9]") | small(t)), lambda t: t["term"]))


def subjects(text: Column) -> Column:
    """Terms of capitalised words; a stop word that begins the text is none."""
    all_terms = F.transform(tokens(text), lambda r, i: F.struct(r.alias("raw"), i.alias("at"), stem(F.lower(r)).alias("stem")))
    named = F.filter(all_terms, lambda s: s["raw"].rlike("^[A-Z]") & ~((s["at"] == 0) & F.lower(s["raw"]).isin(STOPWORDS)))
    names = F.transform(named, lambda s: without_e(s["stem"]))
    return F.array_distinct(F.filter(names, lambda t: (F.length(t) > 1) & ~t.isin(STOPWORDS + NON_ANCHOR)))


def content(text: Column) -> Column:
    """raw and term of the tokens that are no stop words."""
    return F.filter(terms(F.coalesce(text, F.lit(""))), is_content)


# The suffix rules of stem() and without_e() on all tokens of a text at once. What a rule has changed ends with a mark, so
# that no other rule does; \x02 asks for a doubled last letter to go.
RULES = [
    (r"ies(?= |$)(?<=[a-z0-9]{6})", "y\x01"),
    (r"(?:ing(?= |$)(?<=[a-z0-9]{5})|ed(?= |$)(?<=[a-z0-9]{4}))", "\x02"),
    (r"([a-z0-9])\1\x02", "$1\x01"),
    (r"es(?= |$)(?<=[a-z0-9]{4})", "\x01"),
    (r"(?:s(?= |$)(?<=[a-z0-9]{4})|ion(?= |$)(?<=[a-z0-9]{6}))", "\x01"),
    (r"e(?=[ \x01\x02]|$)(?<=[a-z0-9]{6})", ""),
    (r"[\x01\x02]+", ""),
]


def normal(text: Column) -> Column:
    """The terms of a text with blanks between, stop words behind a mark. A regular expression reads a text far faster than an expression does each token."""
    t = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))
    t = F.regexp_replace(t, f"(?<![a-z0-9])(?=(?:{'|'.join(STOPWORDS)})(?: |$))", "\x03")
    for pattern, by in RULES:
        t = F.regexp_replace(t, pattern, by)
    return t


def full_terms(normal: Column) -> Column:
    """All terms of normal() in order; those under two letters are left out."""
    return F.filter(F.split(F.translate(normal, "\x03", ""), " "), lambda t: F.length(t) > 1)


def content_terms(normal: Column) -> Column:
    """Those that are no stop words, as they stand or as terms."""
    return F.filter(F.split(normal, " "), lambda t: (F.length(t) > 1) & ~t.startswith("\x03") & ~t.isin(STOPWORDS))


def sequence(text: Column) -> Column:
    """The content terms of a text in order."""
    return content_terms(normal(text))
