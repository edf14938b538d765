"""Sentences, clauses and spans of texts as columns, with the same as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as tx

TOKEN = "[A-Za-z0-9]+"


def sentences(text: Column) -> Column:
    """Parts that end with . ! or ? and white space. One that ends with a single letter (an initial), or is no more
    than one or two tokens of which any is a single letter, belongs to the next, the last one to the one before it."""
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s*\n+\s*", " ")
    parts = F.filter(F.transform(F.split(F.trim(flat), r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda x: x != "")

    def open_end(cur: Column) -> Column:
        return tx.let(F.regexp_extract_all(cur, F.lit(TOKEN), F.lit(0)), lambda t: ((F.size(t) > 0) & (F.length(F.element_at(t, -1)) == 1)) | ((F.size(t) <= 2) & F.exists(t, lambda w: F.length(w) == 1)))

    def step(state: Column, part: Column) -> Column:
        cur = F.when(state["held"] == "", part).otherwise(F.concat(state["held"], F.lit(" "), part))
        return tx.let(cur, lambda c: F.when(open_end(c), F.struct(state["out"].alias("out"), c.alias("held"))).otherwise(F.struct(F.concat(state["out"], F.array(c)).alias("out"), F.lit("").alias("held"))))

    def end(state: Column) -> Column:
        out, held = state["out"], state["held"]
        last = F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.concat(F.element_at(out, -1), F.lit(" "), held)))
        return F.when(held == "", out).when(F.size(out) > 0, last).otherwise(F.array(held))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("held"))
    return F.aggregate(parts, start, step, end)


def sentences_sql(p: str, table: str, key: str) -> str:
    """Recursive CTE p: key and sents, the sentences of each text that has any."""
    tokens = f"regexp_extract_all(cur, '{TOKEN}')"
    glued = f"((len({tokens}) > 0 AND length({tokens}[-1]) = 1) OR (len({tokens}) <= 2 AND len(list_filter({tokens}, lambda t: length(t) = 1)) > 0))"
    return rf"""{p}_raw AS (SELECT {key}, list_filter(list_transform(string_split(regexp_replace(trim(regexp_replace(coalesce(text, ''), '\s*\n+\s*', ' ', 'g')), '([.!?])\s+', '\1' || chr(31), 'g'), chr(31)), lambda x: trim(x)), lambda x: x <> '') AS parts FROM {table}),
{p}_walk AS (SELECT {key}, parts, 1 AS i, parts[1] AS cur FROM {p}_raw WHERE len(parts) > 0
  UNION ALL SELECT {key}, parts, i + 1, CASE WHEN {glued} THEN cur || ' ' || parts[i + 1] ELSE parts[i + 1] END FROM {p}_walk WHERE i < len(parts)),
{p}_out AS (SELECT {key}, coalesce(list(cur ORDER BY i) FILTER (NOT {glued}), CAST([] AS VARCHAR[])) AS s, max(cur) FILTER ({glued} AND i = len(parts)) AS held FROM {p}_walk GROUP BY 1),
{p} AS (SELECT {key}, CASE WHEN held IS NULL THEN s WHEN len(s) > 0 THEN list_append(s[1:len(s) - 1], s[-1] || ' ' || held) ELSE [held] END AS sents FROM {p}_out)"""


def clauses(text: Column) -> Column:
    """Parts after , ; or : and white space, or around but, while and then."""
    return F.filter(F.transform(F.split(text, r"(?<=[,;:])\s+|\s+(?i:but|while|then)\s+"), lambda x: F.regexp_replace(x, "^[ ,;:]+|[ ,;:]+$", "")), lambda x: x != "")


CLAUSES_SQL = r"list_filter(list_transform(string_split(regexp_replace(text, '([,;:])\s+|\s+(?i:but|while|then)\s+', '\1' || chr(31), 'g'), chr(31)), lambda x: regexp_replace(x, '^[ ,;:]+|[ ,;:]+$', '', 'g')), lambda x: x <> '')"


def spans(units: Column) -> Column:
    """Each unit, then each two and three neighbours joined."""
    def of(n: int):
        return lambda u: F.when(F.size(u) >= n, F.transform(F.sequence(F.lit(1), F.size(u) - (n - 1)), lambda i: F.array_join(F.slice(u, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return tx.let(units, lambda u: F.concat(*(of(n)(u) for n in (1, 2, 3))))


def spans_sql(units: str) -> str:
    each = lambda n: f"list_transform(range(1, len({units}) - {n - 2}), lambda i: array_to_string({units}[i:i + {n - 1}], ' '))"
    return f"list_concat({each(1)}, list_concat({each(2)}, {each(3)}))"


def excerpt(text: Column) -> Column:
    """An excerpt as it is shown: single blanks, none within %, ( and ), one after $, no separators at the ends."""
    t = tx.collapse(text)
    # The patterns of an excerpt's blanks.
    for pattern, by in ((r"\$\s+", r"\$ "), (r"\s+%", "%"), (r"\(\s+", "("), (r"\s+\)", ")"), (r"^[ ,;:]+|[ ,;:]+$", "")):
        t = F.regexp_replace(t, pattern, by)
    return t


EXCERPT_SQL = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '\$\s+', '$ ', 'g'), '\s+%', '%', 'g'), '\(\s+', '(', 'g'), '\s+\)', ')', 'g'), '^[ ,;:]+|[ ,;:]+$', '', 'g')"
