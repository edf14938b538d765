"""Figures in text: period headers, rows of values after a metric, and spans that say metric, period and value together."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.dialect import METRICS

# What counts as a period label, as a line of one value, and as a value within a line.
PERIOD = r"(?i)^(?:q[1-4]\s+[0-9]{4}|fy\s*[0-9]{4}|ttm|[0-9]{4})$"
VALUE_LINE = r"^(?:\$?\s*\(?[0-9][0-9,.\s]*\)?(?:\s*%|\s*[A-Za-z]+(?:\s+[A-Za-z]+)*)?|\([0-9][0-9,.\s]*\)\s*%?)$"
VALUE = r"(?:\(?[0-9]{1,3}\)?\s*%|\(?\$?\s*(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+\.[0-9]+|[0-9]{3,})\)?)"
MARKERS = ["cash flow", "net sales", "operating income", "employees", "q1", "q2", "q3", "q4", "ttm"]
NONE = "array<string>"


def header_start(lines: Column) -> Column:
    """Place (from 1) of the first of two period labels in a row that follow no other label; null if there are none."""
    at = F.sequence(F.lit(1), F.greatest(F.size(lines) - 1, F.lit(1)))
    label = lambda i: F.coalesce(F.get(lines, i - 1).rlike(PERIOD), F.lit(False))
    return F.array_min(F.filter(at, lambda i: label(i) & label(i + 1) & ~label(i - 1)))


def headers(lines: Column) -> Column:
    """The first run of two period labels or more; else an empty list."""

    def run(ls: Column) -> Column:
        def of(start: Column) -> Column:
            ends = F.filter(F.sequence(start, F.size(ls)), lambda i: ~F.get(ls, i - 1).rlike(PERIOD))
            end = F.coalesce(F.array_min(ends), F.size(ls) + 1)
            return F.when(start.isNull(), F.array().cast(NONE)).otherwise(F.slice(ls, start, end - start))

        return tx.let(header_start(ls), of)

    return tx.let(lines, run)


def after_headers(lines: Column) -> Column:
    """Place (from 0) of the first line after the headers, 0 if there are none."""
    return tx.let(header_start(lines), lambda s: F.when(s.isNull(), 0).otherwise(s - 1 + F.size(headers(lines))))


def metric_spans(lines: Column, heads: Column) -> Column:
    """Of each line that is followed by as many value lines as there are headers: the row, then metric, period and value of each."""

    def of(ls: Column, hs: Column, first: Column) -> Column:
        n = F.size(hs)
        row = lambda i: F.slice(ls, i + 2, n)
        is_row = lambda i: ~F.get(ls, i).rlike(VALUE_LINE) & (F.size(row(i)) == n) & F.forall(row(i), lambda v: v.rlike(VALUE_LINE))
        places = F.filter(F.sequence(F.lit(0), F.size(ls) - 1), lambda i: (i >= first) & is_row(i))
        said = lambda i: F.concat(
            F.array(F.concat_ws(" ", F.get(ls, i), F.array_join(row(i), " "))), F.zip_with(hs, row(i), lambda h, v: F.concat_ws(" ", F.get(ls, i), h, v))
        )
        return F.when((n >= 2) & (F.size(ls) > 0), F.flatten(F.transform(places, said))).otherwise(F.array().cast(NONE))

    return tx.let(lines, lambda ls: tx.let(heads, lambda hs: tx.let(after_headers(ls), lambda first: of(ls, hs, first))))


def flat_spans(lines: Column, heads: Column, metrics: list[str] = METRICS) -> Column:
    """The same of lines that have a metric and its values in one, or the values in the next."""

    def of(ls: Column, hs: Column) -> Column:
        n = F.size(hs)

        def line(i: Column, metric: str) -> Column:
            text = F.get(ls, i)
            at = F.locate(metric, F.lower(text))
            rest = F.substring(text, at + len(metric), F.length(text))
            own = F.transform(F.regexp_extract_all(rest, F.lit(VALUE), F.lit(0)), lambda v: F.trim(v))
            after = F.transform(F.regexp_extract_all(F.coalesce(F.get(ls, i + 1), F.lit("")), F.lit(VALUE), F.lit(0)), lambda v: F.trim(v))
            below = (F.size(own) < n) & (F.size(after) > 0)
            whole = F.trim(F.substring(text, at, F.length(text)))
            before = F.trim(F.substring(text, at, F.lit(len(metric)) + F.coalesce(F.regexp_instr(rest, F.lit(VALUE)), F.lit(0)) - 1))
            label = F.when(below | (F.size(own) == 0), whole).otherwise(before)
            values = F.slice(F.when(below, after).otherwise(own), F.lit(1), n)
            spans = F.concat(F.array(F.concat_ws(" ", label, F.array_join(values, " "))), F.zip_with(hs, values, lambda h, v: F.concat_ws(" ", label, h, v)))
            return F.when((at > 0) & (F.size(values) == n), spans).otherwise(F.array().cast(NONE))

        each = F.transform(F.sequence(F.lit(0), F.size(ls) - 1), lambda i: F.flatten(F.array(*(line(i, m) for m in metrics))))
        return F.when((n >= 2) & (F.size(ls) > 0), F.flatten(each)).otherwise(F.array().cast(NONE))

    return tx.let(lines, lambda ls: tx.let(heads, lambda hs: of(ls, hs)))


def is_numeric_block(lines: Column) -> Column:
    """Six lines or more, four with a digit, half of them short, two that name a metric or period."""
    count = lambda ls, f: F.size(F.filter(ls, f))
    short = lambda x: F.size(F.regexp_extract_all(x, F.lit("[A-Za-z0-9]+"), F.lit(0))) <= 8
    marked = lambda x: F.exists(F.array(*map(F.lit, MARKERS)), lambda m: F.contains(F.lower(x), m))
    return tx.let(lines, lambda ls: (F.size(ls) >= 6) & (count(ls, lambda x: x.rlike("[0-9]")) >= 4) & (count(ls, short) >= F.floor(F.size(ls) / 2)) & (count(ls, marked) >= 2))
