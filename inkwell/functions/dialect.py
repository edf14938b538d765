"""Measures of prompts and texts as SQL that both engines read: what differs between them is spelled here."""

from __future__ import annotations

from dataclasses import dataclass

from . import text as tx

# The metric phrases of financial questions, the markers of causes, and patterns of numbers and places.
METRICS = ["net sales", "operating income", "free cash flow", "operating cash flow", "capital expenditures", "employees", "aws segment sales"]
NUMERIC_WORDS = ["percent", "sales", "income", "cash flow", "employees"]
CAUSES = ["because", "due to", "driven", "reflects", "resulted from", "as a result"]
QUARTER = r"\b[qQ][1-4]\s+[0-9]{4}\b"
LARGE = r"\b[0-9]{1,3}(?:,[0-9]{3})+\b"
VALUE = r"\$?[0-9][0-9,]*(?:\.[0-9]+)?%?"


@dataclass(frozen=True)
class Dialect:
    spark: bool

    def regex(self, p: str) -> str:
        return f'r"{p}"' if self.spark else "'" + p.replace("'", "''") + "'"

    def has(self, t: str, p: str) -> str:
        return f"({t} RLIKE {self.regex(p)})" if self.spark else f"regexp_matches({t}, {self.regex(p)})"

    def found(self, t: str, p: str) -> str:
        return f"regexp_extract_all({t}, {self.regex(p)}, 0)" if self.spark else f"regexp_extract_all({t}, {self.regex(p)})"

    def replace(self, t: str, p: str, by: str) -> str:
        """by: plain text, with $1 for the first group."""
        if self.spark:
            return f'regexp_replace({t}, {self.regex(p)}, r"{by}")'
        by = by.replace("\\$", "\0").replace("$1", "\\1").replace("\0", "$")
        return f"regexp_replace({t}, {self.regex(p)}, '{by}', 'g')"

    def size(self, x: str) -> str:
        return f"{'size' if self.spark else 'len'}({x})"

    def count(self, t: str, p: str) -> str:
        return self.size(self.found(t, p))

    def words(self, values: list[str]) -> str:
        inner = ", ".join(f"'{v}'" for v in values)
        return f"array({inner})" if self.spark else f"[{inner}]"

    def each(self, xs: str, body: str) -> str:
        return f"transform({xs}, x -> {body})" if self.spark else f"list_transform({xs}, lambda x: {body})"

    def keep(self, xs: str, body: str) -> str:
        return f"filter({xs}, x -> {body})" if self.spark else f"list_filter({xs}, lambda x: {body})"

    def both(self, a: str, b: str) -> str:
        return f"{'array' if self.spark else 'list'}_intersect({a}, {b})"

    def less(self, a: str, b: str) -> str:
        return f"array_except({a}, {b})" if self.spark else f"list_filter({a}, lambda x: NOT list_contains({b}, x))"

    def distinct(self, xs: str) -> str:
        return f"{'array' if self.spark else 'list'}_distinct({xs})"

    def flat(self, xs: str) -> str:
        return f"flatten({xs})"

    def any(self, t: str, values: list[str]) -> str:
        return "(" + " OR ".join(f"contains({t}, '{v}')" for v in values) + ")"

    def starts(self, t: str, values: list[str]) -> str:
        name = "startswith" if self.spark else "starts_with"
        return "(" + " OR ".join(f"{name}({t}, '{v}')" for v in values) + ")"

    def split(self, t: str, p: str) -> str:
        """The parts between matches; p has no group but maybe one first that stays with the part before it."""
        return f"split({t}, {self.regex(p)})" if self.spark else f"string_split_regex({t}, {self.regex(p)})"


SPARK, DUCK = Dialect(True), Dialect(False)


def flag(condition: str) -> str:
    return f"(CASE WHEN {condition} THEN 1 ELSE 0 END)"


def quarters(d: Dialect, t: str) -> str:
    return d.distinct(d.each(d.found(t, QUARTER), "lower(x)"))


def metrics(d: Dialect, t: str, phrases: list[str] = METRICS) -> str:
    return d.keep(d.words(phrases), f"contains(lower({t}), x)")


def ttm(t: str) -> str:
    return flag(f"contains(lower({t}), 'trailing twelve months') OR contains(lower({t}), 'ttm')")


def exact_metric(d: Dialect, q: str) -> str:
    return f"({d.any(f'lower({q})', METRICS)} AND {d.starts(f'trim(lower({q}))', ['what was', 'what were', 'how much', 'how many'])})"


def numeric_intent(d: Dialect, q: str) -> str:
    low = f"lower({q})"
    return f"({d.starts(low, ['how much', 'how many', 'how fast', 'what was', 'what were'])} OR {d.any(low, NUMERIC_WORDS)})"


def exact_value(d: Dialect, q: str) -> str:
    """Whether an answer must give an exact value."""
    return f"({d.starts(f'trim(lower({q}))', ['when ', 'how many', 'how much', 'how fast'])} OR {exact_metric(d, q)})"


def needs_many(d: Dialect, q: str) -> str:
    return d.any(f"lower({q})", [" and ", "both "])


def why(d: Dialect, q: str) -> str:
    return f"({d.starts(f'lower({q})', ['why '])} OR contains(lower({q}), ' why '))"


def prompt_measures(d: Dialect, q: str = "q_text") -> dict[str, str]:
    low = f"lower({q})"
    return {
        "q_numeric": flag(numeric_intent(d, q)),
        "q_metrics": metrics(d, q),
        "q_exact": flag(exact_metric(d, q)),
        "q_exact_value": flag(exact_value(d, q)),
        "q_quarters": quarters(d, q),
        "q_ttm": ttm(q),
        "q_years": d.distinct(d.found(q, r"\b[0-9]{4}\b")),
        "is_many": flag(d.starts(low, ["how many"])),
        "is_where": flag(d.starts(low, ["where "])),
        "is_why": flag(why(d, q)),
        "q_multi": flag(needs_many(d, q)),
        "q_probe": flag(f"contains({low}, ' say about ') OR {d.starts(low, ['about '])}"),
        "q_date": flag(d.has(q, tx.DATE_RE)),
        "q_percent": flag(d.any(low, ["percent", "how fast"])),
        "q_quarterly": flag(d.any(low, ["q1", "q2", "q3", "q4", "quarter"])),
    }


def text_measures(d: Dialect, t: str = "t_text") -> dict[str, str]:
    return {
        "t_metrics": metrics(d, t),
        "t_quarters": quarters(d, t),
        "t_ttm": ttm(t),
        "t_digit": flag(d.has(t, "[0-9]")),
        "t_large": d.count(t, LARGE),
        "t_five": flag(d.has(t, r"\b[0-9]{5,}\b")),
        "t_number": flag(d.has(t, r"\b[0-9]+\b")),
        "t_values": d.count(t, r"\$?[0-9][0-9,.]*%?"),
        "t_currency": d.count(t, r"\$\s*[0-9][0-9,.]*"),
        "t_percent": d.count(t, r"[0-9][0-9,.]*\s*%"),
        "t_years": d.distinct(d.found(t, r"\b[0-9]{4}\b")),
        "t_digit_tokens": d.count(t, "[A-Za-z]*[0-9][A-Za-z0-9]*"),
        "t_place": flag(d.has(t, r"\b(?:in|at|from|to|toward|towards|near|into|onto)\s+[A-Z]")),
        "t_city": flag(d.has(t, r"\b[A-Z][a-z]+,\s+[A-Z][a-z]+\b")),
    }
