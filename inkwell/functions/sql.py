"""The same functions as DuckDB SQL, for the oracle."""

from __future__ import annotations

from . import text as tx
from .text import METADATA, NON_ANCHOR, STOPWORDS


def words(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


STOP, PLAIN, META = words(STOPWORDS), words(NON_ANCHOR), words(METADATA)


def term(t: str) -> str:
    def single(x: str) -> str:
        return f"CASE WHEN length({x}) >= 2 AND right({x}, 1) = substr({x}, length({x}) - 1, 1) THEN substr({x}, 1, length({x}) - 1) ELSE {x} END"

    cut = lambda k: f"substr({t}, 1, length({t}) - {k})"
    stem = (
        f"(CASE WHEN length({t}) > 5 AND {t} LIKE '%ies' THEN {cut(3)} || 'y'"
        f" WHEN length({t}) > 4 AND {t} LIKE '%ing' THEN {single(cut(3))}"
        f" WHEN length({t}) > 3 AND {t} LIKE '%ed' THEN {single(cut(2))}"
        f" WHEN length({t}) > 3 AND {t} LIKE '%es' THEN {cut(2)}"
        f" WHEN length({t}) > 3 AND {t} LIKE '%s' THEN {cut(1)}"
        f" WHEN length({t}) > 5 AND {t} LIKE '%ion' THEN {cut(3)} ELSE {t} END)"
    )
    return f"CASE WHEN length({stem}) > 5 AND {stem} LIKE '%e' THEN substr({stem}, 1, length({stem}) - 1) ELSE {stem} END"


def occurrences(table: str, key: str) -> str:
    """key, pos, raw, term of every token of a table; terms under two letters are left out."""
    return f"""
      SELECT {key}, pos, raw, term FROM (
        SELECT {key}, pos, raw, {term('lower(raw)')} AS term FROM (
          SELECT {key}, unnest(toks) AS raw, generate_subscripts(toks, 1) AS pos
          FROM (SELECT {key}, regexp_extract_all(text, '[A-Za-z0-9]+') AS toks FROM {table})))
      WHERE length(term) > 1"""


def content(table: str, key: str) -> str:
    """Those that are no stop words, with their place among them."""
    return f"""
      SELECT {key}, raw, term, row_number() OVER (PARTITION BY {key} ORDER BY pos) AS pos
      FROM ({occurrences(table, key)}) WHERE lower(raw) NOT IN ({STOP}) AND term NOT IN ({STOP})"""


def anchors(source: str, key: str) -> str:
    """key, term of the anchors among content occurrences; else the fallback terms."""
    good = f"term NOT IN ({PLAIN})"
    strong = "(regexp_matches(raw, '[0-9]') OR length(raw) >= 6 OR regexp_matches(raw, '^[A-Z]'))"
    return f"""
      SELECT DISTINCT {key}, term FROM (
        SELECT {key}, term, {strong} AS strong, max(CASE WHEN {strong} THEN 1 ELSE 0 END) OVER (PARTITION BY {key}) AS n_strong, length(raw) AS n
        FROM ({source}) WHERE {good}) WHERE strong OR (n_strong = 0 AND n >= 4)"""


def constraints(source: str, key: str) -> str:
    return f"""
      SELECT DISTINCT {key}, term FROM ({source})
      WHERE regexp_matches(raw, '[0-9]') OR (term NOT IN ({PLAIN}) AND regexp_matches(raw, '^[a-z]') AND length(term) >= 4)"""


def subjects(table: str, key: str) -> str:
    return f"""
      SELECT DISTINCT {key}, term FROM ({occurrences(table, key)})
      WHERE regexp_matches(raw, '^[A-Z]') AND NOT (pos = 1 AND lower(raw) IN ({STOP})) AND term NOT IN ({STOP}) AND term NOT IN ({PLAIN})"""


def matches(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, '{pattern.replace(chr(39), chr(39) * 2)}')"


def flag(condition: str) -> str:
    return f"(CASE WHEN {condition} THEN 1 ELSE 0 END)"


def temporal(text: str) -> str:
    return f"({matches(text, tx.DATE_RE)} OR {matches(text, tx.TEMPORAL_RE)} OR {matches(text, tx.TIME_RE)})"


def alias(text: str) -> str:
    flat = rf"trim(regexp_replace({text}, '\s+', ' ', 'g'))"
    return f"({matches(flat, tx.ALIAS_RE)} OR ({matches(flat, tx.SELF_RE)} AND {matches(f'lower({flat})', tx.THE_RE)}))"


EMPTY = "CAST([] AS VARCHAR[])"


def sequences(p: str, table: str, key: str) -> str:
    """CTE p: key, text, full (all terms in order) and seq (content terms in order)."""
    return f"""{p}_f AS (SELECT {key}, list(term ORDER BY pos) AS l FROM ({occurrences(table, key)}) GROUP BY 1),
{p}_s AS (SELECT {key}, list(term ORDER BY pos) AS l FROM ({content(table, key)}) GROUP BY 1),
{p} AS (SELECT x.{key}, coalesce(x.text, '') AS text, coalesce({p}_f.l, {EMPTY}) AS full_terms, coalesce({p}_s.l, {EMPTY}) AS seq
  FROM {table} x LEFT JOIN {p}_f USING ({key}) LEFT JOIN {p}_s USING ({key}))"""


def pairs(seq: str) -> str:
    return f"list_distinct(list_transform(range(1, len({seq})), lambda i: {seq}[i] || ' ' || {seq}[i + 1]))"


def unequal(pairs: str) -> str:
    return f"list_filter({pairs}, lambda p: split_part(p, ' ', 1) <> split_part(p, ' ', 2))"


def grams(seq: str, n: int) -> str:
    return f"list_transform(range(1, len({seq}) - {n - 2}), lambda i: array_to_string({seq}[i:i + {n - 1}], ' '))"


def noise(full: str) -> str:
    m = f"len(list_filter({full}, lambda t: t IN ({META})))"
    return f"(CASE WHEN {m} = 0 THEN 0.0 ELSE least(1.0, {m} / len({full})::DOUBLE * 4 + CASE WHEN {m} >= 2 THEN 0.2 ELSE 0.0 END) END)"


def questions(table: str = "benchmark", p: str = "q") -> str:
    """CTE p: the features of each question; see retrieval.question_features."""
    source = content(table, "item_id")
    listed = lambda name, rows: f"{name} AS (SELECT item_id, list(term) AS l FROM ({rows}) GROUP BY 1)"
    return f"""{sequences(p + '0', table, 'item_id')},
{listed(p + 'a_', anchors(source, 'item_id'))}, {listed(p + 'c_', constraints(source, 'item_id'))}, {listed(p + 's_', subjects(table, 'item_id'))},
{p}1 AS (SELECT {p}0.item_id, {p}0.text AS q_text, seq AS q_seq, list_distinct(seq) AS q_terms, coalesce({p}a_.l, {EMPTY}) AS q_anchors, coalesce({p}c_.l, {EMPTY}) AS q_constraints,
  {unequal(pairs('seq'))} AS q_pairs, [{', '.join(grams('seq', n) for n in (2, 3, 4, 5))}] AS q_grams, array_to_string(full_terms, ' ') AS q_full, coalesce({p}s_.l, {EMPTY}) AS q_named,
  {flag(f"starts_with(lower({p}0.text), 'when ')")} AS is_when, {flag(f"contains(lower({p}0.text), 'nickname')")} AS is_nick
  FROM {p}0 LEFT JOIN {p}a_ USING (item_id) LEFT JOIN {p}c_ USING (item_id) LEFT JOIN {p}s_ USING (item_id)),
{p} AS (SELECT *, CASE WHEN len(q_named) > 0 THEN q_named ELSE q_anchors END AS q_subjects, len(q_terms) AS qn, len(q_anchors) AS qa, len(q_constraints) AS qc, len(q_pairs) AS qp, len(q_named) AS qs FROM {p}1)"""


def passages(table: str = "documents", p: str = "d") -> str:
    """CTE p: the features of each passage; see retrieval.passage_features."""
    return f"""{sequences(p + '0', table, 'doc_id')},
{p} AS (SELECT doc_id, text, seq, full_terms, list_distinct(seq) AS terms, len(list_distinct(seq)) AS dn, {pairs('seq')} AS d_pairs, array_to_string(seq, ' ') AS joined, array_to_string(full_terms, ' ') AS joined_full,
  {noise('full_terms')} AS meta, {noise('full_terms')} AS text_meta, 0 AS head, {flag(matches('text', tx.DATE_RE))} AS date, {flag(temporal('text'))} AS temporal, {flag(matches('text', tx.YEAR_RE))} AS year,
  {flag(matches('text', tx.MONTH_RE))} AS month, {flag(alias('text'))} AS alias_text FROM {p}0)"""


def counts(pairs: str) -> str:
    """pairs (a table with the columns of q and d) with what they share; see retrieval.pair_features."""
    met = lambda a, b: f"len(list_intersect({a}, {b}))"
    has = lambda n: f"len(q_grams[{n - 1}]) > 0 AND len(list_filter(q_grams[{n - 1}], lambda g: contains(joined, g))) > 0"
    return f"""SELECT *, CASE WHEN alias_text = 1 AND (len(q_subjects) = 0 OR ns > 0) THEN 1 ELSE 0 END AS alias FROM (
  SELECT *, {met('terms', 'q_terms')} AS n, {met('terms', 'q_anchors')} AS na, {met('terms', 'q_constraints')} AS nc, {met('d_pairs', 'q_pairs')} AS np, {met('full_terms', 'q_subjects')} AS ns,
    CASE WHEN {has(5)} THEN 5 WHEN {has(4)} THEN 4 WHEN {has(3)} THEN 3 WHEN {has(2)} THEN 2 ELSE 0 END AS run, {flag("q_full <> '' AND contains(joined_full, q_full)")} AS phrase FROM {pairs})"""


def embedding(table: str, key: str) -> str:
    """key, dim and weight of the hashing embedding."""
    return f"SELECT {key}, CAST(('0x' || substr(h, 1, 8))::UBIGINT % 128 AS BIGINT) AS dim, CAST(sum(CASE WHEN ('0x' || substr(h, 9, 2))::INT % 2 = 0 THEN 1 ELSE -1 END) AS BIGINT) AS weight FROM (SELECT {key}, sha256(unnest(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS h FROM {table}) GROUP BY 1, 2"
