"""Scores of sentences and excerpts as evidence for a prompt: SQL on counts (see scores.py) and measures (see functions/dialect.py)."""

from __future__ import annotations

from ..functions.dialect import METRICS, Dialect
from .scores import PAIR, run_bonus, share

TYPE_BONUS = """(is_when * ((CASE WHEN date = 1 THEN 0.34 WHEN temporal = 1 THEN 0.06 ELSE 0.0 END) + 0.06 * year + (CASE WHEN month = 1 THEN 0.08 WHEN t_number = 1 THEN 0.04 ELSE 0.0 END))
  + is_many * (CASE WHEN t_large > 0 OR t_five = 1 THEN 0.22 WHEN t_number = 1 THEN 0.06 ELSE 0.0 END)
  + is_where * (0.12 * t_place + 0.08 * t_city) + 0.38 * is_nick * alias)"""
TYPE_PENALTY = """((CASE WHEN is_when = 1 AND date = 0 THEN (CASE WHEN temporal = 1 THEN 0.18 ELSE 0.24 END) ELSE 0.0 END)
  + (CASE WHEN is_many = 1 AND t_large = 0 AND t_five = 0 THEN 0.24 ELSE 0.0 END)
  + (CASE WHEN is_nick = 1 THEN 0.24 * (1 - alias) + (CASE WHEN qs > 0 AND ns = 0 THEN 0.28 ELSE 0.0 END) ELSE 0.0 END))"""
ANCHORS = f"(0.5 * {share('na', 'qa')} + (CASE WHEN qa > 0 THEN 0.1 * {share('na', 'dn')} ELSE 0.0 END))"
CONSTRAINTS = f"(0.45 * {share('nc', 'qc')} + 0.08 * {share('nc', 'dn')})"


def shared(d: Dialect) -> dict[str, str]:
    """What prompt and text measures have in common."""
    phrases = [m for m in METRICS if m != "operating cash flow"]
    own = lambda xs: d.keep(xs, f"x IN ({', '.join(repr(p) for p in phrases)})")
    return {
        "m_metrics": d.size(d.both("q_metrics", "t_metrics")),
        "m_conflict": d.size(d.less("t_metrics", "q_metrics")),
        "m_quarters": d.size(d.both("q_quarters", "t_quarters")),
        "m_years": d.size(d.both("q_years", "t_years")),
        "m_phrases": d.size(own(d.both("q_metrics", "t_metrics"))),
        "nq_quarters": d.size("q_quarters"),
        "nt_quarters": d.size("t_quarters"),
        "nq_metrics": d.size("q_metrics"),
        "nt_metrics": d.size("t_metrics"),
    }


EXACT_SPAN = "(dn BETWEEN 1 AND 16 AND t_digit = 1 AND nt_metrics = 1 AND (nt_quarters > 0 OR t_ttm = 1))"
EXACT = f"""(CASE WHEN q_exact = 0 OR m_metrics = 0 THEN 0.0 ELSE
  (CASE WHEN nq_quarters > 0 AND m_quarters = nq_quarters THEN 0.38 ELSE 0.0 END) + 0.1 * q_ttm * t_ttm + (CASE WHEN {EXACT_SPAN} THEN 0.16 ELSE 0.0 END)
  + (CASE WHEN t_large > 0 THEN 0.08 ELSE 0.0 END) - least(0.24, 0.12 * m_conflict) END)"""
ALIGNED = "(CASE WHEN m_metrics = 0 THEN 0.0 ELSE least(0.34, 0.24 * m_metrics) + 0.08 * q_numeric * t_digit END)"
TEMPORAL = "(CASE WHEN m_quarters = 0 THEN 0.0 ELSE least(0.18, 0.18 * m_quarters) + (CASE WHEN nt_quarters = m_quarters THEN 0.06 ELSE 0.0 END) END)"
NUMERIC_PENALTY = """(CASE WHEN q_numeric = 0 THEN 0.0 ELSE 0.22 * (1 - t_digit) + (CASE WHEN nq_metrics = 0 THEN 0.0 ELSE
  (CASE WHEN m_conflict = 0 THEN 0.0 WHEN m_metrics = 0 THEN 0.3 ELSE 0.16 END)
  + (CASE WHEN nq_quarters > 0 AND nt_quarters > nq_quarters THEN least(0.24, 0.08 * (nt_quarters - nq_quarters)) ELSE 0.0 END)
  + (CASE WHEN t_digit_tokens > 6 THEN least(0.5, 0.045 * (t_digit_tokens - 6)) ELSE 0.0 END) END) END)"""
#: near: question pairs that stand somewhere in the text's terms.
NUMERIC_BONUS = """(CASE WHEN q_numeric = 0 THEN 0.0 ELSE least(0.16, 0.03 * t_values) + least(0.08, 0.03 * t_currency) + q_percent * least(0.08, 0.04 * t_percent)
  + is_many * least(0.14, 0.03 * t_large) + (CASE WHEN q_quarterly = 1 AND t_large >= 6 THEN 0.16 ELSE 0.0 END) + 0.18 * m_phrases
  + least(0.12, 0.04 * near) + (CASE WHEN m_years > 0 THEN 0.06 ELSE 0.0 END) END)"""

_BASE = f"{share('n', 'qn')} + {ANCHORS} + {CONSTRAINTS} + 0.35 * {share('n', 'dn')} + 0.2 * phrase + {run_bonus(0.24)} + {PAIR} + {TYPE_BONUS} + 0.15 * greatest(ctx, 0.0) - 0.25 * meta - {TYPE_PENALTY}"
#: Of a sentence among all candidates, and of a sentence or excerpt for one facet. ctx: score of its context.
SENTENCE = f"({_BASE} + (CASE WHEN na > 0 THEN 0.1 ELSE 0.0 END) + (CASE WHEN nc > 0 THEN 0.08 ELSE 0.0 END))"
FACET = f"(CASE WHEN n = 0 THEN 0.0 ELSE {_BASE} + {NUMERIC_BONUS} + {ALIGNED} + {EXACT} + {TEMPORAL} - {NUMERIC_PENALTY} END)"


def required_anchors(n: str) -> str:
    return f"(CASE WHEN {n} <= 2 THEN {n} ELSE greatest(1, CAST(ceil({n} * 0.5) AS INT)) END)"


def required_constraints(n: str) -> str:
    return f"(CASE WHEN {n} = 0 THEN 0 WHEN {n} <= 2 THEN 1 WHEN {n} = 3 THEN 2 ELSE greatest(3, CAST(ceil({n} * 0.6) AS INT)) END)"


#: Whether a sentence may answer a facet at all.
GATE = f"""({FACET} >= 0.2 AND (nq_metrics = 0 OR m_metrics > 0)
  AND ((qa = 0 AND qc = 0) OR na >= {required_anchors('qa')} OR nc >= {required_constraints('qc')})
  AND NOT (meta >= 0.35 AND na < {required_anchors('qa')} AND nc < {required_constraints('qc')}))"""

#: Support of a facet by a set of terms (k: its terms, anchors and constraints together), with the weights of its three parts.
def facet_support(coverage: float, anchors: float, constraints: float) -> str:
    cov = share("m_all", "k_all")
    return f"least(1.0, {coverage} * {cov} + {anchors} * (CASE WHEN qa > 0 THEN {share('m_anchors', 'qa')} ELSE {cov} END) + {constraints} * (CASE WHEN qc > 0 THEN {share('m_constraints', 'qc')} ELSE {cov} END))"


COVERAGE = facet_support(0.45, 0.3, 0.25)
QUESTION_SUPPORT = facet_support(0.5, 0.3, 0.2)

#: Thresholds by the number of facets and the kind of question; strict: more than one facet, numbers, dates or constraints.
STRICT = "(facets > 1 OR q_numeric = 1 OR q_date = 1 OR any_constraints = 1)"
THRESHOLD = f"(CASE WHEN {STRICT} THEN 0.58 ELSE 0.45 END)"
CITATION_THRESHOLD = f"(CASE WHEN facets > 1 THEN least(0.84, {THRESHOLD} + 0.08) WHEN q_exact_value = 1 THEN least(0.8, {THRESHOLD} + 0.06) ELSE least(0.78, {THRESHOLD} + 0.04) END)"
FACET_THRESHOLD = f"(CASE WHEN facets > 1 THEN 0.52 WHEN q_exact_value = 1 THEN 0.62 WHEN {STRICT} THEN 0.48 ELSE 0.0 END)"
