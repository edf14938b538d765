"""The scoring formulas, as SQL expressions on the counts of a question and a passage.

n, na, nc, np: terms, anchors, constraints and neighbouring pairs of the question
that the passage has; qn, qa, qc, qp: how many the question has; dn: different
terms of the passage; run: longest run of question terms in it; phrase: the
whole question is in it; head: a question term is in its heading; meta: its
metadata noise; date, temporal, year, month, alias: flags of its text;
is_when, is_nick: kinds of question; qs, ns: named subjects and those it has.
"""

from __future__ import annotations

import numpy as np

from ..config import Settings


def share(a: str, b: str) -> str:
    return f"(CASE WHEN {b} > 0 THEN {a} / CAST({b} AS DOUBLE) ELSE 0.0 END)"


def run_bonus(most: float) -> str:
    return f"least({most}, greatest(0, run - 1) * 0.08)"


PAIR = f"0.2 * {share('np', 'qp')}"
PENALTY = "(CASE WHEN is_nick = 1 AND qs > 0 AND ns = 0 THEN 0.35 ELSE 0.0 END)"


def intent(date: float, temporal: float, alias: float, most: float, both: float = 0.0) -> str:
    """What a "when" or nickname question adds for a text that has a date or an alias."""
    extra = f" + (CASE WHEN year = 1 AND month = 1 THEN {both} ELSE 0.0 END)" if both else ""
    when = f"(CASE WHEN is_when = 0 THEN 0.0 WHEN date = 1 THEN {date}{extra} WHEN temporal = 1 THEN {temporal} ELSE 0.0 END)"
    return f"least({most}, {when} + (CASE WHEN is_nick = 1 AND alias = 1 THEN {alias} ELSE 0.0 END))"


INTENT = intent(0.24, 0.05, 0.55, 0.7, both=0.08)

#: Overlap of a question and a passage.
LEXICAL = f"""(CASE WHEN n = 0 THEN 0.0 ELSE greatest(0.0,
  0.32 * {share('n', 'qn')} + 0.08 * {share('n', 'dn')} + 0.15 * phrase + {run_bonus(0.2)} + 0.1 * head
  + 0.35 * {share('na', 'qa')} + 0.1 * {share('na', 'dn')} + {PAIR}
  + 0.35 * {share('nc', 'qc')} + 0.08 * {share('nc', 'dn')} + {INTENT} - {PENALTY} - 0.18 * meta) END)"""


def lexical_near(c: dict[str, np.ndarray]) -> np.ndarray:
    """LEXICAL for arrays of counts, to well within 1e-6: tasks leave out by it what can't be among the best. What stays is scored by LEXICAL itself."""
    share = lambda a, b: np.divide(c[a], c[b], out=np.zeros(c["n"].shape), where=np.broadcast_to(c[b] > 0, c["n"].shape))
    when = np.where(c["date"] > 0, 0.24 + 0.08 * (c["year"] * c["month"]), 0.05 * c["temporal"])
    intent = np.minimum(0.7, c["is_when"] * when + 0.55 * (c["is_nick"] * c["alias"]))
    penalty = 0.35 * ((c["is_nick"] > 0) & (c["qs"] > 0) & (c["ns"] == 0))
    own = 0.32 * share("n", "qn") + 0.08 * share("n", "dn") + 0.15 * c["phrase"] + np.minimum(0.2, 0.08 * np.maximum(0, c["run"] - 1)) + 0.1 * c["head"]
    own += 0.35 * share("na", "qa") + 0.1 * share("na", "dn") + 0.2 * share("np", "qp") + 0.35 * share("nc", "qc") + 0.08 * share("nc", "dn")
    return np.where(c["n"] > 0, np.maximum(0.0, own + intent - penalty - 0.18 * c["meta"]), 0.0)


#: How well the anchors and constraints are met.
FOCUS = f"""(CASE WHEN qn = 0 OR dn = 0 THEN 0.0 ELSE least(1.0,
  0.45 * {share('na', 'qa')} + 0.4 * {share('nc', 'qc')}
  + (CASE WHEN qa > 0 AND na = qa THEN 0.08 ELSE 0.0 END) + (CASE WHEN qc > 0 AND nc = qc THEN 0.1 ELSE 0.0 END)
  + is_when * (0.1 * temporal + 0.08 * year + 0.1 * month)) END)"""

#: Score of the token-overlap reranker; it may be below zero.
RERANK = f"""(CASE WHEN dn = 0 THEN 0.0 ELSE
  0.4 * {share('n', 'qn')} + 0.1 * {share('n', 'dn')} + 0.22 * {share('na', 'qa')} + 0.05 * {share('na', 'dn')}
  + 0.23 * {share('nc', 'qc')} + 0.05 * {share('nc', 'dn')} + {PAIR} + 0.15 * phrase + {intent(0.22, 0.05, 0.45, 0.5)} - {PENALTY} END)"""

DEFAULTS = Settings()
K, DENSE_WEIGHT, LEXICAL_WEIGHT = DEFAULTS.rrf_k, DEFAULTS.dense_weight, DEFAULTS.lexical_weight


def reciprocal(rank: str, weight: float, k: int = K) -> str:
    return f"coalesce(CAST({weight} AS DOUBLE) / ({k} + {rank}), CAST(0.0 AS DOUBLE))"


def fused(s: Settings = DEFAULTS) -> str:
    """Fused score before it is divided by the question's largest; rarity: see retrieval.rarity."""
    return f"""greatest(0.0, {reciprocal('dense_rank', s.dense_weight, s.rrf_k)} + {reciprocal('lexical_rank', s.lexical_weight, s.rrf_k)}
  + 0.3 * least(1.0, {LEXICAL}) + 0.28 * {FOCUS} + 0.25 * rarity + {run_bonus(0.2)} - {PENALTY} - 0.3 * text_meta)"""


def final(s: Settings = DEFAULTS) -> str:
    """The last score. What the penalty would take off can't lower it: it is only another lower bound."""
    return f"""greatest(0.0, {round(1 - s.rerank_weight, 9)} * hybrid + {s.rerank_weight} * rerank
  + 0.18 * least(1.0, {LEXICAL}) + 0.24 * {FOCUS} + 0.22 * {INTENT} + {run_bonus(0.16)} - 0.25 * text_meta, -{PENALTY})"""


FUSED, FINAL = fused(), final()
