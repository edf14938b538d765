"""The formulas, which both engines share, against values worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from inkwell.functions import text as tx
from inkwell.operators import evidence, scores

NONE = dict.fromkeys("n na nc np ns qn qa qc qp qs dn run phrase head meta date temporal year month alias is_when is_nick".split(), 0)


def value(spark, formula, **given):
    row = {k: float(v) if k in ("meta", "text_meta", "ctx", "hybrid", "rerank", "rarity") else v for k, v in (NONE | given).items()}
    return spark.createDataFrame([row]).select(F.expr(formula).cast("double")).first()[0]


COUNTS = dict(n=2, qn=4, dn=10, na=1, qa=2, nc=1, qc=4, np=1, qp=2, run=2)


def test_search(spark):
    base = 0.32 / 2 + 0.08 / 5 + 0.08 + 0.35 / 2 + 0.1 / 10 + 0.2 / 2 + 0.35 / 4 + 0.08 / 10
    assert value(spark, scores.LEXICAL, **COUNTS) == pytest.approx(base)
    assert value(spark, scores.LEXICAL, **COUNTS, phrase=1, head=1, meta=0.5) == pytest.approx(base + 0.15 + 0.1 - 0.09)
    assert value(spark, scores.LEXICAL, **COUNTS | {"run": 5}) == pytest.approx(base + 0.12)
    assert value(spark, scores.LEXICAL, **COUNTS, is_when=1, date=1, year=1, month=1) == pytest.approx(base + 0.32)
    assert value(spark, scores.LEXICAL, **COUNTS, is_when=1, temporal=1) == pytest.approx(base + 0.05)
    assert value(spark, scores.LEXICAL, **COUNTS, is_nick=1, alias=1, qs=1) == pytest.approx(base + 0.55 - 0.35)
    assert value(spark, scores.LEXICAL, phrase=1, qn=3, dn=5) == 0
    assert value(spark, scores.FOCUS, **COUNTS) == pytest.approx(0.45 / 2 + 0.4 / 4)
    assert value(spark, scores.FOCUS, qn=1, dn=1, na=1, qa=1, nc=1, qc=1, is_when=1, temporal=1, year=1, month=1) == 1
    assert value(spark, scores.RERANK, **COUNTS, phrase=1) == pytest.approx(0.2 + 0.02 + 0.11 + 0.005 + 0.23 / 4 + 0.005 + 0.1 + 0.15)
    assert value(spark, scores.RERANK, dn=3, is_nick=1, qs=1) == pytest.approx(-0.35)
    last = dict(hybrid=0.8, rerank=0.5, text_meta=0.4)
    assert value(spark, scores.FINAL, **COUNTS, **last) == pytest.approx(0.35 * 0.8 + 0.65 * 0.5 + 0.18 * base + 0.24 * 0.325 + 0.08 - 0.1)


def test_gates(spark):
    need = {n: [value(spark, f("n"), n=n) for f in (evidence.required_anchors, evidence.required_constraints)] for n in range(8)}
    assert [need[n][0] for n in range(8)] == [0, 1, 2, 2, 2, 3, 3, 4]
    assert [need[n][1] for n in range(8)] == [0, 1, 1, 2, 3, 3, 4, 5]
    kinds = dict(facets=1, q_numeric=0, q_date=0, any_constraints=0, q_exact_value=0)
    told = lambda **k: [round(value(spark, f, **kinds | k), 4) for f in (evidence.THRESHOLD, evidence.CITATION_THRESHOLD, evidence.FACET_THRESHOLD)]
    assert told() == [0.45, 0.49, 0.0]
    assert told(facets=2) == [0.58, 0.66, 0.52]
    assert told(q_numeric=1, q_exact_value=1) == [0.58, 0.64, 0.62]
    assert told(any_constraints=1) == [0.58, 0.62, 0.48]


def test_terms(spark):
    words = {"batteries": "battery", "dies": "di", "stopped": "stop", "calling": "cal", "red": "red", "seed": "se", "boxes": "box", "cars": "car", "bus": "bus", "mission": "miss", "ion": "ion", "storage": "storag", "these": "these", "classes": "class", "printed": "print", "caring": "car"}
    row = spark.createDataFrame([(" ".join(words),)], "t string").select(tx.full_terms(tx.normal(F.col("t"))).alias("a"), F.transform(tx.terms(F.col("t")), lambda x: x["term"]).alias("b")).first()
    assert row.a == row.b == list(words.values())
    mixed = spark.createDataFrame([("The notes of Ünder-age, a cat's x9 AND the Needs",)], "t string")
    assert mixed.select(tx.sequence(F.col("t"))).first()[0] == ["nder", "age", "cat", "x9"]


@pytest.mark.parametrize("places", [3, 4])
def test_numbers_in_texts_are_written_as_sql_writes_them(spark, places):
    """of a number halfway between two places, as it reads, the exact binary value decides."""
    import duckdb

    values = sorted({x for n in range(0, 20000, 7) for m in ((n + 0.5) / 10**places, round(n / 10**places + 0.5 / 10**places, 9)) for x in (m, math.nextafter(m, 0), math.nextafter(m, 99))} | {k / 32 for k in range(64)} | {0.0, 1e-9, 0.99999, 1.0, 12.34565})
    df = spark.createDataFrame([(v,) for v in values], "v double")
    made = [r[0] for r in df.select(tx.printed(F.col("v"), places)).collect()]
    assert made == [duckdb.execute(f"SELECT printf('%.{places}f', ?::DOUBLE)", [v]).fetchone()[0] for v in values]
    assert made != [r[0] for r in df.select(F.format_string(f"%.{places}f", "v")).collect()]
