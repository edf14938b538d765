"""More queries: predicates, spans, paragraphs, vectors and evaluation summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sql
from ..functions import text as tx
from ..functions.dialect import METRICS
from ..operators import chunks, evidence
from .registry import per_doc, query

per_doc(
    "tx22_metric_phrases",
    lambda t: F.array_join(F.filter(F.array(*map(F.lit, METRICS)), lambda m: F.contains(F.lower(t), m)), ","),
    f"coalesce(array_to_string(list_filter([{sql.words(METRICS)}], lambda m: contains(lower(text), m)), ','), '')",
)


@query(
    "gr01_paragraphs",
    r"""SELECT doc_id, start, "end", text FROM (
      SELECT doc_id, regexp_replace(b, '^\s+|\s+$', '', 'g') AS text, lead_n + length(b) - length(regexp_replace(b, '^\s+', '')) AS start, lead_n + length(regexp_replace(b, '\s+$', '')) AS "end" FROM (
        SELECT doc_id, b, CAST(sum(length(b) + 2) OVER (PARTITION BY doc_id ORDER BY i) - length(b) - 2 AS BIGINT) AS lead_n FROM (
          SELECT doc_id, unnest(x) AS b, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)) AS x FROM documents))))
    WHERE text <> ''""",
    "documents",
)
def _(d):
    # The tables have no empty lines: each line counts as a paragraph.
    spaced = d.select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return chunks.blocks(spaced, ["doc_id"], "text").select("doc_id", "start", "end", "text")


SIGNATURE_SQL = r"""SELECT conv_id, turn, CASE WHEN f = '' OR length(f) > 90 OR len(string_split(f, ' ')) > 12 OR regexp_matches(f, '^\p{Ll}') OR (regexp_matches(f, '[.!?]$') AND len(string_split(f, ' ')) >= 5) THEN NULL
  ELSE trim(regexp_replace(regexp_replace(regexp_replace(lower(f), '[0-9]', '#', 'g'), '[^a-z0-9# ]', ' ', 'g'), ' +', ' ', 'g')) END AS signature
  FROM (SELECT conv_id, turn, trim(regexp_replace(string_split(text, chr(10))[1], '[ \t]+', ' ', 'g')) AS f FROM conversations)"""


@query("tx16_boundary_signature", SIGNATURE_SQL, "conversations")
def _(c):
    return c.select("conv_id", "turn", chunks.signature(F.get(F.split("text", "\n"), F.lit(0))).alias("signature"))


CONTENT = sql.content("benchmark", "item_id")


@query("tx24_term_subsets", f"SELECT item_id, count(DISTINCT term) FILTER (length(term) >= 6) AS long_terms, count(DISTINCT term) FILTER (length(term) >= 5 OR regexp_matches(term, '[0-9]')) AS distinctive FROM ({CONTENT}) GROUP BY 1", "benchmark")
def _(b):
    t = b.select("item_id", F.array_distinct(tx.sequence(F.col("text"))).alias("t")).filter(F.size("t") > 0)
    picked = lambda f: F.size(F.filter("t", f)).cast("long")
    return t.select("item_id", picked(lambda x: F.length(x) >= 6).alias("long_terms"), picked(lambda x: (F.length(x) >= 5) | x.rlike("[0-9]")).alias("distinctive"))


@query(
    "flt13_required_matches",
    f"""SELECT b.item_id, CAST(CASE WHEN coalesce(a.n, 0) <= 2 THEN coalesce(a.n, 0) ELSE greatest(1, ceil(a.n / 2.0)) END AS BIGINT) AS anchors,
      CAST(CASE WHEN coalesce(c.n, 0) = 0 THEN 0 WHEN c.n <= 2 THEN 1 WHEN c.n = 3 THEN 2 ELSE greatest(3, ceil(c.n * 0.6)) END AS BIGINT) AS constraints
      FROM benchmark b LEFT JOIN (SELECT item_id, count(*) AS n FROM ({sql.anchors(CONTENT, 'item_id')}) GROUP BY 1) a USING (item_id)
      LEFT JOIN (SELECT item_id, count(*) AS n FROM ({sql.constraints(CONTENT, 'item_id')}) GROUP BY 1) c USING (item_id)""",
    "benchmark",
)
def _(b):
    c = b.select("item_id", tx.content(F.col("text")).alias("c"))
    n = c.select("item_id", F.size(tx.anchors(F.col("c"))).alias("qa"), F.size(tx.constraints(F.col("c"))).alias("qc"))
    return n.select("item_id", F.expr(evidence.required_anchors("qa")).cast("long").alias("anchors"), F.expr(evidence.required_constraints("qc")).cast("long").alias("constraints"))


RATES = "SELECT doc_id % 2 AS run, avg(quality::DOUBLE) AS quality_rate, avg(1.0 - toxic) AS clean_rate FROM labels GROUP BY 1"
