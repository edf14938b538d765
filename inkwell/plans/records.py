"""Queries on uploads, jobs, evaluation results, tables in text and what answers are made of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import sentences as st
from ..functions import sql
from ..functions import text as tx
from ..functions.dialect import DUCK
from ..operators import chunks, evaluation, events, tables
from ..sources import uploads
from .answers import CELLS, cells
from .evidence import CONTEXTS, SPANS, TURNS, contexts, spans, turns
from .registry import per_doc, query

per_doc("flt04_temporal_marker", tx.has_temporal, sql.temporal("text"))

LETTERED = r"list_filter(string_split_regex(x, '\s+'), lambda w: regexp_matches(w, '\p{L}'))"
HEADING = (
    r"NOT regexp_matches(x, '[.!?]$') AND len(string_split_regex(x, '\s+')) <= 12 AND len(@L) > 0 AND len(list_filter(@L, lambda w: NOT (regexp_matches(w, '\p{Ll}') AND NOT regexp_matches(w, '\p{Lu}')))) > 0"
    r" AND len(list_filter(@L, lambda w: regexp_matches(w, '^\p{Lu}') OR (regexp_matches(w, '\p{Lu}') AND NOT regexp_matches(w, '\p{Ll}')) OR regexp_matches(w, '[0-9]'))) >= len(@L) * 0.6"
).replace("@L", LETTERED)
LINE_LIST = r"list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"
per_doc("flt07_heading_lines", lambda t: F.size(F.filter(F.split(t, "\n"), lambda x: (F.trim(x) != "") & chunks.is_heading(x))).cast("long"), f"len(list_filter({LINE_LIST}, lambda x: {HEADING}))")

# Uploads: pages as files, some with the ending, first bytes or type of a PDF.
FILES = "files AS (SELECT page_id, url || CASE page_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PDF' ELSE '' END AS path, CASE WHEN page_id % 4 = 3 THEN '' ELSE '%PDF-' END || html AS body, CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'application/octet-stream' WHEN 2 THEN 'text/html' ELSE 'application/pdf' END AS type FROM pages)"
STORED = "CASE WHEN b = '' THEN 'document.pdf' WHEN lower(b) LIKE '%.pdf' THEN b ELSE b || '.pdf' END"


def files(p: DataFrame) -> DataFrame:
    n = F.col("page_id")
    ending = F.when(n % 3 == 0, ".pdf").when(n % 3 == 1, ".PDF").otherwise("")
    body = F.concat(F.when(n % 4 == 3, "").otherwise("%PDF-"), "html")
    kind = F.when(n % 5 == 1, "application/octet-stream").when(n % 5 == 2, "text/html").when(n % 5 > 2, "application/pdf")
    return p.select("page_id", F.concat("url", ending).alias("path"), F.encode(body, "UTF-8").alias("content"), kind.alias("content_type")).withColumn("length", F.octet_length("content"))


@query("src02_upload_checks", f"""WITH {FILES} SELECT page_id, sha256(body) AS sha256, substr(sha256(body), 1, 12) || '-' || {STORED} AS stored_name,
  CASE WHEN lower(path) NOT LIKE '%.pdf' THEN 'extension' WHEN type = 'text/html' THEN 'type' WHEN strlen(body) > 1048576 * 0.002 THEN 'size' WHEN body NOT LIKE '\\%PDF-%' ESCAPE '\\' THEN 'content' END AS error
  FROM (SELECT *, regexp_replace(trim(list_extract(string_split(path, '/'), -1)), '[^A-Za-z0-9._-]+', '-', 'g') AS b FROM files)""", "pages")
def _(p):
    return uploads.register(files(p), limit_mb=0.002, keep=["page_id"]).select("page_id", "sha256", "stored_name", "error")


@query("src03_filename", f"SELECT page_id, {STORED} AS filename FROM (SELECT page_id, regexp_replace(trim(list_extract(string_split(url, '/'), -1)), '[^A-Za-z0-9._-]+', '-', 'g') AS b FROM pages)", "pages")
def _(p):
    return p.select("page_id", uploads.filename(F.col("url")).alias("filename"))


@query("src05_document_list", "SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS place FROM documents JOIN labels USING (doc_id) WHERE toxic = 0", "documents", "labels")
def _(d, lab):
    """Ready documents of each owner, the largest (in place of the latest) first."""
    ready = d.select("doc_id", "source", "n_chars").join(lab.filter("toxic = 0").select("doc_id"), "doc_id")
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    return ready.select("doc_id", "source", place.alias("place"))


@query("src06_cascade_delete", """WITH gone AS (SELECT doc_id AS id FROM labels WHERE toxic = 1)
  SELECT 'documents' AS kind, doc_id AS id, count(*) AS rows FROM documents WHERE doc_id NOT IN (SELECT id FROM gone) GROUP BY 2 UNION ALL SELECT 'pages', conv_id, count(*) FROM conversations WHERE conv_id NOT IN (SELECT id FROM gone) GROUP BY 2
  UNION ALL SELECT 'chunks', vec_id, count(*) FROM embeddings WHERE vec_id NOT IN (SELECT id FROM gone) GROUP BY 2 UNION ALL SELECT 'jobs', user_id, count(*) FROM events WHERE user_id NOT IN (SELECT id FROM gone) GROUP BY 2""", "documents", "conversations", "embeddings", "events", "labels")
def _(d, c, v, e, lab):
    """What is left of a document's row, pages, chunks and jobs when the documents rated toxic go."""
    gone = lab.filter("toxic = 1").select(F.col("doc_id").alias("id"))
    own = {"documents": d.select(F.col("doc_id").alias("id")), "pages": c.select(F.col("conv_id").alias("id")), "chunks": v.select(F.col("vec_id").alias("id")), "jobs": e.select(F.col("user_id").alias("id"))}
    left = [t.join(gone, "id", "left_anti").groupBy("id").agg(F.count("*").alias("rows")).select(F.lit(k).alias("kind"), "id", "rows") for k, t in own.items()]
    return left[0].unionByName(left[1]).unionByName(left[2]).unionByName(left[3])


@query("src08_reprocess", "SELECT conv_id, turn, text, 1 AS batch FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) UNION ALL SELECT conv_id, turn, 'again: ' || text, 2 FROM conversations WHERE conv_id IN (SELECT doc_id FROM labels WHERE quality = 0)", "conversations", "labels")
def _(c, lab):
    """A second run of some documents replaces all their rows."""
    again = lab.filter("quality = 0").select(F.col("doc_id").alias("conv_id"))
    old = c.select("conv_id", "turn", "text", F.lit(1).alias("batch"))
    new = c.join(again, "conv_id", "left_semi").select("conv_id", "turn", F.concat(F.lit("again: "), "text").alias("text"), F.lit(2).alias("batch"))
    return old.join(new.select("conv_id").distinct(), "conv_id", "left_anti").unionByName(new)


@query("src09_failures", "SELECT doc_id, CASE WHEN error IS NULL THEN 'ready' ELSE 'failed' END AS status, error FROM (SELECT doc_id, CASE WHEN trim(text) = '' THEN 'PDF extraction failed.' WHEN len(regexp_extract_all(lower(text), '[a-z0-9]+')) < 2 THEN 'Embedding generation failed.' END AS error FROM documents)", "documents")
def _(d):
    return evaluation.ingested(d, "text", least_tokens=2).select("doc_id", "status", "error")


# Tables in text: figures of suppliers, set as lines, in one line, or without headers.
TABLES = """tabs AS (SELECT s_suppkey AS doc_id, s_nationkey AS document, s_suppkey % 3 + 1 AS page_start, s_suppkey % 3 + 1 + s_suppkey % 2 AS page_end,
  CASE s_suppkey % 4 WHEN 3 THEN '' ELSE 'Figures' || chr(10) || 'Q1 2024' || chr(10) || 'Q2 2024' || chr(10) END ||
  CASE s_suppkey % 4 WHEN 1 THEN 'Net sales were $' || s_suppkey || ',100 and ' || s_suppkey || ',200' || chr(10) || 'Operating income' || chr(10) || '1,' || (s_suppkey + 100) || ' 2,' || (s_suppkey + 100)
    ELSE 'net sales' || chr(10) || '$' || s_suppkey || ',000' || chr(10) || '(1,' || (s_suppkey + 100) || ')' || chr(10) || 'employees' || chr(10) || s_suppkey || '%' || chr(10) || s_suppkey || ' people' || chr(10) || 'a remark' END AS text FROM supplier)"""


def figures(s: DataFrame) -> DataFrame:
    k, n = F.col("s_suppkey"), F.lit("\n")
    text = lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs))
    heads = F.when(k % 4 == 3, "").otherwise("Figures\nQ1 2024\nQ2 2024\n")
    flat = text("Net sales were $", k, ",100 and ", k, ",200\nOperating income\n1,", k + 100, " 2,", k + 100)
    rows = text("net sales\n$", k, ",000\n(1,", k + 100, ")\nemployees\n", k, "%\n", k, " people\na remark")
    page = k % 3 + 1
    return s.select(k.alias("doc_id"), F.col("s_nationkey").alias("document"), page.alias("page_start"), (page + k % 2).alias("page_end"), F.concat(heads, F.when(k % 4 == 1, flat).otherwise(rows)).alias("text"))


LINES = f"tl AS (SELECT doc_id, document, page_start, page_end, {CELLS} AS l FROM tabs)"
P, V = tables.PERIOD, tables.VALUE_LINE
HEADS = f"""hs AS (SELECT *, list_filter(range(1, len(l)), lambda i: regexp_matches(l[i], '{P}') AND regexp_matches(l[i + 1], '{P}') AND (i = 1 OR NOT regexp_matches(l[i - 1], '{P}')))[1] AS s FROM tl),
he AS (SELECT *, CASE WHEN s IS NULL THEN CAST([] AS VARCHAR[]) ELSE l[s:coalesce(list_filter(range(s, len(l) + 1), lambda i: NOT regexp_matches(l[i], '{P}'))[1], len(l) + 1) - 1] END AS h FROM hs)"""


@query("tx21_period_headers", f"WITH {TABLES}, {LINES}, {HEADS} SELECT doc_id, array_to_string(h, '|') AS headers FROM he", "supplier")
def _(s):
    return figures(s).select("doc_id", F.array_join(tables.headers(cells(F.col("text"))), "|").alias("headers"))


@query("flt09_numeric_block", f"WITH {TABLES}, {LINES} SELECT doc_id, len(l) >= 6 AND len(list_filter(l, lambda x: regexp_matches(x, '[0-9]'))) >= 4 AND len(list_filter(l, lambda x: len(regexp_extract_all(x, '[A-Za-z0-9]+')) <= 8)) >= len(l) // 2 AND len(list_filter(l, lambda x: {DUCK.any('lower(x)', tables.MARKERS)})) >= 2 AS block FROM tl", "supplier")
def _(s):
    return figures(s).select("doc_id", tables.is_numeric_block(cells(F.col("text"))).alias("block"))


@query("gr06_metric_spans", f"""WITH {TABLES}, {LINES}, {HEADS}, r AS (SELECT doc_id, l, h, unnest(range(coalesce(s - 1 + len(h), 0) + 1, len(l) + 1)) AS i FROM he WHERE len(h) >= 2),
  ok AS (SELECT doc_id, l[i] AS m, h, l[i + 1:i + len(h)] AS v FROM r WHERE NOT regexp_matches(l[i], '{V}') AND len(l[i + 1:i + len(h)]) = len(h) AND len(list_filter(l[i + 1:i + len(h)], lambda x: NOT regexp_matches(x, '{V}'))) = 0)
  SELECT doc_id, m || ' ' || array_to_string(v, ' ') AS span FROM ok UNION ALL SELECT doc_id, m || ' ' || unnest(h) || ' ' || unnest(v) FROM ok""", "supplier")
def _(s):
    lines = figures(s).select("doc_id", cells(F.col("text")).alias("l"))
    return lines.select("doc_id", F.explode(tables.metric_spans(F.col("l"), tables.headers(F.col("l")))).alias("span"))


FLAT_SQL = " UNION ALL ".join(
    f"SELECT doc_id, i, {k} AS k, l, h, strpos(lower(l[i]), '{m}') AS spot, substr(l[i], strpos(lower(l[i]), '{m}') + {len(m)}) AS rest, {len(m)} AS n FROM li WHERE strpos(lower(l[i]), '{m}') > 0" for k, m in enumerate(tables.METRICS)
)


@query("gr06_flat_spans", f"""WITH {TABLES}, {LINES}, {HEADS}, li AS (SELECT doc_id, l, h, unnest(range(1, len(l) + 1)) AS i FROM he WHERE len(h) >= 2), fm AS ({FLAT_SQL}),
  fv AS (SELECT *, list_transform(regexp_extract_all(rest, '{tables.VALUE}'), lambda x: trim(x)) AS own, list_transform(regexp_extract_all(coalesce(l[i + 1], ''), '{tables.VALUE}'), lambda x: trim(x)) AS below FROM fm),
  fl AS (SELECT doc_id, h, CASE WHEN (len(own) < len(h) AND len(below) > 0) OR len(own) = 0 THEN trim(substr(l[i], spot)) ELSE trim(substr(l[i], spot, n + strpos(rest, regexp_extract(rest, '{tables.VALUE}')) - 1)) END AS label,
    CASE WHEN len(own) < len(h) AND len(below) > 0 THEN below ELSE own END[1:len(h)] AS v FROM fv)
  SELECT doc_id, label || ' ' || array_to_string(v, ' ') AS span FROM fl WHERE len(v) = len(h) UNION ALL SELECT doc_id, label || ' ' || unnest(h) || ' ' || unnest(v) FROM fl WHERE len(v) = len(h)""", "supplier")
def _(s):
    lines = figures(s).select("doc_id", cells(F.col("text")).alias("l"))
    return lines.select("doc_id", F.explode(tables.flat_spans(F.col("l"), tables.headers(F.col("l")))).alias("span"))


@query("jn06_page_headers", f"""WITH {TABLES}, {LINES}, {HEADS}, pg AS (SELECT document, unnest(range(page_start, page_end + 1)) AS page, doc_id, h FROM he WHERE len(h) >= 2), f AS (SELECT document, page, arg_min(h, doc_id) AS h FROM pg GROUP BY 1, 2),
  x AS (SELECT doc_id, document, unnest(range(page_start, page_end + 1)) AS page FROM he) SELECT doc_id, array_to_string(arg_min(f.h, page), '|') AS headers, min(page) AS page FROM x JOIN f USING (document, page) GROUP BY 1""", "supplier")
def _(s):
    """The headers of the first page of each context that has any: of the first context there that says them."""
    t = figures(s).select("doc_id", "document", "page_start", "page_end", tables.headers(cells(F.col("text"))).alias("h"))
    on = t.select("doc_id", "document", "h", F.explode(F.sequence("page_start", "page_end")).alias("page"))
    said = on.filter(F.size("h") >= 2).groupBy("document", "page").agg(F.min_by("h", "doc_id").alias("said"))
    return on.join(said, ["document", "page"]).groupBy("doc_id").agg(F.array_join(F.min_by("said", "page"), "|").alias("headers"), F.min("page").alias("page"))


# Pages with headers and footers: the turns of a conversation under the same lines.
PAGES = "sheets AS (SELECT conv_id AS document_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS page_number, 'Volume ' || conv_id || chr(10) || 'Harbour Notes' || chr(10) || text || chr(10) || 'Page ' || (turn + 1) AS raw_text FROM conversations)"


def sheets(c: DataFrame) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    text = F.concat(F.lit("Volume "), F.col("conv_id").cast("string"), F.lit("\nHarbour Notes\n"), "text", F.lit("\nPage "), (F.col("turn") + 1).cast("string"))
    return c.select(F.col("conv_id").alias("document_id"), n.alias("page_number"), text.alias("raw_text"))


SIGNED = r"CASE WHEN f = '' OR length(f) > 90 OR len(string_split(f, ' ')) > 12 OR regexp_matches(f, '^\p{Ll}') OR (regexp_matches(f, '[.!?]$') AND len(string_split(f, ' ')) >= 5) THEN NULL ELSE trim(regexp_replace(regexp_replace(regexp_replace(lower(f), '[0-9]', '#', 'g'), '[^a-z0-9# ]', ' ', 'g'), ' +', ' ', 'g')) END"


@query("ag01_boundary_counts", f"""WITH {PAGES}, ln AS (SELECT document_id, list_filter(string_split(raw_text, chr(10)), lambda x: trim(x) <> '') AS l FROM sheets),
  e AS (SELECT document_id, 'head' AS side, unnest(l[1:2]) AS line FROM ln UNION ALL SELECT document_id, 'foot', unnest(l[greatest(len(l) - 1, 1):len(l)]) FROM ln),
  g AS (SELECT document_id, side, {SIGNED} AS signature FROM (SELECT document_id, side, trim(regexp_replace(line, '[ \\t]+', ' ', 'g')) AS f FROM e)) SELECT document_id, side, signature FROM g WHERE signature IS NOT NULL GROUP BY ALL HAVING count(*) >= 3""", "conversations")
def _(c):
    return chunks.repeated_boundaries(sheets(c)).select("document_id", "side", "signature")


# Results of an evaluation: the rated documents as questions, their sources as documents.
RESULTS = """results AS (SELECT l.doc_id AS question, d.source AS document, CASE WHEN l.doc_id % 3 = 0 THEN 'exploratory' ELSE 'gating' END AS tier, l.quality = 1 AS supported, l.toxic = 0 AS expected_supported,
  n_chars % 5 <> 0 AS retrieval_hit, n_chars % 7 <> 0 AS citation_hit, n_chars % 3 <> 0 AS citation_text_hit, (l.quality = 1) = (l.toxic = 0) AS support_hit, n_chars % 11 <> 0 AS answer_hit, coalesce(e.value, 0.0) AS latency_ms
  FROM labels l JOIN documents d USING (doc_id) LEFT JOIN events e ON e.event_id = l.doc_id)"""


def results(lab: DataFrame, d: DataFrame, e: DataFrame) -> DataFrame:
    n = F.col("n_chars")
    joined = lab.join(d.select("doc_id", "source", "n_chars"), "doc_id").join(e.select(F.col("event_id").alias("doc_id"), "value"), "doc_id", "left")
    ok, expected = F.col("quality") == 1, F.col("toxic") == 0
    return joined.select(
        F.col("doc_id").alias("question"), F.col("source").alias("document"), F.when(F.col("doc_id") % 3 == 0, "exploratory").otherwise("gating").alias("tier"), ok.alias("supported"), expected.alias("expected_supported"),
        (n % 5 != 0).alias("retrieval_hit"), (n % 7 != 0).alias("citation_hit"), (n % 3 != 0).alias("citation_text_hit"), (ok == expected).alias("support_hit"), (n % 11 != 0).alias("answer_hit"), F.coalesce("value", F.lit(0.0)).alias("latency_ms"),
    )


FAILED = "NOT (retrieval_hit AND citation_hit AND citation_text_hit AND support_hit AND answer_hit)"
RATE = lambda c: f"coalesce(avg(CASE WHEN {c} THEN 1.0 ELSE 0.0 END), 0.0)"
SUMMARY = f"""count(*) AS questions, count(*) FILTER (tier = 'gating') AS gating_questions, count(*) FILTER (tier = 'exploratory') AS exploratory_questions,
  {RATE('retrieval_hit')} AS retrieval_hit_rate, {RATE('citation_hit')} AS citation_hit_rate, {RATE('citation_text_hit')} AS citation_evidence_hit_rate,
  avg(CASE WHEN citation_text_hit THEN 1.0 ELSE 0.0 END) FILTER (tier = 'gating') AS gating_citation_evidence_hit_rate, {RATE('support_hit')} AS support_accuracy, {RATE('answer_hit')} AS answer_match_rate,
  count(*) FILTER (NOT supported AND NOT expected_supported) / nullif(count(*) FILTER (NOT supported), 0)::DOUBLE AS unsupported_precision,
  coalesce(avg(latency_ms), 0.0) AS average_latency_ms, coalesce(quantile_cont(latency_ms, 0.5), 0.0) AS latency_p50_ms, coalesce(quantile_cont(latency_ms, 0.95), 0.0) AS latency_p95_ms,
  count(*) FILTER (NOT supported) AS predicted_unsupported_count, count(*) FILTER (NOT expected_supported) AS expected_unsupported_count,
  count(*) FILTER ({FAILED}) AS failure_count, count(*) FILTER ({FAILED} AND tier = 'gating') AS gating_failure_count, count(*) FILTER ({FAILED} AND tier = 'exploratory') AS exploratory_failure_count"""
COUNTS = [c for c in evaluation.SUMMARY if c.endswith(("questions", "count"))]
ROUNDED = ", ".join(c if c in COUNTS else f"round({c}, 6) AS {c}" for c in evaluation.SUMMARY)


def rounded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *(F.col(c) if c in COUNTS else F.round(c, 6).alias(c) for c in evaluation.SUMMARY))


query("ag08_eval_summary", f"WITH {RESULTS} SELECT {ROUNDED} FROM (SELECT {SUMMARY} FROM results)", "labels", "documents", "events")(lambda lab, d, e: rounded(evaluation.summary(results(lab, d, e))))
query("ag07_per_document", f"WITH {RESULTS} SELECT document, count(*) AS questions, count(*) FILTER (tier = 'gating') AS gating_questions, count(*) FILTER (tier = 'exploratory') AS exploratory_questions, count(*) FILTER (tier = 'gating' AND {FAILED}) AS gating_failures, count(*) FILTER (tier = 'exploratory' AND {FAILED}) AS exploratory_failures FROM results GROUP BY 1", "labels", "documents", "events")(
    lambda lab, d, e: evaluation.per_document(results(lab, d, e))
)
query("gr18_failures", f"WITH {RESULTS} SELECT question, document, tier FROM results WHERE {FAILED}", "labels", "documents", "events")(lambda lab, d, e: evaluation.failures(results(lab, d, e)).select("question", "document", "tier"))
RUNS = f"WITH {RESULTS}, runs AS (SELECT question % 2 AS run, {SUMMARY} FROM results GROUP BY 1)"
QUALITY = ", ".join(f"{c}::DOUBLE AS {c}" for c in evaluation.QUALITY + evaluation.LATENCY)


@query("ag12_metric_deltas", f"""{RUNS}, long AS (UNPIVOT (SELECT run, {QUALITY} FROM runs) ON COLUMNS(* EXCLUDE (run)) INTO NAME metric VALUE v), m AS (SELECT metric, max(v) FILTER (run = 1) AS cur, max(v) FILTER (run = 0) AS base FROM long GROUP BY 1)
  SELECT metric, round(cur - base, 6) AS delta, coalesce(CASE WHEN metric IN ({sql.words(evaluation.LATENCY)}) THEN cur - base >= 10 WHEN metric = 'citation_evidence_hit_rate' THEN false ELSE cur - base < 0 END, false) AS regressed FROM m""", "labels", "documents", "events")
def _(lab, d, e):
    r = results(lab, d, e)
    now, before = (evaluation.summary(r.filter(F.col("question") % 2 == k)) for k in (1, 0))
    return evaluation.compare(now, before).select("metric", F.round("delta", 6).alias("delta"), "regressed")


@query("ag13_best_preset", f"WITH {RESULTS}, p AS (SELECT CASE question % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'default' ELSE 'large' END AS preset, question % 3 AS place, {SUMMARY} FROM results GROUP BY 1, 2) SELECT preset FROM p ORDER BY {', '.join(f'{c} DESC' for c in evaluation.GATING)}, average_latency_ms, latency_p95_ms, place LIMIT 1", "labels", "documents", "events")
def _(lab, d, e):
    r = results(lab, d, e).withColumn("place", F.col("question") % 3).withColumn("preset", F.when(F.col("place") == 0, "small").when(F.col("place") == 1, "default").otherwise("large"))
    return evaluation.best(evaluation.summary(r, "preset", "place"), "preset", "place")


@query("src11_report", f"{RUNS} SELECT run, '| retrieval | ' || printf('%.3f', retrieval_hit_rate) || ' |' || chr(10) || '| support | ' || printf('%.3f', support_accuracy) || ' |' || chr(10) || '| questions | ' || questions || ' |' AS report FROM runs", "labels", "documents", "events")
def _(lab, d, e):
    per = evaluation.summary(results(lab, d, e).withColumn("run", F.col("question") % 2), "run")
    return per.select("run", evaluation.report({"retrieval": F.col("retrieval_hit_rate"), "support": F.col("support_accuracy"), "questions": F.col("questions")}).alias("report"))


# Texts of answers.
per_doc("tx18_evidence_excerpt", st.excerpt, st.EXCERPT_SQL)
NORMAL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(lower(trim(regexp_replace(translate(text, '‐‑‒–—―−‘’“”', '-------''''""'), '\s+', ' ', 'g'))), 'ß', 'ss'), '\s-+\s', ' - ', 'g'), '\$\s+', '$', 'g'), '\s+%', '%', 'g'), '\(\s+', '(', 'g'), '\s+\)', ')', 'g')"""
per_doc("tx19_excerpt_norm", evaluation.normal_excerpt, NORMAL)
REFUSAL = "I could not find enough support in the indexed document content to answer that question."  # a fixed value
ANSWERS = f"answers AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN ' insufficient_support ' WHEN 2 THEN upper('{REFUSAL}') ELSE '  ' END AS answer FROM conversations)"


def answers(c: DataFrame) -> DataFrame:
    n = F.col("turn") % 4
    return c.select("conv_id", "turn", F.when(n == 0, F.col("text")).when(n == 1, " insufficient_support ").when(n == 2, REFUSAL.upper()).otherwise("  ").alias("answer"))


@query("flt14_unsupported", f"WITH {ANSWERS} SELECT conv_id, turn, lower(trim(answer)) IN ('', 'insufficient_support', lower('{REFUSAL}')) AS unsupported FROM answers", "conversations")
def _(c):
    return answers(c).select("conv_id", "turn", F.lower(F.trim("answer")).isin("", "insufficient_support", REFUSAL.lower()).alias("unsupported"))


@query("st01_answer_deltas", f"WITH {ANSWERS} SELECT conv_id, turn, unnest(w) AS delta, generate_subscripts(w, 1) AS seq FROM (SELECT conv_id, turn, list_filter(string_split_regex(trim(answer), '\\s+'), lambda x: x <> '') AS w FROM answers)", "conversations")
def _(c):
    """An answer as the stream of its words."""
    words = F.filter(F.split(F.trim("answer"), r"\s+"), lambda w: w != "")
    each = answers(c).select("conv_id", "turn", F.posexplode(words).alias("p", "delta"))
    return each.select("conv_id", "turn", "delta", (F.col("p") + 1).cast("long").alias("seq"))


@query("tx23_terminal_punctuation", f"WITH {ANSWERS} SELECT conv_id, turn, CASE WHEN trim(answer) = '' THEN '' WHEN regexp_matches(trim(answer), '[.!?]$') THEN trim(answer) ELSE trim(answer) || '.' END AS ended, lower(trim(regexp_replace(answer, '\\s+', ' ', 'g'))) AS unit FROM answers", "conversations")
def _(c):
    t = F.trim("answer")
    return answers(c).select("conv_id", "turn", F.when(t == "", "").when(t.rlike("[.!?]$"), t).otherwise(F.concat(t, F.lit("."))).alias("ended"), F.lower(tx.collapse(F.col("answer"))).alias("unit"))


#: Completions of every kind: a text, one that looks like a list, parts of which some are no text, and none at all.
BODIES = """CASE turn % 5 WHEN 0 THEN '{"choices": [{"message": {"content": ' || @SAID || '}}]}' WHEN 1 THEN '{"choices": [{"message": {"content": "[{" }}]}'
  WHEN 2 THEN '{"choices": [{"message": {"content": [{"type": "reasoning", "text": "hidden"}, {"type": "text", "text": ' || @SAID || '}, "loose", {"type": "text"}, {"type": "text", "text": "!"}]}}]}'
  WHEN 3 THEN '{"choices": [], "content": ' || @SAID || '}' ELSE '{"choices": [{"message": {"content": null}}]}' END"""
PARTS = "list_transform(list_filter(CAST(json_extract(body, '$.choices[0].message.content') AS JSON[]), lambda p: json_type(p) = 'OBJECT' AND coalesce(json_extract_string(p, '$.type'), '') = 'text'), lambda p: coalesce(json_extract_string(p, '$.text'), ''))"


@query("tx25_completion_text", f"""WITH p AS (SELECT conv_id, turn, {BODIES.replace('@SAID', 'CAST(to_json(text) AS VARCHAR)')} AS body FROM conversations),
  k AS (SELECT *, coalesce(json_type(body, '$.choices[0].message.content'), '') AS kind FROM p)
  SELECT conv_id, turn, CASE kind WHEN 'VARCHAR' THEN json_extract_string(body, '$.choices[0].message.content') WHEN 'ARRAY' THEN array_to_string({PARTS}, '') ELSE '' END AS content FROM k""", "conversations")
def _(c):
    """The text of a completion: a string, or the texts of its parts together."""
    said = F.regexp_replace(F.to_json(F.struct("text")), r'(?s)^\{"text":(.*)\}$', "$1")
    body = c.withColumn("said", said).select("conv_id", "turn", F.expr(BODIES.replace("@SAID", "said")).alias("body"))
    return body.select("conv_id", "turn", events.completion_text(F.col("body")).alias("content"))


@query("tx25_stream_deltas", "SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN [] ELSE [role || ' ', text] END AS deltas FROM conversations WHERE text <> ''", "conversations")
def _(c):
    """What the lines of a streamed completion add: comments, other lines and empty deltas add nothing, and what follows the end isn't read."""
    line = lambda x: F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(x.alias("content")).alias("delta"))).alias("choices"))))
    said = F.array(F.lit(": ping"), F.when(F.col("turn") % 3 == 2, F.lit("data: [DONE]")).otherwise(line(F.concat("role", F.lit(" ")))), F.lit("event: x"), line(F.lit("")), line(F.col("text")), F.lit(" data:[DONE] "), line(F.lit("late")))
    return c.filter("text <> ''").select("conv_id", "turn", events.stream_deltas(said).alias("deltas"))


WORDS = f"WITH {ANSWERS}, w AS (SELECT conv_id, turn, list_filter(string_split_regex(trim(answer), '\\s+'), lambda x: x <> '') AS l FROM answers)"


@query("st01_event_stream", f"""{WORDS} SELECT conv_id, turn, seq, CASE seq WHEN 0 THEN 'start' WHEN len(l) + 1 THEN 'complete' ELSE 'answer_delta' END AS event,
  CASE WHEN seq BETWEEN 1 AND len(l) THEN l[seq] || CASE WHEN seq < len(l) THEN ' ' ELSE '' END END AS delta FROM (SELECT *, CAST(unnest(range(0, len(l) + 2)) AS INTEGER) AS seq FROM w)""", "conversations")
def _(c):
    """Each answer as events on the wire, cut into pieces of 17 characters wherever that falls, and read back."""
    rows = answers(c).select("*", F.struct("conv_id", "turn").alias("id"))
    sent = events.answer_events(rows, "id", F.struct(F.col("turn").alias("retrieved_chunk_count")), F.col("answer"), F.struct("answer", (F.col("turn") % 4 == 0).alias("supported")))
    wire = sent.withColumn("said", events.frame(F.col("event"), F.col("data"))).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "said"))), lambda x: x["said"]), "").alias("said"))
    pieces = wire.select("id", F.posexplode(F.regexp_extract_all("said", F.lit("(?s).{1,17}"), F.lit(0))).alias("n", "piece"))
    got = events.received(pieces, "id", "n", "piece")
    delta = F.when(F.col("event") == "answer_delta", F.get_json_object("data", "$.delta"))
    return got.select("id.*", "seq", "event", delta.alias("delta"))


VERDICTS = "CASE turn % 3 WHEN 0 THEN 'Supported: yes' || chr(10) || ' because ' || role WHEN 1 THEN chr(10) || 'UNSUPPORTED' ELSE role END"


@query("tx25_verdict", f"WITH v AS (SELECT conv_id, turn, list_filter(list_transform(string_split({VERDICTS}, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM conversations) SELECT conv_id, turn, CASE WHEN upper(l[1]) LIKE 'SUPPORTED%' THEN true WHEN upper(l[1]) LIKE 'UNSUPPORTED%' THEN false END AS supported, CASE WHEN upper(l[1]) LIKE 'SUPPORTED%' OR upper(l[1]) LIKE 'UNSUPPORTED%' THEN coalesce(array_to_string(l[2:], ' '), '') END AS reason FROM v", "conversations")
def _(c):
    said = c.select("conv_id", "turn", F.expr(VERDICTS.replace("chr(10)", "'\\n'")).alias("said"))
    v = evaluation.verdict(F.col("said"))
    return said.select("conv_id", "turn", v["supported"].alias("supported"), v["reason"].alias("reason"))


@query("tx26_expectations", """WITH p AS (SELECT conv_id, list(DISTINCT turn) AS pages, list(lower(text)) AS texts, min(lower(text)) AS one FROM conversations GROUP BY 1), x AS (SELECT *, range(conv_id % 3, conv_id % 3 + 2) AS want, list_filter([one[1:20], 'no such words'], lambda t: conv_id % 4 > 0) AS said FROM p)
  SELECT conv_id, len(list_intersect(pages, want)) > 0 AS any_page, len(list_intersect(pages, want)) = len(want) AS all_pages, len(said) = 0 OR len(list_filter(said, lambda t: len(list_filter(texts, lambda a: contains(a, t))) > 0)) > 0 AS any_text, len(list_filter(said, lambda t: len(list_filter(texts, lambda a: contains(a, t))) > 0)) = len(said) AS all_texts FROM x""", "conversations")
def _(c):
    """Whether the pages and texts that were expected are among those there are; nothing expected is a hit."""
    p = c.groupBy("conv_id").agg(F.collect_set("turn").alias("pages"), F.collect_list(F.lower("text")).alias("texts"), F.min(F.lower("text")).alias("one"))
    n = F.col("conv_id") % 3
    want = F.sequence(n, n + 1)
    said = F.when(F.col("conv_id") % 4 > 0, F.array(F.substring("one", 1, 20), F.lit("no such words"))).otherwise(F.array().cast("array<string>"))
    p = p.withColumns({"want": want, "said": said})
    hit = lambda mode: evaluation.page_hit(F.col("want"), F.col("pages"), mode)
    text = lambda mode: evaluation.text_hit(F.col("said"), F.col("texts"), mode)
    return p.select("conv_id", hit("any").alias("any_page"), hit("all").alias("all_pages"), text("any").alias("any_text"), text("all").alias("all_texts"))


@query("tx27_tier", "SELECT conv_id, turn, CASE WHEN lower(trim(raw)) IN ('gating', 'exploratory') THEN lower(trim(raw)) END AS tier FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN ' Gating' WHEN 1 THEN 'EXPLORATORY ' ELSE role END AS raw FROM conversations)", "conversations")
def _(c):
    """The tier that is meant; null where evaluation.tier(strict=True) raises an error."""
    n = F.col("turn") % 3
    return c.select("conv_id", "turn", evaluation.tier(F.when(n == 0, " Gating").when(n == 1, "EXPLORATORY ").otherwise(F.col("role")), strict=False).alias("tier"))


WORDS = "list_distinct(list_filter(regexp_extract_all(lower({t}), '[a-z0-9]+'), lambda w: length(w) > 2))"


@query("tx28_sentence_citation", f"""WITH RECURSIVE {TURNS}, {st.sentences_sql('s', 'turns', 'doc_id')}, u AS (SELECT doc_id, doc_id // 1000 AS conv, unnest(sents) AS sentence, generate_subscripts(sents, 1) AS i FROM s), x AS (SELECT *, {WORDS.format(t='sentence')} AS w FROM u),
  o AS (SELECT x.doc_id, x.i, t.doc_id AS citation, len(list_intersect(x.w, {WORDS.format(t='t.text')})) AS n FROM x JOIN turns t ON t.item_id = x.conv AND t.doc_id <> x.doc_id)
  SELECT doc_id, i, citation, n FROM o WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY doc_id, i ORDER BY n DESC, citation) = 1""", "conversations")
def _(c):
    """Which other turn of the conversation each sentence is most like, by words of three letters or more; of equal ones the first."""
    words = lambda t: F.array_distinct(F.filter(F.regexp_extract_all(F.lower(t), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) > 2))
    t = turns(c)
    each = t.select("item_id", "doc_id", F.posexplode(st.sentences(F.col("text"))).alias("p", "sentence")).select("item_id", "doc_id", (F.col("p") + 1).cast("long").alias("i"), words("sentence").alias("w"))
    other = t.select("item_id", F.col("doc_id").alias("citation"), words("text").alias("v"))
    both = each.join(other, "item_id").filter("citation <> doc_id").withColumn("n", F.size(F.array_intersect("w", "v")).cast("long")).filter("n > 0")
    return both.groupBy("doc_id", "i").agg(F.max_by(F.struct("citation", "n"), F.struct("n", -F.col("citation"))).alias("b")).select("doc_id", "i", "b.citation", "b.n")


BLOCK = "'[' || rank || '] turn ' || turn || ', pages ' || page_start || '-' || page_end || ', Score: ' || printf('%.4f', ctx) || chr(10) || t_text"


@query("tx29_prompt", f"{CONTEXTS}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY ctx DESC, doc_id) AS rank FROM contexts WHERE ctx > 0) SELECT item_id, 'Question: ' || any_value(q_text) || chr(10) || chr(10) || string_agg({BLOCK}, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS prompt FROM r GROUP BY 1", "benchmark", "conversations")
def _(b, c):
    """The prompt of a question: its contexts with their places and scores, best first."""
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("ctx"), "doc_id"))
    block = F.format_string("[%d] turn %d, pages %d-%d, Score: %s\n%s", "rank", "turn", "page_start", "page_end", tx.printed(F.col("ctx"), 4), "t_text")
    each = contexts(b, c).filter("ctx > 0").withColumn("rank", rank).select("item_id", "q_text", F.struct("rank", block.alias("b")).alias("x"))
    blocks = each.groupBy("item_id").agg(F.first("q_text").alias("q"), F.array_sort(F.collect_list("x")).alias("l"))
    return blocks.select("item_id", F.concat(F.lit("Question: "), "q", F.lit("\n\n"), F.array_join(F.transform("l", lambda x: x["b"]), "\n\n---\n\n")).alias("prompt"))


@query("flt03_positive_contexts", f"{CONTEXTS} SELECT item_id, doc_id FROM contexts WHERE ctx > 0", "benchmark", "conversations")
def _(b, c):
    return contexts(b, c).filter("ctx > 0").select("item_id", "doc_id")


@query("so03_merged_citations", f"{SPANS}, f AS (SELECT item_id, context_id, min(doc_id) AS first FROM spans WHERE n >= 2 GROUP BY 1, 2) SELECT item_id, list(context_id ORDER BY first) AS citations FROM f GROUP BY 1", "benchmark", "conversations")
def _(b, c):
    """The contexts that the claims of a question cite, each once, in the order in which claims first name them."""
    first = spans(b, c).filter("n >= 2").groupBy("item_id", "context_id").agg(F.min("doc_id").alias("first"))
    return first.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "context_id"))), lambda x: x["context_id"]).alias("citations"))


@query("src14_runtime", "SELECT DISTINCT event_type AS request, 'hashing' AS embedding_provider, 'token_overlap' AS reranker, 'extractive' AS answer_provider, CAST(NULL AS VARCHAR) AS answer_model FROM events", "events")
def _(e):
    """What answered a request; a model's name only where the provider has one."""
    from ..config import Settings

    s = Settings()
    return e.select(F.col("event_type").alias("request")).distinct().select("request", F.lit(s.embedding_provider).alias("embedding_provider"), F.lit(s.reranker).alias("reranker"), F.lit(s.answer_provider).alias("answer_provider"), F.lit(s.answer_model).cast("string").alias("answer_model"))
