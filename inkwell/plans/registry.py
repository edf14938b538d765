"""Queries by name, with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import sql
from ..functions import text as tx
from ..sources.scratch import spread, tidied

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "vc05_lexical"


def query(name: str, oracle: str, *tables: str):
    """Registers f(table, ...) under the name."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: tidied(spark, name, lambda: f(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables)))
        ORACLE_SQL[name] = oracle
        return f

    return add


def per_doc(name: str, value, oracle: str) -> None:
    """A column of each document's text."""
    query(name, f"SELECT doc_id, {oracle} AS value FROM documents", "documents")(lambda d: d.select("doc_id", value(F.col("text")).alias("value")))


per_doc("tx01_normalize_ws", tx.collapse, r"trim(regexp_replace(text, '\s+', ' ', 'g'))")
per_doc("tx02_tokens", lambda t: F.size(tx.tokens(F.lower(t))).cast("long"), "len(regexp_extract_all(lower(text), '[a-z0-9]+'))")
per_doc("tx11_token_estimate", lambda t: F.greatest(F.lit(1), F.rint(F.size(F.filter(F.split(t, r"\s+"), lambda w: w != "")) * 1.3)).cast("long"), r"CAST(greatest(1, round_even(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) * 1.3, 0)) AS BIGINT)")
per_doc("tx20_numeric_values", lambda t: F.array_join(F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(r"\$?[0-9][0-9,]*(?:\.[0-9]+)?%?"), F.lit(0)), lambda v: F.regexp_replace(v, "[$%,]", "")))), " "), r"coalesce(array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '\$?[0-9][0-9,]*(?:\.[0-9]+)?%?'), lambda v: regexp_replace(v, '[$%,]', '', 'g')))), ' '), '')")
per_doc("flt08_page_number_lines", lambda t: F.size(F.filter(F.split(t, "\n"), lambda x: F.trim(x).rlike(r"(?i)^((page )?[0-9]+|[ivxlcdm]+)$"))).cast("long"), r"len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(trim(x), '(?i)^((page )?[0-9]+|[ivxlcdm]+)$')))")


@query("tx03_normalize_term", f"SELECT DISTINCT token, {sql.term('token')} AS term FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents)", "documents")
def _(d):
    return spread(d.select("text")).select(F.explode(tx.tokens(F.lower("text"))).alias("token")).distinct().select("token", tx.term(F.col("token")).alias("term"))


@query("tx04_term_sets", f"SELECT doc_id, count(DISTINCT term) AS terms, count(*) AS sequence FROM ({sql.content('documents', 'doc_id')}) GROUP BY 1", "documents")
def _(d):
    seq = spread(d.select("doc_id", "text")).select("doc_id", tx.sequence(F.col("text")).alias("seq"))
    sizes = F.struct(F.size(F.array_distinct("seq")).cast("long").alias("terms"), F.size("seq").cast("long").alias("sequence"))
    # Grouped, so that the filter isn't worked out before the texts are spread.
    return seq.groupBy("doc_id").agg(F.max(sizes).alias("n")).select("doc_id", "n.*").filter("sequence > 0")


@query("tx06_anchor_terms", sql.anchors(sql.content("benchmark", "item_id"), "item_id"), "benchmark")
def _(b):
    return b.select("item_id", F.explode(tx.anchors(tx.content(F.col("text")))).alias("term"))


@query("tx07_constraint_terms", sql.constraints(sql.content("benchmark", "item_id"), "item_id"), "benchmark")
def _(b):
    return b.select("item_id", F.explode(tx.constraints(tx.content(F.col("text")))).alias("term"))


@query(
    "tx08_named_subjects",
    f"SELECT DISTINCT item_id, term FROM ({sql.occurrences('benchmark', 'item_id')}) WHERE regexp_matches(raw, '^[A-Z]') AND NOT (pos = 1 AND lower(raw) IN ({sql.STOP})) AND term NOT IN ({sql.STOP}) AND term NOT IN ({sql.PLAIN})",
    "benchmark",
)
def _(b):
    return b.select("item_id", F.explode(tx.subjects(F.col("text"))).alias("term"))


@query(
    "tx10_metadata_noise",
    f"SELECT doc_id, round(CASE WHEN m = 0 THEN 0.0 ELSE least(1.0, m / n * 4 + CASE WHEN m >= 2 THEN 0.2 ELSE 0.0 END) END, 6) AS noise FROM (SELECT doc_id, count(*)::DOUBLE AS n, count(*) FILTER (term IN ({sql.META}))::DOUBLE AS m FROM ({sql.occurrences('documents', 'doc_id')}) GROUP BY 1)",
    "documents",
)
def _(d):
    full = spread(d.select("doc_id", "text")).select("doc_id", tx.full_terms(tx.normal(F.col("text"))).alias("full"))
    n = F.struct(F.size("full").alias("n"), F.round(tx.noise(F.col("full")), 6).alias("noise"))
    return full.groupBy("doc_id").agg(F.max(n).alias("x")).filter("x.n > 0").select("doc_id", "x.noise")


@query("wn11_bigrams", f"SELECT item_id, count(*) AS pairs FROM (SELECT DISTINCT item_id, term, nxt FROM (SELECT item_id, term, lead(term) OVER (PARTITION BY item_id ORDER BY pos) AS nxt FROM ({sql.content('benchmark', 'item_id')})) WHERE nxt <> term) GROUP BY 1", "benchmark")
def _(b):
    n = F.size(tx.unequal(tx.pairs(tx.sequence(F.col("text"))))).cast("long")
    return b.select("item_id", n.alias("pairs")).filter("pairs > 0")


@query("src04_dedupe", "SELECT min(doc_id) AS doc_id, sha256(text) AS sha256, count(*) AS copies FROM documents GROUP BY sha256(text)", "documents")
def _(d):
    return d.groupBy(F.sha2("text", 256).alias("sha256")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("src07_latest_job", "SELECT user_id, max(event_id) AS event_id FROM (SELECT user_id, event_id, rank() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r FROM events) WHERE r = 1 GROUP BY 1", "events")
def _(e):
    return e.groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("m")).select("user_id", F.col("m.event_id").alias("event_id"))


@query("jn01_chunk_document", "SELECT l.doc_id, l.quality, d.lang, d.source FROM labels l JOIN documents d USING (doc_id) WHERE l.toxic = 0", "labels", "documents")
def _(lab, d):
    return lab.filter("toxic = 0").join(d.select("doc_id", "lang", "source"), "doc_id").select("doc_id", "quality", "lang", "source")


@query("jn08_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)", "documents", "labels")
def _(d, lab):
    return d.select("doc_id").join(lab, "doc_id", "left_anti")


@query("ag04_rates", "SELECT quality, round(avg(CASE WHEN toxic = 1 THEN 1.0 ELSE 0.0 END), 6) AS rate, count(*) AS n FROM labels GROUP BY 1", "labels")
def _(lab):
    return lab.groupBy("quality").agg(F.round(F.avg((F.col("toxic") == 1).cast("double")), 6).alias("rate"), F.count("*").alias("n"))


@query("ag05_unsupported_precision", "SELECT round(count(*) FILTER (quality = 0 AND toxic = 1) / nullif(count(*) FILTER (quality = 0), 0)::DOUBLE, 6) AS unsupported_precision FROM labels", "labels")
def _(lab):
    both, said = F.count_if((F.col("quality") == 0) & (F.col("toxic") == 1)), F.count_if(F.col("quality") == 0)
    return lab.agg(F.round(both / F.nullif(said, F.lit(0)), 6).alias("unsupported_precision"))


@query("ag06_latency_percentiles", "SELECT event_type, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1", "events")
def _(e):
    return e.groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("mean"), F.round(F.percentile("value", 0.5), 6).alias("p50"), F.round(F.percentile("value", 0.95), 6).alias("p95"))
