"""Queries on candidates, lines and claims: what stands between search and answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import sql
from ..functions import text as tx
from ..operators import retrieval
from .registry import per_doc, query

# The shapes of lines of flattened tables.
NUMERIC_LINE = r"^\$? ?\(?[0-9][0-9,. ]*\)? ?%?$"
NO_CELL = ["$", "%", "N/A"]
WHITE = r"[ \t\n\r\f\v]+"


def lines(text: Column) -> Column:
    """The lines of a text that aren't blank, trimmed, with runs of white space as one blank."""
    flat = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, WHITE, " ")))
    return F.filter(flat, lambda x: x != "")


LINES = r"list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[ \t\n\r\f\v]+', ' ', 'g'))), lambda x: x <> '')"


def cells(text: Column) -> Column:
    """Lines without bullets, and without those that hold no cell."""
    bare = F.transform(lines(text), lambda x: F.trim(F.regexp_replace(x, r"^[•*\- ]+", "")))
    return F.filter(bare, lambda x: (x != "") & ~x.isin(NO_CELL))


CELLS = f"list_filter(list_transform({LINES}, lambda x: trim(regexp_replace(x, '^[•*\\- ]+', ''))), lambda x: x <> '' AND x NOT IN ({sql.words(NO_CELL)}))"

per_doc("tx13_structured_lines", lambda t: F.array_join(cells(t), "|"), f"coalesce(array_to_string({CELLS}, '|'), '')")
per_doc("wn14_boundary_lines", lambda t: F.concat_ws("|", F.slice(lines(t), 1, 2), F.slice(lines(t), F.greatest(F.size(lines(t)) - 1, F.lit(1)), 2)), f"array_to_string(list_concat(list_slice({LINES}, 1, 2), list_slice({LINES}, greatest(len({LINES}) - 1, 1), len({LINES}))), '|')")
@query("wn13_line_windows", f"SELECT conv_id, turn, i, n, array_to_string(list_slice(l, i, i + n - 1), ' ') AS span FROM (SELECT conv_id, turn, l, i, unnest(range(1, least(8, len(l) - i + 1) + 1)) AS n FROM (SELECT conv_id, turn, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT conv_id, turn, {LINES} AS l FROM conversations)))", "conversations")
def _(c):
    parted = c.select("conv_id", "turn", lines(F.col("text")).alias("l")).filter(F.size("l") > 0)
    starts = parted.select("conv_id", "turn", "l", F.explode(F.sequence(F.lit(1), F.size("l"))).alias("i"))
    each = starts.select("conv_id", "turn", "l", "i", F.explode(F.sequence(F.lit(1), F.least(F.lit(8), F.size("l") - F.col("i") + 1))).alias("n"))
    return each.select("conv_id", "turn", F.col("i").cast("long").alias("i"), F.col("n").cast("long").alias("n"), F.array_join(F.slice("l", F.col("i"), F.col("n")), " ").alias("span"))


@query("so01_distinct_units", f"SELECT doc_id, min(i) AS first, key FROM (SELECT doc_id, lower(unnest(l)) AS key, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, {LINES} AS l FROM documents)) GROUP BY doc_id, key", "documents")
def _(d):
    units = d.select("doc_id", F.transform(lines(F.col("text")), lambda x: F.lower(x)).alias("l"))
    each = units.select("doc_id", "l", F.explode(F.array_distinct("l")).alias("key"))
    return each.select("doc_id", "key", F.array_position("l", F.col("key")).alias("first"))


@query("ag09_term_union", f"SELECT item_id % 10 AS bucket, count(DISTINCT term) AS terms FROM ({sql.content('benchmark', 'item_id')}) GROUP BY 1", "benchmark")
def _(b):
    each = b.select((F.col("item_id") % 10).alias("bucket"), F.explode(F.array_distinct(tx.sequence(F.col("text")))).alias("term"))
    return each.groupBy("bucket").agg(F.countDistinct("term").alias("terms"))


@query("ag14_cheapest_context", "SELECT conv_id, arg_min(turn, length(text) * 100000 + turn) AS turn FROM conversations GROUP BY 1", "conversations")
def _(c):
    return c.groupBy("conv_id").agg(F.min_by("turn", F.struct(F.length("text"), F.col("turn"))).alias("turn"))


@query("jn10_config_resolution", "SELECT d.doc_id, coalesce(l.quality, s.q, -1) AS quality FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN (SELECT source, max(quality) AS q FROM labels JOIN documents USING (doc_id) WHERE toxic = 1 GROUP BY 1) s ON s.source = d.source", "documents", "labels")
def _(d, lab):
    slim = d.select("doc_id", "source")
    defaults = lab.filter("toxic = 1").join(slim, "doc_id").groupBy("source").agg(F.max("quality").alias("q"))
    return slim.join(lab.select("doc_id", "quality"), "doc_id", "left").join(defaults, "source", "left").select("doc_id", F.coalesce("quality", "q", F.lit(-1)).alias("quality"))


@query("wn16_recent_first", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rank FROM events QUALIFY rank <= 3", "events")
def _(e):
    return retrieval.top(e.select("user_id", "event_id", "ts"), "user_id", 3, F.desc("ts"), "event_id").select("user_id", "event_id", "rank")
