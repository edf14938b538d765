"""Server-sent events of answers: written as frames, read back from pieces cut anywhere, and the texts in model completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

EVENTS = "array<struct<event:string,data:string>>"


def _content(body: Column, path: str) -> Column:
    """A content that is a string, or the texts of its parts of type text together; an empty text for anything else.

    What kind it is comes from its JSON type, so a text that looks like a list stays a text."""
    value = F.try_variant_get(F.try_parse_json(body), path, "variant")
    kind = F.schema_of_variant(value)
    part = lambda p, name: F.when(F.schema_of_variant(F.try_variant_get(p, f"$.{name}", "variant")) == "STRING", F.try_variant_get(p, f"$.{name}", "string"))
    parts = F.filter(F.try_variant_get(value, "$", "array<variant>"), lambda p: part(p, "type") == "text")
    whole = F.array_join(F.transform(parts, lambda p: F.coalesce(part(p, "text"), F.lit(""))), "")
    return F.coalesce(F.when(kind == "STRING", F.try_variant_get(value, "$", "string")).when(kind.startswith("ARRAY"), whole), F.lit(""))


def completion_text(body: Column) -> Column:
    """The text of the first choice of a chat completion."""
    return _content(body, "$.choices[0].message.content")


def completion_delta(body: Column) -> Column:
    """What the first choice of a streamed completion adds."""
    return _content(body, "$.choices[0].delta.content")


def data_line(line: Column) -> Column:
    """What a line says after data:, an empty text for other lines."""
    flat = F.regexp_replace(line, r"^\s+|\s+$", "")
    return F.when(flat.startswith("data:"), F.regexp_replace(F.substring(flat, 6, 1 << 30), r"^\s+", "")).otherwise("")


def stream_deltas(lines: Column) -> Column:
    """What the data lines of a streamed completion add, in order, up to [DONE]; lines that add nothing are left out."""

    def of(said: Column) -> Column:
        end = F.array_position(said, F.lit("[DONE]"))
        return F.when(end > 0, F.slice(said, F.lit(1), (end - 1).cast("int"))).otherwise(said)

    said = tx.let(F.filter(F.transform(lines, data_line), lambda d: d != ""), of)
    return F.filter(F.transform(said, completion_delta), lambda d: d != "")


def answer_words(answer: Column) -> Column:
    """An answer as it is streamed: its words, each but the last with a blank."""
    words = F.filter(F.split(F.trim(F.coalesce(answer, F.lit(""))), r"\s+"), lambda w: w != "")
    return tx.let(words, lambda w: F.transform(w, lambda x, i: F.when(i == F.size(w) - 1, x).otherwise(F.concat(x, F.lit(" ")))))


def frame(event: Column, data: Column) -> Column:
    """An event on the wire; data is JSON, which has no line break outside its strings and writes those within as escapes."""
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), data, F.lit("\n\n"))


def answer_events(answers: DataFrame, key: str, start: Column, answer: Column, complete: Column) -> DataFrame:
    """key, seq, event and data of each answer's stream: start, a delta for each word, complete. start and complete: structs."""
    one = lambda name, data: F.struct(F.lit(name).alias("event"), data.alias("data"))
    deltas = F.transform(answer_words(answer), lambda d: one("answer_delta", F.to_json(F.struct(d.alias("delta")))))
    every = F.concat(F.array(one("start", F.to_json(start))), deltas, F.array(one("complete", F.to_json(complete))))
    return answers.select(key, F.posexplode(every).alias("seq", "e")).select(key, "seq", "e.*")


def blocks(said: Column) -> Column:
    """The events of a text that holds whole blocks: lines event: and data:, blocks ended by an empty line; a block without data says nothing."""

    def event(block: Column) -> Column:
        lines = F.filter(F.transform(F.split(block, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
        after = lambda x, n: F.regexp_replace(F.substring(x, n + 1, 1 << 30), r"^\s+", "")
        named = lambda ls: F.transform(F.filter(ls, lambda x: x.startswith("event:")), lambda x: after(x, 6))
        data = lambda ls: F.transform(F.filter(ls, lambda x: x.startswith("data:")), lambda x: after(x, 5))
        return tx.let(lines, lambda ls: F.struct(F.coalesce(F.get(F.reverse(named(ls)), F.lit(0)), F.lit("message")).alias("event"), F.array_join(data(ls), "\n").alias("data")))

    return F.filter(F.transform(F.split(F.regexp_replace(said, "\r\n", "\n"), "\n\n"), event), lambda e: e["data"] != "")


def received(pieces: DataFrame, key: str, order: str, piece: str) -> DataFrame:
    """key, seq, event and data of what pieces (cut anywhere, in lines too) hold. A stream is one answer, so it fits a row; what its end leaves open is a block as well."""
    whole = pieces.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, piece))), lambda x: x[piece]), "").alias("said"))
    return whole.select(key, F.posexplode(blocks(F.col("said"))).alias("seq", "e")).select(key, "seq", "e.*")


def outcome(events: DataFrame, key: str) -> DataFrame:
    """key, answer (the deltas together), payload of the completion, and error: what the stream reported, or that it ended before a completion."""
    per = events.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("event") == "answer_delta", F.struct("seq", F.coalesce(F.get_json_object("data", "$.delta"), F.lit("")).alias("d"))))), lambda x: x["d"]), "").alias("answer"),
        F.max_by("data", F.when(F.col("event") == "complete", F.col("seq"))).alias("last"),
        F.bool_or(F.col("event") == "complete").alias("done"),
        F.min_by(F.coalesce(F.get_json_object("data", "$.detail"), F.lit("Streaming request failed.")), F.when(F.col("event") == "error", F.col("seq"))).alias("failed"),
    )
    early = F.lit("Streaming response ended before a completion event.")
    return per.select(key, "answer", F.when(F.col("done"), F.col("last")).alias("payload"), F.coalesce("failed", F.when(~F.col("done"), early)).alias("error"))
