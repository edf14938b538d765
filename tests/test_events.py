"""Completions and event streams by hand, and the same stream cut in every way."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from inkwell.operators import events
from inkwell.streaming import events as arriving

BODIES = [
    ({"choices": [{"message": {"content": [{"type": "reasoning", "text": "hidden"}, {"type": "text", "text": "shown"}]}}]}, "shown"),
    ({"choices": [{"message": {"content": '[{"type": "text", "text": "plain"}]'}}]}, '[{"type": "text", "text": "plain"}]'),
    ({"choices": [{"message": {"content": "[{ no list"}}]}, "[{ no list"),
    ({"choices": []}, ""),
    ({}, ""),
    ({"choices": [{"message": {"content": 7}}]}, ""),
    ({"choices": [{"message": {}}]}, ""),
    ({"choices": [{"message": {"content": ["loose", {"type": "text"}, {"type": "text", "text": " a\n"}, {"text": "untyped"}]}}]}, " a\n"),
    ({"choices": [{"message": {"content": "  kept  "}}, {"message": {"content": "second"}}]}, "  kept  "),
]


def test_completion_texts(spark):
    rows = [(i, json.dumps(b)) for i, (b, _) in enumerate(BODIES)] + [(100, "no json"), (101, None)]
    got = dict(spark.createDataFrame(rows, "i int, body string").select("i", events.completion_text(F.col("body"))).collect())
    assert got == {**{i: t for i, (_, t) in enumerate(BODIES)}, 100: "", 101: ""}


def test_streamed_deltas(spark):
    line = lambda c: "data: " + json.dumps({"choices": [{"delta": {"content": c}}]})
    rows = [(1, [line("Oil the pump"), line(" gears first."), "data: [DONE]"]), (2, [": ping", line(""), line([{"type": "text", "text": "x"}]), line("y")]), (3, []), (4, ["data: [DONE]", line("late")])]
    got = dict(spark.createDataFrame(rows, "i int, lines array<string>").select("i", events.stream_deltas(F.col("lines"))).collect())
    assert got == {1: ["Oil the pump", " gears first."], 2: ["x", "y"], 3: [], 4: []}


def wire(answer, newline="\n", end=True):
    words = answer.split()
    sent = [("start", {"retrieved_chunk_count": 2})] + [("answer_delta", {"delta": w + (" " if k < len(words) - 1 else "")}) for k, w in enumerate(words)]
    sent += [("complete", {"answer": answer, "supported": True})] if end else []
    return "".join(f"event: {e}{newline}data: {json.dumps(d)}{newline}{newline}" for e, d in sent)


def test_any_cut_gives_the_same(spark):
    rnd, answer, rows = random.Random(3), 'Oil the "pump" gears,\\ then rest é.', []
    for i in range(40):
        said = wire(answer, "\r\n" if i % 2 else "\n")
        said = said.rstrip() if i % 5 == 0 else said  # a last block that nothing closes
        at = 0
        while at < len(said):
            n = rnd.randint(1, 30)
            rows.append((str(i), len(rows), said[at : at + n]))
            at += n
    pieces = spark.createDataFrame(rows, "stream string, seq long, piece string").repartition(5)
    got = events.outcome(events.received(pieces, "stream", "seq", "piece"), "stream").collect()
    assert len(got) == 40 and all(r.answer == answer and json.loads(r.payload) == {"answer": answer, "supported": True} and r.error is None for r in got)


def test_errors_of_a_stream(spark):
    rows = [("cut", 0, wire("one two", end=False)), ("bad", 0, wire("one", end=False) + 'event: error\ndata: {"detail": "no model"}\n\n'), ("bad2", 0, "event: error\ndata: {}\n\n"), ("none", 0, "event: start\n\n: ping\n\n")]
    got = {r.stream: r for r in events.outcome(events.received(spark.createDataFrame(rows, "stream string, seq long, piece string"), "stream", "seq", "piece"), "stream").collect()}
    assert (got["cut"].answer, got["cut"].payload, got["cut"].error) == ("one two", None, "Streaming response ended before a completion event.")
    assert (got["bad"].error, got["bad2"].error) == ("no model", "Streaming request failed.") and "none" not in got


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_pieces_over_micro_batches(spark, tmp_path, newline):
    """Pieces of two streams in ten files, a micro-batch each, with a restart from the checkpoint half way."""
    texts = {"a": wire("Oil the pump gears after rain.", newline), "b": wire("No.", newline)}
    cuts = {k: [t[len(t) * i // 10 : len(t) * (i + 1) // 10] for i in range(10)] for k, t in texts.items()}
    source, out, at = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "at")
    source.mkdir()

    def run():
        stream = spark.readStream.schema("stream string, seq long, piece string").option("maxFilesPerTrigger", 1).json(str(source))
        q = arriving.received(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start()
        q.awaitTermination()

    for half in (range(5), range(5, 10)):
        for i in half:
            (source / f"{i}.json").write_text("\n".join(json.dumps({"stream": k, "seq": i, "piece": c[i]}) for k, c in cuts.items()))
        run()
    got = sorted((r.stream, r.seq, r.event, json.loads(r.data).get("delta")) for r in spark.read.parquet(out).collect())
    want = [(k, n, *e) for k, t in (("a", "Oil the pump gears after rain."), ("b", "No.")) for n, e in enumerate([("start", None), *(("answer_delta", w + (" " if j < len(t.split()) - 1 else "")) for j, w in enumerate(t.split())), ("complete", None)])]
    assert got == want
