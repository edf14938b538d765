"""Ingestion jobs over micro-batches with a restart from the checkpoint after each."""

from __future__ import annotations

import json

import pytest

from inkwell.streaming import jobs

BATCHES = [
    [("a", "submitted", 0), ("a", "started", 1), ("b", "submitted", 0), ("c", "submitted", 0), ("c", "started", 1), ("d", "submitted", 2), ("d", "started", 3)],
    [("a", "extracted", 2), ("a", "embedded", 3), ("a", "embedded", 3), ("b", "started", 2), ("b", "failed", 3), ("c", "extracted", 2), ("c", "failed", 4), ("d", "extracted", 4)],
    [("b", "submitted", 5), ("b", "embedded", 5), ("b", "started", 6), ("b", "extracted", 7), ("b", "embedded", 8), ("e", "started", 8)],
    [("clock", "submitted", 40)],  # what says nothing for ten minutes is tried again
    [("d", "started", 41), ("clock", "started", 41)],
    [("clock", "extracted", 60)],
    [("clock", "embedded", 62)],
]


@pytest.fixture(scope="module")
def changes(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("jobs")
    source, out, at = root / "in", str(root / "out"), str(root / "at")
    source.mkdir()
    for n, batch in enumerate(BATCHES):
        (source / f"{n}.json").write_text("\n".join(json.dumps({"document_id": d, "event": e, "at": f"2024-01-01T00:{m:02d}:00Z" if m < 60 else f"2024-01-01T01:{m - 60:02d}:00Z"}) for d, e, m in batch))
        stream = spark.readStream.schema("document_id string, event string, at timestamp").json(str(source))
        q = jobs.transitions(stream, retries=2, late="5 minutes").writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(out)


def of(changes, document):
    return [(r.job, r.attempt, r.status, r.document_status, r.error) for r in changes.filter(changes.document_id == document).orderBy("job", "at", "attempt").collect()]


def test_a_job_that_goes_well(changes):
    assert of(changes, "a") == [(1, 1, "queued", "uploaded", None), (1, 1, "processing", "processing", None), (1, 1, "completed", "ready", None)]


def test_failures_are_named_after_their_stage(changes):
    assert of(changes, "c")[-1] == (1, 1, "failed", "failed", "Embedding generation failed.")
    b = of(changes, "b")
    assert b[2] == (1, 1, "failed", "failed", "PDF extraction failed.")
    # Submitted again it has a new job; what comes before its turn changes nothing.
    assert b[3:] == [(2, 1, "queued", "uploaded", None), (2, 1, "processing", "processing", None), (2, 1, "completed", "ready", None)]
    assert of(changes, "e") == []


def test_silence_is_tried_again_then_fails(changes):
    d = of(changes, "d")
    assert [x[:3] for x in d] == [(1, 1, "queued"), (1, 1, "processing"), (1, 2, "queued"), (1, 2, "processing"), (1, 2, "failed")]
    assert d[-1][4] == "PDF extraction failed."


def test_latest(changes):
    got = {r.document_id: (r.job, r.status) for r in jobs.latest(changes).collect()}
    assert got == {"a": (1, "completed"), "b": (2, "completed"), "c": (1, "failed"), "d": (1, "failed"), "clock": (1, "completed")}
