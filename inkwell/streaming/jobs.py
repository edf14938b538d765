"""Ingestion jobs as a stream: what happens to documents, in the order of its time, to the states of their jobs.

A job is queued, processing, then completed or failed; its document uploaded, processing, then ready or failed. A job that
says nothing for its lease is queued again, and has failed after ``RETRIES`` attempts; a failure is named after the
stage that it came in. States are kept by document with the stream's checkpoint, so a restart goes on where it stopped."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# What a failed stage is called.
LABELS = {"extraction": "PDF extraction failed.", "embedding": "Embedding generation failed."}
RETRIES, LEASE = 3, "10 minutes"
OUT = "document_id string, job int, attempt int, status string, document_status string, error string, at timestamp"


def stepper(retries: int, lease_ms: int) -> Callable:
    """The state of one document: number of its last job, its attempt, its stage and status."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        job, attempt, stage, status, last = state.get if state.exists else (0, 0, "", "", 0)
        out: list[tuple] = []

        def say(at: int, now: str, document: str, error: str | None = None) -> None:
            nonlocal status, last
            status, last = now, at
            out.append((key[0], job, attempt, now, document, error, pd.Timestamp(at, unit="ms")))

        if state.hasTimedOut:
            at = last + lease_ms
            if attempt < retries:
                attempt, stage = attempt + 1, "extraction"
                say(at, "queued", "processing")
            else:
                say(at, "failed", "failed", LABELS[stage])
        else:
            events = pd.concat(list(batches))
            events = events.assign(ms=[int(pd.Timestamp(t).timestamp() * 1000) for t in events["at"]]).sort_values(["ms", "event"], kind="stable")
            for at, event in zip(events["ms"].tolist(), events["event"].tolist(), strict=True):
                if event == "submitted" and status not in ("queued", "processing"):
                    job, attempt, stage = job + 1, 1, "extraction"
                    say(at, "queued", "uploaded")
                elif event == "started" and status == "queued":
                    say(at, "processing", "processing")
                elif event == "extracted" and status == "processing":
                    stage, last = "embedding", at
                elif event == "embedded" and status == "processing" and stage == "embedding":
                    say(at, "completed", "ready")
                elif event == "failed" and status == "processing":
                    say(at, "failed", "failed", LABELS[stage])
        state.update((job, attempt, stage, status, last))
        if status in ("queued", "processing"):
            state.setTimeoutTimestamp(max(last + lease_ms, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["document_id", "job", "attempt", "status", "document_status", "error", "at"])

    return step


def transitions(events: DataFrame, retries: int = RETRIES, lease: str = LEASE, late: str = "1 minute") -> DataFrame:
    """Each change of state of a job, of a stream of events (document_id, event, at): submitted, started, extracted, embedded,
    failed. What does not fit the state, as a second report of the same, changes nothing, nor does what is ``late`` by more."""
    number, unit = lease.split()
    lease_ms = int(pd.Timedelta(int(number), unit).total_seconds() * 1000)
    held = events.withWatermark("at", late).groupBy("document_id")
    return held.applyInPandasWithState(stepper(retries, lease_ms), OUT, "job int, attempt int, stage string, status string, last long", "append", GroupStateTimeout.EventTimeTimeout)


def latest(changes: DataFrame) -> DataFrame:
    """The last state of each document's last job."""
    order = F.struct("job", "at", "attempt", F.when(F.col("status").isin("completed", "failed"), 2).when(F.col("status") == "processing", 1).otherwise(0))
    return changes.groupBy("document_id").agg(F.max_by(F.struct("job", "attempt", "status", "document_status", "error", "at"), order).alias("x")).select("document_id", "x.*")
