"""Event streams as they arrive: pieces of many answers, cut anywhere, to whole events."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from ..operators import events


def _whole(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The whole blocks of a stream so far, and how many blocks went before; what is open, or came before its turn, waits in the state."""
    tail, n, turn, early = state.get if state.exists else ("", 0, 0, "{}")
    waiting = {int(k): v for k, v in json.loads(early).items()}
    for rows in batches:
        waiting.update((k, v) for k, v in zip(rows["seq"].tolist(), rows["piece"].tolist(), strict=True) if k >= turn)
    new = []
    while turn in waiting:
        new.append(waiting.pop(turn))
        turn += 1
    # A carriage return at the end may belong to a line break that the next piece ends.
    held, cut, tail = (tail + "".join(new)).replace("\r\n", "\n").rpartition("\n\n")
    state.update((tail, n + (held.count("\n\n") + 1 if cut else 0), turn, json.dumps(waiting)))
    if cut:
        yield pd.DataFrame({"stream": [key[0]], "first": [n], "said": [held + cut]})


def received(pieces: DataFrame) -> DataFrame:
    """stream, seq, event and data of a stream of pieces (stream string, seq long from 0, piece string), in whatever order and
    however often they come. What a cut leaves open is kept as the stream's state, so a restart goes on from there."""
    whole = pieces.groupBy("stream").applyInPandasWithState(_whole, "stream string, first long, said string", "tail string, n long, turn long, early string", "append", "NoTimeout")
    each = whole.select("stream", "first", F.posexplode(F.filter(F.split("said", "\n\n"), lambda b: b != "")).alias("i", "block"))
    return each.select("stream", (F.col("first") + F.col("i")).alias("seq"), F.inline(events.blocks(F.col("block"))))
