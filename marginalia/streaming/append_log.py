"""A keyed append log: turns that come as a stream are numbered on within their session, across triggers and restarts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

#: The state store that keyed state needs.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_STATE = StructType([StructField("last", LongType())])


class _Numbers(StatefulProcessor):
    """The state of a session is the number of its last turn."""

    def __init__(self, expire_ms: int | None):
        self.expire_ms = expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", _STATE, self.expire_ms)

    def handleInitialState(self, key, rows: pd.DataFrame, timers) -> None:
        self.last.update((int(rows["last"].iloc[0]),))

    def handleInputRows(self, key, batches: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["at", "question", "answer"], kind="stable", na_position="first")  # a session's turns of one trigger
        last = int(self.last.get()[0]) if self.last.exists() else 0
        self.last.update((last + len(rows),))
        yield pd.DataFrame({"session_id": rows["session_id"], "turn_index": range(last + 1, last + 1 + len(rows)), "question": rows["question"], "answer": rows["answer"]})

    def close(self) -> None:
        pass


def numbered(new: DataFrame, turns: DataFrame | None = None, expire_ms: int | None = None) -> DataFrame:
    """(session_id, turn_index, question, answer) from a stream of (session_id, at, question, answer): as ``sessions.appended`` numbers a batch, each turn behind all of earlier triggers.

    ``turns``: a stored table of turns, behind whose last ones each session goes on. State is one number a session; with ``expire_ms`` a session that had no turn for so long is
    forgotten and begins anew, so it should be longer than any session rests. Rows with a null session_id are left out. Needs the state store ``STORE``.
    """
    rows = new.filter("session_id IS NOT NULL").select("session_id", "at", "question", "answer").groupBy("session_id")
    kind = new.schema["session_id"].dataType.simpleString()
    start = None if turns is None else turns.groupBy("session_id").agg(F.max("turn_index").cast("bigint").alias("last")).groupBy("session_id")
    mode = "ProcessingTime" if expire_ms else "None"
    return rows.transformWithStateInPandas(_Numbers(expire_ms), f"session_id {kind}, turn_index bigint, question string, answer string", "Append", mode, start)
