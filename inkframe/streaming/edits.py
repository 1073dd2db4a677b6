"""Undo and redo on a stream of edit events: the stacks of each scan are kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from inkframe.operators.edits import HISTORY, UNDO_CAP, History, history_rows

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _value(v) -> int | None:
    return None if v is None or pd.isna(v) else int(v)


class _Stacks(StatefulProcessor):
    """Both stacks as lists, and one row of what is current, held since focus, being placed, and the last event seen."""

    def __init__(self, cap: int):
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        entry = "version long, mark long"
        self.undo, self.redo = handle.getListState("undo", entry), handle.getListState("redo", entry)
        self.rest = handle.getValueState("rest", "now long, held long, placed long, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows))  # of one scan in one batch
        now, held, placed, last = map(_value, self.rest.get()) if self.rest.exists() else (None,) * 4
        if last is not None:
            events = events[events["seq"] > last]
        if events.empty:
            return
        stack = lambda state: [tuple(map(_value, e)) for e in state.get()] if state.exists() else []
        kept = History(stack(self.undo), stack(self.redo), now, held, placed)
        yield history_rows(key[0], events, kept, self.cap)
        for state, entries in ((self.undo, kept.undo), (self.redo, kept.redo)):
            state.put(entries) if entries else state.clear()
        self.rest.update((kept.now, kept.held, kept.placed, int(events["seq"].max())))

    def close(self) -> None:
        pass


def history_stream(events: DataFrame, cap: int = UNDO_CAP) -> DataFrame:
    """operators.edits.history on a stream of events (scan_id, seq, kind, version): a row per event, whatever the batches.

    A scan's events must come in order of seq from batch to batch; within one they are put in order. One whose seq is
    not above the last of an earlier batch is dropped, so a repeated event counts once. State a scan: at most twice
    the cap of entries. The state store must be RocksDB's (see start).
    """
    keyed = events.select("scan_id", "seq", "kind", "version").groupBy("scan_id")
    return keyed.transformWithStateInPandas(_Stacks(cap), HISTORY, "Append", "None")


def start(events: DataFrame, path: str, checkpoint: str, cap: int = UNDO_CAP, **trigger) -> StreamingQuery:
    """Writes the history of a stream of events as Parquet under path. A query keeps the settings that it was started with, so the session's state store is set for the start only."""
    spark = events.sparkSession
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        out = history_stream(events, cap).writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        return (out.trigger(**trigger) if trigger else out).start()
    finally:
        spark.conf.set(_PROVIDER, before)


__all__ = ["history_stream", "start"]
