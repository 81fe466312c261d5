"""Debounced changes: the last event of each path, once no other has come for a while.

State is keyed by path: the newest event and the time at which it is due. Each event moves the timer, so a path that keeps
changing waits and then comes once; a null content, a delete, is an event like any other. State and timers live in the
checkpoint: after a restart, what was waiting is still due. Timers need a state store that orders them (RocksDB), which is
set for the session where another is.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENT = "content string, modified timestamp, events long, due long"
OUT = "path string, content string, modified timestamp, events long"


def newer(a: tuple, b: tuple) -> bool:
    """Whether event a (content, modified) counts rather than b: the later, of two at once the greater, a delete last."""
    early = datetime.min
    return (a[1] or early, a[0] is not None, a[0] or "") > (b[1] or early, b[0] is not None, b[0] or "")


class Quiet(StatefulProcessor):
    def __init__(self, quiet: int) -> None:
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.event = handle, handle.getValueState("event", EVENT)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        held = self.event.get() if self.event.exists() else None
        content, modified, events = held[:3] if held else (None, None, 0)
        for row in rows:
            if not events or newer((row["content"], row["modified"]), (content, modified)):
                content, modified = row["content"], row["modified"]
            events += 1
        if held:
            self.handle.deleteTimer(held[3])
        due = timerValues.getCurrentProcessingTimeInMs() + self.quiet
        self.handle.registerTimer(due)
        self.event.update((content, modified, events, due))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if not self.event.exists():
            return
        content, modified, events, due = self.event.get()
        if due <= expiredTimerInfo.getExpiryTimeInMs():
            self.event.clear()
            yield Row(path=key[0], content=content, modified=modified, events=events)

    def close(self) -> None:
        pass


def debounced(source: DataFrame, quiet: int) -> DataFrame:
    """path, content, modified, events (how many became this one) of a stream of changes (path, content[, modified])."""
    spark = source.sparkSession
    if spark.conf.get(PROVIDER, "") != ROCKSDB:
        spark.conf.set(PROVIDER, ROCKSDB)
    modified = F.col("modified").cast("timestamp") if "modified" in source.columns else F.lit(None).cast("timestamp")
    events = source.filter(F.col("path").isNotNull()).select("path", "content", modified.alias("modified"))
    return events.groupBy("path").transformWithState(statefulProcessor=Quiet(quiet), outputStructType=OUT, outputMode="Append", timeMode="ProcessingTime")


def drained(source: DataFrame, quiet: int, out: str, checkpoint: str, every: str = "100 milliseconds") -> DataFrame:
    """Run a debounced stream until all input is read and nothing waits any more; its rows, as Parquet in `out`."""
    query = debounced(source, quiet).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
    try:
        while (p := query.lastProgress) is None or p["numInputRows"] or any(op["numRowsTotal"] for op in p["stateOperators"]):
            if query.exception():
                raise query.exception()
            time.sleep(0.1)
    finally:
        query.stop()
    return source.sparkSession.read.schema(OUT).parquet(out)
