"""Upload sessions as state with timers, and the progress of streams as a log.

A user's files come one by one; a session is complete when every kind has come, and one that is not complete a day after it was opened
expires. The clock is the stream's event time, so a replay gives the same sessions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from ..operators import store

#: The kinds of files that a session collects, in the order in which they are asked for, and its hours.
KINDS = ("BASKET", "PAYMENTS", "ACCOUNTS", "SHIPMENTS")
TTL_HOURS = 24
STATUS = "user_id string, opened_at timestamp, status string, waiting_for string, files int, replaced boolean"


class Sessions(StatefulProcessor):
    """State of a user: when the open session began, and its files by kind."""

    def __init__(self, ttl_hours: int = TTL_HOURS):
        self.ttl = ttl_hours * 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.opened = handle.getValueState("opened", T.StructType([T.StructField("at", T.LongType())]))
        self.files = handle.getMapState("files", T.StructType([T.StructField("kind", T.StringType())]), T.StructType([T.StructField("name", T.StringType())]))

    def _row(self, user: str, at: int, status: str, waiting: str | None, files: int, replaced: bool = False) -> tuple:
        return (user, pd.Timestamp(at, unit="ms"), status, waiting, files, replaced)

    def _end(self, timer: int) -> None:
        self.opened.clear()
        self.files.clear()
        self.handle.deleteTimer(timer)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - names of the interface
        out = []
        came = pd.concat(list(rows)).sort_values(["at", "file_name"], kind="stable")
        for at, kind, name in zip(came["at"].astype("datetime64[ms]").astype("int64"), came["kind"], came["file_name"], strict=True):
            begun = self.opened.get()[0] if self.opened.exists() else None
            if begun is not None and at - begun > self.ttl:  # the file is later than the timer that has not fired yet
                out.append(self._row(key[0], begun, "EXPIRED", None, sum(1 for _ in self.files.keys())))
                self._end(begun + self.ttl)
                begun = None
            if begun is None:
                begun = int(at)
                self.opened.update((begun,))
                self.handle.registerTimer(begun + self.ttl)
            replaced = self.files.containsKey((kind,))
            self.files.updateValue((kind,), (name,))
            have = {k[0] for k in self.files.keys()}
            waiting = next((k for k in KINDS if k not in have), None)
            out.append(self._row(key[0], begun, "WAITING" if waiting else "COMPLETE", waiting, len(have), replaced))
            if waiting is None:
                self._end(begun + self.ttl)
        yield pd.DataFrame(out, columns=[f.split()[0] for f in STATUS.split(", ")])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.opened.exists():
            begun = self.opened.get()[0]
            yield pd.DataFrame([self._row(key[0], begun, "EXPIRED", None, sum(1 for _ in self.files.keys()))], columns=[f.split()[0] for f in STATUS.split(", ")])
            self.opened.clear()
            self.files.clear()

    def close(self) -> None:
        pass


def sessions(files: DataFrame, late: str = "10 minutes", ttl_hours: int = TTL_HOURS) -> DataFrame:
    """A stream of files (user_id, kind, file_name, at) -> a row for each file and each session that expires (STATUS).

    A file of a kind that has come replaces it; one that comes after its session has expired opens a new one. Needs the RocksDB state store.
    """
    timed = files.select("user_id", "kind", "file_name", "at").withWatermark("at", late)
    return timed.groupBy("user_id").transformWithStateInPandas(Sessions(ttl_hours), outputStructType=STATUS, outputMode="Append", timeMode="EventTime")


class ProgressLog(StreamingQueryListener):
    """Appends a row to a log for every batch of every stream of a session, and one for every end."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _add(self, event: str, query: str, batch: int | None, rows: int | None, ms: int | None, note: str | None) -> None:
        entry = [(event, query, batch, rows, ms, note)]
        store.append_log(self.spark.createDataFrame(entry, "event string, query string, batch long, rows long, ms long, note string"), self.root)

    def onQueryStarted(self, event: object) -> None:  # noqa: N802
        self._add("STARTED", str(event.id), None, None, None, event.name)

    def onQueryProgress(self, event: object) -> None:  # noqa: N802
        p = event.progress
        self._add("BATCH", str(p.id), p.batchId, p.numInputRows, p.durationMs.get("triggerExecution"), p.name)

    def onQueryIdle(self, event: object) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event: object) -> None:  # noqa: N802
        self._add("ENDED", str(event.id), None, None, None, event.exception)
