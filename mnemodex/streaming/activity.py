"""Spans of activity of each user: keyed state with a lifetime, ended by a timer, and the same spans from a table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_STATE = "first long, last long, event_id long, event_type string"
#: Columns of a span: its first and last time, its last event, and whether more can follow.
SPAN = "user_id long, first timestamp, last timestamp, event_id long, event_type string, open boolean"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _joined(spans: list[tuple], life: int) -> list[tuple]:
    """Spans (first, last, event_id, event_type) whose distance is under ``life`` made one. The later last event stands, the greater id of equal times."""
    out: list[tuple] = []
    for span in sorted(spans):
        if out and span[0] - out[-1][1] < life:
            first, newest = out[-1][0], max(out[-1][1:], span[1:], key=lambda s: (s[0], s[1]))
            out[-1] = (first, *newest)
        else:
            out.append(span)
    return out


class _Spans(StatefulProcessor):
    """The open spans of a user, few numbers each, however many events they have."""

    def __init__(self, life: int) -> None:
        self.life = life  # microseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getListState("spans", _STATE)

    def _keep(self, spans: list[tuple]) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        if not spans:
            self.state.clear()
            return
        self.state.put(spans)
        self.handle.registerTimer(-(-(min(s[1] for s in spans) + self.life) // 1000))

    def _rows(self, key, spans: list[tuple], open_: bool) -> pd.DataFrame:
        rows = pd.DataFrame(spans, columns=["first", "last", "event_id", "event_type"])
        for name in ("first", "last"):
            rows[name] = pd.to_datetime(rows[name], unit="us", utc=True)
        return rows.assign(user_id=key[0], open=open_)[["user_id", "first", "last", "event_id", "event_type", "open"]]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        had = [tuple(s) for s in self.state.get()]
        spans = list(had)
        for chunk in rows:  # a chunk at a time, so a user with very many events is never held whole
            spans = _joined([*spans, *zip(chunk["us"].tolist(), chunk["us"].tolist(), chunk["event_id"].tolist(), chunk["event_type"].tolist())], self.life)
        self._keep(spans)
        if new := [s for s in spans if s not in had]:
            yield self._rows(key, new, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        spans = [tuple(s) for s in self.state.get()]
        ended = [s for s in spans if s[1] + self.life <= now]
        self._keep([s for s in spans if s[1] + self.life > now])
        if ended:
            yield self._rows(key, ended, False)

    def close(self) -> None:
        pass


def _named(events: DataFrame) -> DataFrame:
    return events.filter("user_id is not null and ts is not null and event_id is not null")


def spans(events: DataFrame, life: int) -> DataFrame:
    """(user_id, first, last, event_id, event_type) of a table: spans of events of one user, each less than ``life`` seconds after the one before. Repeated events change nothing;
    events without a user, a time or an id take no part."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = _named(events).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    rows = rows.withColumn("start", F.coalesce(F.col("at") - F.lag("at").over(by) >= life * 1_000_000, F.lit(True)).cast("int"))
    rows = rows.withColumn("span", F.sum("start").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.max_by(F.struct("ts", "event_id", "event_type"), F.struct("ts", "event_id"))
    found = rows.groupBy("user_id", "span").agg(F.min("ts").alias("first"), last.alias("l"))
    return found.select("user_id", "first", F.col("l.ts").alias("last"), "l.event_id", "l.event_type")


def follow(events: DataFrame, life: int, late: str = "2 days") -> DataFrame:
    """The spans (see ``SPAN``) of a stream: an open one whenever it has grown, a closed one once the watermark is ``life`` seconds past its last event; then the state of the user goes.

    Rows later than ``late`` are dropped by the watermark, others count wherever they fall, so closed spans are those of ``spans``. A batch touches the users it has and those whose
    timers end. Needs the RocksDB state store (``state_store``); write it in the mode ``update``.
    """
    rows = _named(events).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    rows = rows.select("user_id", "event_id", "event_type", "at", F.unix_micros("at").alias("us"))
    return rows.groupBy("user_id").transformWithStateInPandas(_Spans(life * 1_000_000), outputStructType=SPAN, outputMode="Update", timeMode="EventTime")


def state_store(spark) -> None:
    """Use the state store that ``follow`` needs for the streams that this session starts from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
