"""From tab activity to page visits: how long was a page looked at?"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as st
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from trailmark import schemas
from trailmark.operators import admission, scale
from trailmark.session import ROCKSDB_PROVIDER

MIN_DWELL_SECONDS = 30.0

_STATE = st.StructType([
    st.StructField("start", st.LongType()), st.StructField("url", st.StringType()),
    st.StructField("title", st.StringType()), st.StructField("processed", st.BooleanType()),
    st.StructField("last", st.LongType()),
])


def trackable(events: DataFrame) -> DataFrame:
    """Drops the URL of tab events whose page must not be captured."""
    blocked = F.coalesce(admission.capture_blocked(F.col("url")), F.lit(True))
    return events.withColumn("url", F.when(~blocked, F.col("url")))


class DwellProcessor(StatefulProcessor):
    """One small state per tab: start, url, title, whether the visit was already reported, time of the last event.

    A visit is reported once, when its dwell time reaches the threshold: on navigation, on close, or
    on an alarm event. A page that may not be captured neither ends nor replaces the visit before it.
    With `timers` a visit is reported as soon as event time passes its threshold, with that dwell time, however
    the rows fall into micro-batches. The state of a tab without events for `ttl_seconds` of event time is dropped.
    """

    def __init__(self, min_seconds: float = MIN_DWELL_SECONDS, timers: bool = False, ttl_seconds: float | None = None):
        self.min_micros = int(min_seconds * 1_000_000)
        self.timers = timers
        self.ttl_micros = None if ttl_seconds is None else int(ttl_seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tab = handle.getValueState("tab", _STATE)

    def _due(self, current: list | None) -> int | None:
        """When the visit reaches the threshold, if it is still to be reported."""
        if self.timers and current and current[1] is not None and not current[3]:
            return current[0] + self.min_micros
        return None

    def _keep(self, current: list | None) -> None:
        if current is None:
            self.tab.clear()
            return
        self.tab.update(tuple(current))
        due = self._due(current)
        if due is not None:
            self.handle.registerTimer(-(-due // 1000))
        if self.ttl_micros is not None:
            self.handle.registerTimer(-(-(current[4] + self.ttl_micros) // 1000))

    @staticmethod
    def _frame(out: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=["tab_id", "url", "title", "start", "dwell_seconds"])
        frame["start"] = pd.to_datetime(frame["start"], unit="us", utc=True)
        return frame

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        current = self.tab.get() if self.tab.exists() else None
        if current is None:
            return
        current, now, out = list(current), expiredTimerInfo.getExpiryTimeInMs() * 1000, []
        due = self._due(current)
        if due is not None and due <= now:
            out.append((key[0], current[1], current[2], current[0], self.min_micros / 1e6))
            current[3] = True
        if self.ttl_micros is not None and current[4] + self.ttl_micros <= now:
            self.tab.clear()
        else:
            self.tab.update(tuple(current))
        if out:
            yield self._frame(out)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        current = self.tab.get() if self.tab.exists() else None
        current = list(current) if current is not None else None
        # The rows of one tab in one trigger, in time order.
        batch = pd.concat(list(rows)).sort_values(["micros", "seq"], kind="stable")
        out = []

        def report(now: int) -> bool:
            if current and current[1] is not None and not current[3] and now - current[0] >= self.min_micros:
                out.append((key[0], current[1], current[2], current[0], (now - current[0]) / 1e6))
                return True
            return False

        for micros, kind, url, title in zip(batch["micros"], batch["kind"], batch["url"], batch["title"]):
            micros = int(micros)
            known = isinstance(url, str)
            if current and self.ttl_micros is not None and current[4] + self.ttl_micros <= micros:
                due = self._due(current)
                if due is not None and due <= micros:
                    report(due)
                current = None
            due = self._due(current)
            if due is not None and due <= micros:
                report(due)
                current[3] = True
            if kind == "updated" and known:
                report(micros)
                current = [micros, url, title, False, micros]
            elif kind == "activated":
                if current is None:
                    current = [micros, None, None, False, micros]
                if known:
                    current[1], current[2] = url, title
            elif kind == "removed":
                report(micros)
                current = None
            elif kind == "alarm" and report(micros):
                current[3] = True
            if current:
                current[4] = micros

        self._keep(current)
        if out:
            yield self._frame(out)

    def close(self) -> None:
        pass


def stream_dwell(
    events: DataFrame, min_seconds: float = MIN_DWELL_SECONDS, timers: bool = False, ttl_seconds: float | None = None,
    late: str = "0 seconds",
) -> DataFrame:
    """Visits (schema DWELL) from a stream of tab events with a `seq` column for equal times.

    `timers` and `ttl_seconds` follow the watermark, which stays `late` behind the newest event.
    """
    # The processor is also loaded outside the executors, where shipped files are not on the path.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    timed = timers or ttl_seconds is not None
    rows = trackable(events.withWatermark("ts", late) if timed else events).select(
        "tab_id", F.unix_micros("ts").alias("micros"), "seq", "kind", "url", "title", *["ts"] * timed
    )
    return rows.groupBy("tab_id").transformWithStateInPandas(
        statefulProcessor=DwellProcessor(min_seconds, timers, ttl_seconds), outputStructType=schemas.DWELL,
        outputMode="Append", timeMode="EventTime" if timed else "None",
    )


def batch_dwell(events: DataFrame, min_seconds: float = MIN_DWELL_SECONDS) -> DataFrame:
    """The same visits from a finished table of navigations and closes.

    Every event looks back to the navigation before it in its tab, hour by hour, so that a tab with
    very many events is not one task.
    """
    kept = trackable(events).filter((F.col("kind") == "removed") | ((F.col("kind") == "updated") & F.col("url").isNotNull()))
    opened = F.struct("ts", F.col("kind"), "url", "title")
    chained = scale.carry_forward(kept, ["tab_id"], F.date_trunc("hour", "ts"), ["ts", "seq"], opened, "before")
    dwell = (F.unix_micros("ts") - F.unix_micros("before.ts")) / 1e6
    return (
        chained.filter((F.col("before.kind") == "updated") & (dwell >= min_seconds))
        .select("tab_id", F.col("before.url").alias("url"), F.col("before.title").alias("title"),
                F.col("before.ts").alias("start"), dwell.alias("dwell_seconds"))
    )
