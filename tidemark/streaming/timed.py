"""Impression and click history in event time, for streams whose rows come out of order.

A key's rows wait in the state store until the watermark has passed their hour; an event-time timer
of the key's earliest waiting hour then closes all hours that the watermark has passed, puts their
rows in order and emits them with their history, which so is that of a batch over the same rows. So
waiting rows are read once for each advance of the watermark, not once for each hour. Rows whose hour was closed before they came change nothing: the same
operator emits them, marked late. Watermark, timers and waiting rows are in the checkpoint, so that
a restarted query goes on as if it had not stopped. Input is handled chunk by chunk; what a task
holds at a time is the rows of one key in one hour.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.sources.impressions import shared_folder
from tidemark.streaming.history import ROCKSDB

HOUR = 3_600_000
_COLUMNS = ["event_id", "late", "prior_impressions", "hours_since_previous", "prior_in_hour", "prior_clicks", "prior_nonclicks", "hours_since_click", "impressions_since_click", "click_pattern"]
SCHEMA = "event_id long, late boolean, " + ", ".join(f"{c} long" for c in _COLUMNS[2:])
_STATE = ["total", "last", "n", "pos", "clicked", "since", "pattern", "length", "labelled"]


class TimedHistory(StatefulProcessor):
    """Rows ``event_id, hour_no, click, scoring`` of a key; scoring rows read the state and count as impressions only."""

    def __init__(self, bits: int = 4):
        self.bits = bits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("past", ", ".join(f"{c} long" for c in _STATE))
        self.waiting = handle.getListState("waiting", "hour long, event long, click long, scoring boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        closed = timerValues.getCurrentWatermarkInMs() // HOUR  # hours before it
        earliest = None
        for chunk in rows:
            late = chunk[chunk["hour_no"] < closed]
            if len(late):
                yield pd.DataFrame({"event_id": late["event_id"], "late": True}).reindex(columns=_COLUMNS).astype({c: "Int64" for c in _COLUMNS[2:]})
            kept = chunk[chunk["hour_no"] >= closed]
            new = list(zip(kept["hour_no"].tolist(), kept["event_id"].tolist(), kept["click"].tolist(), kept["scoring"].tolist(), strict=True))
            if new:
                self.waiting.appendList(new)
                earliest = min(r[0] for r in new) if earliest is None else min(earliest, min(r[0] for r in new))
        if earliest is not None:
            self.handle.registerTimer((earliest + 1) * HOUR)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) // HOUR  # hours before it
        due, rest = [], []
        for r in self.waiting.get():
            (due if r[0] < until else rest).append(tuple(r))
        if not due:
            return
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer((min(r[0] for r in rest) + 1) * HOUR)
        else:
            self.waiting.clear()
        due.sort(key=lambda r: (r[0], r[3], r[1]))  # scoring rows of an hour come last
        s = dict(zip(_STATE, self.state.get() if self.state.exists() else (0, -1, 0, 0, 0, 0, 0, 0, 0), strict=True))
        out, at = [], 0
        while at < len(due):
            hour, end = due[at][0], at
            while end < len(due) and due[end][0] == hour:
                end += 1
            out += self._hour(s, hour, due[at:end])
            at = end
        self.state.update(tuple(int(s[c]) for c in _STATE))
        yield pd.DataFrame(out, columns=_COLUMNS).astype({c: "Int64" for c in _COLUMNS[2:]})

    def _hour(self, s: dict, hour: int, rows: list[tuple]) -> list[tuple]:
        past = s["pos"], s["n"] - s["pos"], hour - s["clicked"] if s["pos"] else 0, s["since"], (s["length"] << self.bits) | s["pattern"]
        out = []
        for k, (_, event, _, _) in enumerate(rows):
            out.append((event, False, s["total"] + k, hour - s["last"] if not k and s["total"] else 0, k, *past))
        s["total"], s["last"] = s["total"] + len(rows), hour
        labels = [r[2] for r in rows if not r[3]]
        if labels:  # the hour is complete: its labels count from now on
            hit, gap = sum(labels) > 0, hour - s["labelled"] if s["n"] else 1
            s["pattern"] = ((s["pattern"] << min(gap, self.bits)) | hit) & ((1 << self.bits) - 1)
            s["length"] = min(s["length"] + gap, self.bits)
            s["n"], s["pos"] = s["n"] + len(labels), s["pos"] + sum(labels)
            s["since"], s["clicked"] = (0, hour) if hit else (s["since"] + len(labels), s["clicked"])
            s["labelled"] = hour
        return out

    def close(self) -> None:
        pass


def timed_history(events: DataFrame, allowed_hours: int, scoring_from: int, key: str = "user_id", bits: int = 4) -> DataFrame:
    """History of all rows in hours that the watermark, ``allowed_hours`` behind the newest row, has passed."""
    hour = F.floor(F.unix_timestamp("ts") / 3600)
    rows = events.withWatermark("ts", f"{allowed_hours} hours")
    # without the time column, which would let Spark drop late rows before they can be told
    rows = rows.select(key, "event_id", hour.alias("hour_no"), (F.col("event_type") == "click").cast("long").alias("click"), (hour >= scoring_from).alias("scoring"))
    return rows.groupBy(key).transformWithStateInPandas(TimedHistory(bits), SCHEMA, "append", "eventTime")


def run_arrivals(make: Callable[[], DataFrame], arrivals: Sequence[Callable[[], None]]) -> DataFrame:
    """Starts the stream anew from its checkpoint after each arrival of files; returns all that it wrote.

    The session's state store is set for the runs only.
    """
    name = "spark.sql.streaming.stateStore.providerClass"
    out, spark, before = None, None, None
    for k, arrive in enumerate(arrivals):
        arrive()
        df = make()
        if spark is None:
            spark, folder = df.sparkSession, shared_folder(df.sparkSession)
            before = spark.conf.get(name, None)
            spark.conf.set(name, ROCKSDB)
        try:
            query = df.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
            query.awaitTermination()
        finally:
            if k == len(arrivals) - 1:
                spark.conf.set(name, before) if before else spark.conf.unset(name)
        out = df.schema
    return spark.read.schema(out).parquet(f"{folder}/out")
