"""The streaming reduce: processing-time timers, late rows emitted again, idle firing.

Event-time watermarks would drop late rows and wait for input, so a stateful processor keeps the windows of each key
and sets a timer at each window's end; a timer in the past fires within the same micro-batch.  A window's state is its
accumulator with the id and headers of its first record, which the emitted record carries on.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import udfs

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "key string, window_start_ms bigint, window_end_ms bigint, payload string, record_id string, headers string, fired_ms bigint"


def configure(spark: SparkSession) -> None:
    """Session settings that the stateful reduce needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    spark.conf.set("spark.sql.session.timeZone", "UTC")


class WindowReducer(StatefulProcessor):
    """Input rows: key, window_start_ms, payload (JSON), record_id, headers (JSON)."""

    def __init__(self, fn: Callable, size_ms: int):
        self.fn, self.size_ms = udfs.checked(fn, "reduce"), size_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.windows = handle.getMapState("windows", "start_ms bigint", "payload string, record_id string, headers string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """One state update per window: the batch's records of a window are folded in memory, in record order."""
        frame = pd.concat(list(rows))
        for start, group in frame.sort_values(["part", "place", "record_id"]).groupby("window_start_ms", sort=True):
            at, payloads = (int(start),), group["payload"].tolist()
            held = self.windows.getValue(at) if self.windows.containsKey(at) else None
            first = held[1:] if held else (group["record_id"].iloc[0], group["headers"].iloc[0])
            self.windows.updateValue(at, (udfs.fold_json(self.fn, [held[0], *payloads] if held else payloads), *first))
            self.handle.registerTimer(int(start) + self.size_ms)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        start = int(expiredTimerInfo.getExpiryTimeInMs()) - self.size_ms
        if self.windows.containsKey((start,)):
            payload, record_id, headers = self.windows.getValue((start,))
            self.windows.removeKey((start,))
            fired = int(timerValues.getCurrentProcessingTimeInMs())
            yield pd.DataFrame({"key": [key[0]], "window_start_ms": [start], "window_end_ms": [start + self.size_ms], "payload": [payload], "record_id": [record_id], "headers": [headers], "fired_ms": [fired]})

    def close(self) -> None:
        """Open windows stay in the checkpoint; nothing is emitted."""


def reduce_stream(df: DataFrame, fn: Callable, size_ms: int) -> DataFrame:
    """df: key, processing_time, payload (JSON), and where there are any record_id and headers, as a stream."""
    millis = F.floor(F.unix_micros(F.col("processing_time")) / 1000).cast("bigint")
    record_id = F.col("record_id") if "record_id" in df.columns else F.lit("")
    headers = F.to_json("headers") if "headers" in df.columns else F.lit("{}")
    part = lambda k: F.coalesce(F.try_element_at(F.split(record_id, ":"), F.lit(k)).try_cast("bigint"), F.lit(-1))
    own = df.select(F.col("key").cast("string").alias("key"), (millis - F.pmod(millis, F.lit(size_ms))).alias("window_start_ms"), "payload", record_id.alias("record_id"), headers.alias("headers"), part(-2).alias("part"), part(-1).alias("place"))
    return own.groupBy("key").transformWithStateInPandas(WindowReducer(fn, size_ms), OUTPUT, "Append", "ProcessingTime")


def merge_word_counts(total, more):
    """A reducer of word counts: both sides must be objects about one word with whole counts."""
    for side in (total, more):
        if not isinstance(side, dict) or type(side.get("count")) is not int:
            raise ValueError("a word count needs a word and a whole count")
    if total.get("word") != more.get("word"):
        raise ValueError("counts of different words")
    return {**total, "count": total["count"] + more["count"]}


def word_rows(out: DataFrame) -> DataFrame:
    """window_end, word, count from reduced word payloads."""
    got = F.from_json("payload", "word string, count bigint")
    end = F.date_format(F.timestamp_millis("window_end_ms"), "yyyy/MM/dd'T'HH:mm:ss")
    return out.select(end.alias("window_end"), got["word"].alias("word"), got["count"].alias("count"))


#: Job states and the states that may follow each.
STATES = {"SUBMITTED": ("RUNNING", "FAILED", "CANCELLED"), "RUNNING": ("FINISHED", "FAILED", "CANCELLED"), "FINISHED": (), "FAILED": (), "CANCELLED": ()}


def status(query, cancelled: bool = False) -> dict:
    """A query's state under the usual job names; cancelled: whether the caller has stopped it."""
    progress = query.lastProgress
    state = "FAILED" if query.exception() else ("RUNNING" if progress else "SUBMITTED") if query.isActive else "CANCELLED" if cancelled else "FINISHED"
    return {"status": state, "records_in": progress["numInputRows"] if progress else 0, "state": json.loads(progress.json)["stateOperators"] if progress else []}


def drained(query, rows: int) -> bool:
    """Whether so many input rows have been taken and no window waits; a failed query raises."""
    if error := query.exception():
        raise error
    progress = query.recentProgress
    return sum(p["numInputRows"] for p in progress) >= rows and bool(progress) and all(s["numRowsTotal"] == 0 for s in progress[-1]["stateOperators"])
