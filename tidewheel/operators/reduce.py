"""Keyed tumbling-window reduce in replay mode.

processing_time is the source-side stamp that decides the window.  `clock`, where given, is the reduce-side time: windows
that end after it are still open and yield nothing, as at the end of a stream.  A reducer that is declared (sum, count, min,
max, first) becomes a native aggregate with map-side partial sums; anything else is a fold in record order.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import udfs, windows

def record_order(record_id: Column | None = None) -> Column:
    """The order in which a topic gave its records: by partition and offset, the last two parts of the id, as numbers."""
    record_id = F.col("record_id") if record_id is None else record_id
    part = lambda k: F.try_element_at(F.split(record_id, ":"), F.lit(k)).try_cast("bigint")
    return F.struct(part(-2).alias("partition"), part(-1).alias("offset"), record_id.alias("id"))


DECLARED = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count}


def assign(df: DataFrame, size_ms: int, clock: datetime | None = None, flush_open_windows: bool = False) -> DataFrame:
    """Add window_start and window_end; without flush, windows still open at the clock are dropped."""
    out = df.withColumn("window_start", windows.window_start(F.col("processing_time"), size_ms)).withColumn("window_end", windows.window_end(F.col("processing_time"), size_ms))
    return out if clock is None or flush_open_windows else out.where(F.col("window_end") <= F.lit(clock))


def declared(df: DataFrame, size_ms: int, aggregates: dict[str, tuple[str, Column]], *, order: Column | None = None, clock: datetime | None = None) -> DataFrame:
    """One row per window and key. aggregates: name -> (kind, value); `first` takes the first value in record order."""
    order = record_order() if order is None else order
    made = [(F.min_by(value, order) if kind == "first" else DECLARED[kind](value)).alias(name) for name, (kind, value) in aggregates.items()]
    return assign(df, size_ms, clock).groupBy("window_start", "window_end", "key").agg(*made)


def ordered_fold(df: DataFrame, size_ms: int, value: Column, order: Column | None, step: Callable[[Column, Column], Column], *, name: str = "payload", clock: datetime | None = None) -> DataFrame:
    """acc := first value; acc := step(acc, value) for the others in order. A window's values of a key must fit one task."""
    order = record_order() if order is None else order
    items = F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v"))))
    held = assign(df, size_ms, clock).groupBy("window_start", "window_end", "key").agg(items.alias("_items"))
    values = F.transform("_items", lambda x: x["v"])
    folded = F.aggregate(F.slice(values, 2, F.size(values)), values[0], step)
    return held.select("window_start", "window_end", "key", folded.alias(name))


def python_fold(df: DataFrame, size_ms: int, fn: Callable, *, order: Column | None = None, head: Column | None = None, clock: datetime | None = None) -> DataFrame:
    """The fold with a user function over JSON payloads; opaque, so each group goes to one Python task.

    head: a string of each record; that of the first record comes out as `head`.
    """
    fn = udfs.checked(fn, "reduce")

    def fold(key, rows):
        rows = rows.sort_values("_rank")
        return pd.DataFrame({"window_start": [key[0]], "window_end": [key[1]], "key": [key[2]], "payload": [udfs.fold_json(fn, rows["payload"].tolist())], "head": [rows["head"].iloc[0]]})

    within = Window.partitionBy("window_start", "window_end", "key").orderBy(record_order() if order is None else order)
    head = F.lit(None).cast("string") if head is None else head
    own = assign(df, size_ms, clock).withColumn("_rank", F.row_number().over(within)).select("window_start", "window_end", "key", "payload", "_rank", head.alias("head"))
    return own.groupBy("window_start", "window_end", "key").applyInPandas(fold, "window_start timestamp, window_end timestamp, key string, payload string, head string")


def with_late_rows(df: DataFrame, size_ms: int, arrival: Column, kind: str, value: Column, *, name: str = "total") -> DataFrame:
    """Records that arrive after their window fired give a row of their own each; the others are reduced."""
    placed = assign(df, size_ms).withColumn("_late", arrival.cast("timestamp") >= F.col("window_end"))
    on_time = placed.where("not _late").groupBy("window_start", "window_end", "key").agg(DECLARED[kind](value).alias(name))
    one = F.lit(1).cast("bigint") if kind == "count" else value
    return on_time.unionByName(placed.where("_late").select("window_start", "window_end", "key", one.alias(name)))


def emitted(df: DataFrame, size_ms: int, kind: str, value: Column, fired_at: Column, *, order: Column | None = None) -> DataFrame:
    """Envelope rows as a reduce emits them: id and headers of the first record, window bounds in the headers."""
    order = record_order() if order is None else order
    head = F.struct("record_id", "headers")
    made = F.min_by(value, order) if kind == "first" else DECLARED[kind](value)
    out = assign(df, size_ms).groupBy("window_start", "window_end", "key").agg(made.alias("payload"), F.min_by(head, order).alias("_head"))
    bounds = {n: windows.stamp(F.col(n)) for n in ("window_start", "window_end")}
    headers = F.col("_head.headers").withField("window_start", bounds["window_start"]).withField("window_end", bounds["window_end"])
    return out.select(F.col("_head.record_id").alias("record_id"), "payload", fired_at.alias("processing_time"), "key", headers.alias("headers"), "window_end")


def state_metrics(df: DataFrame, size_ms: int, clock: datetime) -> DataFrame:
    """state_entries and active_windows at the clock: what windows that haven't fired hold."""
    seen = assign(df.where(F.col("processing_time") <= F.lit(clock)), size_ms)
    live = seen.where(F.col("window_end") > F.lit(clock)).select("window_start", "key").distinct()
    return live.agg(F.count("*").alias("state_entries"), F.count_distinct("window_start").alias("active_windows"))

