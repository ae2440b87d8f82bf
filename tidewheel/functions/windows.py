"""Epoch-aligned tumbling windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STAMP = "yyyy/MM/dd'T'HH:mm:ss"


def window_start(ts: Column, size_ms: int) -> Column:
    """Start of the window that holds ts (a UTC timestamp), exact for any size and before 1970."""
    micros, size = F.unix_micros(ts.cast("timestamp")), size_ms * 1000
    return F.timestamp_micros(micros - F.pmod(micros, F.lit(size)))


def window_end(ts: Column, size_ms: int) -> Column:
    return F.timestamp_micros(F.unix_micros(window_start(ts, size_ms)) + size_ms * 1000)


def stamp(ts: Column) -> Column:
    return F.date_format(ts, STAMP)
