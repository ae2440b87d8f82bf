"""Map, filter, key-by, merge and branch over envelopes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import udfs


def map_native(df: DataFrame, payload: Column) -> DataFrame:
    """1 to 1 on the payload; null drops the record."""
    return df.withColumn("payload", payload).where("payload is not null")


def map_python(df: DataFrame, fn: Callable) -> DataFrame:
    return df.withColumn("payload", udfs.map_json(fn, F.col("payload"))).where("payload is not null")


def key_native(df: DataFrame, key: Column) -> DataFrame:
    """Set the key; a null key fails the query."""
    kind = df.select(key.alias("k")).schema["k"].dataType
    return df.withColumn("key", F.when(key.isNull(), F.raise_error(F.lit("key selector returned null")).cast(kind)).otherwise(key))


def key_python(df: DataFrame, fn: Callable) -> DataFrame:
    return df.withColumn("key", udfs.key_json(fn, F.col("payload")))


def merge(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Bag union by column name."""
    for df in others:
        first = first.unionByName(df, allowMissingColumns=True)
    return first
