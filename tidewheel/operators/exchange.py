"""Exchanges that put records where their edge says; the partition a record is in is the downstream's number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from ..functions import keys


def hash_exchange(df: DataFrame, token: Column, n: int) -> DataFrame:
    """All records of a key in the partition that its token names; a null key fails the query."""
    return df.repartitionById(n, keys.hash_partition(token, n).cast("int"))


def forward_exchange(df: DataFrame, subtask: Column, n: int) -> DataFrame:
    """Each record in the partition of its upstream's number."""
    return df.repartitionById(n, keys.forward_partition(subtask, n).cast("int"))


def rebalance_exchange(df: DataFrame, n: int) -> DataFrame:
    """Even partitions, whatever the keys."""
    return df.repartition(n)
