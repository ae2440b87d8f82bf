"""Filters by sets of ids that go to every task, so that rows with long texts are not shuffled to meet their ids."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, stash

#: Bits of a filter for each id at least, and in all at most (32 MB): with more ids a filter lets more others through.
BITS_EACH, MOST_BITS = 16, 1 << 28
#: Ids that are sent as they are (8 MB).
HELD = 1 << 20


def bits_of(ids: DataFrame, level: int = 0) -> tuple[int, np.ndarray]:
    """(modulus, words of 64 bits), with the bit of each id's hash set; ids: one column, null is an id too.

    Each level has an odd modulus of its own: ids that meet in one filter need not meet in the next.
    """
    col, size = ids.columns[0], 256
    n = ids.agg(F.approx_count_distinct(col)).first()[0]
    while size < min(MOST_BITS, BITS_EACH * n):
        size *= 2
    modulus = size - 1 - 2 * level
    slots = ids.select(F.pmod(F.xxhash64(col), F.lit(modulus)).alias("s"))
    words = slots.groupBy(F.shiftright("s", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(s & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return modulus, out


def has(bits: tuple[int, np.ndarray], hashes: np.ndarray) -> np.ndarray:
    """Whether the bits of the hashes are set."""
    s = hashes % bits[0]
    return bits[1][s >> 6] >> (s & 63) & 1 == 1


def maybe(spark: SparkSession, bits: tuple[int, np.ndarray], col: Column) -> Column:
    """True for every id that bits_of was given, and for a few others."""
    shared = spark.sparkContext.broadcast(bits)

    @F.arrow_udf("boolean")
    def test(h: pa.Array) -> pa.Array:
        return pa.array(has(shared.value, h.to_numpy(zero_copy_only=False)))

    return test(F.xxhash64(col))


def among(inside: DataFrame, outside: DataFrame, held: int = HELD) -> Callable[[Column], Column]:
    """An exact test for ids that are not null: true for those inside, false for those outside; both have one column.

    Ids that a filter of one side lets through from the other are told apart by a filter of theirs, and so on, until so
    few are left that they are sent as they are.
    """
    spark, filters, own = inside.sparkSession, [], []
    while inside.count() > held:
        filters.append(bits_of(inside, len(filters)))
        own.append(stash(outside.where(maybe(spark, filters[-1], F.col(outside.columns[0])))))
        inside, outside = own[-1], inside
    rest = np.unique(inside.toArrow().column(0).to_numpy())
    discard(*own)
    shared = spark.sparkContext.broadcast((filters, rest))

    @F.arrow_udf("boolean")
    def test(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        filters, rest = shared.value
        ids, hashes = (x.to_numpy(zero_copy_only=False) for x in (ids.fill_null(0), hashes))
        at = np.searchsorted(rest, ids)
        out = rest[np.minimum(at, len(rest) - 1)] == ids if len(rest) else np.zeros(len(ids), bool)
        for bits in reversed(filters):
            out = has(bits, hashes) & ~out
        return pa.array(out)

    return lambda col: test(col, F.xxhash64(col))
