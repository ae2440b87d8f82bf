"""Key identity and exact partition numbers as columns."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical_json(value) -> str:
    """One text per JSON value: sorted keys, no blanks, NaN and infinities refused."""
    return json.dumps(value, ensure_ascii=False, allow_nan=False, sort_keys=True, separators=(",", ":"))


@F.udf(T.StringType(), useArrow=True)
def canonical_token(text):
    """The canonical text of a JSON text; for keys without a declared type."""
    return None if text is None else canonical_json(json.loads(text))


def string_token(key: Column) -> Column:
    """canonical_json of a string column; null stays null."""
    text = F.regexp_replace(key, r"([\"\\])", r"\\$1")
    controls = text
    for code in range(32):
        controls = F.replace(controls, F.lit(chr(code)), F.lit(json.dumps(chr(code))[1:-1]))
    return F.concat(F.lit('"'), F.when(key.rlike(r"[\x00-\x1f]"), controls).otherwise(text), F.lit('"'))


def struct_token(**tokens: Column) -> Column:
    """canonical_json of an object of fields that have tokens already; null if one is null."""
    parts = [F.concat(F.lit(("," if i else "{") + canonical_json(name) + ":"), tokens[name]) for i, name in enumerate(sorted(tokens))]
    return F.concat(*parts, F.lit("}"))


def long_token(key: Column) -> Column:
    return key.cast("bigint").cast("string")


def hash_partition(token: Column, n: int) -> Column:
    """SHA-256 of the token as an unsigned number, modulo n."""
    if type(n) is not int or n < 1:
        raise ValueError("parallelism must be a positive integer")
    digest = F.sha2(token.cast("binary"), 256)
    step = (62 - n.bit_length()) // 4  # as many hex digits at a time as stay inside a bigint beside a remainder
    value = F.lit(0).cast("bigint")
    for at in range(1, 65, step):
        width = min(step, 65 - at)
        value = F.pmod(value * (16**width) + F.conv(F.substring(digest, at, width), 16, 10).cast("bigint"), F.lit(n))
    return F.when(token.isNull(), F.raise_error(F.lit("null key")).cast("bigint")).otherwise(value)


def _checked(upstream: int, n: int) -> None:
    if type(n) is not int or n < 1:
        raise ValueError("parallelism must be a positive integer")
    if type(upstream) is not int or upstream < 0:
        raise ValueError("the upstream's number must be 0 or more")


def rebalance_partition(ordinal: Column, upstream: int, n: int) -> Column:
    """Round robin from the upstream's own number on."""
    _checked(upstream, n)
    return F.pmod(ordinal + upstream, F.lit(n))


def forward_partition(subtask: Column, n: int) -> Column:
    """The upstream's own number, which the downstream must have too."""
    _checked(0, n)
    return F.when((subtask >= 0) & (subtask < n), subtask).otherwise(F.raise_error(F.lit("no downstream of that number")).cast("bigint"))
