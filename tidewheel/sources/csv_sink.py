"""Header-less CSV output with a checked schema."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

COLUMNS = "window_end string, word string, count bigint"
OPTIONS = {"header": "false", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "lineSep": "\n", "emptyValue": ""}
_SAFE = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")


def directory(output_path: str, job_id: str, operator_id: str) -> str:
    for part in (job_id, operator_id):
        if not _SAFE.fullmatch(part):
            raise ValueError(f"{part!r} can't name a folder")
    return f"{output_path.rstrip('/')}/{job_id}/{operator_id}"


def checked(df: DataFrame) -> DataFrame:
    """window_end, word, count; an empty or null one fails the query."""
    need = lambda name, ok: F.when(ok, F.col(name)).otherwise(F.raise_error(F.lit(f"sink: {name} is missing"))).alias(name)
    text = lambda name: F.col(name).isNotNull() & (F.col(name) != "")
    for name in ("window_end", "word"):
        if dict(df.dtypes).get(name) not in ("string", "void"):
            raise TypeError(f"sink: {name} must be a string")
    if dict(df.dtypes).get("count") not in ("int", "bigint", "smallint", "tinyint"):
        raise TypeError("sink: count must be an integer")
    return df.select(need("window_end", text("window_end")), need("word", text("word")), need("count", F.col("count").isNotNull()).cast("bigint").alias("count"))


def write(df: DataFrame, path: str, metrics: Observation | None = None) -> None:
    """metrics: gets records_written."""
    out = checked(df)
    if metrics is not None:
        out = out.observe(metrics, F.count("*").alias("records_written"))
    out.write.mode("append").options(**OPTIONS).csv(path)


def write_batch(df: DataFrame, path: str, batch: int) -> None:
    """One micro-batch in a folder of its own, written anew when the batch is replayed."""
    checked(df).write.mode("overwrite").options(**OPTIONS).csv(f"{path}/batch-{batch}")


def read(spark, path: str, batches: bool = False) -> DataFrame:
    return spark.read.schema(COLUMNS).options(**OPTIONS).csv(f"{path}/{'batch-*/' if batches else ''}part-*.csv")
