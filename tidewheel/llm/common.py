"""Tables, scratch space and small expressions that the operators share."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Else a shuffle's files stay until the driver happens to collect garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of rows that go to a Python worker, or come back, at once; the executor keeps some copies of them outside its heap.
BATCH_BYTES = {"spark.sql.execution.arrow.maxBytesPerBatch": "4MB"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one only in local mode, where all share this machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return shared or os.path.join(tempfile.gettempdir(), "tidewheel-scratch")


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """The session with other settings for a while."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stash(df: DataFrame, values: dict[str, str] = BATCH_BYTES, **options: str) -> DataFrame:
    """Cut the lineage by a table in the shared folder, which outlives any executor; the files of its shuffles go as soon as it is written.

    values: settings while it is made.  options: of the writer.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/stash-{uuid.uuid4().hex}"
    with settings(spark, {CLEAN_UP: "true", **values}):
        df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Remove stashed tables that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_stash_path", None)
        if path:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def give_back() -> None:
    """Return freed memory to the system: allocators keep it, and a worker lives on beside the next stage's."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
        trim(0)


def pieces(batches, rows: int = 512):
    """The same rows in smaller batches: a worker then holds little of what it makes of them, and gives that back after the last."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    batch = None
    give_back()


def let(value: Column, body) -> Column:
    """Bind value once for body; a column reference in a lambda could be inlined and evaluated per element."""
    return F.transform(F.array(value), body)[0]


def fold(col: str, modulus: int) -> Column:
    """crc32 of an id's decimal text, modulo: the split into learning and held-out rows."""
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(modulus))


def fold_of(doc_id, modulus: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % modulus


def stable_order(*cols: str) -> Column:
    """A pseudo-random but repeatable order, for bounded samples that a retried task draws again alike."""
    return F.xxhash64(*[F.col(c) for c in cols])


def bounded_sample(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """At most so many rows, first in a hash order.  A threshold on that order goes first, so that tasks send about 1.5 x rows in all."""
    order, n = F.pmod(stable_order(*by), F.lit(2**31 - 1)), df.count()
    if n > 2 * rows:
        df = df.where(order < F.lit(int((2**31 - 1) * 1.5 * rows / n)))
    return df.orderBy(order, *by).limit(rows)
