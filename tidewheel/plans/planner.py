"""A job document to DataFrames, in topological order; Catalyst does the rest.

The same plan serves tables and streams: a reduce of streaming input is the stateful processor, of a table an aggregate.
Map, key selector and reduce functions are resolved once on the driver.  Reducers registered in `NATIVE` run as native
aggregates over typed payloads; the others as Python folds.  FORWARD and HASH edges need nothing from us (a group-by implies
its exchange); a REBALANCE edge is a round-robin repartition, taken only where asked for.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import udfs, windows
from ..operators import core, reduce
from ..sources import csv_sink, records
from ..streaming import reduce as streaming
from .spec import DEFAULTS, Job

#: reference -> (payload schema, kind, field, field that all records of a window share): reducers known to equal a native aggregate.
NATIVE: dict[str, tuple[str, str, str, str]] = {"tidewheel.streaming.reduce:merge_word_counts": ("word string, count bigint", "sum", "count", "word")}


def open_sources(spark: SparkSession, job: Job, *, streaming: bool = False, resolve: Callable = udfs.resolve, metrics: dict[str, Observation] | None = None) -> dict[str, DataFrame]:
    """The envelopes of every source of the job, by its config."""
    out = {}
    for op in job.operators:
        if op.type == "source":
            check = op.config.get("validator")
            out[op.id] = records.open_source(spark, job.name, op.id, op.config, streaming=streaming, validator=resolve(check, "validator") if check else None, metrics=(metrics or {}).get(op.id))
    return out


def plan(job: Job, sources: dict[str, DataFrame], *, clock: datetime | None = None, flush_open_windows: bool = False, rebalance: bool = False, resolve: Callable = udfs.resolve) -> dict[str, DataFrame]:
    """The output of every operator. sources: an envelope DataFrame (JSON payload) per source operator."""
    made: dict[str, DataFrame] = {}
    how = {(e.source, e.target): e.partitioning for e in job.edges}
    for op_id in job.order:
        op = job[op_id]
        if op.type == "source":
            made[op_id] = sources[op_id]
            continue
        inputs = [made[i].repartition(op.parallelism) if rebalance and how[i, op_id] == "rebalance" else made[i] for i in job.inputs(op_id)]
        df = core.merge(*inputs)
        if op.type == "map":
            df = core.map_python(df, resolve(op.udf, "map"))
        elif op.type == "key_by":
            df = core.key_python(df, resolve(op.udf, "key_selector"))
        elif op.type == "reduce":
            df = _reduce(df, op, clock, flush_open_windows, resolve)
        made[op_id] = df
    return made


def _reduce(df: DataFrame, op, clock, flush, resolve) -> DataFrame:
    """Envelopes as a reduce emits them: id and headers of the window's first record, the window's bounds in the headers.

    processing_time is the time of firing: of the timer in a stream; in a table the clock, or else the window's end.
    """
    if "headers" not in df.columns:
        df = df.withColumn("headers", F.lit(None).cast(records.HEADERS))
    if df.isStreaming:
        out = streaming.reduce_stream(df, resolve(op.udf, "reduce"), op.window_ms)
        start, end = F.timestamp_millis("window_start_ms"), F.timestamp_millis("window_end_ms")
        return _emitted(out, F.col("record_id"), F.from_json("headers", records.HEADERS), start, end, F.timestamp_millis("fired_ms"))
    own_clock, start, end = None if flush else clock, F.col("window_start"), F.col("window_end")
    fired = end if clock is None else F.greatest(end, F.lit(clock))
    if op.udf in NATIVE:
        schema, kind, name, same = NATIVE[op.udf]
        value, head = F.from_json("payload", schema), F.struct("record_id", "headers")
        got = reduce.declared(df, op.window_ms, {"_sum": (kind, value[name]), "_first": ("first", F.struct("payload", head.alias("head"))), "_n": ("count", F.lit(1)), "_good": ("count", value[name]), "_a": ("min", value[same]), "_b": ("max", value[same])}, clock=own_clock)
        merged = F.to_json(F.from_json("_first.payload", schema).withField(name, F.col("_sum")))
        wrong = F.raise_error(F.lit(f"{op.id}: payloads that {op.udf} refuses")).cast("string")
        bad = (F.col("_good") < F.col("_n")) | ~F.col("_a").eqNullSafe(F.col("_b"))
        out = got.withColumn("payload", F.when(F.col("_n") == 1, F.col("_first.payload")).when(bad, wrong).otherwise(merged))
        return _emitted(out, F.col("_first.head.record_id"), F.col("_first.head.headers"), start, end, fired)
    head = F.to_json(F.struct("record_id", "headers"))
    out = reduce.python_fold(df, op.window_ms, resolve(op.udf, "reduce"), head=head, clock=own_clock)
    out = out.withColumn("head", F.from_json("head", f"record_id string, headers {records.HEADERS}"))
    return _emitted(out, F.col("head.record_id"), F.col("head.headers"), start, end, fired)


def _emitted(out: DataFrame, record_id: Column, headers: Column, start: Column, end: Column, fired: Column) -> DataFrame:
    names = [f.split(" ")[0] for f in records.HEADERS[7:-1].split(", ")]
    bounds = {"window_start": windows.stamp(start), "window_end": windows.stamp(end)}
    headers = F.struct(*[bounds.get(n, headers[n]).alias(n) for n in names])
    return out.select(record_id.alias("record_id"), "payload", fired.alias("processing_time"), "key", headers.alias("headers"))


def word_output(df: DataFrame) -> DataFrame:
    """The sink's three columns; records that no reduce has seen lack window_end and fail there, as do fields of other types."""
    value = F.try_parse_json("payload")
    kind = lambda name: F.schema_of_variant(F.try_variant_get(value, f"$.{name}", "variant"))

    def field(name: str, wanted: str, spark_type: str) -> Column:
        wrong = F.raise_error(F.lit(f"sink: {name} must be {'text' if wanted == 'STRING' else 'an integer'}")).cast(spark_type)
        return F.when(F.coalesce(kind(name), F.lit("")) == wanted, F.try_variant_get(value, f"$.{name}", spark_type)).otherwise(wrong).alias(name)

    return df.select(F.col("headers.window_end").alias("window_end"), field("word", "STRING", "string"), field("count", "BIGINT", "bigint"))


def _sinks(job: Job):
    for op in job.operators:
        if op.type == "sink":
            yield op, csv_sink.directory(op.config.get("output_path") or DEFAULTS["output_path"], job.name, op.id)


def run(spark: SparkSession, job: Job, sources: dict[str, DataFrame] | None = None, *, metrics: dict[str, Observation] | None = None, **options) -> list[str]:
    """Write every sink from tables; the folders written.

    Where several sinks share an operator, its output is kept on the executors' disks, so that user code sees a record once
    (again only if an executor with it is lost).
    """
    resolve = options.get("resolve", udfs.resolve)
    made = plan(job, sources or open_sources(spark, job, resolve=resolve, metrics=metrics), **options)
    out, held = [], []
    targets = {op.id: [e.target for e in job.edges if e.source == op.id] for op in job.operators}
    if any(len(t) > 1 for t in targets.values()):
        kept = {o: df for o, df in made.items() if len(targets[o]) > 1}
        for o, df in kept.items():  # plans are immutable: what comes after a kept operator finds it by its plan
            held.append(df.persist(StorageLevel.DISK_ONLY))
    try:
        for op, path in _sinks(job):
            csv_sink.write(word_output(made[op.id]), path, (metrics or {}).get(op.id))
            out.append(path)
    finally:
        for df in held:
            df.unpersist()
    return out


def start(spark: SparkSession, job: Job, checkpoint: str, sources: dict[str, DataFrame] | None = None, *, trigger: dict | None = None, **options) -> dict[str, tuple]:
    """Run the job as streams, one query per sink: sink id -> (query, folder). Replayed batches overwrite their own folder."""
    streaming.configure(spark)
    made = plan(job, sources or open_sources(spark, job, streaming=True, resolve=options.get("resolve", udfs.resolve)), **options)
    out = {}
    for op, path in _sinks(job):
        writer = word_output(made[op.id]).writeStream.queryName(f"{job.name}-{op.id}").option("checkpointLocation", f"{checkpoint}/{op.id}").trigger(**(trigger or {"processingTime": "1 second"}))
        out[op.id] = (writer.foreachBatch(lambda batch, k, path=path: csv_sink.write_batch(batch, path, k)).start(), path)
    return out
