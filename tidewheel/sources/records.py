"""The record envelope and JSON decoding with a bad-record policy."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

HEADERS = "struct<source_topic string, source_partition int, source_offset bigint, window_start string, window_end string>"
COLUMNS = ("record_id", "payload", "processing_time", "key", "event_time", "message_type", "change_kind", "checkpoint_id", "headers")


def envelope(df: DataFrame, *, topic: str, partition: Column, offset: Column, payload: Column, processing_time: Column) -> DataFrame:
    """The nine envelope columns."""
    headers = F.struct(
        F.lit(topic).alias("source_topic"), partition.cast("int").alias("source_partition"), offset.cast("bigint").alias("source_offset"),
        F.lit(None).cast("string").alias("window_start"), F.lit(None).cast("string").alias("window_end"),
    )
    return df.select(
        F.concat_ws(":", F.lit(topic), partition.cast("string"), offset.cast("string")).alias("record_id"), payload.alias("payload"), processing_time.cast("timestamp").alias("processing_time"),
        F.lit(None).cast("string").alias("key"), F.lit(None).cast("timestamp").alias("event_time"), F.lit("DATA").alias("message_type"), F.lit("INSERT").alias("change_kind"),
        F.lit(None).cast("bigint").alias("checkpoint_id"), headers.alias("headers"),
    )


def _refuse(name: str):
    raise ValueError(f"{name} is not JSON")


def decoder(validator: Callable | None = None):
    """bytes -> struct(payload, error): strict UTF-8 JSON; a validator rejects by raising only."""

    def run(value):
        try:
            if value is None:
                raise ValueError("no value")
            data = json.loads(bytes(value).decode("utf-8"), parse_constant=_refuse)
            if validator is not None:
                validator(data)
            return (json.dumps(data, ensure_ascii=False, allow_nan=False, separators=(",", ":")), None)
        except Exception as e:  # noqa: BLE001  any failure is a bad record
            return (None, f"{type(e).__name__}: {e}")

    return F.udf(run, "struct<payload string, error string>", useArrow=True).asNondeterministic()


def is_json(value: Column) -> Column:
    """Whether the bytes are UTF-8 and one JSON value, without NaN, repeated names or trailing text.

    The parser ignores what follows a value; inside brackets and inside braces both, only white space can.
    """
    text = value.cast("string")
    closed = [F.try_parse_json(F.concat(F.lit(a), text, F.lit(b))).isNotNull() for a, b in (("[", "]"), ('{"v":', "}"))]
    return F.coalesce(F.is_valid_utf8(text) & closed[0] & closed[1], F.lit(False))


def decode(df: DataFrame, value: Column, *, where: Column, policy: str = "fail", schema: str | None = None, valid: Column | None = None, validator: Callable | None = None, metrics: Observation | None = None) -> DataFrame:
    """Add payload; bad records fail the query with their place, or are skipped.

    With a schema, decoding is native (valid: a predicate on payload); without one, the strict Python decoder runs.
    A valid JSON object may lack any field.  metrics: gets records_read (good ones) and bad_records.
    """
    if schema:
        out = df.withColumn("payload", F.from_json(value.cast("string"), schema, {"mode": "PERMISSIVE"}))
        ok = is_json(value) & F.col("payload").isNotNull()
        out = out.withColumn("_error", F.when(ok & (F.coalesce(valid, F.lit(False)) if valid is not None else F.lit(True)), F.lit(None)).otherwise("bad payload"))
    else:
        got = decoder(validator)(value.cast("binary"))
        out = df.withColumn("_got", got).withColumn("payload", F.col("_got.payload")).withColumn("_error", F.col("_got.error")).drop("_got")
    if metrics is not None:
        out = out.observe(metrics, F.count_if(F.col("_error").isNull()).alias("records_read"), F.count_if(F.col("_error").isNotNull()).alias("bad_records"))
    if policy == "skip":
        return out.where("_error is null").drop("_error")
    if policy != "fail":
        raise ValueError("bad_record_policy must be fail or skip")
    failed = F.raise_error(F.concat(F.lit("bad record at "), where, F.lit(": "), F.col("_error")))
    return out.withColumn("payload", F.when(F.col("_error").isNotNull(), failed.cast(out.schema["payload"].dataType)).otherwise(F.col("payload"))).drop("_error")


def kafka_options(job_id: str, operator_id: str, config: dict) -> dict[str, str]:
    """Reader options of a Kafka JSON source; offsets live in the checkpoint."""
    options = {"kafka.bootstrap.servers": config.get("bootstrap_servers") or "kafka:9092", "subscribe": config["topic"], "startingOffsets": config.get("auto_offset_reset", "earliest")}
    group = config.get("group_id")
    return options | ({"kafka.group.id": group} if group else {"groupIdPrefix": f"tidewheel-{job_id}-{operator_id}"})


def kafka(spark: SparkSession, job_id: str, operator_id: str, config: dict) -> DataFrame:
    """topic, partition, offset, value as a stream; needs Spark's Kafka package on the class path."""
    return spark.readStream.format("kafka").options(**kafka_options(job_id, operator_id, config)).load()


TOPIC = "topic string, partition int, offset bigint, value binary, timestamp timestamp"


def table(spark: SparkSession, config: dict, streaming: bool) -> DataFrame:
    """The same columns from a folder of Parquet files, at once or as a stream."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(TOPIC).parquet(config["path"]).where(F.col("topic") == config["topic"])


def open_source(spark: SparkSession, job_id: str, operator_id: str, config: dict, *, streaming: bool, validator: Callable | None = None, metrics: Observation | None = None) -> DataFrame:
    """Envelopes with JSON payloads of a job's source: connector kafka (a stream) or table."""
    if config["connector"] == "kafka":
        raw = kafka(spark, job_id, operator_id, config)
    else:
        raw = table(spark, config, streaming)
    where = F.concat_ws(":", "topic", "partition", "offset")
    got = decode(raw, F.col("value"), where=where, policy=config.get("bad_record_policy", "fail"), validator=validator, metrics=metrics)
    return envelope(got, topic=config["topic"], partition=F.col("partition"), offset=F.col("offset"), payload=F.col("payload"), processing_time=F.coalesce("timestamp", F.current_timestamp()))
