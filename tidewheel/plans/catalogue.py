"""Registered queries and their SQL twins."""

from __future__ import annotations

import tempfile
import time
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, windows
from ..operators import core, exchange, reduce
from ..sources import csv_sink, records
from ..streaming import reduce as streaming

FLAGSHIP = "tumbling_count_300s"
HOUR, FIVE = 3_600_000, 300_000
CLOCK = datetime(2024, 1, 15, 12, 30, tzinfo=timezone.utc)
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet")


def stream(spark: SparkSession, d: str) -> DataFrame:
    """Events as envelopes keyed by lower-cased type; the event's own columns stay for native payloads."""
    e = events(spark, d)
    return e.select(F.col("event_id").alias("ordinal"), F.concat_ws(":", F.lit("events"), F.lit("0"), F.col("event_id").cast("string")).alias("record_id"), F.col("ts").cast("timestamp").alias("processing_time"), F.lower("event_type").alias("key"), "user_id", F.round(F.col("value") * 100).cast("bigint").alias("cents"))


def ends(size_ms: int, ts: str = "ts") -> str:
    n = size_ms * 1000
    return f"make_timestamp((epoch_us({ts}) - ((epoch_us({ts}) % {n}) + {n}) % {n} + {n})::BIGINT)"


def stamp_sql(x: str) -> str:
    return f"strftime({x}, '%Y/%m/%dT%H:%M:%S')"


def _count(spark, d, size):
    got = reduce.declared(stream(spark, d), size, {"count": ("count", F.lit(1))})
    return got.select(windows.stamp(F.col("window_end")).alias("window_end"), F.col("key").alias("word"), "count")


def _count_sql(size):
    return f"SELECT {stamp_sql('w')} AS window_end, word, n AS count FROM (SELECT {ends(size)} AS w, lower(event_type) AS word, count(*) AS n FROM events GROUP BY 1, 2)"


@query("SELECT 'events:0:' || event_id AS record_id, props AS payload, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS processing_time, 'DATA' AS message_type, 'INSERT' AS change_kind, 'events' AS source_topic, 0 AS source_partition, event_id AS source_offset FROM events")
def scan_envelope(spark, d):
    e = records.envelope(events(spark, d), topic="events", partition=F.lit(0), offset=F.col("event_id"), payload=F.col("props"), processing_time=F.col("ts"))
    return e.select("record_id", "payload", F.date_format("processing_time", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("processing_time"), "message_type", "change_kind", "headers.source_topic", "headers.source_partition", "headers.source_offset")


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def json_decode(spark, d):
    got = records.decode(events(spark, d), F.col("props"), where=F.concat_ws(":", F.lit("events"), "event_id"), schema="k bigint")
    return got.select("event_id", F.col("payload.k").alias("k"))


def _corrupt(spark, d):
    return events(spark, d).withColumn("value_bytes", F.when(F.col("event_id") % 10 == 3, F.lit("not-json")).otherwise(F.col("props")).cast("binary"))


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events WHERE event_id % 10 <> 3")
def bad_record_skip(spark, d):
    got = records.decode(_corrupt(spark, d), F.col("value_bytes"), where=F.col("event_id").cast("string"), policy="skip")
    return got.select("event_id", F.get_json_object("payload", "$.k").cast("bigint").alias("k"))


def _has_small_k(payload):
    if payload["k"] >= 50:
        raise ValueError("k is too large")
    return False  # only an exception rejects


@query("SELECT count(*) FILTER (event_id % 10 <> 3) AS records_read, count(*) FILTER (event_id % 10 = 3) AS bad_records FROM events")
def bad_record_counts(spark, d):
    got = _corrupt(spark, d).withColumn("bad", records.decoder()(F.col("value_bytes"))["error"].isNotNull())
    return got.agg(F.count_if(~F.col("bad")).alias("records_read"), F.count_if("bad").alias("bad_records"))


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events WHERE json_extract(props, '$.k')::BIGINT < 50")
def payload_validator(spark, d):
    got = records.decode(events(spark, d), F.col("props"), where=F.col("event_id").cast("string"), policy="skip", validator=_has_small_k)
    return got.select("event_id", F.get_json_object("payload", "$.k").cast("bigint").alias("k"))


@query("SELECT event_id, lower(event_type) AS word, 1::BIGINT AS count FROM events")
def map_normalize(spark, d):
    return core.map_native(events(spark, d), F.struct(F.lower("event_type").alias("word"), F.lit(1).cast("bigint").alias("count"))).select("event_id", "payload.word", "payload.count")


@query("SELECT event_id, event_type AS word FROM events WHERE user_id % 2 = 0")
def map_drop_none(spark, d):
    return core.map_native(events(spark, d), F.when(F.col("user_id") % 2 == 0, F.col("event_type"))).select("event_id", F.col("payload").alias("word"))


def _shout_even(payload):
    return {"word": payload["word"].upper()} if payload["id"] % 2 == 0 else None


@query("SELECT event_id, upper(event_type) AS word FROM events WHERE event_id % 2 = 0")
def map_python_udf(spark, d):
    e = events(spark, d).withColumn("payload", F.to_json(F.struct(F.col("event_type").alias("word"), F.col("event_id").alias("id"))))
    return core.map_python(e, _shout_even).select("event_id", F.get_json_object("payload", "$.word").alias("word"))


@query("SELECT event_id, '\"' || event_type || '\"' AS key_token FROM events")
def key_by_scalar(spark, d):
    return core.key_native(events(spark, d), F.col("event_type")).select("event_id", keys.string_token(F.col("key")).alias("key_token"))


@query("SELECT event_id, '{\"type\":\"' || event_type || '\",\"user\":' || user_id || '}' AS key_token FROM events")
def key_by_composite(spark, d):
    token = keys.struct_token(user=keys.long_token(F.col("user_id")), type=keys.string_token(F.col("event_type")))
    return events(spark, d).select("event_id", token.alias("key_token"))


@query("SELECT event_id, list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 65), lambda i: (strpos('0123456789abcdef', sha256(user_id::VARCHAR)[i]) - 1)::BIGINT)), lambda a, x: (a * 16 + x) % 7) AS p FROM events")
def hash_partition(spark, d):
    return events(spark, d).select("event_id", keys.hash_partition(keys.long_token(F.col("user_id")), 7).alias("p"))


@query("SELECT event_id, (event_id + 2) % 3 AS p FROM events")
def rebalance_partition(spark, d):
    return events(spark, d).select("event_id", keys.rebalance_partition(F.col("event_id"), 2, 3).alias("p"))


@query("SELECT event_id, event_id % 4 AS p FROM events")
def forward_partition(spark, d):
    """Every record is in the partition of its upstream's number, and a map leaves it there."""
    there = exchange.forward_exchange(events(spark, d).withColumn("subtask", F.col("event_id") % 4), F.col("subtask"), 4)
    return core.map_native(there, F.upper("event_type")).select("event_id", F.spark_partition_id().cast("bigint").alias("p"))


@query(_count_sql(FIVE))
def tumbling_count_300s(spark, d):
    return _count(spark, d, FIVE)


@query(_count_sql(7_000))
def tumbling_7s(spark, d):
    return _count(spark, d, 7_000)


@query(_count_sql(1))
def tumbling_1ms(spark, d):
    return _count(spark, d, 1)


@query(_count_sql(HOUR))
def tumbling_1h(spark, d):
    return _count(spark, d, HOUR)


@query(f"SELECT {stamp_sql('w')} AS window_end, word, total, low, high FROM (SELECT {ends(24 * HOUR)} AS w, lower(event_type) AS word, sum(round(value * 100)::BIGINT)::BIGINT AS total, min(round(value * 100)::BIGINT) AS low, max(round(value * 100)::BIGINT) AS high FROM events GROUP BY 1, 2)")
def reduce_sum_min_max(spark, d):
    c = F.col("cents")
    got = reduce.declared(stream(spark, d), 24 * HOUR, {"total": ("sum", c), "low": ("min", c), "high": ("max", c)})
    return got.select(windows.stamp(F.col("window_end")).alias("window_end"), F.col("key").alias("word"), "total", "low", "high")


@query(f"SELECT {stamp_sql('w')} AS window_end, word, first_id FROM (SELECT {ends(HOUR)} AS w, lower(event_type) AS word, arg_min(event_id, event_id) AS first_id FROM events GROUP BY 1, 2)")
def reduce_first_payload(spark, d):
    got = reduce.declared(stream(spark, d), HOUR, {"first_id": ("first", F.col("ordinal"))}, order=F.col("ordinal"))
    return got.select(windows.stamp(F.col("window_end")).alias("window_end"), F.col("key").alias("word"), "first_id")


@query(f"SELECT {stamp_sql('w')} AS window_end, word, ids FROM (SELECT {ends(6 * HOUR)} AS w, lower(event_type) AS word, string_agg(event_id::VARCHAR, '-' ORDER BY event_id) AS ids FROM events GROUP BY 1, 2)")
def reduce_ordered_fold(spark, d):
    got = reduce.ordered_fold(stream(spark, d), 6 * HOUR, F.col("ordinal").cast("string"), F.col("ordinal"), lambda a, x: F.concat(a, F.lit("-"), x), name="ids")
    return got.select(windows.stamp(F.col("window_end")).alias("window_end"), F.col("key").alias("word"), "ids")


@query(_count_sql(24 * HOUR))
def reduce_python_udf(spark, d):
    own = stream(spark, d).withColumn("payload", F.to_json(F.struct(F.col("key").alias("word"), F.lit(1).alias("count"))))
    got = reduce.python_fold(own, 24 * HOUR, streaming.merge_word_counts)
    return got.select(windows.stamp(F.col("window_end")).alias("window_end"), F.col("key").alias("word"), F.get_json_object("payload", "$.count").cast("bigint").alias("count"))


@query(f"SELECT 'events:0:' || first_id AS record_id, word AS key, n AS count, {stamp_sql(f'w - INTERVAL {HOUR} MILLISECONDS')} AS window_start, {stamp_sql('w')} AS window_end, first_id AS source_offset FROM (SELECT {ends(HOUR)} AS w, lower(event_type) AS word, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY 1, 2)")
def reduce_output_envelope(spark, d):
    e = records.envelope(events(spark, d).withColumn("word", F.lower("event_type")), topic="events", partition=F.lit(0), offset=F.col("event_id"), payload=F.col("word"), processing_time=F.col("ts"))
    keyed = core.key_native(e, F.col("payload"))
    out = reduce.emitted(keyed, HOUR, "count", F.lit(1), F.current_timestamp(), order=F.col("headers.source_offset"))
    return out.select("record_id", "key", F.col("payload").alias("count"), "headers.window_start", "headers.window_end", "headers.source_offset")


@query(f"SELECT {stamp_sql('w')} AS window_end, word, n AS count FROM (SELECT {ends(HOUR)} AS w, lower(event_type) AS word, count(*) AS n FROM events GROUP BY 1, 2) WHERE w <= TIMESTAMP '2024-01-15 12:30:00'")
def reduce_cutoff_no_flush(spark, d):
    got = reduce.declared(stream(spark, d), HOUR, {"count": ("count", F.lit(1))}, clock=CLOCK)
    return got.select(windows.stamp(F.col("window_end")).alias("window_end"), F.col("key").alias("word"), "count")


@query(f"WITH e AS (SELECT {ends(HOUR)} AS w, lower(event_type) AS word, ts + CASE WHEN event_id % 4 = 0 THEN INTERVAL 2 HOURS ELSE INTERVAL 0 HOURS END AS arrived FROM events) SELECT {stamp_sql('w')} AS window_end, word, count(*) AS count FROM e WHERE arrived < w GROUP BY w, word UNION ALL SELECT {stamp_sql('w')}, word, 1 FROM e WHERE arrived >= w")
def reduce_late_rows(spark, d):
    arrived = F.col("processing_time") + F.expr("make_dt_interval(0, if(ordinal % 4 = 0, 2, 0))")
    got = reduce.with_late_rows(stream(spark, d), HOUR, arrived, "count", F.lit(1), name="count")
    return got.select(windows.stamp(F.col("window_end")).alias("window_end"), F.col("key").alias("word"), "count")


@query(f"SELECT {stamp_sql('w2')} AS window_end, word, n AS count FROM (SELECT {ends(24 * HOUR, 'w')} AS w2, word, sum(n)::BIGINT AS n FROM (SELECT {ends(HOUR)} AS w, lower(event_type) AS word, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1, 2)")
def chained_reduce(spark, d):
    first = reduce.declared(stream(spark, d), HOUR, {"n": ("count", F.lit(1))})
    second = reduce.declared(first.withColumn("processing_time", F.col("window_end")).drop("window_start", "window_end").withColumn("record_id", F.col("key")), 24 * HOUR, {"count": ("sum", F.col("n"))})
    return second.select(windows.stamp(F.col("window_end")).alias("window_end"), F.col("key").alias("word"), "count")


@query("SELECT lower(event_type) AS word, event_id AS id FROM events UNION ALL SELECT o_orderstatus, o_orderkey FROM orders")
def merge_union_all(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderstatus").alias("word"), F.col("o_orderkey").alias("id"))
    return core.merge(events(spark, d).select(F.lower("event_type").alias("word"), F.col("event_id").alias("id")), orders)


@query("SELECT 'lower' AS branch, event_id, lower(event_type) AS word FROM events UNION ALL SELECT 'upper', event_id, upper(event_type) FROM events")
def branch_two_outputs(spark, d):
    e = events(spark, d)
    return core.merge(*[e.select(F.lit(n).alias("branch"), "event_id", f("event_type").alias("word")) for n, f in (("lower", F.lower), ("upper", F.upper))])


def _folder(spark) -> str:
    """A new folder that driver and executors share; a temporary one only in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{shared or tempfile.gettempdir() + '/tidewheel-scratch'}/{uuid.uuid4().hex}"


@query(_count_sql(HOUR).replace("lower(event_type)", "'a, \"' || lower(event_type) || '\" #'"))
def csv_sink_roundtrip(spark, d):
    rows = _count(spark, d, HOUR).withColumn("word", F.concat(F.lit('a, "'), "word", F.lit('" #')))
    path = csv_sink.directory(_folder(spark), "job", "output")
    csv_sink.write(rows, path)
    return csv_sink.read(spark, path)


@query("SELECT 'word-' || (i % 100) AS word, 500::BIGINT AS count FROM range(100) t(i)")
def wordcount_50k(spark, d):
    """The reference workload: 50,000 records over 100 words, upper case when even, one 300 s window."""
    raw = F.concat(F.lit("word-"), (F.col("id") % 100).cast("string"))
    made = spark.range(50_000).select(F.when(F.col("id") % 2 == 0, F.upper(raw)).otherwise(raw).alias("word"), F.lit(1).cast("bigint").alias("n"), F.lit("2024-01-01 00:00:01").cast("timestamp").alias("processing_time"), F.col("id").cast("string").alias("record_id"))
    got = reduce.declared(core.key_native(made.withColumn("word", F.lower("word")), F.col("word")), FIVE, {"count": ("sum", F.col("n"))})
    return got.select(F.col("key").alias("word"), "count")


@query(f"SELECT count(*) AS state_entries, count(DISTINCT w) AS active_windows FROM (SELECT DISTINCT {ends(24 * HOUR)} AS w, lower(event_type) AS word FROM events WHERE ts <= TIMESTAMP '2024-01-15 12:30:00') WHERE w > TIMESTAMP '2024-01-15 12:30:00'")
def state_metrics(spark, d):
    return reduce.state_metrics(stream(spark, d), 24 * HOUR, CLOCK)


@query(f"SELECT {stamp_sql('w')} AS window_end, word, sum(q)::BIGINT AS total FROM (SELECT {ends(24 * HOUR, 'l_shipdate')} AS w, l_returnflag AS word, round(l_quantity)::BIGINT AS q FROM lineitem) GROUP BY 1, 2")
def reduce_lineitem(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_returnflag").alias("key"), F.round("l_quantity").cast("bigint").alias("q"), F.col("l_shipdate").cast("timestamp").alias("processing_time"), F.col("l_orderkey").cast("string").alias("record_id"))
    got = reduce.declared(rows, 24 * HOUR, {"total": ("sum", F.col("q"))})
    return got.select(windows.stamp(F.col("window_end")).alias("window_end"), F.col("key").alias("word"), "total")


@query(_count_sql(24 * HOUR))
def stream_wordcount(spark, d):
    """Word count of the event types as a stream: files in, stateful reduce with timers, CSV out, a folder per batch."""
    streaming.configure(spark)
    table = events(spark, d)
    folder, rows = _folder(spark), table.count()
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/events.parquet")
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    reader = spark.readStream.schema(table.schema)
    raw = reader.parquet(f"{d}/events.parquet") if whole else reader.option("pathGlobFilter", "events.parquet").parquet(d)  # a stream reads folders
    payload = F.to_json(F.struct(F.lower("event_type").alias("word"), F.lit(1).alias("count")))
    own = raw.select(F.lower("event_type").alias("key"), F.col("ts").cast("timestamp").alias("processing_time"), payload.alias("payload"), F.concat(F.lit("events:0:"), "event_id").alias("record_id"))
    out = csv_sink.directory(folder, "job", "output")
    made = streaming.word_rows(streaming.reduce_stream(own, streaming.merge_word_counts, 24 * HOUR))
    running = made.writeStream.foreachBatch(lambda batch, k: csv_sink.write_batch(batch, out, k)).option("checkpointLocation", f"{folder}/state").trigger(processingTime="1 second").start()
    try:  # processAllAvailable() would wait for ever: timers keep an idle query's batches going
        taken: dict[int, int] = {}
        while True:
            if error := running.exception():
                raise error
            seen = running.recentProgress
            taken |= {p["batchId"]: p["numInputRows"] for p in seen}
            if sum(taken.values()) >= rows and seen and all(s["numRowsTotal"] == 0 for s in seen[-1]["stateOperators"]):
                break
            time.sleep(0.5)
    finally:
        running.stop()
    return csv_sink.read(spark, out, batches=True)


@query("SELECT key, string_agg(event_id::VARCHAR, '-' ORDER BY event_id) AS ids FROM (SELECT lower(event_type) AS key, event_id FROM events WHERE event_id < 60) GROUP BY key")
def fold_default_order(spark, d):
    """A fold that depends on the order, in the default one: by offset as a number, not as text."""
    rows = stream(spark, d).where("ordinal < 60").withColumn("processing_time", F.lit("2024-01-01").cast("timestamp"))
    got = reduce.ordered_fold(rows, HOUR, F.col("ordinal").cast("string"), None, lambda acc, x: F.concat(acc, F.lit("-"), x), name="ids")
    return got.select("key", "ids")


_ODD = ("{}", '{"k":null}', '{"k":1} junk', '{"k":2}', "{", '{"k":NaN}', '[{"k":3}]', '{"k":4},{"k":5}')


@query("SELECT event_id, event_id % 8 AS kind, CASE WHEN event_id % 8 = 3 THEN 2 ELSE -1 END::BIGINT AS k FROM events WHERE event_id % 8 IN (0, 1, 3)")
def json_decode_strict(spark, d):
    """Native decoding of odd values: absent and null fields are valid, trailing text and NaN are not."""
    kind = F.col("event_id") % 8
    odd = events(spark, d).withColumn("kind", kind).withColumn("v", F.element_at(F.array(*[F.lit(x) for x in _ODD]), (kind + 1).cast("int")).cast("binary"))
    got = records.decode(odd.where("kind <> 6"), F.col("v"), where=F.col("event_id").cast("string"), policy="skip", schema="k bigint")
    return got.select("event_id", "kind", F.coalesce("payload.k", F.lit(-1)).cast("bigint").alias("k"))
