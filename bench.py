"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidewheel.plans import catalogue, planner, spec
from tidewheel.sources import records

HEADLINE = ["wordcount_50k", "tumbling_count_300s", "tumbling_1h", "reduce_sum_min_max", "reduce_first_payload", "reduce_ordered_fold", "reduce_output_envelope", "chained_reduce", "merge_union_all", "hash_partition", "json_decode", "reduce_lineitem"]


def lower(payload):
    return {**payload, "word": payload["word"].lower()}


def word(payload):
    return payload["word"]


def job_50k(spark, folder: str):
    """A whole job over 50,000 JSON messages: decode, map, key, reduce in 300 s windows, CSV."""
    raw = F.concat(F.lit("word-"), (F.col("id") % 100).cast("string"))
    body = F.to_json(F.struct(F.when(F.col("id") % 2 == 0, F.upper(raw)).otherwise(raw).alias("word"), F.lit(1).alias("count")))
    rows = spark.range(50_000).select(F.lit("words").alias("topic"), F.lit(0).alias("partition"), F.col("id").alias("offset"), body.cast("binary").alias("value"), F.lit("2024-01-01 00:00:01").cast("timestamp").alias("timestamp"))
    rows.write.mode("overwrite").parquet(f"{folder}/in")
    steps = [
        {"id": "words", "type": "source", "config": {"connector": "table", "topic": "words", "path": f"{folder}/in"}},
        {"id": "fold", "type": "map", "udf": "bench:lower"}, {"id": "by_word", "type": "key_by", "udf": "bench:word"},
        {"id": "counts", "type": "reduce", "udf": "tidewheel.streaming.reduce:merge_word_counts", "window": {"size": "300s"}},
        {"id": "sheet", "type": "sink", "config": {"connector": "file", "output_path": f"{folder}/out"}},
    ]
    job = spec.build({"api_version": spec.API_VERSION, "name": "bench", "operators": steps, "edges": [{"from": a["id"], "to": b["id"]} for a, b in zip(steps, steps[1:], strict=False)]})
    functions = {"bench:lower": lower, "bench:word": word}
    return lambda: planner.run(spark, job, resolve=lambda ref, kind: functions.get(ref))


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda q: catalogue.QUERIES[q](spark, sf_dir).write.format("noop").mode("overwrite").save()
    took, cold = {}, {}
    for q in HEADLINE:
        start = time.perf_counter()
        run(q)
        cold[q] = round(time.perf_counter() - start, 3)
        start = time.perf_counter()
        run(q)
        took[q] = round(time.perf_counter() - start, 3)
    with tempfile.TemporaryDirectory() as folder:
        run = job_50k(spark, folder)
        for times in (cold, took):
            start = time.perf_counter()
            run()
            times["job_50k"] = round(time.perf_counter() - start, 3)
    rate = round(50_000 / took["wordcount_50k"])
    print(json.dumps({"metric": "headline queries, warm", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "cold": cold, "wordcount_records_per_s": rate, "job_records_per_s": round(50_000 / took["job_50k"]), "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
