import io
import json
import time
import zipfile
from datetime import datetime, timezone

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tidewheel import cli, observability
from tidewheel.functions import keys, udfs, windows
from tidewheel.operators import core, exchange, reduce
from tidewheel.plans import bundle, planner, spec
from tidewheel.sources import csv_sink, records
from tidewheel.streaming import reduce as streaming

REDUCER = "tidewheel.streaming.reduce:merge_word_counts"


def job(**changes):
    """Page views: four readers of clicks feed two key selectors, six counters and one report."""
    steps = [
        dict(id="clicks", type="source", parallelism=4, config={"connector": "table", "topic": "clicks", "path": "/tmp/clicks"}),
        dict(id="tidy", type="map", parallelism=4, udf="page_views:lower"),
        dict(id="per_page", type="key_by", parallelism=2, udf="page_views:word"),
        dict(id="views", type="reduce", parallelism=6, udf=REDUCER, window={"size": "300s"}),
        dict(id="report", type="sink", config={"connector": "file", "output_path": "/tmp/out"}),
    ]
    chain = [{"from": a["id"], "to": b["id"]} for a, b in zip(steps, steps[1:], strict=False)]
    return {"api_version": spec.API_VERSION, "name": "page-views", "operators": steps, "edges": chain} | changes


def lower(p):
    return p | {"word": p["word"].lower()}


def word(p):
    return p["word"]


FNS = {"page_views:lower": lower, "page_views:word": word, REDUCER: streaming.merge_word_counts, "other:add": streaming.merge_word_counts}
resolve = lambda ref, kind: FNS[ref]


def test_plan_edges_and_order():
    j = spec.build(job())
    assert j.order == ("clicks", "tidy", "per_page", "views", "report")
    assert [e.partitioning for e in j.edges] == ["forward", "rebalance", "hash", "hash"]


@pytest.mark.parametrize("text, ms", [("1ms", 1), ("2s", 2000), ("3m", 180000), ("4h", 14400000)])
def test_durations(text, ms):
    assert spec.duration_ms(text) == ms


@pytest.mark.parametrize("text", ["0s", "-1s", "1d", "1.5s", "seconds", 5])
def test_bad_durations(text):
    with pytest.raises(ValueError):
        spec.duration_ms(text)


@pytest.mark.parametrize(
    "edges, message",
    [
        ([{"from": "clicks", "to": "nowhere"}], "unknown operator"),
        ([{"from": "tidy", "to": "tidy"}], "feed itself"),
        ([{"from": a, "to": b} for a, b in (("clicks", "views"), ("views", "report"), ("clicks", "tidy"), ("tidy", "per_page"), ("per_page", "report"))], "keyed input"),
    ],
)
def test_graph_errors(edges, message):
    with pytest.raises(spec.SpecError, match=message):
        spec.build(job(edges=edges))


def test_cycle_and_duplicate_keys():
    doc = job()
    doc["edges"].append({"from": "per_page", "to": "tidy"})
    with pytest.raises(spec.SpecError, match="cycle"):
        spec.build(doc)
    with pytest.raises(spec.SpecError, match="duplicate key"):
        spec.load('{"name": "a", "name": "b"}')


def test_canonical_keys_differ_by_type():
    assert len({keys.canonical_json(x) for x in (1, 1.0, True, "1")}) == 4
    assert keys.canonical_json({"b": 1, "a": 2}) == '{"a":2,"b":1}'


def test_hash_and_rebalance(spark):
    df = spark.createDataFrame([("apple",)], "k string")
    assert df.select(keys.hash_partition(keys.string_token(F.col("k")), 8)).first()[0] == 0
    got = [r[0] for r in spark.range(4).select(keys.rebalance_partition(F.col("id"), 2, 3)).collect()]
    assert got == [2, 0, 1, 2]


def test_benchmark_keys_by_reducer(spark):
    df = spark.range(50_000).select(F.concat(F.lit("word-"), (F.col("id") % 100).cast("string")).alias("k"))
    got = df.groupBy(keys.hash_partition(keys.string_token(F.col("k")), 3).alias("p")).count().collect()
    assert sorted(r["count"] for r in got) == [13500, 16500, 20000]


def test_windows_before_the_epoch(spark):
    df = spark.createDataFrame([(datetime(1969, 12, 31, 23, 59, 59),)], "t timestamp")
    assert df.select(windows.stamp(windows.window_end(F.col("t"), 300_000))).first()[0] == "1970/01/01T00:00:00"


def records_of(spark, rows):
    raw = spark.createDataFrame([(i, json.dumps(p), t) for i, (p, t) in enumerate(rows)], "i int, payload string, t timestamp")
    return records.envelope(raw, topic="clicks", partition=F.lit(0), offset=F.col("i"), payload=F.col("payload"), processing_time=F.col("t"))


T1, T2 = datetime(2026, 7, 26, 12, 4, 59), datetime(2026, 7, 26, 12, 5)
ROWS = [({"word": "APPLE", "count": 1}, T1), ({"word": "pie", "count": 1}, T1), ({"word": "apple", "count": 1}, T1), ({"word": "apple", "count": 5}, T2)]
WANT = [("2026/07/26T12:05:00", "apple", 2), ("2026/07/26T12:05:00", "pie", 1), ("2026/07/26T12:10:00", "apple", 5)]


@pytest.mark.parametrize("udf", [REDUCER, "other:add"])
def test_job_runs_natively_and_in_python(spark, udf):
    doc = job()
    doc["operators"][3]["udf"] = udf
    made = planner.plan(spec.build(doc), {"clicks": records_of(spark, ROWS)}, resolve=resolve)
    assert sorted(map(tuple, planner.word_output(made["report"]).collect())) == WANT
    first = made["report"].where("key = '\"apple\"'").orderBy("processing_time").first()  # the envelope of the window's first record
    assert first["record_id"] == "clicks:0:0" and first["headers"]["source_offset"] == 0 and first["headers"]["window_start"] == "2026/07/26T12:00:00"
    late = planner.plan(spec.build(doc), {"clicks": records_of(spark, ROWS)}, clock=datetime(2026, 7, 26, 12, 6, tzinfo=timezone.utc), resolve=resolve)
    assert late["report"].count() == 2  # the open window is lost
    mixed = records_of(spark, [({"word": "a", "count": 1}, T1), ({"word": "a", "count": "1"}, T1)])
    with pytest.raises(Exception, match="whole count|refuses"):
        planner.plan(spec.build(doc), {"clicks": mixed}, resolve=resolve)["report"].collect()


@pytest.mark.parametrize("payload, message", [({"word": 7, "count": 1}, "word must be text"), ({"word": "a", "count": True}, "count must be an integer"), ({"word": "a", "count": 1.5}, "count must be"), ([1], "word must be")])
def test_sink_refuses_other_types(spark, payload, message):
    with pytest.raises(Exception, match=message):
        planner.word_output(records_of(spark, [(payload, T1)])).collect()


def test_default_fold_order_is_by_offset(spark):
    df = records_of(spark, [({"word": "a", "n": i}, T1) for i in range(12)]).withColumn("key", F.lit("k"))
    n = F.get_json_object("payload", "$.n")
    got = reduce.ordered_fold(df, 1000, n, None, lambda acc, x: F.concat(acc, F.lit("-"), x), name="ids").first()["ids"]
    assert got == "-".join(map(str, range(12)))
    joined = reduce.python_fold(df, 1000, lambda a, b: {"n": f"{a['n']}-{b['n']}"}).first()["payload"]
    assert json.loads(joined)["n"] == got


@pytest.mark.parametrize(
    "step, config, path",
    [
        (0, {"connector": "kafka"}, "config.topic"), (0, {"connector": "file"}, "config.connector"), (0, {"connector": "kafka", "topic": "x" * 250}, "config.topic"),
        (0, {"connector": "kafka", "topic": "t", "speed": 1}, "config.speed"), (0, {"connector": "kafka", "topic": "t", "validator": "no"}, "config.validator"),
        (0, {"connector": "kafka", "topic": "t", "bad_record_policy": "stop"}, "config.bad_record_policy"), (0, {"connector": "kafka", "topic": "t", "group_id": ""}, "config.group_id"),
        (4, {"connector": "file", "format": "json"}, "config.format"), (4, {"output_path": "/x"}, "config.connector"),
    ],
)
def test_connector_rules(step, config, path):
    doc = job()
    doc["operators"][step]["config"] = config
    with pytest.raises(spec.SpecError) as e:
        spec.build(doc)
    assert [p for p, _ in e.value.findings] == [f"operators[{step}].{path}"]


def _topic(spark, folder, rows):
    made = [("clicks", 0, i, v if v is None or isinstance(v, bytes) else json.dumps(v).encode(), t) for i, (v, t) in enumerate(rows)]
    spark.createDataFrame(made, records.TOPIC).coalesce(1).write.mode("append").parquet(folder)


def _on_disk(spark, tmp_path, rows, **source):
    _topic(spark, f"{tmp_path}/in", rows)
    doc = job()
    doc["operators"][0]["config"] |= {"path": f"{tmp_path}/in"} | source
    doc["operators"][4]["config"]["output_path"] = f"{tmp_path}/out"
    return doc


def no_pie(p):
    if p["word"] == "pie":
        raise ValueError("no pie")


def test_run_from_config_with_policy_validator_and_metrics(spark, tmp_path):
    fns = FNS | {"page_views:check": no_pie}
    doc = _on_disk(spark, tmp_path, [*ROWS, (b"not-json", T1), (None, T1)], bad_record_policy="skip", validator="page_views:check")
    read, written = Observation(), Observation()
    paths = planner.run(spark, spec.build(doc), metrics={"clicks": read, "report": written}, resolve=lambda r, k: fns[r])
    assert sorted(map(tuple, csv_sink.read(spark, paths[0]).collect())) == [WANT[0], WANT[2]]
    assert read.get == {"records_read": 3, "bad_records": 3} and written.get == {"records_written": 2}


def test_branches_run_user_code_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(p):
        seen.add(1)
        return lower(p)

    doc = job()
    doc["operators"][4]["config"]["output_path"] = str(tmp_path)
    doc["operators"].append(doc["operators"][4] | {"id": "again"})
    doc["edges"].append({"from": "views", "to": "again"})
    paths = planner.run(spark, spec.build(doc), {"clicks": records_of(spark, ROWS).coalesce(1)}, resolve=lambda r, k: counted if r.endswith("lower") else FNS[r])
    assert len(paths) == 2 and all(sorted(map(tuple, csv_sink.read(spark, p).collect())) == WANT for p in paths)
    assert seen.value == len(ROWS)


def _until(done, seconds=90):
    end = time.time() + seconds
    while not done():
        assert time.time() < end, "the stream has not come so far"
        time.sleep(0.3)


def test_job_as_a_stream_with_late_rows_and_idle_firing(spark, tmp_path):
    doc = _on_disk(spark, tmp_path, ROWS)
    doc["operators"][3]["window"]["size"] = "4s"
    started = planner.start(spark, spec.build(doc), f"{tmp_path}/state", resolve=resolve)
    query, path = started["report"]
    rows = lambda: sorted(tuple(r) for r in csv_sink.read(spark, path, batches=True).collect())

    def have(n):
        if error := query.exception():
            raise error
        try:
            return len(rows()) >= n
        except Exception:  # nothing is written yet
            return False

    try:
        _until(lambda: have(3))
        assert [(w, n) for _, w, n in rows()] == [("apple", 2), ("pie", 1), ("apple", 5)]  # long past, so they fire at once
        _topic(spark, f"{tmp_path}/in", [({"word": "apple", "count": 7}, T1)])
        _until(lambda: have(4))  # late: a row of its own
        assert ("2026/07/26T12:05:00", "apple", 7) in rows()
        now = datetime.now(timezone.utc)
        _topic(spark, f"{tmp_path}/in", [({"word": "kiwi", "count": 1}, now), ({"word": "kiwi", "count": 2}, now)])
        _until(lambda: have(5))  # fires while no input comes
        assert [n for _, w, n in rows() if w == "kiwi"] == [3]
        assert streaming.status(query)["status"] == "RUNNING"
    finally:
        query.stop()
    assert streaming.status(query, cancelled=True)["status"] == "CANCELLED"


def test_batches_are_written_once(spark, tmp_path):
    rows = spark.createDataFrame([WANT[0]], "window_end string, word string, count bigint")
    for _ in range(2):
        csv_sink.write_batch(rows, str(tmp_path), 3)
    assert csv_sink.read(spark, str(tmp_path), batches=True).count() == 1


@pytest.mark.parametrize("value, good", [("{}", 1), ('{"n":null}', 1), ('{"n":1}', 1), ('{"n":1} junk', 0), ('{"n":1},{"n":2}', 0), ('{"n":1}}, {"x":2', 0), ("NaN", 0), ("{", 0), ("", 0)])
def test_native_decoding_is_strict(spark, value, good):
    df = spark.createDataFrame([(value.encode(),)], "v binary")
    assert records.decode(df, F.col("v"), where=F.lit("x"), policy="skip", schema="n bigint").count() == good
    assert records.decode(df, F.col("v"), where=F.lit("x"), policy="skip").count() == good


def test_tokens_of_null_and_control_characters(spark):
    texts = ["a", 'q"\\', "\x00\x1f\x0b\n\t", "\\u000b", "é\u2028", ""]
    df = spark.createDataFrame([(x,) for x in texts] + [(None,)], "k string")
    got = [r[0] for r in df.select(keys.string_token(F.col("k"))).collect()]
    assert got == [keys.canonical_json(x) for x in texts] + [None]
    with pytest.raises(Exception, match="null key"):
        df.select(keys.hash_partition(keys.string_token(F.col("k")), 8)).collect()
    both = df.where("k = 'a'").select(keys.struct_token(b=keys.string_token(F.col("k")), a=F.lit("1"))).first()[0]
    assert both == keys.canonical_json({"b": "a", "a": 1})


def test_exchanges_place_records(spark):
    df = spark.range(100).withColumn("k", F.col("id").cast("string"))
    token = keys.string_token(F.col("k"))
    placed = exchange.hash_exchange(df, token, 8).select(F.spark_partition_id().alias("p"), keys.hash_partition(token, 8).alias("want")).collect()
    assert all(r["p"] == r["want"] for r in placed)
    assert exchange.rebalance_exchange(df, 3).rdd.getNumPartitions() == 3
    with pytest.raises(ValueError):
        keys.rebalance_partition(F.col("id"), -1, 3)
    with pytest.raises(Exception, match="no downstream"):
        exchange.forward_exchange(df, F.col("id"), 3).count()


def test_late_rows_and_state(spark):
    df = records_of(spark, ROWS).withColumn("key", F.get_json_object("payload", "$.word")).withColumn("n", F.lit(1))
    got = reduce.with_late_rows(df, 300_000, F.lit(datetime(2026, 7, 26, 12, 5)), "sum", F.col("n"))
    assert got.count() == 4 and reduce.state_metrics(df, 300_000, datetime(2026, 7, 26, 12, 5, tzinfo=timezone.utc)).first()["state_entries"] == 1


def test_cli(tmp_path, capsys):
    good, bad = tmp_path / "job.json", tmp_path / "bad.json"
    good.write_text(json.dumps(job()))
    bad.write_text(json.dumps(job(name="1x")))
    assert cli.main(["validate", str(good)]) == 0 and "5 operators" in capsys.readouterr().out
    assert cli.main(["validate", str(bad)]) == 3 and cli.main(["validate", str(tmp_path / "none")]) == 4


@pytest.mark.parametrize("part", ["..", "a/b", ""])
def test_sink_folders_stay_inside(part):
    with pytest.raises(ValueError):
        csv_sink.directory("/out", part, "x")


def test_csv_quotes(spark, tmp_path):
    rows = [("2026/07/26T12:05:00", 'a,"b"\n c ', 3)]
    csv_sink.write(spark.createDataFrame(rows, "window_end string, word string, count bigint"), str(tmp_path / "x"))
    back = spark.read.schema(csv_sink.COLUMNS).options(**csv_sink.OPTIONS, multiLine=True).csv(str(tmp_path / "x")).collect()
    assert list(map(tuple, back)) == rows


def test_sink_refuses_records_without_window(spark, tmp_path):
    with pytest.raises(Exception, match="window_end is missing"):
        csv_sink.write(spark.createDataFrame([(None, "a", 1)], "window_end string, word string, count bigint"), str(tmp_path / "x"))


@pytest.mark.parametrize("value", [b"not-json", b"\xff", b'{"n":NaN}', None])
def test_bad_records(spark, value):
    df = spark.createDataFrame([(value,), (b'{"n":1}',)], "v binary")
    where = F.lit("words:0:1")
    assert records.decode(df, F.col("v"), where=where, policy="skip").count() == 1
    with pytest.raises(Exception, match="bad record at words:0:1"):
        records.decode(df, F.col("v"), where=where).collect()


def test_udf_contracts():
    with pytest.raises(udfs.ContractError):
        udfs.checked(lambda: 1, "map")
    with pytest.raises(udfs.ContractError):
        udfs.strict(float("nan"))
    assert udfs.fold_json(lambda a, b: 1 / 0, ['{"only": 1}']) == '{"only": 1}'


def test_null_key_fails_and_map_drops(spark):
    df = spark.createDataFrame([("a", None), ("b", "x")], "record_id string, payload string")
    with pytest.raises(Exception, match="null"):
        core.key_native(df, F.col("payload")).collect()
    assert core.map_native(df, F.col("payload")).count() == 1


def test_native_reduce_has_partial_aggregates(spark):
    df = records_of(spark, [({"word": "a"}, datetime(2026, 1, 1))]).withColumn("key", F.lit("a"))
    plan = reduce.declared(df, 1000, {"n": ("count", F.lit(1))})._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan


def test_bundles(spark, tmp_path, capsys):
    folder = tmp_path / "views"
    folder.mkdir()
    (folder / "page_views.py").write_text("def lower(p):\n    return p | {'word': p['word'].lower()}\n\n\ndef word(p):\n    return p['word']\n")
    (folder / "notes.txt").write_text("left out")
    (folder / "job.json").write_text(json.dumps(_on_disk(spark, tmp_path, ROWS)))
    assert cli.main(["package", str(folder), "--output-dir", str(tmp_path)]) == 0
    made = capsys.readouterr().out.strip()
    assert bundle.build(folder, tmp_path / "again").name == made.rsplit("/", 1)[1] and cli.main(["validate", made]) == 0
    bundle.ship(spark, made)
    paths = planner.run(spark, bundle.read(made))  # functions come from the bundle, on the executors too
    assert sorted(map(tuple, csv_sink.read(spark, paths[0]).collect())) == WANT
    with zipfile.ZipFile(made, "a") as z:
        z.writestr("extra.py", "x = 1")
    with pytest.raises(bundle.BundleError, match="manifest"):
        bundle.read(made)
    assert cli.main(["run", made]) == 3


def test_log_lines_carry_locators():
    out = io.StringIO()
    observability.configure(stream=out)
    observability.logger(job_id="page-views", operator_id="views").warning("late %d", 3, extra={"record_id": "clicks:0:3"})
    line = json.loads(out.getvalue())
    assert (line["message"], line["level"], line["job_id"], line["operator_id"], line["record_id"]) == ("late 3", "WARNING", "page-views", "views", "clicks:0:3")


def test_kafka_options():
    options = records.kafka_options("j", "s", {"connector": "kafka", "topic": "t"})
    assert options["kafka.bootstrap.servers"] == "kafka:9092" and options["subscribe"] == "t" and options["groupIdPrefix"] == "tidewheel-j-s"
    assert records.kafka_options("j", "s", {"topic": "t", "group_id": "g"})["kafka.group.id"] == "g"
