import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.plans.pipeline import Pipeline
from millrace.sources import clients
from millrace.sources.streams import queue_source
from millrace.streaming.windows import EVENT_TIME, WINDOW, WindowSpec, assign_sessions, assign_windows, count_windows, event_time


def change(i, op="c"):
    return json.dumps({"payload": {"op": op, "after": {"id": i}, "ts_ms": i * 1000}}) + "\n"


def test_a_restart_leaves_no_gap(spark, tmp_path):
    """Files that arrive between two runs of one checkpoint are each written once."""
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    text = f"""
pipeline:
  type: chain
  transforms:
    - {{type: ReadFromDebezium, config: {{path: '{source}'}}}}
    - {{type: Filter, config: {{field: op, operator: in, values: [c, r, u]}}}}
    - {{type: JsonToFields, config: {{field: after, fields: ['id:long']}}}}
    - {{type: MapToFields, config: {{fields: {{id: id}}}}}}
    - {{type: WriteToSpark, config: {{format: parquet, path: '{out}'}}}}
"""
    options = {"checkpoint": str(tmp_path / "checkpoint"), "trigger": "available_now"}
    (source / "a.json").write_text(change(1) + change(2, "d") + change(3))
    Pipeline.from_yaml(text).run(spark, options)
    (source / "b.json").write_text(change(4))
    Pipeline.from_yaml(text).run(spark, options)
    assert sorted(r.id for r in spark.read.parquet(str(out)).collect()) == [1, 3, 4]


def test_streamed_windows_match_the_batch(spark, tmp_path):
    rows = spark.range(500).select(F.timestamp_seconds(F.col("id") * 37).alias("ts"), "id")
    rows.write.parquet(str(tmp_path / "t"))
    spec = WindowSpec.parse({"type": "fixed", "size": "10m"})
    stream = spark.readStream.schema("ts timestamp, id long").parquet(str(tmp_path / "t"))
    query = count_windows(stream, "ts", spec).writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    query.awaitTermination(60)
    want = sorted(map(tuple, count_windows(rows, "ts", spec).collect()))
    assert sorted(map(tuple, spark.table("windows").collect())) == want


def test_assigned_windows(spark):
    rows = event_time(spark.createDataFrame([(0, "a"), (5, "a"), (100, "a"), (3, "b")], "s long, k string").withColumn("ts", F.timestamp_seconds("s")), "ts")
    count = lambda df: sorted(r.n for r in df.groupBy(f"{WINDOW}.start", f"{WINDOW}.end").agg(F.count("*").alias("n")).collect())
    assert count(assign_windows(rows, WindowSpec.parse({"type": "fixed", "size": "10s"}))) == [1, 3]
    assert assign_windows(rows, WindowSpec.parse({"type": "sliding", "size": "10s", "period": "5s"})).count() == 8
    assert count(assign_windows(rows, WindowSpec.parse({"type": "session", "gap": "10s"}))) == [1, 3]
    assert sorted(r.n for r in assign_sessions(rows, 10_000, ["k"]).groupBy("k", WINDOW).agg(F.count("*").alias("n")).collect()) == [1, 1, 2]
    assert assign_windows(rows.drop(EVENT_TIME), WindowSpec.parse({"type": "fixed", "size": "1s"})).columns == ["s", "k", "ts"]


def test_windowing_of_roots_is_inherited(spark):
    text = "pipeline: {type: composite, windowing: {type: fixed, size: 1h}, output: M, transforms: [{type: ReadFromSpark, name: R, config: {format: parquet, path: /root/testdata/sf0.001/events.parquet, event_time: ts}}, {type: MapToFields, name: M, input: R, config: {append: true, fields: {w: _window}}}]}"
    df = Pipeline.from_yaml(text).output(spark)
    assert df.select("w.start").distinct().count() > 1


class Queue:
    """Gives ten messages, three at a time, and takes acknowledgements."""

    def __init__(self, config):
        self.at = 0

    def poll(self):
        rows = [{"message_id": str(i), "body": f"b{i}", "receipt_handle": "r", "attributes": {}} for i in range(self.at, min(10, self.at + 3))]
        self.at += len(rows)
        return rows, [r["message_id"] for r in rows]

    def ack(self, tags):
        pass


def test_queue_stream(spark):
    clients.use("sqs", Queue)
    try:
        schema = T._parse_datatype_string("message_id string, body string, receipt_handle string, attributes map<string,string>")
        spark.dataSource.register(queue_source("test_queue", Queue, None, schema))
        query = spark.readStream.format("millrace_test_queue").load().writeStream.format("memory").queryName("queue").trigger(processingTime="100 milliseconds").start()
        import time

        end = time.time() + 60
        while time.time() < end and spark.table("queue").count() < 10:
            time.sleep(0.3)
        query.stop()
        assert sorted(int(r.message_id) for r in spark.table("queue").collect()) == list(range(10))
    finally:
        clients.use("sqs", None)


def test_ticker_builds_as_a_stream(spark):
    assert Pipeline.from_yaml("pipeline: {type: composite, output: T, transforms: [{type: ReadRunnerSmokeTicker, name: T}]}").output(spark).isStreaming
