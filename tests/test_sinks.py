import csv
import glob
import io
import json
import struct
from decimal import Decimal

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import types as T

from millrace.errors import CapabilityError, PipelineError
from millrace.functions import codecs
from millrace.plans.pipeline import Pipeline
from millrace.plans.registry import bind, known
from millrace.sinks.writer import Policy, write_batch, write_rows
from millrace.sources import clients
from millrace.sources.files import byte_ranges, lines_of_range
from millrace.sources.services import bucket_count, bucket_ranges


class Store:
    """A client that keeps rows in a file of its own folder, and rejects some."""

    def __init__(self, config, folder, reject=None, whole=False):
        self.folder, self.reject, self.whole = folder, reject, whole

    def write(self, rows):
        import uuid

        bad = [(i, ValueError(f"bad {r}")) for i, r in enumerate(rows) if self.reject and self.reject(r)]
        if bad and self.whole:
            raise ConnectionError("batch failed")
        out = [r for i, r in enumerate(rows) if i not in dict(bad)]
        with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
            f.writelines(json.dumps(r, default=str) + "\n" for r in out)
        return bad


def stored(folder):
    return [json.loads(line) for f in glob.glob(f"{folder}/*") for line in open(f)]


DEAD = """
pipeline:
  type: chain
  transforms:
    - {type: Create, config: {elements: [{id: a, n: 1}, {id: b, n: 2}, {id: null, n: 3}, {id: d, n: 4}]}}
    - %s
  extra_transforms:
    - {type: StripErrorMetadata, name: Back, input: W.bad}
    - {type: AssertEqual, input: Back, config: {elements: [%s]}}
"""


@pytest.mark.parametrize("whole", [False, True])
def test_dead_letters_of_a_client_sink(spark, tmp_path, whole):
    folder = str(tmp_path)
    clients.use("neo4j" if whole else "mongodb", lambda config: Store(config, folder, lambda r: r["n"] == 2, whole))
    write = "{type: WriteToNeo4j, name: W, config: {statement: 'CREATE (:X {id: $id, n: $n})', error_handling: {output: bad}}}" if whole else "{type: WriteToMongoDb, name: W, config: {connection_uri: m, database: d, collection: c, schema_fields: ['id:STRING', 'n:INT64'], upsert_keys: [id], error_handling: {output: bad}}}"
    try:
        Pipeline.from_yaml(DEAD % (write, "{id: b, n: 2}")).run(spark)
        assert sorted(r["n"] for r in stored(folder)) == [1, 3, 4]
    finally:
        clients.use("mongodb", None)
        clients.use("neo4j", None)


def test_null_values_are_rejected_by_redis(spark, tmp_path):
    folder = str(tmp_path)
    clients.use("redis", lambda config: Store(config, folder))
    try:
        Pipeline.from_yaml(DEAD % ("{type: WriteToRedis, name: W, config: {key_field: id, value_field: n, error_handling: {output: bad}}}", "{id: null, n: 3}")).run(spark)
        assert sorted(r["key"] for r in stored(folder)) == ["a", "b", "d"]
    finally:
        clients.use("redis", None)


def test_rejects_without_dead_letters_fail_the_job(spark, tmp_path):
    clients.use("redis", lambda config: Store(config, str(tmp_path)))
    try:
        with pytest.raises(RuntimeError, match="id is null"):
            Pipeline.from_yaml((DEAD % ("{type: WriteToRedis, name: W, config: {key_field: id, value_field: n}}", "")).split("  extra")[0]).run(spark)
    finally:
        clients.use("redis", None)


def test_missing_libraries_are_reported(spark):
    text = "pipeline: {type: chain, transforms: [{type: ReadFromPulsar, config: {service_url: p, topic: t}}]}"
    with pytest.raises(CapabilityError, match="pulsar"):
        Pipeline.from_yaml(text).output(spark)


def test_jdbc_dead_letters(spark):
    url = "jdbc:derby:memory:letters;create=true"
    conn = spark.sparkContext._jvm.java.sql.DriverManager.getConnection(url)
    conn.createStatement().execute('CREATE TABLE T ("id" VARCHAR(10) NOT NULL, "n" BIGINT)')
    conn.close()
    write = f"{{type: WriteToJdbc, name: W, config: {{url: '{url}', table: T, batch_size: 3, error_handling: {{output: bad}}}}}}"
    Pipeline.from_yaml(DEAD % (write, "{id: null, n: 3}")).run(spark)
    got = spark.read.format("jdbc").options(url=url, dbtable="T").load()
    assert sorted(r.n for r in got.collect()) == [1, 2, 4]


def test_batches_and_retries():
    class Flaky:
        def __init__(self, fails):
            self.fails, self.calls = fails, []

        def write(self, rows):
            self.calls.append(len(rows))
            if len(self.calls) <= self.fails or "x" in rows:
                raise OSError("no")

    waits = []
    assert write_batch(Flaky(2), ["a", "b"], Policy(2, "batch", 3, 1.0, exponential=True), waits.append) == [] and waits == [1.0, 2.0]
    waits.clear()
    assert [i for i, _ in write_batch(Flaky(9), ["a", "b"], Policy(2, "batch", 2, 1.0, exponential=False), waits.append)] == [0, 1] and waits == [1.0, 2.0]
    client = Flaky(0)
    assert [i for i, _ in write_batch(client, ["a", "x", "c"], Policy(3, "row"))] == [1] and client.calls == [3, 1, 1, 1]
    assert [i for i, _ in write_batch(Flaky(0), ["x"], Policy(3, "row", 5, 1.0, retry_on=lambda e: False), waits.append)] == [0]
    letters = list(write_rows(Flaky(0), iter([{"v": "a"}, {"v": None}, {"v": "x"}]), Policy(1), lambda r: r["v"].strip(), "t"))
    assert [(x["element"]["v"], x["error_type"], x["transform"]) for x in letters] == [(None, "AttributeError", "t"), ("x", "OSError", "t")]


def test_a_second_run_into_one_folder_loses_no_row(spark, tmp_path):
    from millrace.sinks.files import publish

    for values in ("ab", "cd", "ef"):
        staged = f"{tmp_path}/out/_staged-{values}"
        spark.createDataFrame([(v,) for v in values], "content string").coalesce(1).write.text(staged)
        assert publish(spark, staged, f"{tmp_path}/out", "output") == 1
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/out").collect()) == list("abcdef")
    # a repeated batch of a stream takes its own place
    for values in ("gh", "hi"):
        staged = f"{tmp_path}/out/_staged-{values}"
        spark.createDataFrame([(v,) for v in values], "content string").coalesce(1).write.text(staged)
        publish(spark, staged, f"{tmp_path}/out", "output-7", replace=True)
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/out").collect()) == list("abcdefhi")


def test_a_failed_move_keeps_the_staged_files(spark, tmp_path, monkeypatch):
    import os

    from millrace.sinks.files import publish

    staged = f"{tmp_path}/out/_staged"
    spark.createDataFrame([(v,) for v in "ab"], "content string").repartition(2).write.text(staged)
    os.makedirs(f"{tmp_path}/out/x-00001-of-00002.txt/full")  # a folder stands where the second file goes
    open(f"{tmp_path}/out/x-00001-of-00002.txt/full/file", "w").close()
    with pytest.raises(Exception, match="moved|not empty"):
        publish(spark, staged, f"{tmp_path}/out", "x", replace=True)
    assert os.path.isdir(staged)


def test_file_sink_names_and_nulls(spark, tmp_path):
    text = f"""
pipeline:
  type: chain
  transforms:
    - {{type: Create, config: {{elements: [{{content: a}}, {{content: null}}, {{content: 'b, "c"'}}]}}}}
    - {{type: WriteToFilesystem, name: W, config: {{path: {tmp_path}/out, num_shards: 2, file_prefix: x, error_handling: {{output: bad}}}}}}
  extra_transforms:
    - {{type: StripErrorMetadata, name: B, input: W.bad}}
    - {{type: AssertEqual, input: B, config: {{elements: [{{content: null}}]}}}}
"""
    Pipeline.from_yaml(text).run(spark)
    names = sorted(p.rpartition("/")[2] for p in glob.glob(f"{tmp_path}/out/x-*"))
    assert names == ["x-00000-of-00002.txt", "x-00001-of-00002.txt"]
    assert sorted(r[0] for r in spark.read.text(f"{tmp_path}/out").collect()) == ["a", 'b, "c"']


def test_csv_cells(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name,ok\n1,"x, ""y""\nz",YES\n2,  ,n\n3\n')
    read = lambda name: Pipeline.from_yaml(f"pipeline: {{type: chain, transforms: [{{type: ReadFromFilesystem, config: {{path: '{tmp_path}/{name}', file_format: csv, header: true, schema_fields: ['id:int', 'name:string', 'ok:boolean']}}}}]}}").output(spark)
    assert sorted(map(tuple, read("a.csv").collect())) == [(1, 'x, "y"\nz', True), (2, None, False), (3, None, None)]
    (tmp_path / "b.csv").write_text("id,name,ok\n1,a,perhaps\n")
    (tmp_path / "c.csv").write_text("id,name,ok\n1,a,true,more\n")
    for bad in ("b.csv", "c.csv"):
        with pytest.raises(Exception):
            read(bad).collect()


@given(st.lists(st.text(alphabet="ab", max_size=5), max_size=12), st.integers(1, 9), st.booleans())
def test_byte_ranges_give_each_line_once(lines, split, ended):
    data = "\n".join(lines).encode() + (b"\n" if ended and lines else b"")
    got = [x for a, b in byte_ranges(len(data), split) for x in lines_of_range(lambda at, n: data[at : at + n], a, b, block=3)]
    want = data.split(b"\n")
    assert got == (want[:-1] if want[-1] == b"" else want)


def test_buckets():
    assert bucket_count(0, None) == 1 and bucket_count(250_000, None) == 3 and bucket_count(10**9, None) == 1000 and bucket_count(5, 7) == 7
    assert bucket_ranges([(1, 5), (5, 9), (9, 12)]) == [{"low": 1, "high": 5, "last": False}, {"low": 5, "high": 9, "last": False}, {"low": 9, "high": 12, "last": True}]


@given(st.integers(1, 300))
def test_token_ranges_cover_all(n):
    ranges = codecs.token_ranges(n)
    assert ranges[0][0] == -(2**63) and ranges[-1][1] == 2**63 - 1
    assert all(a[1] + 1 == b[0] for a, b in zip(ranges, ranges[1:], strict=False))


def test_codecs():
    assert codecs.with_token_range("SELECT * FROM t WHERE a = 'LIMIT' LIMIT 5", "k", 1, 2) == "SELECT * FROM t WHERE a = 'LIMIT' AND token(k) >= 1 AND token(k) <= 2 LIMIT 5"
    assert codecs.with_token_range("SELECT a FROM t;", "k", 1, 2) == "SELECT a FROM t WHERE token(k) >= 1 AND token(k) <= 2"
    assert codecs.cypher_parameters("MATCH (n {a: $a, b: '$no'}) // $no\n SET n.`$no` = $`b c` /* $no */ RETURN $a") == ["a", "b c"]
    assert codecs.cell_decode(codecs.cell_encode(-5, T.LongType()), T.LongType()) == -5
    with pytest.raises(ValueError):
        codecs.cell_decode(struct.pack(">i", 1), T.LongType())
    assert codecs.document_value(3.0, T.IntegerType()) == 3
    for value, kind in ((3.5, T.IntegerType()), ("x", T.BooleanType()), (2**40, T.IntegerType()), (True, T.LongType())):
        with pytest.raises(ValueError):
            codecs.document_value(value, kind)
    assert codecs.document_value("12", T.LongType(), numeric_text=True) == 12
    schema = codecs.dynamo_schema([{"b": {"S": "x"}}, {"b": {"N": "1"}, "a": {"SS": ["q"]}}])
    assert schema.simpleString() == "struct<a:array<string>,b:decimal(38,18)>"
    assert codecs.dynamo_value({"L": [{"S": "x"}, {"M": {"k": {"N": "1"}}}]}, T.ArrayType(T.StringType())) == ["x", '{"k":"1"}']
    assert codecs.dynamo_attribute({"a": [1, None, b"x", True, Decimal("1.5")]}) == {"M": {"a": {"L": [{"N": "1"}, {"NULL": True}, {"B": b"x"}, {"BOOL": True}, {"N": "1.5"}]}}}
    assert codecs.cassandra_type("map<text, frozen<list<int>>>").simpleString() == "map<string,array<int>>"
    assert codecs.prometheus_rows({"status": "success", "data": {"resultType": "matrix", "result": []}}) == []
    assert codecs.change_row("k", '{"payload": {"op": "u", "after": {"a": 1}, "ts_ms": 5}}') == {"op": "u", "key": "k", "before": None, "after": '{"a":1}', "source": None, "ts_ms": 5}
    assert codecs.change_row(None, "") is None


class Fake:
    def __init__(self, config):
        self.config = config

    def read(self, partition):
        return iter([{"key": k, "value": k * 2} for k in partition["keys"]])

    def keys(self, pattern):
        return ["a", "b", "b"]


def test_client_source(spark):
    clients.use("redis", Fake)
    try:
        got = Pipeline.from_yaml("pipeline: {type: chain, transforms: [{type: ReadFromRedis}]}").output(spark)
        assert sorted(map(tuple, got.collect())) == [("a", "aa"), ("b", "bb")]
    finally:
        clients.use("redis", None)


VALID = {
    "ReadFromKafka": {"bootstrap_servers": "b", "topics": ["t"]}, "ReadFromRedis": {"mode": "keys", "keys": ["a"]}, "ReadFromRabbitMQ": {"queue": "q"}, "ReadFromSQS": {"queue_url": "q"},
    "ReadFromDynamoDB": {"table_name": "t"}, "ReadFromMongoDb": {"connection_uri": "m", "database": "d", "collection": "c"}, "ReadFromElasticsearch8": {"connection_uri": "e", "index": "i"},
    "ReadFromElasticsearch6": {"connection_uri": "e", "indices": ["i"]}, "ReadFromDebezium": {"host": "h", "user": "u", "allow_ephemeral_state": True}, "ReadFromCassandra": {"keyspace": "k", "query": "select 1"},
    "ReadFromHBase": {"zookeeper_quorum": "z", "table": "t", "schema_fields": ["a:STRING"]}, "ReadFromNeo4j": {"query": "q", "schema_fields": ["a"]}, "ReadFromFtp": {"host": "h", "path": "p"},
    "ReadFromPrometheus": {"query": "up"}, "ReadFromPulsar": {"service_url": "s", "topic": "t"}, "ReadFromClickHouse": {"query": "select 1"}, "ReadFromHive": {"table": "t"},
    "ReadFromIceberg": {"warehouse": "w", "table": "t", "schema_fields": ["a:INT64"]}, "ReadFromFilesystem": {"path": "p"}, "WriteToKafka": {"bootstrap_servers": "b"}, "WriteToSQS": {"queue_url": "q"},
    "WriteToRabbitMQ": {"queue": "q"}, "WriteToDynamoDB": {"table_name": "t"}, "WriteToCassandra": {"keyspace": "k", "table": "t"}, "WriteToRedis": {}, "WriteToClickHouse": {"table": "t"},
    "WriteToHBase": {"zookeeper_quorum": "z", "table": "t", "schema_fields": ["a:STRING"]}, "WriteToElasticsearch6": {"connection_uri": "e", "index": "i"}, "WriteToIceberg": {"warehouse": "w", "table": "t", "schema_fields": ["a:INT64"]},
}
BAD = [
    ("ReadFromKafka", {"topic_pattern": "x"}), ("ReadFromKafka", {"scan_startup_mode": "timestamp"}), ("ReadFromKafka", {"scan_bounded_specific_offsets": {"t:0": 1}}), ("ReadFromKafka", {"properties": {"group.id": "g"}}),
    ("ReadFromKafka", {"scan_startup_mode": "group-offsets"}), ("ReadFromKafka", {"scan_startup_mode": "specific-offsets", "scan_startup_specific_offsets": {"t": 1}}), ("ReadFromKafka", {"key_format": "avro"}),
    ("ReadFromRedis", {"key_pattern": "*"}), ("ReadFromRedis", {"keys": []}), ("ReadFromRabbitMQ", {"streaming": True}), ("ReadFromSQS", {"batch_size": 11}), ("ReadFromSQS", {"streaming": True}),
    ("ReadFromDynamoDB", {"parallel_scan_segments": 2, "key_condition_expression": "x"}), ("ReadFromMongoDb", {"partition_num": 1001}), ("ReadFromMongoDb", {"limit": 0}), ("ReadFromMongoDb", {"limit": 5, "partition_num": 2}),
    ("ReadFromElasticsearch8", {"indices": ["x"]}), ("ReadFromElasticsearch8", {"limit": 3, "scan_slices": 2}), ("ReadFromElasticsearch8", {"schema_fields": ["a:int64"]}), ("ReadFromDebezium", {"allow_ephemeral_state": False}),
    ("ReadFromDebezium", {"connector": "postgres"}), ("ReadFromCassandra", {"parallel_scan_segments": 2}), ("ReadFromHBase", {"schema_fields": ["a:STRING", "x:a:INT32"]}), ("ReadFromHBase", {"rowkey_format": "hex"}),
    ("ReadFromNeo4j", {"query": "MATCH $x"}), ("ReadFromFtp", {"host_name": "other"}), ("ReadFromFtp", {"file_format": "csv"}), ("ReadFromPulsar", {"start_position": "middle"}), ("ReadFromClickHouse", {"query": "drop table t"}),
    ("ReadFromHive", {"partitions": ["a=1"], "partition_filter": "x"}), ("ReadFromHive", {"aggregates": [{"type": "count"}], "limit": 5}), ("ReadFromIceberg", {"limit": 5, "split_size": 1}), ("ReadFromIceberg", {"filter": "a ="}),
    ("ReadFromIceberg", {"schema_fields": ["a:MAP"]}), ("ReadFromFilesystem", {"file_format": "csv"}), ("ReadFromFilesystem", {"sheet": "x"}), ("ReadFromFilesystem", {"csv_delimiter": "||"}), ("WriteToKafka", {"sink_delivery_guarantee": "exactly-once"}),
    ("WriteToSQS", {"batch_size": 0}), ("WriteToRabbitMQ", {"declare_exchange": True}), ("WriteToDynamoDB", {"batch_size": 26}), ("WriteToCassandra", {"batch_size": 0}), ("WriteToRedis", {"mode": "zadd"}), ("WriteToIceberg", {"write_mode": "merge"}),
]


@pytest.mark.parametrize("name", sorted(VALID))
def test_configs_that_are_valid(spark, name):
    node = bind(known()[name], VALID[name], name)
    assert node.delivery() is not None
    with pytest.raises(PipelineError, match="unknown options"):
        bind(known()[name], {**VALID[name], "nope": 1}, name)


@pytest.mark.parametrize("name, change", BAD)
def test_configs_that_are_not_valid(spark, name, change):
    with pytest.raises(PipelineError):
        bind(known()[name], {**VALID[name], **change}, name)


def test_kafka_is_unbounded_only_if_asked(spark):
    cls = known()["ReadFromKafka"]
    assert not bind(cls, VALID["ReadFromKafka"], "k").unbounded()
    streaming = bind(cls, {**VALID["ReadFromKafka"], "scan_bounded_mode": "unbounded"}, "k")
    assert streaming.unbounded() and "endingOffsets" not in streaming.options()
    node = bind(cls, {**VALID["ReadFromKafka"], "scan_startup_mode": "specific-offsets", "scan_startup_specific_offsets": {"t:0": 5}}, "k")
    assert node.options()["startingOffsets"] == '{"t": {"0": 5}}' and node.options()["endingOffsets"] == "latest"


def test_ftp_lines():
    from millrace.sinks.services import format_csv

    node = bind(known()["WriteToFtp"], {"host": "h", "path": "p", "file_format": "csv", "schema_fields": ["a:string", "b:int"]}, "f")
    line = node.converter(T._parse_datatype_string("a string, b int"))({"a": 'x,"y"', "b": None})
    assert next(csv.reader(io.StringIO(line))) == ['x,"y"', ""] and format_csv(["a"], node.config) == "a\n"
