"""Unbounded sources: Kafka, queues, change data, and a ticker."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from millrace.errors import CapabilityError, PipelineError
from millrace.functions import codecs
from millrace.plans.registry import Context, Data, Delivery, Source, transform
from millrace.sources import clients
from millrace.sources.services import AwsOptions, ClientSource, read_partitions
from millrace.sources.tables import has_class
from millrace.streaming.windows import event_time

FORMATS = {"string": T.StringType(), "raw": T.BinaryType()}
#: Properties that the engine sets itself.
RESERVED = {"bootstrap.servers", "group.id", "key.deserializer", "value.deserializer", "key.serializer", "value.serializer", "enable.auto.commit", "auto.offset.reset"}
KAFKA_CLASS = "org.apache.spark.sql.kafka010.KafkaSourceProvider"


def offsets_json(offsets: dict[str, int]) -> str:
    """``{"topic:partition": offset}`` as Spark's offsets."""
    out: dict[str, dict[str, int]] = {}
    for key, offset in offsets.items():
        topic, colon, partition = key.rpartition(":")
        if not colon or not partition.isdigit() or isinstance(offset, bool) or not isinstance(offset, int) or offset < 0:
            raise PipelineError(f"{key!r}: {offset!r} is not topic:partition: offset")
        out.setdefault(topic, {})[partition] = offset
    return json.dumps(out, sort_keys=True)


def kafka_columns(df: DataFrame, key_format: str, value_format: str) -> DataFrame:
    """Kafka's rows in the fixed schema; the last of equal headers wins."""
    decoded = lambda n, f: F.col(n).cast("string") if f == "string" else F.col(n)
    headers = F.col("headers")
    last = F.filter(headers, lambda h, i: ~F.exists(F.slice(headers, i + 2, F.size(headers)), lambda o: o["key"] == h["key"]))
    kinds = F.when(F.col("timestampType") == 0, "CREATE_TIME").when(F.col("timestampType") == 1, "LOG_APPEND_TIME").otherwise("NO_TIMESTAMP_TYPE")
    return df.select(
        decoded("key", key_format).alias("key"),
        decoded("value", value_format).alias("value"),
        "topic",
        F.col("partition").cast("int").alias("partition"),
        F.col("offset").cast("long").alias("offset"),
        F.unix_millis(F.col("timestamp").cast("timestamp")).alias("timestamp"),
        kinds.alias("timestamp_type"),
        F.when(headers.isNotNull(), F.map_from_arrays(F.transform(last, lambda h: h["key"]), F.transform(last, lambda h: h["value"]))).alias("headers"),
    )


@transform
class ReadFromKafka(Source):
    type = "ReadFromKafka"
    tier = "experimental"

    @dataclass
    class Config:
        bootstrap_servers: str
        topics: list[str] = field(default_factory=list)
        topic_pattern: str = ""
        group_id: str = ""
        properties: dict[str, Any] = field(default_factory=dict)
        scan_startup_mode: str = "earliest-offset"
        scan_startup_specific_offsets: dict[str, Any] = field(default_factory=dict)
        scan_startup_timestamp_millis: int | None = None
        scan_bounded_mode: str = "latest-offset"
        scan_bounded_specific_offsets: dict[str, Any] = field(default_factory=dict)
        scan_bounded_timestamp_millis: int | None = None
        key_format: str = "string"
        value_format: str = "string"
        commit_offsets_on_checkpoint: bool = False

    def check(self) -> None:
        c = self.config
        if bool(c.topics) == bool(c.topic_pattern):
            raise PipelineError("give topics or topic_pattern")
        for side, first in (("startup", "earliest-offset"), ("bounded", "unbounded")):
            mode = getattr(c, f"scan_{side}_mode")
            if mode not in (first, "latest-offset", "group-offsets", "specific-offsets", "timestamp"):
                raise PipelineError(f"scan_{side}_mode {mode!r} is not known")
            offsets, at = getattr(c, f"scan_{side}_specific_offsets"), getattr(c, f"scan_{side}_timestamp_millis")
            if bool(offsets) != (mode == "specific-offsets") or (at is not None) != (mode == "timestamp"):
                raise PipelineError(f"scan_{side}_specific_offsets and _timestamp_millis belong to their modes")
            offsets_json(offsets)
        if c.scan_startup_timestamp_millis is not None and c.scan_bounded_timestamp_millis is not None and c.scan_startup_timestamp_millis > c.scan_bounded_timestamp_millis:
            raise PipelineError("the start is after the end")
        if not {c.key_format, c.value_format} <= set(FORMATS):
            raise PipelineError("formats must be string or raw")
        if bad := RESERVED & set(c.properties):
            raise PipelineError(f"properties are set by the engine: {', '.join(sorted(bad))}")
        if not c.group_id and (c.commit_offsets_on_checkpoint or "group-offsets" in (c.scan_startup_mode, c.scan_bounded_mode)):
            raise PipelineError("group_id is needed")

    def unbounded(self) -> bool:
        return self.config.scan_bounded_mode == "unbounded"

    def delivery(self) -> Delivery:
        return Delivery("AT_LEAST_ONCE", "RESUMABLE" if self.unbounded() else "FULL_REPLAY", "PER_KEY")

    def options(self) -> dict[str, str]:
        c = self.config
        out = {"kafka.bootstrap.servers": c.bootstrap_servers, "includeHeaders": "true"} | {f"kafka.{k}": str(v) for k, v in c.properties.items()}
        out |= {"subscribe": ",".join(c.topics)} if c.topics else {"subscribePattern": c.topic_pattern}
        if c.group_id:
            out["kafka.group.id"] = c.group_id
        sides = [("startup", "starting")] if self.unbounded() else [("startup", "starting"), ("bounded", "ending")]
        for side, name in sides:
            mode = getattr(c, f"scan_{side}_mode")
            if mode in ("earliest-offset", "latest-offset"):
                out[f"{name}Offsets"] = mode.removesuffix("-offset")
            elif mode == "specific-offsets":
                out[f"{name}Offsets"] = offsets_json(getattr(c, f"scan_{side}_specific_offsets"))
            elif mode == "timestamp":
                out[f"{name}Timestamp"] = str(getattr(c, f"scan_{side}_timestamp_millis"))
        return out

    def read(self, ctx: Context) -> Data:
        c = self.config
        if not has_class(ctx.spark, KAFKA_CLASS):
            raise CapabilityError("the spark-sql-kafka package is not on the class path")
        if "group-offsets" in (c.scan_startup_mode, c.scan_bounded_mode):
            raise CapabilityError("a group's committed offsets need a Kafka admin client; give specific-offsets")
        reader = ctx.spark.readStream if self.unbounded() else ctx.spark.read
        return Data.of(kafka_columns(reader.format("kafka").options(**self.options()).load(), c.key_format, c.value_format))


# Queues


def queue_source(kind: str, factory: Callable, config: Any, schema: T.StructType) -> type[DataSource]:
    """A streaming data source over a queue client: ``poll() -> (rows, tags)`` and ``ack(tags)``.

    Rows are acknowledged when their batch is committed, not when they are read,
    so a lost batch is delivered again.
    """
    names = schema.names

    class Reader(SimpleDataSourceStreamReader):
        def __init__(self) -> None:
            self.client, self.batches, self.tags = None, {}, {}

        def initialOffset(self) -> dict:
            return {"batch": 0}

        def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
            self.client = self.client or factory(config)
            rows, tags = self.client.poll()
            end = {"batch": start["batch"] + bool(rows)}
            if rows:
                self.batches[start["batch"]], self.tags[start["batch"]] = [tuple(r.get(n) for n in names) for r in rows], tags
            return iter(self.batches.get(start["batch"], []) if rows else []), end

        def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
            return iter([r for b in range(start["batch"], end["batch"]) for r in self.batches.get(b, [])])

        def commit(self, end: dict) -> None:
            for b in [b for b in self.tags if b < end["batch"]]:
                self.client.ack(self.tags.pop(b))
                self.batches.pop(b, None)

    class Queue(DataSource):
        @classmethod
        def name(cls) -> str:
            return f"millrace_{kind}"

        def schema(self) -> T.StructType:
            return schema

        def simpleStreamReader(self, schema: T.StructType) -> SimpleDataSourceStreamReader:
            return Reader()

    return Queue


class _Queue(ClientSource):
    limit_option = "max_messages"

    def unbounded(self) -> bool:
        return self.config.streaming

    def check(self) -> None:
        if self.config.streaming and self.config.max_messages:
            raise PipelineError("streaming needs max_messages: 0")
        if self.config.max_messages < 0:
            raise PipelineError("max_messages must not be negative")

    def read(self, ctx: Context) -> Data:
        if not self.config.streaming:
            return super().read(ctx)
        source = queue_source(self.kind, clients.factory(self.kind), self.config, self.schema(lambda: None))
        ctx.spark.dataSource.register(source)
        return Data.of(ctx.spark.readStream.format(source.name()).load())


@dataclass
class RabbitConnection:
    host: str = "localhost"
    port: int = 5672
    virtual_host: str = "/"
    username: str = "guest"
    password: str = "guest"


@transform
class ReadFromRabbitMQ(_Queue):
    type = "ReadFromRabbitMQ"
    kind = "rabbitmq"

    @dataclass
    class Config(RabbitConnection):
        queue: str = ""
        max_messages: int = 1000
        wait_timeout_ms: int = 1000
        streaming: bool = False

    def check(self) -> None:
        super().check()
        if not self.config.queue:
            raise PipelineError("queue is required")

    def delivery(self) -> Delivery:
        return Delivery("AT_LEAST_ONCE" if self.config.streaming else "AT_MOST_ONCE", "NONE", "NONE")

    def schema(self, client: Callable[[], Any]) -> T.StructType:
        return T._parse_datatype_string("exchange string not null, routing_key string not null, body string not null, message_id string, delivery_tag bigint not null")


@transform
class ReadFromSQS(_Queue):
    type = "ReadFromSQS"
    kind = "sqs"

    @dataclass
    class Config(AwsOptions):
        queue_url: str = ""
        max_messages: int = 10
        batch_size: int = 10
        visibility_timeout: int = 30
        wait_time_seconds: int = 20
        delete_after_read: bool = True
        streaming: bool = False

    def check(self) -> None:
        super().check()
        c = self.config
        if not c.queue_url or not 1 <= c.batch_size <= 10 or not 0 <= c.visibility_timeout <= 43_200 or not 0 <= c.wait_time_seconds <= 20:
            raise PipelineError("queue_url, batch_size 1-10, visibility_timeout 0-43200 and wait_time_seconds 0-20 are needed")

    def delivery(self) -> Delivery:
        return Delivery("AT_MOST_ONCE" if self.config.delete_after_read and not self.config.streaming else "AT_LEAST_ONCE", "NONE", "NONE")

    def schema(self, client: Callable[[], Any]) -> T.StructType:
        return T._parse_datatype_string("message_id string not null, body string not null, receipt_handle string not null, attributes map<string,string>")


# Change data


def change_events(df: DataFrame, value: str = "value", key: str | None = None) -> DataFrame:
    """The fixed change schema from rows of event JSON; rows without an operation are dropped."""
    doc = F.try_parse_json(F.col(value))
    payload = F.coalesce(F.try_variant_get(doc, "$.payload", "variant"), doc)
    part = lambda n: F.to_json(F.try_variant_get(payload, f"$.{n}", "variant"))
    void = lambda c: F.when(c != "null", c)
    out = df.select("*", payload.alias("_payload"))
    payload = F.col("_payload")
    found = out.select(
        F.try_variant_get(payload, "$.op", "string").alias("op"),
        (F.col(key).cast("string") if key else F.lit(None).cast("string")).alias("key"),
        *(void(part(n)).alias(n) for n in ("before", "after", "source")),
        F.try_variant_get(payload, "$.ts_ms", "bigint").alias("ts_ms"),
    )
    return found.where("op is not null")


@transform
class ReadFromDebezium(Source):
    """Change events: from an engine client, or as JSON lines of a directory that a capture process fills.

    The stream's checkpoint takes the place of offset files and leases.  With
    ``follow: false`` a path is read once, as a batch of all that it holds.
    """

    type = "ReadFromDebezium"
    tier = "experimental"

    @dataclass
    class Config:
        connector: str = "mysql"
        connector_class: str | None = None
        host: str | None = None
        port: int | None = None
        user: str | None = None
        password: str | None = None
        database: str | None = None
        table_include: str | None = None
        snapshot_mode: str | None = "initial"
        server_name: str | None = "millrace"
        server_id: int | None = 184054
        offset_file: str | None = None
        schema_history_file: str | None = None
        name: str | None = "millrace-changes"
        max_records: int | None = None
        allow_ephemeral_state: bool = False
        lease_timeout_ms: int = 30_000
        job_id: str | None = None
        extra: dict[str, Any] | None = None
        path: str = ""
        follow: bool = True

    def check(self) -> None:
        c = self.config
        if not c.follow and not c.path:
            raise PipelineError("follow: false reads what a path holds, so it needs one")
        if c.port is not None and not 1 <= c.port <= 65535 or c.max_records is not None and c.max_records < 1 or c.lease_timeout_ms < 1:
            raise PipelineError("port, max_records or lease_timeout_ms is out of range")
        if c.path:
            return
        if not c.connector_class:
            if c.connector not in ("mysql", "postgres"):
                raise PipelineError("connector must be mysql or postgres, or give connector_class")
            if not c.host or not c.user or c.connector == "postgres" and not c.database:
                raise PipelineError(f"{c.connector} needs host and user" + (" and database" if c.connector == "postgres" else ""))
        if self.unbounded() and not c.allow_ephemeral_state and (not c.offset_file or c.connector == "mysql" and not c.connector_class and not c.schema_history_file):
            raise PipelineError("an unbounded job needs offset_file (and schema_history_file for mysql), or allow_ephemeral_state")

    def unbounded(self) -> bool:
        return self.config.max_records is None and self.config.follow

    def delivery(self) -> Delivery:
        return Delivery("AT_LEAST_ONCE", "RESUMABLE" if self.unbounded() else "FULL_REPLAY", "GLOBAL")

    def read(self, ctx: Context) -> Data:
        c = self.config
        if c.path:
            reader = ctx.spark.readStream if self.unbounded() else ctx.spark.read
            df = change_events(reader.schema("value string").text(c.path))
            if self.unbounded():
                return Data.of(event_time(df.withColumn("_ts", F.timestamp_millis("ts_ms")), "_ts").drop("_ts"))
            return Data.of(df.limit(c.max_records) if c.max_records else df)
        factory = clients.factory("debezium")
        if not self.unbounded():
            df = read_partitions(ctx.spark, [{}], codecs.CHANGES, factory, c, lambda client, p: client.read(p))
            return Data(df.limit(c.max_records), codecs.CHANGES)
        source = queue_source("debezium", factory, c, codecs.CHANGES)
        ctx.spark.dataSource.register(source)
        return Data.of(ctx.spark.readStream.format(source.name()).load())


@transform
class ReadRunnerSmokeTicker(Source):
    """An unbounded sequence, to see that streaming runs."""

    type = "ReadRunnerSmokeTicker"

    @dataclass
    class Config:
        rows_per_second: int = 1

    def unbounded(self) -> bool:
        return True

    def delivery(self) -> Delivery:
        return Delivery("AT_LEAST_ONCE", "RESUMABLE", "GLOBAL")

    def read(self, ctx: Context) -> Data:
        df = ctx.spark.readStream.format("rate").option("rowsPerSecond", self.config.rows_per_second).load()
        return Data.of(event_time(df.withColumnRenamed("value", "sequence"), "timestamp").drop("timestamp"))
