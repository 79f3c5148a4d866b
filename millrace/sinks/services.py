"""Sinks over client libraries: what is written, how a batch fails, and what needs a key."""

from __future__ import annotations

import csv
import io
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import CapabilityError, PipelineError
from millrace.functions import codecs
from millrace.functions.types import parse_fields
from millrace.plans.registry import Context, Data, Delivery, transform
from millrace.sinks.tables import TableSink
from millrace.sinks.writer import ClientSink, Policy
from millrace.sources.services import AwsOptions, FtpOptions, HBaseTable, RedisConnection, positive
from millrace.sources.streams import FORMATS, KAFKA_CLASS, RESERVED, RabbitConnection
from millrace.sources.tables import has_class

KEYED = Delivery("AT_LEAST_ONCE", "NONE", "NONE", needs_key=True)
FREE = Delivery("AT_LEAST_ONCE", "NONE", "NONE")


def declared_or_document(fields: list[str], schema: T.StructType) -> Callable[[dict], Any]:
    """Rows by declared fields, or the JSON text of ``document``."""
    import json

    if not fields:
        if "document" not in schema.names:
            raise PipelineError("without schema_fields the input needs a field document")

        def whole(row: dict) -> dict:
            value = json.loads(row["document"]) if row["document"] is not None else None
            if not isinstance(value, dict):
                raise ValueError("document is not a JSON object")
            return value

        return whole
    declared = parse_fields(fields, codecs.DOCUMENT_TYPES)
    if missing := [f.name for f in declared if f.name not in schema.names]:
        raise PipelineError(f"fields are missing: {', '.join(missing)}")
    return lambda row: {f.name: codecs.document_value(row[f.name], f.dataType) for f in declared}


def text_of(value: Any, what: str) -> str:
    """A value as text; null is an error."""
    if value is None:
        raise ValueError(f"{what} is null")
    return value if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else str(value)


def need(schema: T.StructType, *names: str) -> None:
    if missing := [n for n in names if n not in schema.names]:
        raise PipelineError(f"fields are missing: {', '.join(missing)}")


@transform
class WriteToMongoDb(ClientSink):
    """Inserts, or replaces by keys; the client reports single errors of an unordered bulk."""

    type = "WriteToMongoDb"
    kind = "mongodb"

    @dataclass
    class Config:
        connection_uri: str
        database: str
        collection: str
        schema_fields: list[str] = field(default_factory=list)
        upsert_keys: list[str] = field(default_factory=list)
        batch_size: int = 1000

    def check(self) -> None:
        c = self.config
        positive(batch_size=c.batch_size)
        names = [f.partition(":")[0].strip() for f in c.schema_fields]
        if c.upsert_keys and not set(c.upsert_keys) <= set(names):
            raise PipelineError("upsert_keys must be among schema_fields")

    def delivery(self) -> Delivery:
        return FREE if self.config.upsert_keys else KEYED

    def policy(self) -> Policy:
        return Policy(self.config.batch_size)

    def converter(self, schema: T.StructType) -> Callable[[dict], Any]:
        return declared_or_document(self.config.schema_fields, schema)


@dataclass
class IndexOptions:
    connection_uri: str
    index: str
    username: str = ""
    password: str = ""
    schema_fields: list[str] = field(default_factory=list)
    batch_size: int = 1000


class _Index(ClientSink):
    def check(self) -> None:
        positive(batch_size=self.config.batch_size)

    def delivery(self) -> Delivery:
        return KEYED

    def policy(self) -> Policy:
        return Policy(self.config.batch_size)

    def converter(self, schema: T.StructType) -> Callable[[dict], Any]:
        return declared_or_document(self.config.schema_fields, schema)


@transform
class WriteToElasticsearch8(_Index):
    type = "WriteToElasticsearch8"
    kind = "elasticsearch8"

    @dataclass
    class Config(IndexOptions):
        api_key: str = ""


@transform
class WriteToElasticsearch6(_Index):
    type = "WriteToElasticsearch6"
    kind = "elasticsearch6"

    @dataclass
    class Config(IndexOptions):
        doc_type: str = "_doc"


@transform
class WriteToKafka(TableSink):
    """Keys, values and topics as Spark's Kafka sink takes them; a null value is a tombstone."""

    type = "WriteToKafka"

    @dataclass
    class Config:
        bootstrap_servers: str
        topic: str = ""
        properties: dict[str, Any] = field(default_factory=dict)
        batch_size: int = 1000
        key_format: str = "string"
        value_format: str = "string"
        sink_delivery_guarantee: str = "at-least-once"

    def check(self) -> None:
        c = self.config
        positive(batch_size=c.batch_size)
        if c.sink_delivery_guarantee not in ("at-least-once", "none"):
            raise PipelineError("sink_delivery_guarantee must be at-least-once or none")
        if not {c.key_format, c.value_format} <= set(FORMATS) or RESERVED & set(c.properties):
            raise PipelineError("formats must be string or raw, and some properties are set by the engine")

    def delivery(self) -> Delivery:
        return KEYED if self.config.sink_delivery_guarantee == "at-least-once" else Delivery("AT_MOST_ONCE", "NONE", "NONE")

    def prepare(self, data: Data, ctx: Context) -> None:
        c = self.config
        need(data.schema, "value", *([] if c.topic else ["topic"]))
        for name, form in (("key", c.key_format), ("value", c.value_format)):
            if name in data.schema.names and data.schema[name].dataType != FORMATS[form]:
                raise PipelineError(f"{ctx.name}: {name} is not {form}")

    def bad_rows(self, data: Data, ctx: Context) -> tuple:
        return (None, None) if self.config.topic else (F.col("topic").isNull(), F.lit("topic is null"))

    def options(self) -> dict[str, str]:
        c = self.config
        out = {"kafka.bootstrap.servers": c.bootstrap_servers, "kafka.acks": "all" if c.sink_delivery_guarantee == "at-least-once" else "0"}
        return out | {f"kafka.{k}": str(v) for k, v in c.properties.items()} | ({"topic": c.topic} if c.topic else {})

    def write(self, df: DataFrame, ctx: Context) -> None:
        if not has_class(ctx.spark, KAFKA_CLASS):
            raise CapabilityError("the spark-sql-kafka package is not on the class path")
        names = [n for n in ("key", "value", *([] if self.config.topic else ["topic"])) if n in df.columns]
        df.select(*names).write.format("kafka").options(**self.options()).save()


@transform
class WriteToRedis(ClientSink):
    type = "WriteToRedis"
    kind = "redis"

    @dataclass
    class Config(RedisConnection):
        mode: str = "set"
        key_field: str = "key"
        value_field: str = "value"
        hash_field: str = "field"
        ttl_seconds: int | None = None

    def check(self) -> None:
        if self.config.mode not in ("set", "lpush", "rpush", "sadd", "hset"):
            raise PipelineError("mode must be set, lpush, rpush, sadd or hset")
        if self.config.ttl_seconds is not None:
            positive(ttl_seconds=self.config.ttl_seconds)

    def delivery(self) -> Delivery:
        return KEYED if self.config.mode in ("lpush", "rpush") else FREE

    def policy(self) -> Policy:
        return Policy(1, "row")

    def converter(self, schema: T.StructType) -> Callable[[dict], Any]:
        c = self.config
        fields = {"key": c.key_field, "value": c.value_field, **({"field": c.hash_field} if c.mode == "hset" else {})}
        need(schema, *fields.values())
        return lambda row: {k: text_of(row[n], n) for k, n in fields.items()}


@transform
class WriteToNeo4j(ClientSink):
    """One transaction for each batch; a batch that fails is written row by row."""

    type = "WriteToNeo4j"
    kind = "neo4j"

    @dataclass
    class Config:
        statement: str
        uri: str = "bolt://localhost:7687"
        user: str = "neo4j"
        password: str = ""
        database: str | None = None
        parameters: dict[str, str] | None = None
        batch_size: int = 1000

    def check(self) -> None:
        positive(batch_size=self.config.batch_size)
        self.names = codecs.cypher_parameters(self.config.statement)
        if self.config.parameters is not None and set(self.names) != set(self.config.parameters):
            raise PipelineError("parameters must name exactly those of the statement")

    def delivery(self) -> Delivery:
        return KEYED

    def policy(self) -> Policy:
        return Policy(self.config.batch_size, "row")

    def converter(self, schema: T.StructType) -> Callable[[dict], Any]:
        bound = self.config.parameters or {n: n for n in self.names}
        need(schema, *bound.values())
        return lambda row: {p: row[n] for p, n in bound.items()}


@transform
class WriteToHBase(ClientSink):
    """Puts by row key; a put with the same key is the same put."""

    type = "WriteToHBase"
    kind = "hbase"

    @dataclass
    class Config(HBaseTable):
        batch_size: int = 1000

    def check(self) -> None:
        positive(batch_size=self.config.batch_size)
        self.columns = self.config.columns()

    def delivery(self) -> Delivery:
        return FREE

    def policy(self) -> Policy:
        return Policy(self.config.batch_size)

    def converter(self, schema: T.StructType) -> Callable[[dict], Any]:
        columns, name = self.columns, self.config.rowkey_field
        need(schema, name, *(q for _, q, _ in columns))

        def put(row: dict) -> tuple[bytes, dict[str, bytes]]:
            if row[name] is None:
                raise ValueError(f"{name} is null")
            key = row[name].encode() if isinstance(row[name], str) else bytes(row[name])
            return key, {f"{f}:{q}": codecs.cell_encode(row[q], k) for f, q, k in columns if row[q] is not None}

        return put


@transform
class WriteToFtp(ClientSink):
    """A file for each batch of a task, uploaded under a temporary name and renamed."""

    type = "WriteToFtp"
    kind = "ftp"

    @dataclass
    class Config(FtpOptions):
        file_prefix: str = "output"
        batch_size: int = 1000

    def check(self) -> None:
        self.declared = self.config.settle()
        positive(batch_size=self.config.batch_size)

    def delivery(self) -> Delivery:
        return KEYED

    def policy(self) -> Policy:
        return Policy(self.config.batch_size, "batch")

    def factory(self) -> Callable:
        make = super().factory()

        class Files:
            def __init__(self, config: Any):
                self.config, self.client = config, make(config)

            def write(self, lines: list[str]) -> None:
                c = self.config
                name = f"{c.path.rstrip('/')}/{c.file_prefix}-{uuid.uuid4().hex}.{'txt' if c.file_format == 'text' else 'csv'}"
                head = format_csv([f.name for f in fields], c) if c.header else ""
                self.client.upload(name, (head + "".join(lines)).encode(c.encoding))

            def close(self) -> None:
                getattr(self.client, "close", lambda: None)()

        fields = self.declared
        return Files

    def converter(self, schema: T.StructType) -> Callable[[dict], Any]:
        c, fields = self.config, self.declared
        need(schema, *fields.names)
        if c.file_format == "text":
            return lambda row: text_of(row["content"], "content") + "\n"
        return lambda row: format_csv([row[n] for n in fields.names], c)


def format_csv(values: list[Any], c: FtpOptions) -> str:
    out = io.StringIO()
    csv.writer(out, delimiter=c.csv_delimiter, quotechar=c.csv_quote, lineterminator="\n").writerow(["" if v is None else text_of(v, "") for v in values])
    return out.getvalue()


@transform
class WriteToPulsar(ClientSink):
    type = "WriteToPulsar"
    kind = "pulsar"

    @dataclass
    class Config:
        service_url: str
        topic: str
        value_field: str = "value"
        batch_size: int = 1000

    def delivery(self) -> Delivery:
        return KEYED

    def policy(self) -> Policy:
        return Policy(1, "row")

    def converter(self, schema: T.StructType) -> Callable[[dict], Any]:
        name = self.config.value_field
        need(schema, name)
        return lambda row: bytes(row[name]) if isinstance(row[name], (bytes, bytearray)) else text_of(row[name], name).encode()


@transform
class WriteToRabbitMQ(ClientSink):
    """Publishes with confirms; a null body is rejected."""

    type = "WriteToRabbitMQ"
    kind = "rabbitmq"

    @dataclass
    class Config(RabbitConnection):
        queue: str = ""
        exchange: str = ""
        routing_key: str = ""
        body_field: str = "body"
        routing_key_field: str = "routing_key"
        exchange_field: str = "exchange"
        message_id_field: str = "message_id"
        declare_exchange: bool = False
        exchange_type: str = "direct"
        declare_queue: bool = False
        persistent: bool = False
        message_ttl_ms: int | None = None
        batch_size: int = 100

    def check(self) -> None:
        c = self.config
        positive(batch_size=c.batch_size)
        if not c.queue or c.declare_exchange and (not c.exchange or c.exchange_type not in ("direct", "fanout", "topic", "headers")):
            raise PipelineError("queue is needed, and a known exchange to declare")

    def delivery(self) -> Delivery:
        return KEYED

    def policy(self) -> Policy:
        return Policy(self.config.batch_size)

    def converter(self, schema: T.StructType) -> Callable[[dict], Any]:
        c = self.config
        need(schema, c.body_field)

        def message(row: dict) -> dict:
            return {
                "exchange": row.get(c.exchange_field) or c.exchange,
                "routing_key": row.get(c.routing_key_field) or c.routing_key or c.queue,
                "body": text_of(row[c.body_field], c.body_field),
                "message_id": row.get(c.message_id_field),
            }

        return message


@transform
class WriteToSQS(ClientSink):
    """Batches of messages; the client reports each entry that failed."""

    type = "WriteToSQS"
    kind = "sqs"

    @dataclass
    class Config(AwsOptions):
        queue_url: str = ""
        body_field: str = "body"
        message_group_id_field: str = ""
        message_deduplication_id_field: str = ""
        batch_size: int = 10

    def check(self) -> None:
        if not self.config.queue_url or not 1 <= self.config.batch_size <= 10:
            raise PipelineError("queue_url and a batch_size from 1 to 10 are needed")

    def delivery(self) -> Delivery:
        return FREE if self.config.message_deduplication_id_field else KEYED

    def policy(self) -> Policy:
        return Policy(self.config.batch_size)

    def converter(self, schema: T.StructType) -> Callable[[dict], Any]:
        c = self.config
        optional = {k: n for k, n in (("group_id", c.message_group_id_field), ("deduplication_id", c.message_deduplication_id_field)) if n}
        need(schema, c.body_field, *optional.values())
        return lambda row: {"body": text_of(row[c.body_field], c.body_field), **{k: text_of(row[n], n) for k, n in optional.items()}}


@transform
class WriteToCassandra(ClientSink):
    """Logged or unlogged batches, rejected whole after the retries."""

    type = "WriteToCassandra"
    kind = "cassandra"

    @dataclass
    class Config:
        keyspace: str
        table: str
        endpoints: list[str] = field(default_factory=lambda: ["localhost:9042"])
        datacenter: str = "datacenter1"
        consistency_level: str = "LOCAL_ONE"
        batch_size: int = 50
        max_retries: int = 3
        retry_delay_ms: int = 1000
        unlogged_batch: bool = False
        connect_timeout_ms: int = 10_000
        request_timeout_ms: int = 30_000

    def check(self) -> None:
        positive(batch_size=self.config.batch_size)

    def delivery(self) -> Delivery:
        return KEYED

    def policy(self) -> Policy:
        c = self.config
        return Policy(c.batch_size, "batch", c.max_retries, c.retry_delay_ms / 1000, exponential=False)

    def statement(self, schema: T.StructType) -> str:
        return f"INSERT INTO {self.config.keyspace}.{self.config.table} ({', '.join(schema.names)}) VALUES ({', '.join('?' * len(schema))})"


@transform
class WriteToDynamoDB(ClientSink):
    """Puts in batches; what a batch gives up on is written one by one."""

    type = "WriteToDynamoDB"
    kind = "dynamodb"

    @dataclass
    class Config(AwsOptions):
        table_name: str = ""
        batch_size: int = 25
        max_retries: int = 3
        retry_delay_ms: int = 500

    def check(self) -> None:
        if not self.config.table_name or not 1 <= self.config.batch_size <= 25:
            raise PipelineError("table_name and a batch_size from 1 to 25 are needed")

    def delivery(self) -> Delivery:
        return KEYED

    def policy(self) -> Policy:
        c = self.config
        return Policy(c.batch_size, "row", c.max_retries, c.retry_delay_ms / 1000, exponential=False)

    def converter(self, schema: T.StructType) -> Callable[[dict], Any]:
        return lambda row: {k: codecs.dynamo_attribute(v) for k, v in row.items() if v is not None}
