"""Sources over client libraries.  A planner lists bounded partitions; executors read them through a client."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from millrace.errors import PipelineError
from millrace.functions import aggregates, codecs
from millrace.functions.types import parse_fields
from millrace.plans.registry import Context, Data, Delivery, Source, transform
from millrace.sources import clients
from millrace.sources.files import FileOptions, byte_ranges, lines_of_range, matching

BATCH = 1000


def read_partitions(spark: SparkSession, partitions: list[dict], schema: T.StructType, factory: Callable, config: Any, rows: Callable[[Any, dict], Iterator[dict]]) -> DataFrame:
    """One task for each partition; ``rows(client, partition)`` gives dicts of the schema's fields."""
    if not partitions:
        return spark.createDataFrame([], schema)
    names = schema.names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in batch["id"]:
                client = factory(config)
                try:
                    held = []
                    for row in rows(client, partitions[int(i)]):
                        held.append([row.get(n) for n in names])
                        if len(held) == BATCH:
                            yield pd.DataFrame(held, columns=names, dtype=object)
                            held = []
                    if held:
                        yield pd.DataFrame(held, columns=names, dtype=object)
                finally:
                    getattr(client, "close", lambda: None)()

    loose = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
    return spark.range(0, len(partitions), 1, len(partitions)).mapInPandas(run, loose)


class ClientSource(Source):
    """Base: a kind of client, a schema, partitions, and how a partition is read."""

    kind = ""
    tier = "experimental"
    ordering = "NONE"
    limit_option = "limit"

    def delivery(self) -> Delivery:
        return Delivery("AT_LEAST_ONCE", "FULL_REPLAY", self.ordering)

    def schema(self, client: Callable[[], Any]) -> T.StructType:
        raise NotImplementedError

    def partitions(self, client: Callable[[], Any]) -> list[dict]:
        return [{}]

    def rows(self) -> Callable[[Any, dict], Iterator[dict]]:
        return lambda client, partition: client.read(partition)

    def finish(self, df: DataFrame) -> DataFrame:
        limit = getattr(self.config, self.limit_option, -1)
        return df.limit(limit) if limit > 0 else df  # of all partitions together

    def read(self, ctx: Context) -> Data:
        factory = clients.factory(self.kind)
        made: list[Any] = []

        def client() -> Any:
            if not made:
                made.append(factory(self.config))
            return made[0]

        schema = self.schema(client)
        df = read_partitions(ctx.spark, self.partitions(client), schema, factory, self.config, self.rows())
        out = self.finish(df)
        return Data(out, schema if out.schema.names == schema.names else out.schema)


def positive(**values: int) -> None:
    for name, value in values.items():
        if value < 1:
            raise PipelineError(f"{name} must be positive")


def limit_of(value: int) -> None:
    if value != -1 and value < 1:
        raise PipelineError("limit must be positive")


MOST_BUCKETS = 1000
DOCUMENTS_PER_BUCKET = 100_000


def bucket_count(documents: int, given: int | None) -> int:
    return given or max(1, min(MOST_BUCKETS, math.ceil(documents / DOCUMENTS_PER_BUCKET)))


def bucket_ranges(bounds: list[tuple[Any, Any]]) -> list[dict]:
    """Ranges ``[low, next low)``; the last holds its upper end."""
    return [{"low": low, "high": bounds[i + 1][0] if i + 1 < len(bounds) else high, "last": i + 1 == len(bounds)} for i, (low, high) in enumerate(bounds)]


@transform
class ReadFromMongoDb(ClientSource):
    """Ranges of ``_id``.  The client has ``count()``, ``bounds(n)`` and ``read({low, high, last})``."""

    type = "ReadFromMongoDb"
    kind = "mongodb"

    @dataclass
    class Config:
        connection_uri: str
        database: str
        collection: str
        schema_fields: list[str] = field(default_factory=list)
        filter: str = ""
        partition_num: int | None = None
        fetch_size: int = 1000
        limit: int = -1
        aggregate: list[Any] = field(default_factory=list)

    def check(self) -> None:
        c = self.config
        self.declared = parse_fields(c.schema_fields, codecs.DOCUMENT_TYPES) if c.schema_fields else codecs.DOCUMENT
        positive(fetch_size=c.fetch_size)
        limit_of(c.limit)
        if c.partition_num is not None and not 1 <= c.partition_num <= MOST_BUCKETS:
            raise PipelineError(f"partition_num must be from 1 to {MOST_BUCKETS}")
        if c.limit != -1 and (c.partition_num or c.aggregate):
            raise PipelineError("limit takes no partition_num or aggregate")
        if c.aggregate:
            self.aggregated = aggregates.parse(c.aggregate, "document")
            names = dict.fromkeys(n for _, n, _ in self.aggregated if n)
            known = {f.name: f for f in self.declared}
            self.declared = T.StructType([known.get(n) or T.StructField(n, T.DoubleType(), True) for n in names]) if names else codecs.DOCUMENT

    def schema(self, client: Callable[[], Any]) -> T.StructType:
        return self.declared

    def partitions(self, client: Callable[[], Any]) -> list[dict]:
        if self.config.limit != -1:
            return [{"low": None, "high": None, "last": True}]
        n = bucket_count(client().count(), self.config.partition_num)
        return bucket_ranges(client().bounds(n))

    def rows(self) -> Callable[[Any, dict], Iterator[dict]]:
        schema = self.declared
        return lambda client, partition: codecs.rows_of(client.read(partition), schema)

    def finish(self, df: DataFrame) -> DataFrame:
        return aggregates.aggregate(df, self.config.aggregate, "document") if self.config.aggregate else super().finish(df)


class _Search(ClientSource):
    def check(self) -> None:
        c = self.config
        if bool(c.index) == bool(c.indices) or len(set(c.indices)) < len(c.indices):
            raise PipelineError("give index or (distinct) indices")
        positive(scan_slices=c.scan_slices)
        limit_of(c.limit)
        many = len(c.indices) > 1 or c.scan_slices > 1
        if c.limit != -1 and (many or c.aggregations):
            raise PipelineError("limit takes one index, one slice and no aggregations")
        if c.aggregations:
            self.aggregated = aggregates.parse(c.aggregations, "search")
        self.declared = parse_fields(c.schema_fields, codecs.DOCUMENT_TYPES, case_sensitive=self.kind == "elasticsearch8") if c.schema_fields else codecs.DOCUMENT

    def schema(self, client: Callable[[], Any]) -> T.StructType:
        return self.declared

    def partitions(self, client: Callable[[], Any]) -> list[dict]:
        c = self.config
        return [{"index": i, "slice": s, "slices": c.scan_slices} for i in c.indices or [c.index] for s in range(c.scan_slices)]

    def rows(self) -> Callable[[Any, dict], Iterator[dict]]:
        schema = self.declared
        return lambda client, partition: codecs.rows_of(client.read(partition), schema, numeric_text=True)

    def finish(self, df: DataFrame) -> DataFrame:
        return aggregates.aggregate(df, self.config.aggregations, "search") if self.config.aggregations else super().finish(df)


@dataclass
class SearchOptions:
    connection_uri: str
    index: str = ""
    indices: list[str] = field(default_factory=list)
    username: str = ""
    password: str = ""
    schema_fields: list[str] = field(default_factory=list)
    scan_query: str = ""
    scan_slices: int = 1
    limit: int = -1
    aggregations: list[Any] = field(default_factory=list)


@transform
class ReadFromElasticsearch8(_Search):
    type = "ReadFromElasticsearch8"
    kind = "elasticsearch8"

    @dataclass
    class Config(SearchOptions):
        api_key: str = ""
        batch_size: int = 1000
        keep_alive_minutes: int = 5

    def check(self) -> None:
        super().check()
        positive(batch_size=self.config.batch_size, keep_alive_minutes=self.config.keep_alive_minutes)
        if self.config.api_key and self.config.username:
            raise PipelineError("give api_key or username")


@transform
class ReadFromElasticsearch6(_Search):
    type = "ReadFromElasticsearch6"
    kind = "elasticsearch6"

    @dataclass
    class Config(SearchOptions):
        scroll_size: int = 1000
        scroll_timeout_minutes: int = 1

    def check(self) -> None:
        super().check()
        positive(scroll_size=self.config.scroll_size, scroll_timeout_minutes=self.config.scroll_timeout_minutes)


@dataclass
class RedisConnection:
    host: str = "localhost"
    port: int = 6379
    password: str = ""
    database: int = 0
    ssl: bool = False
    timeout_ms: int = 5000


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType(), True) for n in names])


@transform
class ReadFromRedis(ClientSource):
    """Keys by pattern or list, or a stream's entries (a row for each field).

    The client has ``keys(pattern)`` for scans and ``read({keys} or {stream})``.
    """

    type = "ReadFromRedis"
    kind = "redis"
    KEYS_PER_PARTITION = 10_000

    @dataclass
    class Config(RedisConnection):
        mode: str = "scan"
        key_pattern: str | None = None
        keys: list[str] = field(default_factory=list)
        stream: str = ""
        start_id: str = "-"
        end_id: str = "+"

    def check(self) -> None:
        c = self.config
        if c.mode not in ("scan", "keys", "stream"):
            raise PipelineError("mode must be scan, keys or stream")
        used = {"key_pattern": c.key_pattern is not None, "keys": bool(c.keys), "stream": bool(c.stream), "start_id": c.start_id != "-", "end_id": c.end_id != "+"}
        allowed = {"scan": {"key_pattern"}, "keys": {"keys"}, "stream": {"stream", "start_id", "end_id"}}[c.mode]
        if extra := [n for n, u in used.items() if u and n not in allowed]:
            raise PipelineError(f"mode {c.mode} takes no {', '.join(extra)}")
        if c.mode == "keys" and not c.keys or c.mode == "stream" and not c.stream:
            raise PipelineError(f"mode {c.mode} needs {c.mode}")
        if c.mode == "stream" and c.start_id != "-" and c.end_id != "+" and _entry(c.start_id) > _entry(c.end_id):
            raise PipelineError("start_id is after end_id")
        self.ordering = "GLOBAL" if c.mode == "stream" else "NONE"

    def schema(self, client: Callable[[], Any]) -> T.StructType:
        return _strings("id", "field", "value") if self.config.mode == "stream" else _strings("key", "value")

    def partitions(self, client: Callable[[], Any]) -> list[dict]:
        c, n = self.config, self.KEYS_PER_PARTITION
        if c.mode == "stream":
            return [{"stream": c.stream, "start": c.start_id, "end": c.end_id}]
        keys = c.keys or sorted(set(client().keys(c.key_pattern or "*")))
        return [{"keys": keys[at : at + n]} for at in range(0, len(keys), n)]


def _entry(text: str) -> tuple[int, int]:
    a, _, b = text.partition("-")
    return int(a), int(b or 0)


@transform
class ReadFromNeo4j(ClientSource):
    type = "ReadFromNeo4j"
    kind = "neo4j"

    @dataclass
    class Config:
        query: str
        schema_fields: list[str]
        uri: str = "bolt://localhost:7687"
        user: str = "neo4j"
        password: str = ""
        database: str | None = None
        parameters: dict[str, Any] | None = None

    def check(self) -> None:
        fields = [f if ":" in f else f"{f}:STRING" for f in self.config.schema_fields]
        self.declared = parse_fields(fields)
        if not fields:
            raise PipelineError("schema_fields must not be empty")
        if missing := set(codecs.cypher_parameters(self.config.query)) - set(self.config.parameters or {}):
            raise PipelineError(f"parameters are not given: {', '.join(sorted(missing))}")

    def schema(self, client: Callable[[], Any]) -> T.StructType:
        return self.declared

    def rows(self) -> Callable[[Any, dict], Iterator[dict]]:
        schema = self.declared
        return lambda client, partition: ({f.name: codecs.document_value(r.get(f.name), f.dataType) for f in schema} for r in client.read(partition))


@dataclass
class HBaseTable:
    zookeeper_quorum: str
    table: str
    schema_fields: list[str]
    zookeeper_znode_parent: str = ""
    rowkey_field: str = "rowkey"
    rowkey_format: str = "string"
    family: str = "cf"
    properties: dict[str, Any] = field(default_factory=dict)

    def columns(self) -> list[tuple[str, str, T.DataType]]:
        if self.rowkey_format not in ("string", "bytes"):
            raise PipelineError("rowkey_format must be string or bytes")
        columns = codecs.hbase_columns(self.schema_fields, self.family)
        if any(q == self.rowkey_field for _, q, _ in columns):
            raise PipelineError(f"{self.rowkey_field} is the row key's field")
        return columns

    def schema(self) -> T.StructType:
        key = T.StringType() if self.rowkey_format == "string" else T.BinaryType()
        return T.StructType([T.StructField(self.rowkey_field, key, False), *(T.StructField(q, k, True) for _, q, k in self.columns())])


@transform
class ReadFromHBase(ClientSource):
    """A range of row keys.  The client has ``regions(start, stop)`` and ``read({start, stop})`` giving (key, {family:qualifier: bytes})."""

    type = "ReadFromHBase"
    kind = "hbase"

    @dataclass
    class Config(HBaseTable):
        scan_start_row: str = ""
        scan_stop_row: str = ""
        scan_caching: int = 100
        scan_cache_blocks: bool = False

    def check(self) -> None:
        self.columns = self.config.columns()
        positive(scan_caching=self.config.scan_caching)

    def schema(self, client: Callable[[], Any]) -> T.StructType:
        return self.config.schema()

    def partitions(self, client: Callable[[], Any]) -> list[dict]:
        return [{"start": a, "stop": b} for a, b in client().regions(self.config.scan_start_row.encode(), self.config.scan_stop_row.encode())]

    def rows(self) -> Callable[[Any, dict], Iterator[dict]]:
        columns, name, text = self.columns, self.config.rowkey_field, self.config.rowkey_format == "string"

        def read(client: Any, partition: dict) -> Iterator[dict]:
            for key, found in client.read(partition):
                yield {name: key.decode() if text else key, **{q: codecs.cell_decode(found.get(f"{f}:{q}"), k) for f, q, k in columns}}

        return read


@dataclass
class FtpOptions:
    path: str
    host: str = ""
    host_name: str = ""
    port: int = 21
    user: str = ""
    username: str = ""
    password: str = ""
    file_format: str = "text"
    schema_fields: list[str] | None = None
    header: bool = False
    encoding: str = "UTF-8"
    csv_delimiter: str = ","
    csv_quote: str = '"'
    timeout_millis: int = 30_000

    def settle(self) -> T.StructType:
        """Resolves aliases, checks, and gives the rows' schema."""
        for a, b in (("host", "host_name"), ("user", "username")):
            if getattr(self, a) and getattr(self, b) and getattr(self, a) != getattr(self, b):
                raise PipelineError(f"{a} and {b} differ")
            setattr(self, a, getattr(self, a) or getattr(self, b))
        if not self.host or not 1 <= self.port <= 65535:
            raise PipelineError("host and a port from 1 to 65535 are needed")
        if self.file_format not in ("text", "csv"):
            raise PipelineError("file_format must be text or csv")
        return FileOptions(self.path, file_format=self.file_format, schema_fields=self.schema_fields or [], header=self.header, encoding=self.encoding, csv_delimiter=self.csv_delimiter, csv_quote=self.csv_quote).schema()


@transform
class ReadFromFtp(ClientSource):
    """Text by byte ranges, CSV by file.  The client has ``files()`` (name, size) and ``read_at(name, at, size)``."""

    type = "ReadFromFtp"
    kind = "ftp"
    SPLIT = 64 << 20

    @dataclass
    class Config(FtpOptions):
        file_pattern: str | None = None

    def check(self) -> None:
        self.declared = self.config.settle()

    def schema(self, client: Callable[[], Any]) -> T.StructType:
        return self.declared

    def partitions(self, client: Callable[[], Any]) -> list[dict]:
        sizes = dict(client().files())
        split = self.SPLIT if self.config.file_format == "text" and self.config.encoding.upper() in ("UTF-8", "US-ASCII", "ISO-8859-1") else None
        return [{"name": n, "start": a, "stop": b} for n in matching(list(sizes), self.config.file_pattern) for a, b in byte_ranges(sizes[n], split or max(1, sizes[n]))]

    def rows(self) -> Callable[[Any, dict], Iterator[dict]]:
        c, schema = self.config, self.declared

        def text(client: Any, p: dict) -> Iterator[dict]:
            for line in lines_of_range(lambda at, n: client.read_at(p["name"], at, n), p["start"], p["stop"]):
                yield {"content": line.decode(c.encoding)}

        def table(client: Any, p: dict) -> Iterator[dict]:
            import csv
            import io

            data = client.read_at(p["name"], 0, p["stop"]).decode(c.encoding)
            for i, row in enumerate(r for r in csv.reader(io.StringIO(data), delimiter=c.csv_delimiter, quotechar=c.csv_quote) if r):
                if i or not c.header:
                    yield parse_cells(row, schema, f"{p['name']}, row {i + 1}")

        return text if c.file_format == "text" else table


def parse_cells(row: list[str], schema: T.StructType, where: str) -> dict:
    """Cells of a row by the strict rules."""
    from millrace.functions.cells import FALSE_WORDS, TRUE_WORDS

    if len(row) > len(schema):
        raise ValueError(f"{where}: more than {len(schema)} cells")
    out: dict[str, Any] = {}
    for f, cell in zip(schema, row + [""] * (len(schema) - len(row)), strict=True):
        text = cell.strip()
        try:
            if not text:
                out[f.name] = None
            elif isinstance(f.dataType, T.StringType):
                out[f.name] = cell
            elif isinstance(f.dataType, T.BooleanType):
                if text.lower() not in TRUE_WORDS + FALSE_WORDS:
                    raise ValueError("not a boolean")
                out[f.name] = text.lower() in TRUE_WORDS
            elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
                out[f.name] = float(text)
            else:
                out[f.name] = codecs.document_value(int(text), f.dataType)
        except ValueError as e:
            raise ValueError(f"{where}, column {f.name}: {cell!r}: {e}") from None
    return out


@transform
class ReadFromPulsar(ClientSource):
    type = "ReadFromPulsar"
    kind = "pulsar"
    limit_option = "max_messages"

    @dataclass
    class Config:
        service_url: str
        topic: str
        start_position: str = "earliest"
        max_messages: int = -1
        receive_timeout_millis: int = 1000

    def check(self) -> None:
        if self.config.start_position not in ("earliest", "latest"):
            raise PipelineError("start_position must be earliest or latest")
        positive(receive_timeout_millis=self.config.receive_timeout_millis)

    def schema(self, client: Callable[[], Any]) -> T.StructType:
        return T.StructType([T.StructField("topic", T.StringType(), False), T.StructField("value", T.BinaryType(), False)])


@transform
class ReadFromPrometheus(ClientSource):
    type = "ReadFromPrometheus"
    kind = "prometheus"

    @dataclass
    class Config:
        query: str
        endpoint: str = "http://localhost:9090"
        time: str = ""
        connect_timeout_ms: int = 10_000
        read_timeout_ms: int = 30_000

    def check(self) -> None:
        if not self.config.query.strip():
            raise PipelineError("query must not be blank")

    def schema(self, client: Callable[[], Any]) -> T.StructType:
        return T._parse_datatype_string("metric_name string not null, labels map<string,string>, value double not null, timestamp double not null")


@dataclass
class AwsOptions:
    region: str = "us-east-1"
    endpoint_override: str = ""
    access_key_id: str = ""
    secret_access_key: str = ""


@transform
class ReadFromDynamoDB(ClientSource):
    """Segments of a scan, or a query.  The client has ``probe(n)`` and ``read({segment, segments})``, both giving attribute maps."""

    type = "ReadFromDynamoDB"
    kind = "dynamodb"
    limit_option = "max_items"
    PROBED = 100

    @dataclass
    class Config(AwsOptions):
        table_name: str = ""
        consistent_read: bool = False
        filter_expression: str = ""
        projection_expression: str = ""
        key_condition_expression: str = ""
        expression_attribute_values: dict[str, str] = field(default_factory=dict)
        max_items: int = 0
        parallel_scan_segments: int = 1

    def check(self) -> None:
        c = self.config
        if not c.table_name:
            raise PipelineError("table_name is required")
        positive(parallel_scan_segments=c.parallel_scan_segments)
        if c.parallel_scan_segments > 1 and c.key_condition_expression:
            raise PipelineError("a query has no segments")

    def schema(self, client: Callable[[], Any]) -> T.StructType:
        self.declared = codecs.dynamo_schema(list(client().probe(self.PROBED)))
        return self.declared

    def partitions(self, client: Callable[[], Any]) -> list[dict]:
        n = self.config.parallel_scan_segments
        return [{"segment": i, "segments": n} for i in range(n)]

    def rows(self) -> Callable[[Any, dict], Iterator[dict]]:
        schema = self.declared
        return lambda client, p: ({f.name: codecs.dynamo_value(item.get(f.name), f.dataType) for f in schema} for item in client.read(p))


@transform
class ReadFromCassandra(ClientSource):
    """A query, or its token ranges.  The client has ``columns(query)`` (name, type) and ``read({query})``."""

    type = "ReadFromCassandra"
    kind = "cassandra"
    limit_option = "max_rows"

    @dataclass
    class Config:
        keyspace: str
        query: str
        endpoints: list[str] = field(default_factory=lambda: ["localhost:9042"])
        datacenter: str = "datacenter1"
        consistency_level: str = "LOCAL_ONE"
        max_rows: int = 0
        fetch_size: int = 5000
        parallel_scan_segments: int = 1
        partition_key_column: str = ""
        connect_timeout_ms: int = 10_000
        request_timeout_ms: int = 30_000

    def check(self) -> None:
        c = self.config
        positive(fetch_size=c.fetch_size, parallel_scan_segments=c.parallel_scan_segments)
        if not c.query.lstrip().lower().startswith("select") or not c.endpoints:
            raise PipelineError("query must be a SELECT, and endpoints must be given")
        if c.parallel_scan_segments > 1 and not c.partition_key_column:
            raise PipelineError("parallel_scan_segments needs partition_key_column")

    def schema(self, client: Callable[[], Any]) -> T.StructType:
        return T.StructType([T.StructField(n, codecs.cassandra_type(k), True) for n, k in client().columns(self.config.query)])

    def partitions(self, client: Callable[[], Any]) -> list[dict]:
        c = self.config
        if c.parallel_scan_segments == 1:
            return [{"query": c.query}]
        return [{"query": codecs.with_token_range(c.query, c.partition_key_column, a, b)} for a, b in codecs.token_ranges(c.parallel_scan_segments)]
