"""JDBC and lake-table sources: partitioned reads, predicates, projections, limits, aggregates, samples."""

from __future__ import annotations

import datetime as dt
import math
import re
from dataclasses import dataclass, field
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import CapabilityError, PipelineError
from millrace.functions import aggregates, predicates, sampling
from millrace.functions.types import parse_fields
from millrace.plans.registry import Context, Data, Delivery, Source, transform

MOST_TABLES = 10_000
MOST_PARTITIONS = 10_000
MOST_AUTO_PARTITIONS = 1_000
CHUNKS_PER_PARTITION = 4
_RANGE = re.compile(r"\$\{(\d+)-(\d+)\}")


def expand_tables(names: list[str]) -> list[str]:
    """``t_${00-15}`` as t_00 to t_15, zero-padded; one range a name, no name twice."""
    out: list[str] = []
    for name in names:
        ranges = _RANGE.findall(name)
        if len(ranges) > 1:
            raise PipelineError(f"{name!r} has more than one range")
        if not ranges:
            out.append(name)
            continue
        (low, high), width = ranges[0], len(ranges[0][0])
        if int(low) > int(high):
            raise PipelineError(f"the range of {name!r} is empty")
        if int(high) - int(low) >= MOST_TABLES:
            raise PipelineError(f"more than {MOST_TABLES} tables")
        out += [_RANGE.sub(str(i).zfill(width), name) for i in range(int(low), int(high) + 1)]
    if len(out) > MOST_TABLES:
        raise PipelineError(f"more than {MOST_TABLES} tables")
    if len(set(out)) < len(out):
        raise PipelineError("a table is named twice")
    return out


# Range partitions


def to_long(value: Any) -> int:
    """A bound as a number: days of dates, seconds of times and timestamps."""
    if isinstance(value, bool) or isinstance(value, float):
        raise PipelineError("booleans and floating-point columns cannot be partitioned")
    if isinstance(value, dt.datetime):
        return math.floor((value.replace(tzinfo=None) - dt.datetime(1970, 1, 1)).total_seconds())
    if isinstance(value, dt.date):
        return value.toordinal() - dt.date(1970, 1, 1).toordinal()
    if isinstance(value, dt.time):
        return value.hour * 3600 + value.minute * 60 + value.second
    if isinstance(value, (int, Decimal)):
        return math.floor(value)
    raise PipelineError(f"{type(value).__name__} columns cannot be partitioned")


def from_long(value: int, like: Any) -> str:
    """A bound as an SQL literal of the column's type."""
    if isinstance(like, dt.datetime):
        return f"TIMESTAMP '{dt.datetime(1970, 1, 1) + dt.timedelta(seconds=value)}'"
    if isinstance(like, dt.date):
        return f"DATE '{dt.date.fromordinal(dt.date(1970, 1, 1).toordinal() + value)}'"
    if isinstance(like, dt.time):
        return f"TIME '{dt.time(value // 3600, value // 60 % 60, value % 60)}'"
    return str(value)


def auto_partitions(span: int) -> int:
    return max(1, min(MOST_AUTO_PARTITIONS, math.floor(math.isqrt(span) / 10 + 0.5)))


def boundaries(low: int, high: int, partitions: int | None = None) -> list[int]:
    """Half-open chunk boundaries over ``[low, high + 1)``: four chunks a partition, sizes at most one apart."""
    span = high + 1 - low
    chunks = min(span, CHUNKS_PER_PARTITION * (partitions or auto_partitions(span)))
    base, more = divmod(span, chunks)
    return [low + base * i + min(i, more) for i in range(chunks + 1)]


def chunk_predicates(column: str, low: Any, high: Any, nulls: bool, partitions: int | None = None) -> list[str]:
    """Predicates that split all rows: the last range has no upper bound, nulls have a chunk of their own."""
    out = []
    if low is not None:
        cuts = boundaries(to_long(low), to_long(high), partitions)
        for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            lower = f"{column} >= {from_long(a, low)}"
            out.append(lower if i == len(cuts) - 2 else f"{lower} AND {column} < {from_long(b, low)}")
    if nulls:
        out.append(f"{column} IS NULL")
    return out or ["1 = 0"]


@dataclass
class JdbcConnection:
    url: str
    user: str = ""
    password: str = ""
    driver_class: str = ""
    connection_properties: dict[str, Any] = field(default_factory=dict)

    def options(self) -> dict[str, str]:
        given = {"url": self.url, "user": self.user, "password": self.password, "driver": self.driver_class}
        return {k: v for k, v in given.items() if v} | {k: str(v) for k, v in self.connection_properties.items()}


def jdbc(spark: SparkSession, options: dict[str, str]) -> DataFrameReader:
    return spark.read.format("jdbc").options(**options)


def primary_key(spark: SparkSession, connection: JdbcConnection, table: str) -> str | None:
    """The first primary-key column, from the database's metadata."""
    jvm = spark.sparkContext._jvm
    properties = jvm.java.util.Properties()
    for k, v in connection.options().items():
        if k != "url":
            properties.setProperty(k, v)
    try:
        conn = jvm.java.sql.DriverManager.getConnection(connection.url, properties)
    except Exception:  # the driver is not on the driver's own class path: no automatic column
        return None
    try:
        schema, _, name = table.rpartition(".")
        for candidate in (name, name.upper(), name.lower()):
            found = conn.getMetaData().getPrimaryKeys(None, schema or None, candidate)
            while found.next():
                if found.getShort("KEY_SEQ") == 1:
                    return found.getString("COLUMN_NAME")
        return None
    finally:
        conn.close()


@transform
class ReadFromJdbc(Source):
    """Tables in ranges of a column, or a query, or global aggregates."""

    type = "ReadFromJdbc"
    tier = "experimental"

    @dataclass
    class Config(JdbcConnection):
        tables: list[str] = field(default_factory=list)
        query: str = ""
        columns: list[str] = field(default_factory=lambda: ["*"])
        where: str = ""
        partition_column: str = ""
        partition_num: int | None = None
        fetch_size: int = 10_000
        limit: int = -1
        aggregations: list[Any] = field(default_factory=list)

    def check(self) -> None:
        c = self.config
        if bool(c.tables) == bool(c.query):
            raise PipelineError("give tables or query")
        self.tables = expand_tables(c.tables)
        if len(set(c.columns)) < len(c.columns) or not c.columns or "*" in c.columns and len(c.columns) > 1:
            raise PipelineError("columns must be distinct, or * alone")
        if c.query and (c.columns != ["*"] or c.where or c.partition_column or c.partition_num or c.aggregations or c.limit != -1):
            raise PipelineError("a query takes no columns, where, partitions, limit or aggregations")
        if c.limit != -1 and (c.limit < 1 or c.partition_column or (c.partition_num or 1) > 1 or len(self.tables) > 1 or c.aggregations):
            raise PipelineError("limit must be positive, of one table, without partitions or aggregations")
        if c.partition_num is not None and not 1 <= c.partition_num <= MOST_PARTITIONS:
            raise PipelineError(f"partition_num must be from 1 to {MOST_PARTITIONS}")
        if c.fetch_size < 1:
            raise PipelineError("fetch_size must be positive")
        if c.aggregations:
            aggregates.parse(c.aggregations, "sql")
            if c.columns != ["*"] or c.partition_column or c.partition_num or len(self.tables) > 1:
                raise PipelineError("aggregations take one table, no columns and no partitions")

    def delivery(self) -> Delivery:
        return Delivery("AT_LEAST_ONCE", "FULL_REPLAY", "NONE")

    def sql(self, table: str, columns: str = "*") -> str:
        return f"SELECT {columns} FROM {table}" + (f" WHERE ({self.config.where})" if self.config.where else "")

    def aggregate_sql(self, table: str) -> str:
        made = []
        for op, column, name in aggregates.parse(self.config.aggregations, "sql"):
            value = "COUNT(*)" if column is None else f"{op.upper()}({column})"
            made.append(f'{value} AS "{name}"')
        return self.sql(table, ", ".join(made))

    def read(self, ctx: Context) -> Data:
        c, spark = self.config, ctx.spark
        options = c.options() | {"fetchsize": str(c.fetch_size)}
        if c.query:
            return Data.of(jdbc(spark, options).option("query", c.query).load())
        if c.aggregations:
            return Data.of(jdbc(spark, options).option("query", self.aggregate_sql(self.tables[0])).load())
        if c.limit != -1:
            df = jdbc(spark, options).option("dbtable", f"({self.sql(self.tables[0], ', '.join(c.columns))}) t").load()
            return Data.of(df.limit(c.limit))
        column = c.partition_column or primary_key(spark, c, self.tables[0])
        if column is None and (c.partition_num or 1) > 1:
            raise PipelineError("partition_num needs a partition_column or a primary key")
        return Data.of(reduce(DataFrame.union, [self._table(spark, options, t, column) for t in self.tables]))

    def _table(self, spark: SparkSession, options: dict[str, str], table: str, column: str | None) -> DataFrame:
        c = self.config
        source = f"({self.sql(table, ', '.join(c.columns))}) t"
        if column is None:
            return jdbc(spark, options).option("dbtable", source).load()
        probe = f"SELECT MIN({column}) AS least_value, MAX({column}) AS most_value, COUNT(*) AS row_total, COUNT({column}) AS value_total FROM {table}" + (f" WHERE ({c.where})" if c.where else "")
        low, high, n, some = jdbc(spark, options).option("query", probe).load().first()
        try:
            chunks = chunk_predicates(column, low, high, n > some, c.partition_num)
        except PipelineError:
            if c.partition_column:
                raise
            chunks = ["1 = 1"]  # a key that has no ranges
        inner = self.sql(table, ", ".join(c.columns))
        if c.columns != ["*"] and column.lower() not in [x.lower() for x in c.columns]:
            # the chunk's column is not selected: the predicate goes inside
            joiner = " AND " if c.where else " WHERE "
            parts = [jdbc(spark, options).option("dbtable", f"({inner}{joiner}({p})) t").load() for p in chunks]
            return reduce(DataFrame.union, parts)
        properties = {k: v for k, v in options.items() if k != "url"}
        return spark.read.jdbc(options["url"], source, predicates=chunks, properties=properties)


@transform
class ReadFromClickHouse(Source):
    """A query over JDBC; its types are widened as the driver reports them."""

    type = "ReadFromClickHouse"
    tier = "experimental"

    @dataclass
    class Config:
        query: str
        endpoint: str = "http://localhost:8123"
        database: str = "default"
        username: str = "default"
        password: str = ""
        max_rows: int = 0
        connect_timeout_ms: int = 10_000
        socket_timeout_ms: int = 60_000

    def check(self) -> None:
        if not re.match(r"\s*(select|with)\b", self.config.query, re.I):
            raise PipelineError("query must be a SELECT")
        if self.config.max_rows < 0:
            raise PipelineError("max_rows must not be negative")

    def delivery(self) -> Delivery:
        return Delivery("AT_LEAST_ONCE", "FULL_REPLAY", "NONE")

    def options(self) -> dict[str, str]:
        c = self.config
        url = c.endpoint if c.endpoint.startswith("jdbc:") else f"jdbc:clickhouse:{c.endpoint}/{c.database}"
        return {k: v for k, v in {"url": url, "user": c.username, "password": c.password}.items() if v}

    def sql(self) -> str:
        return f"SELECT * FROM ({self.config.query}) t LIMIT {self.config.max_rows}" if self.config.max_rows else self.config.query

    def read(self, ctx: Context) -> Data:
        return Data.of(jdbc(ctx.spark, self.options()).option("query", self.sql()).load())


def clickhouse_type(name: str) -> T.DataType:
    """The type that holds a ClickHouse type: unsigned numbers one wider."""
    name = name.strip()
    while m := re.fullmatch(r"(?:Nullable|LowCardinality)\((.*)\)", name):
        name = m[1].strip()
    if m := re.fullmatch(r"Array\((.*)\)", name):
        return T.ArrayType(clickhouse_type(m[1]))
    #: Fixed values.
    known = {
        "Bool": T.BooleanType(), "Int8": T.ByteType(), "Int16": T.ShortType(), "UInt8": T.ShortType(), "Int32": T.IntegerType(), "UInt16": T.IntegerType(),
        "Int64": T.LongType(), "UInt32": T.LongType(), "Float32": T.FloatType(), "Float64": T.DoubleType(), "String": T.StringType(),
    }
    if name in known:
        return known[name]
    if re.match(r"(U?Int(64|128|256)|Decimal)", name):
        return T.DecimalType(38, 0) if "Int" in name else T.DecimalType(38, 18)
    return T.TimestampType() if name.startswith("Date") else T.StringType()


# Lake tables


@dataclass
class LakeOptions:
    columns: list[str] = field(default_factory=list)
    predicates: list[dict[str, Any]] = field(default_factory=list)
    limit: int = -1
    sample: dict[str, Any] | None = None
    aggregates: list[Any] = field(default_factory=list)


def apply_lake(df: DataFrame, o: LakeOptions, dialect: str = "columnar") -> DataFrame:
    """Predicates, then a sample, then aggregates or columns and a limit; Catalyst pushes what can be pushed."""
    if (keep := predicates.from_list(o.predicates, df.schema)) is not None:
        df = df.where(keep)
    if o.sample:
        df = sampling.sample(df, o.sample)
    if o.aggregates:
        return aggregates.aggregate(df, o.aggregates, dialect)
    if o.columns:
        known = {n.lower(): n for n in df.columns}
        if missing := [c for c in o.columns if c.lower() not in known]:
            raise PipelineError(f"columns are not known: {', '.join(missing)}")
        wanted = {known[c.lower()] for c in o.columns}
        df = df.select(*[f"`{n}`" for n in df.columns if n in wanted])  # the table's order
    return df.limit(o.limit) if o.limit != -1 else df


def partition_filter(df: DataFrame, partitions: list[str], text: str) -> DataFrame:
    """Rows of the partitions named (``dt=2024-01-01/hr=01``) or of a filter; an empty match is an error."""
    if partitions:
        parts = []
        for name in partitions:
            pairs = [p.partition("=") for p in name.split("/")]
            if any(not sep for _, sep, _ in pairs):
                raise PipelineError(f"{name!r} does not name a partition")
            parts.append(reduce(lambda a, b: a & b, [F.col(f"`{k}`").isNull() if v == "__HIVE_DEFAULT_PARTITION__" else F.col(f"`{k}`").cast("string") == v for k, _, v in pairs]))
        df = df.where(reduce(lambda a, b: a | b, parts))
    elif text:
        df = df.where(F.expr(text))
    else:
        return df
    if df.isEmpty():
        raise PipelineError("no partition matches")
    return df


@transform
class ReadFromHive(Source):
    """A table of the session's catalog, or a directory laid out like one."""

    type = "ReadFromHive"
    tier = "experimental"

    @dataclass
    class Config(LakeOptions):
        table: str = ""
        metastore_uri: str = ""
        database: str = "default"
        path: str = ""
        file_format: str = "parquet"
        partitions: list[str] = field(default_factory=list)
        partition_filter: str = ""
        recursive_directories: bool = False
        hadoop_conf: dict[str, Any] = field(default_factory=dict)
        split_bytes: int | None = None
        metastore_timeout_millis: int = 60_000

    def check(self) -> None:
        c = self.config
        if bool(c.table) == bool(c.path):
            raise PipelineError("give table or path")
        if c.partitions and c.partition_filter:
            raise PipelineError("give partitions or partition_filter")
        if c.limit != -1 and c.limit < 1:
            raise PipelineError("limit must be positive")
        if c.aggregates:
            aggregates.parse(c.aggregates, "columnar")
            if c.columns or c.predicates or c.limit != -1 or c.sample or c.split_bytes:
                raise PipelineError("aggregates take no columns, predicates, limit, sample or split_bytes")

    def delivery(self) -> Delivery:
        return Delivery("AT_LEAST_ONCE", "FULL_REPLAY", "NONE")

    def read(self, ctx: Context) -> Data:
        c, spark = self.config, ctx.spark
        if c.split_bytes:
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(c.split_bytes))
        if c.table:
            name = f"`{c.database}`.`{c.table}`"
            described = {r.col_name.strip(): r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect()}
            if described.get("Type") == "VIEW" or "transactional=true" in described.get("Table Properties", ""):
                raise PipelineError(f"{c.table} is a view or transactional")
            df = spark.read.table(name)
        else:
            reader = spark.read.format(c.file_format).options(**{k: str(v) for k, v in c.hadoop_conf.items()})
            df = (reader.option("recursiveFileLookup", "true") if c.recursive_directories else reader).load(c.path)
        return Data.of(apply_lake(partition_filter(df, c.partitions, c.partition_filter), c))


def has_class(spark: SparkSession, name: str) -> bool:
    try:
        spark.sparkContext._jvm.java.lang.Class.forName(name, False, spark.sparkContext._jvm.java.lang.Thread.currentThread().getContextClassLoader())
        return True
    except Exception:
        return False


ICEBERG_CLASS = "org.apache.iceberg.spark.SparkCatalog"
#: The types that schema_fields of lake tables know.
ICEBERG_TYPES = {"STRING", "BOOLEAN", "INT32", "INT64", "FLOAT32", "FLOAT64", "BYTES", "TIMESTAMP", "INT", "LONG", "FLOAT", "DOUBLE", "DATETIME"}


@dataclass
class IcebergTable:
    warehouse: str
    table: str
    schema_fields: list[str]
    catalog_name: str = "lake"
    hadoop_conf: dict[str, Any] = field(default_factory=dict)

    def name(self, spark: SparkSession) -> str:
        """The table's name in a catalog of this session; needs the Iceberg runtime."""
        if not has_class(spark, ICEBERG_CLASS):
            raise CapabilityError("the Iceberg Spark runtime is not on the class path")
        prefix = f"spark.sql.catalog.{self.catalog_name}"
        for key, value in {prefix: ICEBERG_CLASS, f"{prefix}.type": "hadoop", f"{prefix}.warehouse": self.warehouse, **{f"{prefix}.hadoop.{k}": str(v) for k, v in self.hadoop_conf.items()}}.items():
            spark.conf.set(key, value)
        return f"{self.catalog_name}.{self.table}"


def read_lake(df: DataFrame, schema: T.StructType, text: str = "", limit: int = -1, specs: list[Any] | None = None) -> DataFrame:
    """Filter text, then aggregates, or the declared columns and a limit."""
    if text:
        df = df.where(predicates.from_text(text, df.schema))
    if specs:
        return aggregates.aggregate(df, specs, "lake")
    df = df.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in schema])
    return df.limit(limit) if limit != -1 else df


@transform
class ReadFromIceberg(Source):
    type = "ReadFromIceberg"
    tier = "experimental"

    @dataclass
    class Config(IcebergTable):
        split_size: int | None = None
        filter: str = ""
        limit: int = -1
        aggregations: list[Any] = field(default_factory=list)

    def check(self) -> None:
        c = self.config
        self.schema = parse_fields(c.schema_fields, ICEBERG_TYPES)
        if c.filter:
            predicates.from_text(c.filter, self.schema) if _session() else predicates._Parser(c.filter, self.schema)
        if c.aggregations:
            aggregates.parse(c.aggregations, "lake")
        if c.limit != -1 and (c.limit < 1 or c.split_size or c.aggregations):
            raise PipelineError("limit must be positive, without split_size or aggregations")

    def delivery(self) -> Delivery:
        return Delivery("AT_LEAST_ONCE", "FULL_REPLAY", "NONE")

    def read(self, ctx: Context) -> Data:
        c = self.config
        reader = ctx.spark.read.option("split-size", str(c.split_size)) if c.split_size else ctx.spark.read
        return Data.of(read_lake(reader.table(c.name(ctx.spark)), self.schema, c.filter, c.limit, c.aggregations))


def _session() -> SparkSession | None:
    return SparkSession.getActiveSession()


@transform
class ReadFromSpark(Source):
    """Any format that Spark reads, by name."""

    type = "ReadFromSpark"

    @dataclass
    class Config:
        format: str
        path: str = ""
        options: dict[str, Any] = field(default_factory=dict)
        schema_fields: list[str] = field(default_factory=list)
        streaming: bool = False
        event_time: str = ""

    def unbounded(self) -> bool:
        return self.config.streaming

    def delivery(self) -> Delivery:
        return Delivery("AT_LEAST_ONCE", "RESUMABLE" if self.config.streaming else "FULL_REPLAY", "NONE")

    def read(self, ctx: Context) -> Data:
        from millrace.streaming.windows import event_time

        c = self.config
        reader = (ctx.spark.readStream if c.streaming else ctx.spark.read).format(c.format).options(**{k: str(v) for k, v in c.options.items()})
        if c.schema_fields:
            reader = reader.schema(parse_fields(c.schema_fields))
        df = reader.load(c.path) if c.path else reader.load()
        return Data.of(event_time(df, c.event_time) if c.event_time else df)
