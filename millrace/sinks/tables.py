"""JDBC and lake-table sinks."""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from threading import Lock
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import PipelineError
from millrace.functions.types import INTEGRAL, parse_fields
from millrace.operators.transforms import col, dead_letter_schema
from millrace.plans.registry import ERRORS, INPUT, Context, Data, Delivery, Sink, transform
from millrace.sinks.writer import start_stream
from millrace.sources.tables import ICEBERG_TYPES, IcebergTable, JdbcConnection
from millrace.streaming.windows import without_marks
from millrace.workspace import new_path


class TableSink(Sink):
    """Base: ``write(df, spark)`` in one action, rows that cannot be converted go to the dead letters."""

    tier = "experimental"

    def bad_rows(self, data: Data, ctx: Context) -> tuple[Column | None, Column | None]:
        """A condition for rows that cannot be written, and why."""
        return None, None

    def write(self, df: DataFrame, ctx: Context) -> None:
        raise NotImplementedError

    def prepare(self, data: Data, ctx: Context) -> None:
        """Checks against the input's schema, when the graph is built."""

    def build(self, inputs: dict[str, list[Data]], ctx: Context) -> dict[str, Data]:
        data = inputs[INPUT][0]
        self.prepare(data, ctx)
        letters = dead_letter_schema(data.schema)
        none = Data(ctx.spark.createDataFrame([], letters), letters)
        if not ctx.execute:
            return {ERRORS: none}
        bad, why = self.bad_rows(data, ctx)
        df = without_marks(data.df)
        if df.isStreaming:
            start_stream(df, lambda batch, _: self.write(batch if bad is None else batch.where(~bad), ctx), ctx)
            return {ERRORS: none}
        if bad is None:
            self.write(df, ctx)
            return {ERRORS: none}
        failed = df.where(bad).select(F.struct(*map(col, data.schema.names)).alias("element"), F.lit("ValueError").alias("error_type"), why.alias("error_message"), F.lit(ctx.name).alias("transform"))
        if not ctx.errors_wanted:
            if (first := failed.select("error_message").first()) is not None:
                raise RuntimeError(f"{ctx.name}: {first[0]}")
            self.write(df, ctx)
            return {ERRORS: none}
        path = new_path(ctx.spark, "dead-letters")
        failed.write.parquet(path)
        self.write(df.where(~bad), ctx)
        return {ERRORS: Data(ctx.spark.read.schema(letters).parquet(path), letters)}


#: Parts that are written at a time, and rejects that are saved together.
PARTS_AT_ONCE = 8
SAVED_AT_ONCE = 10_000
#: SQL states of deadlocks and serialization failures, which are tried again.
RETRIED_STATES = ("40001", "40P01")


def retried(error: Exception) -> bool:
    return any(state in str(error) for state in RETRIED_STATES)


@transform
class WriteToJdbc(Sink):
    """Plain inserts.  With dead letters, rows that fail are isolated by halving."""

    type = "WriteToJdbc"
    tier = "experimental"

    @dataclass
    class Config(JdbcConnection):
        table: str = ""
        batch_size: int = 10_000
        retry_max_attempts: int = 3
        retry_initial_seconds: int = 3
        retry_max_seconds: int = 60
        allow_duplicate_replay: bool = False

    def check(self) -> None:
        c = self.config
        if not c.table or c.batch_size < 1 or c.retry_max_attempts < 0 or c.retry_initial_seconds < 1 or c.retry_max_seconds < c.retry_initial_seconds:
            raise PipelineError("table, a positive batch_size and retry bounds in order are needed")

    def delivery(self) -> Delivery:
        return Delivery("AT_LEAST_ONCE", "NONE", "NONE", needs_key=not self.config.allow_duplicate_replay)

    def build(self, inputs: dict[str, list[Data]], ctx: Context) -> dict[str, Data]:
        data = inputs[INPUT][0]
        letters = dead_letter_schema(data.schema)
        none = Data(ctx.spark.createDataFrame([], letters), letters)
        if not ctx.execute:
            return {ERRORS: none}
        df = without_marks(data.df)
        if df.isStreaming:
            start_stream(df, lambda batch, _: self._append(batch), ctx)
            return {ERRORS: none}
        if not ctx.errors_wanted:
            self._parts(df, ctx, None)
            return {ERRORS: none}
        path = new_path(ctx.spark, "dead-letters")
        none.df.write.parquet(path)
        self._parts(df, ctx, path)
        return {ERRORS: Data(ctx.spark.read.schema(letters).parquet(path), letters)}

    def _append(self, df: DataFrame) -> None:
        """Appends rows; a task is a transaction, and Spark repeats a failed one, so that nothing is written twice."""
        c = self.config
        df.write.format("jdbc").mode("append").options(**c.options(), dbtable=c.table, batchsize=str(c.batch_size), isolationLevel="READ_COMMITTED").save()

    def _transaction(self, rows: DataFrame) -> None:
        """Appends rows by one task, so in one transaction, which may be tried again."""
        c = self.config
        for attempt in range(c.retry_max_attempts + 1):
            try:
                return self._append(rows.coalesce(1))
            except Exception as e:
                if attempt == c.retry_max_attempts or not retried(e):
                    raise
                time.sleep(min(c.retry_max_seconds, c.retry_initial_seconds * 2**attempt))

    def _parts(self, df: DataFrame, ctx: Context, letters: str | None) -> None:
        """Appends the rows part by part, several at once; the executors write, the driver starts the jobs.

        Rows are staged with numbers, so a part is a number range in one staged
        file, and parts that succeed are not written again.  With dead letters, a
        part that fails is halved until batches, and then single rows, are left;
        only those are rejected, and saved as they come.
        """
        stage = new_path(ctx.spark, "jdbc-stage")
        df.select(F.monotonically_increasing_id().alias("_n"), *map(col, df.columns)).write.parquet(stage)
        rows = ctx.spark.read.parquet(stage)
        per_file = rows.groupBy(F.shiftright("_n", 33).alias("p")).agg(F.min("_n").alias("low"), F.max("_n").alias("high")).collect()  # one for each partition
        saving = Lock()

        def write(low: int, high: int) -> None:
            todo, bad = [(low, high)], []
            while todo:
                low, high = todo.pop()
                try:
                    self._transaction(rows.where(f"_n between {low} and {high}").drop("_n"))
                except Exception as e:
                    if letters is None:
                        raise
                    if low < high:
                        middle = (low + high) // 2
                        todo += [(low, middle), (middle + 1, high)]
                    else:
                        bad.append((low, *_cause(e)))
                if bad and (len(bad) >= SAVED_AT_ONCE or not todo):
                    self._save(rows, bad, ctx, letters, saving)
                    bad = []

        with ThreadPoolExecutor(PARTS_AT_ONCE) as pool:
            for done in [pool.submit(write, r.low, r.high) for r in per_file]:
                done.result()

    def _save(self, rows: DataFrame, bad: list[tuple[int, str, str]], ctx: Context, letters: str, saving: Lock) -> None:
        """Appends the rejects (``SAVED_AT_ONCE`` at most) to the dead letters."""
        failed = ctx.spark.createDataFrame(bad, "_n long, error_type string, error_message string")
        low, high = min(b[0] for b in bad), max(b[0] for b in bad)
        found = rows.where(f"_n between {low} and {high}").join(F.broadcast(failed), "_n")
        names = [n for n in rows.columns if n != "_n"]
        with saving:  # one commit to the folder at a time
            found.select(F.struct(*map(col, names)).alias("element"), "error_type", "error_message", F.lit(ctx.name).alias("transform")).write.mode("append").parquet(letters)


def _cause(error: Exception) -> tuple[str, str]:
    text = str(error)
    lines = [x.strip() for x in text.splitlines() if x.strip().startswith("Caused by:")]
    last = lines[-1].removeprefix("Caused by:").strip() if lines else text.splitlines()[0]
    kind, _, message = last.partition(": ")
    return kind.rpartition(".")[2] or type(error).__name__, message or last


@transform
class WriteToClickHouse(TableSink):
    """Inserts over JDBC, in whole batches, with exponential back-off."""

    type = "WriteToClickHouse"

    @dataclass
    class Config:
        table: str
        endpoint: str = "http://localhost:8123"
        database: str = "default"
        username: str = "default"
        password: str = ""
        batch_size: int = 10_000
        max_retries: int = 3
        retry_delay_ms: int = 1000
        connect_timeout_ms: int = 10_000
        socket_timeout_ms: int = 60_000
        column_names: list[str] = field(default_factory=list)

    def check(self) -> None:
        if self.config.batch_size < 1 or self.config.max_retries < 0:
            raise PipelineError("batch_size must be positive and max_retries not negative")

    def delivery(self) -> Delivery:
        return Delivery("AT_LEAST_ONCE", "NONE", "NONE", needs_key=True)

    def prepare(self, data: Data, ctx: Context) -> None:
        names = self.config.column_names
        if names and (len(names) != len(data.schema) or len(set(names)) < len(names)):
            raise PipelineError(f"{ctx.name}: column_names must name each of the {len(data.schema)} fields")

    def write(self, df: DataFrame, ctx: Context) -> None:
        c = self.config
        url = c.endpoint if c.endpoint.startswith("jdbc:") else f"jdbc:clickhouse:{c.endpoint}/{c.database}"
        named = df.toDF(*c.column_names) if c.column_names else df
        options = {"url": url, "dbtable": c.table, "batchsize": str(c.batch_size)} | {k: v for k, v in {"user": c.username, "password": c.password}.items() if v}
        for attempt in range(c.max_retries + 1):
            try:
                return named.write.format("jdbc").mode("append").options(**options).save()
            except Exception:
                if attempt == c.max_retries:
                    raise
                time.sleep(c.retry_delay_ms / 1000 * 2**attempt)


def narrowed(f: T.StructField, target: T.DataType) -> tuple[Column, Column]:
    """A field cast to a target's type, and whether that loses something."""
    source, value = col(f.name), col(f.name).try_cast(target)
    lost = source.isNotNull() & value.isNull()
    if type(target) in INTEGRAL and isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
        lost = lost | (value.cast(f.dataType) != source)
    return value, F.coalesce(lost, F.lit(False))


@transform
class WriteToHive(TableSink):
    """Dynamic partitions; ``overwrite`` clears only the partitions written."""

    type = "WriteToHive"

    @dataclass
    class Config:
        table: str = ""
        metastore_uri: str = ""
        database: str = "default"
        path: str = ""
        file_format: str = "parquet"
        partition_by: list[str] = field(default_factory=list)
        write_mode: str = "append"
        create_partitions: bool = True
        num_shards: int = 0
        file_prefix: str = "part"
        hadoop_conf: dict[str, Any] = field(default_factory=dict)
        metastore_timeout_millis: int = 60_000

    def check(self) -> None:
        c = self.config
        if bool(c.table) == bool(c.path):
            raise PipelineError("give table or path")
        if c.write_mode not in ("append", "overwrite") or c.num_shards < 0:
            raise PipelineError("write_mode must be append or overwrite, num_shards not negative")

    def delivery(self) -> Delivery:
        append = self.config.write_mode == "append"
        return Delivery("AT_LEAST_ONCE" if append else "EXACTLY_ONCE", "NONE", "NONE", needs_key=append)

    def _target(self, data: Data, ctx: Context) -> T.StructType:
        """The table's columns; a directory has the input's."""
        c = self.config
        if c.path:
            if missing := set(c.partition_by) - set(data.schema.names):
                raise PipelineError(f"{ctx.name}: partition columns are missing: {', '.join(sorted(missing))}")
            partitions = [f for f in data.schema if f.name in c.partition_by]
            if any(isinstance(f.dataType, T.BinaryType) for f in partitions):
                raise PipelineError(f"{ctx.name}: a binary column cannot be a partition")
            return T.StructType([f for f in data.schema if f.name not in c.partition_by] + partitions)
        if not ctx.spark.catalog.tableExists(f"{c.database}.{c.table}"):
            raise PipelineError(f"{ctx.name}: table {c.database}.{c.table} does not exist")
        return ctx.spark.table(f"`{c.database}`.`{c.table}`").schema

    def _columns(self, data: Data, ctx: Context) -> list[tuple[str, Column, Column | None]]:
        by = {f.name.lower(): f for f in data.schema}
        out = []
        for f in self._target(data, ctx):
            source = by.get(f.name.lower())
            if source is None:
                out.append((f.name, F.lit(None).cast(f.dataType), None))
            elif source.dataType == f.dataType:
                out.append((f.name, col(source.name), None))
            else:
                out.append((f.name, *narrowed(source, f.dataType)))
        return out

    def prepare(self, data: Data, ctx: Context) -> None:
        self.aligned = self._columns(data, ctx)

    def bad_rows(self, data: Data, ctx: Context) -> tuple[Column | None, Column | None]:
        checks = [(n, lost) for n, _, lost in self.aligned if lost is not None]
        if not checks:
            return None, None
        bad, why = F.lit(False), F.lit(None).cast("string")
        for name, lost in checks:
            bad, why = bad | lost, F.coalesce(why, F.when(lost, f"column {name} cannot hold the value"))
        return bad, why

    def write(self, df: DataFrame, ctx: Context) -> None:
        c, spark = self.config, ctx.spark
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        rows = df.select(*[value.alias(n) for n, value, _ in self.aligned])
        rows = rows.repartition(c.num_shards) if c.num_shards else rows
        if c.table:
            rows.write.mode(c.write_mode).insertInto(f"`{c.database}`.`{c.table}`", overwrite=c.write_mode == "overwrite")
        else:
            rows.write.mode(c.write_mode).format(c.file_format).partitionBy(*c.partition_by).save(c.path)


@transform
class WriteToIceberg(TableSink):
    type = "WriteToIceberg"

    @dataclass
    class Config(IcebergTable):
        write_mode: str = "append"

    def check(self) -> None:
        self.schema = parse_fields(self.config.schema_fields, ICEBERG_TYPES)
        if self.config.write_mode not in ("append", "overwrite"):
            raise PipelineError("write_mode must be append or overwrite")

    def delivery(self) -> Delivery:
        append = self.config.write_mode == "append"
        return Delivery("AT_LEAST_ONCE" if append else "EXACTLY_ONCE", "NONE", "NONE", needs_key=append)

    def prepare(self, data: Data, ctx: Context) -> None:
        by = {f.name: f for f in data.schema}
        if missing := [f.name for f in self.schema if f.name not in by]:
            raise PipelineError(f"{ctx.name}: fields are missing: {', '.join(missing)}")
        self.aligned = [(f.name, *narrowed(by[f.name], f.dataType)) for f in self.schema]

    bad_rows = WriteToHive.bad_rows

    def write(self, df: DataFrame, ctx: Context) -> None:
        name = self.config.name(ctx.spark)
        rows = df.select(*[value.alias(n) for n, value, _ in self.aligned])
        if not ctx.spark.catalog.tableExists(name):
            rows.limit(0).writeTo(name).using("iceberg").create()
        writer = rows.writeTo(name)
        writer.append() if self.config.write_mode == "append" else writer.overwrite(F.lit(True))


@transform
class WriteToSpark(TableSink):
    """Any format that Spark writes, by name."""

    type = "WriteToSpark"

    @dataclass
    class Config:
        format: str
        path: str = ""
        mode: str = "append"
        options: dict[str, Any] = field(default_factory=dict)
        partition_by: list[str] = field(default_factory=list)

    def check(self) -> None:
        if self.config.mode not in ("append", "overwrite", "error", "ignore"):
            raise PipelineError("mode must be append, overwrite, error or ignore")

    def delivery(self) -> Delivery:
        return Delivery("AT_LEAST_ONCE", "NONE", "NONE")

    def write(self, df: DataFrame, ctx: Context) -> None:
        c = self.config
        writer = df.write.format(c.format).mode(c.mode).options(**{k: str(v) for k, v in c.options.items()}).partitionBy(*c.partition_by)
        writer.save(c.path) if c.path else writer.save()

