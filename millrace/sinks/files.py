"""File sinks: text, CSV and spreadsheets, with prefixes and shard counts."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import CapabilityError, PipelineError
from millrace.operators.transforms import col, dead_letter_schema
from millrace.plans.registry import ERRORS, INPUT, Context, Data, Delivery, Sink, transform
from millrace.sources.files import FileOptions
from millrace.streaming.windows import without_marks


def publish(spark: SparkSession, staged: str, target: str, prefix: str, replace: bool = False) -> int:
    """Renames a finished write's part files to ``prefix-00000-of-00004`` names; the driver moves names, not bytes.

    Files that an earlier run left under the prefix stay, and this run's names
    get a mark of their own; with ``replace`` (a repeated batch of a stream) they
    go.  The staged folder is removed when all its files are moved, never before.
    """
    jvm = spark.sparkContext._jvm
    path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path(target))
    taken = [s.getPath() for s in fs.listStatus(path(target)) if re.fullmatch(re.escape(prefix) + r"-\d{5}-of-\d{5}(\..*)?", s.getPath().getName())]
    if taken and not replace:
        prefix, taken = f"{prefix}-{uuid.uuid4().hex[:12]}", []
    names = sorted(s.getPath().getName() for s in fs.listStatus(path(staged)) if s.getPath().getName().startswith("part-"))
    for old in taken:
        fs.delete(old, False)
    for i, name in enumerate(names):
        suffix = name[name.index(".") :] if "." in name else ""
        final = f"{target}/{prefix}-{i:05d}-of-{len(names):05d}{suffix}"
        if not fs.rename(path(f"{staged}/{name}"), path(final)):
            raise RuntimeError(f"{staged}/{name} could not be moved to {final}; it and the files after it are still there")
    fs.delete(path(staged), True)
    return len(names)


def shape(df: DataFrame, shards: int) -> DataFrame:
    return df.repartition(shards) if shards else df


def csv_text(f: T.StructField) -> Column:
    """A value as CSV has it."""
    return F.base64(col(f.name)) if isinstance(f.dataType, T.BinaryType) else col(f.name).cast("string")


@transform
class WriteToFilesystem(Sink):
    """A directory of text or CSV files, written aside and renamed."""

    type = "WriteToFilesystem"

    @dataclass
    class Config(FileOptions):
        file_prefix: str = "output"
        num_shards: int = 0

    def check(self) -> None:
        self.schema = self.config.schema()
        if self.config.num_shards < 0 or self.config.file_format == "xlsx" and self.config.num_shards != 1:
            raise PipelineError("num_shards must not be negative, and 1 for xlsx")
        if not self.config.file_prefix or "/" in self.config.file_prefix:
            raise PipelineError("file_prefix must be a name")

    def delivery(self) -> Delivery:
        return Delivery("EXACTLY_ONCE", "NONE", "NONE")

    def build(self, inputs: dict[str, list[Data]], ctx: Context) -> dict[str, Data]:
        data, c = inputs[INPUT][0], self.config
        names = {f.name for f in data.schema}
        if missing := [f.name for f in self.schema if f.name not in names]:
            raise PipelineError(f"{ctx.name}: fields are missing: {', '.join(missing)}")
        letters = dead_letter_schema(data.schema)
        none = Data(ctx.spark.createDataFrame([], letters), letters)
        if not ctx.execute:
            return {ERRORS: none}
        df = without_marks(data.df)
        if df.isStreaming:
            from millrace.sinks.writer import start_stream

            start_stream(df, lambda batch, n: self._write(batch, ctx.spark, f"{c.file_prefix}-{n}", replace=True), ctx)
            return {ERRORS: none}
        if c.file_format != "text":
            self._write(df, ctx.spark, c.file_prefix)
            return {ERRORS: none}
        bad = df.where(col("content").isNull())
        if not ctx.errors_wanted and not bad.isEmpty():
            raise RuntimeError(f"{ctx.name}: a null content cannot be written")
        self._write(df.where(col("content").isNotNull()), ctx.spark, c.file_prefix)
        failed = bad.select(F.struct(*map(col, data.schema.names)).alias("element"), F.lit("ValueError").alias("error_type"), F.lit("content is null").alias("error_message"), F.lit(ctx.name).alias("transform"))
        return {ERRORS: Data(failed, letters)}

    def _write(self, df: DataFrame, spark: SparkSession, prefix: str, replace: bool = False) -> None:
        c, target = self.config, self.config.full_path().rstrip("/")
        staged = f"{target}/_staged-{uuid.uuid4().hex}"
        if c.file_format == "xlsx":
            self._write_xlsx(df, target, prefix)
            return
        if c.file_format == "text":
            shape(df.select("content"), c.num_shards).write.text(staged)
        else:
            rows = df.select(*[csv_text(f).alias(f.name) for f in self.schema])
            writer = shape(rows, c.num_shards).write.option("header", c.header).option("sep", c.csv_delimiter).option("quote", c.csv_quote).option("escape", c.csv_quote)
            writer.option("encoding", c.encoding).option("emptyValue", "").option("nullValue", "").csv(staged)
        publish(spark, staged, target, prefix, replace)

    def _write_xlsx(self, df: DataFrame, target: str, prefix: str) -> None:
        """One workbook: a format of one file, streamed by the driver."""
        try:
            import openpyxl
        except ModuleNotFoundError:
            raise CapabilityError("xlsx needs openpyxl") from None
        if not target.startswith("file:"):
            raise CapabilityError("workbooks are written to file systems mounted on the driver")
        book = openpyxl.Workbook(write_only=True)
        page = book.create_sheet(self.config.sheet or "Sheet1")
        if self.config.header:
            page.append(self.schema.names)
        for row in df.select(*[col(f.name) for f in self.schema]).toLocalIterator():
            page.append(list(row))
        book.save(f"{target.removeprefix('file:').replace('//', '/', 1)}/{prefix}.xlsx")
