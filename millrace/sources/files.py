"""File sources: text, CSV and spreadsheets."""

from __future__ import annotations

import fnmatch
import io
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import CapabilityError, PipelineError
from millrace.functions import cells
from millrace.functions.types import parse_fields
from millrace.plans.registry import Context, Data, Delivery, Source, transform

#: Types that cells know.
CELL_TYPES = {"STRING", "INT", "LONG", "FLOAT", "DOUBLE", "BOOLEAN", "SHORT", "BYTE"}
CONTENT = T.StructType([T.StructField("content", T.StringType(), True)])


@dataclass
class FileOptions:
    path: str
    default_fs: str = "file:///"
    file_format: str = "text"
    schema_fields: list[str] = field(default_factory=list)
    header: bool = False
    sheet: str = ""
    encoding: str = "UTF-8"
    csv_delimiter: str = ","
    csv_quote: str = '"'

    def full_path(self) -> str:
        if "://" in self.path or self.path.startswith("file:"):
            return self.path
        return self.default_fs.rstrip("/") + "/" + self.path.lstrip("/")

    def schema(self) -> T.StructType:
        """Checks the options against the format, and gives the rows' schema."""
        if "://" not in self.default_fs and not self.default_fs.endswith(":"):
            raise PipelineError("default_fs needs a scheme")
        if self.file_format not in ("text", "csv", "xlsx"):
            raise PipelineError(f"file_format {self.file_format!r} is not text, csv or xlsx")
        if len(self.csv_delimiter) != 1 or len(self.csv_quote) != 1:
            raise PipelineError("csv_delimiter and csv_quote are one character")
        if self.file_format != "csv" and (self.csv_delimiter, self.csv_quote) != (",", '"'):
            raise PipelineError("csv options belong to csv")
        if self.file_format != "csv" and self.encoding.upper() != "UTF-8":
            raise PipelineError(f"{self.file_format} is UTF-8")
        if self.file_format != "xlsx" and self.sheet:
            raise PipelineError("sheet belongs to xlsx")
        if self.file_format == "text":
            if self.schema_fields or self.header:
                raise PipelineError("text takes no schema_fields or header")
            return CONTENT
        if not self.schema_fields:
            raise PipelineError(f"{self.file_format} needs schema_fields")
        return parse_fields(self.schema_fields, CELL_TYPES)


def read_csv(spark: SparkSession, o: FileOptions, schema: T.StructType) -> DataFrame:
    """Cells by position; short rows are padded with nulls, long ones fail."""
    extra = "_more"
    texts = T.StructType([*(T.StructField(f"_c{i}", T.StringType()) for i in range(len(schema))), T.StructField(extra, T.StringType())])
    reader = spark.read.schema(texts).option("header", o.header).option("sep", o.csv_delimiter).option("quote", o.csv_quote).option("escape", o.csv_quote)
    raw = reader.option("encoding", o.encoding).option("multiLine", True).option("mode", "PERMISSIVE").option("enforceSchema", True).option("nullValue", "").csv(o.full_path())
    too_long = F.when(F.col(extra).isNotNull(), F.raise_error(F.lit(f"a row has more than {len(schema)} cells")).cast("boolean")).otherwise(True)
    return raw.where(too_long).select(*[cells.strict(F.col(f"_c{i}"), f.dataType, f.name).alias(f.name) for i, f in enumerate(schema)])


def sheet_cells(data: bytes, sheet: str, header: bool, width: int) -> Iterator[list[str | None]]:
    """Rows of a workbook's sheet as texts; integers without a fraction, dates as ISO; error cells fail."""
    try:
        import openpyxl
    except ModuleNotFoundError:
        raise CapabilityError("xlsx needs openpyxl") from None
    book = openpyxl.load_workbook(io.BytesIO(data), read_only=True, data_only=True)
    page = book[sheet] if sheet else book.worksheets[0]
    for i, row in enumerate(page.iter_rows()):
        if header and i == 0:
            continue
        values = []
        for cell in row:
            v = cell.value
            if cell.data_type == "e":
                raise ValueError(f"an error cell in row {i + 1}")
            if isinstance(v, float) and v.is_integer():
                v = int(v)
            values.append(None if v is None else str(v).lower() if isinstance(v, bool) else v.isoformat() if hasattr(v, "isoformat") else str(v))
        if any(v is not None for v in values[width:]):
            raise ValueError(f"row {i + 1} has more than {width} cells")
        yield (values + [None] * width)[:width]


def read_xlsx(spark: SparkSession, o: FileOptions, schema: T.StructType) -> DataFrame:
    sheet, header, names = o.sheet, o.header, [f"_c{i}" for i in range(len(schema))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                rows = list(sheet_cells(data.as_py(), sheet, header, len(names)))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(len(names))], names=names)

    raw = spark.read.format("binaryFile").load(o.full_path()).select("content").mapInArrow(run, ", ".join(f"{n} string" for n in names))
    return raw.select(*[cells.strict(F.col(n), f.dataType, f.name).alias(f.name) for n, f in zip(names, schema, strict=True)])


def read_files(spark: SparkSession, o: FileOptions, schema: T.StructType) -> DataFrame:
    if o.file_format == "text":
        return spark.read.text(o.full_path()).withColumnRenamed("value", "content")
    return (read_csv if o.file_format == "csv" else read_xlsx)(spark, o, schema)


@transform
class ReadFromFilesystem(Source):
    type = "ReadFromFilesystem"

    @dataclass
    class Config(FileOptions):
        pass

    def check(self) -> None:
        self.schema = self.config.schema()

    def delivery(self) -> Delivery:
        return Delivery("AT_LEAST_ONCE", "FULL_REPLAY", "NONE")

    def read(self, ctx: Context) -> Data:
        return Data(read_files(ctx.spark, self.config, self.schema), self.schema)


# Byte ranges of text, for sources that Spark cannot split itself


def byte_ranges(size: int, split: int) -> list[tuple[int, int]]:
    """Half-open ranges of at most ``split`` bytes."""
    return [(at, min(at + split, size)) for at in range(0, size, split)]


def lines_of_range(read: callable, start: int, stop: int, block: int = 1 << 16) -> Iterator[bytes]:
    """Lines that begin in a range: a range other than the first begins after the first line break at or after start - 1."""
    at, held = max(0, start - 1), b""
    if start:
        while True:
            data = read(at, block)
            if not data:
                return
            cut = data.find(b"\n")
            if cut >= 0:
                at += cut + 1
                break
            at += len(data)
    begin = at  # of the line that is held
    while begin < stop:
        data = read(at, block)
        if not data:
            if held:
                yield held
            return
        at += len(data)
        held += data
        *whole, held = held.split(b"\n")
        for line in whole:
            if begin >= stop:
                return
            yield line.removesuffix(b"\r")
            begin += len(line) + 1


def matching(names: list[str], pattern: str | None) -> list[str]:
    return sorted(n for n in names if pattern is None or fnmatch.fnmatchcase(n.rpartition("/")[2], pattern))
