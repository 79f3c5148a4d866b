"""The eleven row transforms.  All are column expressions, so Catalyst fuses and pushes them."""

from __future__ import annotations

import logging
from collections import Counter
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import AssertionFailed, PipelineError
from millrace.functions import types as X
from millrace.plans.registry import ANY, INPUT, OUTPUT, Context, Data, RowTransform, Source, Transform, transform

log = logging.getLogger("millrace")


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def field_of(schema: T.StructType, name: str) -> T.StructField:
    found = next((f for f in schema if f.name == name), None)
    if found is None:
        raise PipelineError(f"field {name!r} is not among {', '.join(schema.names)}")
    return found


def make(data: Data, columns: list[Column], fields: list[T.StructField]) -> Data:
    return Data(data.df.select(*columns), T.StructType(fields))


@transform
class Create(Source):
    """Literal rows."""

    type = "Create"

    @dataclass
    class Config:
        elements: list[dict[str, Any]]

    def check(self) -> None:
        if not self.config.elements:
            raise PipelineError("elements must not be empty")
        self.schema = X.infer_schema(self.config.elements)

    def read(self, ctx: Context) -> Data:
        rows = [X.convert_row(r, self.schema, f"elements[{i}]") for i, r in enumerate(self.config.elements)]
        return Data(ctx.spark.createDataFrame(rows, self.schema), self.schema)


@transform
class MapToFields(RowTransform):
    """Selects and renames; with ``append`` over the fields kept."""

    type = "MapToFields"

    @dataclass
    class Config:
        fields: dict[str, str] = field(default_factory=dict)
        append: bool = False
        drop: list[str] = field(default_factory=list)

    def check(self) -> None:
        c = self.config
        if c.drop and not c.append:
            raise PipelineError("drop needs append")
        if len(set(c.drop)) < len(c.drop):
            raise PipelineError("drop names a field twice")
        if not c.fields and not c.drop:
            raise PipelineError("fields must not be empty")

    def apply(self, data: Data, ctx: Context) -> Data:
        c = self.config
        for name in c.drop:
            field_of(data.schema, name)
        sources = {n: n for n in data.schema.names if n not in c.drop} if c.append else {}
        sources |= c.fields  # a name that is there already keeps its place
        fields = [field_of(data.schema, s) for s in sources.values()]
        return make(data, [col(s).alias(t) for t, s in sources.items()], [T.StructField(t, f.dataType, f.nullable) for t, f in zip(sources, fields, strict=True)])


@transform
class AddFields(RowTransform):
    """Appends typed constants."""

    type = "AddFields"

    @dataclass
    class Config:
        fields: dict[str, Any]

    def check(self) -> None:
        if not self.config.fields:
            raise PipelineError("fields must not be empty")
        self.schema = X.infer_schema([self.config.fields])

    def apply(self, data: Data, ctx: Context) -> Data:
        if both := set(data.schema.names) & set(self.schema.names):
            raise PipelineError(f"fields exist already: {', '.join(sorted(both))}")
        values = X.convert_row(self.config.fields, self.schema)
        added = [X.literal(v, f.dataType).alias(f.name) for v, f in zip(values, self.schema, strict=True)]
        return make(data, [*map(col, data.schema.names), *added], [*data.schema.fields, *self.schema.fields])


@transform
class Filter(RowTransform):
    """Keeps rows by one field.  Null differs from every value, so ``not_equals`` keeps nulls.

    Decimals compare by value, and 0.0 equals -0.0.
    """

    type = "Filter"

    @dataclass
    class Config:
        field: str
        operator: str = "equals"
        value: Any = None
        values: list[Any] | None = None

    def check(self) -> None:
        c = self.config
        if c.operator not in ("equals", "not_equals", "in", "is_null", "is_not_null"):
            raise PipelineError(f"operator {c.operator!r} is not known")
        if c.operator == "in":
            if not c.values or c.value is not None:
                raise PipelineError("in needs values, and no value")
        elif c.values:
            raise PipelineError(f"{c.operator} takes no values")
        elif c.operator in ("equals", "not_equals"):
            if c.value is None:
                raise PipelineError(f"{c.operator} needs a value; use is_null or is_not_null for nulls")
        elif c.value is not None:
            raise PipelineError(f"{c.operator} takes no value")

    def apply(self, data: Data, ctx: Context) -> Data:
        c, f = self.config, field_of(data.schema, self.config.field)
        column = col(f.name)
        equal = lambda v: column.eqNullSafe(X.literal(X.convert(v, f.dataType, f.nullable, f.name), f.dataType))
        if c.operator == "equals":
            keep = equal(c.value)
        elif c.operator == "not_equals":
            keep = ~equal(c.value)
        elif c.operator == "in":
            keep = reduce(lambda a, b: a | b, map(equal, c.values))
        else:
            keep = column.isNull() if c.operator == "is_null" else column.isNotNull()
        return Data(data.df.where(keep), data.schema)


@transform
class Explode(RowTransform):
    """A row for each element of an array; null elements stay, null and empty arrays give none."""

    type = "Explode"

    @dataclass
    class Config:
        field: str
        output_field: str | None = None

    def apply(self, data: Data, ctx: Context) -> Data:
        f, name = field_of(data.schema, self.config.field), self.config.output_field
        if not isinstance(f.dataType, T.ArrayType):
            raise PipelineError(f"{f.name} is not an array but {f.dataType.simpleString()}")
        element = lambda n: T.StructField(n, f.dataType.elementType, f.dataType.containsNull)
        if name is None or name == f.name:
            columns = [F.explode(col(n)).alias(n) if n == f.name else col(n) for n in data.schema.names]
            return make(data, columns, [element(x.name) if x.name == f.name else x for x in data.schema])
        if name in data.schema.names or not name or any(c.isspace() for c in name):
            raise PipelineError(f"output_field {name!r} exists already or has white space")
        return make(data, [*map(col, data.schema.names), F.explode(col(f.name)).alias(name)], [*data.schema.fields, element(name)])


#: JSON field types, and the kinds of JSON values each accepts.
JSON_TYPES = {
    "string": "string", "boolean": "boolean", "bool": "boolean", "byte": "tinyint", "int8": "tinyint", "short": "smallint", "int16": "smallint", "int": "int", "int32": "int",
    "long": "bigint", "int64": "bigint", "float": "float", "double": "double", "decimal": "decimal(38,18)", "bytes": "binary",
}
_NUMBER_KINDS = ("BIGINT", "DOUBLE", "FLOAT", "DECIMAL", "TINYINT", "SMALLINT", "INT")


def json_field(variant: Column, name: str, kind: str) -> Column:
    """A top-level key as a type: the value's own JSON kind must fit, and numbers must be exact."""
    path = "$['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']"
    found = F.try_variant_get(variant, path, "variant")
    what = F.schema_of_variant(found)
    bad = lambda: F.raise_error(F.concat(F.lit(f"JSON field {name} is not a {kind}: "), F.coalesce(F.to_json(found), F.lit("null"))))
    spark_type = JSON_TYPES[kind]
    number = F.regexp_extract(what, "^[A-Z]+", 0).isin(*_NUMBER_KINDS)
    as_decimal = F.try_variant_get(found, "$", "decimal(38,18)")
    as_double = F.try_variant_get(found, "$", "double")
    if spark_type == "string":
        value, fits = F.variant_get(found, "$", "string"), what == "STRING"
    elif spark_type == "boolean":
        value, fits = F.variant_get(found, "$", "boolean"), what == "BOOLEAN"
    elif spark_type == "binary":
        text = F.variant_get(found, "$", "string")
        value = F.try_to_binary(text, F.lit("base64"))
        fits = (what == "STRING") & value.isNotNull()
    elif spark_type in ("float", "double"):
        value = as_double.cast(spark_type)
        fits = number & value.isNotNull() & (F.abs(value) < float("inf"))
    elif spark_type.startswith("decimal"):
        value = F.when(what == "STRING", F.variant_get(found, "$", "string").try_cast(spark_type)).otherwise(as_decimal)
        fits = (number | (what == "STRING")) & value.isNotNull()
    else:
        value = as_decimal.try_cast(spark_type)
        fits = number & as_decimal.isNotNull() & value.isNotNull() & (value.cast("decimal(38,18)") == as_decimal)
    null = found.isNull() | (what == "VOID")
    return F.when(null, F.lit(None)).when(F.coalesce(fits, F.lit(False)), value).otherwise(bad().cast(spark_type)).cast(spark_type)


@transform
class JsonToFields(RowTransform):
    """Typed top-level keys of a JSON text; null and missing keys are null, all else must fit exactly."""

    type = "JsonToFields"

    @dataclass
    class Config:
        field: str
        fields: list[str]
        drop_input: bool = False

    def check(self) -> None:
        self.targets: list[tuple[str, str]] = []
        for f in self.config.fields:
            name, colon, kind = (x.strip() for x in f.rpartition(":"))
            if not colon or not name or kind.lower() not in JSON_TYPES:
                raise PipelineError(f"{f!r} is not of the form name:type")
            self.targets.append((name, kind.lower()))
        if not self.targets or len({n for n, _ in self.targets}) < len(self.targets):
            raise PipelineError("fields must be given, with distinct names")

    def apply(self, data: Data, ctx: Context) -> Data:
        f = field_of(data.schema, self.config.field)
        if not isinstance(f.dataType, T.StringType):
            raise PipelineError(f"{f.name} is not a string but {f.dataType.simpleString()}")
        kept = [x for x in data.schema if not (self.config.drop_input and x.name == f.name)]
        if both := {x.name for x in kept} & {n for n, _ in self.targets}:
            raise PipelineError(f"fields exist already: {', '.join(sorted(both))}")
        text = col(f.name)
        parsed = F.parse_json(text)
        is_object = F.schema_of_variant(parsed).startswith("OBJECT")
        # the object is parsed once, for all fields
        checked = F.when(text.isNull(), F.lit(None).cast("variant")).when(is_object, parsed).otherwise(F.raise_error(F.concat(F.lit("not a JSON object: "), F.substring(text, 1, 80))).cast("variant"))
        held = "_json"
        while held in data.schema.names:
            held += "_"
        df = data.df.withColumn(held, checked)
        columns = [*(col(x.name) for x in kept), *(json_field(col(held), n, k).alias(n) for n, k in self.targets)]
        fields = [*kept, *(T.StructField(n, X.scalar(k if k != "bool" else "BOOLEAN"), True) for n, k in self.targets)]
        return Data(df.select(*columns), T.StructType(fields))


@transform
class FillNulls(RowTransform):
    """Replaces nulls by typed literals; the schema stays as it is."""

    type = "FillNulls"

    @dataclass
    class Config:
        fields: dict[str, Any]

    def check(self) -> None:
        if not self.config.fields or any(v is None for v in self.config.fields.values()):
            raise PipelineError("fields must be given, without nulls")

    def apply(self, data: Data, ctx: Context) -> Data:
        values = {n: X.literal(X.convert(v, (f := field_of(data.schema, n)).dataType, False, n), f.dataType) for n, v in self.config.fields.items()}
        return make(data, [F.coalesce(col(n), values[n]).alias(n) if n in values else col(n) for n in data.schema.names], list(data.schema.fields))


@transform
class Flatten(Transform):
    """All rows of all inputs, whose declared schemas must be equal."""

    type = "Flatten"
    inputs = (ANY,)

    def build(self, inputs: dict[str, list[Data]], ctx: Context) -> dict[str, Data]:
        first, *others = inputs[ANY]
        for other in others:
            if other.schema != first.schema:
                raise PipelineError(f"{ctx.name}: schemas differ: {first.schema.simpleString()} and {other.schema.simpleString()}")
        return {OUTPUT: Data(reduce(DataFrame.union, [d.df for d in inputs[ANY]]), first.schema)}


@transform
class LogForTesting(RowTransform):
    """Logs rows when the pipeline runs, and passes all through."""

    type = "LogForTesting"

    @dataclass
    class Config:
        level: str = "INFO"
        prefix: str = ""
        max_rows: int = 1000

    LEVELS = {"TRACE": 5, "DEBUG": 10, "INFO": 20, "WARN": 30, "ERROR": 40}

    def check(self) -> None:
        if self.config.level.upper() not in self.LEVELS:
            raise PipelineError(f"level {self.config.level!r} is not one of {', '.join(self.LEVELS)}")

    def apply(self, data: Data, ctx: Context) -> Data:
        level, prefix, most = self.LEVELS[self.config.level.upper()], self.config.prefix, self.config.max_rows

        def show(df: DataFrame, _: int = 0) -> None:
            for row in df.take(most):  # a bounded report
                log.log(level, "%s%s", prefix, row)

        if ctx.execute:
            if data.df.isStreaming:
                ctx.queries.append(data.df.writeStream.foreachBatch(show).trigger(availableNow=True).start())
            else:
                show(data.df)
        return data


def _plain(value: Any) -> Any:
    """A row's value in a form that can be counted."""
    if isinstance(value, dict):
        return ("map", frozenset((_plain(k), _plain(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(map(_plain, value))
    return bytes(value) if isinstance(value, bytearray) else value


@transform
class AssertEqual(RowTransform):
    """When the pipeline runs: rows must equal the elements in any order."""

    type = "AssertEqual"

    @dataclass
    class Config:
        elements: list[dict[str, Any]]

    def apply(self, data: Data, ctx: Context) -> Data:
        expected = [X.convert_row(r, data.schema, f"elements[{i}]") for i, r in enumerate(self.config.elements)]
        if ctx.execute:
            plan = ctx.spark.createDataFrame(expected, T.StructType([T.StructField(f.name, f.dataType, True) for f in data.schema]))
            want = Counter(_plain(r) for r in plan.collect())
            got = Counter(_plain(r) for r in data.df.limit(len(expected) + 1000).collect())  # as many as can be reported
            if want != got:
                raise AssertionFailed(f"{ctx.name}: missing {list((want - got).elements())[:20]}, unexpected {list((got - want).elements())[:20]}")
        return data


def dead_letter_schema(element: T.StructType) -> T.StructType:
    return T.StructType([
        T.StructField("element", element, True),
        T.StructField("error_type", T.StringType(), False),
        T.StructField("error_message", T.StringType(), True),
        T.StructField("transform", T.StringType(), False),
    ])


@transform
class StripErrorMetadata(RowTransform):
    """The rows that dead letters hold; those without one are dropped."""

    type = "StripErrorMetadata"

    def apply(self, data: Data, ctx: Context) -> Data:
        element = data.schema.fields[0].dataType if data.schema.fields else None
        if not isinstance(element, T.StructType) or data.schema != dead_letter_schema(element):
            raise PipelineError(f"{ctx.name}: the input has no dead letters: {data.schema.simpleString()}")
        return Data(data.df.where("element is not null").select("element.*"), element)


__all__ = ["INPUT", "dead_letter_schema"]
