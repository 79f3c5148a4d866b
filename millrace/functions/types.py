"""Types, strict literals and literal inference.

A declared schema is a Spark ``StructType`` whose nullability is meant exactly;
it is kept beside each DataFrame, because file reads reset Spark's own flags.
"""

from __future__ import annotations

import base64
import binascii
import datetime as dt
import math
import re
from decimal import Decimal, InvalidOperation
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import PipelineError

DECIMAL = T.DecimalType(38, 18)
#: Names of scalar types in configs.
SCALARS: dict[str, T.DataType] = {
    "STRING": T.StringType(),
    "BOOLEAN": T.BooleanType(),
    "BOOL": T.BooleanType(),
    "BYTE": T.ByteType(),
    "INT8": T.ByteType(),
    "SHORT": T.ShortType(),
    "INT16": T.ShortType(),
    "INT": T.IntegerType(),
    "INT32": T.IntegerType(),
    "LONG": T.LongType(),
    "INT64": T.LongType(),
    "FLOAT": T.FloatType(),
    "FLOAT32": T.FloatType(),
    "DOUBLE": T.DoubleType(),
    "FLOAT64": T.DoubleType(),
    "DECIMAL": DECIMAL,
    "BYTES": T.BinaryType(),
    "DATETIME": T.TimestampType(),
    "TIMESTAMP": T.TimestampType(),
    "DATE": T.DateType(),
    "LOCAL_DATETIME": T.TimestampNTZType(),
}
INTEGRAL = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


def scalar(name: str, allowed: set[str] | None = None, case_sensitive: bool = False) -> T.DataType:
    key = name.strip() if case_sensitive else name.strip().upper()
    if key not in SCALARS or allowed is not None and key not in allowed:
        raise PipelineError(f"type {name!r} is not known here; known: {', '.join(sorted(allowed or SCALARS))}")
    return SCALARS[key]


def parse_fields(fields: list[str], allowed: set[str] | None = None, case_sensitive: bool = False) -> T.StructType:
    """``["name:TYPE"]`` as a schema of nullable fields."""
    out: list[T.StructField] = []
    for field in fields:
        name, colon, kind = field.partition(":")
        if not name.strip() or not colon:
            raise PipelineError(f"{field!r} is not of the form name:TYPE")
        if any(f.name == name.strip() for f in out):
            raise PipelineError(f"field {name.strip()!r} is declared twice")
        out.append(T.StructField(name.strip(), scalar(kind, allowed, case_sensitive), True))
    return T.StructType(out)


def infer_type(values: list[Any]) -> T.DataType:
    """The type of literals that stand in one place."""
    some = [v for v in values if v is not None]
    if not some:
        return T.StringType()
    kinds = {"bool" if isinstance(v, bool) else "int" if isinstance(v, int) else "float" if isinstance(v, float) else type(v).__name__ for v in some}
    if kinds == {"bool"}:
        return T.BooleanType()
    if kinds == {"int"}:
        if any(not -(2**63) <= v < 2**63 for v in some):
            raise PipelineError("an integer literal does not fit 64 bits")
        return T.LongType()
    if kinds <= {"int", "float"}:
        return T.DoubleType()
    if kinds == {"str"}:
        return T.StringType()
    if kinds == {"dict"}:
        return infer_schema(some)
    if kinds == {"list"}:
        items = [x for v in some for x in v]
        return T.ArrayType(infer_type(items), any(x is None for x in items))
    raise PipelineError(f"literals of mixed types: {', '.join(sorted(kinds))}")


def infer_schema(records: list[dict[str, Any]]) -> T.StructType:
    """Fields in the order they first appear; missing or null anywhere makes a field nullable."""
    names = list(dict.fromkeys(k for r in records for k in r))
    return T.StructType([T.StructField(n, infer_type([r.get(n) for r in records]), any(r.get(n) is None for r in records)) for n in names])


def _fail(what: str, value: Any, kind: T.DataType) -> PipelineError:
    return PipelineError(f"{what}: {value!r} is not a {kind.simpleString()} literal")


def convert(value: Any, kind: T.DataType, nullable: bool = True, what: str = "literal") -> Any:
    """A JSON literal as a value of a type: exact, or an error."""
    if value is None:
        if not nullable:
            raise PipelineError(f"{what} must not be null")
        return None
    number = isinstance(value, (int, float, Decimal)) and not isinstance(value, bool)
    if isinstance(kind, T.StringType):
        if isinstance(value, str):
            return value
    elif isinstance(kind, T.BooleanType):
        if isinstance(value, bool):
            return value
    elif type(kind) in INTEGRAL:
        if number and (not isinstance(value, float) or math.isfinite(value)) and value == int(value):
            bits = INTEGRAL[type(kind)]
            if -(1 << bits - 1) <= int(value) < 1 << bits - 1:
                return int(value)
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        if number:
            try:
                x = float(value)
            except OverflowError:
                x = math.inf
            if math.isfinite(x) and (isinstance(kind, T.DoubleType) or abs(x) <= 3.4028235677973366e38):
                return x
    elif isinstance(kind, T.DecimalType):
        if number or isinstance(value, str):
            try:
                x = Decimal(str(value).strip())
            except InvalidOperation:
                raise _fail(what, value, kind) from None
            if x.is_finite():
                return x
    elif isinstance(kind, T.BinaryType):
        if isinstance(value, str):
            try:
                return bytearray(base64.b64decode(value, validate=True))
            except binascii.Error:
                raise _fail(what, value, kind) from None
    elif isinstance(kind, T.DateType):
        if isinstance(value, str):
            try:
                return dt.date.fromisoformat(value)
            except ValueError:
                raise _fail(what, value, kind) from None
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        if isinstance(value, str):
            try:
                x = dt.datetime.fromisoformat(value)
            except ValueError:
                raise _fail(what, value, kind) from None
            if isinstance(kind, T.TimestampNTZType):
                if x.tzinfo is None:
                    return x
            else:
                return x if x.tzinfo else x.replace(tzinfo=dt.timezone.utc)
    elif isinstance(kind, T.ArrayType):
        if isinstance(value, list):
            return [convert(v, kind.elementType, kind.containsNull, f"{what}[]") for v in value]
    elif isinstance(kind, T.MapType):
        if isinstance(value, dict):
            return {convert(_key(k, kind.keyType), kind.keyType, False, f"{what} key"): convert(v, kind.valueType, kind.valueContainsNull, f"{what}[{k}]") for k, v in value.items()}
    elif isinstance(kind, T.StructType):
        if isinstance(value, dict):
            return convert_row(value, kind, what)
    elif kind.typeName().startswith("time") and isinstance(value, str):
        try:
            return dt.time.fromisoformat(value)
        except ValueError:
            raise _fail(what, value, kind) from None
    raise _fail(what, value, kind)


def _key(text: str, kind: T.DataType) -> Any:
    """A map's key, which JSON has as text."""
    if type(kind) in INTEGRAL and re.fullmatch(r"-?\d+", text):
        return int(text)
    if isinstance(kind, T.BooleanType) and text in ("true", "false"):
        return text == "true"
    return text


def convert_row(record: dict[str, Any], schema: T.StructType, what: str = "record") -> tuple:
    unknown = set(record) - set(schema.names)
    if unknown:
        raise PipelineError(f"{what} has unknown fields: {', '.join(sorted(unknown))}")
    return tuple(convert(record.get(f.name), f.dataType, f.nullable, f"{what}.{f.name}") for f in schema)


def literal(value: Any, kind: T.DataType) -> Column:
    """A converted value as a typed column."""
    if value is None:
        return F.lit(None).cast(kind)
    if isinstance(kind, T.ArrayType):
        return F.array(*[literal(v, kind.elementType) for v in value]).cast(kind)
    if isinstance(kind, T.MapType):
        return F.create_map(*[x for k, v in value.items() for x in (literal(k, kind.keyType), literal(v, kind.valueType))]).cast(kind)
    if isinstance(kind, T.StructType):
        return F.struct(*[literal(v, f.dataType).alias(f.name) for v, f in zip(value, kind.fields, strict=True)])
    if isinstance(kind, T.BinaryType):
        return F.lit(bytes(value))
    return F.lit(value).cast(kind)
