"""Global aggregates of sources: count, min, max, sum and avg in exactly one row.

Dialects differ in names, types and in what a sum of nulls is:

- ``sql``: ``count``, ``op_column``; the database's (Spark's) types, null sums
- ``lake``: the same names; sum and avg are doubles of numeric columns
- ``columnar``: min, max and sum keep the column's type; an all-null sum is 0
- ``document``: an alias for each; all but count are doubles; an all-null sum is 0, a sum of no rows null
- ``search``: as ``lake``, with min and max doubles too
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import PipelineError

OPS = ("count", "min", "max", "sum", "avg")
DIALECTS = ("sql", "lake", "columnar", "document", "search")


def parse(specs: list[Any], dialect: str) -> list[tuple[str, str | None, str]]:
    """Operator, column (None: rows) and output name of each aggregate."""
    if dialect not in DIALECTS:
        raise PipelineError(f"dialect {dialect!r} is not known")
    out = []
    for spec in specs:
        if isinstance(spec, str):
            op, _, column = spec.partition(":")
            alias = None
        elif isinstance(spec, dict) and not set(spec) - {"type", "column", "as"}:
            op, column, alias = spec.get("type", ""), spec.get("column") or "", spec.get("as")
        else:
            raise PipelineError(f"aggregate {spec!r} is not known")
        op, column = op.strip().lower(), column.strip()
        if op not in OPS:
            raise PipelineError(f"aggregate {op!r} is not one of {', '.join(OPS)}")
        if op == "count" and column in ("", "*"):
            column = ""
        elif op == "count" and dialect in ("lake", "search"):
            raise PipelineError("count takes no column here")
        if op != "count" and not column:
            raise PipelineError(f"{op} needs a column")
        if dialect == "document" and not alias:
            raise PipelineError("every aggregate needs an alias (as)")
        if dialect != "document" and alias:
            raise PipelineError("aliases are not known here")
        out.append((op, column or None, alias or (f"{op}_{column}" if column else op)))
    names = [n for *_, n in out]
    if not out or len(set(names)) < len(names):
        raise PipelineError("aggregates must be given, with distinct names")
    return out


def columns(specs: list[Any], schema: T.StructType, dialect: str = "sql") -> list[Column]:
    made = []
    for op, name, alias in parse(specs, dialect):
        if name is None:
            made.append(F.count(F.lit(1)).alias(alias))
            continue
        field = next((f for f in schema if f.name == name), None)
        if field is None:
            raise PipelineError(f"column {name!r} is not among {', '.join(schema.names)}")
        column, numeric = F.col(f"`{name}`"), isinstance(field.dataType, T.NumericType)
        if op in ("sum", "avg") and not numeric or op in ("min", "max") and dialect in ("document", "search") and not numeric:
            raise PipelineError(f"{op} needs a numeric column; {name} is {field.dataType.simpleString()}")
        if op == "count":
            value = F.count(column)
        elif op in ("min", "max"):
            value = getattr(F, op)(column)
            value = value.cast("double") if dialect in ("document", "search") else value
        elif op == "sum":
            value = F.sum(column.cast("double")) if dialect in ("lake", "document", "search") else F.sum(column)
            if dialect == "columnar":
                value = F.coalesce(value, F.lit(0)).cast(value_type(field.dataType))
            elif dialect == "document":
                value = F.when(F.count(F.lit(1)) > 0, F.coalesce(value, F.lit(0.0)))
        elif dialect == "columnar" and isinstance(field.dataType, T.DecimalType):
            value = F.avg(column).cast(field.dataType)
        else:
            value = F.avg(column if dialect == "sql" else column.cast("double"))
        made.append(value.alias(alias))
    return made


def value_type(kind: T.DataType) -> T.DataType:
    """A sum keeps the column's type but for small integers, which would overflow."""
    return T.LongType() if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)) else kind


def aggregate(df: DataFrame, specs: list[Any], dialect: str = "sql") -> DataFrame:
    return df.agg(*columns(specs, df.schema, dialect))
