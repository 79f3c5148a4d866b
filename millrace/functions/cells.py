"""Text cells of CSV, spreadsheets and delimited tables as typed columns.

Two dialects.  ``strict``: a blank cell is null for every type, a boolean is one
of the known words, and what cannot be read fails the job, naming the column.
``lenient``: only the null sequence is null, only ``true`` is true, and what
cannot be read is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words for booleans.
TRUE_WORDS = ["true", "1", "yes", "y", "t"]
FALSE_WORDS = ["false", "0", "no", "n", "f"]


def strict(cell: Column, kind: T.DataType, name: str) -> Column:
    blank = cell.isNull() | (F.trim(cell) == "")
    if isinstance(kind, T.StringType):
        return F.when(blank, F.lit(None)).otherwise(cell)
    text = F.trim(cell)
    failed = F.raise_error(F.concat(F.lit(f"column {name} is not a {kind.simpleString()}: "), cell))
    if isinstance(kind, T.BooleanType):
        word = F.lower(text)
        return F.when(blank, F.lit(None)).when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS), False).otherwise(failed.cast("boolean"))
    value = text.try_cast(kind)
    return F.when(blank, F.lit(None)).when(value.isNotNull(), value).otherwise(failed.cast(kind))


def lenient(cell: Column, kind: T.DataType, null: str = "\\N") -> Column:
    if isinstance(kind, T.StringType):
        value = cell
    elif isinstance(kind, T.BooleanType):
        value = F.lower(cell) == "true"
    elif isinstance(kind, T.BinaryType):
        value = F.try_to_binary(cell, F.lit("base64"))
    else:
        value = F.trim(cell).try_cast(kind)
    return F.when(cell == null, F.lit(None)).otherwise(value)


def delimited(line: Column, schema: T.StructType, delimiters: str = "\x01\x02\x03\x04\x05\x06\x07\x08", null: str = "\\N") -> list[Column]:
    """A line's cells by nested delimiters: missing cells are null, cells beyond the schema are left out."""
    cells = F.split(line, _literal(delimiters[0]), -1)
    return [nested(F.try_element_at(cells, F.lit(i + 1)), f.dataType, delimiters[1:], null).alias(f.name) for i, f in enumerate(schema)]


def _literal(delimiter: str) -> str:
    return "\\Q" + delimiter + "\\E"


def nested(cell: Column, kind: T.DataType, delimiters: str, null: str) -> Column:
    """A cell of any type; collections use the next delimiters."""
    if isinstance(kind, T.ArrayType):
        value = F.transform(F.split(cell, _literal(delimiters[0]), -1), lambda x: nested(x, kind.elementType, delimiters[1:], null))
        return F.when(cell == null, F.lit(None)).when(cell == "", F.array().cast(kind)).otherwise(value)
    if isinstance(kind, T.MapType):
        entries = F.transform(
            F.split(cell, _literal(delimiters[0]), -1),
            lambda x: F.struct(
                nested(F.split(x, _literal(delimiters[1]), 2)[0], kind.keyType, delimiters[2:], null), nested(F.try_element_at(F.split(x, _literal(delimiters[1]), 2), F.lit(2)), kind.valueType, delimiters[2:], null)
            ),
        )
        return F.when(cell == null, F.lit(None)).when(cell == "", F.create_map().cast(kind)).otherwise(F.map_from_entries(entries))
    if isinstance(kind, T.StructType):
        cells = F.split(cell, _literal(delimiters[0]), -1)
        value = F.struct(*[nested(F.try_element_at(cells, F.lit(i + 1)), f.dataType, delimiters[1:], null).alias(f.name) for i, f in enumerate(kind)])
        return F.when(cell == null, F.lit(None)).otherwise(value)
    return lenient(cell, kind, null)


def hive_type(text: str) -> T.DataType:
    """A Hive type's text as a type: char and varchar are strings, bare decimal is (10,0); unions are not known."""
    lowered = text.lower().strip()
    if "uniontype" in lowered or lowered in ("void", "null"):
        from millrace.errors import PipelineError

        raise PipelineError(f"type {text!r} is not supported")
    import re

    lowered = re.sub(r"\b(var)?char\s*\(\s*\d+\s*\)", "string", lowered)
    lowered = lowered.replace("timestamp with local time zone", "timestamp_ltz")
    lowered = re.sub(r"\btimestamp\b", "timestamp_ntz", lowered)
    return T._parse_datatype_string(lowered)
