"""Predicates of source configs as Spark columns, which Catalyst pushes down.

Two grammars: a list of ``{column, op, value}`` joined by AND, and a text
expression with AND, OR, parentheses, comparisons, IN and IS [NOT] NULL.  In
both a comparison with null is not true.
"""

from __future__ import annotations

import re
from decimal import Decimal, InvalidOperation
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import PipelineError

#: Spellings of operators in predicate lists.
OPERATORS = {
    "=": "eq", "==": "eq", "eq": "eq", "!=": "ne", "<>": "ne", "neq": "ne", ">": "gt", "gt": "gt", ">=": "ge", "gte": "ge", "ge": "ge",
    "<": "lt", "lt": "lt", "<=": "le", "lte": "le", "le": "le", "is null": "null", "isnull": "null", "is not null": "not_null", "isnotnull": "not_null",
}


def _column(name: str, schema: T.StructType, exact: bool) -> T.StructField:
    found = [f for f in schema if f.name == name or not exact and f.name.lower() == name.lower()]
    if len(found) != 1:
        raise PipelineError(f"column {name!r} is not among {', '.join(schema.names)}")
    return found[0]


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def compare(column: Column, op: str, value: Any) -> Column:
    value = F.lit(value)
    return {"eq": column == value, "ne": column != value, "gt": column > value, "ge": column >= value, "lt": column < value, "le": column <= value}[op]


def from_list(predicates: list[dict[str, Any]], schema: T.StructType) -> Column | None:
    """All of ``[{column, op, value}]``; numbers compare as decimals, strings by their UTF-8 bytes."""
    parts = []
    for p in predicates:
        unknown = set(p) - {"column", "op", "value"}
        if unknown or not isinstance(p.get("column"), str):
            raise PipelineError(f"predicate {p!r} is not of the form column, op, value")
        op = OPERATORS.get(" ".join(str(p.get("op", "=")).lower().split()))
        if op is None:
            raise PipelineError(f"operator {p.get('op')!r} is not known")
        field = _column(p["column"], schema, exact=False)
        column = _quoted(field.name)
        if op in ("null", "not_null"):
            if "value" in p:
                raise PipelineError(f"{p['op']} takes no value")
            parts.append(column.isNull() if op == "null" else column.isNotNull())
            continue
        if p.get("value") is None:
            raise PipelineError(f"a comparison of {field.name} needs a value")
        if isinstance(field.dataType, T.StringType):
            value: Any = str(p["value"])
        elif isinstance(field.dataType, T.NumericType):
            try:
                value = Decimal(str(p["value"]))
            except InvalidOperation:
                raise PipelineError(f"{p['value']!r} is not a number for {field.name}") from None
            if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
                value = float(value)
            elif value == int(value):
                value = int(value)
        else:
            raise PipelineError(f"column {field.name} of type {field.dataType.simpleString()} cannot be compared")
        parts.append(compare(column, op, value))
    return reduce(lambda a, b: a & b, parts) if parts else None


_TOKEN = re.compile(r"\s*(?:(?P<str>'[^']*')|(?P<num>-?\d+(?:\.\d+)?)|(?P<op><=|>=|<>|!=|=|<|>|\(|\)|,)|(?P<word>[A-Za-z][A-Za-z0-9_]*))")
_WORDS = {"AND", "OR", "IS", "NOT", "NULL", "IN", "TRUE", "FALSE"}


class _Parser:
    def __init__(self, text: str, schema: T.StructType):
        self.schema, self.tokens, self.at = schema, [], 0
        pos, text = 0, text.rstrip()
        while pos < len(text):
            m = _TOKEN.match(text, pos)
            if not m:
                raise PipelineError(f"filter: nothing is known at {text[pos : pos + 20]!r}")
            kind = m.lastgroup
            value = m[kind]
            if kind == "word" and value.upper() in _WORDS:
                kind, value = "key", value.upper()
            self.tokens.append((kind, value))
            pos = m.end()

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in ("op", "key") and self.tokens[self.at][1] in values

    def take(self, *values: str) -> str:
        if not self.peek(*values):
            raise PipelineError(f"filter: {' or '.join(values)} is expected {self.where()}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def where(self) -> str:
        return f"before {self.tokens[self.at][1]!r}" if self.at < len(self.tokens) else "at the end"

    def any_of(self) -> Column:
        out = self.all_of()
        while self.peek("OR"):
            self.at += 1
            out = out | self.all_of()
        return out

    def all_of(self) -> Column:
        out = self.one()
        while self.peek("AND"):
            self.at += 1
            out = out & self.one()
        return out

    def value(self) -> Any:
        if self.at < len(self.tokens):
            kind, text = self.tokens[self.at]
            if kind == "str" or kind == "num" or text in ("TRUE", "FALSE"):
                self.at += 1
                return text[1:-1] if kind == "str" else text == "TRUE" if kind == "key" else float(text) if "." in text else int(text)
        raise PipelineError(f"filter: a literal is expected {self.where()}")

    def one(self) -> Column:
        if self.peek("("):
            self.at += 1
            out = self.any_of()
            self.take(")")
            return out
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "word":
            raise PipelineError(f"filter: a column is expected {self.where()}")
        column = _quoted(_column(self.tokens[self.at][1], self.schema, exact=True).name)
        self.at += 1
        if self.peek("IS"):
            self.at += 1
            negated = self.peek("NOT")
            self.at += negated
            self.take("NULL")
            return column.isNotNull() if negated else column.isNull()
        if self.peek("IN"):
            self.at += 1
            self.take("(")
            values = [self.value()]
            while self.peek(","):
                self.at += 1
                values.append(self.value())
            self.take(")")
            return column.isin(values)
        op = self.take("=", "!=", "<>", "<", "<=", ">", ">=")
        return compare(column, OPERATORS[op], self.value())


def from_text(text: str, schema: T.StructType) -> Column:
    """``a = 1 AND (b IN ('x', 'y') OR c IS NOT NULL)``; names are case-sensitive."""
    parser = _Parser(text, schema)
    out = parser.any_of()
    if parser.at != len(parser.tokens):
        raise PipelineError(f"filter: nothing may follow {parser.where()}")
    return out
