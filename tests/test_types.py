import math

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import types as T

from millrace.errors import PipelineError
from millrace.functions import types as X
from millrace.functions.durations import milliseconds


def test_inference():
    s = X.infer_schema([{"a": 1, "b": 1, "c": None, "d": {"x": True}, "e": [1, None], "f": []}, {"a": 2.5, "b": 2, "d": {"x": None}, "e": [3], "f": [], "g": "t"}])
    assert s.names == ["a", "b", "c", "d", "e", "f", "g"]
    assert [f.dataType.simpleString() for f in s] == ["double", "bigint", "string", "struct<x:boolean>", "array<bigint>", "array<string>", "string"]
    assert [f.nullable for f in s] == [False, False, True, False, False, False, True]
    assert s["d"].dataType["x"].nullable and s["e"].dataType.containsNull
    with pytest.raises(PipelineError, match="mixed"):
        X.infer_schema([{"a": 1}, {"a": "x"}])


@pytest.mark.parametrize(
    "value, kind",
    [("1", T.IntegerType()), (1.5, T.LongType()), (True, T.LongType()), (128, T.ByteType()), (2**63, T.LongType()), (1, T.BooleanType()), (1, T.StringType()), (math.inf, T.DoubleType()), (1e39, T.FloatType()), ("?", T.BinaryType()), ("x", T.DateType()), ([1], T.StructType([]))],
)
def test_literals_that_do_not_fit(value, kind):
    with pytest.raises(PipelineError):
        X.convert(value, kind)


def test_literals_that_fit():
    assert X.convert(3.0, T.ByteType()) == 3
    assert X.convert("aGk=", T.BinaryType()) == b"hi"
    assert X.convert({"1": "a"}, T.MapType(T.LongType(), T.StringType())) == {1: "a"}
    assert X.convert_row({"a": [1, None]}, T.StructType([T.StructField("a", T.ArrayType(T.LongType()))])) == ([1, None],)
    assert X.convert("2024-01-02T03:04:05Z", T.TimestampType()).year == 2024
    with pytest.raises(PipelineError, match="null"):
        X.convert(None, T.LongType(), nullable=False)
    with pytest.raises(PipelineError, match="unknown"):
        X.convert_row({"z": 1}, T.StructType([]))


@given(st.integers(-(2**70), 2**70))
def test_integers_are_exact_or_an_error(n):
    for kind, bits in ((T.ByteType(), 8), (T.ShortType(), 16), (T.IntegerType(), 32), (T.LongType(), 64)):
        if -(1 << bits - 1) <= n < 1 << bits - 1:
            assert X.convert(n, kind) == n
        else:
            with pytest.raises(PipelineError):
                X.convert(n, kind)


def test_durations():
    assert [milliseconds(x) for x in ("10ms", "1.5s", 3, "2m", "0.5h", "1d")] == [10, 1500, 3000, 120_000, 1_800_000, 86_400_000]
    for bad in ("0s", "-1s", "1.5ms", "x", "1w", True):
        with pytest.raises(PipelineError):
            milliseconds(bad)
