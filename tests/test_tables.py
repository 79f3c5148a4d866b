import datetime as dt

import pytest
from hypothesis import given
from hypothesis import strategies as st

from millrace.errors import PipelineError
from millrace.functions import aggregates, predicates, sampling
from millrace.plans.registry import bind
from millrace.sources import tables as S


def test_expand_tables():
    assert S.expand_tables(["t_${08-11}", "u"]) == ["t_08", "t_09", "t_10", "t_11", "u"]
    for bad in (["a_${3-1}"], ["a", "a"], ["a_${0-20000}"], ["${0-1}_${0-1}"]):
        with pytest.raises(PipelineError):
            S.expand_tables(bad)


@given(st.integers(-(2**40), 2**40), st.integers(0, 2**40), st.one_of(st.none(), st.integers(1, 50)))
def test_boundaries_cover_without_overlap(low, span, partitions):
    cuts = S.boundaries(low, low + span, partitions)
    assert cuts[0] == low and cuts[-1] == low + span + 1 and cuts == sorted(set(cuts))
    sizes = [b - a for a, b in zip(cuts, cuts[1:], strict=False)]
    assert max(sizes) - min(sizes) <= 1
    assert len(sizes) == min(span + 1, 4 * (partitions or S.auto_partitions(span + 1)))


def test_auto_partitions_are_bounded():
    assert S.auto_partitions(1) == 1 and S.auto_partitions(10**6) == 100 and S.auto_partitions(10**12) == 1000


def test_chunk_predicates():
    assert S.chunk_predicates("k", None, None, True) == ["k IS NULL"]
    found = S.chunk_predicates("k", 1, 4, True, 1)
    assert found == ["k >= 1 AND k < 2", "k >= 2 AND k < 3", "k >= 3 AND k < 4", "k >= 4", "k IS NULL"]
    assert S.chunk_predicates("d", dt.date(2024, 1, 1), dt.date(2024, 1, 2), False, 1) == ["d >= DATE '2024-01-01' AND d < DATE '2024-01-02'", "d >= DATE '2024-01-02'"]
    with pytest.raises(PipelineError):
        S.chunk_predicates("x", 1.5, 2.5, False)


def test_text_predicates(spark):
    df = spark.createDataFrame([(1, "a", -1.5, True), (2, None, 2.0, False), (3, "c", None, None)], "i int, s string, d double, b boolean")
    ids = lambda text: [r.i for r in df.where(predicates.from_text(text, df.schema)).orderBy("i").collect()]
    assert ids("i = 1 OR i = 2 AND s IS NULL") == [1, 2]
    assert ids("(i = 1 OR i = 2) AND s IS NOT NULL") == [1]
    assert ids("s IN ('a', 'c') and d <= -1.5") == [1]
    assert ids("s <> 'a'") == [3]
    assert ids("b = TRUE") == [1]
    for bad in ("i =", "i = 1 AND", "nope = 1", "I = 1", "i = 1 2", "NOT i = 1", "i ? 1", "(i = 1"):
        with pytest.raises(PipelineError):
            predicates.from_text(bad, df.schema)


def test_list_predicates(spark):
    df = spark.createDataFrame([(1, "é", dt.date(2024, 1, 1)), (2, "z", None), (None, "Z", None)], "i int, s string, d date")
    ids = lambda *p: [r.s for r in df.where(predicates.from_list(list(p), df.schema)).collect()]
    assert ids({"column": "I", "op": "<>", "value": 1}) == ["z"]
    assert ids({"column": "s", "op": ">", "value": "z"}) == ["é"]
    assert ids({"column": "i", "op": "IS  NULL"}) == ["Z"]
    for bad in ({"column": "d", "op": "=", "value": "2024-01-01"}, {"column": "i", "op": "~", "value": 1}, {"column": "i", "op": "="}, {"column": "q", "op": "=", "value": 1}, {"column": "i", "op": "=", "value": "x"}, {"column": "i", "x": 1}):
        with pytest.raises(PipelineError):
            predicates.from_list([bad], df.schema)


@pytest.mark.parametrize("specs, dialect", [(["count:x"], "lake"), (["min"], "sql"), (["median:x"], "sql"), ([], "sql"), (["count", "count"], "sql"), ([{"type": "sum", "column": "x"}], "document"), ([{"type": "sum", "column": "x", "as": "y"}], "columnar")])
def test_aggregates_that_are_not_valid(specs, dialect):
    with pytest.raises(PipelineError):
        aggregates.parse(specs, dialect)


def test_document_sums_of_nulls_and_of_nothing(spark):
    spec = [{"type": "sum", "column": "x", "as": "s"}, {"type": "avg", "column": "x", "as": "a"}]
    df = spark.createDataFrame([(None,)], "x int")
    assert tuple(aggregates.aggregate(df, spec, "document").first()) == (0.0, None)
    assert tuple(aggregates.aggregate(df.where("false"), spec, "document").first()) == (None, None)


def test_samples_are_repeatable(spark, tmp_path):
    spark.range(20_000).repartition(40).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    a, b = (sampling.bernoulli(df, 0.2, 5).count() for _ in range(2))
    assert a == b and 3000 < a < 5000
    kept = sampling.blocks(df, 0.5, 3)
    assert kept.count() == sampling.blocks(df, 0.5, 3).count() and 0 < kept.count() < 20_000
    with pytest.raises(PipelineError):
        sampling.sample(df, {"fraction": 0})


@pytest.mark.parametrize(
    "config",
    [{}, {"tables": ["t"], "query": "select 1"}, {"query": "select 1", "where": "x"}, {"tables": ["t"], "limit": 0}, {"tables": ["t", "u"], "limit": 5}, {"tables": ["t"], "partition_num": 10_001}, {"tables": ["t"], "aggregations": ["count"], "columns": ["a"]}, {"tables": ["t"], "columns": ["a", "a"]}, {"tables": ["t"], "nope": 1}, {"tables": "t"}],
)
def test_jdbc_configs_that_are_not_valid(config):
    with pytest.raises(PipelineError):
        bind(S.ReadFromJdbc, {"url": "jdbc:x", **config}, "node")


def test_jdbc_aggregate_sql():
    node = bind(S.ReadFromJdbc, {"url": "jdbc:x", "tables": ["t"], "where": "a > 1", "aggregations": ["count", "max:b"]}, "node")
    assert node.aggregate_sql("t") == 'SELECT COUNT(*) AS "count", MAX(b) AS "max_b" FROM t WHERE (a > 1)'


def test_jdbc_limit_columns_and_key(spark):
    url = "jdbc:derby:memory:keys;create=true"
    jvm = spark.sparkContext._jvm
    conn = jvm.java.sql.DriverManager.getConnection(url)
    st_ = conn.createStatement()
    st_.execute("CREATE TABLE K (ID INT NOT NULL PRIMARY KEY, NAME VARCHAR(10))")
    st_.execute("INSERT INTO K VALUES (1, 'a'), (2147483647, 'b'), (5, NULL)")
    conn.close()
    read = lambda **c: bind(S.ReadFromJdbc, {"url": url, "tables": ["K"], **c}, "n").read(type("C", (), {"spark": spark})()).df
    assert sorted(r.ID for r in read().collect()) == [1, 5, 2147483647]
    assert read().rdd.getNumPartitions() > 1
    assert read(limit=2).count() == 2
    assert sorted(str(r.NAME) for r in read(columns=["NAME"], partition_column="ID", partition_num=2).collect()) == ["None", "a", "b"]
    assert read(aggregations=["count", "max:ID"]).first().asDict() == {"count": 3, "max_ID": 2147483647}


def test_clickhouse_types():
    kinds = {"Nullable(UInt8)": "smallint", "LowCardinality(Nullable(String))": "string", "UInt32": "bigint", "UInt64": "decimal(38,0)", "Array(Int32)": "array<int>", "DateTime64(3)": "timestamp", "UUID": "string"}
    assert {k: S.clickhouse_type(k).simpleString() for k in kinds} == kinds
