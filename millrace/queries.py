"""Queries over the driver's tables: each uses the engine's own operators, most through a pipeline file."""

from __future__ import annotations

import contextlib
import glob
import json
import os
import re
import shutil
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.errors import CapabilityError
from millrace.functions import aggregates, cells, codecs, predicates, sampling
from millrace.functions.types import parse_fields
from millrace.operators.transforms import dead_letter_schema
from millrace.plans.pipeline import Pipeline
from millrace.sources import tables
from millrace.sources.services import read_partitions
from millrace.sources.streams import change_events, kafka_columns
from millrace.streaming.windows import WindowSpec, count_windows
from millrace.workspace import new_path

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_oracles: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        _queries[f.__name__] = f
        if sql:
            _oracles[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The output of a pipeline whose ``${SF}`` is the tables' folder."""
    return Pipeline.from_yaml(text, {"SF": sf_dir}).output(spark)


def chain(source: str, *steps: str) -> str:
    """A chain that reads one table; steps are YAML flow mappings."""
    lines = [f"    - {{type: ReadFromSpark, name: Table, config: {{format: parquet, path: '${{SF}}/{source}.parquet'}}}}", *(f"    - {s}" for s in steps)]
    return "pipeline:\n  type: chain\n  transforms:\n" + "\n".join(lines)


# Transforms


@query("SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'a', CAST(1.0 AS DOUBLE), NULL::VARCHAR), (2, 'b', 2.5, 'x'), (3, NULL, 3.0, NULL)) t(id, name, score, note)")
def create_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, "pipeline: {type: composite, output: C, transforms: [{type: Create, name: C, config: {elements: [{id: 1, name: a, score: 1}, {id: 2, name: b, score: 2.5, note: x}, {id: 3, name: null, score: 3}]}}]}")


@query("SELECT o_orderkey AS order_id, o_totalprice AS amount FROM orders")
def map_select_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, chain("orders", "{type: MapToFields, config: {fields: {order_id: o_orderkey, amount: o_totalprice}}}"))


@query("SELECT n_nationkey, n_regionkey AS n_name, n_regionkey, n_name AS label FROM nation")
def map_append_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, chain("nation", "{type: MapToFields, config: {append: true, fields: {n_name: n_regionkey, label: n_name}}}"))


@query("SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment, c_name AS who FROM customer")
def map_append_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, chain("customer", "{type: MapToFields, config: {append: true, drop: [c_name], fields: {who: c_name}}}"))


@query("SELECT *, 'batch' AS origin, CAST(7 AS BIGINT) AS run_no, true AS ok, 0.5::DOUBLE AS weight FROM region")
def add_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, chain("region", "{type: AddFields, config: {fields: {origin: batch, run_no: 7, ok: true, weight: 0.5}}}"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def filter_equals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, chain("orders", "{type: Filter, config: {field: o_orderstatus, value: F}}", "{type: MapToFields, config: {fields: {o_orderkey: o_orderkey, o_orderstatus: o_orderstatus}}}"))


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('purchase', 'signup')")
def filter_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, chain("events", "{type: Filter, config: {field: event_type, operator: in, values: [purchase, signup]}}", "{type: MapToFields, config: {fields: {event_id: event_id, event_type: event_type}}}"))


def _nulled(spark: SparkSession, sf_dir: str) -> str:
    """Orders whose status O is null, as a table of its own."""
    path = new_path(spark, "nulled")
    table(spark, sf_dir, "orders").select("o_orderkey", F.expr("nullif(o_orderstatus, 'O')").alias("status")).write.parquet(path)
    return path


def _on(path: str, *steps: str) -> str:
    return "pipeline:\n  type: chain\n  transforms:\n" + "\n".join([f"    - {{type: ReadFromSpark, config: {{format: parquet, path: '{path}'}}}}", *(f"    - {s}" for s in steps)])


@query("SELECT o_orderkey, nullif(o_orderstatus, 'O') AS status FROM orders WHERE nullif(o_orderstatus, 'O') IS DISTINCT FROM 'F'")
def filter_not_equals_keeps_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, _on(_nulled(spark, sf_dir), "{type: Filter, config: {field: status, operator: not_equals, value: F}}"))


@query("SELECT o_orderkey, nullif(o_orderstatus, 'O') AS status FROM orders WHERE nullif(o_orderstatus, 'O') IS NULL")
def filter_is_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, _on(_nulled(spark, sf_dir), "{type: Filter, config: {field: status, operator: is_null}}"))


@query("SELECT o_orderkey, nullif(o_orderstatus, 'O') AS status FROM orders WHERE nullif(o_orderstatus, 'O') IS NOT NULL")
def filter_is_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, _on(_nulled(spark, sf_dir), "{type: Filter, config: {field: status, operator: is_not_null}}"))


@query("SELECT vec_id, unnest(embedding) AS embedding, label FROM embeddings")
def explode_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, chain("embeddings", "{type: Explode, config: {field: embedding}}"))


@query("SELECT vec_id, label, x FROM (SELECT *, unnest(embedding) AS x FROM embeddings)")
def explode_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, chain("embeddings", "{type: Explode, config: {field: embedding, output_field: x}}", "{type: MapToFields, config: {fields: {vec_id: vec_id, label: label, x: x}}}"))


@query("SELECT event_id, props, CAST(json_extract(props, '$.k') AS BIGINT) AS k, NULL::VARCHAR AS missing FROM events")
def json_to_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, chain("events", "{type: MapToFields, config: {fields: {event_id: event_id, props: props}}}", "{type: JsonToFields, config: {field: props, fields: ['k:long', 'missing:string']}}"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events")
def json_drop_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, chain("events", "{type: MapToFields, config: {fields: {event_id: event_id, props: props}}}", "{type: JsonToFields, config: {field: props, fields: ['k:double'], drop_input: true}}"))


@query("SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'O'), 'open') AS status FROM orders")
def fill_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, _on(_nulled(spark, sf_dir), "{type: FillNulls, config: {fields: {status: open}}}"))


FLATTEN = """
pipeline:
  transforms:
    - {type: ReadFromSpark, name: Orders, config: {format: parquet, path: '${SF}/orders.parquet'}}
    - {type: Filter, name: Done, input: Orders, config: {field: o_orderstatus, value: F}}
    - {type: Filter, name: Open, input: Orders, config: {field: o_orderstatus, value: O}}
    - {type: Flatten, name: Both, input: [Done, Open]}
    - {type: MapToFields, name: Keys, input: Both, config: {fields: {k: o_orderkey, s: o_orderstatus}}}
  output: Keys
"""


@query("SELECT n_nationkey AS k FROM nation UNION ALL SELECT n_nationkey FROM nation")
def flatten_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(
        spark,
        sf_dir,
        "pipeline:\n  transforms:\n    - {type: ReadFromSpark, name: N, config: {format: parquet, path: '${SF}/nation.parquet'}}\n    - {type: MapToFields, name: K, input: N, config: {fields: {k: n_nationkey}}}\n    - {type: Flatten, name: F, input: [K, K]}\n  output: F\n",
    )


@query("SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderstatus IN ('F', 'O')")
def flatten_branch_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, FLATTEN)


@query("SELECT c_custkey, c_name FROM customer")
def strip_error_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.operators.transforms import StripErrorMetadata
    from millrace.plans.registry import Context, Data

    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    letters = rows.select(F.struct("c_custkey", "c_name").alias("element"), F.lit("E").alias("error_type"), F.lit(None).cast("string").alias("error_message"), F.lit("t").alias("transform"))
    with_null = letters.union(spark.createDataFrame([(None, "E", None, "t")], "element struct<c_custkey:bigint,c_name:string>, error_type string, error_message string, transform string"))
    return StripErrorMetadata(StripErrorMetadata.Config()).apply(Data(with_null, dead_letter_schema(rows.schema)), Context(spark, "strip")).df


@query("SELECT c_custkey, c_name, true AS rejected FROM customer WHERE c_acctbal < 0 UNION ALL SELECT c_custkey, c_name, false FROM customer WHERE c_acctbal >= 0")
def dead_letter_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A write that rejects negative balances: rejects come back through the dead letters."""
    from millrace.sinks.writer import Policy, run_writer

    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    path = new_path(spark, "letters")
    run_writer(rows, _Picky, None, Policy(100, "row"), lambda r: r, "Picky").write.parquet(path)  # the one action
    failed = spark.read.parquet(path).select("element.*")
    written = rows.join(failed.select("c_custkey"), "c_custkey", "left_anti")
    return failed.select("c_custkey", "c_name", F.lit(True).alias("rejected")).union(written.select("c_custkey", "c_name", F.lit(False)))


class _Picky:
    """A client that fails a whole batch if one row of it is negative."""

    def __init__(self, config: None):
        pass

    def write(self, rows: list[dict]) -> None:
        if any(r["c_acctbal"] < 0 for r in rows):
            raise ValueError("negative")


NESTED = """
pipeline:
  type: composite
  transforms:
    - {type: ReadFromSpark, name: Lines, config: {format: parquet, path: '${SF}/lineitem.parquet'}}
    - type: chain
      name: Narrow
      input: Lines
      transforms:
        - {type: Filter, config: {field: l_returnflag, value: R}}
        - type: composite
          name: Inner
          transforms:
            - {type: MapToFields, name: Pick, input: input, config: {fields: {k: l_orderkey, n: l_linenumber, flag: l_returnflag}}}
            - {type: AddFields, name: Mark, input: Pick, config: {fields: {src: nested}}}
          output: Mark
  output: Narrow
"""


@query("SELECT l_orderkey AS k, l_linenumber AS n, l_returnflag AS flag, 'nested' AS src FROM lineitem WHERE l_returnflag = 'R'")
def nested_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, NESTED)


@query("SELECT s_suppkey AS id, s_name AS name, 'supplier' AS kind FROM supplier WHERE s_nationkey = 3")
def chain_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, chain("supplier", "{type: Filter, config: {field: s_nationkey, value: 3}}", "{type: MapToFields, config: {fields: {id: s_suppkey, name: s_name}}}", "{type: AddFields, config: {fields: {kind: supplier}}}"))


FLAGSHIP = """
pipeline:
  type: chain
  source: {type: ReadFromSpark, config: {format: parquet, path: '${SF}/events.parquet'}}
  transforms:
    - {type: Filter, config: {field: event_type, operator: in, values: [purchase, signup]}}
    - {type: JsonToFields, config: {field: props, fields: ['k:long'], drop_input: true}}
    - {type: AddFields, config: {fields: {source: events}}}
    - {type: MapToFields, config: {fields: {id: event_id, user: user_id, kind: event_type, amount: value, k: k, source: source}}}
"""


@query("SELECT event_id AS id, user_id AS user, event_type AS kind, value AS amount, CAST(json_extract(props, '$.k') AS BIGINT) AS k, 'events' AS source FROM events WHERE event_type IN ('purchase', 'signup')")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, FLAGSHIP)


# Push-down


@query("SELECT l_orderkey, l_quantity, l_shipmode FROM (SELECT *, l_linestatus AS l_shipmode FROM lineitem) WHERE l_quantity >= 10 AND l_quantity < 20.5 AND l_linestatus <> 'O' AND l_partkey IS NOT NULL")
def pred_hive_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = {"columns": ["l_orderkey", "L_QUANTITY", "l_linestatus"], "predicates": [{"column": "l_quantity", "op": ">=", "value": 10}, {"column": "L_Quantity", "op": "lt", "value": "20.5"}, {"column": "l_linestatus", "op": "<>", "value": "O"}, {"column": "l_partkey", "op": "is not null"}]}
    text = json.dumps({"pipeline": {"type": "chain", "transforms": [{"type": "ReadFromHive", "config": {"path": f"{sf_dir}/lineitem.parquet", **config}}]}})
    found = run(spark, sf_dir, text)
    return found.withColumnRenamed("l_linestatus", "l_shipmode")


def _filtered(spark: SparkSession, sf_dir: str, name: str, text: str, *columns: str) -> DataFrame:
    df = table(spark, sf_dir, name)
    return df.where(predicates.from_text(text, df.schema)).select(*columns)


@query("SELECT p_partkey, p_size FROM part WHERE p_size > 10 AND (p_brand = 'Brand#11' OR p_retailprice <= 1000.5) AND p_size <> 20")
def pred_text_and_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, "part", "p_size > 10 AND (p_brand = 'Brand#11' or p_retailprice <= 1000.5) AND p_size <> 20", "p_partkey", "p_size")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal > -100")
def pred_text_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, "customer", "c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal > -100", "c_custkey", "c_acctbal")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, nullif(o_orderstatus, 'O') AS status FROM orders) WHERE status <> 'F' OR status IS NULL AND o_orderkey < 1000")
def pred_null_semantics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(_nulled(spark, sf_dir))
    return df.where(predicates.from_text("status <> 'F' OR status IS NULL AND o_orderkey < 1000", df.schema)).select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem")
def proj_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.apply_lake(table(spark, sf_dir, "lineitem"), tables.LakeOptions(columns=["l_linenumber", "L_ORDERKEY"]))


@query("SELECT CAST(17 AS BIGINT) AS n")
def limit_rowcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.apply_lake(table(spark, sf_dir, "orders"), tables.LakeOptions(limit=17)).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS count, count(o_custkey) AS count_o_custkey, min(o_totalprice) AS min_o_totalprice, max(o_orderkey) AS max_o_orderkey FROM orders")
def agg_count_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.aggregate(table(spark, sf_dir, "orders"), ["count", "count:o_custkey", "min:o_totalprice", "max:o_orderkey"])


@query("SELECT CAST(sum(s) AS DOUBLE) AS sum_p_size, avg(s) AS avg_p_size FROM (SELECT p_size AS s FROM part)")
def agg_sum_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.aggregate(table(spark, sf_dir, "part"), ["sum:p_size", "avg:p_size"], "lake")


@query("SELECT count(*) AS n, CAST(min(l_linenumber) AS DOUBLE) AS low, CAST(sum(l_linenumber) AS DOUBLE) AS total FROM lineitem WHERE l_quantity > 30")
def agg_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    specs = [{"type": "count", "as": "n"}, {"type": "min", "column": "l_linenumber", "as": "low"}, {"type": "sum", "column": "l_linenumber", "as": "total"}]
    return aggregates.aggregate(df.where(predicates.from_text("l_quantity > 30", df.schema)), specs, "document")


@query("SELECT count(*) AS count, CAST(NULL AS DOUBLE) AS sum_x, CAST(NULL AS DOUBLE) AS avg_x, CAST(NULL AS INTEGER) AS max_x FROM nation")
def agg_all_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "nation").select(F.lit(None).cast("int").alias("x"))
    return aggregates.aggregate(df, ["count", "sum:x", "avg:x", "max:x"], "lake")


@query("SELECT count(*) AS count, min(n_name) AS min_n_name, CAST(sum(n_nationkey) AS DOUBLE) AS sum_n_nationkey FROM nation WHERE n_nationkey < 0")
def agg_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.aggregate(table(spark, sf_dir, "nation").where("n_nationkey < 0"), ["count", "min:n_name", "sum:n_nationkey"], "lake")


@query("SELECT min(n_name) AS min_n_name, max(n_name) AS max_n_name FROM nation")
def agg_min_max_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.aggregate(table(spark, sf_dir, "nation"), ["min:n_name", "max:n_name"], "columnar")


@query("SELECT CAST(0 AS BIGINT) AS sum_x, CAST(sum(n_nationkey) AS BIGINT) AS sum_n_nationkey FROM nation")
def agg_sum_zero_dialect(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "nation").select("n_nationkey", F.lit(None).cast("int").alias("x"))
    return aggregates.aggregate(df, ["sum:x", "sum:n_nationkey"], "columnar")


@query()
def sample_bernoulli(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.bernoulli(table(spark, sf_dir, "lineitem"), 0.1, 7).select("l_orderkey", "l_linenumber")


@query()
def sample_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.blocks(table(spark, sf_dir, "lineitem"), 0.5, 7).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus = 'P'")
def partition_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "partitioned")
    table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus").write.partitionBy("o_orderstatus").parquet(path)
    return tables.partition_filter(spark.read.parquet(path), ["o_orderstatus=P"], "")


# Sources and sinks


def _database(spark: SparkSession, tables: dict[str, tuple[str, DataFrame]]) -> str:
    """The URL of a Derby database with these tables (columns in SQL, and rows), which every process can read.

    An embedded database that can be written belongs to one process, so the
    driver fills it, in bulk from files that the executors write.  Packed as an
    archive in the shared folder it is read-only, and any number of executors
    read it at once.
    """
    path = new_path(spark, "database")
    scheme, _, place = path.rpartition(":")
    if scheme not in ("", "file"):
        raise CapabilityError("the database must lie in a folder that is mounted where the executors run")
    place = re.sub("^/+", "/", place)
    manager = spark.sparkContext._jvm.java.sql.DriverManager
    connection = manager.getConnection(f"jdbc:derby:{place}/db;create=true")
    try:
        statement = connection.createStatement()
        for name, (columns, rows) in tables.items():
            statement.execute(f"CREATE TABLE {name} ({columns})")
            quoted = [F.coalesce(F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('""')), F.lit('"')), F.lit("")) for c in rows.columns]  # nulls are not quoted
            rows.select(F.concat_ws(",", *quoted)).write.text(f"{path}/{name}")
            for part in sorted(glob.glob(f"{glob.escape(place)}/{name}/part-*")):
                statement.execute(f"CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, '{name}', '{part}', NULL, NULL, 'UTF-8', 0)")
            shutil.rmtree(f"{place}/{name}")
    finally:
        connection.close()
        with contextlib.suppress(Exception):  # Derby tells by an exception that it has shut down
            manager.getConnection(f"jdbc:derby:{place}/db;shutdown=true")
    with zipfile.ZipFile(f"{place}/db.jar", "w") as packed:  # stored, so that pages are found by their place
        for folder, _, names in os.walk(f"{place}/db"):
            for name in names:
                if not name.endswith(".lck"):
                    packed.write(f"{folder}/{name}", os.path.relpath(f"{folder}/{name}", place))
    shutil.rmtree(f"{place}/db")
    return f"jdbc:derby:jar:({place}/db.jar)db"


@query("SELECT CAST(k AS BIGINT) AS k, s FROM (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders UNION ALL SELECT NULL, 'none')")
def jdbc_range_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written to and read from a database in ranges of a column, with a chunk for nulls."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("K"), F.col("o_orderstatus").alias("S"))
    url = _database(spark, {"T": ("K BIGINT, S VARCHAR(8)", rows.union(spark.createDataFrame([(None, "none")], rows.schema)))})
    text = f"pipeline: {{type: composite, output: R, transforms: [{{type: ReadFromJdbc, name: R, config: {{url: '{url}', tables: [T], partition_column: K, partition_num: 3}}}}]}}"
    return run(spark, sf_dir, text).select(F.col("K").alias("k"), F.col("S").alias("s"))


@query("SELECT n_nationkey AS k, n_name AS name FROM nation")
def table_range_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("K"), F.col("n_name").alias("NAME"))
    parts = {f"T_{i:02d}": ("K INTEGER, NAME VARCHAR(64)", rows.where(F.coalesce(F.pmod("K", F.lit(4)), F.lit(0)) == i)) for i in range(4)}
    url = _database(spark, parts)
    text = f"pipeline: {{type: composite, output: R, transforms: [{{type: ReadFromJdbc, name: R, config: {{url: '{url}', tables: ['T_${{00-03}}']}}}}]}}"
    return run(spark, sf_dir, text).select(F.col("K").alias("k"), F.col("NAME").alias("name"))


def _through_files(spark: SparkSession, sf_dir: str, source: str, fields: str, form: str, config: str) -> DataFrame:
    """Writes columns of a table with the file sink, and reads them back with the file source."""
    path = new_path(spark, "files")
    wanted = fields or "'content:STRING'"
    names = [f.strip(" '").partition(":")[0] for f in wanted.split(",")]
    mapping = ", ".join(f"{n}: {n if fields else 'text'}" for n in names)
    schema = f", schema_fields: [{fields}]" if fields else ""
    write = chain(source, f"{{type: MapToFields, config: {{fields: {{{mapping}}}}}}}", f"{{type: WriteToFilesystem, config: {{path: '{path}', file_format: {form}{schema}{config}}}}}")
    Pipeline.from_yaml(write, {"SF": sf_dir}).run(spark)
    return run(spark, sf_dir, f"pipeline: {{type: composite, output: R, transforms: [{{type: ReadFromFilesystem, name: R, config: {{path: '{path}/output-*', file_format: {form}{schema}{config}}}}}]}}")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through_files(spark, sf_dir, "customer", "'c_custkey:long', 'c_name:string', 'c_acctbal:double'", "csv", ", header: true")


@query("SELECT page_id, url, html FROM pages")
def csv_awkward_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through_files(spark, sf_dir, "pages", "'page_id:long', 'url:string', 'html:string'", "csv", ", csv_delimiter: ';'")


@query("SELECT line AS content FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM benchmark)")
def text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through_files(spark, sf_dir, "benchmark", "", "text", "")


@query("SELECT o_orderkey AS k, o_totalprice AS v, o_orderstatus AS s FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT o_orderkey, 0.0, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def dyn_partition_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two writes: the second replaces only the partition that it has rows for."""
    path = new_path(spark, "overwritten")
    write = "{type: WriteToHive, config: {path: '" + path + "', partition_by: [s], write_mode: overwrite}}"
    columns = "{type: MapToFields, config: {fields: {k: o_orderkey, v: o_totalprice, s: o_orderstatus}}}"
    Pipeline.from_yaml(chain("orders", columns, write), {"SF": sf_dir}).run(spark)
    again = new_path(spark, "again")
    table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"), F.lit(0.0).alias("v"), F.col("o_orderstatus").alias("s")).write.parquet(again)
    Pipeline.from_yaml(_on(again, write)).run(spark)
    return spark.read.parquet(path).select("k", "v", "s")


@query("SELECT CAST(n_nationkey AS BIGINT) AS id, [n_name, CAST(n_regionkey AS VARCHAR)] AS tags FROM nation")
def delimited_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with nested delimiters, by the lenient rules."""
    path = new_path(spark, "delimited")
    table(spark, sf_dir, "nation").select(F.concat(F.col("n_nationkey").cast("string"), F.lit("\x01"), F.col("n_name"), F.lit("\x02"), F.col("n_regionkey").cast("string"), F.lit("\x01left out"))).write.text(path)
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("id", cells.hive_type("bigint")), T.StructField("tags", cells.hive_type("array<varchar(20)>"))])
    return spark.read.text(path).select(*cells.delimited(F.col("value"), schema))


# Change data, windows, codecs


@query("SELECT event_id AS id, event_type AS name FROM events WHERE event_type <> 'view'")
def cdc_envelope_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change envelopes of a table, without deletions, down to the new row's fields."""
    path = new_path(spark, "changes")
    rows = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "view", "d").otherwise("c")
    after = F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("name"))
    payload = F.struct(op.alias("op"), F.when(op == "c", after).alias("after"), F.lit(1).alias("ts_ms"))
    rows.select(F.to_json(F.struct(payload.alias("payload")))).write.text(path)
    text = f"pipeline: {{type: chain, transforms: [{{type: ReadFromDebezium, config: {{path: '{path}', follow: false}}}}, {{type: Filter, config: {{field: op, operator: in, values: [c, r, u]}}}}, {{type: JsonToFields, config: {{field: after, fields: ['id:long', 'name:string'], drop_input: true}}}}, {{type: MapToFields, config: {{fields: {{id: id, name: name}}}}}}]}}"
    return run(spark, sf_dir, text)


def _windows(spark: SparkSession, sf_dir: str, name: str, time: str, config: dict) -> DataFrame:
    found = count_windows(table(spark, sf_dir, name), time, WindowSpec.parse(config))
    return found.select(F.unix_seconds("start").alias("start_s"), F.unix_seconds("end").alias("end_s"), "n")


@query("SELECT CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS start_s, CAST(floor(epoch(ts) / 3600) * 3600 + 3600 AS BIGINT) AS end_s, count(*) AS n FROM events GROUP BY 1, 2")
def window_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir, "events", "ts", {"type": "fixed", "size": "1h"})


@query("SELECT CAST(floor(epoch(ts) / 3600) * 3600 - 3600 * i AS BIGINT) AS start_s, CAST(floor(epoch(ts) / 3600) * 3600 - 3600 * i + 10800 AS BIGINT) AS end_s, count(*) AS n FROM events, generate_series(0, 2) g(i) GROUP BY 1, 2")
def window_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir, "events", "ts", {"type": "sliding", "size": "3h", "period": "1h"})


@query(
    "SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start_s, CAST(floor(epoch(max(ts)) + 86400) AS BIGINT) AS end_s, count(*) AS n FROM (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 86400 THEN 0 ELSE 1 END AS b FROM events)) GROUP BY user_id, s"
)
def window_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = count_windows(table(spark, sf_dir, "events"), "ts", WindowSpec.parse({"type": "sessions", "gap": "1d"}), ["user_id"])
    return found.select("user_id", F.unix_seconds("start").alias("start_s"), F.unix_seconds("end").alias("end_s"), "n")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS value, 'last' AS header FROM nation")
def kafka_header_lastwins(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = lambda k, v: F.struct(F.lit(k).alias("key"), F.encode(F.lit(v), "utf-8").alias("value"))
    raw = table(spark, sf_dir, "nation").select(
        F.encode(F.col("n_nationkey").cast("string"), "utf-8").alias("key"), F.encode("n_name", "utf-8").alias("value"), F.lit("t").alias("topic"), F.lit(0).alias("partition"),
        F.col("n_nationkey").cast("long").alias("offset"), F.timestamp_millis(F.lit(0)).alias("timestamp"), F.lit(0).alias("timestampType"), F.array(h("a", "first"), h("b", "x"), h("a", "last")).alias("headers"),
    )
    return kafka_columns(raw, "string", "string").select("key", "value", F.decode(F.col("headers")["a"], "utf-8").alias("header"))


def _coded(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    from pyspark.sql import types as T

    return read_partitions(spark, [{"rows": rows}], T._parse_datatype_string(schema), _Given, None, lambda client, p: client.read(p))


class _Given:
    def __init__(self, config: None):
        pass

    def read(self, partition: dict):
        return iter(partition["rows"])


@query("SELECT * FROM (VALUES ('1', CAST(1.5 AS DOUBLE), true, 'x'), ('2', NULL, NULL, NULL)) t(id, n, ok, m)")
def dynamo_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = [{"id": {"S": "1"}, "n": {"N": "1.5"}, "ok": {"BOOL": True}, "m": {"M": {"k": {"S": "x"}}}}, {"id": {"S": "2"}, "n": {"NULL": True}}]
    schema = codecs.dynamo_schema(items)
    rows = [{f.name: codecs.dynamo_value(i.get(f.name), f.dataType) for f in schema} for i in items]
    found = _coded(spark, rows, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema))
    return found.select("id", F.col("n").cast("double").alias("n"), "ok", F.col("m")["k"].alias("m"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS rowkey, n_name AS name, n_regionkey AS region FROM nation")
def hbase_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as big-endian cells and back."""
    columns = codecs.hbase_columns(["name:STRING", "region:INT32"], "cf")

    def through(batches):
        for b in batches:
            for k in ("n_name", "n_regionkey"):
                kind = next(t for _, q, t in columns if q == {"n_name": "name", "n_regionkey": "region"}[k])
                cast = str if k == "n_name" else int
                b[k] = [codecs.cell_decode(codecs.cell_encode(cast(v), kind), kind) for v in b[k]]
            yield b

    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("rowkey"), "n_name", "n_regionkey")
    return rows.mapInPandas(through, rows.schema).toDF("rowkey", "name", "region")


@query("SELECT * FROM (VALUES ('up', 'a', CAST(1 AS DOUBLE), CAST(1700000000.5 AS DOUBLE)), ('', 'b', 0.25, 1700000000.5)) t(metric_name, job, value, seen_at)")
def prom_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = {"status": "success", "data": {"resultType": "vector", "result": [{"metric": {"__name__": "up", "job": "a"}, "value": [1700000000.5, "1"]}, {"metric": {"job": "b"}, "value": [1700000000.5, "0.25"]}]}}
    found = _coded(spark, codecs.prometheus_rows(answer), "metric_name string, labels map<string,string>, value double, timestamp double")
    return found.select("metric_name", F.col("labels")["job"].alias("job"), "value", F.col("timestamp").alias("seen_at"))


@query("SELECT CAST(event_id AS VARCHAR) AS id, value AS v, user_id AS u FROM events")
def document_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a client in ranges of ids, by declared fields."""
    schema = parse_fields(["id:STRING", "v:DOUBLE", "u:INT64"], codecs.DOCUMENT_TYPES)
    rows = table(spark, sf_dir, "events").select("event_id", "value", "user_id")

    def decode(batches):
        import pandas as pd

        for b in batches:
            documents = ({"id": int(i), "v": float(v), "u": float(u)} for i, v, u in zip(b["event_id"], b["value"], b["user_id"], strict=True))
            yield pd.DataFrame(list(codecs.rows_of(documents, schema)), columns=schema.names)

    return rows.mapInPandas(decode, schema)


@query("SELECT CAST(n_nationkey AS BIGINT) AS ts_ms, 'u' AS op, n_name AS name FROM nation")
def change_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation")
    value = F.to_json(F.struct(F.lit("u").alias("op"), F.struct(F.col("n_name").alias("name")).alias("after"), F.col("n_nationkey").alias("ts_ms")))
    found = change_events(rows.select(value.alias("value")).union(spark.createDataFrame([("{}",), (None,), ("null",)], "value string")))
    return found.select("ts_ms", "op", F.get_json_object("after", "$.name").alias("name"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)
