import json
import logging

import pytest

from millrace.errors import AssertionFailed, PipelineError
from millrace.plans import registry
from millrace.plans.pipeline import Pipeline, main
from millrace.plans.spec import PipelineSpec, merge_options, parse_text, substitute

CREATE = "{type: Create, name: C, config: {elements: [{id: 1, op: c}, {id: 2, op: u}, {id: 3, op: d}]}}"


def rows(spark, text):
    return sorted(tuple(r) for r in Pipeline.from_yaml(text).output(spark).collect())


def chain(*steps):
    return "pipeline:\n  type: chain\n  transforms:\n" + "".join(f"    - {s}\n" for s in (CREATE, *steps))


def test_yaml_has_json_scalars():
    assert parse_text("{a: no, b: on, c: 012, d: 2024-01-01, e: 1e3, f: true, g: ~, h: 1_000, i: -3}") == {"a": "no", "b": "on", "c": "012", "d": "2024-01-01", "e": 1000.0, "f": True, "g": None, "h": "1_000", "i": -3}
    with pytest.raises(PipelineError, match="twice"):
        parse_text("{a: 1, a: 2}")


def test_variables(monkeypatch):
    monkeypatch.setenv("FROM_ENV", "e")
    assert substitute("${X} ${FROM_ENV} ${Y:-d} ${Z:-} t_${00-15}", {"X": "x"}) == "x e d  t_${00-15}"
    with pytest.raises(PipelineError, match="NOT_SET"):
        substitute("${NOT_SET}")


@pytest.mark.parametrize(
    "text, match",
    [
        ("pipeline: {type: Create}\nformat_version: 2", "format_version"),
        ("pipeline: {type: Create, nope: 1}", "unknown keys"),
        ("other: 1", "must have a pipeline"),
        ("pipeline: {type: chain, transforms: []}", "needs transforms"),
        ("pipeline: {type: chain, transforms: [{type: A}, {type: B, input: X}]}", "only the first"),
        ("pipeline: {transforms: [{type: A, name: a.b}]}", "dot"),
        ("pipeline: {type: composite, source: {type: A}, transforms: []}", "chain"),
        ("pipeline: {type: Create}\nexecution: {mode: fast}", "mode"),
        ("pipeline: {type: Create, transforms: [{type: A}]}", "holds no transforms"),
    ],
)
def test_specs_that_are_not_valid(text, match):
    with pytest.raises(PipelineError, match=match):
        PipelineSpec.parse(text)


def test_options_merge():
    assert merge_options({"a": [1, 2], "b": True, "c": "file"}, {"c": "cli"}) == {"a": "1,2", "b": "true", "c": "cli"}


def test_filter_chain(spark):
    assert rows(spark, chain("{type: Filter, config: {field: id, operator: in, values: [1, 3]}}", "{type: Filter, config: {field: op, operator: not_equals, value: d}}")) == [(1, "c")]


def test_branches_scopes_and_extra(spark):
    text = f"""
pipeline:
  transforms:
    - {CREATE}
    - {{type: Filter, name: A, input: C, config: {{field: op, value: c}}}}
    - type: chain
      name: B
      input: C
      transforms:
        - {{type: Filter, config: {{field: op, value: d}}}}
        - {{type: MapToFields, config: {{append: true, fields: {{id: id}}}}}}
    - {{type: Flatten, name: U, input: [A, B]}}
  extra_transforms:
    - {{type: AddFields, name: X, input: U, config: {{fields: {{x: 1}}}}}}
  output: {{output: U, more: X}}
"""
    built = Pipeline.from_yaml(text).build(spark)
    assert sorted(map(tuple, built["output"].collect())) == [(1, "c"), (3, "d")]
    assert sorted(map(tuple, built["more"].collect())) == [(1, "c", 1), (3, "d", 1)]


@pytest.mark.parametrize(
    "text, match",
    [
        ("pipeline: {transforms: [{type: Filter, name: A, input: B, config: {field: x, value: 1}}, {type: Filter, name: B, input: A, config: {field: x, value: 1}}]}", "A -> B -> A"),
        (f"pipeline: {{transforms: [{CREATE}, {{type: Filter, input: Nope, config: {{field: id, value: 1}}}}]}}", "known here: C"),
        (f"pipeline: {{transforms: [{CREATE}, {CREATE}]}}", "given twice"),
        (f"pipeline: {{transforms: [{CREATE}, {{type: Create, name: D, input: C, config: {{elements: [{{a: 1}}]}}}}]}}", "takes no input"),
        (f"pipeline: {{transforms: [{CREATE}, {{type: Filter, config: {{field: id, value: 1}}}}]}}", "missing"),
        (f"pipeline: {{transforms: [{CREATE}, {{type: Filter, input: C.nope, config: {{field: id, value: 1}}}}]}}", "no output"),
        (f"pipeline: {{transforms: [{CREATE}, {{type: Filter, input: {{x: C}}, config: {{field: id, value: 1}}}}]}}", "missing"),
        (f"pipeline: {{transforms: [{CREATE}, {{type: Filter, input: [C, C], config: {{field: id, value: 1}}}}]}}", "more than one"),
        ("pipeline: {type: Filtr}", "near: Filter"),
        (chain("{type: Filter, config: {field: nope, value: 1}}"), "nope"),
        (chain("{type: Filter, config: {field: id, value: x}}"), "literal"),
        (chain("{type: Filter, config: {field: id, operator: is_null, value: 1}}"), "takes no value"),
        (chain("{type: Filter, config: {field: id, value: 1, config_version: 2}}"), "config_version"),
        (chain("{type: MapToFields, config: {fields: {a: id}, drop: [op]}}"), "needs append"),
        (chain("{type: MapToFields, config: {append: true, drop: [zz], fields: {}}}"), "zz"),
        (chain("{type: AddFields, config: {fields: {id: 1}}}"), "exist already"),
        (chain("{type: Explode, config: {field: op}}"), "not an array"),
        (chain("{type: FillNulls, config: {fields: {op: null}}}"), "without nulls"),
        (chain("{type: JsonToFields, config: {field: op, fields: ['id:long']}}"), "exist already"),
        (chain("{type: StripErrorMetadata}"), "no dead letters"),
        (chain("{type: Filter, config: {field: id, value: 1, error_handling: {output: bad}}}"), "no dead letters"),
        (chain("{type: WriteToFilesystem, config: {path: /tmp/x, error_handling: {output: ' '}, file_format: csv, schema_fields: ['id:long']}}"), "blank"),
        (chain("{type: WriteToFilesystem, config: {path: /tmp/x, error_handling: {output: bad, threshold: 1}, file_format: csv, schema_fields: ['id:long']}}"), "only output"),
        (chain("{type: WriteToFilesystem, config: {path: /tmp/x, error_handling: {output: bad}, file_format: csv, schema_fields: ['id:long']}}"), "nothing reads"),
        ("pipeline: {type: ReadRunnerSmokeTicker}\nexecution: {mode: batch}", "unbounded"),
        (chain("{type: WriteToJdbc, config: {url: 'jdbc:derby:memory:x', table: T}}"), "idempotency key"),
        (chain("{type: Filter, name: W, config: {field: id, value: 1}, windowing: {type: fixed}}"), "takes exactly"),
    ],
)
def test_graphs_that_are_not_valid(spark, text, match):
    text = text.replace("idempotency", "idempotency")
    if "WriteToJdbc" in text:
        text = text.replace(CREATE, "{type: ReadFromSpark, config: {format: parquet, path: /root/testdata/sf0.001/nation.parquet}}")
    with pytest.raises(PipelineError, match=match):
        Pipeline.from_yaml(text).build(spark)


def test_nested_delivery_is_checked(spark):
    text = """
pipeline:
  transforms:
    - {type: ReadFromSpark, name: R, config: {format: parquet, path: /root/testdata/sf0.001/nation.parquet}}
    - {type: chain, name: W, input: R, transforms: [{type: Filter, config: {field: n_nationkey, value: 1}}, {type: WriteToJdbc, config: {url: 'jdbc:derby:memory:x', table: T}}]}
"""
    with pytest.raises(PipelineError, match="idempotency"):
        Pipeline.from_yaml(text).build(spark)
    Pipeline.from_yaml(text.replace("table: T", "table: T, allow_duplicate_replay: true")).build(spark)


def test_flatten_needs_equal_schemas(spark):
    text = "pipeline: {transforms: [{type: Create, name: A, config: {elements: [{x: 1}]}}, {type: Create, name: B, config: {elements: [{x: 1}, {}]}}, {type: Flatten, input: [A, B]}]}"
    with pytest.raises(PipelineError, match="differ"):
        Pipeline.from_yaml(text).build(spark)


def test_explode_keeps_null_elements(spark):
    text = "pipeline: {type: chain, transforms: [{type: Create, config: {elements: [{id: 1, t: [a, null]}, {id: 2, t: []}, {id: 3, t: null}]}}, {type: Explode, config: {field: t}}]}"
    assert [tuple(r) for r in Pipeline.from_yaml(text).output(spark).collect()] == [(1, "a"), (1, None)]


JSON = "pipeline: {type: chain, transforms: [{type: Create, config: {elements: [{j: %s}]}}, {type: JsonToFields, config: {field: j, fields: [%s], drop_input: true}}]}"


@pytest.mark.parametrize(
    "value, kind, want",
    [
        ('{"v": 1.0}', "long", 1), ('{"v": 7}', "string", None), ('{"v": "7"}', "long", None), ('{"v": 1.5}', "long", None), ('{"v": 128}', "byte", None), ('{"v": "aGk="}', "bytes", b"hi"),
        ('{"v": true}', "bool", True), ('{"v": 1}', "double", 1.0), ('{"v": null}', "int", "null"), ('{}', "int", "null"), ('{"v": 1e999}', "double", None), ("[1]", "int", None), ("nope", "int", None),
        ('{"v": "?"}', "bytes", None), ('{"v": 2.5}', "float", 2.5), ('{"v": {"a": 1}}', "string", None), ("null", "int", None), ('{"v": 9007199254740993}', "long", 9007199254740993),
    ],
)
def test_json_fields_are_strict(spark, value, kind, want):
    build = lambda: Pipeline.from_yaml(JSON % (json.dumps(value), f"'v:{kind}'")).output(spark).collect()[0][0]
    if want is None:
        with pytest.raises(Exception):
            build()
    else:
        got = build()
        assert (None if want == "null" else want) == (bytes(got) if isinstance(got, bytearray) else got)


def test_assert_and_log(spark, caplog):
    ok = chain("{type: LogForTesting, config: {level: WARN, prefix: 'row '}}", "{type: AssertEqual, config: {elements: [{id: 3, op: d}, {id: 1, op: c}, {id: 2, op: u}]}}")
    with caplog.at_level(logging.WARNING, "millrace"):
        Pipeline.from_yaml(ok).run(spark)
    assert sum("row " in r.getMessage() for r in caplog.records) == 3
    with pytest.raises(AssertionFailed, match="missing"):
        Pipeline.from_yaml(chain("{type: AssertEqual, config: {elements: [{id: 9, op: x}]}}")).run(spark)
    Pipeline.from_yaml(chain("{type: AssertEqual, config: {elements: [{id: 9, op: x}]}}")).build(spark)


def test_describe_manifest_and_command(spark, tmp_path, capsys):
    text = chain("{type: Filter, name: F, config: {field: id, value: 1}}")
    described = Pipeline.from_yaml(text).describe(spark)
    assert described.splitlines() == ["C [Create] inputs() outputs(output) [stable]", "F [Filter] inputs(input) outputs(output) [stable]"]
    manifest = tmp_path / "m.json"
    Pipeline.from_yaml(text).run(spark, manifest=str(manifest))
    found = json.loads(manifest.read_text())
    assert found["phase"] == "TERMINAL" and found["state"] == "DONE" and [n["name"] for n in found["nodes"]] == ["C", "F"] and "elements" not in manifest.read_text()
    (tmp_path / "p.yaml").write_text(text)
    assert main([str(tmp_path / "p.yaml"), "--dry-run"]) == 0
    assert "F [Filter]" in capsys.readouterr().out


def test_plugins(spark):
    class Twice(registry.RowTransform):
        type = "Twice"

        def apply(self, data, ctx):
            return registry.Data(data.df.union(data.df), data.schema)

    registry.register_plugin(Twice)
    try:
        assert len(rows(spark, chain("{type: Twice}"))) == 6
        with pytest.raises(PipelineError, match="twice"):
            registry.register_plugin(Twice)
        with pytest.raises(PipelineError, match="API"):
            registry.register_plugin(Twice, 2)
    finally:
        registry._registry.pop("Twice")
