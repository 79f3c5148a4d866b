"""Pipeline files: variables, YAML with JSON's scalars, versions, and the tree of transforms."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field
from typing import Any

from millrace.errors import PipelineError

try:
    import yaml
except ModuleNotFoundError:  # then pipelines are JSON, which is YAML too
    yaml = None

_VARIABLE = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_.]*)(?::-([^}]*))?\}")


def substitute(text: str, variables: dict[str, str] | None = None) -> str:
    """``${NAME}`` and ``${NAME:-default}``: given variables, then the environment, then the default."""

    def value(m: re.Match) -> str:
        for source in (variables or {}, os.environ):
            if m[1] in source:
                return str(source[m[1]])
        if m[2] is None:
            raise PipelineError(f"variable {m[1]} is not set and has no default")
        return m[2]

    return _VARIABLE.sub(value, text)


if yaml:

    class _Loader(yaml.SafeLoader):
        """Plain scalars as JSON has them: ``no``, ``on``, ``012`` and dates are strings."""

    _Loader.yaml_implicit_resolvers = {}
    for _tag, _pattern, _first in (
        ("null", r"null|~|", "n~\0"),
        ("bool", r"true|false", "tf"),
        ("int", r"-?(?:0|[1-9][0-9]*)", "-0123456789"),
        ("float", r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?", "-0123456789"),
    ):
        _Loader.add_implicit_resolver(f"tag:yaml.org,2002:{_tag}", re.compile(f"^(?:{_pattern})$"), None if _tag == "null" else list(_first))
    _Loader.add_constructor("tag:yaml.org,2002:float", lambda loader, node: float(node.value))
    _Loader.add_constructor("tag:yaml.org,2002:int", lambda loader, node: int(node.value))

    def _mapping(loader: yaml.SafeLoader, node: yaml.MappingNode) -> dict:
        loader.flatten_mapping(node)
        out: dict[str, Any] = {}
        for k, v in node.value:
            key = str(k.value)
            if key in out:
                raise PipelineError(f"key {key!r} is given twice, line {k.start_mark.line + 1}")
            out[key] = loader.construct_object(v, deep=True)
        return out

    _Loader.add_constructor("tag:yaml.org,2002:map", _mapping)


def parse_text(text: str) -> Any:
    if yaml is None:
        try:
            return json.loads(text)
        except ValueError as e:
            raise PipelineError(f"without PyYAML a pipeline must be JSON: {e}") from None
    try:
        return yaml.load(text, _Loader)  # noqa: S506  a safe loader
    except yaml.YAMLError as e:
        raise PipelineError(f"not YAML: {e}") from None


@dataclass
class TransformSpec:
    type: str
    name: str = ""
    input: Any = None
    config: dict[str, Any] = field(default_factory=dict)
    transforms: list[TransformSpec] = field(default_factory=list)
    extra_transforms: list[TransformSpec] = field(default_factory=list)
    output: Any = None
    windowing: dict[str, Any] | None = None

    @property
    def nested(self) -> bool:
        return self.type in ("chain", "composite")

    def inputs(self) -> dict[str, list[str]]:
        """Ports and the references that feed them; the sole unnamed one is ``""``."""
        given = self.input
        if given is None:
            return {}
        given = given if isinstance(given, dict) else {"": given}
        return {port: list(map(str, v)) if isinstance(v, list) else [str(v)] for port, v in given.items()}


_NODE_KEYS = {"type", "name", "input", "config", "transforms", "extra_transforms", "source", "sink", "output", "windowing"}


def _node(raw: Any, where: str) -> TransformSpec:
    if not isinstance(raw, dict):
        raise PipelineError(f"{where} must be a mapping")
    if unknown := set(raw) - _NODE_KEYS:
        raise PipelineError(f"{where} has unknown keys: {', '.join(sorted(unknown))}")
    shorthand = [raw[k] for k in ("source", "sink") if raw.get(k) is not None]
    children = raw.get("transforms") or []
    kind = raw.get("type") or ("composite" if children or shorthand else "")
    if not kind:
        raise PipelineError(f"{where} has no type")
    if shorthand and kind != "chain":
        raise PipelineError(f"{where}: source and sink belong to a chain")
    if not isinstance(children, list) or not isinstance(raw.get("extra_transforms") or [], list):
        raise PipelineError(f"{where}: transforms must be a list")
    listed = [*([raw["source"]] if raw.get("source") is not None else []), *children, *([raw["sink"]] if raw.get("sink") is not None else [])]
    name = str(raw.get("name") or "")
    if "." in name:
        raise PipelineError(f"{where}: a name must not hold a dot: {name!r}")
    config = raw.get("config") or {}
    if not isinstance(config, dict):
        raise PipelineError(f"{where}: config must be a mapping")
    spec = TransformSpec(kind, name, raw.get("input"), config, output=raw.get("output"), windowing=raw.get("windowing"))
    spec.transforms = [_node(c, f"{name or where}[{i}]") for i, c in enumerate(listed)]
    spec.extra_transforms = [_node(c, f"{name or where}.extra[{i}]") for i, c in enumerate(raw.get("extra_transforms") or [])]
    if spec.nested:
        if not spec.transforms:
            raise PipelineError(f"{where}: a {kind} needs transforms")
        if config:
            raise PipelineError(f"{where}: a {kind} takes no config")
    elif spec.transforms or spec.extra_transforms or spec.output is not None:
        raise PipelineError(f"{where}: {kind} holds no transforms")
    if kind == "chain":
        for child in spec.transforms[1:]:
            if child.input is not None:
                raise PipelineError(f"{where}: only the first transform of a chain may name its input")
    return spec


@dataclass
class PipelineSpec:
    root: TransformSpec
    options: dict[str, Any]
    mode: str
    text: str

    @classmethod
    def parse(cls, text: str, variables: dict[str, str] | None = None) -> PipelineSpec:
        raw = parse_text(substitute(text, variables))
        if not isinstance(raw, dict) or "pipeline" not in raw:
            raise PipelineError("a file must have a pipeline")
        if unknown := set(raw) - {"pipeline", "options", "execution", "format_version"}:
            raise PipelineError(f"unknown keys: {', '.join(sorted(unknown))}")
        version = raw.get("format_version", 1)
        if version != 1 or isinstance(version, bool):
            raise PipelineError(f"format_version {version!r} is not supported; 1 is")
        execution = raw.get("execution") or {}
        if not isinstance(execution, dict) or set(execution) - {"mode"}:
            raise PipelineError("execution knows only mode")
        mode = execution.get("mode", "auto")
        if mode not in ("auto", "batch", "streaming"):
            raise PipelineError(f"execution.mode {mode!r} is not auto, batch or streaming")
        options = raw.get("options") or {}
        if not isinstance(options, dict):
            raise PipelineError("options must be a mapping")
        return cls(_node(raw["pipeline"], "pipeline"), options, mode, text)


def merge_options(file: dict[str, Any], given: dict[str, Any]) -> dict[str, str]:
    """Options of the file are defaults; lists are joined by commas."""
    return {k: ",".join(map(str, v)) if isinstance(v, list) else str(v).lower() if isinstance(v, bool) else str(v) for k, v in {**file, **given}.items()}
