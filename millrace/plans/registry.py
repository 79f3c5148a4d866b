"""Transform types: their configs, ports and delivery; plugins add their own."""

from __future__ import annotations

import dataclasses
import difflib
import importlib.metadata
import types
import typing
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from millrace.errors import PipelineError

API_VERSION = 1
INPUT, OUTPUT, ERRORS, ANY = "input", "output", "errors", "*"


@dataclass
class Data:
    """Rows on an edge, with the declared schema (exact nullability)."""

    df: DataFrame
    schema: T.StructType

    @classmethod
    def of(cls, df: DataFrame) -> Data:
        return cls(df, df.schema)


@dataclass(frozen=True)
class Delivery:
    mode: str = "EXACTLY_ONCE"  # or AT_LEAST_ONCE, AT_MOST_ONCE
    replay: str = "NONE"  # FULL_REPLAY, RESUMABLE, NONE
    ordering: str = "NONE"  # GLOBAL, PER_KEY, NONE
    needs_key: bool = False


@dataclass
class Context:
    """What a transform gets besides its config and inputs."""

    spark: SparkSession
    name: str
    execute: bool = False
    streaming: bool = False
    errors_wanted: bool = False
    options: dict[str, str] = dataclasses.field(default_factory=dict)
    queries: list[Any] = dataclasses.field(default_factory=list)


class Transform:
    """Base of all transforms.  ``Config`` is a dataclass; a field without a default is required."""

    type = ""
    tier = "stable"
    inputs: tuple[str, ...] = (INPUT,)
    outputs: tuple[str, ...] = (OUTPUT,)

    @dataclass
    class Config:
        pass

    def __init__(self, config: Any):
        self.config = config
        self.check()

    def check(self) -> None:
        """Raises if the config is not valid."""

    def delivery(self) -> Delivery | None:
        return None

    def unbounded(self) -> bool:
        return False

    def build(self, inputs: dict[str, list[Data]], ctx: Context) -> dict[str, Data]:
        raise NotImplementedError


class Source(Transform):
    inputs = ()

    def build(self, inputs: dict[str, list[Data]], ctx: Context) -> dict[str, Data]:
        return {OUTPUT: self.read(ctx)}

    def read(self, ctx: Context) -> Data:
        raise NotImplementedError


class RowTransform(Transform):
    def build(self, inputs: dict[str, list[Data]], ctx: Context) -> dict[str, Data]:
        return {OUTPUT: self.apply(inputs[INPUT][0], ctx)}

    def apply(self, data: Data, ctx: Context) -> Data:
        raise NotImplementedError


class Sink(Transform):
    outputs = (ERRORS,)


_registry: dict[str, type[Transform]] = {}


def transform(cls: type[Transform]) -> type[Transform]:
    if cls.type in _registry:
        raise PipelineError(f"type {cls.type} is registered twice")
    _registry[cls.type] = cls
    return cls


def load_builtin() -> None:
    import millrace.operators.transforms
    import millrace.sinks.files
    import millrace.sinks.services
    import millrace.sinks.tables
    import millrace.sources.files
    import millrace.sources.services
    import millrace.sources.streams
    import millrace.sources.tables  # noqa: F401


def load_plugins(group: str = "millrace.transforms") -> list[str]:
    """Entry points whose module has ``API_VERSION`` and whose value is a Transform class; conflicts are errors."""
    found = []
    for point in importlib.metadata.entry_points(group=group):
        register_plugin(point.load())
        found.append(point.name)
    return found


def register_plugin(cls: type[Transform], api_version: int = API_VERSION) -> None:
    if api_version != API_VERSION:
        raise PipelineError(f"plugin {cls.type} is for API {api_version}; this is {API_VERSION}")
    if not (isinstance(cls, type) and issubclass(cls, Transform) and cls.type):
        raise PipelineError(f"plugin {cls!r} is not a named Transform")
    transform(cls)


def known() -> dict[str, type[Transform]]:
    load_builtin()
    return dict(_registry)


def lookup(name: str) -> type[Transform]:
    table = known()
    if name not in table:
        near = difflib.get_close_matches(name, table, 3, 0.5)
        raise PipelineError(f"type {name!r} is not known" + (f"; near: {', '.join(near)}" if near else ""))
    return table[name]


def _fits(value: Any, hint: Any) -> bool:
    if hint is Any:
        return True
    origin, args = typing.get_origin(hint), typing.get_args(hint)
    if origin in (typing.Union, types.UnionType):
        return any(_fits(value, a) for a in args)
    if hint is type(None):
        return value is None
    if origin is list:
        return isinstance(value, list) and all(_fits(v, args[0]) for v in value)
    if origin is dict:
        return isinstance(value, dict) and all(_fits(v, args[1]) for v in value.values())
    if hint is float:
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    if hint is int:
        return isinstance(value, int) and not isinstance(value, bool)
    return isinstance(value, hint)


def bind(cls: type[Transform], raw: dict[str, Any], where: str) -> Transform:
    """The transform of a raw config; unknown keys, missing keys and wrong types are errors."""
    raw = dict(raw)
    version = raw.pop("config_version", 1)
    if version != 1 or isinstance(version, bool):
        raise PipelineError(f"{where}: config_version {version!r} is not supported; 1 is")
    fields = {f.name: f for f in dataclasses.fields(cls.Config)}
    if unknown := set(raw) - set(fields):
        raise PipelineError(f"{where} ({cls.type}): unknown options: {', '.join(sorted(unknown))}")
    hints = typing.get_type_hints(cls.Config)
    for name, f in fields.items():
        if name not in raw:
            if f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING:
                raise PipelineError(f"{where} ({cls.type}): option {name} is required")
        elif not _fits(raw[name], hints[name]):
            raise PipelineError(f"{where} ({cls.type}): option {name} has a wrong type: {raw[name]!r}")
    try:
        return cls(cls.Config(**raw))
    except PipelineError as e:
        raise PipelineError(f"{where} ({cls.type}): {e}") from None
