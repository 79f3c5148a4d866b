"""Builds a pipeline's graph: scopes, references, ports, dead letters, windows, delivery."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession

from millrace.errors import PipelineError
from millrace.plans.registry import ANY, ERRORS, INPUT, OUTPUT, Context, Data, Delivery, Transform, bind, lookup
from millrace.plans.spec import PipelineSpec, TransformSpec
from millrace.streaming.windows import WindowSpec, assign_windows


@dataclass
class Node:
    path: str
    type: str
    tier: str
    delivery: Delivery | None
    upstream: list[str]
    inputs: list[str]
    outputs: list[str]

    def describe(self) -> str:
        d = self.delivery
        what = f"; {d.mode}, {d.replay}, {d.ordering}" + (", needs key" if d.needs_key else "") if d else ""
        return f"{self.path} [{self.type}] inputs({', '.join(self.inputs)}) outputs({', '.join(self.outputs)}) [{self.tier}{what}]"


@dataclass
class Ports:
    """The ports of a built node; ``main`` answers to the bare name."""

    path: str
    data: dict[str, Data]
    main: str | None
    error_port: str | None = None
    origin: dict[str, str] = field(default_factory=dict)  # path of the node that makes each port's rows


class Scope:
    def __init__(self, parent: Scope | None = None):
        self.parent, self.nodes = parent, {}

    def find(self, name: str) -> Ports | None:
        return self.nodes.get(name) or (self.parent.find(name) if self.parent else None)

    def visible(self) -> list[str]:
        return sorted({*self.nodes, *(self.parent.visible() if self.parent else [])})

    def resolve(self, reference: str, where: str) -> tuple[Ports, str]:
        name, _, port = reference.partition(".")
        ports = self.find(name)
        if ports is None:
            raise PipelineError(f"{where}: {name!r} is not known; known here: {', '.join(self.visible()) or 'nothing'}")
        port = port or ports.main or ""
        if port not in ports.data:
            raise PipelineError(f"{where}: {name!r} has no output {port or 'at all'!r}; it has: {', '.join(ports.data) or 'none'}")
        return ports, port


class Graph:
    def __init__(self, spec: PipelineSpec, spark: SparkSession, execute: bool = False, options: dict[str, str] | None = None):
        self.spec, self.spark, self.execute, self.options = spec, spark, execute, options or {}
        self.nodes: list[Node] = []
        self.pending: dict[tuple[str, str], str] = {}  # error ports that nothing has read
        self.queries: list[Any] = []
        self.streaming = self._mode()

    # modes

    def _leaves(self, spec: TransformSpec) -> list[TransformSpec]:
        return [x for c in (*spec.transforms, *spec.extra_transforms) for x in self._leaves(c)] if spec.nested else [spec]

    def _mode(self) -> bool:
        unbounded = []
        for leaf in self._leaves(self.spec.root):
            cls = lookup(leaf.type)
            if not cls.inputs and self._bind(leaf, leaf.name or leaf.type)[0].unbounded():
                unbounded.append(leaf.name or leaf.type)
        if unbounded and self.spec.mode == "batch":
            raise PipelineError(f"mode batch, but unbounded sources: {', '.join(unbounded)}")
        return self.spec.mode == "streaming" or bool(unbounded)

    # building

    def build(self) -> Ports:
        root = self._nested(self.spec.root, "", Scope(), None) if self.spec.root.nested else self._leaf(self.spec.root, "", Scope(), None, None)
        if self.pending:
            raise PipelineError("dead letters that nothing reads: " + ", ".join(f"{p}.{alias}" for (p, alias) in self.pending))
        self.check_delivery()
        return root

    def _names(self, children: list[TransformSpec], where: str) -> dict[str, TransformSpec]:
        named: dict[str, TransformSpec] = {}
        for child in children:
            name = child.name or child.type
            if not child.name:
                i = 2
                while name in named:
                    name, i = f"{child.type}_{i}", i + 1
            if name in named:
                raise PipelineError(f"{where}: the name {name!r} is given twice")
            if name == INPUT:
                raise PipelineError(f"{where}: the name {INPUT!r} is reserved")
            named[name] = child
        return named

    def _nested(self, spec: TransformSpec, path: str, outer: Scope, bound: tuple[Ports, str] | None) -> Ports:
        scope = Scope(outer)
        where = path or "pipeline"
        if bound:
            source, port = bound
            scope.nodes[INPUT] = Ports(source.path, {OUTPUT: source.data[port]}, OUTPUT, None, {OUTPUT: source.origin[port]})
        for port, references in spec.inputs().items():
            if port not in ("", INPUT) or len(references) != 1:
                raise PipelineError(f"{where}: a {spec.type} takes one input")
            found, p = outer.resolve(references[0], where)
            self.pending.pop((found.path, p), None)
            scope.nodes[INPUT] = Ports(found.path, {OUTPUT: found.data[p]}, OUTPUT, None, {OUTPUT: found.origin[p]})
        children = self._names(spec.transforms, where)
        extra = self._names(spec.extra_transforms, where)
        if both := set(children) & set(extra):
            raise PipelineError(f"{where}: names given twice: {', '.join(sorted(both))}")
        last = None
        if spec.type == "chain":
            for name, child in children.items():
                feed = None
                if child.input is None:
                    if last is not None:
                        if last.main is None:
                            raise PipelineError(f"{where}: {last.path} has no output for {name} to read")
                        feed = (last, last.main)
                    elif INPUT in scope.nodes:
                        feed = (scope.nodes[INPUT], OUTPUT)
                last = scope.nodes[name] = self._child(child, name, path, scope, feed, spec.windowing)
        else:
            for name in self._order(children, scope, where):
                last = scope.nodes[name] = self._child(children[name], name, path, scope, None, spec.windowing)
        for name in self._order(extra, scope, where):
            scope.nodes[name] = self._child(extra[name], name, path, scope, None, spec.windowing)
        return self._exports(spec, where, scope, last)

    def _exports(self, spec: TransformSpec, where: str, scope: Scope, last: Ports | None) -> Ports:
        given = spec.output
        if given is None:
            if spec.type == "chain" and last is not None and last.main:
                return Ports(where, {OUTPUT: last.data[last.main]}, OUTPUT, None, {OUTPUT: last.origin[last.main]})
            return Ports(where, {}, None)
        wanted = given if isinstance(given, dict) else {OUTPUT: given}
        data, origin = {}, {}
        for port, reference in wanted.items():
            found, p = scope.resolve(str(reference), where)
            self.pending.pop((found.path, p), None)
            data[port], origin[port] = found.data[p], found.origin[p]
        return Ports(where, data, OUTPUT if OUTPUT in data else next(iter(data), None), None, origin)

    def _order(self, children: dict[str, TransformSpec], scope: Scope, where: str) -> list[str]:
        """Names so that each follows what it reads; a cycle is an error that shows it."""
        needs = {n: {r.partition(".")[0] for x in self._all(c) for refs in x.inputs().values() for r in refs} & set(children) for n, c in children.items()}
        out: list[str] = []
        state: dict[str, int] = {}

        def visit(name: str, trail: list[str]) -> None:
            if state.get(name) == 2:
                return
            if name in trail:
                raise PipelineError(f"{where}: a cycle: {' -> '.join([*trail[trail.index(name) :], name])}")
            for n in sorted(needs[name] - ({name} if children[name].nested else set())):
                visit(n, [*trail, name])
            state[name] = 2
            out.append(name)

        for name in children:
            visit(name, [])
        return out

    def _all(self, spec: TransformSpec) -> list[TransformSpec]:
        """A transform and those in it that it doesn't name itself."""
        own = {c.name or c.type for c in (*spec.transforms, *spec.extra_transforms)}
        inner = [x for c in (*spec.transforms, *spec.extra_transforms) for x in self._all(c)]
        return [spec, *(x for x in inner if not any(r.partition(".")[0] in own for refs in x.inputs().values() for r in refs))]

    def _child(self, spec: TransformSpec, name: str, path: str, scope: Scope, feed: tuple[Ports, str] | None, windowing: dict | None) -> Ports:
        full = f"{path}/{name}" if path else name
        return self._nested(spec, full, scope, feed) if spec.nested else self._leaf(spec, full, scope, feed, windowing)

    def _bind(self, spec: TransformSpec, where: str) -> tuple[Transform, str | None]:
        config = dict(spec.config)
        cls, alias = lookup(spec.type), None
        if "error_handling" in config:
            handling = config.pop("error_handling")
            if ERRORS not in cls.outputs:
                raise PipelineError(f"{where}: {spec.type} has no dead letters")
            if not isinstance(handling, dict) or "threshold" in handling or set(handling) - {"output"}:
                raise PipelineError(f"{where}: error_handling knows only output")
            alias = str(handling.get("output") or "").strip()
            if not alias:
                raise PipelineError(f"{where}: error_handling.output must not be blank")
            if alias in cls.outputs and alias != ERRORS:
                raise PipelineError(f"{where}: error_handling.output {alias!r} is an output already")
        return bind(cls, config, where), alias

    def _leaf(self, spec: TransformSpec, path: str, scope: Scope, feed: tuple[Ports, str] | None, windowing: dict | None) -> Ports:
        path = path or spec.name or spec.type
        node, alias = self._bind(spec, path)
        feeds: dict[str, list[tuple[Ports, str]]] = {}
        for port, references in spec.inputs().items():
            feeds[port] = [scope.resolve(r, path) for r in references]
        if feed and not feeds:
            feeds[""] = [feed]
        if not node.inputs and feeds:
            raise PipelineError(f"{path}: a source takes no input")
        if "" in feeds:
            if len(node.inputs) != 1 and ANY not in node.inputs:
                raise PipelineError(f"{path}: name the inputs: {', '.join(node.inputs)}")
            feeds[node.inputs[0]] = feeds.pop("")
        variadic = ANY in node.inputs
        if not variadic:
            if missing := set(node.inputs) - set(feeds):
                raise PipelineError(f"{path}: inputs are missing: {', '.join(sorted(missing))}")
            if unknown := set(feeds) - set(node.inputs):
                raise PipelineError(f"{path}: inputs are not known: {', '.join(sorted(unknown))}")
            if many := [p for p, f in feeds.items() if len(f) > 1]:
                raise PipelineError(f"{path}: more than one input for {', '.join(many)}")
        elif not any(feeds.values()):
            raise PipelineError(f"{path}: at least one input is needed")
        inputs: dict[str, list[Data]] = {}
        upstream = []
        for port, sources in feeds.items():
            for ports, p in sources:
                self.pending.pop((ports.path, p), None)
                upstream.append(ports.origin[p])
                inputs.setdefault(ANY if variadic else port, []).append(ports.data[p])
        window = spec.windowing or (windowing if not node.inputs else None)
        parsed = WindowSpec.parse(window) if window else None
        if parsed and node.inputs:
            inputs = {k: [Data.of(assign_windows(d.df, parsed)) for d in v] for k, v in inputs.items()}
        ctx = Context(self.spark, path, self.execute, self.streaming, alias is not None, self.options, self.queries)
        made = node.build(inputs, ctx)
        if parsed and not node.inputs:
            made = {k: Data.of(assign_windows(d.df, parsed)) for k, d in made.items()}
        if alias and ERRORS in made:
            made[alias] = made.pop(ERRORS)
            self.pending[(path, alias)] = path
        elif ERRORS in made:
            made.pop(ERRORS)
        main = OUTPUT if OUTPUT in made else next((p for p in made if p != alias), None)
        self.nodes.append(Node(path, spec.type, node.tier, node.delivery(), upstream, sorted(inputs), sorted(made)))
        return Ports(path, made, main, alias, dict.fromkeys(made, path))

    # after building

    def check_delivery(self) -> None:
        """A sink that needs a key must not get rows that a replay would give again."""
        by = {n.path: n for n in self.nodes}
        for sink in self.nodes:
            if not (sink.delivery and sink.delivery.needs_key):
                continue
            todo, seen = list(sink.upstream), set()
            while todo:
                path = todo.pop()
                if path in seen or path not in by:
                    continue
                seen.add(path)
                node = by[path]
                if not node.upstream and node.delivery and node.delivery.replay == "FULL_REPLAY":
                    raise PipelineError(f"{sink.path} needs an idempotency key, but {path} replays all its rows; use keys, or acknowledge duplicates where the sink allows it")
                todo += node.upstream

    def describe(self) -> str:
        return "\n".join(n.describe() for n in self.nodes)
