"""A pipeline from its YAML: build, describe, run, and the run's manifest."""

from __future__ import annotations

import argparse
import hashlib
import json
import os
import sys
import tempfile
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from millrace.plans.graph import Graph, Ports
from millrace.plans.spec import PipelineSpec, merge_options


class Pipeline:
    """``Pipeline.from_yaml(text).build(spark)`` gives lazy DataFrames; ``run`` executes the sinks."""

    def __init__(self, spec: PipelineSpec):
        self.spec = spec
        self.graph: Graph | None = None

    @classmethod
    def from_yaml(cls, text: str, variables: dict[str, str] | None = None) -> Pipeline:
        return cls(PipelineSpec.parse(text, variables))

    @classmethod
    def from_file(cls, path: str, variables: dict[str, str] | None = None) -> Pipeline:
        return cls.from_yaml(Path(path).read_text(encoding="utf-8"), variables)

    def _graph(self, spark: SparkSession, execute: bool, options: dict[str, Any] | None) -> tuple[Graph, Ports]:
        merged = merge_options(self.spec.options, options or {})
        for key, value in merged.items():
            if key.startswith("spark.sql."):
                spark.conf.set(key, value)
        self.graph = Graph(self.spec, spark, execute, merged)
        return self.graph, self.graph.build()

    def build(self, spark: SparkSession, options: dict[str, Any] | None = None) -> dict[str, DataFrame]:
        """The exported ports as DataFrames; sinks don't write and assertions don't run."""
        return {port: d.df for port, d in self._graph(spark, False, options)[1].data.items()}

    def output(self, spark: SparkSession) -> DataFrame:
        return self.build(spark)["output"]

    def describe(self, spark: SparkSession) -> str:
        return self._graph(spark, False, None)[0].describe()

    def run(self, spark: SparkSession, options: dict[str, Any] | None = None, manifest: str | None = None, timeout: float | None = None) -> dict[str, DataFrame]:
        """Validates, then executes node by node; waits for streaming queries."""
        self._graph(spark, False, options)
        self._manifest(manifest, "VALIDATED", None)
        self._manifest(manifest, "SUBMITTED", None)
        try:
            graph, ports = self._graph(spark, True, options)
            for query in graph.queries:
                query.awaitTermination(timeout) if timeout else query.awaitTermination()
        except BaseException:
            self._manifest(manifest, "TERMINAL", "FAILED")
            raise
        self._manifest(manifest, "TERMINAL", "DONE")
        return {port: d.df for port, d in ports.data.items()}

    def _manifest(self, path: str | None, phase: str, state: str | None) -> None:
        """An atomic JSON file; it holds no connector config."""
        if not path:
            return
        nodes = [{"name": n.path, "type": n.type, "tier": n.tier, "delivery": vars(n.delivery) if n.delivery else None} for n in self.graph.nodes]
        content = {"phase": phase, "state": state, "sha256": hashlib.sha256(self.spec.text.encode()).hexdigest(), "streaming": self.graph.streaming, "nodes": nodes}
        fd, temporary = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
        with os.fdopen(fd, "w") as f:
            json.dump(content, f, indent=1)
        os.replace(temporary, path)


def main(args: list[str] | None = None) -> int:
    """``python -m millrace.plans.pipeline FILE [--dry-run] [--var NAME=VALUE] [--option KEY=VALUE]``"""
    parser = argparse.ArgumentParser(prog="millrace")
    parser.add_argument("file")
    parser.add_argument("--dry-run", action="store_true")
    parser.add_argument("--var", action="append", default=[])
    parser.add_argument("--option", action="append", default=[])
    parser.add_argument("--manifest")
    given = parser.parse_args(args)
    pipeline = Pipeline.from_file(given.file, dict(v.split("=", 1) for v in given.var))
    options = dict(o.split("=", 1) for o in given.option)
    builder = SparkSession.builder.appName("millrace")
    for key, value in merge_options(pipeline.spec.options, options).items():
        if key.startswith("spark."):
            builder = builder.config(key, value)
    spark = builder.getOrCreate()
    if given.dry_run:
        print(pipeline.describe(spark))
        return 0
    pipeline.run(spark, options, given.manifest)
    return 0


if __name__ == "__main__":
    sys.exit(main())
