"""Writers with dead letters.

A writer is a side effect, so it runs in exactly one action: a task writes its
rows through a client and returns those that failed, which are saved to a
durable table; what reads the dead letters reads that table.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.operators.transforms import dead_letter_schema
from millrace.plans.registry import ERRORS, INPUT, Context, Data, Sink
from millrace.sources import clients
from millrace.streaming.windows import without_marks
from millrace.workspace import new_path


@dataclass(frozen=True)
class Policy:
    """How a failed batch is handled.

    ``isolate``: ``row`` writes its rows one by one, ``item`` trusts the
    client's report of single rows, ``batch`` rejects all its rows.
    """

    batch_size: int
    isolate: str = "item"
    retries: int = 0
    delay: float = 0.0
    most_delay: float = 60.0
    exponential: bool = True
    retry_on: Callable[[Exception], bool] | None = None

    def waits(self) -> list[float]:
        return [min(self.most_delay, self.delay * (2**i if self.exponential else i + 1)) for i in range(self.retries)]


def failure(row: dict, error: Exception, name: str) -> dict:
    return {"element": row, "error_type": type(error).__name__, "error_message": str(error) or None, "transform": name}


def write_batch(client: Any, rows: list[dict], policy: Policy, sleep: Callable[[float], None] = time.sleep) -> list[tuple[int, Exception]]:
    """Writes a batch; returns the rows that failed, by index."""
    for wait in [*policy.waits(), None]:
        try:
            return list(client.write(rows) or [])
        except Exception as e:
            if wait is not None and (policy.retry_on is None or policy.retry_on(e)):
                sleep(wait)
                continue
            if policy.isolate != "row" or len(rows) == 1:
                return [(i, e) for i in range(len(rows))]
            break
    failed = []
    for i, row in enumerate(rows):
        try:
            failed += [(i, e) for _, e in client.write([row]) or []]
        except Exception as e:
            failed.append((i, e))
    return failed


def write_rows(client: Any, rows: Iterator[dict], policy: Policy, convert: Callable[[dict], Any], name: str) -> Iterator[dict]:
    """Converts and writes rows in batches; gives a dead letter for each row that failed."""
    batch: list[tuple[dict, Any]] = []

    def flush() -> Iterator[dict]:
        if batch:
            for i, e in write_batch(client, [c for _, c in batch], policy):
                yield failure(batch[i][0], e, name)
            batch.clear()

    for row in rows:
        try:
            batch.append((row, convert(row)))
        except Exception as e:
            yield failure(row, e, name)
        if len(batch) >= policy.batch_size:
            yield from flush()
    yield from flush()


def plain(value: Any) -> Any:
    """A Row (as a dict) from Spark's Python values."""
    if hasattr(value, "asDict"):
        return value.asDict(recursive=True)
    return value


def run_writer(df: DataFrame, factory: Callable, config: Any, policy: Policy, convert: Callable[[dict], Any], name: str) -> DataFrame:
    """Rows that failed, as dead letters.  Evaluate it once only."""
    names, schema = df.schema.names, dead_letter_schema(df.schema)
    loose = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])

    def run(rows: Iterator[Any]) -> Iterator[tuple]:
        client = factory(config)
        try:
            for f in write_rows(client, ({n: plain(r[n]) for n in names} for r in rows), policy, convert, name):
                yield tuple(f["element"][n] for n in names), f["error_type"], f["error_message"], f["transform"]
        finally:
            getattr(client, "close", lambda: None)()

    # typed values must reach the client as Python objects, one by one: a partition iterator
    return df.sparkSession.createDataFrame(df.rdd.mapPartitions(run), loose)


class ClientSink(Sink):
    """Base of sinks over clients: a kind, a policy and a conversion."""

    kind = ""
    tier = "experimental"

    def policy(self) -> Policy:
        raise NotImplementedError

    def converter(self, schema: T.StructType) -> Callable[[dict], Any]:
        return lambda row: row

    def factory(self) -> Callable:
        return clients.factory(self.kind)

    def build(self, inputs: dict[str, list[Data]], ctx: Context) -> dict[str, Data]:
        data = inputs[INPUT][0]
        convert = self.converter(data.schema)
        schema = dead_letter_schema(data.schema)
        if not ctx.execute:
            return {ERRORS: Data(ctx.spark.createDataFrame([], schema), schema)}
        factory, df = self.factory(), without_marks(data.df) if not ctx.errors_wanted else data.df
        if df.isStreaming:
            path = new_path(ctx.spark, "dead-letters")

            def step(batch: DataFrame, _: int) -> None:
                self._finish(run_writer(batch, factory, self.config, self.policy(), convert, ctx.name), path, ctx)

            start_stream(df, step, ctx)
            return {ERRORS: Data(ctx.spark.createDataFrame([], schema), schema)}
        path = new_path(ctx.spark, "dead-letters")
        self._finish(run_writer(df, factory, self.config, self.policy(), convert, ctx.name), path, ctx)
        return {ERRORS: Data(ctx.spark.read.schema(schema).parquet(path), schema)}

    def _finish(self, failed: DataFrame, path: str, ctx: Context) -> None:
        """The one action: rejects are saved if something reads them, else the first ends the job."""
        failed.write.mode("append").parquet(path)
        if not ctx.errors_wanted:
            first = ctx.spark.read.parquet(path).select("error_type", "error_message").first()
            if first is not None:
                raise RuntimeError(f"{ctx.name}: rows were rejected and no error_handling reads them: {first.error_type}: {first.error_message}")


def start_stream(df: DataFrame, step: Callable[[DataFrame, int], None], ctx: Context) -> None:
    """A query with a checkpoint named by the option ``checkpoint`` (else in the shared folder)."""
    checkpoint = ctx.options.get("checkpoint")
    location = f"{checkpoint.rstrip('/')}/{ctx.name.replace('/', '-')}" if checkpoint else new_path(ctx.spark, "checkpoint")
    writer = df.writeStream.foreachBatch(step).option("checkpointLocation", location)
    trigger = ctx.options.get("trigger", "available_now" if ctx.options.get("bounded") == "true" else "")
    ctx.queries.append((writer.trigger(availableNow=True) if trigger == "available_now" else writer).start())


