"""Event-time windows: as a column of rows, and as aggregates."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.errors import PipelineError
from millrace.functions.durations import milliseconds

#: Columns by convention: a row's event time, and the window it is in.
EVENT_TIME, WINDOW = "_event_time", "_window"


@dataclass(frozen=True)
class WindowSpec:
    type: str
    size: int = 0
    period: int = 0
    gap: int = 0

    @classmethod
    def parse(cls, config: dict[str, Any]) -> WindowSpec:
        needs = {"fixed": {"size"}, "sliding": {"size", "period"}, "sessions": {"gap"}, "session": {"gap"}, "global": set()}
        kind = config.get("type")
        if kind not in needs:
            raise PipelineError(f"windowing type {kind!r} is not one of {', '.join(needs)}")
        if set(config) - {"type"} != needs[kind]:
            raise PipelineError(f"windowing {kind} takes exactly: {', '.join(sorted(needs[kind])) or 'nothing'}")
        return cls("sessions" if kind == "session" else kind, **{k: milliseconds(config[k]) for k in needs[kind]})

    def column(self, time: Column) -> Column:
        """The window expression to group by."""
        if self.type == "fixed":
            return F.window(time, f"{self.size} milliseconds")
        if self.type == "sliding":
            return F.window(time, f"{self.size} milliseconds", f"{self.period} milliseconds")
        if self.type == "sessions":
            return F.session_window(time, f"{self.gap} milliseconds")
        raise PipelineError("the global window is no column")


def event_time(df: DataFrame, column: str, lateness: str = "0 seconds") -> DataFrame:
    """Names a column the event time, as TIMESTAMP, with a watermark if streaming."""
    out = df.withColumn(EVENT_TIME, F.col(column).cast("timestamp"))
    return out.withWatermark(EVENT_TIME, lateness) if df.isStreaming else out


def assign_windows(df: DataFrame, spec: WindowSpec) -> DataFrame:
    """Adds the window of each row (one row for each window, if sliding).

    Rows without an event time are in one window, as all rows of the global
    one: they are left as they are.  Sessions of a batch are those of all its
    rows; of a stream they exist only in aggregates.
    """
    if spec.type == "global" or EVENT_TIME not in df.columns:
        return df
    if spec.type != "sessions":
        return df.withColumn(WINDOW, spec.column(F.col(EVENT_TIME)))
    if df.isStreaming:
        raise PipelineError("sessions of a stream need an aggregate by window")
    return assign_sessions(df, spec.gap, [])


def assign_sessions(df: DataFrame, gap: int, keys: list[str]) -> DataFrame:
    """The session window of each row of a batch, by key."""
    if not keys:
        # sessions without a key are found from the distinct windows, which merge far fewer rows than the table has
        spans = df.groupBy(F.session_window(EVENT_TIME, f"{gap} milliseconds").alias(WINDOW)).agg(F.count(F.lit(1)).alias("_n")).select(WINDOW)
        return df.join(spans, (F.col(EVENT_TIME) >= F.col(f"{WINDOW}.start")) & (F.col(EVENT_TIME) < F.col(f"{WINDOW}.end")))
    order = Window.partitionBy(*keys).orderBy(EVENT_TIME)
    millis = F.unix_millis(EVENT_TIME)
    begins = F.when(millis - F.lag(millis).over(order) < gap, 0).otherwise(1)
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    numbered = df.withColumn("_begins", begins).withColumn("_session", F.sum("_begins").over(running))
    same = Window.partitionBy(*keys, "_session")
    span = F.struct(F.min(EVENT_TIME).over(same).alias("start"), (F.max(EVENT_TIME).over(same) + F.make_dt_interval(secs=F.lit(gap / 1000).cast("decimal(18,6)"))).alias("end"))
    return numbered.withColumn(WINDOW, span).drop("_begins", "_session")


def count_windows(df: DataFrame, time: str, spec: WindowSpec, keys: list[str] | None = None, lateness: str = "0 seconds") -> DataFrame:
    """``start, end``, the keys and ``n`` rows of each window; streaming or batch."""
    timed = event_time(df, time, lateness)
    grouped = timed.groupBy(*(keys or []), spec.column(F.col(EVENT_TIME)).alias(WINDOW)).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col(f"{WINDOW}.start").alias("start"), F.col(f"{WINDOW}.end").alias("end"), *(keys or []), "n")


def without_marks(df: DataFrame) -> DataFrame:
    """Drops the columns by convention, as before plain sinks."""
    return df.drop(EVENT_TIME, WINDOW)

