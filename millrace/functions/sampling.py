"""Sampling: each row, or each block of a file, is kept with the given chance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.errors import PipelineError


def bernoulli(df: DataFrame, fraction: float, seed: int | None = None) -> DataFrame:
    return df.sample(False, _checked(fraction), seed)


def blocks(df: DataFrame, fraction: float, seed: int | None = None) -> DataFrame:
    """Whole splits of files, chosen by a hash of file, offset and seed; needs a file scan."""
    at = F.xxhash64(F.input_file_name(), F.input_file_block_start(), F.lit(seed or 0))
    return df.where(F.pmod(at, F.lit(1 << 53)).cast("double") / float(1 << 53) < _checked(fraction))


def _checked(fraction: float) -> float:
    if not 0 < fraction <= 1:
        raise PipelineError("a fraction must be above 0 and at most 1")
    return float(fraction)


def sample(df: DataFrame, config: dict) -> DataFrame:
    unknown = set(config) - {"fraction", "method", "seed"}
    method = config.get("method", "bernoulli")
    if unknown or method not in ("bernoulli", "system") or not isinstance(config.get("fraction"), (int, float)):
        raise PipelineError(f"sample {config!r} is not of the form fraction, method (bernoulli or system), seed")
    return (bernoulli if method == "bernoulli" else blocks)(df, config["fraction"], config.get("seed"))
