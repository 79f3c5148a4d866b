"""Durations such as ``10s``, ``1.5m`` or ``3`` (seconds)."""

from __future__ import annotations

import re
from decimal import Decimal

from millrace.errors import PipelineError

#: Milliseconds of each unit.
UNITS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}


def milliseconds(text: str | int | float) -> int:
    """Whole positive milliseconds, or an error."""
    found = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*(ms|s|m|h|d)?\s*", str(text))
    if not found or isinstance(text, bool):
        raise PipelineError(f"{text!r} is not a duration")
    value = Decimal(found[1]) * UNITS[found[2] or "s"]
    if value <= 0 or value != int(value):
        raise PipelineError(f"duration {text!r} is not a whole, positive number of milliseconds")
    return int(value)


def spark_interval(text: str | int | float) -> str:
    return f"{milliseconds(text)} milliseconds"
