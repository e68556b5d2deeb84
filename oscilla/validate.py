"""Eager checks of scalar parameters, and data checks that fail the query they belong to."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

UNITS = {"s": 1_000_000, "ms": 1_000, "us": 1}


def positive(**values: float) -> None:
    for name, value in values.items():
        if not (value > 0 and math.isfinite(value)):
            raise ValueError(f"{name} must be positive and finite, not {value}")


def not_negative(**values: float) -> None:
    for name, value in values.items():
        if not (value >= 0 and math.isfinite(value)):
            raise ValueError(f"{name} must not be negative, not {value}")


def overlap(window: float, shared: float) -> None:
    """A hop of zero or less would never reach the end of a series."""
    positive(window=window)
    if not 0 <= shared < window:
        raise ValueError(f"overlap must be at least 0 and less than the window ({window}), not {shared}")


def band(low: float, high: float) -> None:
    if not low <= high:
        raise ValueError(f"empty band: {low} to {high}")


def unit(name: str) -> int:
    """Microseconds in one unit of time."""
    if name not in UNITS:
        raise ValueError(f"unknown time unit {name!r}: one of {', '.join(UNITS)}")
    return UNITS[name]


def columns(df: DataFrame, *names: str) -> None:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
