"""Column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def us(column: Column | str) -> Column:
    """Microseconds since the epoch of a timestamp, zoned or not (session zone UTC)."""
    return F.unix_micros((F.col(column) if isinstance(column, str) else column).cast("timestamp"))


def quantiles(column: Column, shares: list[float], accuracy: int | None = None) -> Column:
    """Array of quantiles: exact and interpolated, or approximate at scale."""
    wanted = F.array(*map(F.lit, shares))
    return F.percentile(column, wanted) if accuracy is None else F.percentile_approx(column, wanted, F.lit(accuracy)).cast("array<double>")


def rounded(column: Column | str, places: int = 6) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, places)
