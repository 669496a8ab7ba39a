"""Robust scale of residuals as distributed aggregates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearloom.functions import selection

NORMAL = 1.4826


def _spread(rows: DataFrame, centre: float) -> float:
    return max(NORMAL * selection.median(rows, F.abs(F.col("x") - centre)), 1e-9)


def robust_scale(df: DataFrame, column: str, estimator: str = "trimmed_mad", trim_sigma: float = 3.0, rounds: int = 20) -> float:
    """One of ``robust_scales``."""
    return robust_scales(df, column, [estimator], trim_sigma, rounds)[estimator]


def robust_scales(df: DataFrame, column: str, estimators: list[str], trim_sigma: float = 3.0, rounds: int = 20) -> dict[str, float]:
    """Spread of a column by standard deviation (population), IQR, MAD or trimmed MAD; at least 1e-9.

    Trimmed MAD takes the MAD again of what lies within ``trim_sigma`` scales of the centre,
    until it stays or too few rows are left. Medians are selected by histograms around those of
    the round before, so only counts reach the driver; median and MAD are selected once for all
    estimators. Nulls and non-finite values do not count.
    """
    x = F.col(column)
    rows = df.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))).select(x.cast("double").alias("x"))
    x, out = F.col("x"), {}
    if "std" in estimators:
        out["std"] = max(rows.agg(F.stddev_pop(x)).first()[0] or 0.0, 1e-9)
    if "iqr" in estimators:
        q = selection.quantiles(rows, x, [0.25, 0.75])
        out["iqr"] = max((q[1] - q[0]) / 1.349, 1e-9) if q else 1e-9
    if {"mad", "trimmed_mad"} & set(estimators):
        centre = selection.median(rows, x)
        scale = 1e-9 if centre is None else _spread(rows, centre)
        out |= {"mad": scale, "trimmed_mad": scale if centre is None or "trimmed_mad" not in estimators else _trimmed(rows, centre, scale, trim_sigma, rounds)}
    return {e: out[e] for e in estimators}


def _trimmed(rows: DataFrame, centre: float, scale: float, trim_sigma: float, rounds: int) -> float:
    x, n = F.col("x"), rows.count()
    least = max(30, 0.2 * n)
    near, width = (centre - 0.1 * scale, centre + 0.1 * scale), (0.6 * scale / NORMAL, scale / NORMAL)
    for _ in range(rounds):
        limit = trim_sigma * scale
        m = rows.where(F.abs(x - centre) <= limit).count()
        if m < least:
            break

        def inside(batch: pa.RecordBatch, c: float = centre, limit: float = limit) -> np.ndarray:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            return values[np.abs(values - c) <= limit]

        old, before = centre, scale
        centre = selection.narrowed(rows, [0.5], m, [near], inside)[0]
        mad = selection.narrowed(rows, [0.5], m, [width], lambda batch, r=inside, c=centre: np.abs(r(batch) - c))[0]
        scale = max(NORMAL * mad, 1e-9)
        if abs(scale - before) <= 1e-12 * max(before, 1.0):
            break
        near, width = selection.around(centre, abs(centre - old), mad, m), selection.around(mad, abs(scale - before) / NORMAL, mad, m)
    return scale
