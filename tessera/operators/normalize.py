"""Whole-table and per-group normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def robust_norm(df: DataFrame, column: str, out: str, low: float = 0.10, high: float = 0.90) -> DataFrame:
    """Clipped (x - p10) / (p90 - p10) over the table; 0 where the spread vanishes.

    The percentiles are one scalar subquery, not a window over the whole table.
    """
    p = df.agg(F.percentile(column, [low, high])).scalar()
    lo, hi = p[0], p[1]
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(column) - lo) / (hi - lo)))
    return df.withColumn(out, F.when(hi <= lo + 1e-8, F.lit(0.0)).otherwise(value))


def phase_change(df: DataFrame, group: str, time: list[str], signal: str, out: str) -> DataFrame:
    """Larger of the steps to the previous and to the next row; groups under three rows keep the signal."""
    w = Window.partitionBy(group).orderBy(*time)
    x = F.col(signal)
    before, after = F.coalesce(F.lag(x).over(w), x), F.coalesce(F.lead(x).over(w), x)
    n = F.count("*").over(Window.partitionBy(group))
    return df.withColumn(out, F.when(n < 3, x).otherwise(F.greatest(F.abs(x - before), F.abs(after - x))))


def spread_in_group(value: Column, *partition: str) -> Column:
    """.75 + .5 * (v - min) / max(span, 1e-6) inside the group; 1 for a single row."""
    w = Window.partitionBy(*partition)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    scaled = 0.75 + 0.5 * (value - lo) / F.greatest(hi - lo, F.lit(1e-6))
    return F.when(F.count("*").over(w) == 1, F.lit(1.0)).otherwise(scaled)
