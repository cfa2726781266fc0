"""Windowed features over streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def _pooled(df: DataFrame, window: Column, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    out = df.groupBy(*keys, window.alias("_w")).agg(F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(v) for v in values])
    return out.select(*keys, F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), "n", *values)


def sliding_features(df: DataFrame, *, width: str, step: str, late: str, ts_col: str = "ts",
                     keys: Sequence[str] = ("run",), value_cols: Sequence[str] = ("value",)) -> DataFrame:
    """Mean-pooled sliding windows; rows later than ``late`` are dropped."""
    return _pooled(df.withWatermark(ts_col, late), F.window(ts_col, width, step), keys, value_cols)


def tumbling_features(df: DataFrame, *, width: str, late: str, ts_col: str = "ts",
                      keys: Sequence[str] = ("run",), value_cols: Sequence[str] = ("value",)) -> DataFrame:
    """Mean-pooled windows side by side; rows later than ``late`` are dropped."""
    return _pooled(df.withWatermark(ts_col, late), F.window(ts_col, width), keys, value_cols)


def active_segments(df: DataFrame, *, gap: str, late: str, ts_col: str = "ts",
                    keys: Sequence[str] = ("run",), value_cols: Sequence[str] = ("value",)) -> DataFrame:
    """Segments of activity that end with a pause of ``gap``; rows later than ``late`` are dropped."""
    return _pooled(df.withWatermark(ts_col, late), F.session_window(ts_col, gap), keys, value_cols)
