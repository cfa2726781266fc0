"""Stimulus event tables as regressor text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sigframe.functions.scalars import ppoint
from sigframe.operators.segments import row_index


def complete(df: DataFrame) -> DataFrame:
    """Rows without any missing value (NULL or NaN)."""
    return df.dropna("any")


def shift_onset(df: DataFrame, offset: float, onset: str = "onset") -> DataFrame:
    return df.withColumn(onset, F.col(onset) + F.lit(float(offset)))


def flag_duration(df: DataFrame, min_duration: float, duration: str = "duration") -> DataFrame:
    return df.withColumn("time_filter", F.col(duration) >= F.lit(min_duration))


def regressor_text(form: str, *, onset: str = "onset", amplitude: str = "amplitude", duration: str = "duration") -> Column:
    """Event text: ``times``, ``am`` onset*amplitude, ``dm`` onset:duration, ``dm_am`` both."""
    on, am, du = ppoint(F.col(onset)), ppoint(F.col(amplitude)), ppoint(F.col(duration))
    forms = {
        "times": on, "am": F.concat(on, F.lit("*"), am), "dm": F.concat(on, F.lit(":"), du),
        "dm_am": F.concat(on, F.lit("*"), am, F.lit(":"), du)}
    return forms[form]


def regressors(df: DataFrame, form: str, *, offset: float = 0.0, min_duration: float | None = None,
               onset: str = "onset", amplitude: str = "amplitude", duration: str = "duration") -> DataFrame:
    """Complete events with shifted onset and their ``regressor`` text; stateless, so it also streams.

    The duration forms keep the filter column and only rows that pass it.
    """
    out = shift_onset(complete(df), offset, onset)
    if form in ("dm", "dm_am"):
        out = flag_duration(out, 0.0 if min_duration is None else min_duration, duration).where("time_filter")
    return out.withColumn("regressor", regressor_text(form, onset=onset, amplitude=amplitude, duration=duration))


def regressor_lines(df: DataFrame, *, partition_cols: Sequence[str] = ("run",), order_cols: Sequence[str] = ("onset",),
                    buckets: Sequence[Column], per_part: int = 1000) -> DataFrame:
    """Event texts joined by spaces in order, as numbered parts of at most ``per_part`` events.

    Joining a run's parts in order with spaces gives its line; no run is ever gathered whole.
    """
    placed = row_index(df, partition_cols=partition_cols, order_cols=order_cols, buckets=buckets, name="_pos")
    part = F.floor(F.col("_pos") / per_part).cast("long")
    grouped = placed.groupBy(*partition_cols, part.alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("_pos", "regressor"))).alias("_e"))
    return grouped.select(*partition_cols, "part", F.array_join("_e.regressor", " ").alias("line"))
