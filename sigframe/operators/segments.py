"""Windows over long series, cut into bounded segments.

A run may hold a large share of all rows, so no window here is partitioned by run alone.
Rows are cut by position into segments; frames of bounded width see copied margin rows
(halo), and running values carry per-segment summaries across segments.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

SEGMENT_ROWS = 65536
SEG = "_seg"


def segment_of(position: Column, rows: int = SEGMENT_ROWS) -> Column:
    return F.floor(position / F.lit(float(rows))).cast("long")


def halo(df: DataFrame, order_col: str, before: int, after: int, rows: int = SEGMENT_ROWS) -> DataFrame:
    """Copy each row into every segment whose frame [-before, +after] can reach it."""
    pos = F.col(order_col)
    if not before and not after:
        return df.withColumn(SEG, segment_of(pos, rows))
    return df.withColumn(
        SEG, F.explode(F.sequence(segment_of(pos - after, rows), segment_of(pos + before, rows)))
    )


def core(df: DataFrame, order_col: str, rows: int = SEGMENT_ROWS) -> DataFrame:
    """Keep the rows a segment owns."""
    return df.where(segment_of(F.col(order_col), rows) == F.col(SEG)).drop(SEG)


def over_rows(
    df: DataFrame,
    columns: dict[str, Callable[[Window], Column]],
    *,
    partition_cols: Sequence[str],
    order_col: str,
    before: int = 0,
    after: int = 0,
    rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Add windowed columns whose frames reach at most ``before``/``after`` rows.

    ``order_col`` is a dense integer position (see :func:`row_index`).
    """
    w = Window.partitionBy(*partition_cols, SEG).orderBy(order_col)
    out = halo(df, order_col, before, after, rows)
    out = out.select("*", *[make(w).alias(name) for name, make in columns.items()])
    return core(out, order_col, rows)


def row_index(
    df: DataFrame,
    *,
    partition_cols: Sequence[str],
    order_cols: Sequence[str | Column],
    buckets: Sequence[Column],
    name: str = "t",
) -> DataFrame:
    """Dense 0-based position of each row in its run.

    ``buckets`` never decrease along the order and get finer from left to right (day, then
    minute, say). Rows are ranked inside their finest bucket only; bucket starts come from
    counts, one level at a time, so no window spans a run's rows.
    """
    parts = list(partition_cols)
    levels = [f"_b{i}" for i in range(len(buckets))]
    keyed = df.select("*", *[b.alias(n) for b, n in zip(buckets, levels)])
    starts = keyed.groupBy(*parts, *levels).agg(F.count(F.lit(1)).alias("_n"))
    finest = starts
    for depth in range(1, len(levels) + 1):
        here = levels[:depth]
        sizes = finest.groupBy(*parts, *here).agg(F.sum("_n").alias("_size"))
        earlier = Window.partitionBy(*parts, *here[:-1]).orderBy(here[-1]).rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias(f"_s{depth}")
        starts = starts.join(sizes.select(*parts, *here, before), [*parts, *here])
    start = sum((F.col(f"_s{i + 1}") for i in range(len(levels))), F.lit(0))
    starts = starts.select(*parts, *levels, start.alias("_start"))
    local = Window.partitionBy(*parts, *levels).orderBy(*order_cols)
    return (
        keyed.withColumn("_rn", F.row_number().over(local))
        .join(starts, [*parts, *levels])
        .withColumn(name, (F.col("_start") + F.col("_rn") - 1).cast("long"))
        .drop(*levels, "_rn", "_start")
    )


def running_sum(
    df: DataFrame,
    value: Column,
    name: str,
    *,
    partition_cols: Sequence[str],
    order_col: str,
    inclusive: bool = True,
    segment: Column | None = None,
) -> DataFrame:
    """Prefix sum along ``order_col``: segment totals first, then inside each segment."""
    keyed = df.withColumn(SEG, segment_of(F.col(order_col)) if segment is None else segment)
    keyed = keyed.withColumn("_v", value)
    totals = keyed.groupBy(*partition_cols, SEG).agg(F.sum("_v").alias("_total"))
    earlier = Window.partitionBy(*partition_cols).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*partition_cols, SEG, F.sum("_total").over(earlier).alias("_carry"))
    end = 0 if inclusive else -1
    local = Window.partitionBy(*partition_cols, SEG).orderBy(order_col).rowsBetween(Window.unboundedPreceding, end)
    zero = F.lit(0)
    return (
        keyed.withColumn("_local", F.sum("_v").over(local))
        .join(carry, [*partition_cols, SEG])
        .withColumn(name, F.coalesce("_local", zero) + F.coalesce("_carry", zero))
        .drop(SEG, "_v", "_local", "_carry")
    )


def fill_linear(
    df: DataFrame,
    value_col: str,
    *,
    partition_cols: Sequence[str],
    order_col: str,
    rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Fill gaps on the straight line between known neighbours, by row position.

    A leading gap stays missing and a trailing one holds the last known value.
    """
    pos, val = F.col(order_col), F.col(value_col)
    known = F.when(val.isNotNull() & ~F.isnan(val), F.struct(pos.alias("p"), val.alias("v")))
    keyed = df.withColumn(SEG, segment_of(pos, rows)).withColumn("_known", known)
    edges = keyed.groupBy(*partition_cols, SEG).agg(
        F.max("_known").alias("_last"), F.min("_known").alias("_first")
    )
    w = Window.partitionBy(*partition_cols).orderBy(SEG)
    carry = edges.select(
        *partition_cols,
        SEG,
        F.last("_last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.first("_first", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
    )
    local = Window.partitionBy(*partition_cols, SEG).orderBy(order_col)
    out = (
        keyed.withColumn("_l", F.last("_known", ignorenulls=True).over(local.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_r", F.first("_known", ignorenulls=True).over(local.rowsBetween(0, Window.unboundedFollowing)))
        .join(carry, [*partition_cols, SEG])
        .withColumn("_l", F.coalesce("_l", "_before"))
        .withColumn("_r", F.coalesce("_r", "_after"))
    )
    left, right = F.col("_l"), F.col("_r")
    share = F.try_divide(pos - left["p"], right["p"] - left["p"])
    filled = (
        F.when(F.col("_known").isNotNull(), val)
        .when(left.isNull(), F.lit(None).cast("double"))
        .when(right.isNull(), left["v"])
        .otherwise(left["v"] + (right["v"] - left["v"]) * share)
    )
    return out.withColumn(value_col, filled).drop(SEG, "_known", "_l", "_r", "_before", "_after")
