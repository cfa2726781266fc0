"""Alignment of irregular series to time grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sigframe.functions.scalars import lanczos_weight


def rectify(df: DataFrame, value_col: str, name: str = "part") -> DataFrame:
    """Two rows per value: min(x, 0) as ``neg`` and max(x, 0) as ``pos``."""
    v = F.col(value_col)
    others = [c for c in df.columns if c != value_col]
    return df.select(
        *others,
        F.explode(F.map_from_arrays(
            F.array(F.lit("neg"), F.lit("pos")),
            F.array(F.least(v, F.lit(0.0)), F.greatest(v, F.lit(0.0))))).alias(name, value_col),
    )


def rectify_columns(df: DataFrame, value_col: str) -> DataFrame:
    v = F.col(value_col)
    return df.withColumns({
        f"{value_col}_neg": F.least(v, F.lit(0.0)), f"{value_col}_pos": F.greatest(v, F.lit(0.0))})


def lanczos_regular(
    df: DataFrame,
    *,
    step: float,
    n_points: Column,
    start: float = 0.0,
    keys: Sequence[str] = ("run",),
    time_col: str = "time",
    value_cols: Sequence[str] = ("value",),
    window: float = 3,
    cutoff_mult: float = 1.0,
    rectified: bool = False,
) -> DataFrame:
    """Windowed-sinc resampling to ``start + k*step``, k below ``n_points``.

    On a regular grid the reachable points follow from arithmetic, so every sample is expanded
    to its neighbours and summed on the map side: there is no join, and the only shuffle
    carries one row per grid point and task.
    """
    cutoff = cutoff_mult / step
    reach = window / cutoff
    time = F.col(time_col)
    values = list(value_cols)
    if rectified:
        for c in value_cols:
            df = rectify_columns(df, c)
        values = [f"{c}_{side}" for side in ("neg", "pos") for c in value_cols]
    low = F.greatest(F.ceil((time - reach - start) / step), F.lit(0)).cast("long")
    high = F.least(F.floor((time + reach - start) / step), n_points - 1).cast("long")
    points = F.when(low <= high, F.sequence(low, high))
    near = df.select(*keys, *values, time.alias("_time"), F.explode(points).alias("k"))
    weight = lanczos_weight(F.lit(start) + F.col("k") * step - F.col("_time"), cutoff, window)
    sums = near.withColumn("_w", weight).groupBy(*keys, "k").agg(
        *[F.sum(F.col("_w") * F.col(c)).alias(c) for c in values])
    grid = df.select(*keys).distinct().select(
        *keys, F.explode(F.sequence(F.lit(0).cast("long"), (n_points - 1).cast("long"))).alias("k"),
        *[F.lit(0.0).alias(c) for c in values])
    return (
        sums.unionByName(grid).groupBy(*keys, "k").agg(*[F.sum(c).alias(c) for c in values])
        .withColumn(time_col, F.lit(start) + F.col("k") * step)
    )


def lanczos_join(
    df: DataFrame,
    grid: DataFrame,
    *,
    mean_step: float,
    keys: Sequence[str] = ("run",),
    time_col: str = "time",
    value_cols: Sequence[str] = ("value",),
    window: float = 3,
    cutoff_mult: float = 1.0,
    rectified: bool = False,
) -> DataFrame:
    """Windowed-sinc resampling to any table of new times (``keys`` + ``time_col``).

    ``mean_step`` is the mean difference of the new times. The range condition becomes an
    equi-join on time bins as wide as the kernel: grid points, the small side, are copied to
    three bins, samples stay single. Points without a neighbour are 0.
    """
    cutoff = cutoff_mult / mean_step
    reach = window / cutoff
    values = list(value_cols)
    if rectified:
        for c in value_cols:
            df = rectify_columns(df, c)
        values = [f"{c}_{side}" for side in ("neg", "pos") for c in value_cols]
    # bins a little wider than the kernel, so rounding never separates a pair at its edge
    bin_of = lambda t: F.floor(t / F.lit(reach * (1 + 1e-9))).cast("long")
    new = grid.select(*keys, F.col(time_col).alias("_new"))
    binned = new.select("*", F.explode(F.sequence(bin_of(F.col("_new")) - 1, bin_of(F.col("_new")) + 1)).alias("_bin"))
    old = df.select(*keys, *values, F.col(time_col).alias("_old"), bin_of(F.col(time_col)).alias("_bin"))
    pairs = old.join(binned, [*keys, "_bin"]).where(F.abs(F.col("_new") - F.col("_old")) * cutoff <= window)
    sums = (
        pairs.withColumn("_w", lanczos_weight(F.col("_new") - F.col("_old"), cutoff, window))
        .groupBy(*keys, "_new")
        .agg(*[F.sum(F.col("_w") * F.col(c)).alias(c) for c in values])
    )
    blank = new.select(*keys, "_new", *[F.lit(0.0).alias(c) for c in values])
    return (
        sums.unionByName(blank).groupBy(*keys, "_new").agg(*[F.sum(c).alias(c) for c in values])
        .withColumnRenamed("_new", time_col)
    )


def context_windows(df: DataFrame, *, step: float, width: float, n_steps: Column,
                    time_col: str = "time") -> DataFrame:
    """Copy rows to every context window [max(0, t-width), max(t, step)) that holds them.

    Windows sit at t = k*step, k below ``n_steps``; ``k`` and the bounds are added.
    """
    time = F.col(time_col)
    k = F.col("k")
    low = F.when(time < step, F.lit(0)).otherwise(F.floor(time / step) + 1)
    high = F.least(F.floor((time + width) / step), n_steps - 1)
    near = df.select("*", F.explode(F.when((low <= high) & (time >= 0), F.sequence(low.cast("long"), high.cast("long")))).alias("k"))
    start = F.greatest(F.lit(0.0), k * step - width)
    end = F.greatest(k * F.lit(step), F.lit(float(step)))
    return near.withColumns({"window_start": start, "window_end": end}).where(
        (F.col("window_start") <= time) & (time < F.col("window_end")))


def context_windows_join(df: DataFrame, grid: DataFrame, *, width: float, step: float,
                         keys: Sequence[str] = ("run",), time_col: str = "time") -> DataFrame:
    """The same windows around any table of times (per-frame grids end at t + ``step``).

    Interval condition as an equi-join on bins of the window width; the grid is copied, not
    the samples.
    """
    span = width + step
    bin_of = lambda t: F.floor(t / F.lit(span * (1 + 1e-9))).cast("long")
    new = grid.select(*keys, F.col(time_col).alias("grid_time"))
    g = F.col("grid_time")
    new = new.withColumns({
        "window_start": F.greatest(F.lit(0.0), g - width), "window_end": g + step})
    binned = new.select("*", F.explode(F.sequence(bin_of(F.col("window_start")), bin_of(F.col("window_end")))).alias("_bin"))
    old = df.withColumn("_bin", bin_of(F.col(time_col)))
    return old.join(binned, [*keys, "_bin"]).where(
        (F.col("window_start") <= F.col(time_col)) & (F.col(time_col) < F.col("window_end"))).drop("_bin")


def pooled_windows(df: DataFrame, *, step: float, panes: int, n_steps: Column,
                   keys: Sequence[str] = ("run",), time_col: str = "time",
                   value_cols: Sequence[str] = ("value",)) -> DataFrame:
    """Mean-pooled context windows of width ``panes*step``.

    Sums per step-wide pane come first, so a row is counted once and only pane totals are
    copied to the windows that hold them.
    """
    pane = F.floor(F.col(time_col) / step).cast("long")
    sums = df.where(F.col(time_col) >= 0).groupBy(*keys, pane.alias("_pane")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in value_cols])
    low = F.when(F.col("_pane") == 0, F.lit(0).cast("long")).otherwise(F.col("_pane") + 1)
    high = F.least(F.col("_pane") + panes, n_steps - 1).cast("long")
    spread = sums.select("*", F.explode(F.when(low <= high, F.sequence(low, high))).alias("k"))
    return spread.groupBy(*keys, "k").agg(
        F.sum("n").alias("n"), *[(F.sum(c) / F.sum("n")).alias(c) for c in value_cols])
