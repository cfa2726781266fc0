"""Long and vector layouts of a series, and regular grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")
    return df


def to_vectors(df: DataFrame, variables: Sequence[str], *, keys: Sequence[str] = ("run", "t"),
               var_col: str = "var", value_col: str = "value", name: str = "x") -> DataFrame:
    """Long rows to one ARRAY<DOUBLE> per key, in the order of ``variables``; absent cells are 0."""
    cells = [
        F.coalesce(F.max(F.when(F.col(var_col) == v, F.col(value_col))), F.lit(0.0)).cast("double")
        for v in variables
    ]
    return df.groupBy(*keys).agg(F.array(*cells).alias(name))


def to_long(df: DataFrame, *, keys: Sequence[str] = ("run", "t"), vector_col: str = "x",
            var_col: str = "var", value_col: str = "value") -> DataFrame:
    return df.select(*keys, F.posexplode(vector_col).alias(var_col, value_col))


def flip(df: DataFrame, *, keys: Sequence[str] = ("run",), row_col: str = "t", var_col: str = "var",
         n_rows: Column | None = None, n_vars: Column | None = None) -> DataFrame:
    """Long-form transpose when there are fewer rows than variables.

    The two counts default to the table's own maxima plus one, per run.
    """
    sizes = df.groupBy(*keys).agg(
        (F.max(row_col) + 1 if n_rows is None else n_rows).alias("_rows"),
        (F.max(var_col) + 1 if n_vars is None else n_vars).alias("_vars"),
    )
    turned = F.col("_rows") < F.col("_vars")
    return (
        df.join(sizes, list(keys))
        .withColumn("_r", F.when(turned, F.col(var_col)).otherwise(F.col(row_col)))
        .withColumn(var_col, F.when(turned, F.col(row_col)).otherwise(F.col(var_col)))
        .withColumn(row_col, F.col("_r"))
        .drop("_r", "_rows", "_vars")
    )


def densify(df: DataFrame, *, partition_cols: Sequence[str], order_col: str, value_cols: Sequence[str],
            low: Column, high: Column) -> DataFrame:
    """Complete integer grid per run with zeros where nothing was seen.

    Zero rows are added under the existing aggregation instead of joining a grid, so this is
    one shuffle with map-side sums.
    """
    runs = df.select(*partition_cols).distinct()
    blank = runs.select(
        *partition_cols,
        F.explode(F.sequence(low, high)).alias(order_col),
        *[F.lit(0).cast(df.schema[c].dataType).alias(c) for c in value_cols],
    )
    both = df.select(*partition_cols, order_col, *value_cols).unionByName(blank)
    return both.groupBy(*partition_cols, order_col).agg(*[F.sum(c).alias(c) for c in value_cols])


def even_times(df: DataFrame, *, count: Column, step: float, start: float = 0.0, name: str = "time") -> DataFrame:
    """``start + i*step`` for i below ``count``, exploded per row (one row per run)."""
    return df.select(
        "*", F.explode(F.sequence(F.lit(0), (count - 1).cast("int"))).alias("i")
    ).withColumn(name, F.lit(start) + F.col("i") * F.lit(step))


def spread_times(df: DataFrame, *, count: Column, duration: Column, name: str = "time") -> DataFrame:
    """``count`` times from 0 to ``duration`` inclusive, per row."""
    return df.select(
        "*", F.explode(F.sequence(F.lit(0), (count - 1).cast("int"))).alias("i")
    ).withColumn(name, F.coalesce(F.try_divide(F.col("i") * duration, count - 1), F.lit(0.0)))
