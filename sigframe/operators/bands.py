"""Feature spaces: joining bands, aligning layers, centring."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from sigframe.functions.arrays import zeros


def join_bands(bands: Sequence[DataFrame], names: Sequence[str], *, keys: Sequence[str] = ("run", "t"),
               vector_col: str = "x") -> tuple[DataFrame, DataFrame]:
    """Concatenate vectors of several feature spaces; also the (space, start, end) table.

    Spaces that share their partitioning on ``keys`` join without a further shuffle.
    """
    if len(bands) != len(names):
        raise ValueError(f"{len(bands)} feature tables but {len(names)} names")
    parts = [b.select(*keys, F.col(vector_col).alias(f"_x{i}")) for i, b in enumerate(bands)]
    joined = reduce(lambda a, b: a.join(b, list(keys)), parts)
    cols = [F.col(f"_x{i}") for i in range(len(bands))]
    x = joined.select(*keys, F.concat(*cols).alias(vector_col))
    widths = joined.agg(*[F.max(F.size(c)).alias(f"_w{i}") for i, c in enumerate(cols)])
    rows = []
    start: Column = F.lit(0)
    for i, n in enumerate(names):
        end = start + F.col(f"_w{i}")
        rows.append(F.struct(F.lit(n).alias("space"), start.alias("start"), end.alias("end")))
        start = end
    spaces = widths.select(F.explode(F.array(*rows)).alias("s")).select("s.*")
    return x, spaces


def unify_layers(df: DataFrame, *, list_col: str = "list", layer_col: str = "layer", row_col: str = "row",
                 vector_col: str = "x") -> DataFrame:
    """Every list gets every layer; a missing layer is zeros of that layer's width.

    The layer catalogue is one small map read as a scalar subquery, so data rows are grouped
    once and never crossed with it. Different widths of one layer are an error.
    """
    width = F.size(vector_col)
    catalogue = df.groupBy(layer_col).agg(
        F.when(F.min(width) == F.max(width), F.max(width)).otherwise(
            F.raise_error(F.concat(F.lit("layer widths differ: "), F.col(layer_col))).cast("int")).alias("_w"))
    layers = catalogue.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(layer_col, "_w")))).alias("m")).scalar()
    per_row = df.groupBy(list_col, row_col).agg(F.map_from_entries(F.collect_list(F.struct(layer_col, vector_col))).alias("_have"))
    full = per_row.select(list_col, row_col, "_have", F.explode(layers).alias(layer_col, "_w"))
    return full.select(
        list_col, layer_col, row_col,
        F.coalesce(F.try_element_at("_have", F.col(layer_col)), zeros(F.col("_w"))).alias(vector_col))


def layer_names(df: DataFrame, layer_col: str = "layer") -> DataFrame:
    return df.select(layer_col).distinct().orderBy(layer_col)


def standardise(df: DataFrame, value_col: str = "value", *, keys: Sequence[str] = ("run", "var"), scale: bool = True) -> DataFrame:
    """Mean 0 and population sd 1 per series; a constant series is only centred."""
    stats = df.groupBy(*keys).agg(F.avg(value_col).alias("_mean"), F.stddev_pop(value_col).alias("_sd"))
    v = F.col(value_col) - F.col("_mean")
    if scale:
        v = F.when(F.col("_sd") > 0, F.try_divide(v, F.col("_sd"))).otherwise(v)
    return df.join(stats, list(keys)).withColumn(value_col, v).drop("_mean", "_sd")


def centre_on_train(df: DataFrame, is_train: Column, value_cols: Sequence[str], *, keys: Sequence[str] = ()) -> DataFrame:
    """Subtract training means from training and test rows alike, keeping the sd."""
    means = df.where(is_train).groupBy(*keys).agg(*[F.avg(c).alias(f"_m_{c}") for c in value_cols])
    if keys:
        joined = df.join(means, list(keys))
        out = joined.withColumns({c: F.col(c) - F.col(f"_m_{c}") for c in value_cols})
        return out.drop(*[f"_m_{c}" for c in value_cols])
    one = means.select(F.struct(*means.columns).alias("m")).scalar()
    return df.withColumns({c: F.col(c) - one[f"_m_{c}"] for c in value_cols})
