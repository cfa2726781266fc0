"""Sums of products over rows: the one data pass behind ridge and PCA.

A task adds up small matrices for its rows and sends each once, in row blocks; blocks are
then summed inside the JVM with map-side combine. Rows themselves are never shuffled here.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from sigframe.functions.arrays import vector_sum, with_value
from sigframe.session import written

MAX_DRIVER_BYTES = 1 << 30
FLUSH_BYTES = 256 << 20


def _ddl(df: DataFrame, cols: Sequence[str]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*cols).schema)


def gram(df: DataFrame, group_cols: Sequence[str], x_col: str = "x", block: int = 128) -> DataFrame:
    """(group, row_block, width, values): rows of [1|x]'[1|x] per group, ``block`` rows at a time."""
    groups = list(group_cols)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict = {}

        def rows() -> Iterator[pd.DataFrame]:
            for key, g in acc.items():
                width = g.shape[1]
                for b in range(0, width, block):
                    yield pd.DataFrame([(*key, b // block, width, g[b:b + block].ravel())],
                                       columns=[*groups, "row_block", "width", "values"])
            acc.clear()

        for pdf in batches:
            parts = pdf.groupby(groups, sort=False) if groups else [((), pdf)]
            for key, part in parts:
                x = np.stack(part[x_col].to_numpy()).astype(float)
                z = np.hstack([np.ones((len(x), 1)), x])
                key = tuple(key)
                acc[key] = acc[key] + z.T @ z if key in acc else z.T @ z
            if sum(g.nbytes for g in acc.values()) > FLUSH_BYTES:
                yield from rows()
        yield from rows()

    parts = df.select(*groups, x_col).mapInPandas(add, _ddl(df, groups) + "row_block int, width int, values array<double>")
    return parts.groupBy(*groups, "row_block", "width").agg(vector_sum(F.col("values")).alias("values"))


def collect_gram(table: DataFrame, group_cols: Sequence[str]) -> dict[tuple, np.ndarray]:
    """The summed matrices by group, after a check of their total size."""
    table = written(table, "gram")
    size = table.agg(F.sum(F.size("values"))).first()[0] or 0
    if size * 8 > MAX_DRIVER_BYTES:
        raise ValueError(f"Gram matrices need {size * 8 / 2**30:.1f} GiB; use the dual form or reduce features first")
    found: dict[tuple, dict] = {}
    for r in table.collect():
        found.setdefault(tuple(r[g] for g in group_cols), {})[r["row_block"]] = np.asarray(r["values"]).reshape(-1, r["width"])
    return {k: np.vstack([b[i] for i in sorted(b)]) for k, b in found.items()}


def cross(df: DataFrame, group_cols: Sequence[str], x_col: str = "x", y_col: str = "y") -> DataFrame:
    """(group, width, n, values): rows, and [1|x]'y, then y'y per column, flattened, per group."""
    groups = list(group_cols)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict = {}
        counts: dict = {}

        def rows() -> Iterator[pd.DataFrame]:
            for key, c in acc.items():
                yield pd.DataFrame([(*key, c.shape[1], counts[key], c.ravel())], columns=[*groups, "width", "n", "values"])
            acc.clear()
            counts.clear()

        for pdf in batches:
            for key, part in pdf.groupby(groups, sort=False):
                x = np.stack(part[x_col].to_numpy()).astype(float)
                y = np.stack(part[y_col].to_numpy()).astype(float)
                c = np.vstack([y.sum(0), x.T @ y, (y * y).sum(0)])
                key = tuple(key)
                acc[key] = acc[key] + c if key in acc else c
                counts[key] = counts.get(key, 0) + len(y)
            if sum(c.nbytes for c in acc.values()) > FLUSH_BYTES:
                yield from rows()
        yield from rows()

    parts = df.select(*groups, x_col, y_col).mapInPandas(add, _ddl(df, groups) + "width int, n bigint, values array<double>")
    return parts.groupBy(*groups, "width").agg(F.sum("n").alias("n"), vector_sum(F.col("values")).alias("values"))


#: Targets that are packed, solved and predicted together.
CHUNK_TARGETS = 200


def pack_targets(y: DataFrame, *, keys: Sequence[str] = ("run", "t"), target: str = "target", value: str = "y",
                 n_chunks: int | None = None, missing: str = "error", samples: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Long responses to (keys, chunk, y[]) and the (chunk, targets[]) list.

    Chunks are hash groups of targets, about CHUNK_TARGETS each unless their number is given, so that a row and a task stay
    small however many targets there are. A sample that lacks a response of some target, or has it NULL or NaN, is an error; with
    ``missing="zero"`` such responses are 0, which pulls weights towards 0, also at those of ``samples`` (keys) that have no response.
    """
    if missing not in ("error", "zero"):
        raise ValueError(f"missing responses are an error or zero, not {missing!r}")
    names = written(y.select(target).distinct(), "targets")
    if n_chunks is None:
        n_chunks = max(1, -(-names.count() // CHUNK_TARGETS))
    names = names.withColumn("chunk", F.pmod(F.xxhash64(target), F.lit(n_chunks)).cast("int"))
    places = names.withColumn("place", F.row_number().over(Window.partitionBy("chunk").orderBy(target)) - 1)
    places = places.withColumn("width", F.count(F.lit(1)).over(Window.partitionBy("chunk")))
    value = F.col(value).cast("double")
    cells = y.select(*keys, target, F.when(~F.isnan(value), value).alias("_v")).where(F.col("_v").isNotNull()).join(places, target)
    rows = cells.groupBy(*keys, "chunk").agg(F.first("width").alias("width"), F.array_sort(F.collect_list(F.struct("place", F.lit(0).alias("blank"), "_v"))).alias("c"))
    whole = F.size("c") == F.col("width")
    if missing == "error":
        told = F.concat_ws(" ", F.lit("of"), F.col("width").cast("string"), F.lit("responses"), F.size("c").cast("string"), F.lit("are there at"),
                           *(F.col(k).cast("string") for k in keys))
        packed = F.when(whole, F.col("c._v")).otherwise(F.raise_error(told).cast("array<double>"))
    else:
        # one merge of the places that are there with those that should be, not a lookup of each
        blank = F.transform(F.sequence(F.lit(0), F.col("width").cast("int") - 1), lambda i: F.struct(i.alias("place"), F.lit(1).alias("blank"), F.lit(0.0).alias("_v")))
        merged = with_value(F.array_sort(F.concat("c", blank)), lambda s: F.transform(
            F.filter(s, lambda x, i: (i == 0) | (x["place"] != F.get(s, i - 1)["place"])), lambda x: x["_v"]))
        packed = F.when(whole, F.col("c._v")).otherwise(merged)
    listed = names.groupBy("chunk").agg(F.array_sort(F.collect_list(target)).alias("targets"))
    out = rows.select(*keys, "chunk", packed.alias("y"))
    if missing == "zero" and samples is not None:
        widths = listed.select("chunk", F.size("targets").alias("width"))
        grid = samples.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))).alias("chunk")).join(widths, "chunk")
        out = grid.join(out, [*keys, "chunk"], "left").select(*keys, "chunk", F.coalesce("y", F.array_repeat(F.lit(0.0), F.col("width"))).alias("y"))
    return out, listed
