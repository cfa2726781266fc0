"""Principal components of tables too wide for a p x p matrix: randomised subspace steps and a tree of QR factors.

The covariance C is only applied: a pass over the rows turns a basis Q (p x l) into C Q, which is made orthonormal again. A few such
power steps from a random start turn Q towards the leading components. The rows' coordinates Y = (x - mean) Q are then reduced to one l x l triangle:
each task keeps the R of its rows, stacks of them are reduced again, FAN at a time. The singular values and vectors
of R give variances and components within the subspace, without squaring the condition number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sigframe.functions.arrays import vector_sum
from sigframe.plans import gram
from sigframe.plans.decomposition import Components, components_for
from sigframe.session import arrow_rows, written

#: Extra directions, power steps, triangles that one task reduces, features of a summed block, and bytes of rows held at a time.
OVERSAMPLE, STEPS, FAN, BLOCK, ROW_BYTES = 10, 4, 16, 256, 32 << 20


def triangle(rows: np.ndarray) -> np.ndarray:
    """R of a stack of rows, with as many rows as columns."""
    r = np.linalg.qr(rows, mode="r")
    return np.vstack([r, np.zeros((rows.shape[1] - len(r), rows.shape[1]))]) if len(r) < rows.shape[1] else r


def tall_qr(coordinates: DataFrame, name: str, width: int) -> np.ndarray:
    """The width x width R factor of all rows' arrays ``name``."""

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = None
        for pdf in batches:
            if len(pdf):
                rows = np.stack(pdf[name].to_numpy())
                r = triangle(rows if r is None else np.vstack([r, rows]))
        if r is not None:
            yield pd.DataFrame({"r": [r.ravel()]})

    def stacked(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"r": [triangle(np.vstack([np.asarray(v).reshape(width, width) for v in pdf["r"]])).ravel()]})

    factors = written(coordinates.select(name).mapInPandas(local, "r array<double>"), "factors")
    left = factors.count()
    while left > 1:
        left = -(-left // FAN)
        dealt = factors.withColumn("to", F.pmod(F.monotonically_increasing_id() + F.spark_partition_id(), F.lit(left)))
        factors = written(dealt.groupBy("to").applyInPandas(stacked, "r array<double>"), "factors")
        left = factors.count()
    found = factors.first()
    return np.asarray(found["r"]).reshape(width, width) if found else np.zeros((width, width))


def applied(df: DataFrame, x_col: str, mean: np.ndarray, q: np.ndarray) -> np.ndarray:
    """sum of (x - mean)' (x - mean) Q over the rows; a task's sums are sent once, BLOCK features a row, and added up in the JVM."""
    held = df.sparkSession.sparkContext.broadcast((mean, q))

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, basis = held.value
        total = None
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf[x_col].to_numpy()) - m
                w = x.T @ (x @ basis)
                total = w if total is None else total + w
        if total is not None:
            for b in range(0, len(total), BLOCK):
                yield pd.DataFrame([(b // BLOCK, total[b:b + BLOCK].ravel())], columns=["block", "values"])

    with arrow_rows(df.sparkSession, ROW_BYTES // (8 * len(mean))):
        parts = df.select(F.col(x_col).cast("array<double>").alias(x_col)).mapInPandas(add, "block int, values array<double>")
        sums = written(parts.groupBy("block").agg(vector_sum(F.col("values")).alias("values")), "applied")
    return np.vstack([np.asarray(r["values"]).reshape(-1, q.shape[1]) for r in sums.orderBy("block").collect()])


def fit_wide(df: DataFrame, *, n_components: int | None = None, threshold: float = 0.95, x_col: str = "x", steps: int = STEPS, seed: int = 0) -> Components:
    """Components by falling variance: a given number, or the fewest that reach ``threshold``.

    The subspace has OVERSAMPLE more directions than components; a threshold is searched by doubling it. With all directions the result is
    exact. ``error`` of the model is the largest residual |C v - variance v| over the first variance, from one more pass.
    ``ratio`` and ``variance`` cover the subspace's directions; shares are of the total variance. Largest loadings are positive.
    """
    one = df.select(F.col(x_col).cast("array<double>").alias("x"))
    stats = one.agg(F.count(F.lit(1)).alias("n"), vector_sum(F.col("x")).alias("s"), vector_sum(F.transform("x", lambda v: v * v)).alias("q")).first()
    n, mean = stats["n"], np.asarray(stats["s"]) / max(stats["n"], 1)
    total = float(np.maximum(np.asarray(stats["q"]) - n * mean * mean, 0).sum()) / max(n - 1, 1)
    p = len(mean)
    size = min(n, p, (n_components or 32) + OVERSAMPLE)
    while True:
        if 8 * p * size > gram.MAX_DRIVER_BYTES:
            raise ValueError(f"{size} directions of {p} features need {8 * p * size / 2**30:.1f} GiB; ask for fewer components")
        q = np.linalg.qr(np.random.default_rng(seed).normal(size=(p, size)))[0]
        for _ in range(steps):
            q = np.linalg.qr(applied(df, x_col, mean, q))[0]
        held = df.sparkSession.sparkContext.broadcast((mean, q))

        def turned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            m, basis = held.value
            for pdf in batches:
                if len(pdf):
                    yield pd.DataFrame({"y": list((np.stack(pdf["x"].to_numpy()) - m) @ basis)})

        with arrow_rows(df.sparkSession, ROW_BYTES // (8 * p)):
            r = tall_qr(one.mapInPandas(turned, "y array<double>"), "y", size)
        s, v = np.linalg.svd(r)[1:]
        variance = s * s / max(n - 1, 1)
        ratio = variance / total if total > 0 else np.zeros(size)
        k = n_components or components_for(ratio, threshold)
        if n_components or size == min(n, p) or ratio.sum() >= threshold:
            break
        size = min(n, p, 2 * size)
    loadings = v @ q.T
    flip = np.sign(loadings[np.arange(size), np.abs(loadings).argmax(axis=1)])
    loadings = (loadings * np.where(flip == 0, 1, flip)[:, None])[:k]
    gap = applied(df, x_col, mean, loadings.T) / max(n - 1, 1) - loadings.T * variance[:k]
    error = float(np.sqrt((gap * gap).sum(axis=0)).max() / variance[0]) if variance[0] > 0 else 0.0
    return Components(loadings, mean, ratio, variance, error)
