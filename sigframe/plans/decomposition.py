"""Principal components from one summed matrix; batch, incremental and stored forms."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from sigframe.plans.gram import MAX_DRIVER_BYTES, collect_gram, gram
from sigframe.session import arrow_rows, written


@dataclass(frozen=True)
class State:
    """Mergeable (n, mean, scatter) of rows seen so far."""

    n: float
    mean: np.ndarray
    scatter: np.ndarray

    @staticmethod
    def of(moments: np.ndarray) -> "State":
        n = moments[0, 0]
        mean = moments[0, 1:] / n
        return State(n, mean, moments[1:, 1:] - n * np.outer(mean, mean))

    def merge(self, other: "State") -> "State":
        n = self.n + other.n
        gap = other.mean - self.mean
        return State(n, self.mean + gap * other.n / n,
                     self.scatter + other.scatter + np.outer(gap, gap) * self.n * other.n / n)


@dataclass(frozen=True)
class Components:
    """Loadings (k x p), mean, and the share of variance of every component found; ``error`` is that of a wide fit."""

    loadings: np.ndarray
    mean: np.ndarray
    ratio: np.ndarray
    variance: np.ndarray
    error: float = 0.0

    @property
    def k(self) -> int:
        return len(self.loadings)


def moments(df: DataFrame, x_col: str = "x") -> State:
    """One pass over the rows; only the p x p sums come back, after a size check."""
    return State.of(collect_gram(gram(df, [], x_col), [])[()])


def solve(state: State, n_components: int | None = None, threshold: float = 0.95) -> Components:
    """Components by falling variance: a given number, or the fewest that reach ``threshold``.

    The largest entry of each loading is positive, so signs are reproducible.
    """
    cov = state.scatter / max(state.n - 1, 1)
    w, v = np.linalg.eigh(cov)
    order = np.argsort(w)[::-1][: int(min(state.n, len(w)))]
    w, v = np.maximum(w[order], 0), v[:, order].T
    ratio = w / np.trace(cov) if np.trace(cov) > 0 else np.zeros_like(w)
    k = n_components or components_for(ratio, threshold)
    flip = np.sign(v[np.arange(len(v)), np.abs(v).argmax(axis=1)])
    return Components((v * flip[:, None])[:k], state.mean, ratio, w)


def components_for(ratio: Sequence[float], threshold: float) -> int:
    """Fewest components whose shares reach the threshold, all if they never do."""
    reached = np.cumsum(ratio) >= threshold - 1e-12
    return int(np.argmax(reached)) + 1 if reached.any() else len(ratio)


def project(df: DataFrame, model: Components, x_col: str = "x", name: str = "z") -> DataFrame:
    """Scores of each row, a batch at a time against the broadcast loadings (k x p)."""
    return _map_rows(df, x_col, name, model, lambda x, m: (x - m.mean) @ m.loadings.T)


def restore(df: DataFrame, model: Components, z_col: str = "z", name: str = "x") -> DataFrame:
    return _map_rows(df, z_col, name, model, lambda z, m: z @ m.loadings + m.mean)


def _map_rows(df: DataFrame, source: str, name: str, model: Components, fn: Callable) -> DataFrame:
    held = df.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in df.schema if f.name not in (source, name)]
    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept) + f"`{name}` array<double>"
    cols = [f.name for f in kept]

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf[source].to_numpy()).astype(float)
                yield pdf[cols].assign(**{name: list(fn(x, held.value))})

    return df.select(*cols, source).mapInPandas(apply, ddl)


def fit_and_reduce(df: DataFrame, *, threshold: float = 0.95, n_components: int | None = None, x_col: str = "x",
                   method: Callable[[State, int | None, float], Components] = solve, limit: int | None = None) -> tuple[DataFrame, Components]:
    """Reduced rows and the model; one summing pass serves the search and the final fit.

    Where a p x p matrix would take more than ``limit`` bytes (``gram.MAX_DRIVER_BYTES``), :func:`sigframe.plans.subspace.fit_wide` finds
    the components without one, and the reduced rows are stored in the shared folder.
    """
    first = df.select(F.size(x_col).alias("p")).first()
    if first and 8 * (first["p"] + 1) ** 2 > (MAX_DRIVER_BYTES if limit is None else limit):
        from sigframe.plans.subspace import ROW_BYTES, fit_wide

        model = fit_wide(df, n_components=n_components, threshold=threshold, x_col=x_col)
        # wide rows reach Python few at a time, which only counts for what is stored here
        with arrow_rows(df.sparkSession, ROW_BYTES // (8 * first["p"])):
            return written(project(df, model, x_col), "reduced"), model
    model = method(moments(df, x_col), n_components, threshold)
    return project(df, model, x_col), model


class Incremental:
    """Fit by batches: each call adds one batch's sums."""

    def __init__(self, n_components: int | None = None, threshold: float = 0.95):
        self.n_components, self.threshold, self.state = n_components, threshold, None

    def partial_fit(self, df: DataFrame, x_col: str = "x") -> "Incremental":
        new = moments(df, x_col)
        self.state = new if self.state is None else self.state.merge(new)
        return self

    @property
    def model(self) -> Components:
        if self.state is None:
            raise ValueError("not fitted")
        return solve(self.state, self.n_components, self.threshold)


def info(spark: SparkSession, model: Components) -> DataFrame:
    """(component, explained_ratio, cumulative, selected), one row per component."""
    rows = [(i, float(r), float(c), i < model.k) for i, (r, c) in enumerate(zip(model.ratio, np.cumsum(model.ratio)))]
    return spark.createDataFrame(rows, "component int, explained_ratio double, cumulative double, selected boolean")


def scree(df: DataFrame, *, variance: str, order: Sequence[Column | str], keys: Sequence[str] = (), threshold: float = 0.95) -> DataFrame:
    """Ratio, cumulative ratio and selection from a table of component variances (one row each)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    total = F.sum(variance).over(Window.partitionBy(*keys))
    out = df.withColumns({"component": F.row_number().over(w), "explained_ratio": F.col(variance) / total})
    out = out.withColumn("cumulative", F.sum("explained_ratio").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("selected", F.coalesce(F.lag("cumulative").over(w) < threshold, F.lit(True)))


def needed_components(table: DataFrame, threshold: float, *, keys: Sequence[str] = ()) -> DataFrame:
    """Fewest components per model that reach the threshold, all if none does."""
    hit = F.min(F.when(F.col("cumulative") >= threshold, F.col("component")))
    return table.groupBy(*keys).agg(F.coalesce(hit, F.max("component")).alias("n_components"))


def save(spark: SparkSession, model: Components, path: str) -> None:
    rows = [(i, [float(v) for v in l]) for i, l in enumerate(model.loadings)]
    spark.createDataFrame(rows, "component int, loading array<double>").write.mode("overwrite").parquet(f"{path}/components")
    spark.createDataFrame([([float(v) for v in model.mean],)], "mean array<double>").write.mode("overwrite").parquet(f"{path}/mean")
    every = [(i, float(r), float(v)) for i, (r, v) in enumerate(zip(model.ratio, model.variance))]
    spark.createDataFrame(every, "component int, explained_ratio double, variance double").write.mode("overwrite").parquet(f"{path}/info")


def exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def load(spark: SparkSession, path: str) -> Components:
    if not exists(spark, path):
        raise FileNotFoundError(path)
    part = lambda n: spark.read.parquet(f"{path}/{n}")
    comps = part("components").orderBy("component").collect()
    every = part("info").orderBy("component").collect()
    return Components(np.array([r["loading"] for r in comps]), np.array(part("mean").first()["mean"]),
                      np.array([r["explained_ratio"] for r in every]), np.array([r["variance"] for r in every]))


def fit_reduce_or_load(df: DataFrame, path: str, *, force_refit: bool = False, x_col: str = "x", **options) -> tuple[DataFrame, Components]:
    """Reuse the stored model at ``path`` unless there is none or a refit is forced."""
    spark = df.sparkSession
    if not force_refit and exists(spark, path):
        model = load(spark, path)
        return project(df, model, x_col), model
    reduced, model = fit_and_reduce(df, x_col=x_col, **options)
    save(spark, model, path)
    return reduced, model
