"""From features and responses to a fitted model: centre, delay, band, choose and run a solver."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from sigframe.functions.arrays import subtract, vector_mean
from sigframe.operators.windows import delay
from sigframe.plans.kernel import GroupKernels, Kernels
from sigframe.plans.ridge import ALPHAS, Banded, Fit, prepare, prepare_group, random_gammas, with_refined

# The default lags in samples.
DELAYS = (1, 2, 3, 4)
SOLVERS: dict[str, Callable] = {}


@dataclass(frozen=True)
class Encoding:
    """A fitted model with what is needed to transform new features."""

    fit: Fit
    kind: str
    mean: list
    delays: tuple
    spaces: list
    data: Banded | Kernels


def delayed_features(x: DataFrame, mean: Sequence[float], delays: Sequence[int] | None, spaces: Sequence[tuple[str, int, int]], *,
                     partition_cols: Sequence[str] = ("run",), order_col: str = "t") -> tuple[DataFrame, list]:
    """Centred features with all delays of a space side by side; also the widened space list."""
    centred = x.withColumn("x", subtract(F.col("x").cast("array<double>"), F.lit([float(m) for m in mean])))
    if delays is None:
        return centred, list(spaces)
    width, n = len(mean), len(delays)
    stacked = delay(centred, list(delays), ["x"], partition_cols=partition_cols, order_col=order_col)
    parts, wide, at = [], [], 0
    for name, start, end in spaces:
        parts += [F.slice("x", i * width + start + 1, end - start) for i in range(n)]
        wide.append((name, at, at + (end - start) * n))
        at = wide[-1][2]
    return stacked.withColumn("x", F.concat(*parts)), wide


def _random_search(x, y, folds, spaces, *, banded, gammas, alphas, max_iter, **how):
    data = (prepare if banded else Kernels)(x, y, folds, spaces, **how)
    return data, data.search(gammas, alphas)


def _group_search(x, y, folds, spaces, *, banded, gammas, alphas, max_iter, **how):
    data = (prepare_group if banded else GroupKernels)(x, y, folds, spaces, **how)
    return data, data.search(gammas, alphas)


def _gradient_search(x, y, folds, spaces, *, banded, gammas, alphas, max_iter, **how):
    """Start every target from one shared weight with its best penalty, then descend."""
    data = (prepare if banded else Kernels)(x, y, folds, spaces, **how)
    k = len(spaces)
    start = data.search(np.full((1, k), 1.0 / k), alphas)
    refined, _ = data.refine(start, max_iter=max_iter)
    return data, with_refined(start, refined, spaces)


SOLVERS["hyper_gradient"] = _gradient_search
SOLVERS["random_search"] = _random_search
SOLVERS["group_level_random_search"] = _group_search


def fit_encoding(x: DataFrame, y: DataFrame, folds: DataFrame, spaces: Sequence[tuple[str, int, int]] | None = None, *,
                 delays: Sequence[int] | None = DELAYS, alphas: Sequence[float] = ALPHAS, n_iter: int = 20, gammas: np.ndarray | None = None,
                 solver: str = "random_search", n_chunks: int | None = None, force_banded: bool = False, centre_y: bool = True,
                 missing: str = "error", max_iter: int = 10, partition_cols: Sequence[str] = ("run",), seed: int = 0) -> Encoding:
    """Fit x(run, t, x[]) to y(run, t, target, y) with inner folds (fold, run, is_val).

    Without spaces one shared weight is used. With spaces the primal form serves more samples
    than features (or when forced), kernels otherwise, for every solver; ``primal_coef`` gives feature weights of either. ``max_iter`` is the number of gradient steps. Counts and means are small collects.
    """
    if solver not in SOLVERS:
        raise ValueError(f"no solver {solver!r}; registered are {sorted(SOLVERS)}")
    stats = x.agg(F.count(F.lit(1)).alias("n"), vector_mean(F.col("x")).alias("m")).first()
    single = not spaces
    bands = [("all", 0, len(stats["m"]))] if single else list(spaces)
    wide_x, wide = delayed_features(x, stats["m"], delays, bands, partition_cols=partition_cols)
    if gammas is None:
        gammas = np.ones((1, 1)) if single else random_gammas(n_iter, [b[0] for b in bands], seed)
    banded = single or stats["n"] > len(stats["m"]) or force_banded
    data, fit = SOLVERS[solver](wide_x, y, folds, wide, banded=banded, gammas=np.asarray(gammas, float), alphas=alphas,
                                max_iter=max_iter, n_chunks=n_chunks, centre_y=centre_y, missing=missing)
    kind = "ridge" if single else "banded" if banded else "kernel"
    return Encoding(fit, kind, list(stats["m"]), tuple(delays) if delays is not None else None, wide, data)


def primal_coef(model: Encoding, x: DataFrame) -> DataFrame:
    """Feature weights of a model; kernels need their training features ``x`` (undelayed)."""
    if model.kind != "kernel":
        return model.fit.coef
    n = len(model.delays) if model.delays else 1
    narrow, at = [], 0
    for name, start, end in model.spaces:
        narrow.append((name, at, at + (end - start) // n))
        at = narrow[-1][2]
    wide_x, _ = delayed_features(x, model.mean, model.delays, narrow)
    return model.data.primal(model.fit, wide_x)


def transform(model: Encoding, x: DataFrame, spaces: Sequence[tuple[str, int, int]] | None = None) -> DataFrame:
    """New features through the training means and delays."""
    bands = list(spaces) if spaces else [("all", 0, len(model.mean))]
    return delayed_features(x, model.mean, model.delays, bands)[0]
