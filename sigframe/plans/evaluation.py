"""Scores, shares of feature spaces, predictions and residuals of a model on new rows, in blocks of targets.

Responses stay packed: a row meets a chunk of targets as one array, predictions are a matrix product inside a task, and a task sends
sums per target. No table has a row for each sample and target.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sigframe.plans.gram import pack_targets
from sigframe.plans.ridge import with_features
from sigframe.session import written

#: Bytes of features and responses that a task holds at a time.
BLOCK_BYTES = 64 << 20


@dataclass(frozen=True)
class Evaluation:
    """Lazy results over stored blocks; each frame is one pass.

    ``rows`` is (keys, chunk, y[], x[]), ``weights`` (chunk, coef[][], mean[]), ``targets`` (chunk, targets[]) in the order of the arrays.
    """

    rows: DataFrame
    weights: DataFrame
    targets: DataFrame
    keys: tuple
    spaces: tuple
    groups: int

    def _products(self, make: Callable, schema: str) -> DataFrame:
        """``make(rows, y, parts, mean)`` for every block; ``parts`` are the products of the spaces."""
        group = F.pmod(F.xxhash64(*self.keys), F.lit(self.groups)).cast("int")
        right = self.weights.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(self.groups - 1))))
        spaces, empty = self.spaces, self.rows.sparkSession.createDataFrame([], schema).columns

        def block(rows: pd.DataFrame, weights: pd.DataFrame) -> pd.DataFrame:
            if rows.empty or weights.empty:
                return pd.DataFrame(columns=empty)
            w, mean = np.stack([np.asarray(c, float) for c in weights["coef"].iloc[0]]), np.asarray(weights["mean"].iloc[0], float)
            x, y = np.stack(rows["x"]).astype(float), np.stack(rows["y"]).astype(float)
            return make(rows, y, [x[:, a:b] @ w[:, a:b].T for _, a, b in spaces], mean)

        return self.rows.withColumn("part", group).groupBy("part", "chunk").cogroup(right.groupBy("part", "chunk")).applyInPandas(block, schema)

    @cached_property
    def _sums(self) -> DataFrame:
        """(chunk, place, space, n and averages) of responses and predictions less the mean of the training responses, stored."""
        names = [s[0] for s in self.spaces]

        def add(rows: pd.DataFrame, y: np.ndarray, parts: list, mean: np.ndarray) -> pd.DataFrame:
            y, p = y - mean, np.sum(parts, axis=0)
            own = dict(chunk=int(rows["chunk"].iloc[0]), place=np.arange(y.shape[1]), n=len(y), y=y.sum(0), p=p.sum(0), yy=(y * y).sum(0), pp=(p * p).sum(0), yp=(y * p).sum(0))
            return pd.concat([pd.DataFrame({**own, "space": s, "k": q.sum(0), "ky": (q * y).sum(0), "kp": (q * p).sum(0)}) for s, q in zip(names, parts)])

        columns = ("y", "p", "yy", "pp", "yp", "k", "ky", "kp")
        sums = self._products(add, "chunk int, place int, n long, " + ", ".join(f"{c} double" for c in columns[:5]) + ", space string, k double, ky double, kp double")
        total = sums.groupBy("chunk", "place", "space").agg(F.sum("n").alias("n"), *[(F.sum(c) / F.sum("n")).alias(c) for c in columns])
        named = self.targets.select("chunk", F.posexplode("targets").alias("place", "target"))
        return written(total.join(named, ["chunk", "place"]), "sums").withColumns({
            "vy": F.col("yy") - F.col("y") * F.col("y"), "vp": F.col("pp") - F.col("p") * F.col("p")})

    @property
    def scores(self) -> DataFrame:
        """(target, correlation, r2, n); the correlation with a constant is 0, r2 of a constant response is NULL."""
        c = F.try_divide(F.col("yp") - F.col("y") * F.col("p"), F.sqrt(F.col("vy") * F.col("vp")))
        error = F.col("yy") - 2 * F.col("yp") + F.col("pp")
        return self._sums.where(F.col("space") == self.spaces[0][0]).select("target", F.coalesce(c, F.lit(0.0)).alias("correlation"), (1 - F.try_divide(error, "vy")).alias("r2"), "n")

    @property
    def shares(self) -> DataFrame:
        """(target, space, r2, correlation): parts of the scores that add up to them; the constant part is shared out evenly."""
        k, m = len(self.spaces), F.col("y")
        r2 = 2 * F.col("ky") - F.col("kp") - m * F.col("k") - m / k * (m - F.col("p"))
        c = F.try_divide(F.col("ky") - m * F.col("k"), F.sqrt(F.col("vy") * F.col("vp")))
        return self._sums.select("target", "space", F.coalesce(F.try_divide(r2, "vy"), F.lit(0.0)).alias("r2"), F.coalesce(c, F.lit(0.0)).alias("correlation"))

    @property
    def blocks(self) -> DataFrame:
        """(keys, chunk, prediction[], residual[]) in the order of ``targets``."""
        keys = list(self.keys)

        def give(rows: pd.DataFrame, y: np.ndarray, parts: list, mean: np.ndarray) -> pd.DataFrame:
            p = np.sum(parts, axis=0) + mean
            return rows[[*keys, "chunk"]].assign(prediction=list(p), residual=list(y - p))

        ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in self.rows.select(*keys).schema)
        return self._products(give, ddl + "chunk int, prediction array<double>, residual array<double>")


def evaluate(x: DataFrame, y: DataFrame, coef: DataFrame, *, spaces: Sequence[tuple[str, int, int]] | None = None,
             keys: Sequence[str] = ("run", "t"), n_chunks: int | None = None, missing: str = "error") -> Evaluation:
    """Everything about a model (target, coef[], mean) on features x(keys, x[]) and responses y(keys, target, y).

    Targets without weights, samples without features and (unless ``missing="zero"``) samples that lack a response are errors; weights of
    targets without responses are left out. Without ``mean`` it is 0. Without spaces all features are one, ``all``.
    """
    packed, targets = pack_targets(y, keys=keys, n_chunks=n_chunks, missing=missing)
    targets = written(targets, "targets")
    first = coef.select(F.size("coef").alias("p")).first()
    if first is None:
        raise ValueError("there are no weights")
    bands = tuple(spaces) if spaces else (("all", 0, first["p"]),)
    mean = F.col("mean") if "mean" in coef.columns else F.lit(0.0)
    told = F.concat_ws(" ", F.lit("no weights for the target"), F.col("target").cast("string"))
    places = targets.select("chunk", F.posexplode("targets").alias("place", "target"))
    found = places.join(coef.select("target", "coef", mean.cast("double").alias("mean")), "target", "left").withColumn(
        "coef", F.coalesce("coef", F.raise_error(told).cast(coef.schema["coef"].dataType)))
    cells = found.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("place", "coef", "mean"))).alias("c"))
    weights = written(cells.select("chunk", F.col("c.coef").alias("coef"), F.col("c.mean").alias("mean")), "weights")
    rows = with_features(packed, x, keys)
    width = targets.agg(F.max(F.size("targets"))).scalar()
    groups = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) * 8 * (first["p"] + 2 * width * (1 + len(bands))) / BLOCK_BYTES))
    return Evaluation(rows, weights, targets, tuple(keys), bands, int(x.agg(groups.alias("g")).first()["g"]))
