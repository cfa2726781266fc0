"""Multiple-kernel ridge for tables with more features than samples.

A linear kernel is the Gram matrix of the transposed table, so the same summing job builds
one n x n matrix per feature space, reading features as rows. Samples are few here by
definition of the case.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from sigframe.plans import gram as sums
from sigframe.plans.gram import collect_gram, cross, gram, pack_targets
from sigframe.plans.ridge import EVERYTHING, Fit, choose, delta_table, descent, refine_start, sample_keys, side_averages
from sigframe.session import written


@dataclass(frozen=True)
class Split:
    """Responses (by key) and samples on both sides of a fold."""

    train_key: str
    train: np.ndarray
    val_key: str
    val: np.ndarray


class Kernels:
    """Kernels of one data set and the search over their weights."""

    def __init__(self, x: DataFrame, y: DataFrame, folds: DataFrame, spaces: Sequence[tuple[str, int, int]], *,
                 run_col: str = "run", t_col: str = "t", n_chunks: int | None = None, centre_y: bool = True, missing: str = "error"):
        sides: dict = {}
        for r in folds.where("is_val").select("fold", run_col).collect():
            sides.setdefault(r["fold"], set()).add(r[run_col])
        x = self._kernels(x, spaces, [run_col, t_col], [run_col])
        runs = np.repeat(np.array([k[0] for k, _ in self.runs]), [n for _, n in self.runs])
        inside = [np.isin(runs, sorted(sides[f])) for f in sorted(sides)]
        self.splits = [Split(EVERYTHING, ~v, EVERYTHING, v) for v in inside]
        self._responses(y.withColumn("key", F.lit(EVERYTHING)), [run_col, t_col], n_chunks, centre_y, missing, x.withColumn("key", F.lit(EVERYTHING)))

    def _kernels(self, x: DataFrame, spaces: Sequence[tuple[str, int, int]], at: Sequence[str], run: Sequence[str]) -> DataFrame:
        """Numbers the samples, run after run, and sums the kernels; the stored features come back."""
        self.spark, self.spaces, self.at = x.sparkSession, list(spaces), list(at)
        x = written(x, "features")
        # samples are numbered within runs; starts of runs follow from their sizes
        sizes = x.groupBy(*run).agg(F.count(F.lit(1)).alias("n"))
        self.runs = sorted((tuple(r[c] for c in run), r["n"]) for r in sizes.collect())
        n = sum(size for _, size in self.runs)
        if 8 * n * n * len(spaces) > sums.MAX_DRIVER_BYTES:
            raise ValueError(f"kernels of {n} samples need {8 * n * n * len(spaces) / 2**30:.1f} GiB; use the banded form")
        ends = np.cumsum([0] + [size for _, size in self.runs]).tolist()
        schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in x.select(*run).schema)
        starts = self.spark.createDataFrame([(*k, s) for (k, _), s in zip(self.runs, ends)], f"{schema}start long")
        within = F.row_number().over(Window.partitionBy(*run).orderBy(*[c for c in at if c not in run])) - 1
        numbered = x.select(*at, within.alias("i"))
        numbered = numbered.join(F.broadcast(starts), list(run)) if run else numbered.withColumn("start", F.lit(0))  # a row a run
        self.place = written(numbered.select(*at, (F.col("i") + F.col("start")).cast("int").alias("i")), "rows")
        space = F.coalesce(*[F.when((F.col("j") >= s) & (F.col("j") < e), F.lit(name)) for name, s, e in self.spaces])
        cells = x.join(self.place, list(at)).select("i", F.posexplode("x").alias("j", "v"))
        cols = cells.groupBy("j").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("c")).select(
            space.alias("space"), F.col("c.v").alias("x"))
        grams = collect_gram(gram(cols, ["space"]), ["space"])
        self.kernels = self.spark.sparkContext.broadcast([grams[(name,)][1:, 1:] for name, _, _ in self.spaces])  # checked above
        self.n_samples = n
        return x

    def _responses(self, y: DataFrame, at: Sequence[str], n_chunks: int | None, centre_y: bool, missing: str, samples: DataFrame | None) -> None:
        packed, names = pack_targets(y, keys=("key", *at), n_chunks=n_chunks, missing=missing, samples=samples)
        self.y = written(packed.join(self.place, list(at)).join(names, "chunk").select("chunk", "key", "i", "y", "targets"), "responses")
        self.centre = centre_y

    def _reader(self):
        n_samples, centre = self.n_samples, self.centre

        def read(pdf: pd.DataFrame):
            """Responses of a chunk by key (samples x targets), less the mean over all; target names; that mean."""
            out = {}
            for key, part in pdf.groupby("key", sort=False):
                part = part.sort_values("i")
                if len(part) != n_samples:
                    raise ValueError(f"{n_samples} samples have features and {len(part)} responses; drop or complete the others")
                out[key] = np.stack(part["y"].to_numpy()).astype(float)
            mean = out[EVERYTHING].mean(0) if centre else np.zeros(out[EVERYTHING].shape[1])
            return {k: v - mean for k, v in out.items()}, list(pdf["targets"].iloc[0]), mean

        return read

    def _kind(self) -> str:
        return self.y.schema["targets"].dataType.elementType.simpleString()

    def search(self, gammas: np.ndarray, alphas: Sequence[float], *, local_alpha: bool = True) -> Fit:
        kernels, splits, alphas, read, kind = self.kernels, self.splits, np.asarray(alphas, float), self._reader(), self._kind()

        def losses(pdf: pd.DataFrame) -> pd.DataFrame:
            y, targets, _ = read(pdf)
            g = int(pdf["gamma_id"].iloc[0])
            k = sum(w * m for w, m in zip(gammas[g], kernels.value))
            score = np.zeros((len(splits), len(alphas), len(targets)))
            factors: dict = {}
            for f, s in enumerate(splits):
                same = s.train.tobytes()  # sides of group-level folds have the same samples
                if same not in factors:
                    factors = {same: np.linalg.eigh(k[np.ix_(s.train, s.train)])}
                w, u = factors[same]
                z, turn = u.T @ y[s.train_key][s.train], k[np.ix_(s.val, s.train)] @ u
                for a, alpha in enumerate(alphas):
                    miss = y[s.val_key][s.val] - turn @ (z / (np.maximum(w, 0) + alpha)[:, None])
                    score[f, a] = -(miss ** 2).mean(0)
            s = score.mean(0)
            return pd.DataFrame({
                "gamma_id": g, "target": np.repeat(targets, len(alphas)), "alpha": np.tile(alphas, len(targets)), "score": s.T.ravel()})

        ids = F.explode(F.sequence(F.lit(0), F.lit(len(gammas) - 1))).alias("gamma_id")
        scored = written(self.y.select("*", ids).groupBy("gamma_id", "chunk").applyInPandas(
            losses, f"gamma_id int, target {kind}, alpha double, score double"), "scores")
        choice, per_gamma = choose(scored, local_alpha)
        choice = written(choice, "choice")
        picks = self.y.select("chunk", F.explode("targets").alias("target")).distinct().join(choice, "target").groupBy("chunk").agg(
            F.collect_list(F.struct("target", "gamma_id", "alpha")).alias("picks"))

        def solve(pdf: pd.DataFrame) -> pd.DataFrame:
            y, targets, mean = read(pdf)
            want = {p["target"]: (p["gamma_id"], p["alpha"]) for p in pdf["picks"].iloc[0]}
            out = []
            for pair in sorted(set(want.values())):  # targets with equal weights share a solution of many columns
                k = sum(w * m for w, m in zip(gammas[pair[0]], kernels.value))
                mine = [j for j, t in enumerate(targets) if want[t] == pair]
                dual = np.linalg.solve(k + pair[1] * np.eye(len(k)), y[EVERYTHING][:, mine])
                out += [(targets[j], dual[:, n], mean[j]) for n, j in enumerate(mine)]
            return pd.DataFrame(out, columns=["target", "coef", "mean"])

        dual = self.y.where(F.col("key") == EVERYTHING).join(picks, "chunk").groupBy("chunk").applyInPandas(solve, f"target {kind}, coef array<double>, mean double")
        return Fit(written(dual, "dual"), delta_table(self.spark, self.spaces, gammas, choice), choice, per_gamma.select("gamma_id", "target", "score"))

    def refine(self, fit: Fit, *, top_percentile: float | None = None, max_iter: int = 10, tol: float = 1e-3,
               limit: float = 20.0) -> tuple[DataFrame, DataFrame]:
        """Gradient descent of each target's log weights in the dual; options and results as ``ridge.Banded.refine``.

        With K = sum of exp(delta_k) K_k and a penalty of one, w = (K + I)^-1 y on the training side and u = (K + I)^-1 K' e for the errors e
        of the other side; the slope of the loss in delta_k is -2 exp(delta_k) (e' K_k w - u' K_k w) / n. Targets that start from
        equal weights share the factor of their first step. ``coef`` are dual weights in the scale of ``fit`` (over its penalty), so
        ``primal`` takes them.
        """
        packed, mask = refine_start(fit, self.spaces, top_percentile, limit)
        owned = self.y.select("chunk", F.explode("targets").alias("target")).distinct().join(packed, "target").join(fit.choice.select("target", "alpha"), "target")
        jobs = owned.groupBy("chunk").agg(F.collect_list(F.struct("target", "deltas", "alpha")).alias("jobs"))
        kernels, splits, read, kind = self.kernels, self.splits, self._reader(), self._kind()

        def descend(pdf: pd.DataFrame) -> pd.DataFrame:
            y, targets, mean = read(pdf)
            eye, held = np.eye(len(kernels.value[0])), {}

            def inverse(deltas: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                """K and (K_tt + I)^-1, kept for the last weights of each side."""
                key = train.tobytes()
                if key not in held or held[key][0] != tuple(deltas):
                    k = sum(np.exp(d) * m for d, m in zip(deltas, kernels.value))
                    held[key] = (tuple(deltas), k, np.linalg.inv(k[np.ix_(train, train)] + eye[np.ix_(train, train)]))
                return held[key][1:]

            def loss_and_slope(j: int, deltas: np.ndarray) -> tuple[float, np.ndarray]:
                loss, slope = 0.0, np.zeros(len(deltas))
                for s in splits:
                    k, inv = inverse(deltas, s.train)
                    w = inv @ y[s.train_key][s.train, j]
                    miss = y[s.val_key][s.val, j] - k[np.ix_(s.val, s.train)] @ w
                    u = inv @ (k[np.ix_(s.train, s.val)] @ miss)
                    loss += (miss ** 2).mean()
                    for i, m in enumerate(kernels.value):
                        slope[i] -= 2 * np.exp(deltas[i]) * (miss @ (m[np.ix_(s.val, s.train)] @ w) - u @ (m[np.ix_(s.train, s.train)] @ w)) / len(miss)
                return loss / len(splits), slope / len(splits)

            out = []
            for job in sorted(pdf["jobs"].iloc[0], key=lambda p: tuple(p["deltas"])):
                j = targets.index(job["target"])
                deltas, first, loss = descent(lambda d: loss_and_slope(j, d), np.array(job["deltas"], float), max_iter, tol, limit)
                _, inv = inverse(deltas, np.ones(len(eye), bool))
                out.append((job["target"], inv @ y[EVERYTHING][:, j] / job["alpha"], mean[j], deltas, first, loss))
            return pd.DataFrame(out, columns=["target", "coef", "mean", "deltas", "start_loss", "loss"])

        refined = self.y.join(jobs, "chunk").groupBy("chunk").applyInPandas(
            descend, f"target {kind}, coef array<double>, mean double, deltas array<double>, start_loss double, loss double")
        return refined, mask

    def primal(self, fit: Fit, x: DataFrame, *, run_col: str = "run", t_col: str = "t") -> DataFrame:
        """(target, coef[]) on the features: gamma_k X_k' dual, a product of sample rows in chunks of targets."""
        at, kind = self.at, fit.coef.schema["target"].dataType.simpleString()
        dual = fit.coef.select("target", F.posexplode("coef").alias("i", "y"))
        packed, names = pack_targets(dual, keys=("i",))
        rows = packed.join(x.join(self.place, at).select("i", "x"), "i")
        sums_ = cross(rows, ["chunk"])
        deltas = fit.deltas.join(fit.choice, "target").select("target", F.struct("space", (F.exp("delta") * F.col("alpha")).alias("g")).alias("g"))
        weights = names.select("chunk", F.explode("targets").alias("target")).join(deltas, "target").groupBy("chunk", "target").agg(F.collect_list("g").alias("g"))
        weights = weights.join(fit.coef.select("target", "mean"), "target").groupBy("chunk").agg(F.collect_list(F.struct("target", "g", "mean")).alias("weights"))
        spaces = self.spaces

        def scaled(batches):
            for pdf in batches:
                for r in pdf.itertuples():
                    products = np.asarray(r.values).reshape(-1, r.width)[1:-1]
                    place, rows_ = {t: j for j, t in enumerate(r.targets)}, []
                    for w in r.weights:
                        g = {s["space"]: s["g"] for s in w["g"]}
                        coef = products[:, place[w["target"]]].copy()
                        for name, start, end in spaces:
                            coef[start:end] *= g[name]
                        rows_.append((w["target"], coef, w["mean"]))
                    yield pd.DataFrame(rows_, columns=["target", "coef", "mean"])

        both = sums_.join(names, "chunk").join(weights, "chunk").select("width", "values", "targets", "weights")
        return both.mapInPandas(scaled, f"target {kind}, coef array<double>, mean double")


class GroupKernels(Kernels):
    """Kernels shared by all subjects; folds split subjects, and responses are averaged over the subjects of each side.

    Both sides of a fold have all samples, so a scaling is decomposed once for all folds. Samples are told apart as in
    ``ridge.prepare_group``.
    """

    def __init__(self, x: DataFrame, y: DataFrame, folds: DataFrame, spaces: Sequence[tuple[str, int, int]], *,
                 subject_col: str = "subject", t_col: str = "t", n_chunks: int | None = None, centre_y: bool = True, missing: str = "error"):
        at = sample_keys(x, y, t_col)
        averaged = side_averages(y, folds, at, subject_col)
        self._kernels(x, spaces, at, at[:-1])
        everything = np.ones(self.n_samples, bool)
        ids = sorted(r["fold"] for r in folds.select("fold").distinct().collect())
        self.splits = [Split(f"{i}-train", everything, f"{i}-val", everything) for i in ids]
        self._responses(averaged, at, n_chunks, centre_y, missing, None)
