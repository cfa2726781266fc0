"""Cross-validated ridge for tables too wide for their sums of products: Lanczos steps, one pass over the rows each.

A system is one feature scaling with one set of training runs. Its matrix A = S X'X S is never made: a step multiplies
the current vectors of all systems and targets by A in one pass over the rows, v -> S X'(X S v). For every right-hand side the steps build a
tridiagonal matrix T that stands for A, and since A + alpha I has the same vectors with T + alpha I, one run of steps serves all
penalties. Solutions are combinations of the stored vectors; steps end when the residuals of all targets and penalties, which follow
from T alone, are below ``tol`` of the right-hand sides.

Rows stay where they are. The vectors of a pass go to all tasks, so targets are taken in passes whose vectors stay below PASS_BYTES.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sigframe.functions.arrays import vector_sum
from sigframe.plans.gram import CHUNK_TARGETS, cross, pack_targets
from sigframe.plans.ridge import Fit, choose, delta_table, fold_list, scale_of, with_features
from sigframe.session import arrow_rows, written

#: Vectors of one pass (sent to every task), those of one target chunk over all steps (held by one task), and rows held at a time.
PASS_BYTES, BASIS_BYTES, ROW_BYTES = 256 << 20, 512 << 20, 32 << 20
MAX_STEPS = 200
FULL = -1


@dataclass(frozen=True)
class System:
    """A scaling and the runs it is trained and validated on."""

    gamma_id: int
    fold: int
    scale: np.ndarray
    train: frozenset
    val: frozenset


def tridiagonal(alpha: np.ndarray, beta: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """First columns of the inverses of T + shift, (shifts, targets, steps); alpha and beta are (steps, targets)."""
    steps, width = alpha.shape
    t = np.zeros((width, steps, steps))
    i = np.arange(steps)
    t[:, i, i] = alpha.T
    t[:, i[1:], i[:-1]] = t[:, i[:-1], i[1:]] = beta[:-1].T
    whole = t[None] + np.broadcast_to(shifts, (len(shifts), width))[:, :, None, None] * np.eye(steps)
    first = np.zeros((steps, 1))
    first[0] = 1
    return np.linalg.solve(whole, np.broadcast_to(first, (*whole.shape[:2], steps, 1)))[..., 0]


class Wide:
    """Rows, cross sums and folds of one data set, and the search over scalings and penalties."""

    def __init__(self, x: DataFrame, y: DataFrame, folds: DataFrame, spaces: Sequence[tuple[str, int, int]], *, run_col: str = "run",
                 t_col: str = "t", n_chunks: int | None = None, centre_y: bool = True, missing: str = "error", tol: float = 1e-10):
        self.spark, self.spaces, self.run_col, self.tol = x.sparkSession, list(spaces), run_col, tol
        self.folds, self.centre_y = fold_list(folds, run_col), centre_y
        self.width = max(end for _, _, end in spaces)
        self.x = written(x.select(run_col, t_col, F.col("x").cast("array<double>").alias("x")), "features")
        sums = self.x.groupBy(run_col).agg(F.count(F.lit(1)).alias("n"), vector_sum(F.col("x")).alias("s")).collect()
        self.sums = {r[run_col]: (r["n"], np.asarray(r["s"])) for r in sums}
        self.y, self.t_col, self.missing, self.n_chunks = y, t_col, missing, n_chunks

    def _prepare(self, n_systems: int, n_shifts: int) -> None:
        """Cross sums in chunks of targets that fit a pass and a task."""
        most = min(CHUNK_TARGETS, PASS_BYTES // (8 * self.width * n_systems * n_shifts), BASIS_BYTES // (8 * self.width * MAX_STEPS))
        if most < 1:
            raise ValueError(f"{n_systems} systems of {self.width} features and {n_shifts} penalties exceed a pass; search fewer at once")
        targets = self.y.select("target").distinct().count()
        n_chunks = max(self.n_chunks or 1, -(-targets // most))
        packed, names = pack_targets(self.y, keys=(self.run_col, self.t_col), n_chunks=n_chunks, missing=self.missing, samples=self.x)
        joined = with_features(packed, self.x, [self.run_col, self.t_col]).withColumnRenamed(self.run_col, "key")
        with arrow_rows(self.spark, ROW_BYTES // (8 * self.width)):
            self.crosses = written(cross(joined, ["key", "chunk"]).join(names, "chunk").select("chunk", "key", "width", "n", "values", "targets"), "cross")
        chunks = [r["chunk"] for r in self.crosses.select("chunk").distinct().orderBy("chunk").collect()]
        per_pass = max(1, PASS_BYTES // (8 * self.width * n_systems * n_shifts * most))
        self.passes = [chunks[i:i + per_pass] for i in range(0, len(chunks), per_pass)]

    def _reader(self):
        sums, centre = self.sums, self.centre_y

        def read(pdf: pd.DataFrame):
            """Centred cross sums by run, target names and means of a chunk."""
            crosses = {k: np.asarray(v).reshape(-1, w) for k, v, w in zip(pdf["key"], pdf["values"], pdf["width"])}
            for k, n in zip(pdf["key"], pdf["n"]):
                if n != sums[k][0]:
                    raise ValueError(f"{k}: {sums[k][0]} samples have features and {n} of them responses; drop or complete the others")
            mean = sum(c[0] for c in crosses.values()) / sum(n for n, _ in sums.values()) if centre else np.zeros(next(iter(crosses.values())).shape[1])
            out = {}
            for k, c in crosses.items():
                n, s = sums[k]
                out[k] = np.vstack([c[1:-1] - s[:, None] * mean, c[-1] - 2 * mean * c[0] + n * mean * mean])
            return out, list(pdf["targets"].iloc[0]), mean

        return read

    def _product(self, vectors: dict[tuple[int, int], np.ndarray], systems: Sequence[System]) -> DataFrame:
        """(sys, chunk, values): S X'(X S v) of every system and chunk, summed over the training rows."""
        held, run_col = self.spark.sparkContext.broadcast((vectors, {i: (s.scale[:, None], s.train) for i, s in enumerate(systems)})), self.run_col

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            vs, known = held.value
            acc, beside = {}, {}
            for pdf in batches:
                for run, part in pdf.groupby(run_col, sort=False):
                    keys = [k for k in vs if run in known[k[0]][1]]
                    if not keys:
                        continue
                    if run not in beside:
                        beside = {run: np.hstack([known[k[0]][0] * vs[k] for k in keys])}  # the vectors of one run at a time
                    x = np.stack(part["x"].to_numpy())
                    w, at = x.T @ (x @ beside[run]), 0
                    for k in keys:
                        n = vs[k].shape[1]
                        acc[k] = acc[k] + w[:, at:at + n] if k in acc else w[:, at:at + n].copy()
                        at += n
            for k, w in acc.items():
                yield pd.DataFrame([(*k, (known[k[0]][0] * w).ravel())], columns=["sys", "chunk", "values"])

        return self.x.select(run_col, "x").mapInPandas(add, "sys int, chunk int, values array<double>").groupBy("sys", "chunk").agg(vector_sum(F.col("values")).alias("values"))

    def _lanczos(self, systems: Sequence[System], chunks: Sequence[int], shifts: np.ndarray) -> DataFrame:
        """All steps of all systems: (sys, chunk, step, v, alpha, beta, norm), stored step by step."""
        read, width = self._reader(), self.width
        state = "sys int, chunk int, step int, prev array<double>, v array<double>, alpha array<double>, beta array<double>, norm array<double>"

        def begin(pdf: pd.DataFrame) -> pd.DataFrame:
            crosses, _, _ = read(pdf)
            rows = []
            for i, s in enumerate(systems):
                b = s.scale[:, None] * sum(crosses[k][:-1] for k in s.train)
                norm = np.sqrt((b * b).sum(axis=0))
                v = np.divide(b, norm, out=np.zeros_like(b), where=norm > 0)
                rows.append((i, pdf["chunk"].iloc[0], 0, np.zeros(b.size), v.ravel(), np.zeros(len(norm)), np.zeros(len(norm)), norm))
            return pd.DataFrame(rows, columns=[c.split()[0] for c in state.split(", ")])

        def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = []
                for r in pdf.itertuples():
                    v, prev, w = (np.asarray(a).reshape(width, -1) for a in (r.v, r.prev, r.values))
                    w = w - np.asarray(r.beta) * prev
                    alpha = (w * v).sum(axis=0)
                    w = w - alpha * v
                    beta = np.sqrt((w * w).sum(axis=0))
                    on = beta > 1e-13 * np.maximum(np.abs(alpha), 1e-300)  # else the vectors span all there is
                    beta = np.where(on, beta, 0.0)
                    after = np.divide(w, beta, out=np.zeros_like(w), where=on)
                    rows.append((r.sys, r.chunk, r.step + 1, v.ravel(), after.ravel(), alpha, beta, r.norm))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in state.split(", ")])

        own = self.crosses.where(F.col("chunk").isin(list(chunks)))
        now = written(own.groupBy("chunk").applyInPandas(begin, state), "step")
        stored, seen = [], {}
        for _ in range(MAX_STEPS):
            vectors = {(r["sys"], r["chunk"]): np.asarray(r["v"]).reshape(width, -1) for r in now.select("sys", "chunk", "v").collect()}
            with arrow_rows(self.spark, ROW_BYTES // (8 * width)):
                sums = written(self._product(vectors, systems), "product")
            now = written(now.join(sums, ["sys", "chunk"]).select(*now.columns, "values").mapInPandas(step, state), "step")
            stored.append(now)
            done = True
            for r in now.select("sys", "chunk", "alpha", "beta").collect():
                alpha, beta = seen.setdefault((r["sys"], r["chunk"]), ([], []))
                alpha.append(r["alpha"])
                beta.append(r["beta"])
                last = np.abs(tridiagonal(np.array(alpha), np.array(beta), shifts[:, None])[..., -1] * np.array(beta)[-1])
                done &= bool((last <= self.tol).all())
            if done:
                out = stored[0]
                for s in stored[1:]:
                    out = out.unionAll(s)
                return out
        raise ValueError(f"no solution to {self.tol} of the right-hand side after {MAX_STEPS} steps; use larger penalties or a looser tol")

    def search(self, gammas: np.ndarray, alphas: Sequence[float], *, local_alpha: bool = True) -> Fit:
        """As ``ridge.Banded.search``. Penalties must be above zero."""
        alphas, gammas = np.asarray(alphas, float), np.asarray(gammas, float)
        if (alphas <= 0).any():
            raise ValueError("penalties of a wide model must be above zero")
        runs = frozenset(self.sums)
        systems = [System(g, f, scale_of(self.spaces, gamma), frozenset(fold.train_x), frozenset(fold.val_x))
                   for g, gamma in enumerate(gammas) for f, fold in enumerate(self.folds)]
        self._prepare(len(systems), len(alphas))
        parts = [self._losses(systems, chunks, alphas) for chunks in self.passes]
        scored = parts[0]
        for p in parts[1:]:
            scored = scored.unionAll(p)
        choice, per_gamma = choose(written(scored, "scores"), local_alpha)
        choice = written(choice, "choice")
        full = [System(g, FULL, scale_of(self.spaces, gamma), runs, frozenset()) for g, gamma in enumerate(gammas)]
        used = {r["gamma_id"] for r in choice.select("gamma_id").distinct().collect()}
        coef = [self._refit([s for s in full if s.gamma_id in used], chunks, choice, alphas) for chunks in self.passes]
        out = coef[0]
        for c in coef[1:]:
            out = out.unionAll(c)
        return Fit(written(out, "coef"), delta_table(self.spark, self.spaces, gammas, choice), choice, per_gamma.select("gamma_id", "target", "score"))

    def refine(self, fit: Fit, **options):
        raise ValueError("refinement needs sums of products or kernels; reduce the features of a wide model first")

    def _losses(self, systems: Sequence[System], chunks: Sequence[int], alphas: np.ndarray) -> DataFrame:
        """(gamma_id, target, alpha, score): mean over folds of the negative squared error."""
        read, width, run_col = self._reader(), self.width, self.run_col
        states = self._lanczos(systems, chunks, alphas)
        rows = {k: n for k, (n, _) in self.sums.items()}
        kind = self.crosses.schema["targets"].dataType.elementType.simpleString()

        def solve(state: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            crosses, _, _ = read(own)
            s = systems[int(state["sys"].iloc[0])]
            b = combined(state, width, alphas[:, None]) * s.scale[None, :, None]
            c = sum(crosses[k] for k in s.val)
            known = c[-1] - 2 * np.einsum("apt,pt->at", b, c[:-1])
            return pd.DataFrame([(state["sys"].iloc[0], state["chunk"].iloc[0], b.ravel(), known.ravel())], columns=["sys", "chunk", "b", "known"])

        each = self.crosses.where(F.col("chunk").isin(list(chunks)))
        ids = F.explode(F.sequence(F.lit(0), F.lit(len(systems) - 1))).alias("sys")
        own = each.select("*", ids)
        solved = written(states.groupBy("sys", "chunk").cogroup(own.groupBy("sys", "chunk")).applyInPandas(
            solve, "sys int, chunk int, b array<double>, known array<double>"), "solved")
        weights = {(r["sys"], r["chunk"]): np.asarray(r["b"]).reshape(len(alphas), width, -1) for r in solved.select("sys", "chunk", "b").collect()}
        held = self.spark.sparkContext.broadcast(weights)

        def squares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            acc: dict = {}
            for pdf in batches:
                for run, part in pdf.groupby(run_col, sort=False):
                    x = np.stack(part["x"].to_numpy())
                    for k, b in held.value.items():
                        if run in systems[k[0]].val:
                            acc[k] = acc.get(k, 0) + np.stack([((x @ own_b) ** 2).sum(axis=0) for own_b in b])
            for k, a in acc.items():
                yield pd.DataFrame([(*k, a.ravel())], columns=["sys", "chunk", "values"])

        with arrow_rows(self.spark, ROW_BYTES // (8 * width)):
            fit = written(self.x.select(run_col, "x").mapInPandas(squares, "sys int, chunk int, values array<double>").groupBy("sys", "chunk").agg(
                vector_sum(F.col("values")).alias("values")), "squares")
        names = each.groupBy("chunk").agg(F.first("targets").alias("targets"))

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for r in pdf.itertuples():
                    s, n = systems[r.sys], len(r.targets)
                    loss = -(np.asarray(r.known) + np.asarray(r.values)).reshape(len(alphas), n) / sum(rows[k] for k in s.val)
                    yield pd.DataFrame({"gamma_id": s.gamma_id, "fold": s.fold, "target": np.repeat(list(r.targets), len(alphas)),
                                        "alpha": np.tile(alphas, n), "score": loss.T.ravel()})

        both = solved.select("sys", "chunk", "known").join(fit, ["sys", "chunk"]).join(names, "chunk").select("sys", "chunk", "known", "values", "targets")
        each_fold = both.mapInPandas(score, f"gamma_id int, fold int, target {kind}, alpha double, score double")
        return written(each_fold.groupBy("gamma_id", "target", "alpha").agg(F.avg("score").alias("score")), "losses")

    def _refit(self, systems: Sequence[System], chunks: Sequence[int], choice: DataFrame, alphas: np.ndarray) -> DataFrame:
        """(target, coef, mean) of the chunks' targets on all rows, each with its own scaling and penalty."""
        read, width = self._reader(), self.width
        states = self._lanczos(systems, chunks, alphas)
        own = self.crosses.where(F.col("chunk").isin(list(chunks)))
        picked = own.select("chunk", F.explode("targets").alias("target")).distinct().join(choice, "target")
        picks = picked.groupBy("chunk").agg(F.collect_list(F.struct("target", "gamma_id", "alpha")).alias("picks"))
        ids = F.explode(F.sequence(F.lit(0), F.lit(len(systems) - 1))).alias("sys")
        kind = self.crosses.schema["targets"].dataType.elementType.simpleString()

        def solve(state: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
            _, targets, mean = read(side)
            s = systems[int(state["sys"].iloc[0])]
            want = {p["target"]: (p["gamma_id"], p["alpha"]) for p in side["picks"].iloc[0]}
            b = combined(state, width, np.array([[want[t][1] for t in targets]]))[0] * s.scale[:, None]
            return pd.DataFrame([(t, b[:, j], mean[j]) for j, t in enumerate(targets) if want[t][0] == s.gamma_id], columns=["target", "coef", "mean"])

        side = own.join(picks, "chunk").select("*", ids)
        return written(states.groupBy("sys", "chunk").cogroup(side.groupBy("sys", "chunk")).applyInPandas(solve, f"target {kind}, coef array<double>, mean double"), "coef")


def combined(state: pd.DataFrame, width: int, shifts: np.ndarray) -> np.ndarray:
    """Solutions (shifts, features, targets) from the stored steps of one system and chunk: step k's ``prev`` is its k-th vector."""
    state = state.sort_values("step")
    alpha, beta, norm = np.stack(state["alpha"]), np.stack(state["beta"]), np.asarray(state["norm"].iloc[0])
    parts = tridiagonal(alpha, beta, shifts) * norm[None, :, None]
    out = np.zeros((len(parts), width, len(norm)))
    for k, v in enumerate(state["prev"]):
        out += parts[:, None, :, k] * np.asarray(v).reshape(width, -1)[None]
    return out
