"""Ridge, kernels, decompositions, inference and streams against NumPy."""

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigframe.operators import folds as fold_ops, inference
from sigframe.plans import decomposition, encoding, gram, ridge
from sigframe.plans.kernel import GroupKernels, Kernels
from sigframe.session import shared_dir
from sigframe.sources.models import load_model, save_model
from sigframe.streaming import run as stream, state, timers, windows


def problem(spark, n=60, p=6, targets=5, runs=3, seed=0, noise=0.5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p))
    y = x @ rng.normal(size=(p, targets)) + noise * rng.normal(size=(n, targets))
    run = np.arange(n) * runs // n
    xs = spark.createDataFrame([(int(r), i, [float(v) for v in row]) for i, (r, row) in enumerate(zip(run, x))], "run int, t int, x array<double>")
    ys = spark.createDataFrame(
        [(int(run[i]), i, f"v{j}", float(y[i, j])) for i in range(n) for j in range(targets)], "run int, t int, target string, y double")
    folds = fold_ops.leave_runs_out(spark.createDataFrame([(i,) for i in range(runs)], "run int"), runs, 1)
    return x, y, run, xs, ys, folds


def brute(x, y, run, gammas, alphas, spaces, runs):
    y = y - y.mean(0)
    best = np.full(y.shape[1], -np.inf)
    pick = [None] * y.shape[1]
    for g, gamma in enumerate(gammas):
        s = np.concatenate([np.full(e - b, np.sqrt(w)) for (_, b, e), w in zip(spaces, gamma)])
        for alpha in sorted(alphas):
            loss = []
            for r in range(runs):
                tr, va = run != r, run == r
                xt = x[tr] * s
                b = np.linalg.solve(xt.T @ xt + alpha * np.eye(len(s)), xt.T @ y[tr])
                loss.append(-((y[va] - (x[va] * s) @ b) ** 2).mean(0))
            m = np.mean(loss, axis=0)
            for j in np.flatnonzero(m > best + 1e-12):
                best[j], pick[j] = m[j], (g, alpha)
    coef = []
    for j, (g, alpha) in enumerate(pick):
        s = np.concatenate([np.full(e - b, np.sqrt(w)) for (_, b, e), w in zip(spaces, gammas[g])])
        xs = x * s
        coef.append(s * np.linalg.solve(xs.T @ xs + alpha * np.eye(len(s)), xs.T @ y[:, j]))
    return best, pick, np.array(coef)


SPACES = [("a", 0, 2), ("b", 2, 6)]
ALPHAS = [0.1, 1.0, 10.0]


def test_banded_and_kernel_match_brute_force(spark):
    x, y, run, xs, ys, folds = problem(spark)
    gammas = ridge.random_gammas(4, ["a", "b"], seed=1)
    best, pick, coef = brute(x, y, run, gammas, ALPHAS, SPACES, 3)
    data = ridge.prepare(xs, ys, folds, SPACES, n_chunks=2)
    fit = data.search(gammas, ALPHAS)
    kern = Kernels(xs, ys, folds, SPACES, n_chunks=2)
    kfit = kern.search(gammas, ALPHAS)
    for f, weights in ((fit, fit.coef), (kfit, kern.primal(kfit, xs))):
        got = {r["target"]: r for r in f.choice.collect()}
        w = {r["target"]: np.array(r["coef"]) for r in weights.collect()}
        for j in range(y.shape[1]):
            assert (got[f"v{j}"]["gamma_id"], got[f"v{j}"]["alpha"]) == pick[j]
            assert got[f"v{j}"]["score"] == pytest.approx(best[j])
            np.testing.assert_allclose(w[f"v{j}"], coef[j], atol=1e-8)
    deltas = {(r["target"], r["space"]): r["delta"] for r in fit.deltas.collect()}
    assert deltas[("v0", "a")] == pytest.approx(np.log(gammas[pick[0][0]][0] / pick[0][1]))


def test_predictions_and_metrics(spark):
    x, y, run, xs, ys, folds = problem(spark)
    fit = ridge.prepare(xs, ys, folds, SPACES).search(np.array([[0.5, 0.5]]), ALPHAS)
    w = {r["target"]: np.array(r["coef"]) for r in fit.coef.collect()}
    pred = ridge.predict(xs, fit.coef, row_groups=3, target_groups=2)
    for r in pred.where("t = 7").collect():
        assert r["prediction"] == pytest.approx(x[7] @ w[r["target"]] + y[:, int(r["target"][1:])].mean())
    m = {r["target"]: r for r in ridge.metrics(ys, pred).collect()}
    p0 = x @ w["v0"] + y[:, 0].mean()
    assert m["v0"]["r2"] == pytest.approx(1 - ((y[:, 0] - p0) ** 2).sum() / ((y[:, 0] - y[:, 0].mean()) ** 2).sum())
    assert m["v0"]["correlation"] == pytest.approx(np.corrcoef(y[:, 0], p0)[0, 1])
    split = ridge.predict(xs, fit.coef, spaces=SPACES)
    shares = ridge.split_metrics(ys, split).groupBy("target").agg(F.sum("r2").alias("r2"), F.sum("correlation").alias("c")).collect()
    for r in shares:
        assert r["r2"] == pytest.approx(m[r["target"]]["r2"]) and r["c"] == pytest.approx(m[r["target"]]["correlation"])


def test_refinement_never_worsens_and_masks(spark):
    x, y, run, xs, ys, folds = problem(spark, noise=2.0)
    data = ridge.prepare(xs, ys, folds, SPACES)
    fit = data.search(ridge.random_gammas(3, ["a", "b"], seed=0), ALPHAS)
    refined, mask = data.refine(fit, top_percentile=60)
    rows = refined.collect()
    assert rows and all(r["loss"] <= r["start_loss"] + 1e-12 for r in rows)
    assert sum(r["refined"] for r in mask.collect()) == len(rows) == 3
    # the start equals the search score
    scores = {r["target"]: r["score"] for r in fit.choice.collect()}
    for r in rows:
        assert r["start_loss"] == pytest.approx(-scores[r["target"]], rel=1e-6)


def test_group_level(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 2))
    subs = [x @ rng.normal(size=2) + rng.normal(size=40) for _ in range(3)]
    xs = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "t int, x array<double>")
    ys = spark.createDataFrame([(s, i, "v", float(v)) for s, y in enumerate(subs) for i, v in enumerate(y)], "subject int, t int, target string, y double")
    folds = fold_ops.leave_runs_out(spark.createDataFrame([(i,) for i in range(3)], "subject int"), 3, 1, run_col="subject")
    spaces = [("all", 0, 2)]
    fit = ridge.prepare_group(xs, ys, folds, spaces).search(np.ones((1, 1)), [1.0, 50.0])
    mean = np.mean([np.mean(s) for s in subs])
    scores = []
    for alpha in (1.0, 50.0):
        loss = []
        for s in range(3):
            tr = np.mean([subs[k] - mean for k in range(3) if k != s], axis=0)
            b = np.linalg.solve(x.T @ x + alpha * np.eye(2), x.T @ tr)
            loss.append(-((subs[s] - mean - x @ b) ** 2).mean())
        scores.append(np.mean(loss))
    row = fit.choice.first()
    assert row["score"] == pytest.approx(max(scores)) and row["alpha"] == [1.0, 50.0][int(np.argmax(scores))]
    by_entry = encoding.fit_encoding(xs.withColumn("run", F.lit(0)), ys, folds, None, delays=None, alphas=[1.0, 50.0], solver="group_level_random_search")
    xc = x - x.mean(0)
    whole = np.mean([s - mean for s in subs], axis=0)
    alpha = by_entry.fit.choice.first()["alpha"]
    np.testing.assert_allclose(by_entry.fit.coef.first()["coef"], np.linalg.solve(xc.T @ xc + alpha * np.eye(2), xc.T @ whole))
    short = ys.where("not (subject = 1 and t = 3)")
    with pytest.raises(ValueError, match="equally many"):
        ridge.prepare_group(xs, short, folds, spaces)


def test_responses_keep_their_mean(spark):
    x, y, run, xs, ys, folds = problem(spark, noise=0.0)
    high = ys.withColumn("y", F.col("y") + 100)
    model = encoding.fit_encoding(xs, high, folds, SPACES, delays=None, alphas=[1e-9], n_iter=1)
    fit, xs = model.fit, encoding.transform(model, xs, SPACES)
    for r in ridge.metrics(high, ridge.predict(xs, fit.coef)).collect():
        assert r["r2"] > 0.99
    split = ridge.predict(xs, fit.coef, spaces=SPACES).groupBy("run", "t", "target").agg(F.sum("prediction").alias("s"))
    both = split.join(ridge.predict(xs, fit.coef), ["run", "t", "target"]).agg(F.max(F.abs(F.col("s") - F.col("prediction"))).alias("d")).first()
    assert both["d"] < 1e-8


@pytest.mark.parametrize("model", [ridge.prepare, Kernels])
def test_absent_responses_are_refused_or_zero(spark, model):
    x, y, run, xs, ys, folds = problem(spark)
    gammas = np.array([[0.5, 0.5]])
    gapped = ys.where("NOT (target = 'v1' AND t % 3 = 0)")
    nulls = ys.withColumn("y", F.when(~((F.col("target") == "v1") & (F.col("t") % 3 == 0)), F.col("y")))
    nans = nulls.withColumn("y", F.coalesce("y", F.lit(float("nan"))))
    for rows in (gapped, nulls, nans):
        with pytest.raises(Exception, match="responses"):
            model(xs, rows, folds, SPACES, n_chunks=2).search(gammas, ALPHAS)
    with pytest.raises(Exception, match="responses"):
        model(xs, ys.where("t <> 7"), folds, SPACES).search(gammas, ALPHAS)
    if model is ridge.prepare:
        with pytest.raises(Exception, match="no features"):
            model(xs.where("t <> 7"), ys, folds, SPACES).search(gammas, ALPHAS)
    zeros = ys.withColumn("y", F.when((F.col("target") == "v1") & (F.col("t") % 3 == 0), 0.0).when(F.col("t") == 7, 0.0).otherwise(F.col("y")))
    want = {r["target"]: r["coef"] for r in model(xs, zeros, folds, SPACES).search(gammas, ALPHAS).coef.collect()}
    got = model(xs, gapped.where("t <> 7"), folds, SPACES, n_chunks=2, missing="zero").search(gammas, ALPHAS).coef.collect()
    for r in got:
        np.testing.assert_allclose(r["coef"], want[r["target"]], atol=1e-10)
    with pytest.raises(ValueError, match="error or zero"):
        model(xs, ys, folds, SPACES, missing="mean")


def test_targets_are_chunked_by_default(spark, monkeypatch):
    x, y, run, xs, ys, folds = problem(spark, targets=9)
    one = {r["target"]: r["coef"] for r in ridge.prepare(xs, ys, folds, SPACES).search(np.array([[0.5, 0.5]]), ALPHAS).coef.collect()}
    monkeypatch.setattr(gram, "CHUNK_TARGETS", 2)
    data = ridge.prepare(xs, ys, folds, SPACES)
    assert data.crosses.select("chunk").distinct().count() > 2
    for r in data.search(np.array([[0.5, 0.5]]), ALPHAS).coef.collect():
        np.testing.assert_allclose(r["coef"], one[r["target"]])


def test_group_level_with_time_restarting_in_each_run(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(20, 2))
    subs = [x @ [1.0, 2.0] + rng.normal(size=20) for _ in range(3)]
    at = [(i // 10, i % 10) for i in range(20)]
    xs = spark.createDataFrame([(*at[i], i, [float(v) for v in x[i]]) for i in range(20)], "run int, t int, u int, x array<double>")
    ys = spark.createDataFrame([(s, *at[i], i, "v", float(subs[s][i])) for s in range(3) for i in range(20)], "subject int, run int, t int, u int, target string, y double")
    folds = fold_ops.leave_runs_out(spark.createDataFrame([(i,) for i in range(3)], "subject int"), 3, 1, run_col="subject")
    spaces, gammas = [("a", 0, 2)], np.ones((1, 1))
    by_run = ridge.prepare_group(xs.drop("u"), ys.drop("u"), folds, spaces).search(gammas, [1.0]).coef.first()["coef"]
    flat = ridge.prepare_group(xs.select(F.col("u").alias("t"), "x"), ys.select("subject", F.col("u").alias("t"), "target", "y"), folds, spaces)
    np.testing.assert_allclose(by_run, flat.search(gammas, [1.0]).coef.first()["coef"])
    with pytest.raises(ValueError, match="repeat values"):
        ridge.prepare_group(xs.drop("u", "run"), ys.drop("u"), folds, spaces)
    wide = encoding.fit_encoding(xs.drop("u").limit(1).withColumn("x", F.array_repeat(F.lit(1.0), 30)).union(xs.drop("u").withColumn(
        "x", F.concat("x", F.array_repeat(F.lit(0.5), 28))).where("NOT (run = 0 AND t = 0)")), ys.drop("u"), folds, None, delays=None, alphas=[1.0], solver="group_level_random_search")
    assert len(encoding.primal_coef(wide, xs).first()["coef"]) == 30


def test_fit_encoding_chooses_solver_and_delays(spark):
    x, y, run, xs, ys, folds = problem(spark, n=30, p=6, runs=3)
    model = encoding.fit_encoding(xs, ys, folds, SPACES, delays=[0, 1], alphas=ALPHAS, n_iter=2)
    assert model.kind == "banded" and model.spaces == [("a", 0, 4), ("b", 4, 12)]
    wide = {r["t"]: r["x"] for r in encoding.transform(model, xs, SPACES).collect()}
    xc = x - x.mean(0)
    np.testing.assert_allclose(wide[5], np.concatenate([xc[5, :2], xc[4, :2], xc[5, 2:], xc[4, 2:]]))
    assert wide[10][2:4] == [0, 0]  # first row of a run has no past
    x2, y2, run2, xs2, ys2, folds2 = problem(spark, n=12, p=20, runs=3)
    wide_spaces = [("a", 0, 8), ("b", 8, 20)]
    small = encoding.fit_encoding(xs2, ys2, folds2, wide_spaces, delays=None, alphas=ALPHAS, n_iter=2)
    forced = encoding.fit_encoding(xs2, ys2, folds2, wide_spaces, delays=None, alphas=ALPHAS, n_iter=2, force_banded=True)
    assert (small.kind, forced.kind) == ("kernel", "banded")
    a = {r["target"]: r["coef"] for r in encoding.primal_coef(small, xs2).collect()}
    b = {r["target"]: r["coef"] for r in forced.fit.coef.collect()}
    for k in a:
        np.testing.assert_allclose(a[k], b[k], atol=1e-8)
    with pytest.raises(ValueError, match="no solver"):
        encoding.fit_encoding(xs, ys, folds, SPACES, solver="none")


def test_hyper_gradient_not_worse_than_its_start(spark):
    x, y, run, xs, ys, folds = problem(spark, noise=2.0)
    model = encoding.fit_encoding(xs, ys, folds, SPACES, delays=None, alphas=ALPHAS, n_iter=5, solver="hyper_gradient")
    start = {r["target"]: r["score"] for r in model.fit.cv_scores.collect()}
    assert all(r["score"] >= start[r["target"]] - 1e-9 for r in model.fit.choice.collect())
    assert model.fit.deltas.count() == 2 * y.shape[1]


def test_model_round_trip(spark):
    _, _, _, xs, ys, folds = problem(spark)
    fit = ridge.prepare(xs, ys, folds, SPACES).search(np.array([[0.5, 0.5]]), ALPHAS)
    path = f"{shared_dir(spark)}/m"
    save_model(fit, path, "banded", delays=[1, 2])
    back, meta = load_model(spark, path)
    assert meta == {"kind": "banded", "delays": [1, 2]}
    assert sorted(map(tuple, back.coef.select("target").collect())) == sorted(map(tuple, fit.coef.select("target").collect()))
    with pytest.raises(ValueError):
        save_model(fit, path, "forest")


def test_gram_is_blocked_and_size_checked(spark, monkeypatch):
    x, _, _, xs, _, _ = problem(spark)
    g = gram.collect_gram(gram.gram(xs.repartition(5), [], block=3), [])[()]
    z = np.hstack([np.ones((len(x), 1)), x])
    np.testing.assert_allclose(g, z.T @ z)
    monkeypatch.setattr(gram, "MAX_DRIVER_BYTES", 10)
    with pytest.raises(ValueError, match="Gram"):
        gram.collect_gram(gram.gram(xs, []), [])


def test_pca_against_svd_and_incremental(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 8)) * np.array([5, 3, 2, 1, .5, .2, .1, .05]) + 7
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, x array<double>")
    reduced, model = decomposition.fit_and_reduce(df, threshold=0.9)
    _, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    ratio = s ** 2 / (s ** 2).sum()
    assert model.k == int(np.argmax(np.cumsum(ratio) >= 0.9)) + 1
    np.testing.assert_allclose(model.ratio, ratio, atol=1e-10)
    np.testing.assert_allclose(np.abs(model.loadings @ vt[: model.k].T), np.eye(model.k), atol=1e-6)
    z = np.array([r["z"] for r in reduced.orderBy("id").collect()])
    np.testing.assert_allclose(z.var(0, ddof=1), model.variance[: model.k])
    inc = decomposition.Incremental(threshold=0.9)
    for a, b in ((0, 30), (30, 31), (31, 200)):
        inc.partial_fit(df.where((F.col("id") >= a) & (F.col("id") < b)))
    np.testing.assert_allclose(inc.model.loadings, model.loadings, atol=1e-8)
    assert decomposition.components_for([0.5, 0.2], 0.95) == 2
    full = decomposition.fit_and_reduce(df, n_components=8)
    back = np.array([r["x"] for r in decomposition.restore(*full).orderBy("id").collect()])
    np.testing.assert_allclose(back, x, atol=1e-8)


def test_fit_reduce_or_load(spark):
    df = spark.createDataFrame([(i, [float(i), float(i * i % 7), 1.0]) for i in range(20)], "id int, x array<double>")
    path = f"{shared_dir(spark)}/p"
    with pytest.raises(FileNotFoundError):
        decomposition.load(spark, path)
    _, first = decomposition.fit_reduce_or_load(df, path, n_components=2)
    _, again = decomposition.fit_reduce_or_load(df, path, n_components=1)
    assert again.k == 2
    np.testing.assert_allclose(first.loadings, again.loadings)
    _, forced = decomposition.fit_reduce_or_load(df, path, n_components=1, force_refit=True)
    assert forced.k == 1
    assert decomposition.info(spark, forced).where("selected").count() == 1


# -- inference -------------------------------------------------------------------------------------

def test_correlation_edges(spark):
    df = spark.createDataFrame([("c", 1.0, 2.0), ("c", 1.0, 3.0), ("n", 1.0, None), ("n", 2.0, 4.0), ("n", 3.0, 6.0)], "g string, x double, y double")
    got = {r["g"]: r["r"] for r in inference.array_correlation(df, "x", "y", ["g"]).collect()}
    assert got["c"] == 0 and got["n"] == pytest.approx(1)


@pytest.mark.parametrize("method", ["permutation", "choice", "swap"])
def test_random_indices(spark, method):
    a = sorted(map(tuple, inference.random_indices(spark, 6, 5, method, seed=1).collect()))
    assert a == sorted(map(tuple, inference.random_indices(spark, 6, 5, method, seed=1).collect()))
    assert all(0 <= r[2] < 6 for r in a)
    if method == "permutation":
        for p in range(5):
            assert sorted(r[2] for r in a if r[0] == p) == list(range(6))
    if method == "choice":
        assert len(a) == 5
    with pytest.raises(ValueError):
        inference.random_indices(spark, 6, 5, "bootstrap")


@pytest.mark.parametrize("block_rows", [7, 10, 64])
def test_timeshift_matches_roll(spark, block_rows):
    rng = np.random.default_rng(6)
    n = 30
    y, p = rng.normal(size=(2, n)), rng.normal(size=(2, n))
    df = spark.createDataFrame([(f"v{j}", i, float(y[j, i]), float(p[j, i])) for j in range(2) for i in range(n)], "target string, t int, y double, p double")
    shifts = spark.createDataFrame([(0, 0), (1, 1), (2, 13), (3, 29), (4, 13)], "perm int, shift int")
    out = {(r["perm"], r["target"]): r["stat"] for r in inference.timeshift_permutation(df, shifts, n_rows=n, block_rows=block_rows, target_groups=3).collect()}
    assert len(out) == 10
    for perm, s in ((0, 0), (1, 1), (2, 13), (3, 29), (4, 13)):
        for j in range(2):
            assert out[(perm, f"v{j}")] == pytest.approx(np.corrcoef(np.roll(y[j], s), p[j])[0, 1])


def test_p_from_null_sides_and_ties(spark):
    null = spark.createDataFrame([(i, "a", float(v)) for i, v in enumerate([-2, -1, 0, 1, 2])], "perm int, target string, stat double")
    obs = spark.createDataFrame([("a", 1.0)], "target string, stat double")
    p = lambda **k: inference.p_from_null(obs, null, **k).first()["p"]
    assert p() == pytest.approx(5 / 6) and p(side="right") == pytest.approx(3 / 6) and p(side="left") == pytest.approx(5 / 6)
    assert p(side="right", exact=True) == pytest.approx(2 / 5)
    with pytest.raises(ValueError):
        p(side="up")
    assert p(side="right", adjust="bonferroni") == pytest.approx(0.5)
    flat = null.withColumn("stat", F.lit(0.0))
    assert inference.p_from_null(obs, flat).first()["z"] == float("inf")


def adjusted(p, method):
    m, order = len(p), np.argsort(p)
    s = np.asarray(p)[order]
    rank = np.arange(1, m + 1)
    if method == "holm":
        a = np.maximum.accumulate(s * (m - rank + 1))
    elif method == "holm-sidak":
        a = np.maximum.accumulate(1 - (1 - s) ** (m - rank + 1))
    elif method == "simes-hochberg":
        a = np.minimum.accumulate((s * (m - rank + 1))[::-1])[::-1]
    else:
        c = 1.0 if method == "fdr_bh" else (1 / rank).sum()
        a = np.minimum.accumulate((s * m * c / rank)[::-1])[::-1]
    out = np.empty(m)
    out[order] = np.minimum(a, 1)
    return out


@pytest.mark.parametrize("method", ["holm", "holm-sidak", "simes-hochberg", "fdr_bh", "fdr_by"])
def test_adjust_p_with_ties_and_many_values(spark, method):
    rng = np.random.default_rng(7)
    p = np.concatenate([rng.uniform(size=200), [0.01] * 100, rng.uniform(size=50) ** 8, [1.0, 1e-12]])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)], "i int, p double")
    got = np.array([r["p_adj"] for r in inference.adjust_p(df, method).orderBy("i").collect()])
    np.testing.assert_allclose(got, adjusted(p, method), rtol=1e-9, atol=1e-12)


def test_p_threshold_masks_every_failure(spark):
    df = spark.createDataFrame([(1.0, 0.5), (2.0, 0.01), (3.0, None), (4.0, float("nan")), (5.0, 0.05)], "v double, p double")
    got = [r["x"] for r in df.select("v", inference.p_threshold(F.col("v"), F.col("p")).alias("x")).orderBy("v").collect()]
    assert got == [None, 2.0, None, None, None]


def test_missing_p_values_and_draws_do_not_count(spark):
    p = spark.createDataFrame([(1, 0.01), (2, float("nan")), (3, 0.5), (4, None)], "i int, p double")
    got = {r["i"]: r["p_adj"] for r in inference.adjust_p(p, "bonferroni").collect()}
    assert got == {1: 0.02, 2: None, 3: 1.0, 4: None}
    observed = spark.createDataFrame([("a", 1.0), ("b", None)], "target string, stat double")
    null = spark.createDataFrame([(1, "a", 0.5), (2, "a", None), (3, "a", 2.0), (4, "a", float("nan")), (1, "b", 1.0)], "perm int, target string, stat double")
    got = {r["target"]: r["p"] for r in inference.p_from_null(observed, null).collect()}
    assert got == {"a": pytest.approx(2 / 3), "b": None}
    pairs = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (float("nan"), 9.0), (3.0, 6.0), (8.0, None)], "x double, y double")
    assert pairs.agg(inference.correlation(F.col("x"), F.col("y")).alias("r")).first()["r"] == pytest.approx(1)
    m = spark.createDataFrame([(float(i),) for i in (1, 2, 10, 256, 257, 5000)], "m double")
    for r in m.select("m", inference.harmonic(F.col("m")).alias("h")).collect():
        assert r["h"] == pytest.approx(sum(1 / i for i in range(1, int(r["m"]) + 1)), rel=1e-12)


# -- streams -------------------------------------------------------------------------------------------

def event_files(spark, n_files=6):
    """Rows of two runs in files that are out of order, with a late row in each."""
    import time

    base = shared_dir(spark)
    rows = [("a", i, float(i)) for i in range(40)] + [("b", i, float(100 + i)) for i in range(10)]
    dealt = [sorted(rows, key=lambda r: (-r[1], r[0]))[k::n_files] for k in range(n_files)]
    for part in dealt:
        df = spark.createDataFrame(part, "run string, s int, value double").select("run", F.timestamp_seconds(F.col("s") + 1_000_000_000).alias("ts"), "value")
        df.coalesce(1).write.mode("append").parquet(f"{base}/in")
        time.sleep(0.02)
    return f"{base}/in"


@pytest.mark.parametrize("files_per_trigger", [1, 3, 1000])
def test_lags_do_not_depend_on_batches(spark, files_per_trigger):
    s, finish = stream.replay(spark, event_files(spark), "*.parquet", "ts", files_per_trigger)
    out = stream.drain(state.lagged(s, [1, 5], late="1 hour"), finish=finish)
    got = {(r["run"], r["t"]): (r["value_d1"], r["value_d5"]) for r in out.withColumn("t", F.unix_seconds("ts") - 1_000_000_000).collect()}
    assert len(got) == 50
    for (run, t), (d1, d5) in got.items():
        first = 0 if run == "a" else 100
        assert d1 == (first + t - 1 if t >= 1 else 0) and d5 == (first + t - 5 if t >= 5 else 0)


def test_a_run_waits_in_an_entry_for_each_bucket(spark):
    """Lags of a run reach over pauses and over buckets with fewer rows than the longest lag."""
    base = shared_dir(spark)
    s, finish = stream.replay(spark, event_files(spark), "*.parquet", "ts", 3)
    some = s.where("run is null or unix_seconds(ts) % 7 < 2 or unix_seconds(ts) % 20 < 6")
    lags = state.lagged(some, [1, 5], late="1 hour", bucket="2 seconds")
    entries = []
    for end in (finish, None):
        q = lags.start(base, f"{base}/checkpoint")
        q.awaitTermination()
        entries += [o.numRowsTotal for p in q.recentProgress for o in p.stateOperators]
        if end:
            end()
    there = {run: [i for i in range(n) if (1_000_000_000 + i) % 7 < 2 or i % 20 < 6] for run, n in (("a", 40), ("b", 10))}
    assert max(entries) == sum(len({i // 2 for i in at}) for at in there.values()) + 1  # the row that ends the replay
    plan = lags.rows._jdf.queryExecution().analyzed().toString()
    assert "Python" not in plan and "Pandas" not in plan
    got = {(r["run"], r["t"]): (r["value_d1"], r["value_d5"]) for r in spark.read.parquet(f"{base}/out").withColumn("t", F.unix_seconds("ts") - 1_000_000_000).collect()}
    value = lambda run, k: (0 if run == "a" else 100) + there[run][k] if k >= 0 else 0
    assert got == {(run, t): (value(run, k - 1), value(run, k - 5)) for run, at in there.items() for k, t in enumerate(at)}


def test_lags_of_odd_rows(spark):
    """Rows without run are a run, equal times go by the carried column, missing values stay, and a row without time is dropped."""
    base = shared_dir(spark)
    rows = [("a", 5, 1, None), ("a", 5, 0, 1.0), ("a", 9, 2, float("nan")), ("a", 7200, 3, 4.0), (None, 5, 4, 2.0), (None, 7200, 5, 3.0), ("a", None, 6, 9.0)]
    df = spark.createDataFrame(rows, "run string, s int, id int, value double").select("run", F.timestamp_seconds("s").alias("ts"), "id", "value")
    df.coalesce(1).write.parquet(f"{base}/in")
    s, finish = stream.replay(spark, f"{base}/in", "*.parquet", "ts")
    out = stream.drain(state.lagged(s, [0, 1, 2], late="0 seconds", carry=["id"]), finish=finish)
    assert out.columns == ["run", "ts", "value", "id", "value_d0", "value_d1", "value_d2"]
    got = {r["id"]: (str(r["value_d0"]), str(r["value_d1"]), str(r["value_d2"])) for r in out.collect()}
    assert got == {0: ("1.0", "0.0", "0.0"), 1: ("None", "1.0", "0.0"), 2: ("nan", "None", "1.0"), 3: ("4.0", "nan", "None"),
                   4: ("2.0", "0.0", "0.0"), 5: ("3.0", "2.0", "0.0")}
    with pytest.raises(ValueError, match="later values"):
        state.lagged(s, [-1, 1], late="0 seconds")


def test_a_repeated_batch_of_lags_does_not_count_twice(spark):
    base = shared_dir(spark)
    s, _ = stream.replay(spark, event_files(spark), "*.parquet", "ts")
    lags = state.lagged(s, [1, 2], late="1 hour")
    batch = lambda lo, hi: spark.range(lo, hi).select(
        F.lit("a").alias("run"), F.timestamp_seconds(F.floor(F.col("id") / 2)).alias("_bucket"), (F.col("id") % 2).cast("int").alias("_pos"),
        F.timestamp_seconds("id").alias("ts"), F.col("id").cast("double").alias("value"))
    got = []
    for batch_id, (lo, hi) in enumerate([(0, 4), (4, 4), (4, 6), (6, 8)]):
        for _again in range(2):
            out = lags.step(batch(lo, hi), batch_id, base).orderBy("ts").collect()
        got += [(r["value"], r["value_d1"], r["value_d2"]) for r in out]
    assert got == [(float(i), float(max(i - 1, 0)), float(max(i - 2, 0))) for i in range(8)]


def test_query_of_lags_agrees_with_its_sql_where_values_are_missing(spark):
    import duckdb

    from sigframe.workload import load

    base = shared_dir(spark)
    rows = [(i, 1_000_000_000 + 1000 * i, "a", None if i % 3 == 1 else float(i)) for i in range(20)]
    events = spark.createDataFrame(rows, "event_id long, s int, event_type string, value double")
    events = events.withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz")).drop("s")
    events.coalesce(1).write.parquet(f"{base}/events.parquet")
    made, sql = (x["st5_lagged"] for x in load()[:2])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{base}/events.parquet/*.parquet'")
    want = {tuple(r) for r in con.execute(sql).fetchall()}
    assert {tuple(r) for r in made(spark, base).collect()} == want and len(want) == 20


@pytest.mark.parametrize("files_per_trigger", [1, 3, 1000])
def test_windows_are_complete_for_any_batches(spark, files_per_trigger):
    s, finish = stream.replay(spark, event_files(spark), "*.parquet", "ts", files_per_trigger)
    out = stream.drain(windows.tumbling_features(s, width="10 seconds", late="1 hour"), finish=finish).collect()
    assert {(r["run"], int(r["value"])): r["n"] for r in out} == {("a", 4): 10, ("a", 14): 10, ("a", 24): 10, ("a", 34): 10, ("b", 104): 10}


def test_late_rows_are_told(spark):
    folder = event_files(spark)
    late = lambda: windows.tumbling_features(spark.readStream.schema("run string, ts timestamp, value double").option(
        "maxFilesPerTrigger", 1).parquet(folder), width="1 second", late="0 seconds")
    with pytest.raises(ValueError, match="later than the stream allows"):
        stream.drain(late())
    assert stream.drain(late(), allow_late=True).count() > 0


@pytest.mark.parametrize("files_per_trigger", [1, 3, 1000])
def test_grid_lags_of_a_run_in_several_keys(spark, files_per_trigger):
    """Runs of 40 and 10 points in keys of eight, a lag that crosses a key's border, and pauses."""
    s, finish = stream.replay(spark, event_files(spark), "*.parquet", "ts", files_per_trigger)
    some = s.where("run is null or not (run = 'a' and unix_seconds(ts) % 7 = 3)")
    with timers.rocksdb(spark):
        out = stream.drain(timers.lagged_grid(some, [1, 5], period="1 second", late="1 hour", key_rows=8, bucket_rows=4), finish=finish)
    got = {(r["run"], r["t"]): (r["value"], r["value_d1"], r["value_d5"]) for r in out.withColumn("t", F.unix_seconds("ts") - 1_000_000_000).collect()}
    there = {("a", i): float(i) for i in range(40) if (1_000_000_000 + i) % 7 != 3} | {("b", i): float(100 + i) for i in range(10)}
    assert got == {(run, t): (v, there.get((run, t - 1), 0.0), there.get((run, t - 5), 0.0)) for (run, t), v in there.items()}


@pytest.mark.parametrize("files_per_trigger", [1, 3, 1000])
def test_stream_cuts_keep_their_distance(spark, files_per_trigger):
    s, finish = stream.replay(spark, event_files(spark), "*.parquet", "ts", files_per_trigger)
    some = s.where("run is null or unix_seconds(ts) % 3 < 2")
    with timers.rocksdb(spark):
        out = stream.drain(timers.spaced_cuts(some, "4 seconds", late="1 hour", bucket="7 seconds"), finish=finish)
    want = set()
    for run, n in (("a", 40), ("b", 10)):
        last = None
        for t in range(n):
            if (1_000_000_000 + t) % 3 < 2 and (last is None or t - last >= 4):
                last = t
                want.add((run, t))
    rows = out.select("run", (F.unix_seconds("ts") - 1_000_000_000).alias("t")).collect()
    assert len(rows) == len(want) and {(r["run"], r["t"]) for r in rows} == want


def test_grid_points_are_sums_and_missing_values_stay(spark):
    base = shared_dir(spark)
    rows = [("a", 100, 1.0), ("a", 100, 2.0), ("a", 101, None), ("a", 102, 4.0), (None, 101, 9.0), ("a", None, 9.0)]
    df = spark.createDataFrame(rows, "run string, s int, value double").select("run", F.timestamp_seconds("s").alias("ts"), "value")
    df.coalesce(1).write.parquet(f"{base}/in")
    s, finish = stream.replay(spark, f"{base}/in", "*.parquet", "ts")
    with timers.rocksdb(spark):
        out = stream.drain(timers.lagged_grid(s, [1], period="1 second", late="0 seconds", key_rows=4, bucket_rows=2), finish=finish)
    got = {r["t"]: (r["value"], r["value_d1"]) for r in out.withColumn("t", F.unix_seconds("ts")).collect()}
    assert got == {100: (3.0, 0.0), 101: (None, 3.0), 102: (4.0, None)}
    for wrong in (dict(period="0 seconds"), dict(period="1 second", key_rows=3), dict(period="1 second", key_rows=1024, delays=[2000])):
        with pytest.raises(ValueError):
            timers.lagged_grid(s, wrong.pop("delays", [1]), late="0 seconds", **wrong)


def test_stream_moments_are_idempotent(spark):
    base = shared_dir(spark)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(40, 3))
    for k in range(2):
        spark.createDataFrame([([float(v) for v in r],) for r in x[k * 20:(k + 1) * 20]], "x array<double>").coalesce(1).write.mode("append").parquet(f"{base}/in")
    read = lambda: spark.readStream.schema("x array<double>").option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    state.write_moments(read(), f"{base}/sums", f"{base}/c1").awaitTermination()
    state.write_moments(read(), f"{base}/sums", f"{base}/c2").awaitTermination()  # replays the same batch ids
    s = state.read_moments(spark, f"{base}/sums")
    assert s.n == 40
    np.testing.assert_allclose(s.scatter, np.cov(x.T) * 39, atol=1e-9)


def test_streams_read_tables_that_are_folders(spark):
    """A table may be one file or a folder of part files; other tables beside it are not read."""
    base = shared_dir(spark)
    spark.range(10).repartition(3).write.parquet(f"{base}/t.parquet")
    spark.range(50, 53).write.parquet(f"{base}/u.parquet")
    for path in (base, f"{base}/"):
        for pattern in ("t.parquet", "t.par*"):
            out = stream.drain(stream.read_files(spark, path, pattern))
            assert sorted(r["id"] for r in out.collect()) == list(range(10))
    assert stream.drain(stream.read_files(spark, base, "*.parquet")).count() == 13
    part = next(f.rsplit("/", 1)[1] for f in spark.read.parquet(f"{base}/u.parquet").inputFiles())
    assert 0 < stream.drain(stream.read_files(spark, f"{base}/u.parquet", part)).count() <= 3


def test_a_task_decomposes_a_scaling_and_fold_once(monkeypatch):
    rng = np.random.default_rng(4)
    z = {k: np.hstack([np.ones((9, 1)), rng.normal(size=(9, 3))]) for k in "abc"}
    grams = {k: v.T @ v for k, v in z.items()}
    crosses = [{k: np.vstack([v.T @ y, (y * y).sum(0)]) for k, v in z.items() for y in [rng.normal(size=(9, 2))]} for _ in range(4)]
    folds = [ridge.Fold(("a", "b"), ("a", "b"), ("c",), ("c",)), ridge.Fold(("b", "c"), ("b", "c"), ("a",), ("a",))]
    scales, alphas = [np.ones(3), np.array([1.0, 0.5, 0.1])], np.array([0.1, 10.0])
    losses = lambda factors: [ridge._cv_losses(grams, c, folds, s, alphas, g, factors) for g, s in enumerate(scales) for c in crosses]
    once, again = ridge.Factors(), ridge.Factors()
    kept = losses(once)
    assert once.made == len(scales) * len(folds)
    monkeypatch.setattr(ridge, "FACTOR_BYTES", 0)
    np.testing.assert_array_equal(kept, losses(again))
    assert again.made == len(scales) * len(folds) * len(crosses)


def test_evaluation_in_blocks(spark, monkeypatch):
    """Scores, shares and blocks of many small blocks equal the long forms; what does not fit together is an error."""
    from sigframe.plans import evaluation

    _, _, _, xs, ys, folds = problem(spark, n=60, p=6, targets=5)
    spaces = [("a", 0, 2), ("b", 2, 6)]
    ys = ys.withColumn("y", F.col("y") + 1000)
    coef = ridge.prepare(xs, ys, folds, spaces).search(np.array([[0.5, 0.5]]), [1.0]).coef
    monkeypatch.setattr(evaluation, "BLOCK_BYTES", 1 << 10)
    found = evaluation.evaluate(xs, ys, coef, spaces=spaces, n_chunks=2)
    assert found.groups > 5
    whole, split = ridge.predict(xs, coef), ridge.predict(xs, coef, spaces=spaces)
    want = {r["target"]: (r["correlation"], r["r2"], r["n"]) for r in ridge.metrics(ys, whole).collect()}
    got = {r["target"]: (r["correlation"], r["r2"], r["n"]) for r in found.scores.collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)
    want = {(r["target"], r["space"]): (r["correlation"], r["r2"]) for r in ridge.split_metrics(ys, split).collect()}
    got = {(r["target"], r["space"]): (r["correlation"], r["r2"]) for r in found.shares.collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-8) for k in want)
    want = {(r["t"], r["target"]): r["prediction"] for r in whole.collect()}
    cells = found.blocks.join(found.targets, "chunk").collect()
    got = {(r["t"], n): p for r in cells for n, p in zip(r["targets"], r["prediction"])}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
    assert all(abs(e) < 1e3 for r in cells for e in r["residual"])
    with pytest.raises(Exception, match="no weights for the target v0"):
        evaluation.evaluate(xs, ys, coef.where("target <> 'v0'"))
    with pytest.raises(Exception, match="no features for the responses"):
        evaluation.evaluate(xs.where("t > 0"), ys, coef).scores.collect()
    with pytest.raises(ValueError, match="no weights"):
        evaluation.evaluate(xs, ys, coef.limit(0))


# -- wide tables ---------------------------------------------------------------------------------------------------

def test_wide_ridge_equals_the_direct_solution(spark, monkeypatch):
    """More features than samples in a fold, several passes and chunks, shared and own penalties, gaps refused."""
    from sigframe.plans import wide

    _, _, _, xs, ys, folds = problem(spark, n=15, p=12, targets=4, seed=3)
    spaces, gammas, alphas = [("a", 0, 8), ("b", 8, 12)], np.array([[0.5, 0.5], [0.9, 0.1]]), [1.0, 30.0]
    direct = ridge.prepare(xs, ys, folds, spaces)
    monkeypatch.setattr(wide, "PASS_BYTES", 8 * 12 * 6 * 2 * 2)
    rows = lambda df: {r["target"]: r for r in df.collect()}
    data = ridge.prepare(xs, ys, folds, spaces, limit=0)
    want, got = direct.search(gammas, alphas), data.search(gammas, alphas)
    assert isinstance(data, wide.Wide) and len(data.passes) > 1
    a, b, c, d = rows(want.choice), rows(got.choice), rows(want.coef), rows(got.coef)
    for t in a:
        assert (a[t].gamma_id, a[t].alpha) == (b[t].gamma_id, b[t].alpha) and a[t].score == pytest.approx(b[t].score, rel=1e-7)
        np.testing.assert_allclose(d[t].coef, c[t].coef, atol=1e-8)
        assert d[t]["mean"] == pytest.approx(c[t]["mean"])
    deltas = lambda fit: {(r.target, r.space): round(r.delta, 9) for r in fit.deltas.collect()}
    assert deltas(got) == deltas(want)
    with pytest.raises(ValueError):
        data.search(gammas, [0.0])
    with pytest.raises(Exception, match="responses"):
        ridge.prepare(xs, ys.where("t <> 7 OR target <> 'v1'"), folds, spaces, limit=0).search(gammas, alphas)


def test_wide_components(spark):
    """More columns than rows: leading components and variances against NumPy; a threshold doubles the subspace."""
    from sigframe.plans import subspace

    rng = np.random.default_rng(2)
    n, p = 50, 120
    x = rng.normal(size=(n, 8)) * np.array([9, 7, 5, 4, 3, 2, 1, 1]) @ rng.normal(size=(8, p)) + 0.01 * rng.normal(size=(n, p)) + 5
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "i int, x array<double>").repartition(7)
    _, s, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
    model = subspace.fit_wide(df, n_components=5)
    np.testing.assert_allclose(model.variance[:5], s[:5] ** 2 / (n - 1), rtol=1e-9)
    np.testing.assert_allclose(np.abs((model.loadings * v[:5]).sum(axis=1)), 1, atol=1e-9)
    assert model.error < 1e-6 and model.loadings.shape == (5, p)
    old, subspace.OVERSAMPLE = subspace.OVERSAMPLE, -30
    try:
        few = subspace.fit_wide(df, threshold=0.99)
    finally:
        subspace.OVERSAMPLE = old
    share = np.cumsum(s ** 2) / (s ** 2).sum()
    assert few.k == int(np.argmax(share >= 0.99)) + 1
    reduced, same = decomposition.fit_and_reduce(df, n_components=5, limit=0)
    np.testing.assert_allclose(same.loadings, model.loadings, atol=1e-9)
    z = np.array([r.z for r in reduced.orderBy("i").collect()])
    np.testing.assert_allclose(np.abs(z), np.abs((x - x.mean(0)) @ v[:5].T), atol=1e-6)


def test_wide_rows_are_projected_few_at_a_time(spark, monkeypatch):
    from sigframe.plans import subspace

    monkeypatch.setattr(subspace, "ROW_BYTES", 8 * 30 * 4)  # four rows of thirty features
    folder = shared_dir(spark)
    os.makedirs(folder)

    def told(df, source, name, model, fn):
        def watched(x, m):
            open(f"{folder}/{os.getpid()}-{len(x)}-{time.time_ns()}", "w").close()
            return fn(x, m)
        return real(df, source, name, model, watched)

    real = decomposition._map_rows
    monkeypatch.setattr(decomposition, "_map_rows", told)
    x = np.random.default_rng(9).normal(size=(50, 30))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "i int, x array<double>").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    reduced, _ = decomposition.fit_and_reduce(df, n_components=30, limit=0)
    z = np.array([r.z for r in reduced.orderBy("i").collect()])
    np.testing.assert_allclose((z * z).sum(axis=1), ((x - x.mean(0)) ** 2).sum(axis=1), rtol=1e-9)
    assert max(int(f.split("-")[1]) for f in os.listdir(folder)) == 4
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


# -- kernels: groups and refinement ----------------------------------------------------------------------------------

def test_group_kernels_equal_the_primal_group_model(spark):
    rng = np.random.default_rng(8)
    n, p = 12, 20
    x = rng.normal(size=(n, p))
    xs = spark.createDataFrame([(i // 6, i % 6, [float(v) for v in r]) for i, r in enumerate(x)], "run int, t int, x array<double>")
    ys = spark.createDataFrame([(s, i // 6, i % 6, f"v{j}", float(x[i, :4].sum() * (j + 1) + rng.normal())) for s in range(4) for i in range(n) for j in range(3)],
                               "subject int, run int, t int, target string, y double")
    folds = fold_ops.leave_runs_out(spark.createDataFrame([(i,) for i in range(4)], "subject int"), 4, 1, run_col="subject")
    spaces, gammas, alphas = [("a", 0, 12), ("b", 12, 20)], np.array([[0.5, 0.5], [0.8, 0.2]]), [0.5, 5.0]
    one = ridge.prepare_group(xs, ys, folds, spaces).search(gammas, alphas)
    data = GroupKernels(xs, ys, folds, spaces)
    two = data.search(gammas, alphas)
    rows = lambda df: {r["target"]: r for r in df.collect()}
    a, b, c, d = rows(one.choice), rows(two.choice), rows(one.coef), rows(data.primal(two, xs))
    for t in a:
        assert (a[t].gamma_id, a[t].alpha) == (b[t].gamma_id, b[t].alpha) and a[t].score == pytest.approx(b[t].score)
        np.testing.assert_allclose(d[t].coef, c[t].coef, atol=1e-9)


def test_refinement_in_the_dual_takes_the_steps_of_the_primal(spark):
    _, _, _, xs, ys, folds = problem(spark, n=30, p=8, targets=4, seed=6)
    spaces, gammas, alphas = [("a", 0, 5), ("b", 5, 8)], np.array([[0.5, 0.5], [0.9, 0.1]]), [1.0, 30.0]
    primal, dual = ridge.prepare(xs, ys, folds, spaces), Kernels(xs, ys, folds, spaces, n_chunks=2)
    one, two = primal.search(gammas, alphas), dual.search(gammas, alphas)
    a = {r.target: r for r in primal.refine(one)[0].collect()}
    refined = dual.refine(two)[0]
    b = {r.target: r for r in refined.collect()}
    back = {r.target: r for r in dual.primal(ridge.with_refined(two, refined, spaces), xs).collect()}
    for t in a:
        np.testing.assert_allclose(b[t].deltas, a[t].deltas, atol=1e-6)
        assert b[t].loss == pytest.approx(a[t].loss) and b[t].loss <= b[t].start_loss
        np.testing.assert_allclose(back[t].coef, a[t].coef, atol=1e-7)


@pytest.mark.parametrize("n,rows", [(50, 7), (48, 12), (10, 100), (9, 1)])
def test_metrics_of_shifted_and_permuted_blocks(spark, n, rows):
    """Every shift, also where the last block is short and the series wraps around; several keys; sums of blocks against whole series."""
    rng = np.random.default_rng(n)
    y, p = rng.normal(size=(2, 2, n))
    df = spark.createDataFrame([(f"v{j}", t, float(y[j, t]), float(p[j, t]), t // 5, t % 5) for j in range(2) for t in range(n)], "target string, t int, y double, p double, block int, offset int")
    shifts = spark.createDataFrame([(i, s) for i, s in enumerate([*range(n), n + 3, -2])], "perm int, shift long")
    got = {(r.perm, r.target): r.stat for r in inference.timeshift_metric(df, shifts, inference.MEAN_SQUARED_ERROR, n_rows=n, block_rows=rows).collect()}
    assert len(got) == 2 * (n + 2)
    for i, s in enumerate([*range(n), n + 3, -2]):
        for j in range(2):
            assert got[(i, f"v{j}")] == pytest.approx(((np.roll(y[j], s) - p[j]) ** 2).mean())
    if n % 5 == 0:
        order = rng.permutation(n // 5)
        perms = spark.createDataFrame([(0, b, int(o)) for b, o in enumerate(order)], "perm int, b1 int, b2 int")
        for r in inference.block_metric(df, perms, inference.MEAN_ABSOLUTE_ERROR).collect():
            j = int(r.target[1])
            assert r.stat == pytest.approx(abs(y[j].reshape(-1, 5)[order].ravel() - p[j]).mean())
