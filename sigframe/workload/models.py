"""Queries on ridge models, decompositions and streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from sigframe.functions.arrays import dot
from sigframe.operators import bands, events as stimulus, folds as fold_ops
from sigframe.plans import decomposition, encoding, evaluation, ridge
from sigframe.plans.kernel import GroupKernels, Kernels
from sigframe.session import shared_dir, written
from sigframe.sources.models import load_model, save_model
from sigframe.streaming import run as stream, state, timers, windows as stream_windows
from sigframe.workload.base import SAMPLES_SQL, event_seconds, regular_sql, samples, series
from sigframe.workload.registry import query, table

# -- hourly responses of five series to the view and click series one hour before, weeks as runs -----------

ALPHAS = [1e6, 1e7, 1e8]
GAMMAS = np.array([[0.5, 0.5], [0.9, 0.1], [0.1, 0.9]])
TWO = [("view", 0, 1), ("click", 1, 2)]


def features(spark, d, names=("view", "click")) -> DataFrame:
    """Stored once per query: the plans read their inputs more than once."""
    s = series(spark, d)
    wide = s.groupBy("t").agg(*[F.max(F.when(F.col("run") == n, F.col("value"))).alias(n) for n in names])
    from sigframe.operators.windows import delay

    lagged = delay(wide, [1], list(names), partition_cols=[])
    x = lagged.select((F.floor(F.col("t") / 168)).cast("int").alias("run"), "t", *[F.col(f"{n}_d1").alias(n) for n in names])
    return written(bands.centre_on_train(x, F.lit(True), list(names)).select("run", "t", F.array(*names).alias("x")))


def responses(spark, d) -> DataFrame:
    return written(series(spark, d).select(F.floor(F.col("t") / 168).cast("int").alias("run"), "t", F.col("run").alias("target"), F.col("value").alias("y")))


def run_folds(y: DataFrame) -> DataFrame:
    return fold_ops.leave_runs_out(y.select("run").distinct(), 5, 1)


_DATA = f"""{regular_sql()}, wide AS (SELECT t, max(value) FILTER (WHERE run = 'view') AS view, max(value) FILTER (WHERE run = 'click') AS click FROM series GROUP BY t),
lagx AS (SELECT t, coalesce(lag(view) OVER (ORDER BY t), 0) AS x1, coalesce(lag(click) OVER (ORDER BY t), 0) AS x2 FROM wide),
x AS (SELECT t, x1 - avg(x1) OVER () AS x1, x2 - avg(x2) OVER () AS x2 FROM lagx),
y AS (SELECT run AS target, t, value - avg(value) OVER (PARTITION BY run) AS y FROM series),
s AS (SELECT target, t // 168 AS run, sum(x1 * x1) AS g11, sum(x1 * x2) AS g12, sum(x2 * x2) AS g22, sum(x1 * y) AS c1, sum(x2 * y) AS c2, sum(y * y) AS yy, count(*) AS n FROM x JOIN y USING (t) GROUP BY 1, 2),
tot AS (SELECT target, sum(g11) AS g11, sum(g12) AS g12, sum(g22) AS g22, sum(c1) AS c1, sum(c2) AS c2 FROM s GROUP BY 1),
tr AS (SELECT s.*, tot.g11 - s.g11 AS t11, tot.g12 - s.g12 AS t12, tot.g22 - s.g22 AS t22, tot.c1 - s.c1 AS d1, tot.c2 - s.c2 AS d2 FROM s JOIN tot USING (target)),
al AS (SELECT unnest([1e6, 1e7, 1e8]) AS alpha)"""
_ONE = f"""{_DATA}, b1 AS (SELECT tr.*, alpha, d1 / (t11 + alpha) AS b FROM tr, al),
l1 AS (SELECT target, alpha, avg(-(yy - 2 * b * c1 + b * b * g11) / n) AS score FROM b1 GROUP BY 1, 2),
best AS (SELECT DISTINCT ON (target) target, alpha, score FROM l1 ORDER BY target, score DESC, alpha)"""
_TWO = f"""{_DATA}, ga AS (SELECT * FROM (VALUES (0, 0.5, 0.5), (1, 0.9, 0.1), (2, 0.1, 0.9)) v(gamma_id, ga, gb)),
p AS (SELECT tr.*, gamma_id, alpha, t11 + alpha / ga AS a11, t22 + alpha / gb AS a22 FROM tr, al, ga),
b2 AS (SELECT *, (a22 * d1 - t12 * d2) / (a11 * a22 - t12 * t12) AS u, (a11 * d2 - t12 * d1) / (a11 * a22 - t12 * t12) AS v FROM p),
l2 AS (SELECT target, gamma_id, alpha, avg(-(yy - 2 * (u * c1 + v * c2) + u * u * g11 + 2 * u * v * g12 + v * v * g22) / n) AS score FROM b2 GROUP BY 1, 2, 3),
best AS (SELECT DISTINCT ON (target) target, gamma_id, alpha, score FROM l2 ORDER BY target, score DESC, gamma_id, alpha),
f AS (SELECT best.*, ga, gb, g11 + alpha / ga AS a11, g22 + alpha / gb AS a22, g12, c1, c2 FROM best JOIN ga USING (gamma_id) JOIN tot USING (target)),
w AS (SELECT *, (a22 * c1 - g12 * c2) / (a11 * a22 - g12 * g12) AS u, (a11 * c2 - g12 * c1) / (a11 * a22 - g12 * g12) AS v FROM f)"""


def one_feature(spark, d) -> ridge.Fit:
    x, y = features(spark, d, ("view",)), responses(spark, d)
    return ridge.prepare(x, y, run_folds(y), [("view", 0, 1)], n_chunks=2).search(np.ones((1, 1)), ALPHAS)


def two_spaces(spark, d) -> tuple[DataFrame, DataFrame, ridge.Fit]:
    """Features, responses and the fit on two feature spaces."""
    x, y = features(spark, d), responses(spark, d)
    return x, y, ridge.prepare(x, y, run_folds(y), TWO, n_chunks=2).search(GAMMAS, ALPHAS)


@query("m1_ridge_single_feature", f"WITH {_ONE} SELECT target, alpha, round(score, 3) AS score, round(c1 / (g11 + alpha), 9) AS coef FROM best JOIN tot USING (target)")
def m1_ridge_single_feature(spark, d):
    fit = one_feature(spark, d)
    return fit.choice.join(fit.coef, "target").select("target", "alpha", F.round("score", 3).alias("score"), F.round(F.get("coef", F.lit(0)), 9).alias("coef"))


@query("m1_shared_alpha", f"WITH {_ONE}, sh AS (SELECT alpha FROM l1 GROUP BY alpha ORDER BY avg(score) DESC, alpha LIMIT 1) SELECT target, alpha, round(score, 3) AS score FROM l1 JOIN sh USING (alpha)")
def m1_shared_alpha(spark, d):
    x, y = features(spark, d, ("view",)), responses(spark, d)
    data = ridge.prepare(x, y, run_folds(y), [("view", 0, 1)], n_chunks=3)
    fit = data.search(np.ones((1, 1)), ALPHAS, local_alpha=False)
    return fit.choice.select("target", "alpha", F.round("score", 3).alias("score"))


_BAND_OUT = "SELECT target, CAST(gamma_id AS INTEGER) AS gamma_id, alpha, round(score, 3) AS score, round(u, 9) AS view, round(v, 9) AS click, round(ln(ga / alpha), 6) AS delta_view, round(ln(gb / alpha), 6) AS delta_click FROM w"


def _band_rows(fit: ridge.Fit, coef: DataFrame) -> DataFrame:
    pick = lambda n: F.round(F.max(F.when(F.col("space") == n, F.col("delta"))), 6).alias(f"delta_{n}")
    deltas = fit.deltas.groupBy("target").agg(pick("view"), pick("click"))
    return fit.choice.join(coef, "target").join(deltas, "target").select(
        "target", "gamma_id", "alpha", F.round("score", 3).alias("score"), F.round(F.get("coef", F.lit(0)), 9).alias("view"),
        F.round(F.get("coef", F.lit(1)), 9).alias("click"), "delta_view", "delta_click")


@query("m2_banded", f"WITH {_TWO} {_BAND_OUT}")
def m2_banded(spark, d):
    fit = two_spaces(spark, d)[2]
    return _band_rows(fit, fit.coef)


@query("m1_wide", f"WITH {_TWO} {_BAND_OUT}")
def m1_wide(spark, d):
    """The same search without sums of products, as tables above the limit are solved."""
    x, y = features(spark, d), responses(spark, d)
    fit = ridge.prepare(x, y, run_folds(y), TWO, limit=0).search(GAMMAS, ALPHAS)
    return _band_rows(fit, fit.coef)


@query("m3_kernel", f"WITH {_TWO} {_BAND_OUT}")
def m3_kernel(spark, d):
    """The same search through kernels; weights mapped back to features."""
    x, y = features(spark, d), responses(spark, d)
    data = Kernels(x, y, run_folds(y), TWO, n_chunks=3)
    fit = data.search(GAMMAS, ALPHAS)
    return _band_rows(fit, data.primal(fit, x))


@query("m14_prediction", f"WITH {_TWO} SELECT w.target, x.t, round(u * x1 + v * x2, 6) AS prediction FROM w, x")
def m14_prediction(spark, d):
    x, _, fit = two_spaces(spark, d)
    return ridge.predict(x, fit.coef.drop("mean")).select("target", "t", F.round("prediction", 6).alias("prediction"))


@query("m14_prediction_split", f"WITH {_TWO} SELECT w.target, x.t, sp AS space, round(CASE sp WHEN 'view' THEN u * x1 ELSE v * x2 END, 6) AS prediction FROM w, x, (SELECT unnest(['view', 'click']) AS sp)")
def m14_prediction_split(spark, d):
    x, _, fit = two_spaces(spark, d)
    return ridge.predict(x, fit.coef.drop("mean"), spaces=TWO).select("target", "t", "space", F.round("prediction", 6).alias("prediction"))


@query("a23_metrics", f"""WITH {_TWO}, j AS (SELECT w.target, y.y, u * x1 + v * x2 AS p FROM w JOIN y USING (target) JOIN x USING (t))
SELECT target, round(coalesce(covar_pop(p, y) / nullif(sqrt(var_pop(p) * var_pop(y)), 0), 0), 6) AS correlation, round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) AS r2, count(*) AS n FROM j GROUP BY 1""")
def a23_metrics(spark, d):
    x, y, fit = two_spaces(spark, d)
    y = bands.standardise(y, "y", keys=["target"], scale=False)
    out = ridge.metrics(y, ridge.predict(x, fit.coef.drop("mean")))
    return out.withColumns({c: F.round(c, 6) for c in ("correlation", "r2")})


@query("a23_split_metrics", f"""WITH {_TWO}, j AS (SELECT w.target, y.y, u * x1 AS pa, v * x2 AS pb FROM w JOIN y USING (target) JOIN x USING (t)),
q AS (SELECT target, unnest(['view', 'click']) AS space, unnest([pa, pb]) AS pk, y, pa + pb AS p FROM j)
SELECT target, space, round(avg(pk * (2 * y - p)) / var_pop(y), 6) AS r2, round(avg(pk * y) / sqrt(var_pop(y) * var_pop(p)), 6) AS correlation FROM q GROUP BY 1, 2""")
def a23_split_metrics(spark, d):
    x, y, fit = two_spaces(spark, d)
    y = bands.standardise(y, "y", keys=["target"], scale=False)
    out = ridge.split_metrics(y, ridge.predict(x, fit.coef.drop("mean"), spaces=TWO))
    return out.select("target", "space", F.round("r2", 6).alias("r2"), F.round("correlation", 6).alias("correlation"))


@query("a23_residuals", f"WITH {_TWO} SELECT w.target, x.t, round(y.y - u * x1 - v * x2, 6) AS residual FROM w JOIN y USING (target) JOIN x USING (t)")
def a23_residuals(spark, d):
    x, y, fit = two_spaces(spark, d)
    y = bands.standardise(y, "y", keys=["target"], scale=False)
    return ridge.residuals(y, ridge.predict(x, fit.coef.drop("mean"))).select("target", "t", F.round("residual", 6).alias("residual"))


_RAW = f"""{_TWO}, raw AS (SELECT run AS target, t, value, avg(value) OVER (PARTITION BY run) AS m FROM series),
j AS (SELECT w.target, x.t, raw.value AS y, raw.m + u * x1 + v * x2 AS p FROM w JOIN raw USING (target) JOIN x USING (t))"""


@query("m14_prediction_raw", f"WITH {_RAW} SELECT target, t, round(p, 6) AS prediction FROM j")
def m14_prediction_raw(spark, d):
    """Predictions of the responses as they are: the training mean is part of the model."""
    x, _, fit = two_spaces(spark, d)
    return ridge.predict(x, fit.coef).select("target", "t", F.round("prediction", 6).alias("prediction"))


@query("a23_metrics_raw", f"""WITH {_RAW} SELECT target, round(coalesce(covar_pop(p, y) / nullif(sqrt(var_pop(p) * var_pop(y)), 0), 0), 6) AS correlation,
round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) AS r2, count(*) AS n FROM j GROUP BY 1""")
def a23_metrics_raw(spark, d):
    x, y, fit = two_spaces(spark, d)
    out = ridge.metrics(y, ridge.predict(x, fit.coef))
    return out.withColumns({c: F.round(c, 6) for c in ("correlation", "r2")})


@query("a23_evaluate", f"""WITH {_TWO}, j AS (SELECT w.target, y.y, u * x1 AS pa, v * x2 AS pb, u * x1 + v * x2 AS p FROM w JOIN y USING (target) JOIN x USING (t)),
q AS (SELECT target, unnest(['view', 'click']) AS space, unnest([pa, pb]) AS pk, y, p FROM j)
SELECT target, 'whole' AS part, round(coalesce(covar_pop(p, y) / nullif(sqrt(var_pop(p) * var_pop(y)), 0), 0), 6) AS correlation, round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) AS r2 FROM j GROUP BY 1
UNION ALL SELECT target, space, round(avg(pk * y) / sqrt(var_pop(y) * var_pop(p)), 6), round(avg(pk * (2 * y - p)) / var_pop(y), 6) FROM q GROUP BY 1, 2""")
def a23_evaluate(spark, d):
    """Scores and shares from blocks of targets, on responses as they are."""
    x, y, fit = two_spaces(spark, d)
    found = evaluation.evaluate(x, y, fit.coef, spaces=TWO, n_chunks=2)
    both = found.scores.select("target", F.lit("whole").alias("part"), "correlation", "r2").unionAll(found.shares.select("target", "space", "correlation", "r2"))
    return both.withColumns({c: F.round(c, 6) for c in ("correlation", "r2")})


@query("a23_evaluate_blocks", f"WITH {_RAW} SELECT target, t, round(p, 6) AS prediction, round(y - p, 6) AS residual FROM j")
def a23_evaluate_blocks(spark, d):
    x, y, fit = two_spaces(spark, d)
    found = evaluation.evaluate(x, y, fit.coef, spaces=TWO, n_chunks=2)
    cells = found.blocks.join(found.targets, "chunk").select("t", F.inline(F.arrays_zip("targets", "prediction", "residual")))
    return cells.select(F.col("targets").alias("target"), "t", F.round("prediction", 6).alias("prediction"), F.round("residual", 6).alias("residual"))


# -- many targets: every user's events of a type, in steps of six hours -------------------------------------------

_USERS = f"""{SAMPLES_SQL}, st AS (SELECT CAST(unnest(range(0, (SELECT CAST(floor(max(time) / 21600.0) AS BIGINT) FROM samples) + 1)) AS INTEGER) AS t),
tot AS (SELECT CAST(floor(time / 21600.0) AS INTEGER) AS t, round(sum(value), 2) AS v FROM samples WHERE run = 'view' GROUP BY 1),
xs AS (SELECT st.t, st.t // 24 AS run, coalesce(tot.v, 0) AS x0 FROM st LEFT JOIN tot USING (t)),
x AS (SELECT t, run, x0 - avg(x0) OVER () AS x FROM xs),
cl AS (SELECT user_id || '-' || run AS target, CAST(floor(time / 21600.0) AS INTEGER) AS t, round(sum(value), 2) AS v FROM samples GROUP BY 1, 2),
y0 AS (SELECT g.target, x.t, x.run, x.x, coalesce(cl.v, 0) AS y FROM (SELECT DISTINCT target FROM cl) g CROSS JOIN x LEFT JOIN cl ON cl.target = g.target AND cl.t = x.t),
y AS (SELECT *, y - avg(y) OVER (PARTITION BY target) AS yc, avg(y) OVER (PARTITION BY target) AS m FROM y0),
s AS (SELECT target, run, max(m) AS m, sum(x * x) AS g, sum(x * yc) AS c, sum(yc * yc) AS yy, count(*) AS n FROM y GROUP BY 1, 2),
tt AS (SELECT target, max(m) AS m, sum(g) AS g, sum(c) AS c FROM s GROUP BY 1),
l AS (SELECT target, alpha, avg(-(yy - 2 * b * c + b * b * g) / n) AS score FROM (
  SELECT s.*, alpha, (tt.c - s.c) / (tt.g - s.g + alpha) AS b FROM s JOIN tt USING (target), (SELECT unnest([1e5, 1e7, 1e9]) AS alpha)) GROUP BY 1, 2),
b AS (SELECT DISTINCT ON (target) target, alpha, score FROM l ORDER BY target, round(score, 6) DESC, alpha)"""


@query("m1_user_targets", f"WITH {_USERS} SELECT target, round(c / (g + alpha), 8) AS coef, round(m, 6) AS mean FROM b JOIN tt USING (target)")
def m1_user_targets(spark, d):
    """Hundreds of targets in chunks of about 200; steps without an event of a user are 0."""
    s = samples(spark, d).withColumn("t", F.floor(F.col("time") / 21600.0).cast("int"))
    last = s.agg(F.max("t")).scalar()
    v = s.where("run = 'view'").groupBy("t").agg(F.round(F.sum("value"), 2).alias("v"))
    t = spark.range(1).select(F.explode(F.sequence(F.lit(0), last)).alias("t"))
    x = t.join(v, "t", "left").select((F.floor(F.col("t") / 24)).cast("int").alias("run"), "t", F.coalesce("v", F.lit(0.0)).alias("v"))
    x = written(bands.centre_on_train(x, F.lit(True), ["v"]).select("run", "t", F.array("v").alias("x")))
    y = s.groupBy(F.concat_ws("-", "user_id", "run").alias("target"), "t").agg(F.round(F.sum("value"), 2).alias("y"))
    y = written(y.withColumn("run", F.floor(F.col("t") / 24).cast("int")))
    folds = fold_ops.leave_runs_out(x.select("run").distinct(), x.select("run").distinct().count(), 1)
    fit = ridge.prepare(x, y, folds, [("view", 0, 1)], missing="zero").search(np.ones((1, 1)), [1e5, 1e7, 1e9])
    return fit.coef.select("target", F.round(F.get("coef", F.lit(0)), 8).alias("coef"), F.round("mean", 6).alias("mean"))


# -- group level: users in four groups as subjects, one left out per fold -------------------------------------

_GROUP = f"""{_DATA}, cells4 AS (SELECT user_id % 4 AS subject, run AS target, CAST(floor(time / 3600.0) AS INTEGER) AS t, sum(value) AS y FROM samples GROUP BY 1, 2, 3),
ys AS (SELECT CAST(g.subject AS INTEGER) AS subject, y.target, y.t, round(coalesce(c.y, 0), 2) AS y FROM (SELECT unnest([0, 1, 2, 3]) AS subject) g, y LEFT JOIN cells4 c ON c.subject = g.subject AND c.target = y.target AND c.t = y.t),
avgd AS (SELECT target, t, avg(y) AS y FROM ys GROUP BY 1, 2), mu AS (SELECT target, avg(y) AS m FROM avgd GROUP BY 1),
fo AS (SELECT f.subject AS fold, target, t, avg(y) FILTER (WHERE ys.subject <> f.subject) AS ytr, max(y) FILTER (WHERE ys.subject = f.subject) AS yva FROM ys, (SELECT unnest([0, 1, 2, 3]) AS subject) f GROUP BY 1, 2, 3),
st AS (SELECT fold, target, alpha, sum(x1 * (ytr - m)) / (sum(x1 * x1) + alpha) AS b FROM fo JOIN x USING (t) JOIN mu USING (target), al GROUP BY 1, 2, 3),
ls AS (SELECT target, fold, alpha, -avg(pow(yva - m - b * x1, 2)) AS score FROM st JOIN fo USING (fold, target) JOIN x USING (t) JOIN mu USING (target) GROUP BY 1, 2, 3),
la AS (SELECT target, alpha, avg(score) AS score FROM ls GROUP BY 1, 2),
bg AS (SELECT DISTINCT ON (target) * FROM la ORDER BY target, score DESC, alpha),
cf AS (SELECT target, alpha, score, (SELECT sum(x1 * (avgd.y - m)) FROM avgd JOIN x USING (t) JOIN mu USING (target) WHERE avgd.target = bg.target) / ((SELECT sum(x1 * x1) FROM x) + alpha) AS coef FROM bg)"""


def subject_responses(spark, d) -> DataFrame:
    s = table(spark, d, "events").select((F.col("user_id") % 4).cast("int").alias("subject"), F.col("event_type").alias("target"), F.floor(event_seconds() / 3600).cast("int").alias("t"), "value")
    cells = s.groupBy("subject", "target", "t").agg(F.sum("value").alias("y"))
    from sigframe.operators.layout import densify
    from sigframe.workload.base import last_step

    return densify(cells, partition_cols=["subject", "target"], order_col="t", value_cols=["y"], low=F.lit(0), high=last_step(spark, d, 3600.0)).withColumn("y", F.round("y", 2))


def _subject_folds(spark, d) -> DataFrame:
    ids = table(spark, d, "events").select((F.col("user_id") % 4).cast("int").alias("subject")).distinct()
    return fold_ops.leave_runs_out(ids, 4, 1, run_col="subject")


@query("m4_group_level", f"WITH {_GROUP} SELECT target, alpha, round(score, 3) AS score, round(coef, 9) AS coef FROM cf")
def m4_group_level(spark, d):
    x = features(spark, d, ("view",)).drop("run")
    data = ridge.prepare_group(x, written(subject_responses(spark, d)), _subject_folds(spark, d), [("view", 0, 1)])
    fit = data.search(np.ones((1, 1)), ALPHAS)
    return fit.choice.join(fit.coef, "target").select("target", "alpha", F.round("score", 3).alias("score"), F.round(F.get("coef", F.lit(0)), 9).alias("coef"))


@query("m4_group_kernel", f"WITH {_GROUP} SELECT target, alpha, round(score, 3) AS score, round(coef, 9) AS coef FROM cf")
def m4_group_kernel(spark, d):
    """The group-level model through kernels that all subjects share; weights mapped back to features."""
    x = features(spark, d, ("view",)).drop("run")
    data = GroupKernels(x, written(subject_responses(spark, d)), _subject_folds(spark, d), [("view", 0, 1)])
    fit = data.search(np.ones((1, 1)), ALPHAS)
    return fit.choice.join(data.primal(fit, x), "target").select("target", "alpha", F.round("score", 3).alias("score"), F.round(F.get("coef", F.lit(0)), 9).alias("coef"))


@query("a7_group_average", f"WITH {_GROUP} SELECT target, t, round(y, 4) AS y FROM avgd")
def a7_group_average(spark, d):
    return subject_responses(spark, d).groupBy("target", "t").agg(F.round(F.avg("y"), 4).alias("y"))


# -- encoding entry: vectors as features of row groups, labels as targets -------------------------------------

def raw_features(spark, d) -> DataFrame:
    s = series(spark, d)
    names = ("view", "click", "signup")
    wide = s.groupBy("t").agg(*[F.max(F.when(F.col("run") == n, F.col("value"))).alias(n) for n in names])
    return written(wide.select(F.floor(F.col("t") / 168).cast("int").alias("run"), "t", F.array(*names).alias("x")))


SPACES = [("browse", 0, 2), ("join", 2, 3)]


def encoded(spark, d, **options) -> encoding.Encoding:
    y = responses(spark, d)
    return encoding.fit_encoding(raw_features(spark, d), y, run_folds(y), SPACES, n_iter=6, alphas=np.logspace(4, 10, 7), seed=3, n_chunks=2, **options)


@query("m5_fit_encoding")
def m5_fit_encoding(spark, d):
    """Centre, four delays, two spaces, random search; weights and scores per target."""
    model = encoded(spark, d)
    return model.fit.choice.join(model.fit.coef, "target").select("target", "gamma_id", "alpha", "score", F.size("coef").alias("n_coef"))


@query("m5_single_space")
def m5_single_space(spark, d):
    y = responses(spark, d)
    model = encoding.fit_encoding(raw_features(spark, d), y, run_folds(y), None, alphas=np.logspace(4, 10, 7))
    return model.fit.choice.select("target", "alpha", "score")


@query("m5_gradient_search")
def m5_gradient_search(spark, d):
    model = encoded(spark, d, solver="hyper_gradient")
    return model.fit.deltas.join(model.fit.choice, "target").select("target", "space", "delta", "score")


@query("m5b_refine")
def m5b_refine(spark, d):
    model = encoded(spark, d)
    refined, mask = model.data.refine(model.fit, top_percentile=60)
    return mask.join(refined, "target", "left").select("target", "refined", "start_loss", "loss", F.col("deltas").isNotNull().alias("has_deltas"))


@query("m5b_refine_kernel", f"WITH {_TWO} SELECT target, round(-score, 3) AS start_loss, true AS not_above, true AS equal_loss FROM best")
def m5b_refine_kernel(spark, d):
    """Refinement of a kernel fit: it starts at the loss of the search and ends no higher; the loss of the end is computed again from the
    refined weights, by the sums of the primal form."""
    x, y = features(spark, d), responses(spark, d)
    data = Kernels(x, y, run_folds(y), TWO, n_chunks=2)
    fit = data.search(GAMMAS, ALPHAS)
    refined = written(data.refine(fit, limit=40.0)[0], "refined")
    primal = ridge.prepare(x, y, run_folds(y), TWO, n_chunks=2)
    again = primal.refine(ridge.with_refined(fit, refined, TWO), max_iter=0, limit=40.0)[0].select("target", F.col("start_loss").alias("again"))
    equal = F.abs(F.col("again") - F.col("loss")) <= 1e-9 * F.abs("loss")
    return refined.join(again, "target").select("target", F.round("start_loss", 3).alias("start_loss"), (F.col("loss") <= F.col("start_loss")).alias("not_above"), equal.alias("equal_loss"))


@query("s11_model_roundtrip", f"WITH {_TWO} SELECT target, alpha, round(u, 9) AS view, round(v, 9) AS click FROM w")
def s11_model_roundtrip(spark, d):
    path = f"{shared_dir(spark)}/model"
    save_model(two_spaces(spark, d)[2], path, "banded", spaces=[s[0] for s in TWO])
    fit, _ = load_model(spark, path)
    return fit.choice.join(fit.coef, "target").select("target", "alpha", F.round(F.get("coef", F.lit(0)), 9).alias("view"), F.round(F.get("coef", F.lit(1)), 9).alias("click"))


# -- decomposition ------------------------------------------------------------------------------------------------

def rows64(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))


@query("m6_pca")
def m6_pca(spark, d):
    reduced, _ = decomposition.fit_and_reduce(rows64(spark, d), threshold=0.9)
    return reduced.select("vec_id", F.posexplode("z").alias("component", "score"))


@query("m6_explained", """SELECT count(*) AS n, CAST(64 AS BIGINT) AS n_features, round(sum(v), 6) AS total_variance FROM (SELECT i, var_samp(CAST(embedding[i] AS DOUBLE)) AS v FROM (SELECT embedding, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY i)""")
def m6_explained(spark, d):
    """Full decomposition: component variances add up to the variables' variances."""
    reduced, model = decomposition.fit_and_reduce(rows64(spark, d), n_components=64)
    v = reduced.select(F.posexplode("z").alias("c", "z")).groupBy("c").agg(F.var_samp("z").alias("v"))
    return v.agg(F.count(F.lit(1)).alias("n"), F.lit(len(model.mean)).cast("long").alias("n_features"), F.round(F.sum("v"), 6).alias("total_variance"))


@query("m6_wide", f"""WITH {SAMPLES_SQL}, c AS (SELECT user_id, CAST(floor(time / 3600.0) AS INTEGER) AS t, count(*) AS n FROM samples GROUP BY 1, 2),
g AS (SELECT u.user_id, h.t, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT user_id FROM c) u CROSS JOIN (SELECT unnest(range(0, (SELECT max(t) FROM c) + 1)) AS t) h
      LEFT JOIN c ON c.user_id = u.user_id AND c.t = h.t),
m AS (SELECT *, n - avg(n) OVER (PARTITION BY t) AS d FROM g)
SELECT user_id, CAST(least((SELECT count(DISTINCT user_id) FROM g), (SELECT count(DISTINCT t) FROM g)) AS INTEGER) AS n_components, round(sum(d * d), 6) AS norm2 FROM m GROUP BY 1""")
def m6_wide(spark, d):
    """Users by hours, more columns than rows: all components, without a matrix of the columns, keep each row's length."""
    hours = F.floor(event_seconds() / 3600).cast("int")
    events = table(spark, d, "events").select("user_id", hours.alias("t"))
    last = events.agg(F.max("t")).scalar()
    counts = events.groupBy("user_id", "t").agg(F.count(F.lit(1)).cast("double").alias("n"))
    held = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("t", "n"))).alias("m"))
    held = held.withColumn("last", last)
    x = F.transform(F.sequence(F.lit(0), F.col("last")), lambda t: F.coalesce(F.try_element_at("m", t), F.lit(0.0)))
    rows = written(held.select("user_id", x.alias("x")))
    directions = min(rows.count(), len(rows.first()["x"]))
    reduced, _ = decomposition.fit_and_reduce(rows, n_components=directions, limit=0)
    return reduced.select("user_id", F.size("z").alias("n_components"), F.round(dot(F.col("z"), F.col("z")), 6).alias("norm2"))


@query("m7_inverse_transform", "SELECT vec_id, CAST(i - 1 AS INTEGER) AS dim, round(CAST(embedding[i] AS DOUBLE), 5) AS value FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings)")
def m7_inverse_transform(spark, d):
    rows = rows64(spark, d)
    reduced, model = decomposition.fit_and_reduce(rows, n_components=64)
    return decomposition.restore(reduced, model).select("vec_id", F.posexplode("x").alias("dim", "value")).withColumn("value", F.round("value", 5))


@query("m7_incremental")
def m7_incremental(spark, d):
    """Fit in four batches of rows."""
    pca = decomposition.Incremental(threshold=0.9)
    rows = rows64(spark, d).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(4)))
    for i in range(4):
        pca.partial_fit(rows.where(F.col("part") == i))
    return decomposition.info(spark, pca.model)


_SCREE = """v AS (SELECT s_nationkey, s_suppkey, abs(s_acctbal) AS v FROM supplier),
sc AS (SELECT s_nationkey, s_suppkey, row_number() OVER w AS component, v / sum(v) OVER (PARTITION BY s_nationkey) AS ratio, sum(v) OVER w / sum(v) OVER (PARTITION BY s_nationkey) AS cumulative FROM v WINDOW w AS (PARTITION BY s_nationkey ORDER BY v DESC, s_suppkey))"""


def _scree(spark, d) -> DataFrame:
    v = table(spark, d, "supplier").select("s_nationkey", "s_suppkey", F.abs("s_acctbal").alias("v"))
    return decomposition.scree(v, variance="v", order=[F.col("v").desc(), F.col("s_suppkey")], keys=["s_nationkey"], threshold=0.8)


@query("m8_scree", f"WITH {_SCREE} SELECT s_nationkey, s_suppkey, CAST(component AS INTEGER) AS component, round(ratio, 6) AS explained_ratio, round(cumulative, 6) AS cumulative, coalesce(lag(cumulative) OVER (PARTITION BY s_nationkey ORDER BY component) < 0.8, true) AS selected FROM sc")
def m8_scree(spark, d):
    return _scree(spark, d).select("s_nationkey", "s_suppkey", "component", F.round("explained_ratio", 6).alias("explained_ratio"), F.round("cumulative", 6).alias("cumulative"), "selected")


@query("a21_cumulative_variance", f"WITH {_SCREE} SELECT s_nationkey, CAST(component AS INTEGER) AS component, round(cumulative, 6) AS cumulative FROM sc")
def a21_cumulative_variance(spark, d):
    return _scree(spark, d).select("s_nationkey", "component", F.round("cumulative", 6).alias("cumulative"))


@query("a22_components_needed", f"WITH {_SCREE} SELECT s_nationkey, CAST(coalesce(min(component) FILTER (WHERE cumulative >= 0.8), max(component)) AS INTEGER) AS n_components FROM sc GROUP BY 1")
def a22_components_needed(spark, d):
    return decomposition.needed_components(_scree(spark, d), 0.8, keys=["s_nationkey"])


@query("s9_decomposition_roundtrip")
def s9_decomposition_roundtrip(spark, d):
    path = f"{shared_dir(spark)}/pca"
    decomposition.fit_reduce_or_load(rows64(spark, d), path, n_components=5)
    again, model = decomposition.fit_reduce_or_load(rows64(spark, d), path)
    return again.select("vec_id", F.size("z").alias("k"), F.aggregate("z", F.lit(0.0), lambda s, v: s + v * v).alias("energy"))


# -- streams: the event file replayed -----------------------------------------------------------------------------

def event_stream(spark, d):
    """The events, and what ends their stream."""
    s, finish = stream.replay(spark, d, "events.parquet", "ts")
    # the file's times carry no zone and mean UTC, whatever zone the session reads them in
    utc = F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone())
    return s.select(F.col("event_type").alias("run"), utc.alias("ts"), "value", "event_id"), finish


_STREAM = "e AS (SELECT event_type AS run, epoch_us(ts) AS us, value, event_id FROM events)"


def _windowed(spark, d, windows) -> DataFrame:
    events, finish = event_stream(spark, d)
    df = stream.drain(windows(events), finish=finish)
    return df.select("run", F.unix_seconds("window_start").alias("start_s"), "n", F.round("value", 6).alias("value"))


@query("st1_sliding", f"""WITH {_STREAM}, w AS (SELECT run, value, CAST(us // 3600000000 - k AS BIGINT) AS h FROM e, (SELECT unnest(range(0, 6)) AS k))
SELECT run, h * 3600 AS start_s, count(*) AS n, round(avg(value), 6) AS value FROM w GROUP BY 1, 2""")
def st1_sliding(spark, d):
    return _windowed(spark, d, lambda s: stream_windows.sliding_features(s, width="6 hours", step="1 hour", late="10 minutes"))


@query("st2_tumbling", f"""WITH {_STREAM} SELECT run, CAST(us // 3600000000 * 3600 AS BIGINT) AS start_s, count(*) AS n, round(avg(value), 6) AS value FROM e GROUP BY 1, 2""")
def st2_tumbling(spark, d):
    return _windowed(spark, d, lambda s: stream_windows.tumbling_features(s, width="1 hour", late="10 minutes"))


@query("st3_incremental_moments", """SELECT CAST(i - 1 AS INTEGER) AS dim, count(*) AS n, round(avg(CAST(embedding[i] AS DOUBLE)), 6) AS mean, round(var_pop(CAST(embedding[i] AS DOUBLE)), 6) AS variance FROM (SELECT embedding, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY i""")
def st3_incremental_moments(spark, d):
    base = shared_dir(spark)
    rows = stream.read_files(spark, d, "embeddings.parquet").select(F.col("embedding").cast("array<double>").alias("x"))
    state.write_moments(rows, f"{base}/sums", f"{base}/checkpoint").awaitTermination()
    s = state.read_moments(spark, f"{base}/sums")
    out = [(i, int(s.n), float(s.mean[i]), float(s.scatter[i, i] / s.n)) for i in range(len(s.mean))]
    return spark.createDataFrame(out, "dim int, n long, mean double, variance double").withColumns({c: F.round(c, 6) for c in ("mean", "variance")})


@query("st4_segments", f"""WITH {_STREAM}, g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY run ORDER BY us) < 1800000000 THEN 0 ELSE 1 END AS new FROM e),
i AS (SELECT *, sum(new) OVER (PARTITION BY run ORDER BY us) AS seg FROM g)
SELECT run, CAST(min(us) // 1000000 AS BIGINT) AS start_s, count(*) AS n, round(avg(value), 6) AS value FROM i GROUP BY run, seg""")
def st4_segments(spark, d):
    return _windowed(spark, d, lambda s: stream_windows.active_segments(s, gap="30 minutes", late="10 minutes"))


@query("st5_lagged", f"WITH {_STREAM} SELECT run, event_id, value, coalesce(lag(value, 1) OVER w, 0) AS value_d1, coalesce(lag(value, 3) OVER w, 0) AS value_d3 FROM e WINDOW w AS (PARTITION BY run ORDER BY us)")
def st5_lagged(spark, d):
    events, finish = event_stream(spark, d)
    out = stream.drain(state.lagged(events, [1, 3], late="10 minutes", carry=["event_id"], bucket="1 hour"), finish=finish)
    return out.select("run", "event_id", "value", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("value_d1", "value_d3")])


@query("st7_grid_lags", f"""WITH {_STREAM}, g AS (SELECT run, us // 3600000000 AS h, sum(value) AS value FROM e GROUP BY 1, 2)
SELECT g.run, CAST(g.h * 3600 AS BIGINT) AS start_s, round(g.value, 2) AS value, round(coalesce(a.value, 0), 2) AS value_d1, round(coalesce(b.value, 0), 2) AS value_d24
FROM g LEFT JOIN g a ON a.run = g.run AND a.h = g.h - 1 LEFT JOIN g b ON b.run = g.run AND b.h = g.h - 24""")
def st7_grid_lags(spark, d):
    """Hourly sums an hour and a day earlier, a run's hours in keys of 128."""
    events, finish = event_stream(spark, d)
    with timers.rocksdb(spark):
        out = stream.drain(timers.lagged_grid(events, [1, 24], period="1 hour", late="10 minutes", key_rows=128, bucket_rows=16), finish=finish)
    return out.select("run", F.unix_seconds("ts").alias("start_s"), *[F.round(c, 2).alias(c) for c in ("value", "value_d1", "value_d24")])


@query("st8_spaced_cuts", f"""WITH RECURSIVE {_STREAM}, k AS (SELECT run, min(us) AS us FROM e GROUP BY run
UNION ALL SELECT e.run, min(e.us) FROM k JOIN e ON e.run = k.run AND e.us >= k.us + 7200000000 GROUP BY e.run)
SELECT run, us FROM k""")
def st8_spaced_cuts(spark, d):
    """Events that lie two hours or more behind the last kept one of their type."""
    events, finish = event_stream(spark, d)
    with timers.rocksdb(spark):
        out = stream.drain(timers.spaced_cuts(events, "2 hours", late="10 minutes", bucket="1 hour"), finish=finish)
    return out.select("run", F.unix_micros("ts").alias("us"))


@query("st6_regressors", f"WITH {_STREAM} SELECT event_id, printf('%.2f*%.2f', CAST(us // 1000000 - 1704067200 AS DOUBLE), value) AS regressor FROM e")
def st6_regressors(spark, d):
    s = event_stream(spark, d)[0].select("run", "event_id", (F.unix_seconds("ts") - 1704067200).cast("double").alias("onset"), F.col("value").alias("amplitude"))
    return stream.drain(stimulus.regressors(s, "am")).select("event_id", "regressor")
