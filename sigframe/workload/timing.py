"""Queries on resampling, context windows, scenes and permutation tests."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from sigframe.operators import inference, resample, scenes, spectral, windows, words
from sigframe.workload.base import HOUR, SAMPLES_SQL, last_step, regular_sql, samples, series
from sigframe.workload.registry import query


_KERNEL = """CASE WHEN u = 0 THEN 1.0 WHEN abs(u) > 3 THEN 0.0
  ELSE 3 * sin(pi() * u) * sin(pi() * u / 3) / (pi() * pi() * u * u) END"""


def _lanczos_sql(values: str, outs: str) -> str:
    return f"""WITH {SAMPLES_SQL}, steps AS (SELECT unnest(range(0, (SELECT CAST(floor(max(time) / {HOUR}) AS BIGINT) + 1 FROM samples))) AS k),
grid AS (SELECT run, k FROM (SELECT DISTINCT run FROM samples), steps),
near AS (SELECT g.run, g.k, s.value, (g.k * {HOUR} - s.time) * (1 / {HOUR}) AS u FROM grid g JOIN samples s ON s.run = g.run
  AND s.time >= (g.k - 3) * {HOUR} AND s.time <= (g.k + 3) * {HOUR}),
w AS (SELECT run, k, value, {_KERNEL} AS w FROM near)
SELECT g.run, g.k, {outs} FROM grid g LEFT JOIN (SELECT run, k, {values} FROM w GROUP BY 1, 2) x USING (run, k)"""


@query("j5_lanczos", _lanczos_sql("sum(w * value) AS v", "round(coalesce(v, 0), 4) AS value"))
def j5_lanczos(spark, d):
    n = last_step(spark, d, HOUR) + 1
    out = resample.lanczos_regular(samples(spark, d), step=HOUR, n_points=n)
    return out.select("run", "k", F.round("value", 4).alias("value"))


@query("j5_lanczos_rectify", _lanczos_sql(
    "sum(w * least(value - 100, 0)) AS a, sum(w * greatest(value - 100, 0)) AS b",
    "round(coalesce(a, 0), 4) AS value_neg, round(coalesce(b, 0), 4) AS value_pos"))
def j5_lanczos_rectify(spark, d):
    grid = series(spark, d).select("run", F.col("t").cast("long").alias("k"), (F.col("t") * HOUR).alias("time"))
    s = samples(spark, d).withColumn("value", F.col("value") - 100)
    out = resample.lanczos_join(s, grid, mean_step=HOUR, rectified=True)
    return out.select("run", F.round(F.col("time") / HOUR).cast("long").alias("k"),
                      F.round("value_neg", 4).alias("value_neg"), F.round("value_pos", 4).alias("value_pos"))


_WINDOWS_SQL = f"""{SAMPLES_SQL}, steps AS (SELECT unnest(range(0, (SELECT CAST(floor(max(time) / {HOUR}) AS BIGINT) + 1 FROM samples))) AS k),
win AS (SELECT k, greatest(0, k * {HOUR} - 6 * {HOUR}) AS ws, greatest(k * {HOUR}, {HOUR}) AS we FROM steps)"""


@query("j14_context_windows", f"WITH {_WINDOWS_SQL} SELECT run, k, count(*) AS n, round(max(value), 2) AS top FROM samples JOIN win ON time >= ws AND time < we GROUP BY 1, 2")
def j14_context_windows(spark, d):
    out = resample.context_windows(samples(spark, d), step=HOUR, width=6 * HOUR, n_steps=last_step(spark, d, HOUR) + 1)
    return out.groupBy("run", "k").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("value"), 2).alias("top"))


@query("j14_per_frame_windows", f"""WITH {regular_sql()}, win AS (SELECT run, CAST(t * {HOUR} AS DOUBLE) AS g, greatest(0, t * {HOUR} - 5400) AS ws, (t + 1) * {HOUR} AS we FROM series)
SELECT run, g AS grid_time, count(*) AS n, round(sum(s.value), 2) AS total FROM win JOIN samples s USING (run) WHERE time >= ws AND time < we GROUP BY 1, 2""")
def j14_per_frame_windows(spark, d):
    grid = series(spark, d).select("run", (F.col("t") * HOUR).alias("time"))
    out = resample.context_windows_join(samples(spark, d), grid, width=5400.0, step=HOUR)
    return out.groupBy("run", "grid_time").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("e2_mean_pool", f"WITH {_WINDOWS_SQL} SELECT run, k, count(*) AS n, round(avg(value), 6) AS value FROM samples JOIN win ON time >= ws AND time < we GROUP BY 1, 2")
def e2_mean_pool(spark, d):
    out = resample.pooled_windows(samples(spark, d), step=HOUR, panes=6, n_steps=last_step(spark, d, HOUR) + 1)
    return out.select("run", "k", "n", F.round("value", 6).alias("value"))


@query("e2_user_model", f"""WITH {_WINDOWS_SQL}, w AS (SELECT run, k, count(*) AS n, min(value) AS lo, max(value) AS hi, sum(value) AS total FROM samples JOIN win ON time >= ws AND time < we GROUP BY 1, 2)
SELECT run, k, round(hi - CASE WHEN n < 12 THEN least(lo, 0) ELSE lo END, 2) AS spread, round(total, 2) AS total FROM w""")
def e2_user_model(spark, d):
    def spread_and_total(x):
        return np.stack([x.max(1) - x.min(1), x.sum(1)], axis=1)

    out = words.windowed_model(samples(spark, d), spread_and_total, step=HOUR, width=6 * HOUR, n_steps=last_step(spark, d, HOUR) + 1, samples_per_window=12)
    return out.select("run", "k", F.round(F.get("features", F.lit(0)), 2).alias("spread"), F.round(F.get("features", F.lit(1)), 2).alias("total"))


_SCENE_SQL = {
    "content": "CASE WHEN score >= 400 THEN true ELSE false END",
    "adaptive": "coalesce(CASE WHEN others > 0 THEN score / others WHEN score > 0 THEN 255 ELSE 0 END, CASE WHEN score > 0 THEN 255 ELSE 0 END) >= 1.5 AND score >= 15",
}
_SCORES = """scores AS (SELECT run, t, value, n, coalesce(abs(value - lag(value) OVER (PARTITION BY run ORDER BY t)), 0) AS score,
  coalesce(bit_count(xor(n, lag(n) OVER (PARTITION BY run ORDER BY t))) / 64.0, 0) AS bits FROM series),
ring AS (SELECT *, (sum(score) OVER r - score) / nullif(count(*) OVER r - 1, 0) AS others FROM scores
  WINDOW r AS (PARTITION BY run ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))"""


@query("w8_scene_content", f"WITH {regular_sql()}, {_SCORES} SELECT run, t, {_SCENE_SQL['content']} AS cut FROM ring")
def w8_scene_content(spark, d):
    return scenes.candidate_cuts(series(spark, d), "content", signal="value", threshold=400).select("run", "t", "cut")


@query("w9_scene_adaptive", f"WITH {regular_sql()}, {_SCORES} SELECT run, t, {_SCENE_SQL['adaptive']} AS cut FROM ring")
def w9_scene_adaptive(spark, d):
    return scenes.candidate_cuts(series(spark, d), "adaptive", signal="value", threshold=1.5).select("run", "t", "cut")


@query("w10_scene_threshold", f"""WITH {regular_sql()}, e AS (SELECT run, t, value < 300 AS dark, coalesce(lag(value < 300) OVER (PARTITION BY run ORDER BY t), false) AS was FROM series),
m AS (SELECT run, t, dark AND NOT was AS is_out FROM e WHERE dark <> was),
p AS (SELECT *, lag(t) OVER (PARTITION BY run ORDER BY t) AS prev FROM m),
last AS (SELECT run, max_by(dark, t) AS dark_end FROM e GROUP BY run),
c AS (SELECT run, CAST(floor((prev + t) / 2.0) AS INTEGER) AS t FROM p WHERE NOT is_out
  UNION SELECT run, max(t) AS t FROM m JOIN last USING (run) WHERE is_out AND dark_end GROUP BY run HAVING max(t) > 0)
SELECT s.run, s.t, c.t IS NOT NULL AS cut FROM series s LEFT JOIN c ON c.run = s.run AND c.t = s.t""")
def w10_scene_threshold(spark, d):
    return scenes.candidate_cuts(series(spark, d), "threshold", signal="value", threshold=300).select("run", "t", "cut")


@query("w11_scene_hash", f"WITH {regular_sql()}, {_SCORES} SELECT run, t, bits > 0.03 AS cut FROM ring")
def w11_scene_hash(spark, d):
    return scenes.candidate_cuts(series(spark, d), "hash", signal="n", threshold=0.03).select("run", "t", "cut")


_KEPT = """cand AS (SELECT run, t FROM ring WHERE score >= 400),
kept AS (SELECT run, min(t) AS t FROM cand WHERE t >= 15 GROUP BY run
  UNION ALL SELECT k.run, (SELECT min(c.t) FROM cand c WHERE c.run = k.run AND c.t >= k.t + 15) FROM kept k
  WHERE EXISTS (SELECT 1 FROM cand c WHERE c.run = k.run AND c.t >= k.t + 15))"""


@query("w12_spaced_cuts", f"WITH RECURSIVE {regular_sql()}, {_SCORES}, {_KEPT} SELECT run, CAST(t AS BIGINT) AS t FROM kept")
def w12_spaced_cuts(spark, d):
    found = scenes.candidate_cuts(series(spark, d), "content", signal="value", threshold=400)
    return scenes.spaced_cuts(found.where("cut"), 15, rows=50).select("run", "t")


@query("e6_scene_features", f"""WITH RECURSIVE {regular_sql()}, {_SCORES}, {_KEPT}
SELECT s.run, s.t, CAST(max(CASE WHEN k.t IS NULL THEN 0 ELSE 1 END) AS INTEGER) AS scene_cut, s.t / 24.0 AS time
FROM series s LEFT JOIN kept k ON k.run = s.run AND k.t BETWEEN s.t - 2 AND s.t + 2 GROUP BY 1, 2""")
def e6_scene_features(spark, d):
    out = scenes.scene_features(series(spark, d), "content", signal="value", threshold=400, fps=24.0, dilation_window=4 / 24)
    return out.select("run", "t", "scene_cut", "time")


# -- permutation tests: hourly prediction = the series three hours before ------------------------

def scored(spark, d) -> DataFrame:
    lag = windows.delay(series(spark, d), [3], ["value"])
    return lag.select(F.col("run").alias("target"), "t", F.col("value").alias("y"), F.col("value_d3").alias("p"))


_SCORED = """scored AS (SELECT run AS target, t, value AS y, coalesce(lag(value, 3) OVER (PARTITION BY run ORDER BY t), 0) AS p FROM series)"""
BLOCK = 48
_BLOCK_NULL = f"""{regular_sql()}, {_SCORED}, m AS (SELECT CAST((max(t) + 1) // {BLOCK} AS INTEGER) AS nb FROM scored),
cut AS (SELECT scored.*, t // {BLOCK} AS b, t % {BLOCK} AS o FROM scored, m WHERE t < nb * {BLOCK}),
perms AS (SELECT CAST(row_number() OVER (ORDER BY a, c) - 1 AS INTEGER) AS perm, a, c FROM (SELECT unnest([1, 2, 4]) AS a), (SELECT unnest(range(0, 15)) AS c)),
map AS (SELECT perm, b AS b1, (a * b + c) % nb AS b2 FROM perms, m, (SELECT unnest(range(0, (SELECT nb FROM m))) AS b)),
null_r AS (SELECT perm, d.target, coalesce(covar_pop(s.y, d.p) / nullif(stddev_pop(s.y) * stddev_pop(d.p), 0), 0) AS stat
  FROM map JOIN cut d ON d.b = b1 JOIN cut s ON s.b = b2 AND s.o = d.o AND s.target = d.target GROUP BY 1, 2),
obs AS (SELECT target, coalesce(covar_pop(y, p) / nullif(stddev_pop(y) * stddev_pop(p), 0), 0) AS stat FROM cut GROUP BY 1)"""


def blocked(spark, d) -> DataFrame:
    return windows.blocks(scored(spark, d), BLOCK, n_rows=last_step(spark, d, HOUR) + 1, tail="drop")


def n_steps(spark, d) -> int:
    """Grid length as a number (one aggregated row)."""
    return samples(spark, d).agg(F.floor(F.max("time") / HOUR).alias("t")).first()["t"] + 1


def block_perms(spark, d) -> DataFrame:
    """45 arithmetic permutations of the blocks: b2 = (a*b1 + c) mod blocks, a in {1, 2, 4}."""
    nb = F.floor((last_step(spark, d, HOUR) + 1) / BLOCK).cast("int")
    draws = spark.range(45).select(
        F.col("id").cast("int").alias("perm"), F.element_at(F.array(F.lit(1), F.lit(2), F.lit(4)), (F.floor(F.col("id") / 15) + 1).cast("int")).alias("a"),
        (F.col("id") % 15).alias("c"))
    rows = draws.select("*", F.explode(F.sequence(F.lit(0), nb - 1)).alias("b1"), nb.alias("nb"))
    return rows.select("perm", "b1", F.pmod(F.col("a") * F.col("b1") + F.col("c"), F.col("nb")).cast("int").alias("b2"))


def block_null(spark, d) -> DataFrame:
    return inference.block_permutation(blocked(spark, d), block_perms(spark, d))


def observed(spark, d) -> DataFrame:
    return inference.array_correlation(blocked(spark, d), "y", "p", ["target"], name="stat")


@query("m9_block_permutation", f"WITH {_BLOCK_NULL} SELECT perm, target, round(stat, 6) AS stat FROM null_r")
def m9_block_permutation(spark, d):
    return block_null(spark, d).select("perm", "target", F.round("stat", 6).alias("stat"))


@query("m9_user_metric", f"""WITH {_BLOCK_NULL} SELECT perm, d.target, round(avg(abs(s.y - d.p)), 6) AS stat
  FROM map JOIN cut d ON d.b = b1 JOIN cut s ON s.b = b2 AND s.o = d.o AND s.target = d.target GROUP BY 1, 2""")
def m9_user_metric(spark, d):
    def mean_gap(t, p):
        return abs(t - p).mean(axis=0)

    out = inference.permutation_metric(blocked(spark, d), block_perms(spark, d), mean_gap)
    return out.select("perm", "target", F.round("stat", 6).alias("stat"))


@query("m9_mergeable_metric", f"""WITH {_BLOCK_NULL} SELECT perm, d.target, round(avg(abs(s.y - d.p)), 6) AS stat
  FROM map JOIN cut d ON d.b = b1 JOIN cut s ON s.b = b2 AND s.o = d.o AND s.target = d.target GROUP BY 1, 2""")
def m9_mergeable_metric(spark, d):
    """The mean absolute error from sums of block pairs."""
    out = inference.block_metric(blocked(spark, d), block_perms(spark, d), inference.MEAN_ABSOLUTE_ERROR)
    return out.select("perm", "target", F.round("stat", 6).alias("stat"))


@query("m10_timeshift_metric", f"""WITH {regular_sql()}, {_SCORED}, m AS (SELECT max(t) + 1 AS n FROM scored), s AS (SELECT unnest(range(0, (SELECT max(t) + 1 FROM scored), 24)) AS s)
SELECT CAST(s // 24 AS INTEGER) AS perm, a.target, round(avg(abs(a.y - b.p)), 6) AS stat
FROM s, m, scored a JOIN scored b ON b.target = a.target AND b.t = (a.t + s) % n GROUP BY 1, 2""")
def m10_timeshift_metric(spark, d):
    shifts = spark.range(-(-n_steps(spark, d) // 24)).select(F.col("id").cast("int").alias("perm"), (F.col("id") * 24).alias("shift"))
    out = inference.timeshift_metric(scored(spark, d), shifts, inference.MEAN_ABSOLUTE_ERROR, n_rows=n_steps(spark, d), block_rows=100)
    return out.select("perm", "target", F.round("stat", 6).alias("stat"))


@query("m10_timeshift", f"""WITH {regular_sql()}, {_SCORED}, m AS (SELECT max(t) + 1 AS n FROM scored), s AS (SELECT unnest(range(0, (SELECT max(t) + 1 FROM scored), 24)) AS s)
SELECT CAST(s // 24 AS INTEGER) AS perm, a.target, round(covar_pop(a.y, b.p) / (stddev_pop(a.y) * stddev_pop(b.p)), 6) AS stat
FROM s, m, scored a JOIN scored b ON b.target = a.target AND b.t = (a.t + s) % n GROUP BY 1, 2""")
def m10_timeshift(spark, d):
    shifts = spark.range(-(-n_steps(spark, d) // 24)).select(F.col("id").cast("int").alias("perm"), (F.col("id") * 24).alias("shift"))
    out = inference.timeshift_permutation(scored(spark, d), shifts, n_rows=n_steps(spark, d), block_rows=256, target_groups=4)
    return out.select("perm", "target", F.round("stat", 6).alias("stat"))


_EXTREME = {"two-sided": "abs(n.stat) >= abs(o.stat)", "left": "n.stat <= o.stat", "right": "n.stat >= o.stat"}
for _side in _EXTREME:
    @query(f"a3_p_from_null_{_side.replace('-', '_')}", f"""WITH {_BLOCK_NULL} SELECT n.target, round(any_value(o.stat), 6) AS observed,
  round((any_value(o.stat) - avg(n.stat)) / stddev_pop(n.stat), 4) AS z, round((count(*) FILTER (WHERE {_EXTREME[_side].replace('n.stat', 'round(n.stat, 9)').replace('o.stat', 'round(o.stat, 9)')}) + 1) / (count(*) + 1), 9) AS p
FROM null_r n JOIN obs o USING (target) GROUP BY 1""")
    def a3_p_from_null(spark, d, side=_side):
        # the identity permutation ties with the observed value up to rounding
        obs = observed(spark, d).withColumn("stat", F.round("stat", 9))
        null = block_null(spark, d).withColumn("stat", F.round("stat", 9))
        out = inference.p_from_null(obs, null, side=side)
        return out.select("target", F.round("observed", 6).alias("observed"), F.round("z", 4).alias("z"), F.round("p", 9).alias("p"))


@query("p14_threshold", f"""WITH {_BLOCK_NULL}, q AS (SELECT n.target, any_value(o.stat) AS stat, (count(*) FILTER (WHERE round(n.stat, 9) >= round(o.stat, 9)) + 1) / (count(*) + 1) AS p FROM null_r n JOIN obs o USING (target) GROUP BY 1)
SELECT target, CASE WHEN p < 0.5 THEN round(stat, 6) END AS value FROM q""")
def p14_threshold(spark, d):
    obs = observed(spark, d).withColumn("stat", F.round("stat", 9))
    null = block_null(spark, d).withColumn("stat", F.round("stat", 9))
    out = inference.p_from_null(obs, null, side="right")
    return out.select("target", F.round(inference.p_threshold(F.col("observed"), F.col("p"), 0.5), 6).alias("value"))


# -- multiple comparisons: one p per customer from the balance's rank within its nation ------------

_P = """pv AS (SELECT c_custkey, round((count(*) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC RANGE UNBOUNDED PRECEDING)) / (count(*) OVER (PARTITION BY c_nationkey) + 1), 12) AS p FROM customer),
rk AS (SELECT p, count(*) AS c, sum(count(*)) OVER (ORDER BY p) AS hi, sum(count(*)) OVER () AS m FROM pv GROUP BY p)"""
_ADJ = {
    "bonferroni": "p * m",
    "sidak": "1 - pow(1 - p, m)",
    "holm": "max(p * (m - hi + c)) OVER (ORDER BY p)",
    "holm-sidak": "max(1 - pow(1 - p, m - hi + c)) OVER (ORDER BY p)",
    "simes-hochberg": "min(p * (m - hi + 1)) OVER (ORDER BY p DESC)",
    "fdr_bh": "min(p * m / hi) OVER (ORDER BY p DESC)",
    "fdr_by": "min(p * m * (SELECT sum(1.0 / i) FROM range(1, (SELECT CAST(max(m) AS BIGINT) + 1 FROM rk)) t(i)) / hi) OVER (ORDER BY p DESC)",
}


def rank_p(spark, d) -> DataFrame:
    from pyspark.sql import Window

    from sigframe.workload.registry import table

    w = Window.partitionBy("c_nationkey")
    rank = F.count(F.lit(1)).over(w.orderBy(F.col("c_acctbal").desc()))
    return table(spark, d, "customer").select("c_custkey", F.round(rank / (F.count(F.lit(1)).over(w) + 1), 12).alias("p"))


for _m in _ADJ:
    @query(f"a4_{_m.replace('-', '_')}", f"WITH {_P} SELECT c_custkey, p, round(least(a, 1), 9) AS p_adj FROM pv JOIN (SELECT p, {_ADJ[_m]} AS a FROM rk) USING (p)")
    def a4_adjust(spark, d, method=_m):
        return inference.adjust_p(rank_p(spark, d), method).select("c_custkey", "p", F.round("p_adj", 9).alias("p_adj"))


_LEVEL = 0.2
_SMALL = _P.replace("+ 1), 12) AS p FROM customer)", "+ 1), 12) AS p0, round(p0 * p0 * p0 * p0, 12) AS p FROM customer UNION ALL SELECT NULL, NULL, NULL UNION ALL SELECT -1, NULL, 'NaN'::DOUBLE)", 1).replace(
    "FROM pv GROUP BY p", "FROM pv WHERE NOT isnan(p) GROUP BY p", 1)


for _m, _fact in (("fdr_tsbh", 1.0), ("fdr_tsbky", 1 + _LEVEL)):
    @query(f"a4_{_m}", f"""WITH {_SMALL}, bh AS (SELECT p, c, m, least(min(p * m / hi) OVER (ORDER BY p DESC), 1) AS q FROM rk),
f AS (SELECT max(m) AS m, coalesce(sum(c) FILTER (WHERE q <= {_LEVEL} / {_fact}), 0) AS found FROM bh),
s AS (SELECT CASE WHEN found > 0 AND found < m THEN (m - found) / m ELSE 1 END AS share FROM f)
SELECT pv.c_custkey, CASE WHEN NOT isnan(pv.p) THEN pv.p END AS p, round(CASE WHEN q IS NOT NULL THEN least(q * share * {_fact}, 1) END, 9) AS p_adj FROM pv LEFT JOIN (SELECT p, q, share FROM bh, s) x ON x.p = pv.p""")
    def a4_two_stage(spark, d, method=_m):
        """Small p values, tied ones, one missing and one NaN."""
        p = rank_p(spark, d).withColumn("p", F.round(F.col("p") * F.col("p") * F.col("p") * F.col("p"), 12))
        p = p.unionAll(spark.range(1).selectExpr("CAST(NULL AS BIGINT)", "CAST(NULL AS DOUBLE)")).unionAll(spark.range(1).selectExpr("-1L", "double('NaN')"))
        out = inference.adjust_p(p, method, alpha=_LEVEL)
        return out.select("c_custkey", F.when(~F.isnan("p"), F.col("p")).alias("p"), F.round("p_adj", 9).alias("p_adj"))


@query("a5_threshold_scores", """WITH z AS (SELECT c_custkey, (c_acctbal - avg(c_acctbal) OVER ()) / 1500 AS z FROM customer),
x AS (SELECT *, abs(z) / sqrt(2) AS x, 1 / (1 + 0.5 * abs(z) / sqrt(2)) AS t FROM z),
pv AS (SELECT c_custkey, z, least(1, t * exp(-x * x - 1.26551223 + t * (1.00002368 + t * (0.37409196 + t * (0.09678418 + t * (-0.18628806 + t * (0.27886807
  + t * (-1.13520398 + t * (1.48851587 + t * (-0.82215223 + t * 0.17087277)))))))))) AS p FROM x),
rk AS (SELECT *, count(*) OVER (ORDER BY p) AS hi, count(*) OVER () AS m FROM pv),
ad AS (SELECT *, min(p * m / hi) OVER (ORDER BY p DESC) AS p_adj FROM rk)
SELECT c_custkey, round(CASE WHEN p_adj < 0.05 THEN z ELSE 0 END, 6) AS thresholded FROM ad""")
def a5_threshold_scores(spark, d):
    from sigframe.workload.registry import table

    c = table(spark, d, "customer")
    mean = c.agg(F.avg("c_acctbal")).scalar()
    z = c.select("c_custkey", ((F.col("c_acctbal") - mean) / 1500).alias("z"))
    return inference.threshold_scores(z).select("c_custkey", F.round("thresholded", 6).alias("thresholded"))


@query("m11_random_indices")
def m11_random_indices(spark, d):
    """Drawn permutations of the blocks applied to the series: block totals per draw."""
    n_blocks = n_steps(spark, d) // BLOCK
    draws = inference.random_indices(spark, n_blocks, 20, "permutation", seed=11).select("perm", F.col("i").alias("b1"), F.col("idx").alias("b2"))
    return inference.block_permutation(blocked(spark, d), draws)


# -- spectra ------------------------------------------------------------------------------------------

@query("e1_frames", f"""WITH {regular_sql()}, c AS (SELECT run, t, value, (SELECT max(t) FROM series) AS last FROM series),
p AS (SELECT run, value, t + 8 AS pos, last FROM c UNION ALL SELECT run, value, 8 - t, last FROM c WHERE t BETWEEN 1 AND 8
  UNION ALL SELECT run, value, 2 * last - t + 8, last FROM c WHERE t < last AND t >= last - 8)
SELECT run, f AS frame, count(*) AS n, round(sum(value), 2) AS total FROM p, (SELECT unnest(range(0, 2000)) AS f)
WHERE f <= (last + 1) // 4 AND pos >= f * 4 AND pos < f * 4 + 16 GROUP BY 1, 2""")
def e1_frames(spark, d):
    s = series(spark, d)
    fr = spectral.frame_samples(s, n_samples=last_step(spark, d, HOUR) + 1, n_fft=16, hop=4, index_col="t", value_col="value")
    return fr.select("run", "frame", F.size("samples").cast("long").alias("n"),
                     F.round(F.aggregate("samples", F.lit(0.0), lambda a, v: a + v), 2).alias("total"))


@query("e1_spectral")
def e1_spectral(spark, d):
    s = series(spark, d)
    mel = spectral.spectral_features(s, sr=24.0, n_samples=last_step(spark, d, HOUR) + 1, n_fft=64, hop=16, n_mels=8, index_col="t", value_col="value")
    return mel.select("run", "frame", F.posexplode("mel").alias("band", "power"))


