"""Window, resampling and summary operators against NumPy on small fixtures."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigframe.functions import arrays, scalars
from sigframe.operators import bands, events, folds, layout, resample, scenes, segments, spectral, summary, windows


def series(spark, values, run="a"):
    return spark.createDataFrame([(run, i, float(v)) for i, v in enumerate(values)], "run string, t int, value double")


def column(df, name, order="t"):
    return [r[name] for r in df.orderBy(order).collect()]


@pytest.mark.parametrize("rows", [2, 3, 7, 100])
def test_delay_matches_shifted_array_across_segments(spark, rows):
    v = np.arange(1, 12, dtype=float)
    out = windows.delay(series(spark, v), [-2, 0, 1, 3], ["value"], rows=rows)
    for d in (-2, 0, 1, 3):
        want = np.zeros_like(v)
        if d > 0:
            want[d:] = v[:-d]
        elif d < 0:
            want[:d] = v[-d:]
        else:
            want = v
        assert column(out, f"value_d{d}" if d >= 0 else f"value_dm{-d}") == want.tolist()


def test_delay_longer_than_run_and_none(spark):
    s = series(spark, [1, 2])
    assert column(windows.delay(s, [5], ["value"]), "value_d5") == [0, 0]
    assert windows.delay(s, None, ["value"]).columns == s.columns


def test_delay_arrays_round_trip(spark):
    x = series(spark, range(6)).select("run", "t", F.array("value", F.col("value") * 10).alias("x"))
    split = windows.split_delays(windows.delay(x, [0, 2], ["x"]), 2)
    rows = {(r["delay_index"], r["t"]): list(r["x"]) for r in split.collect()}
    assert rows[(0, 3)] == [3, 30] and rows[(1, 3)] == [1, 10] and rows[(1, 1)] == [0, 0]


@pytest.mark.parametrize("rows", [2, 3, 50])
def test_fill_linear_head_middle_tail(spark, rows):
    vals = [None, None, 2.0, None, None, 8.0, None, float("nan"), None]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(vals)], "run string, t int, value double")
    out = column(segments.fill_linear(df, "value", partition_cols=["run"], order_col="t", rows=rows), "value")
    assert out == [None, None, 2.0, 4.0, 6.0, 8.0, 8.0, 8.0, 8.0]


def test_row_index_and_running_sum(spark):
    df = spark.createDataFrame([("a" if i % 3 else "b", float(i * 7 % 50), 1.0) for i in range(50)], "run string, time double, v double")
    t = segments.row_index(df, partition_cols=["run"], order_cols=["time"], buckets=[F.floor(F.col("time") / 20), F.floor(F.col("time") / 5)])
    out = segments.running_sum(t, F.col("v"), "s", partition_cols=["run"], order_col="t", segment=F.floor(F.col("t") / 4)).collect()
    for run in "ab":
        mine = sorted((r for r in out if r["run"] == run), key=lambda r: r["time"])
        assert [r["t"] for r in mine] == list(range(len(mine)))
        assert [r["s"] for r in mine] == [float(i + 1) for i in range(len(mine))]


def lanczos(data, old, new, window=3, mult=1.0):
    cut = mult / np.mean(np.diff(new))
    out = np.zeros(len(new))
    for i, n in enumerate(new):
        for o, x in zip(old, data):
            u = (n - o) * cut
            w = 1.0 if u == 0 else 0.0 if abs(u) > window else window * math.sin(math.pi * u) * math.sin(math.pi * u / window) / (math.pi * u) ** 2
            out[i] += w * x
    return out


@pytest.mark.parametrize("mult", [0.5, 1.0, 2.0])
def test_lanczos_both_forms(spark, mult):
    rng = np.random.default_rng(0)
    old = np.concatenate([np.sort(rng.uniform(0, 30, 60)), [4.0, 10.0, 55.0]])
    data = rng.normal(size=len(old))
    new = np.arange(0, 40, 2.0)
    df = spark.createDataFrame([("a", float(o), float(x)) for o, x in zip(old, data)], "run string, time double, value double")
    want = lanczos(data, old, new, mult=mult)
    got = column(resample.lanczos_regular(df, step=2.0, n_points=F.lit(20), cutoff_mult=mult), "value", "k")
    np.testing.assert_allclose(got, want, atol=1e-9)
    grid = spark.createDataFrame([("a", float(n)) for n in new], "run string, time double")
    got = column(resample.lanczos_join(df, grid, mean_step=2.0, cutoff_mult=mult), "value", "time")
    np.testing.assert_allclose(got, want, atol=1e-9)
    both = resample.lanczos_regular(df, step=2.0, n_points=F.lit(20), cutoff_mult=mult, rectified=True).orderBy("k").collect()
    np.testing.assert_allclose([r["value_neg"] for r in both], lanczos(np.minimum(data, 0), old, new, mult=mult), atol=1e-9)


def test_context_windows_are_half_open(spark):
    times = [0.0, 0.5, 1.0, 2.0, 2.9, 5.0]
    df = spark.createDataFrame([("a", t, t) for t in times], "run string, time double, value double")
    out = resample.context_windows(df, step=1.0, width=2.0, n_steps=F.lit(6)).collect()
    got = {(r["k"], r["time"]) for r in out}
    want = {(k, t) for k in range(6) for t in times if max(0, k - 2.0) <= t < max(k * 1.0, 1.0)}
    assert got == want
    pooled = {r["k"]: r["value"] for r in resample.pooled_windows(df, step=1.0, panes=2, n_steps=F.lit(6)).collect()}
    for k in pooled:
        assert pooled[k] == pytest.approx(np.mean([t for kk, t in want if kk == k]))
    grid = spark.createDataFrame([("a", k * 1.0) for k in range(6)], "run string, time double")
    joined = {(r["grid_time"], r["time"]) for r in resample.context_windows_join(df, grid, width=1.5, step=0.25).collect()}
    assert joined == {(k * 1.0, t) for k in range(6) for t in times if max(0, k - 1.5) <= t < k + 0.25}


def greedy(at, gap):
    last, kept = 0, []
    for a in sorted(at):
        if a - last >= gap:
            kept.append(a)
            last = a
    return kept


@pytest.mark.parametrize("density", [0.02, 0.3, 1.0])
def test_spaced_cuts_match_sequential_rule(spark, density):
    rng = np.random.default_rng(1)
    at = np.flatnonzero(rng.uniform(size=400) < density).tolist()
    df = spark.createDataFrame([("a", i) for i in at] + [("b", 3)], "run string, t int")
    out = scenes.spaced_cuts(df, 15, rows=20).collect()
    assert sorted(r["t"] for r in out if r["run"] == "a") == greedy(at, 15)
    assert [r["t"] for r in out if r["run"] == "b"] == []


def test_scene_features_and_detectors(spark):
    v = [0.0] * 20 + [100.0] * 3 + [0.0] * 20
    out = scenes.scene_features(series(spark, v), "content", signal="value", fps=2.0, dilation_window=2.0)
    assert [i for i, m in enumerate(column(out, "scene_cut")) if m] == [18, 19, 20, 21, 22]
    fade = scenes.candidate_cuts(series(spark, [50, 50, 5, 5, 5, 50, 50, 5]), "threshold", signal="value")
    assert [i for i, c in enumerate(column(fade, "cut")) if c] == [3, 7]
    with pytest.raises(ValueError):
        scenes.candidate_cuts(series(spark, v), "none", signal="value")


def test_blocks_tail_modes(spark):
    s = series(spark, range(10)).select(F.col("run").alias("target"), "t", "value", (F.col("value") * 2).alias("p"))
    n = F.lit(10)
    assert windows.blocks(s, 4, n_rows=n, tail="drop").count() == 8
    padded = windows.blocks(s, 4, n_rows=n, tail="pad", pad_cols=["value", "p"]).orderBy("t").collect()
    assert len(padded) == 12 and padded[-1]["value"] == padded[-1]["p"] and padded[-1]["block"] == 2
    assert windows.blocks(s, 5, n_rows=n, tail="error").count() == 10
    with pytest.raises(Exception, match="multiple of block size"):
        windows.blocks(s, 4, n_rows=n, tail="error").collect()


def test_shift_run_ids_chunks(spark):
    s = series(spark, range(6))
    assert column(windows.circular_shift(s, 2, n_rows=F.lit(6)), "value") == [4, 5, 0, 1, 2, 3]
    assert column(windows.circular_shift(s, 0, n_rows=F.lit(6)), "value") == [0, 1, 2, 3, 4, 5]
    assert column(windows.run_ids(s.drop("run"), [0, 2, 5]), "run") == [0, 0, 1, 1, 1, 2]
    for bad in ([0, 2, 2], [0, 0], [0, 3, 1]):
        with pytest.raises(ValueError):
            windows.run_ids(s.drop("run"), bad)
    assert windows.chunks(s, 4).select("chunk").distinct().count() == 2
    assert windows.chunks(s, 4, keep_partial=False).count() == 4


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.log_odds(F.lit(0.0)).alias("a"), scalars.log_odds(F.lit(1.0)).alias("b"), scalars.log_odds(F.lit(0.75)).alias("c"),
        scalars.divide(F.lit(1.0), F.lit(0.0)).alias("d"), scalars.divide(F.lit(0.0), F.lit(0.0)).alias("e"),
        scalars.clean_value(F.lit(float("nan"))).alias("f"), scalars.normal_upper_tail(F.lit(1.959963984540054)).alias("g"),
        scalars.ppoint(F.lit(1.5)).alias("h")).first()
    assert row["a"] == -math.inf and row["b"] == math.inf and row["c"] == pytest.approx(math.log(3))
    assert row["d"] == math.inf and row["e"] is None and row["f"] == 0 and row["g"] == pytest.approx(0.025, rel=1e-6) and row["h"] == "1.50"


def test_clean_leaves_prices_of_the_table(spark):
    """Prices that are NULL, NaN or infinite, and rows without a status, as the query's SQL has them."""
    import duckdb

    from sigframe.session import shared_dir
    from sigframe.workload import load

    base = shared_dir(spark)
    prices = [1.5, None, float("nan"), math.inf, -math.inf, -0.0]
    rows = [(i, s, p) for i, (s, p) in enumerate((s, p) for s in ("O", "P", "F", None) for p in prices)]
    spark.createDataFrame(rows, "o_orderkey long, o_orderstatus string, o_totalprice double").coalesce(1).write.parquet(f"{base}/orders.parquet")
    queries, sql = load()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{base}/orders.parquet/*.parquet')")
    want = con.execute(f"SELECT o_orderkey, zero, top FROM ({sql['p3_clean']}) ORDER BY 1").fetchall()
    got = [tuple(r) for r in queries["p3_clean"](spark, base).select("o_orderkey", "zero", "top").orderBy("o_orderkey").collect()]
    assert repr(got) == repr(want)


def test_magnitude_bucket_keeps_order(spark):
    v = sorted([0.0, -1e-9, 1e-300, -5.0, 5.0, 5.0001, 1e300, 0.3, 0.30001, -7.2])
    got = [r["b"] for r in spark.createDataFrame([(x,) for x in v], "x double").select("x", scalars.magnitude_bucket(F.col("x")).alias("b")).orderBy("x").collect()]
    assert got == sorted(got)


def test_array_helpers(spark):
    row = spark.range(1).select(
        arrays.pad_front(F.array(F.lit(1.0)), 3).alias("a"), arrays.one_hot(F.lit(2), 4).alias("b"),
        arrays.unit(F.array(F.lit(3.0), F.lit(4.0))).alias("c"), arrays.unit(F.array(F.lit(0.0))).alias("d"),
        arrays.reduce_window(F.array(F.lit(1.0), F.lit(5.0)), "mean").alias("e"), arrays.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("f")).first()
    assert list(row["a"]) == [0, 0, 1] and list(row["b"]) == [0, 0, 1, 0] and list(row["c"]) == pytest.approx([0.6, 0.8])
    assert list(row["d"]) == [None] and row["e"] == 3 and row["f"] is None
    with pytest.raises(ValueError):
        arrays.reduce_window(F.array(F.lit(1.0)), "median")


def test_unify_layers_width_mismatch(spark):
    good = spark.createDataFrame([("A", "x", 0, [1.0]), ("B", "y", 0, [2.0, 3.0])], "list string, layer string, row int, x array<double>")
    out = {(r["list"], r["layer"]): list(r["x"]) for r in bands.unify_layers(good).collect()}
    assert out == {("A", "x"): [1.0], ("A", "y"): [0.0, 0.0], ("B", "x"): [0.0], ("B", "y"): [2.0, 3.0]}
    bad = good.union(spark.createDataFrame([("C", "x", 0, [1.0, 2.0])], good.schema))
    with pytest.raises(Exception, match="widths differ"):
        bands.unify_layers(bad).collect()


def test_join_bands_needs_matching_names(spark):
    x = series(spark, [1, 2]).select("run", "t", F.array("value").alias("x"))
    _, spaces = bands.join_bands([x, x], ["a", "b"])
    assert [tuple(r) for r in spaces.orderBy("start").collect()] == [("a", 0, 1), ("b", 1, 2)]
    with pytest.raises(ValueError):
        bands.join_bands([x], ["a", "b"])


def test_standardise_constant(spark):
    s = series(spark, [3, 3, 3]).union(series(spark, [1, 2, 3], "b"))
    out = bands.standardise(s, keys=["run"]).collect()
    assert [r["value"] for r in out if r["run"] == "a"] == [0, 0, 0]
    assert np.std([r["value"] for r in out if r["run"] == "b"]) == pytest.approx(1)


def test_folds(spark):
    runs = spark.createDataFrame([(i,) for i in range(4)], "run int")
    f = folds.leave_runs_out(runs, 4, 2).collect()
    assert len({r["fold"] for r in f}) == 6
    for k in range(6):
        assert sum(r["is_val"] for r in f if r["fold"] == k) == 2
    shuffled = folds.leave_runs_out(runs, 4, 2, seed=3).collect()
    key = lambda rows: {frozenset(r["run"] for r in rows if r["fold"] == k and r["is_val"]) for k in range(6)}
    assert key(f) == key(shuffled)
    with pytest.raises(ValueError):
        folds.leave_runs_out(runs, 4, 4)


def test_split_group_level_reuses_rows(spark):
    s = series(spark, [1.0, float("inf"), float("nan")])
    a, b = folds.split(s, ["x"], ["y"], ["value"], group_level=True)
    assert column(a, "value") == column(b, "value") == [1, 0, 0]


@pytest.mark.parametrize("n", [1, 2, 3, 6, 7, 500])
def test_exact_quantiles(spark, n):
    rng = np.random.default_rng(n)
    v = np.round(rng.lognormal(size=n), 2)
    df = spark.createDataFrame([("a", float(x)) for x in v], "g string, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    for accuracy in (50, 10000):
        got = {r["prob"]: r["quantile"] for r in summary.exact_quantiles(df, ["g"], "v", probs, accuracy=accuracy).collect()}
        np.testing.assert_allclose([got[p] for p in probs], np.percentile(v, [100 * p for p in probs]))


def test_exact_quantiles_with_one_hot_value(spark):
    v = [5.0] * 3000 + list(range(1000))
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    got = {r["prob"]: r["quantile"] for r in summary.exact_quantiles(df, [], "v", [0.2, 0.9], accuracy=100).collect()}
    np.testing.assert_allclose([got[0.2], got[0.9]], np.percentile(v, [20, 90]))


def test_bootstrap_is_stable_and_covers(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, "a", float(x)) for i, x in enumerate(rng.normal(10, 2, 2000))], "id long, g string, v double")
    one = summary.bootstrap_interval(df, ["g"], "v", ["id"], replicates=300).first()
    two = summary.bootstrap_interval(df.repartition(7), ["g"], "v", ["id"], replicates=300).first()
    assert one["low"] == pytest.approx(two["low"]) and one["high"] == pytest.approx(two["high"])
    normal = summary.mean_interval(df, ["g"], "v").first()
    assert one["low"] == pytest.approx(normal["low"], abs=0.03) and one["high"] == pytest.approx(normal["high"], abs=0.03)


def test_density_integrates_to_one(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([("a", float(x)) for x in rng.normal(size=200)], "g string, v double")
    rows = summary.density(df, "g", "v", points=200, cut=4).orderBy("point").collect()
    x, y = np.array([r["x"] for r in rows]), np.array([r["density"] for r in rows])
    assert np.trapezoid(y, x) == pytest.approx(1, abs=1e-3)


def test_spectral_peak_and_short_signal(spark):
    sr, n = 1000, 4000
    tone = np.sin(2 * np.pi * 200 * np.arange(n) / sr)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(tone)], "run string, n int, amp double")
    rows = spectral.spectral_features(df, sr=sr, n_samples=F.lit(n), n_fft=256, hop=128, n_mels=20).collect()
    assert len(rows) == n // 128 + 1
    bank = spectral.mel_filters(sr, 256, 20)
    peak = bank[np.argmin(abs(np.linspace(0, sr / 2, 129) - 200))].argmax()
    mid = next(r for r in rows if r["frame"] == 15)
    assert np.argmax(mid["mel"]) == peak
    # brute force for one frame
    padded = np.pad(tone, 128, mode="reflect")
    win = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(256) / 256)
    for f in (0, 15, n // 128):
        want = np.abs(np.fft.rfft(padded[f * 128:f * 128 + 256] * win)) ** 2 @ bank
        got = next(r for r in rows if r["frame"] == f)["mel"]
        np.testing.assert_allclose(got, want, rtol=1e-8, atol=1e-8)


def test_regressor_edges(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0, 3.0, "x"), ("a", 2.0, 1.0, 3.0, None), ("a", 3.0, float("nan"), 3.0, "y"), ("a", 0.5, 2.5, 1.0, "z")],
                               "run string, onset double, duration double, amplitude double, note string")
    out = events.regressors(df, "dm_am", offset=1.0, min_duration=2.0)
    assert sorted(r["regressor"] for r in out.collect()) == ["1.50*1.00:2.50", "2.00*3.00:2.00"]
    lines = events.regressor_lines(events.regressors(df, "times"), buckets=[F.floor("onset")], per_part=1).orderBy("part").collect()
    assert [r["line"] for r in lines] == ["0.50", "1.00"]


def test_layout_helpers(spark):
    wide = spark.createDataFrame([("a", 0, v, float(v)) for v in range(5)] + [("a", 1, v, float(10 + v)) for v in range(5)], "run string, t int, var int, value double")
    flipped = layout.flip(wide)
    assert flipped.agg(F.max("t")).first()[0] == 4 and flipped.where("t = 3 and var = 1").first()["value"] == 13
    with pytest.raises(ValueError):
        layout.require_columns(wide, "nope")


def test_lags_move_missing_values_and_fill_vacated_rows(spark):
    rows = [("a", 0, 1.0, [1.0]), ("a", 1, None, None), ("a", 2, 3.0, [3.0]), ("a", 3, 4.0, [4.0])]
    df = spark.createDataFrame(rows, "run string, t int, v double, x array<double>")
    got = windows.delay(df, [0, 1, -1], ["v"], rows=2).orderBy("t").collect()
    assert [(r["v_d0"], r["v_d1"], r["v_dm1"]) for r in got] == [(1.0, 0.0, None), (None, 1.0, 3.0), (3.0, None, 4.0), (4.0, 3.0, 0.0)]
    wide = windows.delay(df.where("t > 1"), [1], ["x"]).orderBy("t").collect()
    assert [r["x"] for r in wide] == [[0.0], [3.0]]


def test_a_cluster_needs_a_shared_folder(monkeypatch, spark):
    from sigframe import session

    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
    assert session.is_local("local[4]") and not session.is_local("local-cluster[2,1,1024]") and not session.is_local("yarn")


def test_runs_from_many_onsets(spark):
    """100,000 onsets; equal ones, positions before the first, and segments without onsets; the plan does not grow."""
    rows = spark.range(0, 300_000, 3).select(F.col("id").alias("t"), F.lit(1).alias("run_x"))
    onsets = spark.range(100_000).select((F.col("id") * 2 + 11).alias("t")).unionAll(spark.range(5).select((F.col("id") * 0 + 11).alias("t")))
    out = windows.run_ids_from(rows, onsets, rows=1000)
    want = F.when(F.col("t") < 11, -1).otherwise(F.least(F.floor((F.col("t") - 11) / 2), F.lit(99_999)))
    assert out.count() == 100_000 and out.where(F.col("run") != want).count() == 0 and out.where("run IS NULL").count() == 0
    few = windows.run_ids_from(rows, onsets.limit(3), rows=1000)
    size = lambda df: len(df._jdf.queryExecution().toString())
    assert size(out) < 2 * size(few)
    with_null = spark.createDataFrame([("a", 5), ("a", None), ("b", 5)], "k string, t long")
    got = {(r.k, r.t): r.run for r in windows.run_ids_from(with_null, spark.createDataFrame([("a", 5), ("a", 2)], "k string, t long"), partition_cols=["k"]).collect()}
    assert got == {("a", 5): 1, ("a", None): None, ("b", 5): -1}


def test_folds_by_rank(spark):
    """All sets of C(30, 5) in a random order without repeats, and a slice of them in lexical order."""
    from itertools import combinations, islice

    runs = spark.range(30).select((F.col("id") * 3).alias("run"))
    every = folds.folds_by_rank(runs, 30, 5, seed=4).where("is_val").groupBy("fold").agg(F.array_sort(F.collect_list("run")).alias("v"))
    counts = every.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("v").alias("d"), F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("high")).first()
    assert tuple(counts) == (142_506, 142_506, 5, 5)
    part = folds.folds_by_rank(runs, 30, 5, first=1000, n_folds=7).where("is_val").groupBy("fold").agg(F.array_sort(F.collect_list("run")).alias("v")).orderBy("fold").collect()
    assert [tuple(v // 3 for v in r.v) for r in part] == list(islice(combinations(range(30), 5), 1000, 1007)) and part[0].fold == 1000
    with pytest.raises(ValueError):
        folds.folds_by_rank(runs, 30, 30)


def test_spaced_cuts_over_ten_thousand_segments(spark, monkeypatch):
    """One run whose chain never breaks and one with pauses; rounds grow with the logarithm of the segments."""
    rng = np.random.default_rng(1)
    long_ = np.flatnonzero(rng.random(60_000) < 0.6)
    sparse = np.flatnonzero((rng.random(3000) < 0.5) & (np.arange(3000) // 50 % 3 > 0))
    cuts = spark.createDataFrame([("a", int(t)) for t in long_] + [("b", int(t)) for t in sparse], "run string, t long")
    rounds = []
    real = scenes.written
    monkeypatch.setattr(scenes, "written", lambda df, *a: rounds.append(1) or real(df, *a))
    got = {}
    for r in scenes.spaced_cuts(cuts, 5, rows=6).collect():
        got.setdefault(r.run, []).append(r.t)
    for run, at in (("a", long_), ("b", sparse)):
        last, want = 0, []
        for t in at:
            if t - last >= 5:
                last = t
                want.append(t)
        assert sorted(got[run]) == want
    assert len(rounds) <= 16
