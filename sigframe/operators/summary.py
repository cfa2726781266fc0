"""Distribution summaries behind the usual plots."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F


def exact_quantiles(df: DataFrame, group_cols: Sequence[str], value: str, probs: Sequence[float],
                    accuracy: int = 10000) -> DataFrame:
    """Exact linear-interpolated quantiles per group as (group, prob, quantile, n).

    A mergeable sketch brackets each quantile within 2/accuracy of the ranks. Rows outside the
    bracket collapse to one count and edge value per group on the map side, rows inside to
    distinct values with counts, and only those few are ranked. No group is sorted whole.
    """
    eps = 2.0 / accuracy
    lows = [max(0.0, p - eps) for p in probs]
    highs = [min(1.0, p + eps) for p in probs]
    marks = F.percentile_approx(value, lows + highs, accuracy)
    k = len(probs)
    have = df.where(F.col(value).isNotNull())
    bounds = have.groupBy(*group_cols).agg(marks.alias("_m")).select(
        *group_cols,
        F.array(*[
            F.struct(F.lit(float(p)).alias("prob"), F.get("_m", F.lit(i)).alias("lo"), F.get("_m", F.lit(i + k)).alias("hi"))
            for i, p in enumerate(probs)
        ]).alias("_b"))
    rows = have.select(*group_cols, F.col(value).cast("double").alias("_v"))
    if group_cols:
        tagged = rows.join(bounds, list(group_cols)).select(*group_cols, "_v", F.explode("_b").alias("_b"))
    else:
        tagged = rows.select("_v", F.explode(bounds.select("_b").scalar()).alias("_b"))
    v = F.col("_v")
    band = F.when(v < F.col("_b.lo"), -1).when(v > F.col("_b.hi"), 1).otherwise(0)
    tagged = tagged.select(*group_cols, F.col("_b.prob").alias("prob"), v, band.alias("_band"), F.when(band == 0, v).alias("_cell"))
    counts = tagged.groupBy(*group_cols, "prob", "_band", "_cell").agg(
        F.count(F.lit(1)).alias("_c"), F.max("_v").alias("_max"), F.min("_v").alias("_min"))
    edge = F.when(F.col("_band") < 0, F.col("_max")).otherwise(F.col("_min"))
    w = Window.partitionBy(*group_cols, "prob").orderBy("_band", "_cell")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.select(
        *group_cols, "prob", edge.alias("_v"), "_c", F.sum("_c").over(upto).alias("_end"),
        F.sum("_c").over(Window.partitionBy(*group_cols, "prob")).alias("n"))
    pos = (F.col("n") - 1) * F.col("prob")
    holds = lambda rank: (rank >= F.col("_end") - F.col("_c")) & (rank < F.col("_end"))
    picked = ranked.groupBy(*group_cols, "prob", "n").agg(
        F.max(F.when(holds(F.floor(pos)), F.col("_v"))).alias("_a"),
        F.max(F.when(holds(F.ceil(pos)), F.col("_v"))).alias("_z"))
    share = pos - F.floor(pos)
    return picked.select(*group_cols, "prob", (F.col("_a") + (F.col("_z") - F.col("_a")) * share).alias("quantile"), "n")


def box_summary(df: DataFrame, group_cols: Sequence[str], value: str, whisker: float = 1.5) -> DataFrame:
    """Quartiles and the whisker ends (furthest values within ``whisker`` IQRs), fliers left out."""
    q = exact_quantiles(df, group_cols, value, [0.25, 0.5, 0.75])
    pick = lambda p: F.max(F.when(F.col("prob") == p, F.col("quantile")))
    q = q.groupBy(*group_cols).agg(pick(0.25).alias("q1"), pick(0.5).alias("median"), pick(0.75).alias("q3"), F.max("n").alias("n"))
    iqr = F.col("q3") - F.col("q1")
    inside = (F.col(value) >= F.col("q1") - whisker * iqr) & (F.col(value) <= F.col("q3") + whisker * iqr)
    # the quartiles ride along as grouping columns, so they are not computed again for a join
    return df.join(q, list(group_cols)).where(inside).groupBy(*group_cols, "q1", "median", "q3", "n").agg(
        F.min(value).alias("whisker_low"), F.max(value).alias("whisker_high"))


def mean_interval(df: DataFrame, group_cols: Sequence[str], value: str, z: float = 1.959963984540054) -> DataFrame:
    """Mean and normal-theory interval."""
    out = df.groupBy(*group_cols).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("_sd"), F.count(value).alias("n"))
    half = F.lit(z) * F.col("_sd") / F.sqrt("n")
    return out.select(*group_cols, "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"), "n")


def bootstrap_interval(df: DataFrame, group_cols: Sequence[str], value: str, key_cols: Sequence[str], *,
                       replicates: int = 1000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """Mean with a Poisson-bootstrap interval.

    Each row draws its weight in each replicate from a hash of its key, so results repeat
    under any partitioning; tasks send one (weight, weighted sum) per group and replicate.
    """
    fields = df.select(*group_cols).schema
    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields)
    # Poisson(1) distribution function at 0, 1, 2, ...
    cdf = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate([[1.0], np.arange(1.0, 18.0)])))
    salts = np.random.default_rng(seed).integers(0, 2**63, replicates, dtype=np.uint64)
    groups = list(group_cols)

    def mix(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict = {}
        for pdf in batches:
            for key, part in pdf.groupby(groups, dropna=False, sort=False):
                w_sum, v_sum = acc.setdefault(key, (np.zeros(replicates), np.zeros(replicates)))
                h, v = part["_h"].to_numpy().astype(np.uint64), part["_v"].to_numpy()
                for at in range(0, len(h), 2048):
                    u = mix(h[at:at + 2048, None] ^ salts[None, :]) >> np.uint64(11)
                    w = np.searchsorted(cdf, (u * 2.0 ** -53).ravel()).reshape(u.shape)
                    w_sum += w.sum(axis=0)
                    v_sum += v[at:at + 2048] @ w
        for key, (w_sum, v_sum) in acc.items():
            out = pd.DataFrame({"rep": np.arange(replicates, dtype="int32"), "w": w_sum, "wv": v_sum})
            for name, k in zip(groups, key):
                out[name] = k
            yield out[[*groups, "rep", "w", "wv"]]

    rows = df.where(F.col(value).isNotNull()).select(
        *groups, F.xxhash64(F.lit(seed), *key_cols).alias("_h"), F.col(value).cast("double").alias("_v"))
    reps = rows.mapInPandas(partial, ddl + "rep int, w double, wv double").groupBy(*groups, "rep").agg(
        F.try_divide(F.sum("wv"), F.sum("w")).alias("_m"))
    tail = (1 - level) / 2
    # a group has exactly ``replicates`` rows here
    ends = reps.groupBy(*groups).agg(F.percentile("_m", [tail, 1 - tail]).alias("_q"))
    means = df.groupBy(*groups).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return means.join(ends, groups).select(
        *groups, "mean", F.get("_q", F.lit(0)).alias("low"), F.get("_q", F.lit(1)).alias("high"), "n")


def paired_change(df: DataFrame, unit: str, group: str, value: str, first: str, second: str) -> DataFrame:
    """Mean per unit in two groups and their difference, for units seen in both."""
    wide = df.groupBy(unit).agg(
        F.avg(F.when(F.col(group) == first, F.col(value))).alias("first"),
        F.avg(F.when(F.col(group) == second, F.col(value))).alias("second"))
    return wide.where("first is not null and second is not null").withColumn("change", F.col("second") - F.col("first"))


def density(df: DataFrame, group_col: str, value: str, *, points: int = 64, cut: float = 2.0) -> DataFrame:
    """Gaussian kernel density on an even grid per category, Scott bandwidth, ends ``cut`` bandwidths out.

    Equal values are counted first, then each distinct value adds its kernel to the grid.
    """
    v = F.col(value)
    stats = df.groupBy(group_col).agg(
        F.count(value).alias("_n"), F.stddev_samp(value).alias("_sd"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    stats = stats.where("_sd > 0").withColumn("bandwidth", F.col("_sd") * F.pow(F.col("_n"), F.lit(-0.2)))
    stats = stats.select(
        group_col, "_n", "bandwidth", (F.col("_lo") - cut * F.col("bandwidth")).alias("_start"),
        ((F.col("_hi") - F.col("_lo") + 2 * cut * F.col("bandwidth")) / (points - 1)).alias("_step"))
    counted = df.where(v.isNotNull()).groupBy(group_col, v.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    cells = counted.join(stats, group_col).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    at = F.col("_start") + F.col("point") * F.col("_step")
    z = (at - F.col("_v")) / F.col("bandwidth")
    kernel = F.exp(-0.5 * z * z) * F.col("_c") / (F.col("_n") * F.col("bandwidth") * 2.5066282746310002)
    return cells.groupBy(group_col, "point").agg(F.first(at).alias("x"), F.sum(kernel).alias("density"))


def correlation_matrix(df: DataFrame, value_cols: Sequence[str], *, group_cols: Sequence[str] = ()) -> DataFrame:
    """All variable pairs (a, b, r), from one aggregation over the wide layout."""
    from sigframe.operators.inference import correlation

    pairs = [(a, b) for i, a in enumerate(value_cols) for b in value_cols[i:]]
    aggs = [correlation(F.col(a), F.col(b)).alias(f"_r{i}") for i, (a, b) in enumerate(pairs)]
    one = df.groupBy(*group_cols).agg(*aggs)
    cells = []
    for i, (a, b) in enumerate(pairs):
        for u, v in {(a, b), (b, a)}:
            cells.append(F.struct(F.lit(u).alias("a"), F.lit(v).alias("b"), F.col(f"_r{i}").alias("r")))
    return one.select(*group_cols, F.explode(F.array(*cells)).alias("c")).select(*group_cols, "c.*")


def hierarchy(df: DataFrame, levels: Sequence[str], value: Column) -> DataFrame:
    """Means along a label hierarchy, with ``level`` = number of labels kept."""
    out = df.rollup(*levels).agg(F.avg(value).alias("mean"), F.count(value).alias("n"), F.grouping_id().alias("_g"))
    depth = sum(((F.shiftright(F.col("_g"), i) % 2 == 0).cast("int") for i in range(len(levels))), F.lit(0))
    return out.withColumn("level", depth.cast("int")).drop("_g")
