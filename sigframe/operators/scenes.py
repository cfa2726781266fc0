"""Change points in per-frame signals."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from sigframe.operators.segments import SEG, over_rows, segment_of
from sigframe.operators.windows import dilate
from sigframe.session import written

# Default thresholds per detector.
THRESHOLDS = {"content": 27.0, "adaptive": 3.0, "threshold": 12.0, "hash": 0.395}


def change_score(df: DataFrame, signal: str, *, partition_cols: Sequence[str], order_col: str,
                 name: str = "score") -> DataFrame:
    """Absolute change against the previous frame, 0 on the first."""
    return over_rows(
        df, {name: lambda w: F.coalesce(F.abs(F.col(signal) - F.lag(signal).over(w)), F.lit(0.0))},
        partition_cols=partition_cols, order_col=order_col, before=1,
    )


def candidate_cuts(df: DataFrame, detector: str, *, signal: str = "signal", threshold: float | None = None,
                   partition_cols: Sequence[str] = ("run",), order_col: str = "t",
                   window_width: int = 2, min_content_val: float = 15.0, bits: int = 64,
                   add_final_scene: bool = True, fade_bias: float = 0.0) -> DataFrame:
    """Add the boolean ``cut``.

    content    change score at or over the threshold
    adaptive   score over the mean of its neighbours (itself left out) and at least ``min_content_val``
    threshold  the signal rises from below the level to it (fade in, moved back towards the
               matching fade out by ``fade_bias``); a series that ends dark closes with a final scene
    hash       share of differing bits against the previous frame over the threshold
    """
    if detector not in THRESHOLDS:
        raise ValueError(f"no detector {detector!r}; there are {', '.join(sorted(THRESHOLDS))}")
    thr = THRESHOLDS[detector] if threshold is None else threshold
    keys = dict(partition_cols=partition_cols, order_col=order_col)
    if detector == "content":
        out = change_score(df, signal, **keys)
        return out.withColumn("cut", F.col("score") >= thr)
    if detector == "adaptive":
        k = window_width
        out = change_score(df, signal, **keys)

        def ratio(w) -> Column:
            frame = w.rowsBetween(-k, k)
            others = F.sum("score").over(frame) - F.col("score")
            n = F.count("score").over(frame) - 1
            mean = F.try_divide(others, n)
            return F.when(mean > 0, F.col("score") / mean).when(F.col("score") > 0, 255.0).otherwise(0.0)

        out = over_rows(out, {"ratio": ratio}, before=k, after=k, **keys)
        return out.withColumn("cut", (F.col("ratio") >= thr) & (F.col("score") >= min_content_val))
    if detector == "hash":
        out = over_rows(
            df, {"score": lambda w: F.coalesce(
                F.bit_count(F.col(signal).bitwiseXOR(F.lag(signal).over(w))) / F.lit(float(bits)), F.lit(0.0))},
            before=1, **keys)
        return out.withColumn("cut", F.col("score") > thr)
    return _fade_cuts(df, signal, thr, fade_bias, add_final_scene, partition_cols, order_col)


def _fade_cuts(df: DataFrame, signal: str, thr: float, bias: float, final: bool,
               parts: Sequence[str], t: str) -> DataFrame:
    """A fade pairs the last fade out with the next fade in; the cut lies between the two."""
    dark = F.col(signal) < thr
    edge = over_rows(
        df.withColumn("_dark", dark), {"_was": lambda w: F.lag("_dark").over(w)},
        partition_cols=parts, order_col=t, before=1,
    )
    edge = edge.withColumn("_out", F.col("_dark") & ~F.coalesce("_was", F.lit(False)))
    edge = edge.withColumn("_in", ~F.col("_dark") & F.coalesce("_was", F.lit(False)))
    marks = edge.where("_out or _in").select(*parts, F.col(t).alias("_at"), "_out")
    # marks alternate, so the previous one of a fade in is its fade out
    keyed = marks.withColumn(SEG, segment_of(F.col("_at")))
    prev = _previous_mark(keyed, parts)
    at = F.floor((F.col("_prev") + F.col("_at") + F.lit(bias) * (F.col("_at") - F.col("_prev"))) / 2)
    cuts = prev.where("not _out").select(*parts, at.cast(df.schema[t].dataType).alias(t))
    if final:
        ends = edge.groupBy(*parts).agg(
            F.max(t).alias("_end"), F.max_by("_dark", t).alias("_dark_end")).where("_dark_end")
        last_out = marks.where("_out").groupBy(*parts).agg(F.max("_at").alias(t))
        cuts = cuts.unionByName(ends.join(last_out, list(parts)).select(*parts, t)).where(F.col(t) > 0)
    cuts = cuts.distinct().withColumn("cut", F.lit(True))
    return df.join(cuts, [*parts, t], "left").withColumn("cut", F.coalesce("cut", F.lit(False)))


def _previous_mark(keyed: DataFrame, parts: Sequence[str]) -> DataFrame:
    """The mark before each mark, through per-segment last marks."""
    last = keyed.groupBy(*parts, SEG).agg(F.max("_at").alias("_last"))
    carry = last.select(*parts, SEG, F.lag("_last").over(Window.partitionBy(*parts).orderBy(SEG)).alias("_carry"))
    local = F.lag("_at").over(Window.partitionBy(*parts, SEG).orderBy("_at"))
    return keyed.withColumn("_prev", local).join(carry, [*parts, SEG]).withColumn(
        "_prev", F.coalesce("_prev", "_carry"))


def _entries(table: DataFrame, min_len: int, parts: Sequence[str]) -> DataFrame:
    """(parts, segment, _entry) of tables (parts, segment, _exit[]): the distance that each segment is entered with.

    Tables of neighbours are composed, then those of pairs, of fours and so on, one join a round, until each reaches back to where its entry
    does not matter: a run's start counts as a kept cut, and after an empty segment all are free. Rounds are about the
    logarithm of the longest chain, and no row holds more than one table.
    """
    order = Window.partitionBy(*parts).orderBy(SEG)
    free = F.when(F.col(SEG) == 0, 0).otherwise(min_len)
    table = table.select(*parts, SEG, "_exit", F.row_number().over(order).alias("_i"), (F.col(SEG) - F.lag(SEG).over(order)).alias("_gap"))
    first = F.col("_gap").isNull() | (F.col("_gap") > 1)
    table = written(table.select(*parts, SEG, "_i", first.alias("_first"), F.when(first, F.array_repeat(F.element_at("_exit", free + 1), min_len + 1)).otherwise(F.col("_exit")).alias("_f")), "tables")
    step = 1
    while not table.where(F.array_min("_f") < F.array_max("_f")).isEmpty():
        before = table.select(*parts, (F.col("_i") + step).alias("_i"), F.col("_f").alias("_before"))
        both = table.join(before, [*parts, "_i"], "left")
        table = written(both.withColumn("_f", F.when(F.col("_before").isNull(), F.col("_f")).otherwise(F.transform("_before", lambda e: F.get("_f", e)))).drop("_before"), "tables")
        step *= 2
    exits = table.select(*parts, (F.col("_i") + 1).alias("_i"), F.get("_f", F.lit(0)).alias("_out"))
    return table.join(exits, [*parts, "_i"], "left").select(*parts, SEG, F.when(F.col("_first"), free).otherwise(F.col("_out")).alias("_entry"))


def spaced_cuts(cuts: DataFrame, min_len: int, *, partition_cols: Sequence[str] = ("run",),
                order_col: str = "t", rows: int = 65536) -> DataFrame:
    """Keep a cut only if it lies at least ``min_len`` frames after the last kept one (or the start).

    The rule is sequential, but all a segment needs from its past is how far back the last kept
    cut lies, and that matters only up to ``min_len``. Each segment therefore reports its exit
    distance for every entry distance; those small tables are composed by doubling, and the segments
    then resolve their own cuts independently.
    """
    rows = max(rows, min_len)
    parts = list(partition_cols)
    keyed = cuts.select(*parts, F.col(order_col).cast("long").alias("_at")).withColumn(
        SEG, segment_of(F.col("_at"), rows))
    part_ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cuts.select(*parts).schema)

    def walk(at, start: int, entry: int):
        last, kept = start - entry, []
        for a in at:
            if a - last >= min_len:
                last = a
                kept.append(a)
        return last, kept

    def exits(pdf: pd.DataFrame) -> pd.DataFrame:
        at = sorted(pdf["_at"].tolist())
        start = int(pdf[SEG].iloc[0]) * rows
        row = {p: pdf[p].iloc[0] for p in parts}
        row[SEG] = int(pdf[SEG].iloc[0])
        row["_exit"] = [int(min(start + rows - walk(at, start, e)[0], min_len)) for e in range(min_len + 1)]
        return pd.DataFrame([row])

    table = keyed.groupBy(*parts, SEG).applyInPandas(exits, f"{part_ddl}, {SEG} long, _exit array<int>")
    chain = _entries(table, min_len, parts)

    def resolve(pdf: pd.DataFrame) -> pd.DataFrame:
        start = int(pdf[SEG].iloc[0]) * rows
        kept = walk(sorted(pdf["_at"].tolist()), start, int(pdf["_entry"].iloc[0]))[1]
        out = pd.DataFrame({order_col: kept})
        for p in parts:
            out[p] = pdf[p].iloc[0]
        return out

    return keyed.join(chain, [*parts, SEG]).groupBy(*parts, SEG).applyInPandas(
        resolve, f"{part_ddl}, {order_col} long")


def scene_features(df: DataFrame, detector: str = "content", *, signal: str = "signal", fps: float = 1.0,
                   min_scene_len: int = 15, dilation_window: float = 0.0,
                   partition_cols: Sequence[str] = ("run",), order_col: str = "t", **options) -> DataFrame:
    """1 at (and around) every scene start but the first, else 0; one row per frame."""
    found = candidate_cuts(df, detector, signal=signal, partition_cols=partition_cols, order_col=order_col, **options)
    kept = spaced_cuts(found.where("cut"), min_scene_len, partition_cols=partition_cols, order_col=order_col)
    marked = (
        df.join(kept.withColumn("_hit", F.lit(1)), [*partition_cols, order_col], "left")
        .withColumn("scene_cut", F.coalesce("_hit", F.lit(0)))
        .drop("_hit")
    )
    if dilation_window > 0:
        half = math.ceil(dilation_window / 2 * fps)
        marked = dilate(marked, "scene_cut", half, partition_cols=partition_cols, order_col=order_col)
    return marked.withColumn("time", F.col(order_col) / F.lit(float(fps)))
