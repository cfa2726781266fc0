"""Row-frame operators over regular series (``order_col`` is a dense integer position)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from sigframe.functions.arrays import zeros
from sigframe.operators.segments import SEGMENT_ROWS, over_rows, running_sum, segment_of


def delay(
    df: DataFrame,
    delays: Sequence[int] | None,
    cols: Sequence[str],
    *,
    partition_cols: Sequence[str] = ("run",),
    order_col: str = "t",
    rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """One copy of ``cols`` per delay; positive looks back, negative ahead, vacated rows are 0, NULL values stay NULL.

    Scalar columns become ``{col}_d{delay}`` (``m`` marks a minus). ARRAY columns are replaced
    by the delay-major concatenation.
    """
    if delays is None:
        return df
    is_array = {c: isinstance(df.schema[c].dataType, T.ArrayType) for c in cols}
    made = {}
    for d in delays:
        for c in cols:
            def shifted(w: Window, c: str = c, d: int = d) -> Column:
                step = (lambda x: F.lag(x, d).over(w)) if d >= 0 else (lambda x: F.lead(x, -d).over(w))
                empty = zeros(F.size(c)) if is_array[c] else F.lit(0.0)
                # a missing value moves like any other; only rows that nothing moves to are filled
                return F.when(step(F.lit(True)).isNull(), empty).otherwise(step(F.col(c))) if d else F.col(c)

            made[_delayed_name(c, d)] = shifted
    out = over_rows(
        df, made, partition_cols=partition_cols, order_col=order_col,
        before=max(0, *delays), after=max(0, *[-d for d in delays]), rows=rows,
    )
    for c in cols:
        if is_array[c]:
            parts = [_delayed_name(c, d) for d in delays]
            out = out.withColumn(c, F.concat(*parts)).drop(*parts)
    return out


def _delayed_name(col: str, d: int) -> str:
    return f"{col}_d{d}" if d >= 0 else f"{col}_dm{-d}"


def split_delays(df: DataFrame, n_delays: int, vector_col: str = "x", name: str = "delay_index") -> DataFrame:
    """One row per delay from a delay-major vector."""
    width = (F.size(vector_col) / n_delays).cast("int")
    parts = F.transform(
        F.sequence(F.lit(0), F.lit(n_delays - 1)), lambda i: F.slice(vector_col, i * width + 1, width)
    )
    others = [c for c in df.columns if c != vector_col]
    return df.select(*others, F.posexplode(parts).alias(name, vector_col))


def dilate(df: DataFrame, mark_col: str, half: int, *, partition_cols: Sequence[str] = ("run",),
           order_col: str = "t", name: str | None = None) -> DataFrame:
    """Spread marks to ``half`` rows on both sides."""
    name = name or mark_col
    out = over_rows(
        df, {"_wide": lambda w: F.max(mark_col).over(w.rowsBetween(-half, half))},
        partition_cols=partition_cols, order_col=order_col, before=half, after=half,
    )
    return out.withColumn(name, F.col("_wide")).drop("_wide")


def blocks(df: DataFrame, size: int, *, n_rows: Column, tail: str = "pad", seed: int = 0,
           pad_cols: Sequence[str] = (), partition_cols: Sequence[str] = ("target",),
           order_col: str = "t") -> DataFrame:
    """Add ``block``/``offset`` of a position.

    ``tail='drop'`` leaves out the incomplete last block, ``'error'`` refuses one and ``'pad'``
    fills it with the same seeded normal noise in every column of ``pad_cols``.
    """
    t = F.col(order_col)
    whole = (n_rows - F.pmod(n_rows, F.lit(size))).cast("long")
    if tail == "drop":
        df = df.where(t < whole)
    elif tail == "error":
        df = df.withColumn(order_col, F.when(
            F.pmod(n_rows, F.lit(size)) != 0,
            F.raise_error(F.lit(f"series length is not a multiple of block size {size}")).cast("long"),
        ).otherwise(t))
    elif tail == "pad":
        keys = df.select(*partition_cols).distinct()
        extra = F.pmod(-n_rows, F.lit(size)).cast("int")
        fill = keys.select("*", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("_i")).where(
            F.col("_i") < extra).withColumn(order_col, (n_rows + F.col("_i")).cast(df.schema[order_col].dataType))
        noise = hashed_normal(seed, *partition_cols, order_col)
        others = [c for c in df.columns if c not in (*partition_cols, order_col, *pad_cols)]
        fill = fill.select(
            *partition_cols, order_col, *[noise.alias(c) for c in pad_cols],
            *[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in others],
        )
        df = df.unionByName(fill)
    else:
        raise ValueError(f"tail must be 'pad', 'drop' or 'error', got {tail!r}")
    return df.withColumn("block", F.floor(t / size).cast("int")).withColumn(
        "offset", F.pmod(t, F.lit(size)).cast("int"))


def hashed_uniform(seed: int, *keys: str | Column) -> Column:
    """A uniform in (0, 1) that depends on the keys alone, so recomputation repeats it."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) + 0.5) * (2.0 ** -53)


def hashed_normal(seed: int, *keys: str | Column) -> Column:
    u1, u2 = hashed_uniform(seed, *keys), hashed_uniform(seed + 1, *keys)
    return F.sqrt(-2 * F.ln(u1)) * F.cos(u2 * 6.283185307179586)


def circular_shift(df: DataFrame, shift: Column | int, *, n_rows: Column, order_col: str = "t") -> DataFrame:
    """Move the last ``shift`` rows to the front."""
    return df.withColumn(order_col, F.pmod(F.col(order_col) + shift, n_rows))


def run_ids(df: DataFrame, onsets: Sequence[int], *, order_col: str = "t", name: str = "run") -> DataFrame:
    """0-based run of each position; the first onset is the start of the series."""
    cuts = list(onsets)[1:]
    if any(b <= a for a, b in zip(cuts, cuts[1:])) or any(c <= 0 for c in cuts):
        raise ValueError("each run needs a sample: let the onsets rise")
    t = F.col(order_col)
    passed = F.filter(F.array(*[F.lit(int(c)) for c in cuts]), lambda c: c <= t) if cuts else F.array()
    return df.withColumn(name, F.size(passed).cast("int"))


def run_ids_from(df: DataFrame, onsets: DataFrame, *, partition_cols: Sequence[str] = (), order_col: str = "t", name: str = "run",
                 rows: int = SEGMENT_ROWS) -> DataFrame:
    """Run of each position from a table of onsets (partition_cols, order_col), however many: how many onsets stand at or before it, less one.

    Rows and onsets are merged by position and onsets counted along, in segments of ``rows`` positions whose totals carry over. Positions are
    integers; those before the first onset get -1, equal onsets count once, and NULL positions get NULL.
    """
    keys = [*partition_cols, order_col]
    marks = onsets.select(*keys).distinct().where(F.col(order_col).isNotNull())
    row = F.struct(*df.columns)
    both = df.where(F.col(order_col).isNotNull()).select(*keys, row.alias("_row")).unionByName(marks.select(*keys, F.lit(None).cast(df.select(row).schema[0].dataType).alias("_row")))
    # an onset comes before the row at its position
    place = 2 * F.col(order_col).cast("long") + F.col("_row").isNotNull().cast("int")
    both = both.select(*partition_cols, place.alias("_place"), "_row")
    counted = running_sum(both, F.col("_row").isNull().cast("long"), "_n", partition_cols=list(partition_cols), order_col="_place",
                          segment=segment_of(F.col("_place"), 2 * rows))
    out = counted.where("_row IS NOT NULL").select("_row.*", (F.col("_n") - 1).cast("int").alias(name))
    return out.unionByName(df.where(F.col(order_col).isNull()).withColumn(name, F.lit(None).cast("int")))


def chunks(df: DataFrame, size: int, *, partition_cols: Sequence[str] = ("run",), order_col: str = "t",
           keep_partial: bool = True) -> DataFrame:
    """Non-overlapping chunks of a dense series; the dropping form leaves out a short last one."""
    out = df.withColumn("chunk", F.floor(F.col(order_col) / size).cast("int"))
    if keep_partial:
        return out
    full = out.groupBy(*partition_cols, "chunk").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == size)
    return out.join(full.drop("_n"), [*partition_cols, "chunk"], "left_semi")


def halo_batches(df: DataFrame, batch: int, width: int, *, order_col: str = "t") -> DataFrame:
    """Copy rows into batches padded by half of ``width``; ``is_core`` marks the owned ones."""
    pad = -(-width // 2)
    t = F.col(order_col)
    first = F.greatest(F.floor((t - pad) / batch), F.lit(0))
    return df.select(
        "*", F.explode(F.sequence(first, F.floor((t + pad) / batch))).alias("batch")
    ).withColumn("is_core", F.floor(t / batch) == F.col("batch"))


def halo_moving_average(df: DataFrame, value_col: str, width: int, *, batch: int,
                        partition_cols: Sequence[str] = ("run",), order_col: str = "t",
                        name: str = "smooth") -> DataFrame:
    """A centred mean computed on padded batches and trimmed to their cores."""
    half = width // 2
    w = Window.partitionBy(*partition_cols, "batch").orderBy(order_col).rowsBetween(-half, half)
    out = halo_batches(df, batch, width, order_col=order_col).withColumn(name, F.avg(value_col).over(w))
    # a padded batch past the end of a run has no core rows and disappears here
    return out.where("is_core").drop("batch", "is_core")


def trim_edges(df: DataFrame, dropped: int, *, n_rows: Column, fps: float, order_col: str = "t") -> DataFrame:
    """Remove ``dropped`` frames split between both ends (the larger half from the end)."""
    start = dropped // 2
    end = n_rows - (dropped - start)
    t = F.col(order_col)
    return df.where((t >= start) & (t < end)).withColumn("time", t / F.lit(float(fps)))


def masked_mean(value: str | Column, mask: str | Column) -> Column:
    """Aggregate: mean of the values whose mask is set."""
    mask = F.col(mask) if isinstance(mask, str) else mask
    value = F.col(value) if isinstance(value, str) else value
    return F.avg(F.when(mask.cast("boolean"), value))

