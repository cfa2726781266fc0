"""Streams with state by time bucket and timers: lags of a grid, and cuts that keep their distance.

Both need the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``) where the stream is started; :func:`rocksdb` sets it.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams started within it keep their state in RocksDB; afterwards the session has its own setting again."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(key, before)


class _Buckets(StatefulProcessor):
    """Rows wait in one list of micros and values for each bucket of event time, and a timer at the bucket's end takes them out.

    A row costs one update of its bucket, not of all that waits, and a bucket is looked at once, when nothing can come for it any more.
    Rows of a bucket that has been taken out are late and cannot be placed; Spark drops them before they come here.
    """

    def __init__(self, micros: int) -> None:
        self.micros = micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "bucket long", "at array<long>, value array<double>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for batch in rows:
            # rows without key or time count for the watermark only; the one that ends a replay is among them
            batch = batch[batch["micros"].notna()] if key[0] is not None else batch[:0]
            for bucket, part in batch.groupby(batch["micros"] // self.micros):
                bucket = int(bucket)
                at, value = [int(u) for u in part["micros"]], [None if pd.isna(v) else float(v) for v in part["amount"]]
                if self.waiting.containsKey((bucket,)):
                    held = self.waiting.getValue((bucket,))
                    at, value = [*held[0], *at], [*held[1], *value]
                else:
                    self.handle.registerTimer(self.ends(bucket))
                self.waiting.updateValue((bucket,), (at, value))
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        # whichever timer of a key comes first takes all buckets that are complete, in order; the others find none
        border = timerValues.getCurrentWatermarkInMs()
        complete = sorted(b for (b,) in self.waiting.keys() if self.ends(b) <= border)
        for bucket in complete:
            cells = defaultdict(list)
            for u, v in zip(*self.waiting.getValue((bucket,))):
                cells[u].append(v)
            self.waiting.removeKey((bucket,))
            out = self.taken(key, bucket, cells)
            if len(out):
                yield out
        self.rest(key, border)

    def ends(self, bucket: int) -> int:
        """When a bucket's timer runs out, in milliseconds: its last row lies before that."""
        return (bucket + 1) * self.micros // 1000 + 1

    def rest(self, key: Any, border: int) -> None:
        """State that ends with a key at the watermark ``border``."""

    def taken(self, key: Any, bucket: int, cells: dict[int, list]) -> pd.DataFrame:
        """Rows to emit for a bucket that is complete; ``cells`` has the values at each time."""
        raise NotImplementedError


class _Lags(_Buckets):
    """Lagged values of one segment of a run."""

    def __init__(self, micros: int, period: int, delays: Sequence[int], rows: int) -> None:
        super().__init__(micros)
        self.period, self.delays, self.rows = period, list(delays), rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.past = handle.getValueState("past", "at array<long>, value array<double>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        if key[0] is not None:
            # a segment that gets its margin only ends too
            self.handle.registerTimer(self.over(key))
        return super().handleInputRows(key, rows, timerValues)

    def taken(self, key: Any, bucket: int, cells: dict[int, list]) -> pd.DataFrame:
        # sums that do not depend on the order in which the values came
        new = {u: math.fsum(there) if (there := [v for v in vs if v is not None]) else None for u, vs in cells.items()}
        before = self.past.get() if self.past.exists() else ([], [])
        known = {**dict(zip(*before)), **new}
        lo, end = key[1] * self.rows * self.period, (bucket + 1) * self.micros
        own = sorted(u for u in new if u >= lo)  # earlier ones are the margin
        out = {"key": [key[0]] * len(own), "micros": own, "d0": [known[u] for u in own]}
        for i, d in enumerate(self.delays, 1):
            out[f"d{i}"] = [known.get(u - d * self.period, 0.0) for u in own]
        kept = sorted(u for u in known if u >= end - max(self.delays) * self.period)
        self.past.update((kept, [known[u] for u in kept]))
        return pd.DataFrame(out)

    def over(self, key: Any) -> int:
        return (key[1] + 1) * self.rows * self.period // 1000 + 1

    def rest(self, key: Any, border: int) -> None:
        if self.over(key) <= border:
            self.past.clear()


class _Spaced(_Buckets):
    """Of the cuts of a run those that lie far enough behind the last kept one."""

    def __init__(self, micros: int, min_us: int) -> None:
        super().__init__(micros)
        self.min_us = min_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "at long")

    def taken(self, key: Any, bucket: int, cells: dict[int, list]) -> pd.DataFrame:
        last, kept = self.last.get()[0] if self.last.exists() else None, []
        for u in sorted(cells):
            if last is None or u - last >= self.min_us:
                last = u
                kept.append(u)
        if kept:
            self.last.update((last,))
        return pd.DataFrame({"key": [key[0]] * len(kept), "micros": kept})


def _micros(span: str) -> int:
    td = pd.Timedelta(span)
    if td.value <= 0 or td.value % 1_000_000:
        raise ValueError(f"{span!r} is no positive number of milliseconds")
    return td.value // 1000


def _keyed(df: DataFrame, late: str, key: str, ts_col: str, micros: Column, amount: Column, *more: Column) -> DataFrame:
    """Columns for a processor; keys as text, because numbers among which one is missing reach it as floats."""
    return df.withWatermark(ts_col, late).select(
        F.col(key).cast("string").alias("key"), F.col(ts_col).alias("event_time"), micros.alias("micros"), amount.cast("double").alias("amount"), *more)


def _named(out: DataFrame, like: DataFrame, key: str, ts_col: str, *names: str) -> DataFrame:
    values = [F.col(f"d{i}").alias(n) for i, n in enumerate(names)]
    return out.select(F.col("key").cast(like.schema[key].dataType).alias(key), F.timestamp_micros("micros").alias(ts_col), *values)


def lagged_grid(df: DataFrame, delays: Sequence[int], *, period: str, late: str, key: str = "run", ts_col: str = "ts",
                value_col: str = "value", key_rows: int = 65536, bucket_rows: int = 1024) -> DataFrame:
    """Values ``d`` grid steps earlier, 0 where there is none, of runs sampled every ``period``.

    A run is cut into segments of ``key_rows`` grid points, each a key of its own; the last max(delays) points of a segment go to the next one
    as well, as its margin, so a run of any length spreads over all tasks and no key outlives its segment. Rows off the grid belong to
    the point at or before them; those of one point are summed. NULL values are left out of sums, and a point that has no others is NULL,
    in its lags too. A row without key or time is dropped.
    """
    step = _micros(period)
    if max(delays) > key_rows or min(delays) < 0:
        raise ValueError(f"delays must lie between 0 and key_rows ({key_rows}), not {list(delays)}")
    if key_rows % bucket_rows:
        raise ValueError(f"key_rows ({key_rows}) must be a multiple of bucket_rows ({bucket_rows})")
    point = F.floor(F.unix_micros(ts_col) / step).cast("long")
    own, depth = F.floor(point / key_rows).cast("long"), max(delays)
    margin = F.pmod(point, F.lit(key_rows)) >= key_rows - depth
    segments = F.when(margin, F.array(own, own + 1)).when(point.isNotNull(), F.array(own)).otherwise(F.array(F.lit(0).cast("long")))
    rows = _keyed(df, late, key, ts_col, point * step, F.col(value_col), F.explode(segments).alias("segment"))
    schema = "key string, micros long" + "".join(f", d{i} double" for i in range(len(delays) + 1))
    out = rows.groupBy("key", "segment").transformWithStateInPandas(_Lags(bucket_rows * step, step, delays, key_rows), schema, "Append", "EventTime")
    return _named(out, df, key, ts_col, value_col, *[f"{value_col}_d{d}" for d in delays])


def spaced_cuts(cuts: DataFrame, min_len: str, *, late: str, key: str = "run", ts_col: str = "ts", bucket: str = "10 minutes") -> DataFrame:
    """Keep a cut only if it lies at least ``min_len`` behind the last kept one of its run; the first is kept.

    The rule is sequential, so a run's cuts go through one key; its state is the last kept cut and the cuts that wait for the watermark.
    A cut without run or time is dropped, equal ones are one.
    """
    rows = _keyed(cuts, late, key, ts_col, F.unix_micros(ts_col), F.lit(None))
    out = rows.groupBy("key").transformWithStateInPandas(_Spaced(_micros(bucket), _micros(min_len)), "key string, micros long", "Append", "EventTime")
    return _named(out, cuts, key, ts_col)
