"""Stateful streams: lagged rows and running sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from sigframe.functions.arrays import vector_sum
from sigframe.operators.windows import delay
from sigframe.plans.decomposition import State
from sigframe.plans.gram import collect_gram, gram
from sigframe.streaming.run import PerBatch


def lagged(df: DataFrame, delays: Sequence[int], *, late: str, key: str = "run", order_col: str = "ts", value_col: str = "value",
           carry: Sequence[str] = (), bucket: str = "10 minutes") -> PerBatch:
    """Earlier values of each run, 0 before its start, in the order of the event time ``order_col``, then of ``carry``.

    A row waits in the state until rows before it can no longer come (``late``), so lags do not depend on how rows fall into
    batches. The state has an entry for each ``bucket`` of a run, which a task must be able to hold; a bucket comes out whole when
    the watermark has passed it. The rows that come out of a batch are numbered from the counts of their buckets and lagged in segments
    of positions, after the last max(delay) values of the batches before. NULL values stay NULL in lags; a row without a time is dropped.
    """
    if min(delays) < 0:
        raise ValueError(f"a stream has no later values: delays {list(delays)}")
    spark, depth = df.sparkSession, max(delays)
    fields = list(dict.fromkeys([order_col, *carry, value_col]))
    out_cols = [key, order_col, value_col, *carry]
    names = [f"{value_col}_d{d}" for d in delays]
    schema = T.StructType([*df.select(*out_cols).schema, *[T.StructField(n, T.DoubleType()) for n in names]])
    tail = T.StructType([df.schema[key], T.StructField("_t", T.LongType()), df.schema[value_col]])

    buckets = df.select(*out_cols).withWatermark(order_col, late).groupBy(key, F.window(order_col, bucket).alias("_window"))
    rows = buckets.agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("_rows")).select(
        key, F.col("_window.start").alias("_bucket"), F.posexplode("_rows").alias("_pos", "_row")).select(key, "_bucket", "_pos", "_row.*")

    def step(batch: DataFrame, batch_id: int, folder: str) -> DataFrame:
        # stored, because every use of the batch itself would run the state again
        batch.write.mode("overwrite").parquet(f"{folder}/ready/batch={batch_id}")
        ready = spark.read.schema(batch.schema).parquet(f"{folder}/ready/batch={batch_id}")
        past = ready.limit(0).select(key, F.lit(0).cast("long").alias("_t"), value_col)
        if batch_id:
            past = spark.read.schema(tail).parquet(f"{folder}/tail/batch={batch_id - 1}")
        kept = f"{folder}/tail/batch={batch_id}"
        if ready.isEmpty():
            past.write.mode("overwrite").parquet(kept)
            return ready.select(*out_cols, *[F.lit(None).cast("double").alias(n) for n in names])

        # positions from 0 in each batch; the values kept from earlier ones stand at -1, -2 and so on
        counts = ready.groupBy(F.col(key).alias("_key"), F.col("_bucket").alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
        earlier = Window.partitionBy("_key").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
        starts = counts.select("_key", "_of", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
        placed = ready.join(starts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_bucket") == F.col("_of")))
        placed = placed.select(*out_cols, (F.col("_start") + F.col("_pos")).alias("_t"))
        placed = placed.unionByName(past, allowMissingColumns=True)

        totals = counts.groupBy("_key").agg(F.sum("_n").alias("_total"))
        total = F.coalesce(F.col("_total"), F.lit(0))
        last = placed.join(totals, F.col(key).eqNullSafe(F.col("_key")), "left").where(F.col("_t") >= total - depth)
        last.select(key, (F.col("_t") - total).alias("_t"), value_col).write.mode("overwrite").parquet(kept)

        out = delay(placed, delays, [value_col], partition_cols=[key], order_col="_t").where(F.col("_t") >= 0)
        return out.select(*out_cols, *[F.col(n).cast("double").alias(n) for n in names])

    return PerBatch(rows, schema, step)


def write_moments(df: DataFrame, path: str, checkpoint: str, *, x_col: str = "x"):
    """Start a stream that keeps the sums of products of each micro-batch under its batch id.

    A repeated batch overwrites its own folder, so retries do not count twice.
    """
    def keep(batch: DataFrame, batch_id: int) -> None:
        gram(batch, [], x_col).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return df.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_moments(spark: SparkSession, path: str) -> State:
    """The merged state of all batches so far."""
    parts = spark.read.parquet(path).groupBy("row_block", "width").agg(vector_sum(F.col("values")).alias("values"))
    return State.of(collect_gram(parts, [])[()])
