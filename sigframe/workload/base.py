"""The test tables in their roles as series, words, locations and events.

Each role has a Spark builder and the SQL text that defines the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sigframe.operators.layout import densify
from sigframe.sources.transcripts import tokens
from sigframe.workload.registry import table

ORIGIN = "2024-01-01 00:00:00"
HOUR = 3600.0


def event_seconds() -> Column:
    """Seconds since the first day of the event stream."""
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit(ORIGIN).cast("timestamp"))
    return micros / 1e6


SECONDS_SQL = f"(epoch_us(ts) - epoch_us(TIMESTAMP '{ORIGIN}')) / 1e6"


def samples(spark: SparkSession, d: str) -> DataFrame:
    """Irregular series: run = event type, time in seconds."""
    return table(spark, d, "events").select(
        F.col("event_type").alias("run"), event_seconds().alias("time"), "value", "event_id", "user_id")


SAMPLES_SQL = f"samples AS (SELECT event_type AS run, {SECONDS_SQL} AS time, value, event_id, user_id FROM events)"


def regular(spark: SparkSession, d: str, step: float = HOUR) -> DataFrame:
    """Complete regular grid per run: sum ``value`` and count ``n`` of the samples in each step."""
    cells = samples(spark, d).select("run", F.floor(F.col("time") / step).cast("int").alias("t"), "value")
    cells = cells.groupBy("run", "t").agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("n"))
    return densify(cells, partition_cols=["run"], order_col="t", value_cols=["value", "n"],
                   low=F.lit(0), high=last_step(spark, d, step))


def last_step(spark: SparkSession, d: str, step: float) -> Column:
    return samples(spark, d).agg(F.floor(F.max("time") / step).cast("int")).scalar()


def regular_sql(step: float = HOUR) -> str:
    """CTEs ``samples`` and ``series(run, t, value, n)``; sums are of two-decimal values."""
    return f"""{SAMPLES_SQL},
cells AS (SELECT run, CAST(floor(time / {step}) AS INTEGER) AS t, sum(value) AS value, count(*) AS n
          FROM samples GROUP BY 1, 2),
steps AS (SELECT CAST(unnest(range(0, (SELECT max(t) FROM cells) + 1)) AS INTEGER) AS t),
series AS (SELECT r.run, s.t, round(coalesce(c.value, 0), 2) AS value, CAST(coalesce(c.n, 0) AS BIGINT) AS n
           FROM (SELECT DISTINCT run FROM cells) r CROSS JOIN steps s LEFT JOIN cells c ON c.run = r.run AND c.t = s.t)"""


def series(spark: SparkSession, d: str, step: float = HOUR) -> DataFrame:
    return regular(spark, d, step).withColumn("value", F.round("value", 2))


def turn_words(spark: SparkSession, d: str) -> DataFrame:
    """Words of every conversation turn: (conv_id, turn, pos, word)."""
    return table(spark, d, "conversations").select(
        "conv_id", "turn", F.posexplode(tokens(F.col("text"))).alias("pos", "word"))


TURN_WORDS_SQL = r"""turn_words AS (
  SELECT conv_id, turn, CAST(i - 1 AS INTEGER) AS pos, w[i] AS word
  FROM (SELECT conv_id, turn, w, unnest(range(1, len(w) + 1)) AS i
        FROM (SELECT conv_id, turn, regexp_extract_all(text, '\S+') AS w FROM conversations)))"""


def doc_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(tokens(F.col("text"))).alias("pos", "word"))


DOC_WORDS_SQL = r"""doc_words AS (
  SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, w[i] AS word
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i
        FROM (SELECT doc_id, regexp_extract_all(text, '\S+') AS w FROM documents)))"""


def word_key(word: Column, size: int = 600) -> Column:
    """A stable vocabulary id of a word; some ids lie outside the vector table."""
    return F.conv(F.substring(F.md5(F.lower(word)), 1, 6), 16, 10).cast("long") % size


WORD_KEY_SQL = "(CAST(('0x' || substr(md5(lower(word)), 1, 6)) AS BIGINT) % 600)"


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("vector"), "label")
