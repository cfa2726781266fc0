"""Small expressions that several corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sigframe.session import written

#: A word is a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Rows of an Arrow batch: texts may be long, and a batch is held by the JVM and by Python at the same time.
BATCH_ROWS = 500


BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def in_batches(df: DataFrame, each, schema: str) -> DataFrame:
    """``df.mapInArrow`` in batches of at most BATCH_ROWS; the session keeps that setting, or a lower one of its own."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(BATCH_SETTING)) <= BATCH_ROWS:
        conf.set(BATCH_SETTING, str(BATCH_ROWS))
    return df.mapInArrow(each, schema)


def written_in_batches(df: DataFrame, each, schema: str, rows: int) -> DataFrame:
    """The stored result of ``df.mapInArrow`` in batches of ``rows``; the session's own setting is back afterwards."""
    conf = df.sparkSession.conf
    before = conf.get(BATCH_SETTING)
    conf.set(BATCH_SETTING, str(rows))
    try:
        return written(df.mapInArrow(each, schema), "mapped")
    finally:
        conf.set(BATCH_SETTING, before)


def whole(text: str | Column) -> Column:
    """The text, or an empty string where it is NULL."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def unit(*parts: Column) -> Column:
    """A number in (0, 1) that depends on nothing but the values of ``parts``."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11) + F.lit(0.5)) * F.lit(2.0**-53)


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the decimal id, modulo ``folds``; NULL for a NULL id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def bound_once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once a row.

    An expression that a lambda mentions is computed again for each element; as the variable of an outer lambda it
    is a computed value.
    """
    return F.element_at(F.transform(F.array(value), use), 1)
