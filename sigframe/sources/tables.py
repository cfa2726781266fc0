"""Label, region, confound, vector and feature files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

REGION_SCHEMA = "parcel_index int, area string, description string, aggregate_label string, cortex string"
COMPONENT = (
    "struct<Method:string,Retained:boolean,Mask:string,SingularValue:double,"
    "VarianceExplained:double,CumulativeVarianceExplained:double>"
)


def read_region_table(spark: SparkSession, path: str) -> DataFrame:
    """Region CSV with quoted fields that may span lines."""
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', schema=REGION_SCHEMA)


def read_colour_table(spark: SparkSession, path: str) -> DataFrame:
    """``index name`` lines."""
    return spark.read.csv(path, sep=" ", schema="parcel_index int, aggregate_label string",
                          ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def read_line_labels(spark: SparkSession, path: str) -> DataFrame:
    """One name per non-blank line; the index is the 1-based order."""
    return line_labels(spark.read.text(path, wholetext=True), F.col("value"))


def line_labels(df: DataFrame, text: Column, *keys: str) -> DataFrame:
    names = F.filter(F.transform(F.split(text, r"\r?\n"), lambda s: F.trim(s)), lambda s: s != "")
    return df.select(*keys, F.posexplode(names).alias("i", "aggregate_label")).select(
        *keys, (F.col("i") + 1).alias("parcel_index"), "aggregate_label")


def read_confounds(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A tab-separated confound table and the components of its JSON sidecar (same stem)."""
    wide = spark.read.csv(path, sep="\t", header=True, nullValue="n/a", inferSchema=True)
    sidecar = path[: path.rindex(".")] + ".json"
    text = spark.read.text(sidecar, wholetext=True)
    return wide, components(text, F.col("value"))


def components(df: DataFrame, json_text: Column, *keys: str) -> DataFrame:
    """Component attributes of a JSON object {name: {...}}, one row per component."""
    parsed = F.from_json(json_text, f"map<string,{COMPONENT}>")
    return df.select(*keys, F.explode(parsed).alias("name", "c")).select(
        *keys, "name", F.col("c.Method").alias("method"), F.col("c.Retained").alias("retained"),
        F.col("c.Mask").alias("mask"), F.col("c.SingularValue").alias("singular_value"),
        F.col("c.CumulativeVarianceExplained").alias("cumulative_variance"))


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Text vectors, ``word v1 v2 ...`` per line; a two-number header line is left out."""
    parts = F.split(F.trim("value"), " ")
    lines = spark.read.text(path).select(parts.alias("p")).where(F.size("p") > 2)
    return lines.select(F.get("p", F.lit(0)).alias("word"), F.slice("p", 2, F.size("p") - 1).cast("array<float>").alias("vector"))


def read_banded_features(spark: SparkSession, paths: Sequence[str], names: Sequence[str], **keys) -> tuple[DataFrame, DataFrame]:
    """One parquet table per feature space, joined into bands."""
    from sigframe.operators.bands import join_bands

    return join_bands([spark.read.parquet(p) for p in paths], names, **keys)


def write_regressor(df: DataFrame, path: str, *, partition_cols: Sequence[str] = ("run",),
                    order_cols: Sequence[str] = ("onset",)) -> None:
    """Space-separated regressor text per run.

    Records end in a space instead of a newline and part files follow the sort order, so the
    parts of a run read one after the other are its single line; nothing is gathered.
    """
    (
        df.repartitionByRange(*partition_cols, *order_cols)
        .sortWithinPartitions(*partition_cols, *order_cols)
        .select(*partition_cols, "regressor")
        .write.mode("overwrite").partitionBy(*partition_cols).option("lineSep", " ").text(path)
    )


def write_logits(df: DataFrame, path: str, *, run_col: str = "run") -> None:
    """(run, pos, token, logit) as parquet, one folder per run."""
    df.select(run_col, "pos", "token", "logit").write.mode("overwrite").partitionBy(run_col).parquet(path)
