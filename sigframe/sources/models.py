"""Stored ridge models."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from sigframe.plans.ridge import Fit

KINDS = ("ridge", "banded", "kernel")


def save_model(fit: Fit, path: str, kind: str, **meta) -> None:
    """Weights, deltas, choices and scores as parquet, plus one metadata row."""
    if kind not in KINDS:
        raise ValueError(f"cannot store a {kind!r} model; kinds are {KINDS}")
    spark = fit.coef.sparkSession
    for name in ("coef", "deltas", "choice", "cv_scores"):
        getattr(fit, name).write.mode("overwrite").parquet(f"{path}/{name}")
    text = json.dumps({"kind": kind, **meta}, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_model(spark: SparkSession, path: str) -> tuple[Fit, dict]:
    meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
    if meta.get("kind") not in KINDS:
        raise ValueError(f"{path} holds a {meta.get('kind')!r} model; kinds are {KINDS}")
    return Fit(*[spark.read.parquet(f"{path}/{n}") for n in ("coef", "deltas", "choice", "cv_scores")]), meta
