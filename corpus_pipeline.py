"""A corpus pipeline: one stage after another, each over all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sigframe.llm import dedup, language, mixing, pieces, pii
from sigframe.llm.common import fold_of, whole
from sigframe.session import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language. One without a language gets the predicted one. A corpus in which no document names its
    language teaches none, so nothing can be rejected: all of it passes."""
    model = language.LanguageModel.train(language.sample(docs.where(fold_of(F.col("doc_id"), 3) != 1)))
    if not model.languages:
        return docs.select(*COLUMNS)
    out = language.identify(docs, model, COLUMNS)
    out = out.where(language.accepted(F.col("lang_pred"), F.col("bits_per_byte"), F.octet_length("text")))
    return out.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more)."""
    return dedup.one_of_each(docs.select(*COLUMNS), percent=80, words=5)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    kept = [F.col(c) for c in COLUMNS if c not in ("text", "n_chars")]
    found = pii.find(docs, pii.train(docs), [*kept, F.col("text").isNull().alias("_none")])
    text = F.when(~F.col("_none"), pii.redacted(F.col("_text"), F.col("spans")))
    return found.select(*kept, text.alias("text")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, and those of small sources again, up to the target weights."""
    return mixing.mix(docs, keep=COLUMNS).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether they decode to its text."""
    path, keys = public_tokenizers.path("piece_bpe_32k.model"), ["doc_id", "lang", "source", "digest"]
    docs = docs.withColumn("digest", F.xxhash64(F.replace(whole("text"), F.lit(pieces.SPACE), F.lit(" "))))
    both = pieces.encode(docs, path, keys, back=True)
    same = F.col("digest") == F.xxhash64("decoded")
    return both.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("decodes"))


STAGES = [("language ID", identified), ("near-duplicates", deduplicated), ("PII", redacted), ("mixing", mixed), ("SentencePiece", encoded)]
#: SQL cannot express the learned stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = written(docs) if i + 1 < len(STAGES) else docs
    return docs
