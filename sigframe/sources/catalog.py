"""The modality/feature catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Feature names per kind, and the kinds each modality draws on, in order.
FEATURES = {
    "visual": ["alexnet", "x3d_s", "motion_energy", "scene_cut"],
    "audio": ["spectral", "wav2vec2"],
    "language": ["phoneme", "word2vec", "gpt2", "gpt2-xl"],
    "multimodal": ["clip", "pe_av"],
}
MODALITIES = {
    "audiovisual": ["visual", "audio", "language", "multimodal"],
    "audio": ["audio", "language"],
    "text": ["language"],
    "visual": ["visual"],
}


def modality_features(modality: str) -> list[str]:
    return [f for kind in MODALITIES.get(modality, []) for f in FEATURES[kind]]


def modality_table(spark: SparkSession) -> DataFrame:
    """(modality, rank, feature) for joins."""
    rows = [(m, i, f) for m in MODALITIES for i, f in enumerate(modality_features(m))]
    return spark.createDataFrame(rows, "modality string, rank int, feature string")
