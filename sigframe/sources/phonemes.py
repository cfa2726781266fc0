"""The phoneme dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The public 39-phoneme set of the CMU pronouncing dictionary with manner classes.
PHONEMES = {
    "AA": "vowel", "AE": "vowel", "AH": "vowel", "AO": "vowel", "AW": "vowel", "AY": "vowel",
    "B": "stop", "CH": "affricate", "D": "stop", "DH": "fricative", "EH": "vowel", "ER": "vowel",
    "EY": "vowel", "F": "fricative", "G": "stop", "HH": "aspirate", "IH": "vowel", "IY": "vowel",
    "JH": "affricate", "K": "stop", "L": "liquid", "M": "nasal", "N": "nasal", "NG": "nasal",
    "OW": "vowel", "OY": "vowel", "P": "stop", "R": "liquid", "S": "fricative", "SH": "fricative",
    "T": "stop", "TH": "fricative", "UH": "vowel", "UW": "vowel", "V": "fricative",
    "W": "semivowel", "Y": "semivowel", "Z": "fricative", "ZH": "fricative",
}


def phoneme_table(spark: SparkSession) -> DataFrame:
    """(phoneme, type, idx), 39 rows; small enough to broadcast by construction."""
    rows = [(p, kind, i) for i, (p, kind) in enumerate(PHONEMES.items())]
    return spark.createDataFrame(rows, "phoneme string, type string, idx int")


def read_phonemes(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated (phoneme, type) file; idx is the alphabetical position."""
    from pyspark.sql import Window, functions as F

    table = spark.read.csv(path, sep="\t", schema="phoneme string, type string")
    return table.withColumn("idx", F.row_number().over(Window.orderBy("phoneme")) - 1)
