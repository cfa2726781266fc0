"""Mel spectral features of sampled signals."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def mel_filters(sr: float, n_fft: int, n_mels: int) -> np.ndarray:
    """(n_fft/2+1, n_mels) triangles on the HTK mel scale with area normalisation."""
    freqs = np.linspace(0, sr / 2, n_fft // 2 + 1)
    top = 2595.0 * np.log10(1 + sr / 2 / 700.0)
    edges = 700.0 * (10 ** (np.linspace(0, top, n_mels + 2) / 2595.0) - 1)
    low, mid, high = edges[:-2], edges[1:-1], edges[2:]
    rise = (freqs[:, None] - low) / (mid - low)
    fall = (high - freqs[:, None]) / (high - mid)
    return np.maximum(0, np.minimum(rise, fall)) * (2.0 / (high - low))


def frame_samples(df: DataFrame, *, n_samples: Column, n_fft: int, hop: int, keys: Sequence[str] = ("run",),
                  index_col: str = "n", value_col: str = "amp") -> DataFrame:
    """Centred frames with reflected edges as (keys, frame, samples[n_fft]).

    A sample goes to the frames that cover it, itself and as its mirror image near the ends;
    each frame is a group of at most ``n_fft`` samples.
    """
    half = n_fft // 2
    n = F.col(index_col)
    last = n_samples - 1
    where = F.array_compact(F.array(
        n, F.when((n >= 1) & (n <= half), -n), F.when((n < last) & (n >= last - half), 2 * last - n)))
    placed = df.select(*keys, value_col, F.explode(where).alias("_at"), n_samples.alias("_n"))
    at = F.col("_at") + half  # position in the padded signal
    n_frames = F.floor(F.col("_n") / hop)
    low = F.greatest(F.ceil((at - n_fft + 1) / hop), F.lit(0)).cast("long")
    high = F.least(F.floor(at / hop), n_frames).cast("long")
    spread = placed.select(*keys, value_col, at.alias("_p"), F.explode(F.when(low <= high, F.sequence(low, high))).alias("frame"))
    cell = F.struct((F.col("_p") - F.col("frame") * hop).alias("i"), F.col(value_col).cast("double").alias("v"))
    return spread.groupBy(*keys, "frame").agg(F.array_sort(F.collect_list(cell)).alias("_c")).select(
        *keys, "frame", F.col("_c.v").alias("samples"))


def spectral_features(df: DataFrame, *, sr: float, n_samples: Column, n_fft: int = 2048, hop: int = 512, n_mels: int = 128,
                      keys: Sequence[str] = ("run",), index_col: str = "n", value_col: str = "amp") -> DataFrame:
    """Mel power per frame as (keys, frame, mel ARRAY<DOUBLE>, time); Arrow batches, one FFT per batch.

    Times run evenly from 0 to the signal's duration.
    """
    filters = mel_filters(sr, n_fft, n_mels)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)
    frames = frame_samples(df, n_samples=n_samples, n_fft=n_fft, hop=hop, keys=keys, index_col=index_col, value_col=value_col)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.select(*keys, "frame").schema)

    def mel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 512):
                part = pdf.iloc[at:at + 512]
                mat = np.zeros((len(part), n_fft))
                for i, s in enumerate(part["samples"]):
                    mat[i, :len(s)] = s
                power = np.abs(np.fft.rfft(mat * window, axis=1)) ** 2
                yield part[[*keys, "frame"]].assign(mel=list(power @ filters))

    out = frames.mapInPandas(mel, f"{ddl}, mel array<double>")
    time = F.coalesce(F.try_divide(F.col("frame") * (n_samples / F.lit(float(sr))), F.floor(n_samples / hop)), F.lit(0.0))
    return out.withColumn("time", time)
