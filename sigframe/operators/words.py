"""Word-level features: vectors, phonemes, context strings, encoders."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from sigframe.functions.arrays import dot, one_hot, pad_front, subtract, unit, vector_mean, vector_sum
from sigframe.operators.resample import context_windows
from sigframe.operators.segments import SEG, SEGMENT_ROWS, halo, over_rows

#: Rows of a silhouette's tile, and distances held at a time.
TILE_ROWS, DISTANCES = 8192, 1 << 21


def join_skewed(left: DataFrame, right: DataFrame, key: str, *, spread_by: Sequence[str], salts: int = 1,
                how: str = "inner") -> DataFrame:
    """Equi-join of rows with hot keys to a table of unique keys.

    Adaptive execution splits an oversized key partition of ``left`` and repeats only the matching
    part of ``right``, so by default nothing is copied beforehand. Where it is switched off, ``salts``
    spreads left rows by a hash of their own key over that many copies of ``right``.
    """
    if salts <= 1:
        return left.join(right, key, how)
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
    many = right.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    return left.withColumn("_salt", salt).join(many, [key, "_salt"], how).drop("_salt")


def word_vectors(words: DataFrame, vectors: DataFrame, *, word_col: str = "word", row_cols: Sequence[str] = ("doc", "pos"),
                 keep_unknown: bool = False, salts: int = 1) -> DataFrame:
    """Words with their vector; unknown words drop out unless kept (with a NULL vector)."""
    return join_skewed(words, vectors, word_col, spread_by=row_cols, salts=salts, how="left" if keep_unknown else "inner")


def phone_rows(words: DataFrame) -> DataFrame:
    """Aligned phones with onset = word start + durations of the earlier phones of the word.

    Phones of a word are one array, so the running sum stays inside the row.
    """
    ok = words.where((F.col("case") == "success") & (F.col("alignedWord") != "<unk>"))
    before = F.transform(
        "phones", lambda p, i: F.aggregate(F.slice("phones", F.lit(1), i), F.lit(0.0), lambda s, q: s + q["duration"]))
    others = [c for c in words.columns if c != "phones"]
    rows = ok.select(*others, F.posexplode(F.arrays_zip(F.col("phones").alias("p"), before.alias("b"))).alias("phone_pos", "z"))
    return rows.select(
        *others, "phone_pos", F.upper(F.split(F.col("z.p.phone"), "_")[0]).alias("phoneme"),
        F.col("z.p.duration").alias("duration"), (F.col("start") + F.col("z.b")).alias("onset"))


def phoneme_features(words: DataFrame, phonemes: DataFrame) -> DataFrame:
    """One-hot phonemes at their onsets; unknown symbols drop out but keep their time."""
    # 39 rows by definition, so a broadcast of fixed size; the vectors are made on that side
    return phone_rows(words).join(F.broadcast(phonemes.withColumn("features", one_hot(F.col("idx"), 39))), "phoneme")


def context_strings(words: DataFrame, window: int, *, bidirectional: bool = False, punctuation: bool = False,
                    partition_cols: Sequence[str] = ("doc",), order_col: str = "pos", rows: int = SEGMENT_ROWS) -> DataFrame:
    """Add ``context``: the stripped words of each row's window joined by spaces, and ``n_context``."""
    text = F.concat("word", F.coalesce("punctuation", F.lit(""))) if punctuation else F.col("word")
    back, ahead = (window // 2, window // 2) if bidirectional else (window - 1, 0)
    out = over_rows(
        words.withColumn("_item", F.trim(text)),
        {"_list": lambda w: F.collect_list("_item").over(w.rowsBetween(-back, ahead))},
        partition_cols=partition_cols, order_col=order_col, before=back, after=ahead, rows=rows)
    return out.withColumns({"context": F.array_join("_list", " "), "n_context": F.size("_list")}).drop("_item", "_list")


def context_means(words: DataFrame, window: int, *, vector_col: str = "vector", partition_cols: Sequence[str] = ("doc",),
                  order_col: str = "pos", rows: int = 4096) -> DataFrame:
    """The default context encoder: mean of the known word vectors in each left window.

    Rows arrive sorted by document segment, each with its margin. Arrow batches run across
    documents; a batch carries the last rows of the one before, and running sums make the cost
    independent of the window.
    """
    parts = list(partition_cols)
    order = [*parts, SEG]
    margin = halo(words.select(*parts, order_col, vector_col), order_col, window - 1, 0, rows)
    margin = margin.repartition(*order).sortWithinPartitions(*order, order_col)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in words.select(*parts, order_col).schema)

    def average(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail = None
        for pdf in batches:
            old = 0 if tail is None else len(tail)
            both = pdf if tail is None else pd.concat([tail, pdf], ignore_index=True)
            tail = both.iloc[max(len(both) - (window - 1), 0):] if window > 1 else None
            known = both[vector_col].notna().to_numpy()
            at = np.arange(len(both))
            group = both[order]
            fresh = (group != group.shift()).any(axis=1).to_numpy()
            low = np.maximum(np.maximum.accumulate(np.where(fresh, at, 0)), at - (window - 1))
            mine = (at >= old) & (both[order_col].to_numpy() // rows == both[SEG].to_numpy())
            out = both.loc[mine, [*parts, order_col]].copy()
            if not known.any():
                out["context_vector"] = pd.Series(None, index=out.index, dtype=object)
                yield out
                continue
            vecs = np.stack(both.loc[known, vector_col].to_numpy()).astype(float)
            count = np.concatenate([[0], np.cumsum(known)])
            total = np.vstack([np.zeros((1, vecs.shape[1])), np.cumsum(vecs, axis=0)])
            first, last = count[low[mine]], count[at[mine] + 1]
            mean = (total[last] - total[first]) / np.maximum(last - first, 1)[:, None]
            out["context_vector"] = pd.Series([m if n else None for m, n in zip(mean, last - first)], index=out.index, dtype=object)
            yield out

    return margin.mapInPandas(average, f"{ddl}, context_vector array<double>")


def windowed_model(df: DataFrame, model: Callable[[np.ndarray], np.ndarray], *, step: float, width: float, n_steps: Column,
                   samples_per_window: int, keys: Sequence[str] = ("run",), time_col: str = "time", value_col: str = "value") -> DataFrame:
    """A user model ``(windows, samples) -> (windows, features)`` over context windows.

    Windows are padded with zeros in front to ``samples_per_window`` (longer ones keep all their
    samples and are passed on one by one).
    """
    spread = context_windows(df, step=step, width=width, n_steps=n_steps, time_col=time_col)
    cells = F.array_sort(F.collect_list(F.struct(time_col, value_col)))
    packed = spread.groupBy(*keys, "k").agg(cells.alias("c")).select(
        *keys, "k", pad_front(F.col(f"c.{value_col}"), samples_per_window).alias("samples"))
    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in packed.select(*keys, "k").schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, part in pdf.groupby(pdf["samples"].str.len()):
                yield part[[*keys, "k"]].assign(features=list(model(np.stack(part["samples"]).astype(float))))

    return packed.mapInPandas(run, f"{ddl}features array<double>")


def encode_batches(df: DataFrame, encoder: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str,
                   *, batch_size: int | None = None) -> DataFrame:
    """Run a user model over Arrow batches; a size is passed on by splitting batches in the task."""
    if batch_size is None:
        return df.mapInPandas(encoder, schema)

    def sized(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def cut() -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for at in range(0, len(pdf), batch_size):
                    yield pdf.iloc[at:at + batch_size]
        yield from encoder(cut())

    return df.mapInPandas(sized, schema)


def words_from_subwords(tokens: DataFrame, *, keys: Sequence[str] = ("doc", "word_pos", "layer"), vector_col: str = "vec",
                        n_words: DataFrame | None = None) -> DataFrame:
    """Sum subword vectors, or single numbers, per word and layer.

    ``n_words`` (doc, n_words) checks the word count against the whitespace split.
    """
    total = vector_sum if tokens.schema[vector_col].dataType.typeName() == "array" else F.sum
    out = tokens.groupBy(*keys).agg(total(F.col(vector_col)).alias(vector_col))
    if n_words is None:
        return out
    doc = keys[0]
    seen = tokens.groupBy(doc).agg(F.count_distinct("word_pos").alias("_seen")).join(n_words, doc)
    ok = seen.select(doc, F.when(F.col("_seen") == F.col("n_words"), F.lit(True)).otherwise(
        F.raise_error(F.lit("subword words do not match the whitespace split")).cast("boolean")).alias("_ok"))
    return out.join(ok, doc).where("_ok").drop("_ok")


def basis_vector(vectors: DataFrame, positive: Column, negative: Column, *, vector_col: str = "vector") -> DataFrame:
    """One row: mean of the positive vectors minus mean of the negative ones."""
    side = F.when(positive, 1).when(negative, 0)
    means = vectors.select(side.alias("_s"), vector_col).where("_s is not null").groupBy("_s").agg(
        vector_mean(F.col(vector_col)).alias("m"))
    both = means.agg(F.max(F.when(F.col("_s") == 1, F.col("m"))).alias("p"), F.max(F.when(F.col("_s") == 0, F.col("m"))).alias("n"))
    return both.select(subtract(F.col("p"), F.col("n")).alias("basis"))


def word_scores(vectors: DataFrame, basis: DataFrame, *, vector_col: str = "vector") -> DataFrame:
    """Dot product of every vector with the one basis row."""
    held = vectors.withColumn("_basis", basis.select("basis").scalar())
    return held.withColumn("score", dot(F.col(vector_col), F.col("_basis"))).drop("_basis")


def clusters(labels: DataFrame, *, cluster_col: str = "cluster", word_col: str = "word", part_rows: int = 1000) -> DataFrame:
    """Members per cluster as sorted lists in numbered parts, so a huge cluster is never one value.

    Words are placed by a hash part; with few words there is a single part per cluster.
    """
    n = labels.groupBy(cluster_col).agg(F.count(F.lit(1)).alias("_n"))
    part = F.pmod(F.xxhash64(word_col), F.ceil(F.col("_n") / part_rows).cast("long"))
    return labels.join(n, cluster_col).groupBy(cluster_col, part.alias("part")).agg(
        F.array_sort(F.collect_list(word_col)).alias("words"))


def silhouette(df: DataFrame, *, id_col: str = "word", cluster_col: str = "cluster", vector_col: str = "vector",
               normalise: bool = True, tiles: int | None = None) -> DataFrame:
    """Exact per-item silhouette with Euclidean distances.

    Items go to hash tiles of about TILE_ROWS rows, at least ``tiles`` of them. Each pair of tiles is visited once, for both sides, in strips
    of DISTANCES distances that yield only totals per (item, other cluster); pairs are never rows, and what a task holds does not
    grow with the table. All pairs are compared, so time, and with the number of tiles the shuffle, grow with the square of the rows.
    """
    tiles = max(tiles or 1, -(-df.count() // TILE_ROWS))
    vec = unit(F.col(vector_col).cast("array<double>")) if normalise else F.col(vector_col).cast("array<double>")
    tile = F.pmod(F.xxhash64(id_col), F.lit(tiles)).cast("int")
    rows = df.select(F.col(id_col).alias("id"), F.col(cluster_col).alias("c"), vec.alias("v"), tile.alias("tile"))
    other = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("other")
    # a row meets every tile once: as the left one of the pair, its own included, or as the right one
    both = rows.select("*", other).select(
        "id", "c", "v", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), (F.col("tile") <= F.col("other")).alias("is_left"))
    id_type = df.schema[id_col].dataType.simpleString()
    c_type = df.schema[cluster_col].dataType.simpleString()

    def totals(pdf: pd.DataFrame) -> pd.DataFrame:
        same = pdf["a"].iloc[0] == pdf["b"].iloc[0]
        left = pdf[pdf["is_left"]]
        right = left if same else pdf[~pdf["is_left"]]
        if left.empty or right.empty:
            return pd.DataFrame({"id": left["id"][:0], "c": left["c"][:0], "oc": right["c"][:0], "total": pd.Series(dtype=float)})
        x = np.stack(left["v"].to_numpy()).astype(float)
        y = x if same else np.stack(right["v"].to_numpy()).astype(float)
        xx, yy = (x * x).sum(1), (y * y).sum(1)
        ids = pd.factorize(left["id"])[0] if same else None
        mine, theirs = clusters_of(left["c"]), clusters_of(right["c"])
        to_right, to_left = np.zeros((len(x), theirs[0].shape[1])), np.zeros((len(y), mine[0].shape[1]))
        step = max(1, DISTANCES // len(y))
        for at in range(0, len(x), step):
            strip = slice(at, at + step)
            dist = x[strip] @ y.T
            dist *= -2
            dist += xx[strip, None]
            dist += yy
            np.sqrt(np.maximum(dist, 0, out=dist), out=dist)
            if same:
                # a pair of equal rows is at distance 0 whatever rounding says
                dist[ids[strip, None] == ids] = 0
            else:
                to_left += dist.T @ mine[0][strip]
            to_right[strip] = dist @ theirs[0]
        found = [summed(left, to_right, theirs[1])]
        return found[0] if same else pd.concat([*found, summed(right, to_left, mine[1])], ignore_index=True)

    def clusters_of(c: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        code, names = pd.factorize(c)
        onehot = np.zeros((len(code), len(names)))
        onehot[np.arange(len(code)), code] = 1
        return onehot, np.asarray(names)

    def summed(side: pd.DataFrame, sums: np.ndarray, names: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({
            "id": np.repeat(side["id"].to_numpy(), len(names)), "c": np.repeat(side["c"].to_numpy(), len(names)),
            "oc": np.tile(names, len(side)), "total": sums.ravel()})

    sums = both.groupBy("a", "b").applyInPandas(totals, f"id {id_type}, c {c_type}, oc {c_type}, total double")
    sums = sums.groupBy("id", "c", "oc").agg(F.sum("total").alias("total"))
    sizes = df.groupBy(F.col(cluster_col).alias("oc")).agg(F.count(F.lit(1)).alias("n"))
    own = F.col("oc") == F.col("c")
    mean = F.try_divide(F.col("total"), F.when(own, F.col("n") - 1).otherwise(F.col("n")))
    per = sums.join(sizes, "oc").groupBy("id", "c").agg(
        F.max(F.when(own, mean)).alias("a"), F.min(F.when(~own, mean)).alias("b"))
    score = F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    return per.select(F.col("id").alias(id_col), F.col("c").alias(cluster_col), F.when(F.col("a").isNull(), 0.0).otherwise(score).alias("silhouette"))


def kmeans_clusters(df: DataFrame, k: int, *, id_col: str = "word", vector_col: str = "vector", normalise: bool = True, seed: int = 0) -> DataFrame:
    """Default clusterer: distributed k-means labels (id, cluster, vector)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    vec = unit(F.col(vector_col).cast("array<double>")) if normalise else F.col(vector_col).cast("array<double>")
    rows = df.select(id_col, vec.alias("vector")).withColumn("features", array_to_vector("vector"))
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(rows)
    return model.transform(rows).drop("features")

