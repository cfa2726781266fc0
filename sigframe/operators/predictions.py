"""Scores of predicted token distributions, for all positions at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from sigframe.functions.arrays import cosine, norm2, unit, with_value
from sigframe.operators.words import join_skewed

POS = ("run", "pos")


def softmax(df: DataFrame, logit: str = "logit", *, keys: Sequence[str] = POS, name: str = "prob") -> DataFrame:
    """exp(x - max)/sum per position; the two totals come from aggregation and a join, so a
    position's vocabulary is never sorted or held whole."""
    top = df.groupBy(*keys).agg(F.max(logit).alias("_top"))
    shifted = df.join(top, list(keys)).withColumn("_e", F.exp(F.col(logit) - F.col("_top")))
    total = shifted.groupBy(*keys).agg(F.sum("_e").alias("_sum"))
    return shifted.join(total, list(keys)).withColumn(name, F.col("_e") / F.col("_sum")).drop("_e", "_top", "_sum")


def last_logits(df: DataFrame, *, keys: Sequence[str] = ("run", "pos"), token_pos: str = "token_pos", masked: bool = False) -> DataFrame:
    """Logits at the last input position (the one before it for masked models)."""
    n = df.groupBy(*keys).agg(F.max(token_pos).alias("_last"))
    want = F.col("_last") - (1 if masked else 0)
    return df.join(n, list(keys)).where(F.col(token_pos) == want).drop("_last")


def top_n(df: DataFrame, n: int, *, keys: Sequence[str] = POS, token: str = "token", prob: str = "prob") -> DataFrame:
    """The n most probable tokens per position with ``rank``; ties go by token."""
    w = Window.partitionBy(*keys).orderBy(F.col(prob).desc(), F.col(token))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def entropy(df: DataFrame, *, keys: Sequence[str] = POS, prob: str = "prob") -> DataFrame:
    """-sum p ln p of the renormalised p: ln S - (sum p ln p)/S, in one pass."""
    p = F.col(prob)
    s = F.sum(p)
    return df.groupBy(*keys).agg((F.ln(s) - F.sum(F.when(p > 0, p * F.ln(p)).otherwise(0.0)) / s).alias("entropy"))


def with_previous(df: DataFrame, *, run_cols: Sequence[str] = ("run",), pos: str = "pos", token: str = "token", prob: str = "prob") -> DataFrame:
    """(run, pos, token, p, q): the distribution and the one before it, zeros where absent.

    Each row stands for its own position and as the past of the next; one grouping brings the
    two together without a self join.
    """
    both = df.select(*run_cols, token, F.explode(F.array(
        F.struct(F.col(pos).alias("at"), F.col(prob).alias("p"), F.lit(0.0).alias("q")),
        F.struct((F.col(pos) + 1).alias("at"), F.lit(0.0).alias("p"), F.col(prob).alias("q")))).alias("s"))
    return both.groupBy(*run_cols, F.col("s.at").alias(pos), token).agg(F.max("s.p").alias("p"), F.max("s.q").alias("q"))


def relative_entropy(df: DataFrame, *, run_cols: Sequence[str] = ("run",), pos: str = "pos", token: str = "token", prob: str = "prob") -> DataFrame:
    """Sum of p ln(p/q) - p + q against the previous position, infinite terms as 0, NULL on the first."""
    p, q = F.col("p"), F.col("q")
    term = F.when((p > 0) & (q > 0), p * F.ln(p / q) - p + q).when(p > 0, 0.0).otherwise(q)
    keys = [*run_cols, pos]
    both = with_previous(df, run_cols=run_cols, pos=pos, token=token, prob=prob)
    return both.groupBy(*keys).agg(F.sum(term).alias("_kl"), F.max("p").alias("_p"), F.max("q").alias("_q")).where(
        F.col("_p") > 0).select(*keys, F.when(F.col("_q") > 0, F.col("_kl")).alias("relative_entropy"))


def word_prob(truth: DataFrame, probs: DataFrame, *, keys: Sequence[str] = POS) -> DataFrame:
    """Mean probability of the truth word's subword tokens (``tokens`` array); absent tokens are 0."""
    wanted = truth.select(*keys, F.explode("tokens").alias("token"))
    found = wanted.join(probs.select(*keys, "token", "prob"), [*keys, "token"], "left")
    return found.groupBy(*keys).agg(F.avg(F.coalesce("prob", F.lit(0.0))).alias("ground_truth_prob"))


def similarity(pred: DataFrame, truth: DataFrame, vectors: DataFrame, *, keys: Sequence[str] = POS, prefix: str = "") -> DataFrame:
    """avg/max cosine of predicted words to the truth word and the density of the predictions.

    The mean pairwise distance follows from the length of the summed unit vectors,
    1 - (|sum|^2 - n)/(n(n-1)), so predictions are never paired. All three are NULL when the
    truth word or every prediction is unknown; the density also with a single prediction.
    """
    k = list(keys)
    vec = vectors.select("word", F.col("vector").cast("array<double>").alias("_v"))
    t = join_skewed(truth.select(*k, "word"), vec, "word", spread_by=k).select(*k, F.col("_v").alias("_t"))
    p = join_skewed(pred.select(*k, F.col("token").alias("word")), vec, "word", spread_by=[*k, "word"]).select(*k, "_v")
    pairs = p.join(t, k).withColumn("_cos", cosine(F.col("_v"), F.col("_t")))
    # a zero vector has no direction and stays out of the density
    u = with_value(norm2(F.col("_v")), lambda n: F.transform("_v", lambda v: F.when(n > 0, v / n).otherwise(0.0)))
    good = F.sum(F.exists("_v", lambda v: v != 0).cast("int"))
    agg = pairs.groupBy(*k).agg(
        F.avg("_cos").alias(f"{prefix}avg_accuracy"), F.max("_cos").alias(f"{prefix}max_accuracy"),
        good.alias("_n"), vector_to_array(Summarizer.sum(array_to_vector(u))).alias("_s"))
    return agg.select(*k, f"{prefix}avg_accuracy", f"{prefix}max_accuracy", pairwise_distance(F.col("_s"), F.col("_n")).alias(f"{prefix}prediction_density"))


def pairwise_distance(unit_sum: Column, n: Column) -> Column:
    """Mean cosine distance over pairs from the sum of n unit vectors; NULL below two."""
    sq = F.pow(norm2(unit_sum), F.lit(2.0))
    return F.when(n > 1, 1 - (sq - n) / (n * (n - 1)))


def group_density(df: DataFrame, group_cols: Sequence[str], vector_col: str) -> DataFrame:
    """Mean pairwise cosine distance of the non-zero vectors in each group."""
    v = F.col(vector_col).cast("array<double>")
    rows = df.select(*group_cols, v.alias("_v")).where(norm2(F.col("_v")) > 0)
    sums = rows.groupBy(*group_cols).agg(
        vector_to_array(Summarizer.sum(array_to_vector(unit(F.col("_v"))))).alias("_s"), F.count(F.lit(1)).alias("n"))
    return sums.select(*group_cols, "n", pairwise_distance(F.col("_s"), F.col("n")).alias("density"))


def prediction_statistics(probs: DataFrame, truth: DataFrame, vector_tables: dict[str, DataFrame] | None = None, *,
                          run_cols: Sequence[str] = ("run",), pos: str = "pos", n: int = 1,
                          names: Sequence[str] = ("glove", "word2vec", "fasttext")) -> DataFrame:
    """One row per position with truth probability, top words, hit, similarities and uncertainty.

    ``truth`` has (run, pos, word, tokens). Vector tables that are not given leave NULL columns.
    """
    keys = [*run_cols, pos]
    truth = truth.withColumn("word", F.lower("word"))
    top = top_n(probs, n, keys=keys).withColumn("token", F.lower(F.trim("token")))
    # at most n rows per position
    lists = top.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("rank", "token"))).alias("_t"), F.max("prob").alias("top_prob"))
    out = (
        truth.select(*keys, F.col("word").alias("ground_truth_word"))
        .join(uncertainty(probs, truth, run_cols=run_cols, pos=pos), keys)
        .join(lists.select(*keys, F.col("_t.token").alias("top_n_predictions"), "top_prob"), keys)
        .withColumn("binary_accuracy", F.array_contains("top_n_predictions", F.col("ground_truth_word")))
    )
    for name in names:
        table = (vector_tables or {}).get(name)
        made = [f"{name}_avg_accuracy", f"{name}_max_accuracy", f"{name}_prediction_density"]
        if table is None:
            out = out.withColumns({c: F.lit(None).cast("double") for c in made})
        else:
            out = out.join(similarity(top, truth, table, keys=keys, prefix=f"{name}_"), keys, "left")
    return out


def uncertainty(probs: DataFrame, truth: DataFrame, *, run_cols: Sequence[str] = ("run",), pos: str = "pos") -> DataFrame:
    """(run, pos, ground_truth_prob, entropy, relative_entropy) from one pass over the predictions.

    A prediction counts for its own position and as the past of the next, a truth token asks
    for its probability; one grouping by token and one by position give all three numbers.
    """
    keys = [*run_cols, pos]
    zero, none = F.lit(0.0), F.lit(0)
    mine = probs.select(*run_cols, "token", F.explode(F.array(
        F.struct(F.col(pos).alias("at"), F.col("prob").alias("p"), zero.alias("q"), none.alias("asked")),
        F.struct((F.col(pos) + 1).alias("at"), zero.alias("p"), F.col("prob").alias("q"), none.alias("asked")))).alias("s"))
    asked = truth.select(*run_cols, F.explode("tokens").alias("token"), F.struct(
        F.col(pos).alias("at"), zero.alias("p"), zero.alias("q"), F.lit(1).alias("asked")).alias("s"))
    cells = mine.unionByName(asked).groupBy(*run_cols, F.col("s.at").alias(pos), "token").agg(
        F.max("s.p").alias("p"), F.max("s.q").alias("q"), F.sum("s.asked").alias("asked"))
    p, q = F.col("p"), F.col("q")
    term = F.when((p > 0) & (q > 0), p * F.ln(p / q) - p + q).when(p > 0, 0.0).otherwise(q)
    sums = cells.groupBy(*keys).agg(
        F.sum("p").alias("_p"), F.sum("q").alias("_q"), F.sum(F.when(p > 0, p * F.ln(p)).otherwise(0.0)).alias("_plp"),
        F.sum(term).alias("_kl"), F.try_divide(F.sum(p * F.col("asked")), F.sum("asked")).alias("ground_truth_prob"))
    return sums.where("_p > 0").select(
        *keys, "ground_truth_prob", (F.ln("_p") - F.col("_plp") / F.col("_p")).alias("entropy"),
        F.when(F.col("_q") > 0, F.col("_kl")).alias("relative_entropy"))
