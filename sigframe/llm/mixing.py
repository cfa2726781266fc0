"""Mixing sources to target weights by temperature.

A source's share of all tokens is raised to an exponent between 0 (all sources alike) and 1 (as they are) and normalised. The
exponent is bisected: the largest one whose weights have at least the target entropy, or, where that would repeat a source
more often than the limit, the smallest one that keeps to the limit. The weights are realised exactly: each source gets weight times budget tokens, as whole
passes over its documents and a part of one more. Every pass takes the blocks of a source (documents by hash) in an
order of its own, and documents within a block by hash; the last pass ends where the budget does.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F, Window

from sigframe.llm.common import WORD, whole
from sigframe.session import written

#: Blocks of a source. A task orders the documents of one block.
BLOCKS = 1024
#: Totals of sources are bisected on the driver: up to so many, or the call is refused.
MAX_SOURCES = 100_000


@dataclass(frozen=True)
class Mix:
    exponent: float
    weights: dict[str, float]
    tokens: dict[str, int]
    budget: float

    def share(self, source: str) -> float:
        """Passes over a source: tokens it is given over tokens it has."""
        return self.budget * self.weights[source] / self.tokens[source]


def tempered(tokens: dict[str, int], exponent: float) -> dict[str, float]:
    top = max(tokens.values())
    raw = {s: (n / top) ** exponent for s, n in sorted(tokens.items())}
    total = math.fsum(raw.values())
    return {s: x / total for s, x in raw.items()}


def entropy(weights: dict[str, float]) -> float:
    return -math.fsum(w * math.log(w) for w in weights.values() if w > 0)


def plan(tokens: dict[str, int], target_entropy: float = 0.95, most_repeats: float = 4.0, budget: float | None = None) -> Mix:
    """Weights and budget for token totals per source; sources without tokens take no part.

    ``target_entropy`` is a share of the largest possible one. ``budget`` is in tokens; without one it is the least that
    gives every source a full pass, so that no document is left out.
    """
    tokens = {s: n for s, n in tokens.items() if n > 0}
    if not tokens:
        return Mix(1.0, {}, {}, 0.0)
    least = target_entropy * math.log(len(tokens))

    def spent(weights: dict[str, float]) -> float:
        return budget if budget is not None else max(n / weights[s] for s, n in tokens.items())

    def repeats(e: float) -> float:
        w = tempered(tokens, e)
        return max(spent(w) * w[s] / n for s, n in tokens.items())

    def bisect(fits_low) -> float:
        low, high = 0.0, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if fits_low(mid) else (low, mid)
        return low

    enough = lambda e: entropy(tempered(tokens, e)) >= least  # noqa: E731  falls as the exponent grows
    exponent = 1.0 if enough(1.0) else bisect(enough)
    if repeats(exponent) > most_repeats:  # repeats fall as the exponent grows
        exponent = 1.0 if repeats(1.0) > most_repeats else 1 - bisect(lambda x: repeats(1 - x) <= most_repeats)
    weights = tempered(tokens, exponent)
    return Mix(exponent, weights, tokens, spent(weights))


def mix(docs: DataFrame, target_entropy: float = 0.95, most_repeats: float = 4.0, budget: float | None = None, seed: int = 0,
        doc_id: str = "doc_id", text: str = "text", source: str = "source", keep: list[str] | None = None) -> DataFrame:
    """doc_id, source, n_tokens, pass (from 0) and position of every document each time it is taken, and the columns ``keep``.

    Tokens are words. ``position`` is the share of the source's tokens that come before, from 0 up to 1: ordered by it, the stream
    has the target weights all along. Rows without a source form one source, named by an empty text. A document without
    tokens has one token, so that it is taken with its source. Repeated rows are documents of their own; an empty table
    gives an empty mixture. A document goes in if the budget is not yet spent where it begins.

    No source is sorted as a whole: tokens are summed by block, blocks are put in order and their starts found on that small
    table, and documents are ordered within their block.
    """
    keep = [c for c in keep or [] if c not in (doc_id, source)]
    n = F.greatest(F.regexp_count(whole(text), F.lit(WORD)), F.lit(1)).cast("long")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_source"), n.alias("n_tokens"),
                       F.xxhash64(F.col(doc_id), whole(text)).alias("_h"), *([F.struct(*keep).alias("_keep")] if keep else []))
    rows = rows.withColumn("_block", F.pmod(F.xxhash64("_h", F.lit(seed)), F.lit(BLOCKS)))
    sizes = written(rows.groupBy("_source", "_block").agg(F.sum("n_tokens").alias("n")), "blocks")
    totals = sizes.groupBy("_source").agg(F.sum("n").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; mix groups of them")
    planned = plan({r["_source"]: r["n"] for r in totals}, target_entropy, most_repeats, budget)
    given = docs.sparkSession.createDataFrame([(s, float(planned.share(s)), planned.budget * w) for s, w in planned.weights.items()],
                                              "_source string, passes double, given double")
    total = Window.partitionBy("_source")
    taken = sizes.join(F.broadcast(given), "_source")  # at most MAX_SOURCES rows
    taken = taken.withColumn("total", F.sum("n").over(total))
    # passes are whole numbers where the budget is a multiple of the total; what rounding leaves over is no pass
    taken = taken.withColumn("pass", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("passes") - 1e-9).cast("int") - 1))))
    order = Window.partitionBy("_source", "pass").orderBy(F.xxhash64(F.lit(seed), "_source", "pass", "_block"), "_block").rowsBetween(Window.unboundedPreceding, -1)
    taken = taken.withColumn("start", F.col("pass") * F.col("total") + F.coalesce(F.sum("n").over(order), F.lit(0)))
    taken = taken.where(F.col("start") < F.col("given") - 0.5).select("_source", "_block", "pass", "start", "given")
    within = Window.partitionBy("_source", "_block").orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_before", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    out = placed.join(taken, ["_source", "_block"]).withColumn("_at", F.col("start") + F.col("_before"))
    out = out.where(F.col("_at") < F.col("given") - 0.5)
    return out.select("doc_id", "source", "n_tokens", "pass", (F.col("_at") / F.col("given")).alias("position"),
                      *([F.col(f"_keep.{c}").alias(c) for c in keep]))
