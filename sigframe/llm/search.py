"""Exact top-k search by inner product, term at a time.

Query rows are sparse rows of terms and weights. For a block of queries and a block of candidates, each term's
postings (candidate, weight) are scattered, times the queries' weights, into one dense array of scores; then the k
best of each query are selected by partition, and the selections are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window

#: Queries whose dense scores are held together, and candidates of one block.
QUERY_BLOCK, CANDIDATE_BLOCK = 1024, 4096


def whole_numbers(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of each component; NULL where the vector or a component is NULL or not finite."""
    x = lambda v: v.cast("double")
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(x(v)) | (F.abs(x(v)) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda v: F.floor(x(v) * scale).cast("long")))


def postings(rows: list[np.ndarray]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(term, rows that have it, their weights) of every term with a weight."""
    lengths = np.array([len(r) for r in rows], np.int64)
    row = np.repeat(np.arange(len(rows)), lengths)
    term = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    weight = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    keep = weight != 0
    row, term, weight = row[keep], term[keep], weight[keep]
    order = np.argsort(term, kind="stable")
    row, term, weight = row[order], term[order], weight[order]
    cuts = np.flatnonzero(np.diff(term)) + 1
    return [(int(t[0]), r, w) for t, r, w in zip(np.split(term, cuts), np.split(row, cuts), np.split(weight, cuts)) if len(t)]


def accumulate(queries: list, n_queries: int, candidates: list, n_candidates: int) -> np.ndarray:
    """Scores [query, candidate]: each term's postings, weighted by the queries that have it, are added in turn."""
    scores = np.zeros((n_queries, n_candidates), np.int64)
    own = {t: (r, w) for t, r, w in queries}
    for t, cols, weights in candidates:
        if t in own:
            rows, by = own[t]
            if len(cols) == n_candidates and len(rows) == n_queries:
                scores += by[:, None] * weights[None, :]
            else:
                scores[np.ix_(rows, cols)] += by[:, None] * weights[None, :]
    return scores


def best(scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, scores) of the k highest allowed scores, ties to the smaller id."""
    low = np.iinfo(np.int64).min
    scores = np.where(allowed, scores, low)
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    else:
        least = np.full(len(scores), low)
    for q in range(len(scores)):
        at = np.flatnonzero((scores[q] >= least[q]) & allowed[q])  # all that tie with the k-th take part
        at = at[np.lexsort((ids[at], -scores[q, at]))][:k]
        yield q, ids[at], scores[q, at]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding",
          scale: float = 256.0, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best candidates of each query.

    Queries are the rows where ``is_query`` holds, candidates all rows but those with the query's id. The score is the inner
    product of components floor(scale * x) in 64-bit integers; a missing component of a shorter vector is 0. Ties go to
    the smaller id; fewer candidates give fewer rows. Rows with a NULL id, and vectors that are NULL or hold a NULL or a
    non-finite component, take no part; an empty vector scores 0. A query row that is repeated (same id
    and vector) gets its rows once, a repeated candidate row is one candidate; rows of one id with other vectors are candidates of their own.

    Query blocks meet candidate blocks in a join on (query block, lane): queries are copied to every lane, candidates to
    every query block. A task holds one block of each and one array of scores.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("raw"), whole_numbers(F.col(vector), scale).alias("v"), is_query.alias("q"))
    rows = rows.where("vec_id IS NOT NULL AND v IS NOT NULL")
    asked = rows.where("q").select("vec_id", "raw", "v")
    n = asked.count()
    blocks = max(1, -(-n // query_block))
    lanes = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = 0
        for batch in batches:
            for at in range(0, batch.num_rows, CANDIDATE_BLOCK):
                part = batch.slice(at, CANDIDATE_BLOCK)
                yield pa.RecordBatch.from_arrays([pa.array([block % lanes], pa.int32()), listed(part["vec_id"]), listed(part["v"])],
                                                 ["nth", "ids", "vs"])
                block += 1

    # repeated rows go before the k best are taken, or they would take the places of others
    cand = rows.select("vec_id", "raw").distinct().select("vec_id", whole_numbers(F.col("raw"), scale).alias("v")).mapInArrow(packed, "nth int, ids array<bigint>, vs array<array<bigint>>")
    cand = cand.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
                       F.pmod(F.col("nth") + F.spark_partition_id(), F.lit(lanes)).alias("lane"), "ids", "vs")
    # ids are dealt evenly over the blocks, so that a group is about query_block rows
    asks = asked.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_set(F.struct("vec_id", "raw", "v")).alias("q"))
    asks = asks.select("block", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.col("q.vec_id").alias("q_ids"), F.col("q.v").alias("q_vs"))
    met = cand.join(asks, ["block", "lane"]).select("block", "ids", "vs", "q_ids", "q_vs")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, terms = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                block = row["block"][0].as_py()
                if held is None or held[0] != block:
                    q_ids = row["q_ids"].flatten().to_numpy()
                    held, terms = (block, q_ids), postings(unlisted(row["q_vs"]))
                q_ids, ids = held[1], row["ids"].flatten().to_numpy()
                scores = accumulate(terms, len(q_ids), postings(unlisted(row["vs"])), len(ids))
                yield chosen(q_ids, best(scores, ids, q_ids[:, None] != ids[None, :], k))

    found = met.mapInArrow(scored, "query_id bigint, vec_id bigint, score bigint")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def listed(column: pa.Array) -> pa.Array:
    """All values of a column as one list."""
    column = pa.concat_arrays([column])  # offsets from 0
    return pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)


def unlisted(column: pa.Array) -> list[np.ndarray]:
    inner = column.flatten()
    flat = inner.flatten().to_numpy().astype(np.int64)
    ends = inner.offsets.to_numpy()
    return np.split(flat, (ends[1:-1] - ends[0])) if len(inner) else []


def chosen(q_ids: np.ndarray, found: Iterator) -> pa.RecordBatch:
    parts = list(found)
    lengths = [len(p[1]) for p in parts]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(q_ids[[p[0] for p in parts]], lengths)) if parts else pa.array([], pa.int64()),
         pa.array(np.concatenate([p[1] for p in parts])) if parts else pa.array([], pa.int64()),
         pa.array(np.concatenate([p[2] for p in parts])) if parts else pa.array([], pa.int64())], ["query_id", "vec_id", "score"])
