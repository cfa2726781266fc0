import math
import random

from pyspark.sql import functions as F

from sigframe.llm import search


def brute(rows, k, scale=256.0):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good[(i, tuple(v))] = [math.floor(scale * x) for x in v]
    out = set()
    for (q, _), a in good.items():
        if q % 50 == 0:
            scored = [(-sum(x * y for x, y in zip(a, b)), c) for (c, _), b in good.items() if c != q]
            out |= {(q, n, c, -s) for n, (s, c) in enumerate(sorted(scored)[:k], 1)}
    return out


def got(df, k, **more):
    rows = search.top_k(df, F.col("vec_id") % 50 == 0, k=k, **more).collect()
    out = {(r.query_id, r["rank"], r.vec_id, r.score) for r in rows}
    assert len(out) == len(rows)
    return out


def test_against_brute_force(spark):
    rng = random.Random(5)
    vector = lambda: [rng.choice([0.0, 0.25, -0.5, rng.uniform(-1, 1)]) for _ in range(8)]
    rows = [(i, vector()) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)]  # ties
    rows += [(500, None), (501, [1.0, None]), (502, [float("nan")] * 8), (550, [float("inf")] * 8), (None, vector()), (600, []), (601, [0.5]), rows[50], rows[51]]
    df = spark.createDataFrame([(a, b, 1.0, 2) for a, b in rows], "vec_id long, embedding array<double>, score double, rank int").repartition(7)
    want = brute(rows, 5)
    assert got(df, 5) == want
    assert got(df, 5, query_block=3) == want
    assert got(df.limit(0), 5) == set()
    assert got(df.where("vec_id % 50 <> 0"), 5) == set()
    assert got(df.where("vec_id = 100 OR vec_id = 3"), 5) == brute([rows[100], rows[3]], 5)


def test_repeated_rows_push_nothing_out(spark):
    rows = [(0, [1.0, 0.0])] + [(7, [9.0, 0.0])] * 6 + [(i, [float(i % 5), 1.0]) for i in range(10, 20)]
    rows += [(30, [3.0, 1.0]), (30, [3.0, 2.0])]  # one id, two vectors, one score
    want = brute(rows, 5)
    assert len(want) == 5
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert got(df.coalesce(1), 5) == want
    assert got(df.coalesce(1), 9) == brute(rows, 9)
    assert got(df.repartition(5), 5) == want
