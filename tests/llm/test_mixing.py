import math
from collections import defaultdict

import pytest

from sigframe.llm import mixing


def test_exponent_meets_the_target():
    tokens = {"a": 1_000_000, "b": 100_000, "c": 50_000, "d": 200_000}
    got = mixing.plan(tokens, target_entropy=0.9, most_repeats=100)
    assert math.isclose(mixing.entropy(got.weights), 0.9 * math.log(4), rel_tol=1e-6)
    assert min(got.share(s) for s in tokens) == pytest.approx(1)
    few = mixing.plan(tokens, target_entropy=0.999, most_repeats=3)
    assert max(few.share(s) for s in tokens) == pytest.approx(3, rel=1e-6)
    assert mixing.plan({"a": 5, "b": 5}).exponent == 1.0 and mixing.plan({}).weights == {} and mixing.plan({"a": 3}).weights == {"a": 1.0}


def test_weights_are_realised(spark):
    rows = [(i, "w " * (1 + i % 7), "big") for i in range(3000)] + [(5000 + i, "w " * 4, "small") for i in range(400)] + [(9000 + i, "x y", None) for i in range(300)]
    rows += [(9999, None, "small"), (9998, "", "small"), (None, "q", "small"), (9997, "w " * 50_000, "big"), (0, "w ", "big"), (0, "w ", "big")]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, source string, position double").repartition(5)
    tokens = defaultdict(int)
    for _, t, s in rows:
        tokens[s or ""] += max(1, len((t or "").split()))
    want = mixing.plan(dict(tokens), 0.9, 4.0)
    got = mixing.mix(docs, 0.9, 4.0).collect()
    sums, times = defaultdict(int), defaultdict(int)
    for r in got:
        sums[r.source or ""] += r.n_tokens
        times[(r.doc_id, r.source, r["pass"])] += 1
        assert 0 <= r.position < 1
    largest = max(len((t or "").split()) for _, t, s in rows if s != "big")
    for s in ("small", ""):
        assert want.budget * want.weights[s] <= sums[s] + 1 and sums[s] < want.budget * want.weights[s] + largest + 1
    assert sums["big"] == tokens["big"]  # one whole pass, nobody left out
    assert times[(0, "big", 0)] == 3 and all(n == 1 for k, n in times.items() if k[0] != 0)
    again = mixing.mix(docs.repartition(3), 0.9, 4.0).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    half = [r for r in got if r.position < 0.5]
    shares = defaultdict(int)
    for r in half:
        shares[r.source or ""] += r.n_tokens
    assert shares["small"] / want.weights["small"] == pytest.approx(shares[""] / want.weights[""], rel=0.05)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_a_budget_below_one_pass(spark):
    docs = spark.createDataFrame([(i, "a b c", "s" if i % 2 else "t") for i in range(1000)], "doc_id long, text string, source string")
    got = mixing.mix(docs, budget=600.0).collect()
    assert 600 <= sum(r.n_tokens for r in got) < 606 and len({r.doc_id for r in got}) == len(got)


def test_columns_are_kept(spark):
    docs = spark.createDataFrame([(1, "a b", "s", "en"), (2, None, "", "de")], "doc_id long, text string, source string, lang string")
    got = mixing.mix(docs, keep=["doc_id", "text", "source", "lang"]).select("doc_id", "text", "source", "lang").distinct().collect()
    assert {tuple(r) for r in got} == {(1, "a b", "s", "en"), (2, None, "", "de")}
