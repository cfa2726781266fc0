import math

import numpy as np

from sigframe.llm import quality
from sigframe.llm.arrays import ngrams


def test_scores_are_dot_products():
    texts = ["", "one", "one two", "a b c d a b c d e", "Big!! BIG!! 123 x### y###", "w " * 300]
    reader = quality.Words()
    kinds = quality.features(*reader.read(texts))
    rng = np.random.default_rng(0)
    model = quality.Model(rng.normal(size=1 << quality.BITS).astype(np.float32), 0.3)
    got = model.scores(kinds)
    for i in range(len(texts)):
        alone = quality.features(*quality.Words().read([texts[i]]))
        z = 0.3
        for (b, at), (own, _) in zip(kinds, alone):
            assert b[at[i]:at[i + 1]].tolist() == own.tolist()  # a text's features do not depend on its neighbours
            z += quality.SCALE * sum(float(model.weights[j]) for j in own) / max(1, len(own))
        assert math.isclose(got[i], 1 / (1 + math.exp(-z)), rel_tol=1e-6)


def test_shapes_and_ngrams():
    assert quality.shape("Hello,") == "Aa," and quality.shape("THERE!!") == "A!" and quality.shape("x12***") == "a0*" and quality.shape("ÉTÉ") == "A"
    values, ends = np.arange(5, dtype=np.uint64), np.array([0, 1, 1, 5])
    grams, at = ngrams(values, ends, 2)
    assert at.tolist() == [0, 0, 0, 3] and len(set(grams.tolist())) == 3


def test_training_follows_the_leader_and_rows(spark):
    docs = [(i, ("good plain words here " if i % 2 else "bad*** junk### words&&& ") * 5) for i in range(200)]
    odd = [(900, None), (901, ""), (902, "good " * 50_000), (903, "x"), (903, "x"), (None, "y")]
    df = spark.createDataFrame([(a, b, 5, "s") for a, b in docs + odd], "doc_id long, text string, score int, label string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(160)] + [(3, 1, 0), (None, 1, 0), (5, None, 0), (900, 1, 0)], "doc_id long, quality int, text int")
    model = quality.fit(df, labels)
    got = {r.doc_id: r.score for r in quality.score(df, model).collect()}
    assert all((got[i] > 0.7) == (i % 2 == 1) for i in range(160, 200))
    assert got[900] == got[901] and all(0 <= s <= 1 for s in got.values())
    assert quality.score(df, model).count() == len(docs + odd) and quality.score(df.limit(0), model).count() == 0
    assert quality.fit(df, labels.limit(0)).scores(quality.features(*quality.Words().read(["a b"])))[0] == 0.5
