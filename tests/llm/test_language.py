import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigframe.llm import language
from sigframe.llm.language import LanguageModel, ORDER


def brute_bits(text: bytes, training: list[bytes], order: int) -> float:
    """Code length by counting contexts in dictionaries, byte by byte."""
    counts: dict[bytes, dict[int, int]] = {}
    for t in training:
        t = b"\0" * order + t
        for i in range(order, len(t)):
            for k in range(order + 1):
                own = counts.setdefault(t[i - k:i], {})
                own[t[i]] = own.get(t[i], 0) + 1
    total, t = 0.0, b"\0" * order + text
    for i in range(order, len(t)):
        for k in range(order, -1, -1):
            own = counts.get(t[i - k:i])
            if own is None:
                continue
            n, d = sum(own.values()), len(own)
            if t[i] in own:
                total += math.log2((n + d) / own[t[i]])
                break
            total += math.log2((n + d) / d)
        else:
            total += 8
    return total


def test_code_lengths_match_brute_force():
    rng = random.Random(1)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(1, 6)))
    texts = {"x": [" ".join(word("abcde é") for _ in range(40)).encode() for _ in range(4)],
             "y": [" ".join(word("cdefg ß") for _ in range(40)).encode() for _ in range(4)]}
    model = LanguageModel.train(texts)
    asked = [b"", b"a", "abc é zz".encode(), "cdef ßß gg".encode() * 20, bytes(range(256))]
    bits = model.code_lengths(np.frombuffer(b"".join(asked), np.uint8), np.cumsum([0] + [len(t) for t in asked]))
    for i, t in enumerate(asked):
        for j, name in enumerate(("x", "y")):
            assert math.isclose(bits[i, j], brute_bits(t, texts[name], ORDER), rel_tol=1e-5, abs_tol=1e-5)


def test_long_text_in_pieces_equals_whole(monkeypatch):
    model = LanguageModel.train({"x": [b"the cat sat on the mat"], "y": [b"der hund lief im wald"]})
    data = np.frombuffer(b"the dog lief on the wald " * 400, np.uint8)
    want = model.code_lengths(data, np.array([0, len(data)]))
    monkeypatch.setattr(language, "SLICE_BYTES", 1000)
    assert np.allclose(model.code_lengths(data, np.array([0, len(data)])), want)


def test_odd_rows(spark):
    model = LanguageModel.train({"en": [b"the cat sat on the mat and the dog ran"] * 3, "de": ["der hund lief über die brücke".encode()] * 3})
    rows = [(1, None), (2, ""), (3, "12 34 !"), (4, "the dog"), (4, "the dog"), (None, "der hund"), (5, "the cat " * 100_000)]
    docs = spark.createDataFrame([(a, b, "x", 1.0) for a, b in rows], "doc_id long, text string, score string, lang_pred double")
    got = {(r.doc_id, r.lang_pred) for r in language.identify(docs, model, ["doc_id"]).collect()}
    assert got == {(1, "und"), (2, "und"), (3, "und"), (4, "en"), (None, "de"), (5, "en")}
    assert language.identify(docs, model, ["doc_id"]).count() == len(rows)
    assert language.identify(docs.limit(0), model, ["doc_id"]).count() == 0


def test_nothing_learned_and_ties(spark):
    docs = spark.createDataFrame([(1, "the"), (2, None)], "doc_id long, text string")
    assert {r.lang_pred for r in language.identify(docs, LanguageModel.train({}), ["doc_id"]).collect()} == {"und"}
    same = LanguageModel.train({"b": [b"abc"], "a": [b"abc"]})
    row = language.identify(docs.where("doc_id = 1"), same, ["doc_id"]).first()
    assert (row.lang_pred, row.score) == ("a", 0.5)


def test_sample_is_bounded_and_skips_nulls(spark):
    docs = spark.createDataFrame([(i, "word " * 200, "en") for i in range(2000)] + [(-1, None, "en"), (-2, "x", None), (-3, "x" * 40000, "en")],
                                 "doc_id long, text string, lang string")
    got = language.sample(docs)
    assert set(got) == {"en"} and 150_000 < sum(map(len, got["en"])) < 400_000 and max(map(len, got["en"])) <= language.TEXT_BYTES
    assert language.sample(docs.limit(0)) == {}


def test_every_language_is_learned(spark):
    """70 languages, one of them in a single long text, one in a text of a letter; too many are an error."""
    rng = random.Random(4)
    letters = [chr(0x4E00 + 40 * k + j) for k in range(70) for j in range(8)]
    text = lambda k, n: " ".join("".join(rng.choices(letters[8 * k:8 * k + 8], k=4)) for _ in range(n))
    rows = [(100 * k + i, text(k, 30), f"l{k:02d}") for k in range(68) for i in range(12)]
    rows += [(90_000, text(68, 9000), "l68"), (90_001, letters[8 * 69], "l69"), (90_002, None, "l70"), (90_003, "", "l70"), (90_004, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    got = language.sample(docs)
    assert sorted(got) == [f"l{k:02d}" for k in range(70)]
    assert 0 < len(b"".join(got["l68"])) <= language.TRAIN_BYTES // 70
    model = LanguageModel.train(got)
    found = {r.doc_id: r.lang_pred for r in language.identify(docs, model, ["doc_id"]).collect()}
    assert all(found[d] == lang for d, t, lang in rows if t and lang)
    assert found[90_002] == found[90_003] == "und"
    many = spark.range(language.LANGUAGES + 1).select(F.col("id").alias("doc_id"), F.lit("a text").alias("text"), F.col("id").cast("string").alias("lang"))
    with pytest.raises(ValueError):
        language.sample(many)
