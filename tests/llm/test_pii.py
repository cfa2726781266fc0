import random
import re

from pyspark.sql import functions as F

from sigframe.llm import pii

# The contract's patterns, tried by Python's own engine.
PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(d):
    return sum(x - 9 * (x > 9) for x in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0


def brute(text):
    out = []
    for nth, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), nth, m.end()))
    return sorted(out)


def texts():
    rng = random.Random(4)
    parts = ["a@b.c", "x.y@z", "é", "🙂", " ", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (499) 555-6503", "+49 30 12", "0.0.0.0.0", "_", "@", ".", "-", "7",
             "tel ", "jo (at) ex (dot) org", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "\n", "word", "+", "(", ")"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(400)]
    return [None, "", "a@b.c_d@e.f", "9" * 30_000, "1 " * 5_000, "a" * 50_000, "+1-" * 3_000, "1.1.1.1 " * 1500] + made


def test_base_spans_and_redaction(spark):
    rows = list(enumerate(texts())) + [(9, "a@b.c"), (9, "a@b.c"), (None, "1.2.3.4")]
    docs = spark.createDataFrame([(a, b, 1, "s") for a, b in rows], "doc_id long, text string, kind int, spans string")
    model = pii.train(docs)
    found = pii.find(docs, model, [F.col("doc_id")])
    got = found.select("doc_id", F.col("_text").alias("text"), "base", "spans", pii.redacted(F.col("_text"), F.col("spans")).alias("red")).collect()
    assert len(got) == len(rows)
    for r in got:
        base = [tuple(x) for x in r.base]
        assert base == brute(r.text), r.text[:80]
        spans = [tuple(x) for x in r.spans]
        assert set(base) <= set(spans) and spans == sorted(set(spans))
        out, at = [], 0
        for start, kind, end in spans:
            if start >= at:
                out += [r.text[at:start], f"[{pii.KINDS[kind].upper()}]"]
            at = max(at, end)
        assert r.red == ("".join(out) + r.text[at:] if spans else r.text)
    assert pii.find(docs.limit(0), model, [F.col("doc_id")]).count() == 0
    assert pii.train(docs.limit(0)).thresholds == {}
    assert {len(r.base) - len(r.spans) for r in pii.find(docs, pii.Trees(), [F.col("doc_id")]).collect()} == {0}


def test_trees_learn_and_calibrate():
    import numpy as np

    rng = np.random.default_rng(0)
    rows = np.unique(rng.integers(0, 6, (3000, len(pii.FEATURES))), axis=0)
    rows[:, 0] %= 2
    label = (rows[:, 1] > 2) ^ (rows[:, 3] > 3)
    good, bad = np.where(label, 5.0, 0.0), np.where(label, 0.0, 5.0)
    model = pii.boost(rows, good, bad)
    assert ((model.margins(rows) > 0) == label).mean() > 0.97
    pii.calibrate(model, rows, good, bad, 0.98)
    for kind, t in model.thresholds.items():
        at = (rows[:, 0] == kind) & (model.margins(rows) >= t)
        assert good[at].sum() >= 0.98 * (good[at] + bad[at]).sum()


def test_scores_in_sql_equal_those_in_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = rng.integers(0, 6, (200, len(pii.FEATURES)))
    model = pii.boost(rows, (rows[:, 2] > 3) * 1.0 + 0.1, (rows[:, 2] <= 3) * 1.0)
    df = spark.createDataFrame([tuple(map(int, r)) for r in rows], ", ".join(f"{f} int" for f in pii.FEATURES))
    got = df.select(model.margin(F.struct(*pii.FEATURES)).alias("m")).collect()
    assert np.allclose([r.m for r in got], model.margins(rows))


def test_base_spans_do_not_depend_on_other_digits(spark):
    """A phone number whose digits all stand apart, and a card with one separator each, alone and beside other digits."""
    texts = ["+1    2    3    4    5    6    7    8    9", "+1    2    3    4    5    6    7    8    9 and 12", "+1(((2)))3...4---5   6   7   8   9", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "1.2.3.4"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in docs.select("text", pii.base_spans(F.col("text")).alias("spans")).collect():
        assert [(s.start, s.kind, s.end) for s in r.spans] == brute(r.text)
