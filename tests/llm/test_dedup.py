import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sigframe.llm import dedup


def shingles(text, n=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


def brute(rows, percent, n=5):
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[root(i)] = min(d, ids.get(root(i), d))
    return sorted(((d is None, d), len(s), (ids.get(root(i)) is None, ids.get(root(i)))) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def corpus():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    base = [[word() for _ in range(rng.randint(30, 200))] for _ in range(25)]
    rows = []
    for words in base:
        for _ in range(rng.randint(1, 12)):
            w = list(words)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = word()
            rows.append(" ".join(w))
    chain = [word() for _ in range(150)]  # each is near the next, not near those further on
    for i in range(12):
        chain = chain[3:] + [word() for _ in range(3)]
        rows.append(" ".join(chain))
    passage = " ".join(word() for _ in range(60))
    rows += [passage + " " + " ".join(word() for _ in range(60)) for _ in range(25)]
    rows += [rows[0]] * 30 + [rows[1].upper()] * 3 + [None, "", "  \n", "one", "One", "one two", "é É", "É é", "x " * 9, " ".join(word() for _ in range(30_000))]
    rng.shuffle(rows)
    numbered = [(i * 3 % 1009, t) for i, t in enumerate(rows)]
    return numbered + [(None, rows[5]), (None, None), (None, "lonely text of its own that nobody repeats"), numbered[4], numbered[4]]


def test_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(a, b, b"k", 1) for a, b in rows], "doc_id long, text string, key binary, n int").repartition(6)
    for percent in (80, 85):
        got = dedup.near_duplicates(docs, percent).collect()
        found = sorted(((r.doc_id is None, r.doc_id), r.n_shingles, (r.component_id is None, r.component_id)) for r in got)
        assert found == brute(rows, percent)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    sent, dedup.SENT_KEYS = dedup.SENT_KEYS, 0
    try:
        joined = dedup.near_duplicates(docs, 85).collect()
    finally:
        dedup.SENT_KEYS = sent
    assert sorted(map(str, joined)) == sorted(map(str, got))
    assert dedup.near_duplicates(docs.limit(0)).count() == 0


def test_one_of_each_keeps_all_columns_and_one_row(spark):
    rows = corpus()
    docs = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(rows)], "doc_id long, text string, component int").repartition(6)
    got = dedup.one_of_each(docs, 80).collect()
    want = brute([r for r in rows if shingles(r[1])], 80)
    lone = sum(not shingles(t) for _, t in rows)
    groups = {(w[2], w[1]) if w[2][0] else w[2] for w in want}
    assert len(got) == len(groups) + lone and got[0].asDict().keys() == {"doc_id", "text", "component"}


def test_posterior_bounds():
    steps = dedup.least_matches(0.85)
    assert [n for n, _ in steps] == list(range(dedup.BATCH, dedup.HASHES + 1, dedup.BATCH))
    assert all(0.2 * n < m < 0.8 * n for n, m in steps)
    rng = np.random.default_rng(0)
    for n, m in steps:  # pairs at the threshold pass
        assert (rng.binomial(n, 0.85, 20_000) < m).sum() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    one = rng.integers(0, 2**63, 400).astype(np.uint64)
    two = np.concatenate([one[:320], rng.integers(0, 2**63, 80).astype(np.uint64)])
    sig = dedup.signatures(np.concatenate([one, two]), np.array([0, 400, 800]))
    assert abs((sig[0] == sig[1]).mean() - 320 / 480) < 0.06


def test_members_of_a_block_meet_in_any_order(spark):
    """All pairs of 30 unlinked members whose signatures agree, from blocks that each side of the join collects for itself."""
    rows = [(bucket, 0, bytes([bucket, i]) * 8, 100, bytes([bucket, i]), bytes(dedup.HASHES)) for bucket in range(20) for i in range(30)]
    random.Random(2).shuffle(rows)
    members = spark.createDataFrame(rows, "bucket long, band int, key binary, n long, comp binary, sig binary").repartition(8)
    want = {frozenset((bytes([bucket, i]) * 8, bytes([bucket, j]) * 8)) for bucket in range(20) for i in range(30) for j in range(i)}
    got = dedup.likely_across(members, 0.85, 85).collect()
    assert len(got) == len(want) and {frozenset((bytes(r.a), bytes(r.b))) for r in got} == want

    member = lambda i: {"key": bytes([i]) * 16, "n": 100, "comp": bytes([i]), "sig": bytes(dedup.HASHES)}
    x = [member(i) for i in range(3)]
    batch = pa.RecordBatch.from_pylist([{"bucket": 1, "block": 0, "band": 0, "first": 0, "x": x, "y": y} for y in (x, x[::-1], [x[1], x[2], x[0]])])
    for i in range(3):
        out = pa.Table.from_batches(dedup.across([batch.slice(i, 1)], dedup.least_matches(0.85), 85, dedup.banding(0.85))).to_pylist()
        assert {frozenset(r.values()) for r in out} == {frozenset((p["key"], q["key"])) for p in x for q in x if p != q} and len(out) == 3


def test_pairs_at_any_threshold_share_a_band(spark):
    assert dedup.banding(0.85) == (10, 64) and dedup.banding(0.8) == (8, 80)
    for percent in (50, 70, 80, 85, 90, 95, 100):
        rows, bands = dedup.banding(percent / 100)
        assert rows * bands <= dedup.HASHES and (1 - (percent / 100) ** rows) ** bands <= 1e-6
    with pytest.raises(ValueError):
        dedup.banding(0.01)


def test_pair_that_shares_short_bands_only(spark, monkeypatch):
    """Signatures that differ in every tenth value agree in no band of 10 rows, but in bands of 8."""
    one, two = np.zeros((2, dedup.HASHES), np.uint8)
    two[9::10] = 1
    given = [one.tobytes(), two.tobytes()]
    words = [f"w{i}" for i in range(120)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words + ["more"]))], "doc_id long, text string").coalesce(1)
    real = dedup.described

    def planted(*args):
        sig = F.when(F.col("doc_id") == 1, F.lit(bytearray(given[0]))).otherwise(F.lit(bytearray(given[1])))
        return real(*args).withColumn("sig", sig)

    monkeypatch.setattr(dedup, "described", planted)
    assert {r.component_id for r in dedup.near_duplicates(docs, 80).collect()} == {1}


def test_all_batches_prune_pairs_at_the_threshold_rarely():
    assert dedup.MISS * len(dedup.least_matches(0.8)) <= 1.0001e-8


def near_group(n, words, changed, seed=5):
    """Copies of one text with so many words changed: near each other, most of them not linked."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(words)]
    rows = []
    for i in range(n):
        w = list(base)
        for at in rng.sample(range(words), changed):
            w[at] = f"x{i}_{at}"
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("percent,changed", [(80, 2), (85, 1)])
def test_group_that_is_near_and_not_linked(spark, monkeypatch, percent, changed):
    """Links equal brute force, in one block, in several, and with small sets a block; the pairs stay in the tasks."""
    rows = near_group(90, 120, changed)
    want = brute(rows, percent)
    joined = []
    real = dedup.verified

    def counted(pairs, *args):
        joined.append(pairs.count())
        return real(pairs, *args)

    monkeypatch.setattr(dedup, "verified", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for block, shingles_ in ((128, 1 << 16), (20, 1 << 11)):
        monkeypatch.setattr(dedup, "BLOCK", block)
        monkeypatch.setattr(dedup, "BLOCK_SHINGLES", shingles_)
        got = dedup.near_duplicates(docs, percent).collect()
        assert sorted(((False, r.doc_id), r.n_shingles, (False, r.component_id)) for r in got) == want
    assert max(joined[1::2]) <= 80 * 90


def test_dense_buckets_give_forests(spark):
    """A bucket whose members are all linked and in different components gives one link fewer than members, in blocks a few more."""
    n = 40
    sig = bytes(dedup.HASHES)
    members = spark.createDataFrame([(7, 0, bytes([i]) * 16, 10, bytes([i]), sig) for i in range(n)], "bucket long, band int, key binary, n long, comp binary, sig binary")
    sets = spark.createDataFrame([(bytes([i]) * 16, list(range(9)) + [100 + i]) for i in range(n)], "key binary, shingles array<bigint>")
    links = dedup.dense_links(members, sets, 0.8, 80).collect()
    assert len(links) == n - 1 and len({bytes(k) for r in links for k in (r.a, r.b)}) == n
    setting = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    apart = spark.createDataFrame([(bytes([i]) * 16, list(range(10 * i, 10 * i + 10))) for i in range(n)], "key binary, shingles array<bigint>")
    assert dedup.dense_links(members, apart, 0.8, 80).count() == 0
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == setting


def test_rows_whose_hashes_of_id_and_text_meet_stay(spark, monkeypatch):
    """Rows are removed by id and text hash: with equal text hashes only the id tells them apart."""
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "one two three four five six"), (None, "lone words of a row that has no id"), (5, "")],
                                 "doc_id long, text string")
    docs = docs.withColumn("_id", F.lit("kept")).withColumn("row", F.lit(1)).withColumn("hash", F.lit(2)).withColumn("i", F.lit(3))
    monkeypatch.setattr(dedup, "_text_hash", lambda text: F.lit(0).cast("long"))
    got = dedup.one_of_each(docs, 80).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == [(False, 1), (False, 3), (False, 5), (True, 0)]
    assert all(r["_id"] == "kept" and r["row"] == 1 and r["hash"] == 2 and r["i"] == 3 for r in got)
