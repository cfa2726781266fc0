import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sigframe.llm import simhash


def brute_fingerprint(text, n=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [least.get(root(i)) for i in range(len(ids))]


def texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6)))
    out = [None, "", " \n\t", "one", "One", "one two", "ONE two", "É é", "é É", "a\x0bb\x0cc d", "x " * 7, "lone word here"]
    for _ in range(12):
        words = [word() for _ in range(rng.randint(40, 300))]
        out.append(" ".join(words))
        for _ in range(8):
            w = list(words)
            w[rng.randrange(len(w))] = word()
            out.append("\n".join(w))
    return out + out[14:20]


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PIECE", 200)  # texts are cut in pieces as long ones are
    rows = [(7 * i % 1009, t) for i, t in enumerate(texts())] + [(None, texts()[15]), (None, "a text that has no id and no partner at all")]
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, fp int, key string").repartition(5)
    prints = [brute_fingerprint(t) for _, t in rows]
    want = sorted(zip([(d is None, d or 0) for d, _ in rows], [f"{p:016x}" for p in prints], map(str, brute_components([d for d, _ in rows], prints))))
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(docs).collect())
    assert got == want and len({c for _, _, c in want}) < len(want) - 20
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_pieces_give_the_fingerprint_of_the_whole(monkeypatch):
    rng = random.Random(1)
    for n in (1, 2, 3, 4, 50):
        text = "  ".join("w" * rng.randint(1, 40) for _ in range(n)) + " "
        for piece in (1, 7, 30, 1 << 20):
            monkeypatch.setattr(simhash, "PIECE", piece)
            assert simhash.fingerprint(text) == brute_fingerprint(text)


@pytest.mark.parametrize("block", [2048, 6])
def test_links_of_planted_fingerprints(spark, monkeypatch, block):
    """Balls around a few fingerprints: pairs at 0 to 4 bits, in all segments; small blocks take large entries through their second index."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(block)
    made = set()
    for _ in range(6):
        middle = rng.getrandbits(64)
        for _ in range(25):
            made.add(middle ^ sum(1 << b for b in rng.sample(range(64), rng.choice([0, 1, 2, 3, 4]))))
        upper = rng.getrandbits(32) << 32  # one entry of the table with many members
        made |= {upper | (rng.getrandbits(10) << 20) for _ in range(12)}
    made |= {rng.getrandbits(64) for _ in range(60)}
    made = sorted(made)
    nodes = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in made], "fp long").repartition(4)
    got = {frozenset((r.a % 2**64, r.b % 2**64)) for r in simhash.links(nodes).collect()}
    assert all(len(p) == 2 and (min(p) ^ max(p)).bit_count() <= 2 for p in got)
    names = {v: i for i, v in enumerate(made)}
    comp = list(range(len(made)))
    for p in got:
        a, b = (comp[names[v]] for v in p)
        comp = [a if c == b else c for c in comp]
    want = brute_components(list(range(len(made))), made)
    assert len(set(zip(comp, want))) == len(set(comp)) == len(set(want))


def test_a_forest_has_one_link_fewer_than_members():
    x = np.arange(64, dtype=np.uint64)  # every two are connected by single bits
    parent, child = simhash.forest(x)
    assert len(parent) == 63 and len(set(child.tolist())) == 63
    assert all(int(x[a] ^ x[b]).bit_count() <= 2 for a, b in zip(parent, child))
    assert len(simhash.forest(np.array([0, 2**64 - 1], np.uint64))[0]) == len(simhash.forest(np.zeros(0, np.uint64))[0]) == 0


def test_hash_is_that_of_spark(spark):
    row = spark.createDataFrame([("a bc é",)], "t string").select(F.xxhash64("t").alias("h")).first()
    assert row.h % 2**64 == xxhash.xxh64_intdigest("a bc é".encode(), 42)
