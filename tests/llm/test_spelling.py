import random
import re
import zlib
from collections import Counter

import pytest

from sigframe.llm import spelling


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows):
    counts = Counter()
    for d, text in rows:
        for run in re.findall("[a-zÀ-ÿ]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % 199 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    form, links = {}, {}
    for w, n in words.items():
        others = [v for v in words if near(v, w)]
        links[w] = len(others)
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, links[w], words[form[w]] if form[w] else None))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdé") for _ in range(rng.randint(6, 11))) for _ in range(25)] + ["aaaaaaa", "aabbaabb", "ÀÀééÿÿ×÷", "z" * 70, "ab" * 40]
    rows = []
    for i in range(60):
        words = []
        for w in base:
            words += [w] * rng.choice([1, 3, 20])
            for _ in range(2):
                k = rng.randrange(len(w))
                words += [rng.choice([w[:k] + w[k + 1:], w[:k] + rng.choice("abcdé") + w[k + 1:], w[:k] + rng.choice("abcdé") + w[k:]])]
        rng.shuffle(words)
        rows.append((i * 37, rng.choice([" ", ", ", "1"]).join(x.upper() if rng.random() < 0.2 and x.isascii() else x for x in words)))
    # chains of forms, words at the border of long ones, and a run of the same letter
    for word, n in (("chained", 3000), ("chainedx", 500), ("chainedxy", 90), ("chainedxyz", 10), ("z" * 64, 9), ("z" * 65, 9), ("z" * 66, 60), ("y" * 64 + "a", 9), ("y" * 64 + "b", 50), ("q" * 3000 + "a", 6), ("q" * 3000 + "b", 40)):
        rows += [(9000 + len(word), " ".join([word] * n))]
    return rows + [(None, "chained " * 7), (None, None), (5, ""), (6, "short ab 12"), rows[0], rows[0]]


@pytest.mark.parametrize("longest", [64, 8])
def test_against_brute_force(spark, monkeypatch, longest):
    """Also with long words from nine letters on, so that both ways of pairing meet at every length."""
    monkeypatch.setattr(spelling, "LONGEST", longest)
    monkeypatch.setattr(spelling.near_words, "__defaults__", (longest,))
    rows = corpus()
    docs = spark.createDataFrame([(*r, "w", 3) for r in rows], "doc_id long, text string, word string, n int").repartition(6)
    got = spelling.variants(docs).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)
    assert spelling.variants(docs.limit(0)).count() == 0


def test_pairs_come_once(spark):
    words = ["letter", "leter", "lettr", "lettter", "better", "petter", "lettes", "llettes", "aabaab", "aabaaab", "abaab", "abcdef", "abcdeg", "bbcdef"]
    table = spark.createDataFrame([(w,) for w in words], "word string")
    want = sorted((a, b) for a in words for b in words if near(a, b))
    for longest in (64, 6, 2):
        assert sorted((r.word, r.near) for r in spelling.near_words(table, longest).collect()) == want
