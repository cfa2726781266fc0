import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from sigframe.llm import trie


def brute(rows):
    turns = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            tie = hashlib.md5(f"{len(r.encode())}:{r}{x}".encode()).hexdigest()
            turns[c].append((t is not None, t or 0, tie, r, x))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + v[h:]
    members = defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    out = []
    for node, own_members in members.items():
        below = [n for n in members if n[:len(node)] == node]
        kids = lambda n: sum(len(m) == len(n) + 1 and m[:len(n)] == n for m in below)
        ends = sorted(c for c in own_members if len(built[c]) == len(node))
        out.append((min(own_members), len(node), min(members[node[:-1]]) if node else None, len(own_members), kids(node), sum(not kids(n) for n in below),
                    sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def conversations():
    rng = random.Random(5)
    say = lambda: rng.choice(["hi", "hello é", "", None, "what is this", "x" * 50])
    rows = []
    for c in [*range(0, 60), 1000, 1003, 2**40, 2**40 + 1, -5, -3]:
        for t in range(rng.choice([0, 1, 2, 3, 9, 14])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), say()))
    rows += [(c, t, "user", "the same") for c in range(100, 130) for t in range(12)]  # copies
    rows += [(200, t // 2, "user", f"tie {t % 3}") for t in range(10)] + [(200, None, "system", "first"), (201, None, None, None)]
    rows += [(300, t, "user", f"t{t}") for t in range(40)] + [(301, t, "user", f"t{t}") for t in range(40)]
    rows += [(None, 1, "user", "no conversation"), rows[3], rows[3]]
    return rows


@pytest.mark.parametrize("limit,segment", [(None, 4096), (25, 7), (1, 4096)])
def test_against_brute_force(spark, monkeypatch, limit, segment):
    """One shard a first turn, small shards below upper nodes, and every shared node an upper one; conversations cut in segments."""
    monkeypatch.setattr(trie, "SEGMENT", segment)
    monkeypatch.setattr(trie, "CHUNK", 16)
    rows = conversations()
    table = spark.createDataFrame([(*r, 1, "d") for r in rows], "conv_id long, turn long, role string, text string, depth int, digest string").repartition(7)
    got = trie.prefix_trie(table, limit=limit).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_no_rows_give_no_nodes(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.prefix_trie(empty).count() == 0


def test_messages_spill_and_come_in_order():
    rng = random.Random(2)
    for held in (1, 5, 10_000):
        queue, sent, got = trie.Messages(held), defaultdict(list), defaultdict(list)
        places = sorted({(rng.randint(-30, 0), rng.randint(0, 40), 0) for _ in range(300)})
        for i, place in enumerate(places):
            got[place] = sorted(queue.take(place))
            for _ in range(rng.randint(0, 4)):
                later = places[i + 1:]
                if later:
                    to = rng.choice(later)
                    values = (rng.randint(0, 9), rng.randint(0, 9))
                    queue.send(to, values)
                    sent[to].append(values)
        assert {p: v for p, v in got.items() if v} == {p: sorted(v) for p, v in sent.items()}
        assert not queue.heap and not queue.runs
