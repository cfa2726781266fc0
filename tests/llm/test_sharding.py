import zlib
from collections import Counter

import pytest

from sigframe.llm import sharding
from sigframe.llm.sharding import Leaf


def frame(spark, n=4000):
    rows = [(i, f"text {i % 50}") for i in range(n)] + [(None, None), (None, "é"), (7, "text 7"), (-1, ""), (-2, "x" * 200_000)]
    return spark.createDataFrame([(a, b, "q", 1) for a, b in rows], "doc_id long, text string, shard string, slot int"), rows


def test_law_slots_and_sizes(spark):
    docs, rows = frame(spark)
    got = sharding.shard_rows(docs, 8).collect()
    assert len(got) == len(rows)
    texts = Counter((a, len((b or "").encode()) + 1, zlib.crc32((b or "").encode())) for a, b in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == texts
    assert {r.law for r in got} == {"key"} and {r.shard for r in got} == set(range(8))
    assert all(r.grown_shard in (r.shard, 8) for r in got)
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots))) and 350 < len(slots) < 660
    assert 300 < sum(r.grown_shard == 8 for r in got) < 600
    by_id = {}
    for r in got:
        assert by_id.setdefault(r.doc_id, r.shard) == r.shard
    assert sharding.shard_rows(docs.limit(0), 8).count() == 0


def test_movement_stays_in_changed_subtrees(spark):
    docs, _ = frame(spark)
    before = sharding.tree(8)
    after = [Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 5 else 1.0) for x in before]
    got = sharding.shard_rows(docs, leaves=before, grown=after).collect()
    region, rack = {x.shard: x.region for x in before}, {x.shard: x.rack for x in before}
    moved = [(r.shard, r.grown_shard) for r in got if r.shard != r.grown_shard]
    assert moved
    for a, b in moved:  # into the region that grew, or within it into the rack that grew, or there into the shard
        assert region[b] == region[5] and (region[a] != region[b] or rack[b] == rack[5] and (rack[a] != rack[b] or b == 5))
    share = sum(r.grown_shard == 5 for r in got) / len(got)
    assert 0.25 < share < 0.35  # 3 of 10


def test_trees_are_checked(spark):
    docs, _ = frame(spark, 10)
    with pytest.raises(ValueError, match="above 0"):
        sharding.shard_rows(docs, leaves=[Leaf("a", "b", 0, 0.0)])
    with pytest.raises(ValueError, match="once"):
        sharding.shard_rows(docs, leaves=[Leaf("a", "b", 0), Leaf("a", "c", 0)])
