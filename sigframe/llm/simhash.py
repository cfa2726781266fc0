"""SimHash near-duplicates by multi-index hashing.

1. A text's fingerprint has 64 bits: bit i is set if it is set in over half of the XXH64 hashes of the text's word shingles. Texts
   with one fingerprint are one node from here on.
2. A fingerprint is cut into two segments of 32 bits. Of two fingerprints that differ in two bits or fewer, the upper segments differ
   in one bit at most, or the lower ones are equal. So every fingerprint is a member of the table entries of its two segments,
   and looks up the ball of radius one around its upper segment. Two upper segments that differ in one bit differ by a bit that
   only one of them has set: only flips from 0 to 1 are looked up, 16 of 32 on average.
3. An entry that more than BLOCK rows meet in is indexed once more by the other segment's halves of 16 bits, members with a ball of
   radius one around the upper half, lookups (which have spent one bit) with equal halves. What is still larger is met in blocks.
4. Complete distances are taken inside the task that holds an entry. Only a forest of its links leaves the task, so a group of
   near copies gives as many rows as it has fingerprints. Components of these links are the result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from sigframe.llm.arrays import slices
from sigframe.llm.common import in_batches, whole
from sigframe.llm.dedup import components
from sigframe.session import written

SEED = 42
NEAR = 2
#: Fingerprints of a table entry that are compared in one task.
BLOCK = 2048
#: Bytes of a text that are cut into words at a time.
PIECE = 1 << 20
SPACE = re.compile(rb"[\x20\x09-\x0d]")


def _pieces(data: bytes, words: int) -> Iterator[list[bytes]]:
    """The words of a text, PIECE bytes at a time; each piece begins with the last words - 1 of those before it."""
    at, held = 0, []
    while at < len(data):
        to = at + PIECE
        if to < len(data):
            gap = SPACE.search(data, to)
            to = gap.start() if gap else len(data)
        held += data[at:to].split()
        yield held
        held, at = held[max(0, len(held) - words + 1):], to


def _hashes(held: list[bytes], words: int) -> np.ndarray:
    lengths = np.fromiter(map(len, held), np.int64, len(held))
    ends = np.cumsum(lengths + 1) - 1
    line = memoryview(b" ".join(held))
    spans = zip((ends - lengths)[:len(held) - words + 1].tolist(), ends[words - 1:].tolist())
    return np.array([xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in spans], np.uint64)


def fingerprint(text: str, words: int = 3) -> int:
    """The fingerprint of one text, unsigned; 0 without words. Fewer words than a shingle are one shingle."""
    ones, total, held = np.zeros(64, np.int64), 0, []
    for held in _pieces(text.encode("utf-8", "surrogatepass").lower(), words):
        if len(held) >= words:
            h = _hashes(held, words)
            ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
            total += len(h)
    if not total and held:
        return xxhash.xxh64_intdigest(b" ".join(held), SEED)
    return int(np.packbits(2 * ones > total).view(">u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed number."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = np.array([fingerprint(t, words) for t in part["text"].to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return in_batches(rows, each, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp bigint")


def forest(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (parent, child) of a spanning forest of the links between the fingerprints ``x``: one link fewer than members in each part."""
    parents, children, left, front = [], [], np.arange(len(x)), np.zeros(0, np.int64)
    while len(left):
        if not len(front):
            front, left = left[:1], left[1:]
        now, front = front[:64], front[64:]
        near = np.bitwise_count(x[now][:, None] ^ x[left][None, :]) <= NEAR
        hit = near.any(axis=0)
        parents.append(now[near.argmax(axis=0)[hit]])
        children.append(left[hit])
        front, left = np.concatenate([front, left[hit]]), left[~hit]
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *parents]), np.concatenate([empty, *children])


def _links(entries: DataFrame) -> DataFrame:
    """Forests (a, b) of the entries' arrays ``x`` of fingerprints."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["x"].cast(pa.large_list(pa.int64()))
            ends, flat = np.asarray(lists.offsets), np.asarray(lists.values)
            a, b = [], []
            for i, j in zip(ends, ends[1:]):
                x = flat[i:j]
                parent, child = forest(x.view(np.uint64))
                a.append(x[parent])
                b.append(x[child])
            empty = np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([empty, *a])), pa.array(np.concatenate([empty, *b]))], ["a", "b"])

    return in_batches(entries.select("x"), each, "a bigint, b bigint")


# key of the entry, whether the row is a member; an entry of the lower segment has bit 32 set
FIRST = """inline(concat(
  array(struct(shiftrightunsigned(fp, 32) AS key, true AS member), struct((fp & 4294967295L) | 4294967296L AS key, true AS member)),
  transform(filter(sequence(0, 31), i -> (shiftrightunsigned(fp, 32 + i) & 1L) = 0),
            i -> struct(shiftrightunsigned(fp, 32) | shiftleft(1L, i) AS key, false AS member))))"""
# the same with the halves of the segment that the key does not hold; a lookup has spent one bit, so its halves are equal or nothing
SECOND = """inline(concat(
  array(struct(shiftright(rest, 16) AS sub, member), struct((rest & 65535L) | 65536L AS sub, member)),
  transform(filter(sequence(0, 15), i -> member AND (shiftright(rest, 16 + i) & 1L) = 0),
            i -> struct(shiftright(rest, 16) | shiftleft(1L, i) AS sub, false AS member))))"""


def _met(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of entries that have a member and another row, with the number of rows ``met``."""
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("met"), F.bool_or("member").alias("some"))
    return rows.join(sizes.where("met > 1 AND some").drop("some"), keys)


def links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``fp`` of ``nodes`` that differ in NEAR bits or fewer: enough of them
    that components are those of all such links."""
    looked = nodes.select("fp", F.expr(FIRST))
    members = looked.where("member")
    # a lookup that no entry answers goes before anything is counted
    hits = looked.where("NOT member").join(members.select("key").distinct(), "key", "left_semi")
    rows = written(_met(members.unionByName(hits), ["key"]), "met")
    small = rows.where(F.col("met") <= BLOCK).groupBy("key").agg(F.collect_list("fp").alias("x"))
    other = F.expr("CASE WHEN key < 4294967296L THEN fp & 4294967295L ELSE shiftrightunsigned(fp, 32) END")
    large = rows.where(F.col("met") > BLOCK).select("fp", "key", other.alias("rest"), "member")
    large = _met(large.select("fp", "key", F.expr(SECOND)), ["key", "sub"])
    dealt = large.withColumn("blocks", F.ceil(F.col("met") / BLOCK).cast("int"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("fp", "sub"), F.col("blocks")).cast("int"))
    packed = dealt.groupBy("key", "sub", "block").agg(F.first("blocks").alias("blocks"), F.collect_list("fp").alias("x"))
    packed = written(packed, "blocks")
    left = packed.select("key", "sub", F.explode(F.sequence("block", F.col("blocks") - 1)).alias("block"), F.col("block").alias("first"), F.col("x").alias("y"))
    pairs = left.join(packed.select("key", "sub", "block", "x"), ["key", "sub", "block"])
    pairs = pairs.select(F.when(F.col("block") == F.col("first"), F.col("x")).otherwise(F.concat("x", "y")).alias("x"))
    return _links(small.select("x").unionAll(pairs))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id (the least doc_id reachable over links, itself included) of every row.

    Texts whose fingerprints differ in NEAR bits or fewer are linked, those without words (fingerprint zero) too. Only A-Z are
    lower-cased. NULL text is empty. Repeated rows and ids are rows of their own; NULL ids count only where a component has no
    other. An empty table gives an empty result.
    """
    rows = written(fingerprints(docs, doc_id, text, words), "rows")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    names = components(links(nodes))
    placed = nodes.join(names, F.col("fp") == F.col("key"), "left").select("fp", "least", F.coalesce("comp", "fp").alias("comp"))
    least = placed.groupBy("comp").agg(F.min("least").alias("component_id"))
    of = placed.join(least, "comp").select("fp", "component_id")
    return rows.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
