"""Near-duplicate documents by MinHash with sequential Bayesian verification.

1. A document becomes a set of word shingles and a signature of minima; equal sets are one node from here on.
2. Bands of the signature propose candidates. A bucket's members are compared with its first member; then those of its members that
   are still in different components are compared with each other. Pairs within a component are never compared.
3. Signatures of a pair are compared batch by batch. After each batch the pair goes if the posterior probability that its
   similarity reaches the threshold is below MISS.
4. Survivors are verified on their full sets, and components of verified links are made. A bucket with more survivors than members
   sends its members' sets to the tasks in blocks instead of its pairs; there pairs that links found so far connect are
   skipped, and only a forest of verified links comes out, so a group that is near without being linked gives no pairs.

Of two sets at the threshold itself a band agrees with probability threshold ** rows. ``banding`` takes as many rows a band as leave
the probability that none of the bands agrees at BAND_MISS or less: 10 rows at 0.85, 8 at 0.8.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from sigframe.llm.arrays import Grown, mix, ngrams, ragged, slices
from sigframe.llm.common import in_batches, whole, written_in_batches
from sigframe.session import written

HASHES = 640
BATCH = 64
#: Highest probability that two sets at the threshold share no band.
BAND_MISS = 1e-6
MISS = 1e-9
#: Members of a bucket that are compared with as many others at a time.
BLOCK = 128
#: Shingles of the members of a block whose sets are verified in a task; a larger set is a block of its own.
BLOCK_SHINGLES = 1 << 16
#: Node keys that are sent to every task to fetch their texts (16 bytes each); more are joined by shuffle.
SENT_KEYS = 500_000
REMEMBERED = 100_000


def banding(threshold: float) -> tuple[int, int]:
    """(rows, bands) of signatures: the most rows a band with which two sets at the threshold share none with BAND_MISS at most."""
    for rows in range(HASHES, 0, -1):
        if (1 - threshold ** rows) ** (HASHES // rows) <= BAND_MISS:
            return rows, HASHES // rows
    raise ValueError(f"{HASHES} hash functions are too few for a threshold of {threshold}")


def _constants() -> tuple[np.ndarray, np.ndarray]:
    draws = mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64), 2026)
    draws = mix(draws, 10)
    return (draws[:HASHES] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (draws[HASHES:] >> np.uint64(32)).astype(np.uint32)


class Shingler:
    """Sets of word shingles of texts; word hashes are remembered in a worker."""

    def __init__(self, words: int = 5):
        self.n, self.known, self.hashes = words, {}, Grown(np.zeros(0, np.uint64))

    def sets(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(64-bit shingle hashes, offsets): each text's distinct shingles in order. A text with fewer words than a shingle
        is one shingle, one without words none. Only A-Z are lower-cased."""
        if len(self.known) > REMEMBERED:
            self.known, self.hashes = {}, Grown(np.zeros(0, np.uint64))
        cut = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
        new = list(dict.fromkeys(w for ws in cut for w in ws if w not in self.known))
        if new:
            self.known.update(zip(new, range(self.hashes.n, self.hashes.n + len(new))))
            self.hashes.add(np.array([xxhash.xxh3_64_intdigest(w) for w in new], np.uint64))
        counts = np.array([len(ws) for ws in cut], np.int64)
        words = self.hashes[np.fromiter((self.known[w] for ws in cut for w in ws), np.int64, counts.sum())]
        ends = np.concatenate([[0], np.cumsum(counts)])
        grams, at = ngrams(words, ends, self.n)
        owner = np.repeat(np.arange(len(texts)), np.diff(at))
        short = np.flatnonzero((counts > 0) & (counts < self.n))
        whole_text = [xxhash.xxh3_64_intdigest(b" ".join(cut[i]), seed=int(counts[i])) for i in short]
        grams, owner = np.concatenate([grams, np.array(whole_text, np.uint64)]), np.concatenate([owner, short])
        order = np.lexsort((grams, owner))
        grams, owner = grams[order], owner[order]
        first = np.ones(len(grams), bool)
        first[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
        return grams[first], np.concatenate([[0], np.cumsum(np.bincount(owner[first], minlength=len(texts)))]).astype(np.int64)


def signatures(grams: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Low bytes of the minima of HASHES hash functions, for sets that are not empty; zeros for empty ones."""
    out = np.zeros((len(ends) - 1, HASHES), np.uint8)
    some = np.flatnonzero(np.diff(ends))
    if len(some):
        by, off = _constants()
        x = (grams >> np.uint64(32)).astype(np.uint32)
        with np.errstate(over="ignore"):
            for i in range(HASHES):
                out[some, i] = np.minimum.reduceat((x ^ off[i]) * by[i], ends[:-1][some]) & np.uint32(255)
    return out


_shinglers: dict[int, Shingler] = {}


def _text_hash(text: str) -> Column:
    return F.xxhash64(whole(text))


def _key(grams: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else None


def described(docs: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, key (128-bit digest of the set, NULL if empty) and sig of every row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), _text_hash(text).alias("text_hash"), whole(text).alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = _shinglers.setdefault(words, Shingler(words))
        for batch in batches:
            for part in slices(batch):
                grams, ends = shingler.sets(part["text"].to_pylist())
                sig = signatures(grams, ends)
                keys = [_key(grams[a:b]) for a, b in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["text_hash"], pa.array(np.diff(ends)), pa.array(keys, pa.binary()), pa.array([s.tobytes() for s in sig], pa.binary())],
                    ["doc_id", "text_hash", "n_shingles", "key", "sig"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return in_batches(rows, each, f"doc_id {kind}, text_hash bigint, n_shingles bigint, key binary, sig binary")


def full_sets(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """(key, shingles) of the nodes in ``wanted`` (key, rep): their representatives' texts are read again."""
    rows = docs.select(F.struct(F.col(doc_id).alias("doc_id"), _text_hash(text).alias("text_hash")).alias("rep"), whole(text).alias("text"))
    few = wanted.count() <= SENT_KEYS
    ids = wanted.select(F.xxhash64("rep").alias("id"))
    rows = rows.withColumn("id", F.xxhash64("rep")).join(F.broadcast(ids) if few else ids, "id", "left_semi")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = _shinglers.setdefault(words, Shingler(words))
        for batch in batches:
            for part in slices(batch):
                grams, ends = shingler.sets(part["text"].to_pylist())
                keys = [_key(grams[a:b]) for a, b in zip(ends, ends[1:])]
                sets = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(grams.view(np.int64))).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), sets], ["key", "shingles"])

    return in_batches(rows.select("text"), each, "key binary, shingles array<bigint>").dropDuplicates(["key"])


def least_matches(threshold: float, miss: float = MISS) -> list[tuple[int, int]]:
    """(values compared, matches needed to go on) after each batch: with fewer, the posterior probability that the chance
    of a match reaches that of a pair at the threshold is below ``miss``, the prior being uniform.

    The posterior after m of n is a beta distribution, whose upper tail at t is P(Binomial(n + 1, t) <= m). Values are
    single bytes, which agree by chance once in 256.
    """
    t = threshold + (1 - threshold) / 256
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(t) + (n + 1 - m) * math.log(1 - t))
        out.append((n, m))
    return out


def passing(one: np.ndarray, two: np.ndarray, a: np.ndarray, b: np.ndarray, steps: list[tuple[int, int]]) -> np.ndarray:
    """Which of the pairs (one[a], two[b]) no batch rules out; a pair that is ruled out is not looked at again."""
    left, seen, at = np.arange(len(a)), np.zeros(len(a), np.int64), 0
    for to, least in steps:
        seen = seen + (one[a[left], at:to] == two[b[left], at:to]).sum(axis=1)
        go = seen >= least
        left, seen, at = left[go], seen[go], to
    return left


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, HASHES)


def likely(pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b, sig_a, sig_b) that no batch rules out."""
    steps = least_matches(threshold)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = np.arange(batch.num_rows)
            left = pa.array(passing(_matrix(batch["sig_a"]), _matrix(batch["sig_b"]), same, same, steps))
            yield pa.RecordBatch.from_arrays([batch["a"].take(left), batch["b"].take(left)], ["a", "b"])

    return in_batches(pairs, each, "a binary, b binary")


def _survivors(batch: pa.RecordBatch, i: int, steps: list[tuple[int, int]], percent: int, banded: tuple[int, int]) -> tuple[pa.StructArray, pa.StructArray, np.ndarray, np.ndarray]:
    """The two blocks x and y of row i, and the places (a in x, b in y) of pairs of different components that pass ``steps`` and
    first agree in the row's band."""
    height, bands = banded
    same = batch["first"][i].as_py() == batch["block"][i].as_py()
    x = batch["x"][i].values
    y = x if same else batch["y"][i].values  # a block met by itself comes in two orders
    n_x, n_y = (v.field("n").to_numpy() for v in (x, y))
    comps = {c: j for j, c in enumerate(dict.fromkeys(x.field("comp").to_pylist() + y.field("comp").to_pylist()))}
    c_x, c_y = (np.array([comps[c] for c in v.field("comp").to_pylist()]) for v in (x, y))
    fits = (c_x[:, None] != c_y[None, :]) & (100 * np.minimum.outer(n_x, n_y) >= percent * np.maximum.outer(n_x, n_y))
    a, b = np.nonzero(np.triu(fits, 1) if same else fits)
    one, two = _matrix(x.field("sig")), _matrix(y.field("sig"))
    go = passing(one, two, a, b, steps)
    a, b = a[go], b[go]
    agree = (one[a] == two[b])[:, :bands * height].reshape(-1, bands, height).all(axis=2).argmax(axis=1) if len(a) else a
    here = agree == batch["band"][i].as_py()
    return x, y, a[here], b[here]


def across(batches: Iterator[pa.RecordBatch], steps: list[tuple[int, int]], percent: int, banded: tuple[int, int],
           dense: bool = False) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) of rows (band, first, block, x, y) of two blocks of members that pass ``steps`` and first agree in the band.

    With ``dense`` a row (bucket, with a and b NULL) stands for the pairs of a block that has more of them than members.
    """
    for batch in batches:
        for i in range(batch.num_rows):
            x, y, a, b = _survivors(batch, i, steps, percent, banded)
            if dense and len(a) > len(x):
                none = pa.array([None], pa.binary())
                yield pa.RecordBatch.from_arrays([none, none, pa.array([batch["bucket"][i].as_py()], pa.int64())], ["a", "b", "bucket"])
                continue
            pairs = {"a": x.field("key").take(pa.array(a)), "b": y.field("key").take(pa.array(b))}
            if dense:
                pairs["bucket"] = pa.nulls(len(a), pa.int64())
            yield pa.RecordBatch.from_arrays(list(pairs.values()), list(pairs))


def _block_forest(x: pa.StructArray, y: pa.StructArray, a: np.ndarray, b: np.ndarray, percent: int) -> list[tuple[bytes, bytes]]:
    """Verified links (a, b) among the pairs, less those between members that earlier ones, or their components, connect."""
    both = pa.concat_arrays([x, y])
    keys, lists = both.field("key"), both.field("shingles")
    ends = np.asarray(lists.offsets).astype(np.int64)
    flat = np.unique(np.asarray(lists.values)[ends[0]:ends[-1]], return_inverse=True)[1]
    starts, sizes = ends[:-1] - ends[0], np.diff(ends)
    comps = {c: j for j, c in enumerate(dict.fromkeys(both.field("comp").to_pylist()))}
    group = np.array([comps[c] for c in both.field("comp").to_pylist()])
    held, out = np.zeros(flat.max() + 1 if len(flat) else 1, bool), []
    b = b + len(x)
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    edges = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1], [True]]))
    for at, to in zip(edges, edges[1:]):
        one, others = a[at], b[at:to]
        others = others[group[others] != group[one]]
        if not len(others):
            continue
        mine = flat[starts[one]:starts[one] + sizes[one]]
        held[mine] = True
        theirs = np.add.reduceat(held[flat[ragged(starts[others], sizes[others])]], np.cumsum(sizes[others]) - sizes[others], dtype=np.int64)
        held[mine] = False
        for other in others[100 * theirs >= percent * (sizes[one] + sizes[others] - theirs)]:
            if group[other] != group[one]:
                group[group == group[other]] = group[one]
                out.append((keys[int(one)].as_py(), keys[int(other)].as_py()))
    return out


def dense_links(members: DataFrame, sets: DataFrame, threshold: float, percent: int) -> DataFrame:
    """Verified links (a, b) of the buckets' members (bucket, band, key, n, comp, sig), a forest for each two blocks.

    Blocks hold about BLOCK_SHINGLES shingles together and meet with their members' full sets, so pairs never leave a task.
    """
    steps, banded = least_matches(threshold), banding(threshold)
    counts = members.groupBy("bucket").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    dealt = members.join(counts, "bucket").withColumn("block", F.pmod(F.xxhash64("key", "bucket"), F.col("blocks")).cast("int")).join(sets, "key")
    packed = written(dealt.groupBy("bucket", "block").agg(
        F.first("band").alias("band"), F.first("blocks").alias("blocks"), F.collect_list(F.struct("key", "n", "comp", "sig", "shingles")).alias("x")), "blocks")
    left = packed.select("bucket", "band", F.col("block").alias("first"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("block"), "x")
    met = left.join(packed.select("bucket", "block", F.col("x").alias("y")), ["bucket", "block"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, y, a, b = _survivors(batch, i, steps, percent, banded)
                found = _block_forest(x, y, a, b, percent) if len(a) else []
                yield pa.RecordBatch.from_arrays([pa.array([p[j] for p in found], pa.binary()) for j in (0, 1)], ["a", "b"])

    return written_in_batches(met, each, "a binary, b binary", rows=16)


def open_links(members: DataFrame, sig: DataFrame, sets: DataFrame, threshold: float, percent: int) -> DataFrame:
    """Verified links (a, b) between members (bucket, band, key, n, comp) of a bucket that are in different components."""
    steps, banded = least_matches(threshold), banding(threshold)
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"))
    packed = members.join(sizes.where(F.col("c") <= BLOCK).select("bucket"), "bucket").join(sig, "key").groupBy("bucket").agg(
        F.first("band").alias("band"), F.collect_list(F.struct("key", "n", "comp", "sig")).alias("x"))
    packed = packed.select("bucket", "band", F.lit(0).alias("first"), F.lit(0).alias("block"), "x")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return across(batches, steps, percent, banded, dense=True)

    found = written(in_batches(packed, each, "a binary, b binary, bucket bigint"), "pairs")
    sparse = verified(found.where("a IS NOT NULL").select("a", "b"), sets, percent)
    dense = sizes.where(F.col("c") > BLOCK).select("bucket").unionAll(found.where("bucket IS NOT NULL").select("bucket"))
    return sparse.unionAll(dense_links(members.join(dense, "bucket", "left_semi").join(sig, "key"), sets, threshold, percent))


def likely_across(open_: DataFrame, threshold: float, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that no batch rules out, of the members (bucket, band, key, n, comp, sig) of buckets.

    Members are dealt into blocks of about BLOCK; blocks of a bucket meet, and their members are compared inside a task, so
    that only what passes leaves it. A pair passes in the first band that it agrees in, once.
    """
    steps = least_matches(threshold)
    counts = open_.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = open_.join(counts, "bucket").withColumn("block", F.pmod(F.xxhash64("key", "bucket"), F.col("blocks")).cast("int"))
    packed = dealt.groupBy("bucket", "block").agg(
        F.first("band").alias("band"), F.first("blocks").alias("blocks"), F.collect_list(F.struct("key", "n", "comp", "sig")).alias("x"))
    left = packed.select("bucket", "band", F.col("block").alias("first"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("block"), "x")
    met = left.join(packed.select("bucket", "block", F.col("x").alias("y")), ["bucket", "block"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return across(batches, steps, percent, banding(threshold))

    return in_batches(met, each, "a binary, b binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""
    a = sets.select(F.col("key").alias("a"), F.col("shingles").alias("set_a"))
    b = sets.select(F.col("key").alias("b"), F.col("shingles").alias("set_b"))
    both = pairs.join(a, "a").join(b, "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - common
    return both.where(100 * common >= percent * union).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(key, comp) of every node with a link: nodes take the least neighbour that is less than themselves, and
    the graph of these groups is treated the same way until no link is left. Each round is a stored table."""
    links = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links")
    names = written(links.select(F.col("a").alias("key")).union(links.select("b")).distinct().select("key", F.col("key").alias("comp")), "names")
    while not links.isEmpty():
        hop = links.groupBy(F.col("b").alias("comp")).agg(F.min("a").alias("to"))
        far = hop.select(F.col("comp").alias("to"), F.col("to").alias("next"))
        hop = written(hop.join(far, "to", "left").select("comp", F.coalesce("next", "to").alias("to")), "hop")
        names = written(names.join(hop, "comp", "left").select("key", F.coalesce("to", "comp").alias("comp")), "names")
        a, b = (hop.select(F.col("comp").alias(c), F.col("to").alias(f"to_{c}")) for c in ("a", "b"))
        moved = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("to_a", "a").alias("x"), F.coalesce("to_b", "b").alias("y"))
        links = written(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    return names


def near_duplicates(docs: DataFrame, percent: int = 80, words: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable over links, itself included), kept, text_hash and component of every row.

    Texts are linked if their sets of ``words``-word shingles have ``percent`` / 100 of their union in common. A row
    without words is linked with nothing. Equal sets are one node, so copies need no pairs, whatever their number. Repeated rows
    and repeated ids are rows of their own; NULL ids count only where a component has no other. ``kept`` is whether
    the row's id is that of its component (also if both are NULL). ``component`` is one value for all rows of a component, NULL for
    a row without words. An empty table gives an empty result.
    """
    threshold = percent / 100
    height, n_bands = banding(threshold)
    rows = written(described(docs, doc_id, text, words), "rows")
    nodes = rows.where("key IS NOT NULL").groupBy("key").agg(
        F.min("doc_id").alias("least_id"), F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
    nodes = written(nodes.withColumn("short", F.xxhash64("key")), "nodes")

    bands = F.array(*(F.xxhash64(F.lit(i), F.substring("sig", i * height + 1, height)) for i in range(n_bands)))
    buckets = nodes.select("short", F.posexplode(bands).alias("band", "bucket"))
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("bucket")
    # a short key that two nodes share adds a candidate, which is then found not to be a member's
    members = buckets.join(shared, "bucket").join(nodes.select("short", "key", "n"), "short").select("bucket", "band", "key", "n")
    members = written(members, "members")
    sets = written(full_sets(docs, nodes.join(members.select("key").distinct(), "key", "left_semi").select("key", "rep"), doc_id, text, words), "sets")
    sig = nodes.select("key", "sig")

    first = members.groupBy("bucket").agg(F.min(F.struct("key", "n")).alias("f")).select("bucket", F.col("f.key").alias("a"), F.col("f.n").alias("n_a"))
    stars = members.select("bucket", F.col("key").alias("b"), F.col("n").alias("n_b")).join(first, "bucket").where("a <> b")
    stars = stars.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")).select("a", "b").distinct()
    stars = stars.join(sig.select(F.col("key").alias("a"), F.col("sig").alias("sig_a")), "a").join(sig.select(F.col("key").alias("b"), F.col("sig").alias("sig_b")), "b")
    links = written(verified(likely(stars.select("a", "b", "sig_a", "sig_b"), threshold), sets, percent), "links")

    grouped = members.join(components(links), "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    mixed = grouped.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("key").alias("first")).where("lo <> hi").select("bucket", "first")
    rest = grouped.join(mixed, "bucket").where("key <> first").select("bucket", "band", "key", "n", "comp")
    more = written(open_links(written(rest, "open"), sig, sets, threshold, percent), "links")
    names = components(links.union(more))

    placed = nodes.select("key", "least_id").join(names, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    least = placed.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    of_key = placed.join(least, "comp").select("key", "component_id", F.col("comp").alias("component"))
    some = rows.where("key IS NOT NULL").join(of_key, "key").select("doc_id", "n_shingles", "component_id", "text_hash", "component")
    none = rows.where("key IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "text_hash", F.lit(None).cast("binary").alias("component"))
    return some.unionAll(none).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, percent: int = 80, words: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, less near-duplicates: of each component the row with the least id stays.

    Rows without words are no duplicates of anything. Of rows that are repeated with id and text one stays. Rows go by id and text hash
    together, so a row is lost only to another of its own id. Columns of any name are kept.
    """
    found = near_duplicates(docs, percent, words, doc_id, text).where("component IS NOT NULL")
    ids = written(found.select("component", F.struct("doc_id", "text_hash").alias("rep")).groupBy("component", "rep").agg(F.count(F.lit(1)).alias("times")), "ids")
    first = ids.groupBy("component").agg(F.min("rep").alias("first"), F.sum("times").alias("rows")).where("rows > 1").drop("rows")
    many = ids.join(first, "component").where("rep <> first OR times > 1")
    many = written(many.select(F.col("rep.doc_id").alias("i"), F.col("rep.text_hash").alias("h"), (F.col("rep") == F.col("first")).alias("again")), "less")
    few = many.count() <= SENT_KEYS
    send = F.broadcast if few else (lambda x: x)
    row = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("doc"), _text_hash(text).alias("hash"))
    here = row["doc"].eqNullSafe(F.col("i")) & (row["hash"] == F.col("h"))
    rest = row.join(send(many.select("i", "h")), here, "left_anti")
    repeated = row.join(send(many.where("again").select("i", "h")), here, "left_semi").dropDuplicates(["doc", "hash"])
    return rest.unionAll(repeated).select("row.*")
