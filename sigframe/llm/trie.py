"""Prefix trie of conversations: members of every prefix and totals of every subtree, by time-forward processing.

1. Turns are numbered in ranges of (conversation, turn), so no task holds a whole conversation; conversations are rebuilt from
   the head of their group's first one and their own tail.
2. A prefix is known by its length and the exclusive or of 128 bits that each turn gives together with its position, so running
   values of segments add up to those of whole conversations. Prefixes with equal keys are one node.
3. Nodes with a single member are chains with totals in closed form; only the first of a chain reports to its parent. A shared node
   whose members have more than ``limit`` turns ahead of them together is an upper node; the subtrees below upper nodes are
   the shards, none of which holds more than ``limit`` nodes.
4. Within a shard nodes come in reverse level order, sorted by Spark (an external sort). Each sends its totals forward to its parent through
   a priority queue that spills to disk, and takes those of its children from there. Totals of the shards' roots are added up by
   parent and go the same way through the upper nodes.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sigframe.llm.common import whole
from sigframe.session import written

#: Conversations of a group share the head of the group's first.
GROUP, HEADS = 5, 9
#: Turns of a conversation whose running values are made in one task.
SEGMENT = 4096
#: Least size of a shard; larger inputs have shards of one SHARDS-th of all turns.
LEAST_SHARD, SHARDS = 20_000, 1000
#: Messages that a queue keeps in memory.
HELD = 200_000
#: Range of ids whose members are joined to one text before hashing.
CHUNK = 4096
KEY = ["depth", "p1", "p2"]


class Messages:
    """A priority queue of (place, values) with bounded memory: when it is full its messages are sorted into a run on disk.

    ``take`` is called with places that never fall and sends are to later places only (time goes forward), so runs
    are read once from front to back.
    """

    def __init__(self, held: int = HELD):
        self.held, self.heap, self.runs = held, [], []

    def send(self, place: tuple, values: tuple) -> None:
        heapq.heappush(self.heap, (place, values))
        if len(self.heap) > self.held:
            run = _stored(sorted(self.heap))
            self.heap = []
            self._next(run)

    def _next(self, run: Iterator) -> None:
        head = next(run, None)
        if head is not None:
            heapq.heappush(self.runs, (head, id(run), run))

    def take(self, place: tuple) -> list[tuple]:
        """The values of all messages for ``place``, which leave the queue."""
        out = []
        while self.heap and self.heap[0][0] == place:
            out.append(heapq.heappop(self.heap)[1])
        while self.runs and self.runs[0][0][0] == place:
            (_, values), _, run = heapq.heappop(self.runs)
            out.append(values)
            self._next(run)
        return out


def _stored(items: list) -> Iterator:
    """The items again, from an unnamed file that goes with the iterator; only this task uses it."""
    file, step = tempfile.TemporaryFile(), 1000
    for i in range(0, len(items), step):
        pickle.dump(items[i:i + step], file)
    file.seek(0)

    def read() -> Iterator:
        with file:
            for _ in range(0, len(items), step):
                yield from pickle.load(file)

    return read()


def time_forward(nodes: DataFrame, shard: list[str]) -> DataFrame:
    """Adds n_children, n_leaves and saved_tokens to ``nodes``: totals over each node's subtree within its shard.

    Rows carry depth, p1, p2 (own key), q1, q2 (parent's key), own (what the node itself saves) and totals c, l, s that reach it from
    outside the shard. Shards are dealt to tasks; a shard's rows come deepest first.
    """
    order = [*shard, F.col("depth").desc(), "p1", "p2"]
    dealt = (nodes.repartition(*shard) if shard else nodes.coalesce(1)).sortWithinPartitions(*order)
    kept = [c for c in dealt.columns if c not in ("own", "c", "l", "s", "q1", "q2")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.select(*kept).schema) + ", n_children bigint, n_leaves bigint, saved_tokens bigint"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, queue = None, Messages()
        for batch in batches:
            cols = {c: batch[c].to_pylist() for c in ("depth", "p1", "p2", "q1", "q2", "own", "c", "l", "s", *shard)}
            found = []
            for depth, p1, p2, q1, q2, own, c, l, s, *here in zip(*cols.values()):
                if here != at:
                    at, queue = here, Messages()
                for leaves, saved in queue.take((-depth, p1, p2)):
                    c, l, s = c + 1, l + leaves, s + saved
                found.append((c, max(l, 1), s + own))
                queue.send((1 - depth, q1, q2), found[-1][1:])
            totals = [pa.array(v, pa.int64()) for v in zip(*found)] or [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), *totals], [*kept, "n_children", "n_leaves", "saved_tokens"])

    return dealt.mapInArrow(each, schema)


def numbered(turns: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, i, digest, bytes): turns of a conversation from 1 on. Those with equal numbers are ordered by ``digest``.

    Rows are dealt by ranges of (conversation, turn), numbered within a range and moved by the counts of earlier ranges.
    """
    role, text = whole(role), whole(text)
    slim = turns.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"),
        F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    ranges = slim.repartitionByRange("conv_id", "turn", "digest").withColumn("part", F.spark_partition_id())
    ranges = written(ranges, "turns")
    counts = ranges.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("conv_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    local = Window.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), "digest")
    rows = ranges.withColumn("i", F.row_number().over(local)).join(starts.where("start > 0"), ["conv_id", "part"], "left")
    return rows.select("conv_id", (F.col("i") + F.coalesce("start", F.lit(0))).cast("long").alias("i"), "digest", "bytes")


def head_length(conv: Column) -> Column:
    return (F.crc32(conv.cast("string").cast("binary")) % HEADS).cast("long")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (conv_id, depth, digest, bytes) and conversations (conv_id, total)."""
    lengths = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    base = lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = lengths.withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP).join(base, "base", "left").withColumn("h", head_length(F.col("conv_id")))
    convs = convs.withColumn("head", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = written(convs.withColumn("total", F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "convs")
    tails = turns.join(convs.select("conv_id", "h", "head"), "conv_id").where("i > h").select("conv_id", (F.col("i") - F.col("h") + F.col("head")).alias("depth"), "digest", "bytes")
    heads = turns.where(F.col("i") < HEADS).withColumnRenamed("conv_id", "base").join(convs.select("conv_id", "base", "head"), "base")
    heads = heads.where("i <= head").select("conv_id", F.col("i").alias("depth"), "digest", "bytes")
    return tails.unionByName(heads), convs.select("conv_id", "total")


def prefixes(steps: DataFrame) -> DataFrame:
    """Adds p1, p2 (key of the prefix that ends here) and q1, q2 (that of its parent), by running values of segments."""
    halves = [F.xxhash64("digest", "depth"), F.xxhash64(F.lit(2), "depth", "digest")]
    steps = steps.select("conv_id", "depth", "bytes", *(h.alias(f"h{i}") for i, h in enumerate(halves, 1)), F.floor((F.col("depth") - 1) / SEGMENT).alias("seg"))
    before = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    long_ = steps.groupBy("conv_id", "seg").agg(F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"))
    carried = long_.select("conv_id", "seg", *(F.bit_xor(f"x{i}").over(before).alias(f"x{i}") for i in (1, 2))).where("seg > 0")
    upto = Window.partitionBy("conv_id", "seg").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    local = steps.select("*", *(F.bit_xor(f"h{i}").over(upto).alias(f"l{i}") for i in (1, 2))).join(carried, ["conv_id", "seg"], "left")
    keys = [F.col(f"l{i}").bitwiseXOR(F.coalesce(f"x{i}", F.lit(0))).alias(f"p{i}") for i in (1, 2)]
    parents = [F.col(f"p{i}").bitwiseXOR(F.col(f"h{i}")).alias(f"q{i}") for i in (1, 2)]
    return local.select("*", *keys).select("conv_id", "depth", "bytes", "p1", "p2", *parents)


def id_digests(ends: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ends_sha256) of rows (keys, conv_id): SHA-256 of a key's ids, ascending and joined by commas.

    Texts of CHUNK ids are made first; a key's chunks then go through one running hash, in order, one at a time.
    """
    chunk = F.floor(F.col("conv_id") / CHUNK).alias("chunk")
    texts = ends.groupBy(*keys, chunk).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    dealt = texts.repartition(*keys).sortWithinPartitions(*keys, "chunk")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, running = None, None

        def rows(done: list) -> pa.RecordBatch:
            cols = list(zip(*done))
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:-1]), pa.array(cols[-1])], [*keys, "ends_sha256"])

        for batch in batches:
            done = []
            for *key, ids in zip(*(batch[k].to_pylist() for k in keys), batch["ids"].to_pylist()):
                if key == at:
                    running.update(b",")
                else:
                    if at is not None:
                        done.append((*at, running.hexdigest()))
                    at, running = key, hashlib.sha256()
                running.update(ids.encode())
            if done:
                yield rows(done)
        if at is not None:
            yield rows([(*at, running.hexdigest())])

    return dealt.mapInArrow(each, ", ".join(f"{k} bigint" for k in keys) + ", ends_sha256 string")


def prefix_trie(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", limit: int | None = None) -> DataFrame:
    """One row for each distinct prefix of the rebuilt conversations, the textless root among them:
    conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by number (NULL first), those with equal numbers by an MD5 of role and text; repeated rows are turns of their
    own. NULL role or text is empty; rows without a conversation id are left out. An empty table gives an empty result.
    """
    turns = written(numbered(turns, conv_id, turn, role, text), "numbered")
    steps, convs = rebuilt(turns)
    convs = written(convs, "totals")
    steps = written(prefixes(steps), "steps")
    n_turns = steps.count()
    limit = limit or max(LEAST_SHARD, n_turns // SHARDS)

    ahead = steps.join(convs, "conv_id").withColumn("ahead", F.col("total") - F.col("depth") + 1)
    nodes = ahead.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("q1").alias("q1"), F.first("q2").alias("q2"),
        F.max("bytes").alias("bytes"), F.sum("ahead").alias("ahead"))
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    zero = F.lit(0).cast("long")
    top = top.select(*(zero.alias(k) for k in KEY), "conv_id", "n_convs", F.lit(None).cast("long").alias("q1"), F.lit(None).cast("long").alias("q2"),
                     zero.alias("bytes"), F.lit(2**62).alias("ahead"))
    upper = ((F.col("n_convs") > 1) & (F.col("ahead") > limit)) | (F.col("depth") == 0)
    nodes = written(nodes.unionByName(top).withColumn("upper", upper), "nodes")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"),
                           F.col("n_convs").alias("n_parent"), F.col("upper").alias("below_upper"))
    own = (F.col("n_convs") - 1) * F.col("bytes")
    nodes = written(nodes.join(parents, ["depth", "q1", "q2"], "left").withColumn("own", own).drop("bytes", "ahead"), "family")

    # a chain of a single member: nothing saved, one leaf, one child but for the last
    chain = (F.col("n_convs") == 1) & ~F.col("upper")
    chains = nodes.where(chain).join(convs, "conv_id").select(
        *KEY, "conv_id", "parent_conv_id", "n_convs", (F.col("depth") < F.col("total")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), zero.alias("saved_tokens"))
    first = nodes.where(chain & ((F.col("n_parent") > 1) | F.col("below_upper")))

    # shards: a conversation's is named by its first node below the upper ones
    high = nodes.where(F.col("upper") & (F.col("depth") > 0)).select(*KEY)
    cuts = steps.join(high, KEY, "left_semi").groupBy("conv_id").agg((F.max("depth") + 1).alias("cut"))
    roots = steps.join(cuts, "conv_id", "left").where(F.col("depth") == F.coalesce("cut", F.lit(1))).select("conv_id", F.col("p1").alias("r1"), F.col("p2").alias("r2"))
    inner = nodes.where("n_convs > 1 AND NOT upper").select("*", F.lit(True).alias("shared"))
    below = first.where("NOT below_upper").select("*", F.lit(False).alias("shared"))
    shards = inner.unionByName(below).join(roots, "conv_id").withColumns({"c": zero, "l": zero, "s": zero}).drop("n_parent", "upper")
    lower = written(time_forward(shards, ["r1", "r2"]), "lower").where("shared")

    # the shards' roots and the chains that hang on upper nodes, added up by parent
    up = [F.col("depth") - 1, F.col("q1"), F.col("q2")]
    sent = lower.where("below_upper").join(nodes.select(*KEY, "q1", "q2"), KEY).select(*(k.alias(n) for k, n in zip(up, KEY)), "n_leaves", "saved_tokens")
    sent = sent.unionAll(first.where("below_upper").select(*(k.alias(n) for k, n in zip(up, KEY)), F.lit(1).cast("long"), zero))
    sent = sent.groupBy(*KEY).agg(F.count(F.lit(1)).alias("c"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
    above = nodes.where("upper").join(sent, KEY, "left").withColumns({k: F.coalesce(k, zero) for k in ("c", "l", "s")}).drop("n_parent", "below_upper", "upper")
    above = above.withColumns({"q1": F.coalesce("q1", zero), "q2": F.coalesce("q2", zero)})
    totals = ["conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    every = time_forward(above, []).select(*KEY, *totals).unionByName(lower.select(*KEY, *totals)).unionByName(chains)

    last = steps.join(convs, "conv_id").where("depth = total").select(*KEY, "conv_id")
    last = last.unionAll(convs.where("total = 0").select(*(zero.alias(k) for k in KEY), "conv_id"))
    out = every.join(id_digests(last, KEY), KEY, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
