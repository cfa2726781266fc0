"""Spelling variants: words one edit apart, by a frontier of states that moves through a trie as joins.

Every word is read forwards and backwards, with a first sign that tells which, and the trie holds both: a table of nodes (prefixes of
readings) with their outgoing edges, stored by level. A state (reading, pos, node, edits) says that ``pos`` signs of a reading have been read
at ``node`` with so many edits. Each level joins all states with the nodes they are at: a state without an edit follows its own
letter, replaces it by a larger one, or deletes it; a state with an edit only follows. A state with one edit that has read all at the end
of another reading is a pair of neighbours. Insertions are deletions of the other word, and replacements by smaller letters those of
the other word, so pairs are found once and mirrored.

An edit in the second half of a word is made in the forward reading, one in the first half in the backward one. So states enter
at the middle of a word, where few others share its prefix, and not at the root, where all do.

The number of joins is the length of the longest word, so words above LONGEST code points are paired by the hashes of their texts with
one code point left out instead, and verified; a hash and a place are shared by as many words as there are letters, at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sigframe.llm.arrays import mix
from sigframe.llm.common import LOWER, UPPER, in_batches, whole
from sigframe.session import shared_dir, written

#: A run of letters, after A-Z have become lower case.
RUN = "([a-zÀ-ÿ]+)"
#: Every DROPPED-th spelling, by hash, loses a code point.
DROPPED = 199
LONGEST = 64
LEAST_LENGTH, LEAST_COUNT, FACTOR = 6, 5, 5


def spellings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of all runs of letters in all texts, A-Z lower-cased, one code point deleted where the hash of id and run says so."""
    run = F.explode(F.regexp_extract_all(F.translate(whole(text), UPPER, LOWER), F.lit(RUN), F.lit(1)))
    runs = docs.select(whole(F.col(doc_id).cast("string")).alias("id"), run.alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return runs.select(F.when(F.col("h") % DROPPED == 0, cut).otherwise(F.col("run")).alias("word")).where(
        F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def _letter(word: str, at: Column | int) -> Column:
    """The code point of ``word`` at a place from 0 on; empty behind its end."""
    return F.substring(F.col(word), (F.lit(at) if isinstance(at, int) else at) + 1, F.lit(1))


FORWARD, BACKWARD = ">", "<"


def readings(words: DataFrame) -> DataFrame:
    """(reading, start) of every word, forwards and backwards; edits are made from ``start`` on."""
    n = F.length("word")
    half = F.floor(n / 2).cast("int")
    both = F.array(F.struct(F.concat(F.lit(FORWARD), "word").alias("reading"), (half + 1).alias("start")),
                   F.struct(F.concat(F.lit(BACKWARD), F.reverse("word")).alias("reading"), (n - half + 1).alias("start")))
    return words.select(F.inline(both))


def trie(reads: DataFrame) -> str:
    """Path of the nodes (level, node, kids): ``kids`` are edges (letter, whether a reading ends there, letters that follow), by level.

    Levels above the least ``start`` are not needed.
    """
    n = F.length("reading")
    # a node has all its edges only if every reading through it adds its own, also those that start further down
    first = reads.agg(F.min("start")).first()[0]
    steps = reads.select("reading", F.explode(F.sequence(F.lit(first), n - 1)).alias("level"))
    edges = steps.select("level", F.substring("reading", F.lit(1), F.col("level")).alias("node"), _letter("reading", F.col("level")).alias("letter"),
                         _letter("reading", F.col("level") + 1).alias("then"))
    follow = edges.groupBy("level", "node", "letter").agg(F.array_join(F.array_sort(F.collect_set("then")), "").alias("then"), F.bool_or(F.col("then") == "").alias("ends"))
    nodes = written(follow.groupBy("level", "node").agg(F.collect_list(F.struct("letter", "ends", "then")).alias("kids")), "nodes")
    path = f"{shared_dir(reads.sparkSession)}/levels"
    nodes.repartitionByRange("level", "node").write.partitionBy("level").parquet(path)
    return path


STATE = ["reading", "pos", "node", "edits", "ends"]


def walked(words: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``words``, b being a with one code point deleted or replaced by a larger one."""
    spark = words.sparkSession
    reads = written(readings(words), "readings")
    size = F.length("reading")
    first, last = reads.agg(F.min("start"), F.max(size)).first()
    found = []
    if first is not None:
        nodes = spark.read.schema("node string, kids array<struct<letter string, ends boolean, then string>>, level int").parquet(trie(reads))
        front, own, then = None, _letter("reading", F.col("pos")), _letter("reading", F.col("pos") + 1)
        for level in range(first, last):
            enter = reads.where(F.col("start") == level).select("reading", F.lit(level).alias("pos"), F.substring("reading", 1, level).alias("node"), F.lit(0).alias("edits"), F.lit(False).alias("ends"))
            front = enter if front is None else front.unionByName(enter)
            front = written(_step(front, nodes.where(F.col("level") == level).select("node", "kids"), own, then), "front")
            found.append(front.where("done"))
            front = front.where("NOT done").select(*STATE)
    out = words.limit(0).select(F.col("word").alias("a"), F.col("word").alias("b"))
    for pairs in found:
        out = out.unionAll(pairs.select(*(F.when(F.left("reading", F.lit(1)) == FORWARD, F.substring(c, F.lit(2), size)).otherwise(
            F.reverse(F.substring(c, F.lit(2), size))).alias(n) for c, n in (("reading", "a"), ("node", "b")))))
    return out


def _step(front: DataFrame, nodes: DataFrame, own: Column, then: Column) -> DataFrame:
    """The states one level down, those that are pairs marked as ``done``."""
    size = F.length("reading")
    # a deletion stays at its node; of equal letters in a row the last of the word is deleted
    before = _letter("reading", F.col("pos") - 1)
    lone = F.when(F.left("reading", F.lit(1)) == FORWARD, own != then).otherwise(own != before)
    cut = front.where(F.col("edits") == 0).where(lone).select("reading", (F.col("pos") + 1).alias("pos"), "node", F.lit(1).alias("edits"), "ends")
    met = front.unionByName(cut).join(nodes, "node", "left")
    goes = F.when(F.col("edits") == 1, F.filter("kids", lambda k: k["letter"] == own)).otherwise(F.filter(
        "kids", lambda k: (k["letter"] == own) | ((k["letter"] > own) & F.when(then == "", k["ends"]).otherwise(F.contains(k["then"], then)))))
    done = (F.col("edits") == 1) & (F.col("pos") == size)
    none = F.array(F.lit(None).cast("struct<letter:string,ends:boolean,then:string>"))
    kids = met.select("reading", "pos", "node", "edits", "ends", done.alias("done"), F.explode_outer(F.when(done, none).otherwise(goes)).alias("kid"))
    kids = kids.where("done AND ends OR kid IS NOT NULL")
    moved = kids.select(
        "reading", F.when(F.col("done"), F.col("pos")).otherwise(F.col("pos") + 1).alias("pos"), F.concat("node", F.coalesce("kid.letter", F.lit(""))).alias("node"),
        F.when(F.col("done"), F.lit(1)).otherwise(F.col("edits") + (F.col("kid.letter") != own).cast("int")).alias("edits"),
        F.coalesce("kid.ends", "ends").alias("ends"), "done")
    # what has reached the end of its word with this step is done as well
    at_end = (F.col("edits") == 1) & (F.col("pos") == size) & F.col("ends")
    return moved.withColumn("done", F.col("done") | at_end).where(F.col("done") | (F.col("pos") < size))


def _place_hashes(word: str) -> tuple[np.ndarray, int]:
    """Hashes of the word without its code point i, for every i, and of the whole word."""
    points = mix(np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64), 12)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(len(points), 0x9E3779B97F4A7C15, np.uint64))
        whole_ = np.cumsum(points * power)
        before = np.concatenate([np.zeros(1, np.uint64), whole_[:-1]])
        shifted = np.cumsum((points[1:] * power[:-1])[::-1])[::-1]
        return before + np.concatenate([shifted, np.zeros(1, np.uint64)]), int(whole_[-1])


def hashed(words: DataFrame, longer_than: int) -> DataFrame:
    """Pairs (a, b) as ``walked`` gives them (replacements in either direction) where one of the two has over ``longer_than`` code points."""
    words = words.where(F.length("word") >= longer_than).withColumn("id", F.unhex(F.md5("word")))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for id_, word in zip(batch["id"].to_pylist(), batch["word"].to_pylist()):
                cut, own = _place_hashes(word)
                n = len(word)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([id_] * (n + 1), pa.binary()), pa.array(np.append(np.full(n, n), n + 1), pa.int32()), pa.array(np.append(np.arange(n), -1), pa.int32()),
                     pa.array(np.append(cut, np.uint64(own)).view(np.int64))], ["id", "length", "at", "hash"])

    # a word's own hash is filed as one of length + 1, where its longer neighbours look for it
    places = written(in_batches(words.select("id", "word"), each, "id binary, length int, at int, hash bigint"), "places")
    cut, own = places.where("at >= 0"), places.where("at < 0").select(F.col("id").alias("b"), "length", "hash")
    replaced = cut.withColumnRenamed("id", "a").join(cut.withColumnRenamed("id", "b"), ["length", "at", "hash"]).where("a < b").select("a", "b")
    deleted = cut.withColumnRenamed("id", "a").join(own, ["length", "hash"]).select("a", "b")
    a, b = (words.select(F.col("id").alias(c), F.col("word").alias(f"word_{c}")) for c in ("a", "b"))
    pairs = replaced.unionAll(deleted).distinct().join(a, "a").join(b, "b").where(F.greatest(F.length("word_a"), F.length("word_b")) > longer_than)
    return pairs.where(F.levenshtein("word_a", "word_b", 1) == 1).select(F.col("word_a").alias("a"), F.col("word_b").alias("b"))


def near_words(words: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(word, near): every ordered pair of ``words`` that differ by one inserted, deleted or replaced code point, once."""
    pairs = walked(words.select("word").where(F.length("word") <= longest)).unionAll(hashed(words.select("word"), longest))
    pairs = written(pairs, "pairs")
    return pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).unionAll(pairs.select(F.col("b"), F.col("a")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form (word, form): where following forms ends. Each round doubles the steps taken."""
    at = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = written(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if at.where("moved").isEmpty():
            return at.select("word", "root")
        at = at.select("word", "root")


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of LEAST_LENGTH code points or more that occurs LEAST_COUNT times or more.

    ``form`` is the most frequent near word (ties: least in code-point order) if it occurs FACTOR times as often or more; ``root``
    is where forms end. NULL text has no words, a NULL id counts as an empty one in the hash, repeated rows count again. An empty table
    gives an empty result.
    """
    words = written(spellings(docs, doc_id, text), "words")
    near = near_words(words).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    table = words.join(best, "word", "left")
    fits = -F.col("best.less") >= FACTOR * F.col("n")
    table = written(table.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.near")).alias("form"),
                                 F.when(fits, -F.col("best.less")).alias("form_n")), "forms")
    out = table.join(roots(table.where("form IS NOT NULL")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
