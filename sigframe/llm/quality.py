"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates and
scored as sparse dot products.

Words are read twice: as they are (A-Z lower-cased), and as shapes, in which runs of letters and digits shrink to one
sign and other characters stay, so that marks of bad text carry over to words never seen. A shape also says whether the word
equals the one before it and whether its last four words stood in the text before. Features are n-grams
of words (1, 2) and of shapes (1, 2, 3); the value of a feature is its share of the text's n-grams of that kind.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from sigframe.llm.arrays import Grown, mix, ngrams, slices, sums
from sigframe.llm.common import in_batches, unit, whole

BITS = 20
#: (words or shapes, n) of each kind of feature; all have equal weight in a text.
KINDS = (("word", 1), ("word", 2), ("shape", 1), ("shape", 2), ("shape", 3))
SCALE = 8.0
#: Bounds of the training sample: labelled texts, and bytes of one text.
TRAIN_TEXTS, TEXT_BYTES = 6000, 32 << 10
REMEMBERED = 100_000
# Signs for a run of small letters, of capital letters, and of digits.
SIGNS = ((re.compile(r"[^\W\d_A-Z]+"), "a"), (re.compile(r"[A-Z]+"), "A"), (re.compile(r"\d+"), "0"), (re.compile(r"(.)\1+"), r"\1"))


def shape(word: str) -> str:
    if word.upper() == word and word.lower() != word:
        word = re.sub(r"[^\W\d_]+", "A", word)
    for runs, sign in SIGNS:
        word = runs.sub(sign, word)
    return word[:12]


class Words:
    """Hashes of words and of their shapes, remembered in a worker."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.pairs = Grown(np.zeros((0, 2), np.uint64))

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word hashes, shape hashes, offsets) of whole texts."""
        if len(self.known) > REMEMBERED:
            self.__init__()
        cut = [t.encode("utf-8", "surrogatepass").split() for t in texts]
        new = list(dict.fromkeys(w for ws in cut for w in ws if w not in self.known))
        if new:
            self.known.update(zip(new, range(self.pairs.n, self.pairs.n + len(new))))
            self.pairs.add(np.array([(xxhash.xxh64_intdigest(w.lower()), xxhash.xxh64_intdigest(shape(w.decode("utf-8", "replace")))) for w in new], np.uint64))
        counts = np.array([len(ws) for ws in cut], np.int64)
        which = np.fromiter((self.known[w] for ws in cut for w in ws), np.int64, counts.sum())
        pairs = self.pairs[which]
        return pairs[:, 0], pairs[:, 1], np.concatenate([[0], np.cumsum(counts)])


def features(words: np.ndarray, shapes: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each of KINDS the buckets of all n-grams and the offsets of texts among them."""
    text = np.repeat(np.arange(len(ends) - 1, dtype=np.uint64), np.diff(ends))
    same = np.zeros(len(words), np.uint64)
    same[1:] = (words[1:] == words[:-1]) & (text[1:] == text[:-1])
    fours, four_ends = ngrams(words, ends, 4)
    owner = np.repeat(np.arange(len(ends) - 1, dtype=np.uint64), np.diff(four_ends))
    again = np.ones(len(fours), bool)
    again[np.unique(mix(owner + np.uint64(1), 7) ^ fours, return_index=True)[1]] = False
    seen = np.zeros(len(words), np.uint64)  # at the last word of a repeated four
    seen[np.arange(len(fours)) + 3 * (owner.astype(np.int64) + 1) - lost(ends, owner)] = again
    marked = mix(mix(shapes, 1) ^ (np.uint64(2) * same + seen), 2)
    out = []
    for nth, (kind, n) in enumerate(KINDS):
        grams, at = ngrams(words if kind == "word" else marked, ends, n)
        out.append(((mix(grams, nth + 11) >> np.uint64(64 - BITS - 4) & np.uint64((1 << BITS) - 1)).astype(np.int64), at))
    return out


def lost(ends: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """How far texts of fewer than four words fall short of three, summed up to each text."""
    short = np.maximum(0, 3 - np.diff(ends))
    return np.cumsum(short)[owner.astype(np.int64)]


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, kinds: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        z = np.full(len(kinds[0][1]) - 1, self.bias)
        for buckets, ends in kinds:
            z += SCALE * sums(self.weights[buckets], ends) / np.maximum(np.diff(ends), 1)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def train(texts: list[str], labels: list[int], epochs: int = 4, alpha: float = 0.3, beta: float = 0.1, l1: float = 0.002, l2: float = 0.01) -> Model:
    """Follow the regularised leader, text by text in the given order; without texts every score is 0.5."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    reader, rows = Words(), []
    for t in texts:
        kinds = features(*reader.read([t]))
        idx = np.concatenate([b for b, _ in kinds])
        val = np.concatenate([np.full(len(b), SCALE / max(1, len(b))) for b, _ in kinds])
        at, inverse = np.unique(idx, return_inverse=True)
        rows.append((np.append(at, 1 << BITS), np.append(np.bincount(inverse, val, len(at)), 1.0)))

    def leader(z: np.ndarray, n: np.ndarray, free: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z) * np.maximum(np.abs(z) - np.where(free, 0, l1), 0)
        return -shrunk / ((beta + np.sqrt(n)) / alpha + l2)

    for _ in range(epochs):
        for (at, x), y in zip(rows, labels):
            w = leader(z[at], n[at], at == 1 << BITS)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -50, 50))) - y) * x
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
    w = leader(z, n, np.arange(len(z)) == 1 << BITS)
    return Model(w[:-1].astype(np.float32), float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Train on a bounded sample of labelled texts, chosen by hash of the id and taken in the order of another.

    An id with several labels counts as its lowest, one with several texts as the least of them. NULLs are left out.
    """
    marks = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).na.drop()
    marks = marks.groupBy("doc_id").agg(F.min("label").alias("label"))
    share = TRAIN_TEXTS / max(1, marks.count())
    marks = marks.where(unit(F.lit("sample"), F.col("doc_id").cast("string")) < share)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.octet_length("text") <= TEXT_BYTES)
    both = texts.join(F.broadcast(marks), "doc_id")  # about TRAIN_TEXTS rows of two numbers
    rows = both.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    rows = rows.select("text", "label", unit(F.lit("order"), F.col("doc_id").cast("string")).alias("u")).collect()
    rows.sort(key=lambda r: (r["u"], r["text"]))
    return train([r["text"] for r in rows], [int(r["label"] > 0) for r in rows])


_words = Words()


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ``score``, from 0 to 1, of every whole text; NULL and empty texts get the score of the bias. Repeated rows
    are scored each."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS weights
    rows = docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                values = shared.value.scores(features(*_words.read(part["text"].to_pylist())))
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(values.round(9))], ["doc_id", "score"])

    return in_batches(rows, each, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
