"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of order 0 to ORDER with frozen counts. A byte is coded in the longest context that
has seen it; each longer context that exists but has not seen it costs an escape (method C: distinct successors over
total and distinct ones). Below order 0 every byte costs 8 bits. A text's code length under a language is the sum
over its bytes; the language with the shortest code is predicted.

Since counts are frozen, the cost of each known (context, byte) pair and the escape of each context are fixed numbers;
they are laid out once for all languages together, and a text is scored by looking its byte windows up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sigframe.llm.arrays import HashIndex, SLICE_BYTES, slices, sums, text_bytes
from sigframe.llm.common import in_batches, unit, whole

ORDER = 4
#: Bounds of the training sample: bytes of all languages together, of one language and of one drawn text. They bound the model
#: as well, whatever the size of the corpus.
TRAIN_BYTES, LANGUAGE_BYTES, TEXT_BYTES = 1 << 20, 256 << 10, 32 << 10
#: Each language is learned; a corpus that names more of them than this is an error, as its model would not fit a task.
LANGUAGES = 512


def windows(padded: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The n bytes that end at each place, as one number."""
    code = np.zeros(len(at), np.uint64)
    for back in range(n - 1, -1, -1):
        code = (code << np.uint64(8)) | padded[at - back]
    return code


@dataclass
class LanguageModel:
    """Frozen costs in bits. ``grams[n]`` are known byte windows of length n, ``costs[n]`` their last byte's cost by language;
    ``contexts[n]`` are windows of length n that have successors, ``escapes[n]`` their escape costs."""

    languages: list[str]
    grams: dict[int, np.ndarray] = field(default_factory=dict)
    costs: dict[int, np.ndarray] = field(default_factory=dict)
    contexts: dict[int, np.ndarray] = field(default_factory=dict)
    escapes: dict[int, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def train(texts: dict[str, list[bytes]], order: int = ORDER) -> "LanguageModel":
        model = LanguageModel(sorted(texts))
        many = len(model.languages)
        padded, places = {}, {}
        for name in model.languages:
            parts = [np.frombuffer(b"\0" * order + t, np.uint8) for t in texts[name]]
            padded[name] = np.concatenate([np.zeros(0, np.uint8), *parts]).astype(np.uint64)
            at = np.cumsum([0] + [len(p) for p in parts])
            places[name] = np.concatenate([np.zeros(0, np.int64), *(np.arange(a + order, b) for a, b in zip(at, at[1:]))])
        lower_keys, lower = None, None
        for n in range(1, order + 2):
            seen = [np.unique(windows(padded[x], places[x], n), return_counts=True) for x in model.languages]
            keys = np.unique(np.concatenate([np.arange(256, dtype=np.uint64) if n == 1 else np.zeros(0, np.uint64), *(s[0] for s in seen)]))
            contexts = np.unique(keys >> np.uint64(8))
            of = np.searchsorted(contexts, keys >> np.uint64(8))
            if n == 1:
                below = np.full((len(keys), many), 8.0)
            else:
                below = lower[np.searchsorted(lower_keys, keys & np.uint64((1 << 8 * (n - 1)) - 1))]
            cost, escape = np.zeros((len(keys), many)), np.zeros((len(contexts), many))
            for j, (own, counts) in enumerate(seen):
                count = np.zeros(len(keys))
                count[np.searchsorted(keys, own)] = counts
                total = np.bincount(of, count, len(contexts))
                distinct = np.bincount(of, count > 0, len(contexts))
                known = total > 0
                escape[known, j] = np.log2((total[known] + distinct[known]) / distinct[known])
                with np.errstate(divide="ignore", invalid="ignore"):
                    cost[:, j] = np.where(count > 0, np.log2((total + distinct)[of] / count), escape[of, j] + below[:, j])
            model.grams[n], model.costs[n] = keys, cost.astype(np.float32)
            model.contexts[n - 1], model.escapes[n - 1] = contexts, escape.astype(np.float32)
            lower_keys, lower = keys, cost
        return model

    @property
    def order(self) -> int:
        return len(self.grams) - 1

    def index(self) -> None:
        """Hash indexes of windows and contexts; made once in each worker."""
        if not hasattr(self, "_grams"):
            self._contexts = {n: HashIndex(k) for n, k in self.contexts.items()}
            self._grams = {n: HashIndex(k) for n, k in self.grams.items()}

    def bits(self, padded: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Cost of the byte at each place, by language."""
        self.index()
        out = np.zeros((len(at), len(self.languages)), np.float32)
        left, code = np.arange(len(at)), windows(padded, at, self.order + 1)
        for n in range(self.order + 1, 0, -1):
            code = code & np.uint64((1 << 8 * n) - 1)
            found = self._grams[n].find(code)
            hit = found >= 0
            if n == self.order + 1:
                out[hit] = self.costs[n][found[hit]]
            else:
                out[left[hit]] += self.costs[n][found[hit]]
            left, code = left[~hit], code[~hit]
            if not len(left):
                break
            context = self._contexts[n - 1].find(code >> np.uint64(8))
            some = context >= 0
            out[left[some]] += self.escapes[n - 1][context[some]]
        return out

    def code_lengths(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Bits of each text data[ends[i]:ends[i + 1]], by language; a long text is coded piece by piece."""
        order, n = self.order, len(ends) - 1
        if n == 1 and len(data) > 2 * SLICE_BYTES:
            padded, total = np.concatenate([np.zeros(order, np.uint8), data]), np.zeros((1, len(self.languages)))
            for a in range(0, len(data), SLICE_BYTES):
                piece = padded[a:a + SLICE_BYTES + order].astype(np.uint64)
                total += self.bits(piece, np.arange(order, len(piece))).sum(axis=0, dtype=np.float64)
            return total
        padded = np.zeros(len(data) + order * n, np.uint64)
        at = np.arange(len(data)) + order * (np.repeat(np.arange(n), np.diff(ends)) + 1)
        padded[at] = data
        return sums(self.bits(padded, at), ends)


def sample(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> dict[str, list[bytes]]:
    """A bounded training sample of every language: whole texts of up to TEXT_BYTES, chosen by a hash of id and text. A language
    that none is drawn of gives its first text by that hash, the shorter ones first, cut to what is its share."""
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), unit(F.col(key).cast("string"), F.col(text)).alias("u"))
    rows = rows.where(F.col("lang").isNotNull() & (F.octet_length("text") > 0))
    size = F.octet_length("text")
    short = F.sum(F.when(size <= TEXT_BYTES, size)).alias("bytes")
    sizes = rows.groupBy("lang").agg(short).limit(LANGUAGES + 1).collect()
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages to learn; group rare ones under one name")
    if not sizes:
        return {}
    most = min(LANGUAGE_BYTES, TRAIN_BYTES // len(sizes))
    spark = docs.sparkSession
    shares = spark.createDataFrame([(r["lang"], min(1.0, most / r["bytes"]) if r["bytes"] else 0.0) for r in sizes], "lang string, share double")
    drawn = rows.where(size <= TEXT_BYTES).join(F.broadcast(shares), "lang").where("u < share")  # at most LANGUAGES rows
    out: dict[str, list[bytes]] = {}
    for r in sorted(drawn.select("lang", "text").collect()):
        out.setdefault(r["lang"], []).append(r["text"].encode())
    bare = [r["lang"] for r in sizes if r["lang"] not in out]
    if bare:
        first = rows.where(F.col("lang").isin(bare)).groupBy("lang").agg(F.min(F.struct((size > TEXT_BYTES).alias("long"), "u", F.left("text", F.lit(most)).alias("text"))).alias("f"))
        out.update({r["lang"]: [r["f"]["text"].encode()[:most]] for r in first.collect()})
    return out


def identify(docs: DataFrame, model: LanguageModel, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep``, lang_pred, score and bits_per_byte of every row.

    ``lang_pred`` is the language with the shortest code of the whole text, by name where codes tie; ``und`` if the text
    is NULL, has no letter, or no language was learned. ``score`` is the share of that language among all,
    each weighing 2 to the minus its code length (0 for ``und``). ``bits_per_byte`` is the shortest code over the text's bytes, NULL
    for ``und``. Repeated rows are judged each.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # bounded by the training sample
    # the text passes once, without NULL, and gets its NULLs back afterwards
    names = [k if k != text else "_text" for k in keep]
    rows = docs.select(*[k for k in keep if k != text], whole(text).alias("_text"), F.col(text).isNull().alias("_none"), whole(text).rlike(r"\p{L}").alias("_letter"))
    carried = [*names, *(["_none"] if text in keep else [])]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = shared.value
        called = np.array([*learned.languages, "und"], object)
        for batch in batches:
            for part in slices(batch, "_text"):
                data, ends = text_bytes(part["_text"])
                letter = part["_letter"].to_numpy(zero_copy_only=False).astype(bool)
                if not learned.languages:
                    letter[:] = False
                    bits = np.zeros((len(letter), 1))
                else:
                    bits = learned.code_lengths(data, ends)
                top = np.argmin(bits, axis=1)
                least = bits[np.arange(len(top)), top]
                score = np.where(letter, 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1), 0.0)
                rate = pa.array(least / np.maximum(np.diff(ends), 1), mask=~letter)
                yield pa.RecordBatch.from_arrays([*(part[k] for k in carried), pa.array(called[np.where(letter, top, len(called) - 1)], pa.string()),
                                                  pa.array(score.round(9)), rate], [*carried, "lang_pred", "score", "bits_per_byte"])

    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in carried)
    out = in_batches(rows, each, f"{schema}, lang_pred string, score double, bits_per_byte double")
    given = [F.when(~F.col("_none"), F.col("_text")).alias(text) if k == text else F.col(k) for k in keep]
    return out.select(*given, "lang_pred", "score", "bits_per_byte")


def accepted(lang_pred: Column, bits_per_byte: Column, n_bytes: Column, least_bytes: int = 64, most_bits: float = 8.0) -> Column:
    """Whether a text is in a learned language: ``und`` is not, nor is a text of some length that no language codes
    in fewer bits than plain bytes take."""
    return (lang_pred != "und") & ((n_bytes < least_bytes) | (bits_per_byte <= most_bits))
