"""SentencePiece BPE encoding by vectorised merge rounds, and decoding.

A text is cut into words where no piece can cross: before a space that follows another character, and around line feeds.
The words that a task meets for the first time are laid out as one flat array of symbols. In each round
every word finds the best rank among its pairs (a segmented minimum), merges the leftmost pair of that rank, and the
array is compacted; words without a pair leave. Merging one pair a round keeps the order of the
sequential algorithm. Words above LONG symbols, for which rounds would cost the square of their length, go through a heap instead.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sigframe.llm.arrays import Grown, HashIndex, ragged, slices
from sigframe.llm.common import in_batches, whole

SPACE = "▁"
WORDS = re.compile(r" *[^ \n]+|\n| +")
LONG = 256
#: Distinct words whose ids a worker remembers before it starts anew.
REMEMBERED = 150_000
NONE = np.iinfo(np.int32).max


@dataclass
class Vocabulary:
    """Plain arrays of a model: what tasks need, without the model file."""

    size: int
    end: int
    chars: np.ndarray  # code points that begin as symbols
    char_ids: np.ndarray
    pairs: np.ndarray  # left * span + right
    merged: np.ndarray
    rank: np.ndarray  # by id, 0 is best; equal scores have equal ranks
    bytes_: np.ndarray  # id of each byte
    text: np.ndarray  # what each id decodes to, one after another
    text_ends: np.ndarray
    is_byte: np.ndarray
    span: int

    @staticmethod
    def load(path: str) -> "Vocabulary":
        """Read a BPE model with byte fallback and identity normalisation; anything else is refused."""
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, kind = proto.normalizer_spec, pb.ModelProto.SentencePiece
        odd = [p.piece for p in proto.pieces if p.type in (kind.USER_DEFINED, kind.UNUSED)]
        if (proto.trainer_spec.model_type != pb.TrainerSpec.BPE or not proto.trainer_spec.byte_fallback or norm.precompiled_charsmap
                or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or not norm.escape_whitespaces or odd):
            raise ValueError(f"{path}: only BPE with byte fallback, a space before the text and no other normalisation is supported")
        pieces = [p.piece for p in proto.pieces]
        if any(re.search(f"[^{SPACE}]{SPACE}|\n", p) for p in pieces):
            raise ValueError(f"{path}: a piece crosses the border of words")
        normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kind.NORMAL}
        single = {c: normal.get(c, -1) for p in normal for c in p}
        for c in single:  # characters that occur in longer pieces only
            if single[c] < 0:
                single[c] = len(pieces) + sum(i >= len(pieces) for i in single.values())
        symbols = {**single, **normal}
        span = max(symbols.values(), default=0) + 1
        pairs = {symbols[p[:i]] * span + symbols[p[i:]]: n for p, n in normal.items() for i in range(1, len(p))
                 if p[:i] in symbols and p[i:] in symbols}
        scores = np.array([p.score for p in proto.pieces])
        is_byte = np.array([p.type == kind.BYTE for p in proto.pieces])
        bytes_ = np.array([pieces.index(f"<0x{b:02X}>") for b in range(256)])
        control = {i for i, p in enumerate(proto.pieces) if p.type == kind.CONTROL}
        unknown = {i for i, p in enumerate(proto.pieces) if p.type == kind.UNKNOWN}
        where = {int(i): b for b, i in enumerate(bytes_)}
        texts = [b"" if i in control else proto.trainer_spec.unk_surface.encode() if i in unknown else bytes([where[i]]) if i in where
                 else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        end = sentencepiece.SentencePieceProcessor(model_file=path).eos_id()
        return Vocabulary(len(pieces), end, np.array([ord(c) for c in single]), np.array(list(single.values()), np.int32),
                          np.array(list(pairs), np.uint64), np.array(list(pairs.values()), np.int32),
                          np.unique(-scores, return_inverse=True)[1].astype(np.int32), bytes_.astype(np.int32),
                          np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts]), is_byte, span)

    def encoder(self) -> "Encoder":
        """One encoder for all tasks of a worker."""
        if not hasattr(self, "_encoder"):
            self._encoder = Encoder(self)
        return self._encoder


class Encoder:
    """Encodes words and remembers them; one in each worker."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.index = HashIndex(vocabulary.pairs)
        self.first = np.full(0x110000, -1, np.int32)
        self.first[vocabulary.chars] = vocabulary.char_ids
        self.first[ord(" ")] = self.first[ord(SPACE)]  # words keep plain spaces
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.places = Grown(np.zeros((0, 2), np.int64))  # start and length of each word's ids
        self.ids = Grown(np.zeros(0, np.int32))

    def merge_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id that each pair merges to, or -1."""
        keys = left.astype(np.int64) * self.v.span + right
        keys[(left < 0) | (right < 0)] = -1
        found = self.index.find(keys.astype(np.uint64))
        return np.where(found >= 0, self.v.merged[found], -1)

    def ranks(self, merged: np.ndarray) -> np.ndarray:
        return np.where(merged >= 0, self.v.rank[merged], NONE)

    def rounds(self, words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(symbols, first code points) of each word after all merges."""
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        lengths = np.array([len(w) for w in words], np.int64)
        word = np.repeat(np.arange(len(words)), lengths)
        symbol = self.first[points]
        out: list = [None] * len(words)
        merged = np.full(len(symbol), -1, np.int32)
        inside = np.flatnonzero(word[:-1] == word[1:])
        merged[inside] = self.merge_of(symbol[inside], symbol[inside + 1])
        while len(symbol):
            rank = self.ranks(merged)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[starts, len(word)])
            least = np.minimum.reduceat(rank, starts)
            done = least == NONE
            for at, n in zip(starts[done], sizes[done]):
                out[word[at]] = (symbol[at:at + n], points[at:at + n])
            stay = np.repeat(~done, sizes)
            place = np.flatnonzero(stay & (rank == np.repeat(least, sizes)))
            if not len(place):
                break
            place = place[np.r_[True, word[place[1:]] != word[place[:-1]]]]  # the leftmost of each word
            symbol[place] = merged[place]
            stay[place + 1] = False
            moved = np.cumsum(stay) - 1
            symbol, points, word, merged = symbol[stay], points[stay], word[stay], merged[stay]
            place = moved[place]
            anew = np.r_[place, place[place > 0] - 1]
            paired = (anew + 1 < len(word)) & (word[np.minimum(anew + 1, len(word) - 1)] == word[anew])
            merged[anew[~paired]] = -1
            anew = anew[paired]
            merged[anew] = self.merge_of(symbol[anew], symbol[anew + 1])
        return out

    def by_heap(self, word: str) -> tuple[np.ndarray, np.ndarray]:
        """The same merges for one long word, in n log n steps."""
        points = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        symbol = self.first[points].tolist()
        merges = getattr(self, "_merges", None)
        if merges is None:
            merges = self._merges = dict(zip(self.v.pairs.tolist(), self.v.merged.tolist()))
        rank, span, n = self.v.rank, self.v.span, len(symbol)
        left, right, heap = list(range(-1, n - 1)), [*range(1, n), -1], []

        def offer(i: int) -> None:
            j = right[i]
            if j >= 0 and symbol[i] >= 0 and symbol[j] >= 0 and (m := merges.get(symbol[i] * span + symbol[j])) is not None:
                heapq.heappush(heap, (int(rank[m]), i, symbol[i], symbol[j], m))

        for i in range(n - 1):
            offer(i)
        gone = bytearray(n)
        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            j = right[i]
            if gone[i] or j < 0 or symbol[i] != a or symbol[j] != b:
                continue
            symbol[i], gone[j], right[i] = m, 1, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        stay = np.flatnonzero(np.frombuffer(gone, np.uint8) == 0)
        return np.array(symbol, np.int64)[stay], points[stay]

    def learn(self, words: list[str]) -> None:
        short, far = [w for w in words if len(w) <= LONG], [w for w in words if len(w) > LONG]
        parts = []
        for symbol, points in self.rounds(short) + [self.by_heap(w) for w in far]:
            odd = (symbol < 0) | (symbol >= self.v.size)
            if odd.any():  # characters outside the vocabulary as their bytes
                symbol = np.concatenate([self.v.bytes_[list(chr(p).encode())] if o else [s] for s, p, o in zip(symbol, points, odd)])
            parts.append(symbol)
        self.known.update(zip(short + far, range(self.places.n, self.places.n + len(words))))
        lengths = np.array([len(p) for p in parts])
        self.places.add(np.stack([self.ids.n + np.cumsum(lengths) - lengths, lengths], axis=1))
        self.ids.add(np.concatenate(parts))

    def encode(self, texts: list[str], end: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of whole texts, each with the end id if asked for."""
        if len(self.known) > REMEMBERED or self.ids.n > 32 * REMEMBERED:
            self.forget()
        cut = [WORDS.findall(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
        new = dict.fromkeys(w for ws in cut for w in ws if w not in self.known)
        if new:
            self.learn(list(new))
        counts = [len(ws) for ws in cut]
        which = np.fromiter((self.known[w] for ws in cut for w in ws), np.int64, sum(counts))
        starts, lengths = self.places[which].T
        ids = self.ids[ragged(starts, lengths)]
        word_ends = np.concatenate([[0], np.cumsum(lengths)])
        ends = word_ends[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
        if end:
            ids = np.insert(ids, ends[1:], self.v.end)
            ends = ends + np.arange(len(ends))
        return ids, ends


def decoded(v: Vocabulary, ids: np.ndarray, ends: np.ndarray) -> list[str]:
    """The text of each run ids[ends[i]:ends[i + 1]]; the space before the first piece is taken off."""
    if len(ids) and (ids.min() < 0 or ids.max() >= v.size):
        raise ValueError(f"ids must be from 0 to {v.size - 1}")
    lengths = np.diff(v.text_ends)
    data = v.text[ragged(v.text_ends[:-1][ids], lengths[ids])].tobytes()
    at = np.concatenate([[0], np.cumsum(lengths[ids])])[ends]
    out = []
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        first = next((int(x) for x in ids[ends[i]:ends[i + 1]] if lengths[x]), None)
        skip = first is not None and not v.is_byte[first] and data[a:a + 1] == b" "
        out.append(data[a + skip:b].decode("utf-8", "replace"))
    return out


def encode(docs: DataFrame, model_path: str, keys: list[str], text: str = "text", end: bool = True, back: bool = False) -> DataFrame:
    """The key columns and ``ids``, the ids of each whole text with an end id; with ``back`` also ``decoded``, what they decode to.

    The ids are those of the sentencepiece library. NULL and empty texts have the end id alone. Words are remembered within a
    worker, up to REMEMBERED of them; repeated rows are encoded each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model_path))  # as large as the model file
    rows = docs.select(*keys, whole(text).alias("_text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value.encoder()
        for batch in batches:
            for part in slices(batch, "_text"):
                ids, ends = encoder.encode(part["_text"].to_pylist(), end)
                listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                again = [pa.array(decoded(encoder.v, ids, ends), pa.string())] if back else []
                yield pa.RecordBatch.from_arrays([*(part[k] for k in keys), listed, *again], [*keys, "ids", *["decoded"] * back])

    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return in_batches(rows, each, f"{schema}, ids array<int>" + ", decoded string" * back)


def decode(encoded: DataFrame, model_path: str, keys: list[str], ids: str = "ids") -> DataFrame:
    """The key columns, the ids and ``decoded``, their text. NULL ids give an empty text, ids outside the model an error."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(model_path))
    rows = encoded.select(*keys, F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("ids"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch["ids"]
            for at in range(0, batch.num_rows, 512):
                part = column.slice(at, 512)
                ends = part.offsets.to_numpy()
                texts = decoded(shared.value, part.flatten().to_numpy(), ends - ends[0])
                yield pa.RecordBatch.from_arrays([*(batch[k].slice(at, 512) for k in keys), part, pa.array(texts, pa.string())],
                                                 [*keys, "ids", "decoded"])

    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return in_batches(rows, each, f"{schema}, ids array<int>, decoded string")
