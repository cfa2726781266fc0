import random

import public_tokenizers
import pytest
import sentencepiece

from sigframe.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load(PATH)


def odd_texts():
    rng = random.Random(3)
    fixed = ["", " ", "  a", "a  b", "▁x▁", "a\nb \n c\n\n", "é\0z", "<s>hi</s> <unk>", "x" * 3000, "ab" * 700 + " " + "日本語🙂" * 90,
             " " * 50 + "x" + " " * 33, "\t\ta\r\n", "".join(map(chr, range(1, 2000))), "the " * 5000]
    letters = "aábcdeéthin   \n▁日🙂0.,"
    return fixed + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 400))) for _ in range(60)]


def test_equals_the_library(vocabulary, library):
    texts = odd_texts()
    ids, ends = pieces.Encoder(vocabulary).encode(texts)
    for i, t in enumerate(texts):
        own = ids[ends[i]:ends[i + 1]].tolist()
        assert own == library.encode(t, add_eos=True), t[:40]
    assert pieces.decoded(vocabulary, ids, ends) == [library.decode(library.encode(t)) for t in texts]


def test_heap_and_rounds_agree_and_memory_is_bounded(vocabulary, monkeypatch):
    texts = odd_texts()
    a = pieces.Encoder(vocabulary).encode(texts)
    monkeypatch.setattr(pieces, "LONG", 2)
    b = pieces.Encoder(vocabulary).encode(texts)
    assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()
    monkeypatch.setattr(pieces, "REMEMBERED", 5)
    encoder = pieces.Encoder(vocabulary)
    for i, t in enumerate(texts):
        assert encoder.encode([t])[0].tolist() == a[0][a[1][i]:a[1][i + 1]].tolist()


def test_frames(spark, library):
    rows = [(1, None), (2, ""), (3, "the cat"), (3, "the cat"), (None, "ü\n"), (4, "long words " * 20_000)]
    docs = spark.createDataFrame([(a, b, [9], "q") for a, b in rows], "doc_id long, text string, ids array<int>, decoded string")
    out = pieces.decode(pieces.encode(docs, PATH, ["doc_id"]), PATH, ["doc_id"]).collect()
    assert len(out) == len(rows)
    want = {(a, tuple(library.encode(b or "", add_eos=True)), b or "") for a, b in rows}
    assert {(r.doc_id, tuple(r.ids), r.decoded) for r in out} == want
    assert sorted(map(str, pieces.encode(docs, PATH, ["doc_id"], back=True).collect())) == sorted(map(str, out))
    assert pieces.encode(docs.limit(0), PATH, ["doc_id"]).count() == 0


def test_ids_outside_the_model_are_refused(vocabulary):
    import numpy as np

    with pytest.raises(ValueError, match="ids must be"):
        pieces.decoded(vocabulary, np.array([40000]), np.array([0, 1]))
