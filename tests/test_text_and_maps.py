"""Transcripts, words, predictions, regions and confounds on small fixtures."""

import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigframe.operators import confounds, predictions, regions, words
from sigframe.session import shared_dir
from sigframe.sources import catalog, phonemes, tables, transcripts
from sigframe.workload import load


def write(spark, text, name):
    base = shared_dir(spark)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{base}/{name}")
    return f"{base}/{name}"


def transcript():
    word = lambda w, a, b, start, **k: {"word": w, "alignedWord": w.lower(), "case": "success", "startOffset": a, "endOffset": b, "start": start, "end": (start or 0) + 1, **k}
    text = "Été, Hello — world!"
    return {"transcript": text, "words": [
        word("Été", 0, 3, None), word("Hello", 5, 10, 2.0, phones=[{"phone": "hh_B", "duration": 0.5}, {"phone": "xx_I", "duration": 0.25}, {"phone": "ow_E", "duration": 0.5}]),
        word("world", 13, 18, None, alignedWord="<unk>", phones=[{"phone": "w_B", "duration": 0.5}])]}


def test_read_transcript(spark):
    path = write(spark, json.dumps(transcript()), "t")
    rows = transcripts.read_transcripts(spark, path, start_offset=0.5).orderBy("pos").collect()
    assert [r["word"] for r in rows] == ["été", "hello", "world"]
    assert [r["punctuation"] for r in rows] == [", ", " — ", "!"]
    assert [r["start"] for r in rows] == [None, 1.5, 1.5]
    plain = transcripts.read_transcripts(spark, path).orderBy("pos").collect()
    assert plain[1]["end"] == 3.0


def test_phonemes_keep_time_of_unknown_symbols(spark):
    raw = spark.createDataFrame([("d", json.dumps(transcript()))], "doc string, j string")
    out = words.phoneme_features(transcripts.parse_transcripts(raw, "j"), phonemes.phoneme_table(spark)).orderBy("onset").collect()
    assert [(r["phoneme"], r["onset"], r["type"]) for r in out] == [("HH", 2.0, "aspirate"), ("OW", 2.75, "vowel")]
    assert sum(out[0]["features"]) == 1 and out[0]["features"][15] == 1 and len(out[0]["features"]) == 39


def test_word_spans_and_tokens(spark):
    text = "  a b cc\n d'e-f. "
    df = spark.createDataFrame([("x", text), ("y", "")], "doc string, text string")
    spans = transcripts.word_spans(df, ["doc"]).orderBy("pos").collect()
    assert [text[r["start"]: r["end"] + 1] for r in spans] == text.split() == [r["word"] for r in spans]
    assert [r["word"] for r in transcripts.words_of(df, ["doc"]).orderBy("pos").collect()] == text.split()


ODD_TEXTS = ["", " ", "x", "x x", None, "\u00a0a\u2003b\u3000", "a\x1cb\x85c\u2028d\ne\r\nf\tg\x0bh", "😀 é😀x e\u0301 \u200b \ufeffz", "x\x00y \x00", "$1 \\ ^x$"]


def test_word_spans_need_no_python_and_match_it(spark):
    """Character spans of words as Python's white space has them, of any characters."""
    df = spark.createDataFrame(list(enumerate(ODD_TEXTS)), "doc int, text string")
    out = transcripts.word_spans(df, ["doc"])
    assert "Python" not in out._jdf.queryExecution().toString()
    got = [(r["doc"], r["pos"], r["word"], r["start"], r["end"]) for r in out.orderBy("doc", "pos").collect()]
    assert got == [(d, k, m.group(), m.start(), m.end() - 1) for d, t in enumerate(ODD_TEXTS) for k, m in enumerate(re.finditer(r"\S+", t or ""))]
    assert [f.dataType.simpleString() for f in out.schema][2:] == ["string", "int", "int"]


def test_word_rows_need_no_python_and_match_numpy(spark):
    """Starts on the straight line and gaps of text, with any starts missing, no words and no text."""
    rng = np.random.default_rng(6)
    docs, want = [], {}
    for d, text in enumerate(ODD_TEXTS + ["a, b; c - d e f g. h"] * 30):
        spans = [(m.start(), m.end()) for m in re.finditer(r"\S+", text or "")]
        starts = [None if rng.uniform() < 0.5 else float(np.round(rng.normal(), 3)) if rng.uniform() < 0.9 else float("nan") for _ in spans]
        if d % 7 == 3:
            starts = [None] * len(starts)
        docs.append((d, text, [("W", "w", "success", s, 1.0, a, b, None) for s, (a, b) in zip(starts, spans)]))
        v = np.array([np.nan if s is None else s for s in starts], float)
        at = np.flatnonzero(~np.isnan(v))
        line = [None] * at[0] + np.interp(np.arange(at[0], len(v)), at, v[at]).tolist() if len(at) else [None] * len(v)
        for k, (a, b) in enumerate(spans):
            want[(d, k)] = (line[k], (text or "")[b:spans[k + 1][0] if k + 1 < len(spans) else None])
    docs += [(1000, "text", None), (1001, None, [("W", "w", "success", 2.0, 1.0, 0, 1, None)])]
    want[(1001, 0)] = (2.0, "")
    out = transcripts.word_rows(spark.createDataFrame(docs, f"doc int, transcript string, words array<{transcripts.WORD}>"))
    assert "Python" not in out._jdf.queryExecution().toString()
    assert {(r["doc"], r["pos"]): (r["start"], r["punctuation"]) for r in out.collect()} == want


@pytest.mark.parametrize("bidirectional", [False, True])
@pytest.mark.parametrize("rows", [3, 100])
def test_context_windows(spark, rows, bidirectional):
    w = [f"w{i}" for i in range(10)]
    df = spark.createDataFrame([("d", i, x, "," if i == 2 else " ") for i, x in enumerate(w)], "doc string, pos int, word string, punctuation string")
    out = words.context_strings(df, 4, bidirectional=bidirectional, punctuation=True, rows=rows).orderBy("pos").collect()
    items = [x + ("," if i == 2 else "") for i, x in enumerate(w)]
    for i, r in enumerate(out):
        lo, hi = (max(0, i - 2), i + 3) if bidirectional else (max(0, i - 3), i + 1)
        assert r["context"] == " ".join(items[lo:hi])


def test_context_means_with_unknown_words(spark):
    rng = np.random.default_rng(0)
    docs = {"a": 23, "b": 1, "c": 9}
    rows, want = [], {}
    for d, n in docs.items():
        v = [None if rng.uniform() < 0.3 else rng.normal(size=3) for _ in range(n)]
        for i in range(n):
            rows.append((d, i, None if v[i] is None else [float(x) for x in v[i]]))
            known = [x for x in v[max(0, i - 4): i + 1] if x is not None]
            want[(d, i)] = np.mean(known, axis=0) if known else None
    df = spark.createDataFrame(rows, "doc string, pos int, vector array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        out = words.context_means(df, 5, rows=8).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert len(out) == len(rows)
    for r in out:
        w = want[(r["doc"], r["pos"])]
        assert (w is None) == (r["context_vector"] is None)
        if w is not None:
            np.testing.assert_allclose(r["context_vector"], w)


def test_subword_count_check(spark):
    toks = spark.createDataFrame([("d", 0, 0, [1.0]), ("d", 0, 0, [2.0]), ("d", 1, 0, [4.0])], "doc string, word_pos int, layer int, vec array<double>")
    n = spark.createDataFrame([("d", 2)], "doc string, n_words int")
    got = {r["word_pos"]: list(r["vec"]) for r in words.words_from_subwords(toks, n_words=n).collect()}
    assert got == {0: [3.0], 1: [4.0]}
    with pytest.raises(Exception, match="whitespace split"):
        words.words_from_subwords(toks, n_words=n.withColumn("n_words", F.lit(3))).collect()


@pytest.mark.parametrize("name, step", [("a17_subword_sums", "words_from_subwords"), ("e4_context_vector", "context_means")])
def test_words_carry_one_number_through_shuffles(spark, monkeypatch, name, step):
    """Vectors are folded before they meet their words: what the shuffling step gets has no array of 64 dimensions."""
    seen, real = [], getattr(words, step)
    monkeypatch.setattr(words, step, lambda df, *a, **k: (seen.append(df), real(df, *a, **k))[1])
    load()[0][name](spark, "/root/testdata/sf0.001")
    lists = [f.name for f in seen[0].schema if f.dataType.typeName() == "array"]
    assert all(seen[0].agg(F.max(F.size(c))).first()[0] == 1 for c in lists)


def test_subwords_of_single_numbers(spark):
    toks = spark.createDataFrame([("d", 0, 0, 1.0), ("d", 0, 0, 2.5), ("d", 1, 0, 4.0)], "doc string, word_pos int, layer int, vec double")
    assert {r["word_pos"]: r["vec"] for r in words.words_from_subwords(toks).collect()} == {0: 3.5, 1: 4.0}


@pytest.mark.parametrize("tiles", [1, 3])
def test_silhouette_brute_force(spark, tiles):
    rng = np.random.default_rng(1)
    v, c = rng.normal(size=(30, 4)), np.arange(30) % 3
    c[0] = 9  # a cluster of one scores 0
    df = spark.createDataFrame([(i, int(c[i]), [float(x) for x in v[i]]) for i in range(30)], "word int, cluster int, vector array<double>")
    got = {r["word"]: r["silhouette"] for r in words.silhouette(df, tiles=tiles).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    dist = np.linalg.norm(u[:, None] - u[None], axis=2)
    for i in range(30):
        same = (c == c[i]) & (np.arange(30) != i)
        if not same.any():
            assert got[i] == 0
            continue
        a, b = dist[i][same].mean(), min(dist[i][c == k].mean() for k in set(c) - {c[i]})
        assert got[i] == pytest.approx((b - a) / max(a, b))


def test_silhouette_holds_a_strip_of_small_tiles(spark, monkeypatch):
    """However few tiles are asked for, a task holds so many rows and distances only; copies of an item and single ones count right."""
    seen = []
    for held in ("TILE_ROWS", "DISTANCES"):
        monkeypatch.setattr(words, held, 20)
    kind = type(spark.range(1))
    real = kind.groupBy
    monkeypatch.setattr(kind, "groupBy", lambda df, *c: (seen.append(df) if repr(c) == repr(("a", "b")) else None, real(df, *c))[1])
    rng = np.random.default_rng(4)
    v, c = rng.normal(size=(150, 3)), rng.integers(0, 4, 150)
    v[75:100] = v[:25]
    c[149] = 9
    df = spark.createDataFrame([(i, int(c[i]), [float(x) for x in v[i]]) for i in range(150)], "word int, cluster int, vector array<double>")
    got = {r["word"]: r["silhouette"] for r in words.silhouette(df, tiles=1, normalise=False).collect()}
    dist = np.linalg.norm(v[:, None] - v[None], axis=2)
    means = np.array([[dist[i][(c == k) & (np.arange(150) != i)].mean() if k != 9 or i != 149 else np.nan for k in (0, 1, 2, 3, 9)] for i in range(150)])
    for i in range(149):
        k = [0, 1, 2, 3, 9].index(c[i])
        a, b = means[i][k], np.delete(means[i], k).min()
        assert got[i] == pytest.approx((b - a) / max(a, b), abs=1e-6)
    assert got[149] == 0
    sizes = [r["count"] for r in real(seen[0], "a", "b").count().collect()]
    assert len(sizes) > 30 and max(sizes) < 80
    assert sum(sizes) == 150 * 8  # a row goes to every tile once


def test_density_identity_and_edges(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(6, 4))
    rows = [("g", [float(x) for x in r]) for r in v] + [("g", [0.0] * 4), ("one", [1.0, 0.0, 0.0, 0.0])]
    got = {r["k"]: r["density"] for r in predictions.group_density(spark.createDataFrame(rows, "k string, v array<double>"), ["k"], "v").collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = np.mean([1 - u[i] @ u[j] for i in range(6) for j in range(i)])
    assert got["g"] == pytest.approx(want) and got["one"] is None


def test_prediction_statistics(spark):
    probs = spark.createDataFrame([("r", 0, "a", 0.5), ("r", 0, "b", 0.5), ("r", 1, "a", 0.7), ("r", 1, "c", 0.3), ("r", 2, "c", 1.0), ("r", 2, "a", 0.0)], "run string, pos int, token string, prob double")
    truth = spark.createDataFrame([("r", 0, "B", ["b"]), ("r", 1, "z", ["z", "c"]), ("r", 2, "c", ["c"])], "run string, pos int, word string, tokens array<string>")
    vec = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("c", [0.0, 2.0])], "word string, vector array<float>")
    out = {r["pos"]: r for r in predictions.prediction_statistics(probs, truth, {"word2vec": vec}, n=2).collect()}
    assert out[0]["top_n_predictions"] == ["a", "b"] and out[0]["binary_accuracy"] and out[0]["ground_truth_prob"] == 0.5
    assert out[0]["relative_entropy"] is None and out[0]["entropy"] == pytest.approx(np.log(2))
    assert out[1]["ground_truth_prob"] == pytest.approx(0.15) and out[1]["word2vec_avg_accuracy"] is None and not out[1]["binary_accuracy"]
    # a: .7 ln(.7/.5) - .7 + .5, b: 0 - 0 + .5, c: infinite -> 0
    assert out[1]["relative_entropy"] == pytest.approx(0.7 * np.log(1.4) - 0.2 + 0.5)
    assert out[0]["word2vec_max_accuracy"] == pytest.approx(1) and out[0]["word2vec_prediction_density"] == pytest.approx(1 - np.sqrt(0.5))
    assert out[0]["glove_avg_accuracy"] is None
    assert len(out[0].asDict()) == 2 + 16


def maps(spark):
    a = [("A", i, l) for i, l in enumerate([1, 1, 1, 0, 2, 2, 0, 0])]
    b = [("B", i, l) for i, l in enumerate([1, 1, 1, 1, 2, 3, 3, 0])]
    return spark.createDataFrame(a + b, "atlas string, loc int, label int")


def test_combine_and_overlap(spark):
    combined, info = regions.combine(maps(spark), ["A", "B"], ["B", "A"])
    got = {r["loc"]: r["label"] for r in combined.collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 1, 4: 2, 5: 3, 6: 3}  # A is hidden everywhere
    assert {r["atlas"] for r in info.collect()} == {"B"}
    over = {(r["atlas"], r["label"], r["other_label"]) for r in regions.overlapping_regions(maps(spark), 0.5).collect()}
    assert ("A", 1, 1) in over and ("B", 1, 1) in over and ("A", 2, 2) in over and ("A", 2, 3) in over
    strict = regions.unique_regions(maps(spark), 1.01).count()
    assert strict == 5
    with pytest.raises(ValueError, match="priority names"):
        regions.combine(maps(spark), ["A", "B"], ["C"])


def test_parcels_coverage_edges(spark):
    rows = [(0, 1, 1.0, 1), (1, 1001, 3.0, 0), (2, 2, 5.0, 0), (3, 2, 7.0, 0), (4, 3, None, 1), (5, 0, 9.0, 1)]
    df = spark.createDataFrame(rows, "loc int, label int, value double, mask int")
    got = {r["label"]: (r["value"], r["coverage"]) for r in regions.parcel_values(df).collect()}
    assert got == {1: (1.0, 0.5), 3: (None, 1.0)}
    assert regions.parcel_values(df, coverage_threshold=0.0).count() == 2  # nothing in mask: no parcel 2
    assert [r["loc"] for r in regions.parcel_members(df).orderBy("loc").collect()] == [0, 4]


def test_region_errors_and_names(spark):
    labels = spark.createDataFrame([(1, "x")], "label int, aggregate_label string")
    atlas = maps(spark).where("atlas = 'A'")
    with pytest.raises(ValueError, match="have no column"):
        regions.atlas_mask(atlas, labels, ["x"], label_type="cortex")
    with pytest.raises(Exception, match="no region is named"):
        regions.subset_regions(atlas, labels, ["nope"])[0].collect()
    with pytest.raises(ValueError, match="cannot return"):
        regions.region_maps(atlas, atlas, "raw")
    clean = spark.createDataFrame([("hMT (human MT)",), ("STGa",), ("STGd ",), ("STSv",)], "s string").select(regions.clean_label(F.col("s")).alias("s"))
    assert [r["s"] for r in clean.collect()] == ["hMT", "STG", "STG", "STS"]
    assert regions.region_name(None, regions.labels_in(atlas)).first()["region"] == "A"


def components(spark, values):
    rows = [(f"t_comp_cor_{i}", "tCompCor", True, None, float(s), float(c)) for i, s, c in values]
    return spark.createDataFrame(rows, "name string, method string, retained boolean, mask string, singular_value double, cumulative_variance double")


def test_component_selection(spark):
    comps = components(spark, [(2, 9, 0.5), (10, 5, 0.8), (11, 1, 0.9)])
    names = lambda **k: confounds.component_names(comps, **k)
    assert names(n=2) == ["t_comp_cor_2", "t_comp_cor_10"]
    assert names(n=0.5) == ["t_comp_cor_2", "t_comp_cor_10"]  # the threshold itself is not passed yet
    assert names(n=0.49) == ["t_comp_cor_2"] and len(names(n=99)) == 3
    with pytest.raises(Exception, match="must fall"):
        confounds.component_names(components(spark, [(1, 1, 0.5), (2, 2, 0.8)]), n=1)
    for bad in (dict(n=0), dict(method="pca"), dict(method="aCompCor")):
        with pytest.raises(ValueError):
            names(**bad)
    with pytest.raises(ValueError, match="nothing is retained"):
        confounds.component_names(comps, method="aCompCor", tissue="WM")


def test_confound_groups(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "trans_x int, cosine00 int, cosine01 int, motion_outlier00 int")
    assert confounds.extract_group(df, ["cosine"]).columns == ["cosine00", "cosine01"]
    assert confounds.extract_group(df, "nothing").columns == []
    spec = {"confounds": ["motion_outlier", "trans_x", "cosine"]}
    assert confounds.extract_confounds(df, None, spec).columns == ["trans_x", "motion_outlier00", "cosine00", "cosine01"]


def test_label_files(spark):
    csv = 'Parcel Index,Area Name,Area Description,Aggregate Label,Cortex\n2,MST,"Medial\nArea",hMT (x),C\n'
    row = tables.read_region_table(spark, write(spark, csv, "r")).first()
    assert (row["parcel_index"], row["description"], row["aggregate_label"]) == (2, "Medial\nArea", "hMT (x)")
    lines = tables.read_line_labels(spark, write(spark, "One\n\n  Two \nThree\n", "l")).orderBy("parcel_index").collect()
    assert [tuple(r) for r in lines] == [(1, "One"), (2, "Two"), (3, "Three")]
    vec = tables.read_word_vectors(spark, write(spark, "2 3\ncat 1 2 3\ndog 4 5 6", "v")).orderBy("word").collect()
    assert [(r["word"], list(r["vector"])) for r in vec] == [("cat", [1, 2, 3]), ("dog", [4, 5, 6])]
    assert catalog.modality_features("text") == ["phoneme", "word2vec", "gpt2", "gpt2-xl"] and catalog.modality_features("x") == []
    table = phonemes.read_phonemes(spark, write(spark, "AA\tvowel\nB\tstop", "p"))
    assert [tuple(r) for r in table.orderBy("idx").collect()] == [("AA", "vowel", 0), ("B", "stop", 1)]


def test_written_regressor_is_one_line_in_order(spark):
    import glob

    df = spark.createDataFrame([("a", float(i), f"{i}.00") for i in (5, 3, 1, 4, 2)] + [("b", 1.0, "9.00")], "run string, onset double, regressor string")
    base = shared_dir(spark)
    tables.write_regressor(df, f"{base}/out")
    text = "".join(open(p).read() for p in sorted(glob.glob(f"{base}/out/run=a/part-*"))).strip()
    assert text == "1.00 2.00 3.00 4.00 5.00"


@pytest.mark.parametrize("salts", [1, 5])
def test_word_join_with_one_hot_word(spark, salts):
    rows = [("d", i, "the" if i % 3 else f"w{i % 4}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc string, pos int, word string")
    vec = spark.createDataFrame([("the", [1.0]), ("w0", [2.0])], "word string, vector array<double>")
    out = words.word_vectors(df, vec, salts=salts)
    assert out.count() == sum(w in ("the", "w0") for _, _, w in rows)
    kept = words.word_vectors(df, vec, salts=salts, keep_unknown=True)
    assert kept.count() == 200 and kept.where("vector is null").count() == sum(w not in ("the", "w0") for _, _, w in rows)
