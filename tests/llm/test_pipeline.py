import re

import corpus_pipeline
from corpus_pipeline import COLUMNS, STAGES

SF = "/root/testdata/sf0.001"


def luhn(number):
    return sum(x - 9 * (x > 9) for x in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(number)))) % 10 == 0


def test_each_stage_takes_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(-1, None, None, None, None), (-2, "", "en", "src1", 0), (-3, "123 456", "en", "src1", 7), (-4, None, "en", None, 0)],
                                  docs.schema)
    docs = docs.unionByName(extra).unionByName(docs.limit(3))
    seen = []
    for name, stage in STAGES:
        docs = stage(spark, docs, SF).cache()
        seen.append(docs.count())
        if name != STAGES[-1][0]:
            assert docs.columns == COLUMNS, name
        if name == "language ID":
            assert docs.where("doc_id < 0").count() == 0 and seen[-1] > 190
        if name == "near-duplicates":
            assert docs.select("doc_id").distinct().count() == seen[-1] < seen[0]
            ids = {r.doc_id for r in docs.collect()}
        if name == "PII":
            assert seen[-1] == seen[-2]
            assert not any(re.search(r"@mail\d", r.text) or any(map(luhn, re.findall(r"\d{16}", r.text))) for r in docs.collect())
            assert docs.where("n_chars <> length(text)").count() == 0
        if name == "mixing":
            assert {r.doc_id for r in docs.select("doc_id").collect()} == ids
        if name == "SentencePiece":
            assert seen[-1] == seen[-2] and docs.where("NOT decodes").count() == 0
    assert len(STAGES) == 5


def test_empty_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100


def test_a_corpus_without_labels_passes_language_id(spark):
    rows = [(i, f"some english words of document {i}", None, "s", 10) for i in range(50)] + [(50, None, None, None, None), (51, "123", None, "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.identified(spark, docs, "")
    assert out.columns == corpus_pipeline.COLUMNS and sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))
