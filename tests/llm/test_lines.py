import re
from collections import Counter

from pyspark.sql import functions as F

from sigframe.llm import lines

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text)
    seen = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if seen[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    own = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(own) - len(set(own)), len(covered), n < 20 or 100 * len(covered) > 30 * n)


def test_base_columns(spark):
    run = "a b c d e f g h "
    texts = [None, "", " \t\n", "one", run, run + run, run * 3 + "x y z", run + "q " + run[2:] + "a b", "w " * 5000, "é# ü|\r\né# ü|\n\n x\x0by",
             "line\nline\nother\n line\nline", " ".join(f"w{i % 97}" for i in range(3000)), " ".join(f"w{i}" for i in range(30000)), "#" * 50_000]
    docs = spark.createDataFrame([(i, t, "h", 3) for i, t in enumerate(texts)] + [(4, run, "h", 3)], "doc_id long, text string, source string, n_words int")
    got = {r.doc_id: tuple(r)[1:7] for r in lines.rules(docs).collect()}
    assert got == {i: brute(t or "") for i, t in enumerate(texts)}
    assert lines.rules(docs).count() == len(texts) + 1 and lines.rules(docs.limit(0)).count() == 0


def test_lines_of_many_documents_are_removed(spark):
    own = lambda i: " ".join(f"w{i}x{j}" for j in range(30))
    rows = [(i, f"Cookie notice: accept ALL!\n{own(i)}", "a") for i in range(40)]
    rows += [(100 + i, "cookie notice accept, all\n" * 8 + own(i), "a") for i in range(3)]
    rows += [(200 + i, f"cookie notice accept all\n{own(i)}", "b") for i in range(5)] + [(300, None, None), (301, own(9), None)]
    rows += [rows[0], rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.n_removed, r.kept) for r in lines.rules(docs, least_docs=20, share=0.1).collect()}
    assert all(got[i] == (4, True) for i in range(40))
    assert all(got[100 + i] == (32, False) for i in range(3))  # 30 of 62 words are left
    assert all(got[200 + i] == (0, True) for i in range(5)) and got[300] == (0, False) and got[301] == (0, True)
    lines_joined, lines.SENT_LINES = lines.SENT_LINES, 0
    try:
        assert {r.doc_id: (r.n_removed, r.kept) for r in lines.rules(docs, least_docs=20, share=0.1).collect()} == got
    finally:
        lines.SENT_LINES = lines_joined


def test_documents_of_shared_lines_are_rejected_at_the_defaults(spark):
    """In a small host and in one where the share alone would spare the line."""
    own = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    shared = "\n".join(" ".join(f"s{k}y{j}" for j in range(12)) for k in range(3))
    rows = [(i, f"{shared}\n{own(i, 10)}", "small") for i in range(30)] + [(100 + i, own(100 + i, 25), "small") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.base_failed, r.n_removed, r.kept) for r in lines.rules(docs).collect()}
    assert all(got[i] == (False, 36, False) for i in range(30)) and all(got[100 + i] == (False, 0, True) for i in range(30))
    large = spark.range(130_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 1100, F.concat(F.lit("a line of one host that goes on for twelve words or so\n"), F.lit("one two three four five six seven eight nine")))
                                        .otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"), F.lit("hot").alias("source"))
    found = lines.frequent(large.select(F.col("source").alias("host"), lines.line_rows(F.col("text")).alias("lines")))
    assert found.count() == 2  # 1,100 of 130,000 documents are below the share of 1 %, above 1,000
