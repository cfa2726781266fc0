"""Quality rules over documents and over lines that many documents of a host share.

Base rules need one document. The method looks across documents: lines are normalised and hashed, the documents of a host that
have a line are counted, lines above the limit of their host are removed, and documents that lose too much are rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sigframe.llm.common import WORD, bound_once, whole
from sigframe.session import written

WINDOW = 8
#: A line is removed in a host if it stands in more documents than LEAST_DOCS and in more than this share of the host's, or, in a
#: host of any size, in more than MOST_DOCS.
LEAST_DOCS, SHARE, MOST_DOCS = 20, 0.01, 1000
#: A document is rejected if less than this share of its words is left.
LEFT = 0.5
#: Frequent lines above this number are joined by shuffle; fewer (16 bytes each) are sent to every task.
SENT_LINES = 200_000

LETTERS_ONLY = r"[^\p{L}\p{N}]+"


def repeated_words(words: Column) -> Column:
    """Words that lie in an 8-word window which the text has twice or more, the first one included.

    Windows are 64-bit hashes of eight word hashes. Only if some repeat are they sorted, with their places, so that equal
    ones are neighbours; each place then covers the words up to the next place, eight at most.
    """
    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(WINDOW))))

    def covered(w: Column) -> Column:
        placed = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
        return bound_once(placed, lambda p: bound_once(
            F.array_sort(F.transform(F.filter(p, lambda x, i: (x["h"] == F.get(p, i - 1)["h"]) | (x["h"] == F.get(p, i + 1)["h"])), lambda x: x["at"])),
            lambda at: F.aggregate(F.transform(at, lambda a, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - a, F.lit(WINDOW)))),
                                   F.lit(0), lambda s, n: s + n)))

    counted = bound_once(F.transform(words, lambda w: F.xxhash64(w)), lambda h: bound_once(
        windows(h), lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w))))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(counted).cast("long")


def base(docs: DataFrame, keep: list[Column], text: str = "text") -> DataFrame:
    """The columns ``keep`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed of every whole text.

    Line and word borders, and what fails, are those of the module; NULL text counts as empty. No shuffle.
    """
    t = whole(text)
    rows = docs.select(*keep, t.alias("_text"), F.regexp_extract_all(t, F.lit(f"({WORD})")).alias("_words"))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    dup = bound_once(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    symbols = F.length("_text") - F.length(F.regexp_replace("_text", r"[#*$%&|<>]", ""))
    out = rows.select("*", F.size("_words").cast("long").alias("n_words"), F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
                      symbols.cast("long").alias("n_symbols"), dup.cast("long").alias("n_dup_lines"),
                      repeated_words(F.col("_words")).alias("n_repeat_words"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.drop("_words").withColumn("base_failed", failed)


def normal(line: Column) -> Column:
    """A line without anything but small letters and digits, so that spacing, case and marks do not matter."""
    return F.regexp_replace(F.lower(line), LETTERS_ONLY, "")


def line_rows(text: Column) -> Column:
    """(hash, words) of each distinct normalised line with a letter or digit; ``words`` are those of all lines that are equal to it."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.struct(normal(x).alias("key"), F.regexp_count(x, F.lit(WORD)).alias("words")))
    hashed = F.transform(F.filter(lines, lambda x: x["key"] != ""), lambda x: F.struct(F.xxhash64(x["key"]).alias("hash"), x["words"].alias("words")))
    return hashed


def frequent(rows: DataFrame, least_docs: int = LEAST_DOCS, share: float = SHARE, most_docs: int = MOST_DOCS) -> DataFrame:
    """(host, hash) of lines in more documents of the host than its limits: ``rows`` has host, lines."""
    docs = rows.groupBy("host").agg(F.count(F.lit(1)).alias("docs"))
    seen = rows.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["hash"]))).alias("hash"))
    seen = seen.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least_docs)
    over = seen.join(docs, "host").where((F.col("n") > F.col("docs") * share) | (F.col("n") > most_docs))
    return over.select("host", "hash")


def rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", least_docs: int = LEAST_DOCS,
          share: float = SHARE, left: float = LEFT, most_docs: int = MOST_DOCS) -> DataFrame:
    """doc_id, the base columns, n_removed (words in removed lines), and kept.

    A document is kept unless a base rule fails or less than ``left`` of its words remain. Every row counts as one document of its
    host, repeated rows as well; rows without a host form one host of their own. A document without words fails the base rules.
    """
    source = F.coalesce(F.col(host).cast("string"), F.lit(""))
    lines = docs.select(source.alias("host"), line_rows(whole(text)).alias("lines"))
    common = written(frequent(lines, least_docs, share, most_docs), "lines")
    few = common.count() <= SENT_LINES
    key = [F.col(doc_id).alias("doc_id"), source.alias("host"), F.xxhash64(whole(text)).alias("text_hash")]
    measured = base(docs, key, text).drop("_text")
    each = docs.select(*key, F.posexplode(line_rows(whole(text))).alias("nth", "line"))
    each = each.select("doc_id", "host", "text_hash", "nth", F.col("line.hash").alias("hash"), F.col("line.words").alias("words"))
    hit = each.join(F.broadcast(common) if few else common, ["host", "hash"])
    # equal rows have equal lines: each line counts once for a key
    lost = hit.groupBy("doc_id", "host", "text_hash", "nth").agg(F.first("words").alias("words"))
    lost = lost.groupBy("doc_id", "host", "text_hash").agg(F.sum("words").alias("removed"))
    same = measured["doc_id"].eqNullSafe(lost["doc_id"]) & (measured["text_hash"] == lost["text_hash"]) & (measured["host"] == lost["host"])
    out = measured.join(lost, same, "left").drop(lost["doc_id"]).drop(lost["host"]).drop(lost["text_hash"])
    removed = F.coalesce(F.col("removed"), F.lit(0)).cast("long")
    kept = ~F.col("base_failed") & ((F.col("n_words") - removed) >= F.col("n_words") * left)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      removed.alias("n_removed"), kept.alias("kept"))
