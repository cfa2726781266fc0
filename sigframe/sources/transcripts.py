"""Forced-alignment transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sigframe.functions.arrays import with_value

WORD = (
    "struct<word:string,alignedWord:string,`case`:string,start:double,`end`:double,"
    "startOffset:int,endOffset:int,phones:array<struct<phone:string,duration:double>>>"
)
SCHEMA = f"transcript string, words array<{WORD}>"


def read_transcripts(spark: SparkSession, path: str, start_offset: float | None = None) -> DataFrame:
    """One row per word of every JSON file below ``path``; the file name is the document."""
    raw = spark.read.schema(SCHEMA).json(path, multiLine=True).withColumn("doc", F.input_file_name())
    return word_rows(raw, start_offset)


def parse_transcripts(df: DataFrame, json_col: str, start_offset: float | None = None) -> DataFrame:
    """The same from a (doc, JSON text) table."""
    parsed = df.withColumn("_t", F.from_json(json_col, SCHEMA)).select("doc", "_t.transcript", "_t.words")
    return word_rows(parsed, start_offset)


def filled_line(starts: Column) -> Column:
    """Values filled on the straight line by position: a leading gap stays missing and a trailing one holds the last value."""
    known = lambda v: v.isNotNull() & ~F.isnan(v)
    at = F.filter(F.transform(starts, lambda v, i: F.when(known(v), i)), lambda i: i.isNotNull())

    def stretch(first: Column, k: Column, ats: Column) -> Column:
        """From one known value up to the next, or from the last one to the end."""
        after = F.get(ats, k + 1)
        value = F.get(starts, first)
        slope = (F.get(starts, after) - value) / (after - first)
        places = F.sequence(first, F.coalesce(after, F.size(starts)) - 1)
        return F.transform(places, lambda i: F.when(after.isNull(), value).otherwise(slope * (i - first) + value))

    missing = lambda n: F.array_repeat(F.lit(None).cast("double"), n)
    return with_value(at, lambda ats: F.when(F.size(ats) == 0, missing(F.size(starts))).otherwise(F.concat(
        missing(F.get(ats, F.lit(0))), F.flatten(F.transform(ats, lambda first, k: stretch(first, k, ats))))))


def gaps_after(text: Column, begins: Column, ends: Column) -> Column:
    """The text between each word and the next, or the end; offsets are those of the first character and the one behind the last."""
    def cut(cs: Column) -> Column:
        return F.transform(ends, lambda e, i: F.concat_ws("", F.slice(
            cs, e + 1, F.greatest(F.coalesce(F.get(begins, i + 1), F.length(text)) - e, F.lit(0)))))

    # characters as an array, because finding one by number in a text costs as many steps as stand before it
    return with_value(F.split(text, ""), cut)


def word_rows(docs: DataFrame, start_offset: float | None = None) -> DataFrame:
    """(doc, transcript, words[]) to words with punctuation, filled starts and lower case.

    A file is one row with one word array, so everything that looks at neighbouring words happens
    before the array is exploded: nothing is shuffled.
    """
    part = lambda name: F.transform("words", lambda w: w[name])
    lists = docs.select("doc", "words", F.coalesce("transcript", F.lit("")).alias("text"),
                        part("start").alias("known"), part("startOffset").alias("begins"), part("endOffset").alias("ends"))
    filled = lists.select("doc", "words", filled_line(F.col("known")).alias("s"), gaps_after(F.col("text"), F.col("begins"), F.col("ends")).alias("punctuation"))
    items = F.arrays_zip("words", "s", "punctuation")
    rows = filled.select("doc", F.posexplode(items).alias("pos", "i")).select("doc", "pos", "i.words.*", "i.s", "i.punctuation")
    out = rows.withColumns({"start": F.col("s"), "word": F.lower("word")}).drop("s")
    if start_offset:
        out = out.withColumns({"start": F.col("start") - start_offset, "end": F.col("end") - start_offset})
    return out


def words_of(df: DataFrame, doc_cols: list[str], text_col: str = "text") -> DataFrame:
    """(doc, pos, word) of plain text, split on whitespace."""
    return df.select(*doc_cols, F.posexplode(tokens(F.col(text_col))).alias("pos", "word"))


# Runs of characters that are no white space in the Unicode sense.
WORD_PATTERN = r"[^\s\x1c-\x1f\x85\p{Z}]+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD_PATTERN})"), F.lit(1))


def span_list(text: Column | str) -> Column:
    """Words of each text with inclusive character spans."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    # one mark for a character of a word, another for any other
    marks = F.split(F.regexp_replace(F.regexp_replace(text, WORD_PATTERN[:-1], "x"), "[^x]", " "), "")
    first = lambda cs: lambda c, i: F.when((c == "x") & (F.coalesce(F.get(cs, i - 1), F.lit(" ")) != "x"), i)
    starts = with_value(marks, lambda cs: F.filter(F.transform(cs, first(cs)), lambda i: i.isNotNull()))
    return F.zip_with(tokens(text), starts, lambda w, s: F.struct(w.alias("word"), s.alias("start"), (s + F.length(w) - 1).alias("end")))


def word_spans(df: DataFrame, doc_cols: list[str], text_col: str = "text") -> DataFrame:
    """(pos, word, start, end) of every word."""
    return df.select(*doc_cols, F.posexplode(span_list(text_col)).alias("pos", "s")).select(*doc_cols, "pos", "s.*")
