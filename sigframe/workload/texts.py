"""Queries on words, vectors and predicted distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sigframe.functions.arrays import cosine
from sigframe.operators import predictions, words
from sigframe.session import written
from sigframe.sources import catalog, phonemes, transcripts
from sigframe.workload.base import (
    DOC_WORDS_SQL, TURN_WORDS_SQL, WORD_KEY_SQL, doc_words, turn_words, vectors, word_key,
)
from sigframe.workload.registry import query, table

TURN = ("conv_id", "turn")


# -- transcripts: conversation turns become alignment JSON -------------------------------------------

def alignments(spark, d) -> DataFrame:
    """Turns as transcript documents: spans from the text, gaps in ``start``."""
    docs = table(spark, d, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("doc"), "text", transcripts.span_list("text").alias("spans"))

    def word(s, i):
        return F.struct(
            s["word"].alias("word"), F.when(i % 11 == 5, "<unk>").otherwise(F.lower(s["word"])).alias("alignedWord"),
            F.when(i % 13 == 7, "not-found-in-audio").otherwise("success").alias("case"),
            F.when(~(i % 7).isin(0, 3), i * 0.5).alias("start"), (i * 0.5 + 0.25).alias("end"),
            s["start"].alias("startOffset"), (s["end"] + 1).alias("endOffset"))

    words_ = F.transform("spans", word)
    return docs.select("doc", F.to_json(F.struct(F.col("text").alias("transcript"), words_.alias("words"))).alias("json"))


_SPANS = r"""docs AS (SELECT conv_id || '-' || turn AS doc, text, regexp_extract_all(text, '\S+') AS w, regexp_split_to_array(text, '\S+') AS g FROM conversations),
spans AS (SELECT doc, text, len(w) AS n_words, CAST(i - 1 AS INTEGER) AS pos, w[i] AS word,
  CAST(list_sum([length(x) for x in w[1:i - 1]]) AS INTEGER) AS wb, CAST(list_sum([length(x) for x in g[1:i]]) AS INTEGER) AS gb, g[i + 1] AS gap FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM docs)),
at AS (SELECT *, coalesce(wb, 0) + coalesce(gb, 0) AS first FROM spans)""".replace("at AS (", "located AS (")


@query("s1_transcript", f"""WITH {_SPANS}, s AS (SELECT doc, pos, word, gap, CASE WHEN pos % 7 IN (0, 3) THEN NULL ELSE pos * 0.5 END AS s, pos * 0.5 + 0.25 AS e, n_words FROM located)
SELECT doc, pos, lower(word) AS word, gap AS punctuation, CAST(round(CASE WHEN s IS NOT NULL THEN s WHEN pos = 0 THEN NULL WHEN pos = n_words - 1 THEN (pos - 1) * 0.5 ELSE pos * 0.5 END - 1, 6) AS DOUBLE) AS start, CAST(e - 1 AS DOUBLE) AS "end" FROM s""")
def s1_transcript(spark, d):
    out = transcripts.parse_transcripts(alignments(spark, d), "json", start_offset=1.0)
    return out.select("doc", "pos", "word", "punctuation", F.round("start", 6).alias("start"), "end")


@query("fn_word_spans", f"WITH {_SPANS} SELECT doc, pos, word, first AS start, CAST(first + length(word) - 1 AS INTEGER) AS \"end\" FROM located")
def fn_word_spans(spark, d):
    docs = table(spark, d, "conversations").withColumn("doc", F.concat_ws("-", "conv_id", "turn"))
    return transcripts.word_spans(docs, ["doc"])


_PHONES = f"""{TURN_WORDS_SQL}, ok AS (SELECT * FROM turn_words WHERE pos % 13 <> 7 AND pos % 11 <> 5),
ph AS (SELECT conv_id, turn, pos, CAST(i - 1 AS INTEGER) AS phone_pos, replace(upper(lower(word)[i]), 'ẞ', 'SS') AS phoneme, pos * 0.5 + (i - 1) * 0.125 AS onset FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM ok))"""
_SYMBOLS = ", ".join(f"('{p}', {i}, '{k}')" for i, (p, k) in enumerate(phonemes.PHONEMES.items()))


def phone_words(spark, d) -> DataFrame:
    letters = F.filter(F.split(F.lower("word"), ""), lambda c: c != "")
    return turn_words(spark, d).select(
        "conv_id", "turn", "pos", (F.col("pos") * 0.5).alias("start"),
        F.when(F.col("pos") % 13 == 7, "not-found-in-audio").otherwise("success").alias("case"),
        F.when(F.col("pos") % 11 == 5, "<unk>").otherwise(F.lower("word")).alias("alignedWord"),
        F.transform(letters, lambda c: F.struct(F.concat(c, F.lit("_B")).alias("phone"), F.lit(0.125).alias("duration"))).alias("phones"))


@query("w5_phone_onsets", f"WITH {_PHONES} SELECT conv_id, turn, pos, phone_pos, phoneme, CAST(onset AS DOUBLE) AS onset FROM ph")
def w5_phone_onsets(spark, d):
    return words.phone_rows(phone_words(spark, d)).select("conv_id", "turn", "pos", "phone_pos", "phoneme", "onset")


@query("j2_phonemes", f"""WITH {_PHONES}, sym(phoneme, idx, type) AS (VALUES {_SYMBOLS})
SELECT conv_id, turn, pos, phone_pos, type, CAST(onset AS DOUBLE) AS onset, CAST(idx AS INTEGER) AS hot, CAST(1 AS INTEGER) AS total FROM ph JOIN sym USING (phoneme)""")
def j2_phonemes(spark, d):
    out = words.phoneme_features(phone_words(spark, d), phonemes.phoneme_table(spark))
    hot = (F.array_position("features", 1) - 1).cast("int")
    return out.select("conv_id", "turn", "pos", "phone_pos", "type", "onset", hot.alias("hot"),
                      F.aggregate("features", F.lit(0), lambda s, v: s + v).alias("total"))


# -- context -----------------------------------------------------------------------------------------------

# Every dimension of a vector takes part in a comparison, each with a weight of its own.
ALL_DIMS_SQL = "list_sum(list_transform(range(1, 65), lambda i: i * CAST(embedding[i] AS DOUBLE)))"


def all_dims(vector):
    return F.aggregate(F.transform(vector, lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v)


@query("w2_context_left", f"""WITH {DOC_WORDS_SQL}
SELECT doc_id, pos, count(*) OVER w AS n_context, array_to_string(list(word) OVER w, ' ') AS context FROM doc_words
WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def w2_context_left(spark, d):
    out = words.context_strings(doc_words(spark, d), 5, partition_cols=["doc_id"])
    return out.select("doc_id", "pos", F.col("n_context").cast("long").alias("n_context"), "context")


@query("w2_context_bidirectional", f"""WITH {TURN_WORDS_SQL}
SELECT conv_id, turn, pos, array_to_string(list(word) OVER w, ' ') AS context FROM turn_words
WINDOW w AS (PARTITION BY conv_id, turn ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""")
def w2_context_bidirectional(spark, d):
    return words.context_strings(turn_words(spark, d), 6, bidirectional=True, partition_cols=TURN).select("conv_id", "turn", "pos", "context")


@query("w3_context_strings", f"""WITH {TURN_WORDS_SQL}
SELECT conv_id, turn, pos, array_to_string(list(word || ',') OVER w, ' ') AS context FROM turn_words
WINDOW w AS (PARTITION BY conv_id, turn ORDER BY pos ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""")
def w3_context_strings(spark, d):
    marked = turn_words(spark, d).withColumn("punctuation", F.lit(", "))
    out = words.context_strings(marked, 10, punctuation=True, partition_cols=TURN, rows=50)
    return out.select("conv_id", "turn", "pos", "context")


# -- word vectors --------------------------------------------------------------------------------------------

def vector_table(spark, d) -> DataFrame:
    return vectors(spark, d).select(F.col("vec_id").alias("key"), "vector")


def folded_vectors(spark, d) -> DataFrame:
    """Each vector as one weighted sum of all its dimensions, as a vector of that one; sums and means of words' vectors keep the weights, so
    they are folded here, once for each vector, and no word carries 64 numbers through a shuffle."""
    return vector_table(spark, d).select("key", F.array(all_dims(F.col("vector"))).alias("folded"))


@query("j1_word_vectors", f"""WITH {DOC_WORDS_SQL} SELECT doc_id, count(*) AS n_words, round(sum(v), 4) AS vector_sum
FROM (SELECT doc_id, {WORD_KEY_SQL} AS vec_id FROM doc_words) JOIN (SELECT vec_id, {ALL_DIMS_SQL} AS v FROM embeddings) USING (vec_id) GROUP BY doc_id""")
def j1_word_vectors(spark, d):
    keyed = doc_words(spark, d).withColumn("key", word_key(F.col("word")))
    # folded once for each vector, not once for each word
    folded = vector_table(spark, d).withColumn("total", all_dims(F.col("vector")))
    found = words.word_vectors(keyed, folded, word_col="key", row_cols=("doc_id", "pos"))
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_words"), F.round(F.sum("total"), 4).alias("vector_sum"))


@query("j1_word_vectors_keep", f"""WITH {TURN_WORDS_SQL} SELECT conv_id, turn, pos, word, v.vec_id IS NOT NULL AS known, round({ALL_DIMS_SQL}, 5) AS vector_sum
FROM (SELECT *, {WORD_KEY_SQL} AS k FROM turn_words) LEFT JOIN embeddings v ON v.vec_id = k""")
def j1_word_vectors_keep(spark, d):
    keyed = turn_words(spark, d).withColumn("key", word_key(F.col("word")))
    out = words.word_vectors(keyed, vector_table(spark, d), word_col="key", row_cols=(*TURN, "pos"), keep_unknown=True)
    return out.select(*TURN, "pos", "word", F.col("vector").isNotNull().alias("known"), F.round(all_dims(F.col("vector")), 5).alias("vector_sum"))


@query("e4_context_vector", f"""WITH {TURN_WORDS_SQL}, x AS (SELECT t.conv_id, t.turn, t.pos, {ALL_DIMS_SQL} AS v
  FROM (SELECT *, {WORD_KEY_SQL} AS k FROM turn_words) t LEFT JOIN embeddings v ON v.vec_id = t.k)
SELECT conv_id, turn, pos, round(avg(v) OVER (PARTITION BY conv_id, turn ORDER BY pos ROWS BETWEEN 24 PRECEDING AND CURRENT ROW), 5) AS value FROM x""")
def e4_context_vector(spark, d):
    keyed = turn_words(spark, d).withColumn("key", word_key(F.col("word")))
    vec = words.word_vectors(keyed, folded_vectors(spark, d), word_col="key", row_cols=(*TURN, "pos"), keep_unknown=True)
    out = words.context_means(vec, 25, vector_col="folded", partition_cols=TURN)
    return out.select(*TURN, "pos", F.round(F.get("context_vector", F.lit(0)), 5).alias("value"))


@query("e3_batched_encoder", f"WITH {TURN_WORDS_SQL} SELECT conv_id, turn, CAST(length(word) AS INTEGER) AS layer_0, CAST(2 * length(word) AS INTEGER) AS layer_1, pos FROM turn_words")
def e3_batched_encoder(spark, d):
    def lengths(batches):
        for pdf in batches:
            size = pdf["word"].str.len().astype("int32")
            yield pdf[["conv_id", "turn", "pos"]].assign(layer_0=size, layer_1=2 * size)

    return words.encode_batches(turn_words(spark, d), lengths, "conv_id long, turn long, pos int, layer_0 int, layer_1 int", batch_size=256)


@query("a17_subword_sums", f"""WITH {TURN_WORDS_SQL}, sub AS (SELECT conv_id, turn, pos, layer, CAST(length(word) AS INTEGER) AS n, vec_id FROM (SELECT *, {WORD_KEY_SQL} AS vec_id FROM turn_words), (SELECT CAST(unnest([0, 1]) AS INTEGER) AS layer))
SELECT conv_id, turn, pos, layer, round(2 * (layer + 1) * {ALL_DIMS_SQL}, 5) AS value FROM sub JOIN embeddings USING (vec_id)""")
def a17_subword_sums(spark, d):
    """Each word as two subword tokens on two layers."""
    keyed = turn_words(spark, d).withColumn("key", word_key(F.col("word")))
    vec = words.word_vectors(keyed, folded_vectors(spark, d), word_col="key", row_cols=(*TURN, "pos"))
    toks = vec.select(*TURN, "pos", F.explode(F.array(F.lit(0), F.lit(1))).alias("layer"), "folded").select(
        "*", F.explode(F.array(F.lit(0), F.lit(1))).alias("token_pos"))
    toks = toks.withColumn("vec", F.get("folded", F.lit(0)) * (F.col("layer") + 1))
    out = words.words_from_subwords(toks, keys=(*TURN, "pos", "layer"))
    return out.select(*TURN, "pos", "layer", F.round("vec", 5).alias("value"))


@query("a8_basis", """SELECT CAST(i - 1 AS INTEGER) AS dim, round(avg(CAST(embedding[i] AS DOUBLE)) FILTER (WHERE label = 0) - avg(CAST(embedding[i] AS DOUBLE)) FILTER (WHERE label = 1), 6) AS value
FROM (SELECT *, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY i""")
def a8_basis(spark, d):
    b = words.basis_vector(vectors(spark, d), F.col("label") == 0, F.col("label") == 1)
    return b.select(F.posexplode("basis").alias("dim", "value")).withColumn("value", F.round("value", 6))


@query("a9_score", """WITH b AS (SELECT i, avg(CAST(embedding[i] AS DOUBLE)) FILTER (WHERE label = 0) - avg(CAST(embedding[i] AS DOUBLE)) FILTER (WHERE label = 1) AS b FROM (SELECT *, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY i)
SELECT vec_id, round(sum(CAST(embedding[i] AS DOUBLE) * b), 6) AS score FROM embeddings, b GROUP BY 1""")
def a9_score(spark, d):
    v = vectors(spark, d)
    out = words.word_scores(v, words.basis_vector(v, F.col("label") == 0, F.col("label") == 1))
    return out.select("vec_id", F.round("score", 6).alias("score"))


_UNIT = "u AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings)"


@query("a10_density", f"""WITH {_UNIT} SELECT a.label, round(avg(1 - list_cosine_similarity(a.e, b.e)), 6) AS density FROM u a JOIN u b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY 1""")
def a10_density(spark, d):
    return predictions.group_density(vectors(spark, d), ["label"], "vector").select("label", F.round("density", 6).alias("density"))


@query("a11_similarity", f"""WITH {_UNIT}, t AS (SELECT label, min(vec_id) AS k FROM u GROUP BY 1)
SELECT u.label, round(avg(list_cosine_similarity(u.e, w.e)), 6) AS mean_sim, round(max(list_cosine_similarity(u.e, w.e)), 6) AS max_sim FROM u JOIN t USING (label) JOIN u w ON w.vec_id = t.k WHERE u.vec_id <> t.k GROUP BY 1""")
def a11_similarity(spark, d):
    v = vectors(spark, d)
    truth = v.groupBy("label").agg(F.min_by("vector", "vec_id").alias("t"), F.min("vec_id").alias("k"))
    sim = cosine(F.col("vector"), F.col("t"))
    return v.join(truth, "label").where(F.col("vec_id") != F.col("k")).groupBy("label").agg(
        F.round(F.avg(sim), 6).alias("mean_sim"), F.round(F.max(sim), 6).alias("max_sim"))


@query("a18_word_clusters", "SELECT label, array_to_string(list(vec_id ORDER BY vec_id), ' ') AS members, count(*) AS n FROM embeddings GROUP BY label")
def a18_word_clusters(spark, d):
    out = words.clusters(vectors(spark, d), cluster_col="label", word_col="vec_id", part_rows=10**6)
    return out.select("label", F.array_join(F.transform("words", lambda w: w.cast("string")), " ").alias("members"), F.size("words").cast("long").alias("n"))


@query("m13_silhouette", """WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda w: CAST(w AS DOUBLE) * w)))) AS e FROM embeddings),
p AS (SELECT a.vec_id, a.label, b.label AS other, avg(list_distance(a.e, b.e)) AS m FROM u a JOIN u b ON a.vec_id <> b.vec_id GROUP BY 1, 2, 3),
s AS (SELECT vec_id, label, max(m) FILTER (WHERE other = label) AS a, min(m) FILTER (WHERE other <> label) AS b FROM p GROUP BY 1, 2)
SELECT vec_id, label, round(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS silhouette FROM s""")
def m13_silhouette(spark, d):
    out = words.silhouette(vectors(spark, d), id_col="vec_id", cluster_col="label", tiles=4)
    return out.withColumn("silhouette", F.round("silhouette", 6))


@query("m13_kmeans")
def m13_kmeans(spark, d):
    found = words.kmeans_clusters(vectors(spark, d), 10, id_col="vec_id", seed=5)
    return words.silhouette(found, id_col="vec_id", cluster_col="cluster", tiles=4, normalise=False)


# -- predicted distributions: word shares per turn, the turn before as the past ------------------------------

def shares(spark, d) -> DataFrame:
    counts = turn_words(spark, d).groupBy(*TURN, F.lower("word").alias("token")).agg(F.count(F.lit(1)).alias("c"))
    total = counts.groupBy(*TURN).agg(F.sum("c").alias("n"))
    return counts.join(total, list(TURN)).select(F.col("conv_id").alias("run"), F.col("turn").alias("pos"), "token", (F.col("c") / F.col("n")).alias("prob"))


def truths(spark, d) -> DataFrame:
    """The last word of each turn is what had to be predicted."""
    last = turn_words(spark, d).groupBy(*TURN).agg(F.max_by("word", "pos").alias("word"))
    return last.select(F.col("conv_id").alias("run"), F.col("turn").alias("pos"), F.lower("word").alias("word"), F.array(F.lower("word")).alias("tokens"))


_SHARES = f"""{TURN_WORDS_SQL}, cnt AS (SELECT conv_id AS run, turn AS pos, lower(word) AS token, count(*) AS c FROM turn_words GROUP BY 1, 2, 3),
shares AS (SELECT run, pos, token, c / sum(c) OVER (PARTITION BY run, pos) AS prob FROM cnt),
truths AS (SELECT conv_id AS run, turn AS pos, lower(max_by(word, pos)) AS word FROM turn_words GROUP BY 1, 2),
ent AS (SELECT run, pos, -sum(prob * ln(prob)) AS entropy FROM shares GROUP BY 1, 2),
nxt AS (SELECT run, pos + 1 AS pos, token, prob AS q FROM shares),
kl AS (SELECT run, pos, sum(CASE WHEN prob IS NULL THEN q WHEN q IS NULL THEN 0 ELSE prob * ln(prob / q) - prob + q END) AS kl, count(prob) AS np, count(q) AS nq
  FROM shares FULL JOIN nxt USING (run, pos, token) GROUP BY 1, 2),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run, pos ORDER BY prob DESC, token) AS rank FROM shares) WHERE rank <= 3)"""


@query("a12_entropy", f"WITH {_SHARES} SELECT run, pos, round(entropy, 6) AS entropy FROM ent")
def a12_entropy(spark, d):
    return predictions.entropy(shares(spark, d)).withColumn("entropy", F.round("entropy", 6))


@query("a13_relative_entropy", f"WITH {_SHARES} SELECT run, pos, CASE WHEN nq > 0 THEN round(kl, 6) END AS relative_entropy FROM kl WHERE np > 0")
def a13_relative_entropy(spark, d):
    return predictions.relative_entropy(shares(spark, d)).withColumn("relative_entropy", F.round("relative_entropy", 6))


@query("j16_previous", f"WITH {_SHARES} SELECT run, pos, token, round(coalesce(prob, 0), 9) AS p, round(coalesce(q, 0), 9) AS q FROM shares FULL JOIN nxt USING (run, pos, token)")
def j16_previous(spark, d):
    return predictions.with_previous(shares(spark, d)).withColumns({c: F.round(c, 9) for c in ("p", "q")})


@query("a14_softmax", f"""WITH {_SHARES}, l AS (SELECT run, pos, token, c / 3.0 AS logit FROM cnt)
SELECT run, pos, token, round(exp(logit - max(logit) OVER w) / (sum(exp(logit)) OVER w / exp(max(logit) OVER w)), 9) AS prob FROM l WINDOW w AS (PARTITION BY run, pos)""")
def a14_softmax(spark, d):
    counts = turn_words(spark, d).groupBy(F.col("conv_id").alias("run"), F.col("turn").alias("pos"), F.lower("word").alias("token")).agg(
        (F.count(F.lit(1)) / 3.0).alias("logit"))
    return predictions.softmax(counts).select("run", "pos", "token", F.round("prob", 9).alias("prob"))


@query("e5_last_position", f"""WITH {TURN_WORDS_SQL}, l AS (SELECT conv_id AS run, turn, pos, word AS token, length(word) / 4.0 AS logit FROM turn_words),
k AS (SELECT * FROM l QUALIFY pos = max(pos) OVER (PARTITION BY run, turn) - 1)
SELECT run, turn, token, logit FROM k""".replace("length(word) / 4.0", "CAST(length(word) / 4.0 AS DOUBLE)"))
def e5_last_position(spark, d):
    rows = turn_words(spark, d).select(F.col("conv_id").alias("run"), "turn", F.col("pos").alias("token_pos"), F.col("word").alias("token"), (F.length("word") / 4.0).alias("logit"))
    out = predictions.last_logits(rows, keys=("run", "turn"), masked=True)
    return out.select("run", "turn", "token", F.col("logit").cast("double").alias("logit"))


@query("t1_topn", f"WITH {_SHARES} SELECT run, pos, token, round(prob, 9) AS prob, CAST(rank AS INTEGER) AS rank FROM top")
def t1_topn(spark, d):
    return predictions.top_n(shares(spark, d), 3).withColumn("prob", F.round("prob", 9))


@query("a15_word_prob", f"WITH {_SHARES} SELECT t.run, t.pos, round(avg(coalesce(prob, 0)), 9) AS ground_truth_prob FROM (SELECT run, pos, unnest([word, word || 's']) AS token FROM truths) t LEFT JOIN shares USING (run, pos, token) GROUP BY 1, 2")
def a15_word_prob(spark, d):
    t = truths(spark, d).withColumn("tokens", F.array("word", F.concat("word", F.lit("s"))))
    return predictions.word_prob(t, shares(spark, d)).withColumn("ground_truth_prob", F.round("ground_truth_prob", 9))


def word_vector_table(spark, d) -> DataFrame:
    """Vocabulary with vectors: every distinct word whose key is in the vector table."""
    vocab = turn_words(spark, d).select(F.lower("word").alias("word")).distinct().withColumn("key", word_key(F.col("word")))
    return vocab.join(vector_table(spark, d), "key").select("word", "vector")


_SIM = f"""wv AS (SELECT word, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e FROM (SELECT DISTINCT lower(word) AS word, {WORD_KEY_SQL} AS vec_id FROM turn_words) JOIN embeddings USING (vec_id)),
pv AS (SELECT top.run, top.pos, top.rank, p.e, list_cosine_similarity(p.e, t.e) AS cos FROM top JOIN truths USING (run, pos) JOIN wv p ON p.word = top.token JOIN wv t ON t.word = truths.word),
sim AS (SELECT run, pos, avg(cos) AS mean_cos, max(cos) AS max_cos FROM pv GROUP BY 1, 2),
den AS (SELECT a.run, a.pos, avg(1 - list_cosine_similarity(a.e, b.e)) AS density FROM pv a JOIN pv b ON a.run = b.run AND a.pos = b.pos AND a.rank < b.rank GROUP BY 1, 2)"""


@query("j12_similarity", f"WITH {_SHARES}, {_SIM} SELECT run, pos, round(mean_cos, 6) AS avg_accuracy, round(max_cos, 6) AS max_accuracy, round(density, 6) AS prediction_density FROM sim LEFT JOIN den USING (run, pos)")
def j12_similarity(spark, d):
    top = predictions.top_n(shares(spark, d), 3)
    out = predictions.similarity(top, truths(spark, d), written(word_vector_table(spark, d)))
    return out.withColumns({c: F.round(c, 6) for c in ("avg_accuracy", "max_accuracy", "prediction_density")})


@query("a16_model_statistics", f"""WITH {_SHARES}, {_SIM},
tl AS (SELECT run, pos, array_to_string(list(token ORDER BY rank), ' ') AS top_n, max(prob) AS top_prob FROM top GROUP BY 1, 2)
SELECT run, pos, word AS ground_truth_word, round(prob, 9) AS ground_truth_prob, top_n, round(top_prob, 9) AS top_prob,
  word IN (SELECT token FROM top WHERE top.run = t.run AND top.pos = t.pos) AS binary_accuracy, round(mean_cos, 6) AS glove_avg_accuracy, round(max_cos, 6) AS glove_max_accuracy,
  round(density, 6) AS glove_prediction_density, CAST(NULL AS DOUBLE) AS word2vec_avg_accuracy, round(entropy, 6) AS entropy, CASE WHEN nq > 0 THEN round(kl, 6) END AS relative_entropy
FROM truths t JOIN tl USING (run, pos) JOIN (SELECT run, pos, token AS word, prob FROM shares) s USING (run, pos, word) LEFT JOIN sim USING (run, pos) LEFT JOIN den USING (run, pos) JOIN ent USING (run, pos) JOIN kl USING (run, pos)""")
def a16_model_statistics(spark, d):
    # predictions, truth and vectors are stored tables to the operator
    inputs = [written(t(spark, d)) for t in (shares, truths, word_vector_table)]
    out = predictions.prediction_statistics(inputs[0], inputs[1], {"glove": inputs[2]}, n=3)
    return out.select(
        "run", "pos", "ground_truth_word", F.round("ground_truth_prob", 9).alias("ground_truth_prob"), F.array_join("top_n_predictions", " ").alias("top_n"),
        F.round("top_prob", 9).alias("top_prob"), "binary_accuracy",
        *[F.round(f"glove_{c}", 6).alias(f"glove_{c}") for c in ("avg_accuracy", "max_accuracy", "prediction_density")],
        "word2vec_avg_accuracy", F.round("entropy", 6).alias("entropy"), F.round("relative_entropy", 6).alias("relative_entropy"))


_MODALITY = " ".join(f"WHEN '{lang}' THEN '{m}'" for lang, m in (("en", "audiovisual"), ("fr", "audio"), ("de", "text"), ("es", "visual")))
_CATALOG = ", ".join(f"('{m}', {i}, '{f}')" for m in catalog.MODALITIES for i, f in enumerate(catalog.modality_features(m)))


@query("s14_modality_features", f"""WITH c(modality, rank, feature) AS (VALUES {_CATALOG})
SELECT modality, CAST(rank AS INTEGER) AS rank, feature, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM (SELECT *, CASE lang {_MODALITY} END AS modality FROM documents) JOIN c USING (modality) GROUP BY 1, 2, 3""")
def s14_modality_features(spark, d):
    modality = F.when(F.col("lang") == "en", "audiovisual").when(F.col("lang") == "fr", "audio").when(F.col("lang") == "de", "text").when(F.col("lang") == "es", "visual")
    # totals per modality first, so the catalogue never multiplies document rows
    totals = table(spark, d, "documents").groupBy(modality.alias("modality")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("n_chars"))
    return totals.join(catalog.modality_table(spark), "modality").select("modality", "rank", "feature", "n_docs", "n_chars")
