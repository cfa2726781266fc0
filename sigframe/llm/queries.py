"""The registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sigframe.llm import dedup, language, lines, mixing, pieces, pii, quality, search, sharding, simhash, spelling, trie, urls
from sigframe.llm.common import fold_of, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


# The rules that the query is asked to apply.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query("op3_url_rules", r"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(host_, path_, verdict_) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
f AS (SELECT p.page_id, host, path, host_ || path_ AS rule, verdict_,
             row_number() OVER (PARTITION BY p.page_id ORDER BY length(host_ || path_) DESC) AS nth
      FROM p JOIN r ON (host = host_ OR ends_with(host, '.' || host_)) AND starts_with(path, path_))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict_, 'allow') AS verdict
FROM p LEFT JOIN f ON f.page_id = p.page_id AND f.nth = 1
""")
def op3_url_rules(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge(table(spark, d, "pages"), rules)


@query("op4_hash_tree")
def op4_hash_tree(spark: SparkSession, d: str) -> DataFrame:
    return sharding.shard_rows(table(spark, d, "documents"), shards=8)


@query("op10_term_at_a_time", """
WITH v AS (SELECT DISTINCT vec_id, embedding, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
""")
def op10_term_at_a_time(spark: SparkSession, d: str) -> DataFrame:
    return search.top_k(table(spark, d, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query("op1_language_id")
def op1_language_id(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    held = fold_of(F.col("doc_id"), 3)
    model = language.LanguageModel.train(language.sample(docs.where(held != 1)))
    out = language.identify(docs, model, ["doc_id"])
    return out.select("doc_id", F.coalesce(held == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "bits_per_byte")


@query("op6_sentencepiece")
def op6_sentencepiece(spark: SparkSession, d: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    both = pieces.encode(table(spark, d, "documents"), path, ["doc_id"], back=True)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


@query("op5_quality")
def op5_quality(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    held = fold_of(F.col("doc_id"), 4)
    model = quality.fit(docs.where(held != 2), labels.where(held != 2))
    out = quality.score(docs, model)
    return out.select("doc_id", F.coalesce(held == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op9_line_rules", r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host FROM documents),
w AS (SELECT r, doc_id, host, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
n AS (SELECT r, ws, len(ws) AS n FROM w),
g AS (SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT r, ws, unnest(range(1, n - 6)) AS i FROM n WHERE n > 8)),
gr AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT pos) AS n_repeat_words FROM (SELECT r, i + unnest(range(0, 8)) AS pos FROM gr) GROUP BY r),
l AS (SELECT r, host, i, line, regexp_replace(lower(line), '[^\pL\pN]+', '', 'g') AS key, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words
      FROM (SELECT r, host, ls[i] AS line, i FROM (SELECT r, host, ls, unnest(range(1, len(ls) + 1)) AS i
            FROM (SELECT r, host, string_split(text, chr(10)) AS ls FROM d)))),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE words > 0 GROUP BY r),
f AS (SELECT host, key FROM (SELECT host, key, count(DISTINCT r) AS c FROM l WHERE key <> '' GROUP BY 1, 2)
      JOIN (SELECT host, count(*) AS docs FROM d GROUP BY 1) USING (host) WHERE c > 20 AND (c > docs * 0.01 OR c > 1000)),
lost AS (SELECT r, sum(words) AS n_removed FROM l JOIN f USING (host, key) GROUP BY r),
b AS (SELECT w.r, w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
             CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed
      FROM w LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN lost USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       n_removed, NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - n_removed >= n_words * 0.5 AS kept
FROM b
""")
def op9_line_rules(spark: SparkSession, d: str) -> DataFrame:
    return lines.rules(table(spark, d, "documents"))


@query("op8_pii_trees")
def op8_pii_trees(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    found = pii.find(docs, pii.train(docs), [F.col("doc_id")])
    counts = [F.size(F.array_remove(F.transform("base", lambda s: s["kind"] == i), False)).cast("long").alias(f"n_{k}") for i, k in enumerate(pii.BASE)]
    return found.select("doc_id", *counts, F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


@query("op7_temperature_mix")
def op7_temperature_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"))


@query("op2_minhash_bayes", r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, doc_id, array_to_string(w[i:i + 4], ' ') AS g
      FROM (SELECT r, doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
c AS (SELECT r, doc_id, count(*) AS n, list(g ORDER BY g) AS gs FROM s GROUP BY ALL),
u AS (SELECT gs, any_value(n) AS n, min(doc_id) AS id, row_number() OVER () AS node FROM c GROUP BY gs),
e AS (SELECT node, n, unnest(gs) AS g FROM u),
l AS (SELECT x.node AS a, y.node AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS k
      FROM e x JOIN e y ON x.g = y.g AND x.node < y.node GROUP BY 1, 2),
k AS (SELECT a, b FROM l WHERE 100 * k >= 85 * (na + nb - k)),
edges AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
reach(node, other) AS (SELECT node, node FROM u UNION SELECT reach.node, edges.b FROM reach JOIN edges ON edges.a = reach.other),
m AS (SELECT reach.node, min(u.id) AS component_id FROM reach JOIN u ON u.node = reach.other GROUP BY 1)
SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles, coalesce(m.component_id, d.doc_id) AS component_id,
       d.doc_id = coalesce(m.component_id, d.doc_id) AS kept
FROM d LEFT JOIN c ON c.r = d.r LEFT JOIN u ON u.gs = c.gs LEFT JOIN m ON m.node = u.node
""")
def op2_minhash_bayes(spark: SparkSession, d: str) -> DataFrame:
    out = dedup.near_duplicates(table(spark, d, "documents"), percent=85)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


#: CRC-32 in SQL: a table made from the polynomial, and the fold over the bytes ``b`` of a row.
CRC_TABLE = """crc AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
                        ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i))"""
CRC = "xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295)"


def bytes_sql(text: str) -> str:
    return f"list_transform(range(0, octet_length(encode({text}))), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT))"


@query("op11_prefix_trie", f"""
WITH {CRC_TABLE},
t AS (SELECT conv_id, i, octet_length(encode(text)) AS bytes, m FROM (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, m) AS i FROM (
          SELECT conv_id, turn, coalesce(text, '') AS text, md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS m
          FROM conversations WHERE conv_id IS NOT NULL))),
l AS (SELECT conv_id, count(*) AS n, {bytes_sql("CAST(conv_id AS VARCHAR)")} AS b FROM t GROUP BY conv_id),
h AS (SELECT conv_id, n, conv_id - conv_id % 5 AS base, {CRC} % 9 AS h FROM l, crc),
c AS (SELECT h.*, least(h, coalesce((SELECT n FROM l WHERE l.conv_id = base), 0)) AS head FROM h),
s AS (SELECT c.conv_id, i AS depth, m, bytes FROM c JOIN t ON t.conv_id = base AND i <= head
      UNION ALL SELECT c.conv_id, i - h + head, m, bytes FROM c JOIN t ON t.conv_id = c.conv_id AND i > h),
p AS (SELECT conv_id, depth, bytes, string_agg(m, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM s
      UNION ALL SELECT conv_id, 0, 0, '' FROM c),
n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes FROM p GROUP BY path, depth),
k AS (SELECT substr(path, 1, 32 * (depth - 1)) AS path, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (path, depth)),
a AS (SELECT substr(path, 1, 32 * d) AS path, sum((n_convs - 1) * bytes) AS saved, sum(CAST(n_children = 0 AS BIGINT)) AS leaves
      FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM f) GROUP BY 1),
e AS (SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, max_by(path, depth) AS path FROM p GROUP BY conv_id) GROUP BY path)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(a.leaves AS BIGINT) AS n_leaves,
       CAST(a.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM f JOIN a USING (path) LEFT JOIN e USING (path) LEFT JOIN n u ON u.depth = f.depth - 1 AND u.path = substr(f.path, 1, 32 * (f.depth - 1))
""")
def op11_prefix_trie(spark: SparkSession, d: str) -> DataFrame:
    return trie.prefix_trie(table(spark, d, "conversations"))


@query("op12_spelling", f"""
WITH RECURSIVE {CRC_TABLE},
r AS (SELECT doc_id, run, count(*) AS times FROM (
        SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
        FROM documents) GROUP BY ALL),
h AS (SELECT run, times, {CRC} AS h FROM (SELECT run, times, {bytes_sql("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS b FROM r), crc),
w AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM (
        SELECT times, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h)
      WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
x AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS (SELECT p.word, q.word AS near FROM x p JOIN x q ON p.cut = q.cut AND p.i = q.i AND p.word <> q.word
         UNION SELECT x.word, w.word FROM x JOIN w ON w.word = x.cut UNION SELECT w.word, x.word FROM x JOIN w ON w.word = x.cut),
b AS (SELECT a.word, a.n, near.near, v.n AS near_n, row_number() OVER (PARTITION BY a.word ORDER BY v.n DESC, near.near) AS nth,
             count(*) OVER (PARTITION BY a.word) AS n_near
      FROM w a JOIN near ON near.word = a.word JOIN w v ON v.word = near.near),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form, CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n
      FROM w LEFT JOIN b ON b.word = w.word AND nth = 1),
walk(word, last) AS (SELECT word, word FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.last WHERE f.form IS NOT NULL)
SELECT f.word, f.form, walk.last AS root, f.n, f.n_near, f.form_n
FROM f JOIN walk USING (word) JOIN f g ON g.word = walk.last AND g.form IS NULL
""")
def op12_spelling(spark: SparkSession, d: str) -> DataFrame:
    return spelling.variants(table(spark, d, "documents"))


@query("op13_simhash")
def op13_simhash(spark: SparkSession, d: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, d, "documents"))
