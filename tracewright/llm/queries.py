"""The registered queries of the corpus operators, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import classifier, embedding_dedup, hard_negatives, line_dedup, mixing, ngram_join, packing, pii, quality_rules, secret_scan, spelling, token_files, topk_search
from tracewright.llm.common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk_search.quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk_search.top_k(rows, F.col("id") % 50 == 0, 5)


OP2_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(list_zip(q.w, d.w), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM e q JOIN e d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5
"""


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = token_files.write(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return token_files.read(token_files.placed(index)).select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.cut(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return packing.pack(pieces)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secret_scan.scan(table(spark, sf_dir, "documents"))
    rows = rows.withColumn("base", F.filter("spans", lambda s: s["kind"] != secret_scan.ADDED))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in secret_scan.KINDS]
    return rows.select("doc_id", *counts, F.sha2(pii.listed("base").cast("binary"), 256).alias("base_sha256"), pii.listed("spans").alias("spans"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed_lines", "text")


OP7_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
v AS (SELECT *, CAST('0x' || substr(md5(line), 1, 12) AS BIGINT) AS v, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM l),
m AS (SELECT *, i > 0 AND (lag(v, 1, 0) OVER w * 31 + v) % 1021 < 510 AS m FROM v WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
e AS (SELECT *, m AND NOT lag(m, 1, FALSE) OVER w AS stop FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT *, coalesce(sum(CAST(stop AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM e),
t AS (SELECT doc_id, i, words, sum(least(words, 50)) OVER (PARTITION BY doc_id ORDER BY i) AS so_far FROM v),
w AS (SELECT a.doc_id, a.i AS a, min(b.i) AS z FROM t a JOIN t b ON b.doc_id = a.doc_id AND b.i >= a.i AND b.so_far - a.so_far + least(a.words, 50) >= 50 GROUP BY 1, 2
  UNION SELECT b.doc_id, max(a.i), b.i FROM t a JOIN t b ON b.doc_id = a.doc_id AND b.i >= a.i AND b.so_far - a.so_far + least(a.words, 50) >= 50 GROUP BY b.doc_id, b.i),
u AS (SELECT doc_id, 0 AS sort, min(i) AS place, count(*) AS size, string_agg(line, chr(10) ORDER BY i) AS unit FROM c GROUP BY doc_id, k HAVING count(*) > 1
  UNION ALL SELECT w.doc_id, 3, a, z - a + 1, string_agg(line, chr(10) ORDER BY i) FROM w JOIN l ON l.doc_id = w.doc_id AND l.i BETWEEN a AND z WHERE z > a GROUP BY w.doc_id, a, z UNION ALL SELECT doc_id, 2, i, 1, line FROM v WHERE words >= 50),
f AS (SELECT *, doc_id <> first_value(doc_id) OVER o OR place >= first_value(place) OVER o + size AS later FROM u WHERE regexp_matches(unit, '[^\x20\x09-\x0D]') WINDOW o AS (PARTITION BY sort, unit ORDER BY doc_id, place)),
x AS (SELECT DISTINCT doc_id, unnest(range(place, place + size)) AS i, TRUE AS gone FROM f WHERE later),
y AS (SELECT l.*, coalesce(gone, FALSE) AS gone FROM l LEFT JOIN x ON x.doc_id = l.doc_id AND x.i = l.i)
SELECT d.doc_id, count(i) AS n_lines, count(*) FILTER (gone) AS n_removed_lines,
  CASE WHEN any_value(d.text) IS NOT NULL THEN coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') END AS text
FROM documents d LEFT JOIN y ON d.doc_id = y.doc_id GROUP BY d.doc_id
"""


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classifier.score(docs, classifier.train(docs, table(spark, sf_dir, "labels")))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in pii.KINDS]
    return rows.select("doc_id", *counts, F.sha2(pii.listed("base").cast("binary"), 256).alias("base_sha256"), pii.listed("spans").alias("spans"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = topk_search.quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", label=noisy)
    return hard_negatives.mine(rows, F.col("id") % 100 == 0)


OP11_SQL = """
WITH e AS (SELECT row_number() OVER () AS nth, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.nth, q.vec_id AS anchor_id, d.vec_id, d.nth AS other, q.label = d.label AS same, CAST(list_sum(list_transform(list_zip(q.w, d.w), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM e q JOIN e d ON q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id AND len(q.w) = len(d.w)),
p AS (SELECT *, row_number() OVER (PARTITION BY nth ORDER BY score DESC, vec_id) AS place FROM s WHERE same),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.nth, p.place ORDER BY s.score DESC, s.vec_id) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.nth = p.nth AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score WHERE place <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.9)


OP12_SQL = """
WITH RECURSIVE e AS (SELECT row_number() OVER () AS nth, vec_id, CASE WHEN len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN CAST(embedding AS DOUBLE[]) END AS v FROM embeddings),
l AS (SELECT a.nth AS a, b.nth AS b FROM e a JOIN e b ON a.nth <> b.nth AND len(a.v) = len(b.v) AND CASE WHEN len(a.v) = len(b.v) THEN list_cosine_similarity(a.v, b.v) >= 0.9 END),
r AS (SELECT nth, nth AS node FROM e UNION SELECT r.nth, l.b FROM r JOIN l ON l.a = r.node),
c AS (SELECT r.nth, min(e.vec_id) AS component_id FROM r JOIN e ON e.nth = r.node GROUP BY 1),
n AS (SELECT a AS nth, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM e JOIN c ON c.nth = e.nth LEFT JOIN n ON n.nth = e.nth
"""


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents"), typo_every=199, least_length=6, least_count=5), ratio=5)


OP5_SQL = r"""
WITH d AS (SELECT doc_id, source, text, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, CAST([3, 1, 2][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight FROM s0),
s2 AS (SELECT *, source_size * 2.0::DOUBLE / weight AS ratio FROM s1),
s3 AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(source_size) OVER b, 0) * 2.0::DOUBLE)
           / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0.0)) AS level FROM s2
       WINDOW b AS (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min(level, ratio) AS level FROM s3 WHERE ratio >= level),
s4 AS (SELECT s3.source, source_size, CASE WHEN l.level IS NULL OR ratio <= l.level THEN source_size * 2.0::DOUBLE ELSE l.level * weight END AS target FROM s3, l),
w AS (SELECT source, size, (length(to_base(size + 1, 2)) + 3) / 4.0::DOUBLE AS wish FROM d),
w0 AS (SELECT source, wish, CAST(sum(size) AS BIGINT) AS words FROM w GROUP BY source, wish),
w1 AS (SELECT w0.*, source_size, target, (target - coalesce(sum(words) OVER a, 0) * 2.0::DOUBLE) / nullif(sum(wish * words) OVER (PARTITION BY w0.source) - coalesce(sum(wish * words) OVER a, 0), 0) AS scale
       FROM w0 JOIN s4 ON w0.source IS NOT DISTINCT FROM s4.source WINDOW a AS (PARTITION BY w0.source ORDER BY wish DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
w2 AS (SELECT source, arg_max(scale, wish) AS scale, max(wish) AS top FROM w1 WHERE scale * wish < 2 GROUP BY source),
r AS (SELECT d.doc_id, d.source, size, source_size, target,
        CASE WHEN source_size = 0 THEN 0 WHEN top IS NULL OR (length(to_base(size + 1, 2)) + 3) / 4.0::DOUBLE > top THEN 2.0::DOUBLE ELSE greatest(0, scale * ((length(to_base(size + 1, 2)) + 3) / 4.0::DOUBLE)) END AS copies,
        (CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, '')))), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0::DOUBLE AS u
      FROM d JOIN s4 ON d.source IS NOT DISTINCT FROM s4.source LEFT JOIN w2 ON d.source IS NOT DISTINCT FROM w2.source),
q AS (SELECT *, floor(copies) AS whole, copies - floor(copies) AS p FROM r),
k AS (SELECT *, CASE WHEN p > 0 THEN u / (1.0::DOUBLE - u) / (p / (1.0::DOUBLE - p)) END AS rnk FROM q),
c AS (SELECT *, coalesce(sum(CASE WHEN p > 0 THEN size END) OVER (PARTITION BY source ORDER BY rnk, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
        target - sum(whole * size) OVER (PARTITION BY source) AS lacks FROM k)
SELECT doc_id, size, source_size, target,
  CAST(size * (whole + CASE WHEN p > 0 AND before + size / 2.0::DOUBLE <= lacks THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM c
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_exact_topk, op3_token_files, op4_best_fit_packing, op5_source_mixing, op6_secret_scan, op7_line_dedup, op8_quality_classifier, op9_ngram_jaccard_join, op10_pii_sanitisation, op11_hard_negatives, op12_embedding_dedup, op13_spelling_variants)}


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_topk": OP2_SQL, "op5_source_mixing": OP5_SQL, "op7_line_dedup": OP7_SQL, "op11_hard_negatives": OP11_SQL, "op12_embedding_dedup": OP12_SQL}
