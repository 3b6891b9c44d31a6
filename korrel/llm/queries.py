"""Queries of the thirteen operators and of the pipeline, with their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from korrel.llm import decontamination, divergence, html_text, importance, neardup, pii, secrets, sentencepieces, substrings, token_counts, tokenfiles, topk, toxicity
from korrel.plans.scratch import scratch_path


OP2_SQL = r"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x{20}\x{09}-\x{0D}]+') AS w FROM documents),
places AS (SELECT doc_id, i, w[i] AS word, CASE WHEN i + 49 <= len(w) THEN md5(array_to_string(w[i : i + 49], ' ')) END AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM texts)),
firsts AS (SELECT k, min(doc_id) AS first FROM places WHERE k IS NOT NULL GROUP BY k),
marked AS (
  SELECT doc_id, i, word, max(CASE WHEN first < doc_id THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM places LEFT JOIN firsts USING (k)
), kept AS (SELECT doc_id, CAST(sum(gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM marked GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM texts LEFT JOIN kept USING (doc_id)
"""

OP8_SQL = r"""
WITH RECURSIVE texts AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{20}\x{09}-\x{0D}]+') AS w FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + 4], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM texts WHERE len(w) > 0)
), sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT x.doc_id AS a, y.doc_id AS b FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id JOIN sizes p ON p.doc_id = x.doc_id JOIN sizes q ON q.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))
), both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(doc_id, least) USING KEY (doc_id) AS (
  SELECT a, least(a, min(b)) FROM both_ways GROUP BY a
  UNION SELECT e.b, min(r.least) FROM reached r JOIN both_ways e ON e.a = r.doc_id JOIN recurring.reached AS h ON h.doc_id = e.b WHERE r.least < h.least GROUP BY e.b
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(least, doc_id) AS component_id, coalesce(least, doc_id) = doc_id AS kept FROM texts LEFT JOIN sizes USING (doc_id) LEFT JOIN reached USING (doc_id)
"""

OP7_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, x.vec_id AS vec_id, CAST(list_sum([CAST(q.e[i] AS HUGEINT) * x.e[i] FOR i IN range(1, len(q.e) + 1)]) AS BIGINT) AS score
  FROM v q, v x WHERE q.vec_id % 50 = 0 AND x.vec_id <> q.vec_id AND len(x.e) = len(q.e) AND len(q.e) > 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


# CRC-32 by bytes from its table, the table by bits from the reversed polynomial.
OP11_SQL = r"""
WITH bits AS (
  SELECT i, list_reduce(list_prepend(i, [0, 1, 2, 3, 4, 5, 6, 7]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
  FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i)
), crc AS (SELECT list(c ORDER BY i) AS t FROM bits),
words AS (
  SELECT 0 AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM documents
  UNION ALL SELECT 1, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') FROM benchmark
), grams AS (
  SELECT side, id, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))])) AS g FROM words
), counted AS (SELECT side, id, g, count(*) AS n FROM grams GROUP BY ALL),
spelled AS (SELECT g, hex(encode(g)) AS h FROM (SELECT DISTINCT g FROM counted)),
hashed AS (
  SELECT g, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST((instr('0123456789ABCDEF', h[i]) - 1) * 16 + instr('0123456789ABCDEF', h[i + 1]) - 1 AS BIGINT) FOR i IN range(1, len(h), 2)]),
    lambda c, b: xor(c >> 8, t[CAST(xor(c & 255, b) + 1 AS INTEGER)])), 4294967295) % 10000 AS bucket FROM spelled, crc
), sums AS (SELECT bucket, sum(n) FILTER (side = 0) AS s, sum(n) FILTER (side = 1) AS t FROM counted JOIN hashed USING (g) GROUP BY bucket),
whole AS (SELECT CAST(coalesce(sum(s), 0) AS DOUBLE) AS own, CAST(coalesce(sum(t), 0) AS DOUBLE) AS target FROM sums),
gains AS (SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * (own + 10000) / ((CAST(coalesce(s, 0) AS DOUBLE) + 1) * (target + 10000)))) AS BIGINT) AS gain FROM sums, whole),
weights AS (SELECT id, sum(n) AS n, sum(n * gain) AS total FROM counted JOIN hashed USING (g) JOIN gains USING (bucket) WHERE side = 0 GROUP BY id),
draws AS (
  SELECT id AS doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features, len(w) AS n_words,
    CAST(CASE WHEN n IS NULL THEN 0 ELSE (total - ((total % n) + n) % n) // n END AS BIGINT) AS weight,
    CAST(('0x' || substring(sha256('7:' || id), 1, 8)) AS BIGINT) AS h
  FROM words LEFT JOIN weights USING (id) WHERE side = 0
), scored AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0))) AS BIGINT) AS score, doc_id IS NOT NULL AND n_words >= 20 AS able FROM draws),
placed AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, count(*) FILTER (able) OVER () AS n_able FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 25 * n_able // 100 THEN place END AS rank FROM placed
"""

OP12_SQL = r"""
WITH rows AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+') AS w FROM documents
), held AS (SELECT id, lang, source, term, count(*) AS n FROM (SELECT id, lang, source, unnest(w) AS term FROM rows) GROUP BY ALL),
vocabulary AS (SELECT lang, term, sum(n) AS whole FROM held GROUP BY ALL HAVING count(*) >= 30),
sizes AS (SELECT lang, count(*) AS v, sum(whole) AS total FROM vocabulary GROUP BY lang),
own AS (SELECT lang, source, term, sum(n) AS n FROM held SEMI JOIN vocabulary USING (lang, term) GROUP BY ALL),
groups AS (SELECT lang, source, coalesce(any_value(m), 0) AS m FROM (SELECT DISTINCT lang, source FROM rows) LEFT JOIN (SELECT lang, source, sum(n) AS m FROM own GROUP BY ALL) USING (lang, source) GROUP BY ALL),
shares AS (
  SELECT lang, source, term, coalesce(n, 0) AS n,
    CAST(1 + CAST(1000000000 AS HUGEINT) * (coalesce(n, 0) + 5) // (m + 5 * v) AS BIGINT) AS p, CAST(1 + CAST(1000000000 AS HUGEINT) * (whole + 5) // (total + 5 * v) AS BIGINT) AS q
  FROM groups JOIN sizes USING (lang) JOIN vocabulary USING (lang) LEFT JOIN own USING (lang, source, term)
), apart AS (SELECT x.lang, x.source, y.source AS item, CAST(sum(abs(x.p - y.p)) AS BIGINT) AS value FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
pairs AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0) AS value FROM groups x JOIN groups y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN apart a ON a.lang = x.lang AND a.source = x.source AND a.item = y.source),
every AS (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM every)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document."""
    return sentencepieces.digests(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document outside passages of earlier documents."""
    made = substrings.without_repeats(_table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return toxicity.predictions(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secrets.digests(_table(spark, sf_dir, "documents"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.texts(_table(spark, sf_dir, "pages"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document, from a cache that begins empty."""
    counted = token_counts.count(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), scratch_path(spark, "token-counts"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every fiftieth vector."""
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of the documents."""
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in every document."""
    return decontamination.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.digests(_table(spark, sf_dir, "documents"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents, drawn in proportion to their likeness to the benchmark."""
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language are apart, and the terms that each uses more."""
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, read back from the files that they were written to."""
    return tokenfiles.token_files(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query name to function of (spark, sf_dir)."""
    return {f.__name__: f for f in (op1_sentencepiece, op2_repeated_passages, op3_toxicity, op4_secrets, op5_html_text, op6_token_counts, op7_exact_topk, op8_near_duplicates, op9_decontamination, op10_pii, op11_importance, op12_divergence, op13_token_files)} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """Query name to DuckDB SQL."""
    return {"op2_repeated_passages": OP2_SQL, "op8_near_duplicates": OP8_SQL, "op7_exact_topk": OP7_SQL, "op11_importance": OP11_SQL, "op12_divergence": OP12_SQL}
