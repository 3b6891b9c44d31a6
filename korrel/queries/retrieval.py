"""Text and retrieval queries over documents, benchmark and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korrel.functions import text as t
from korrel.operators import retrieval as r
from korrel.queries import sql as s
from korrel.sources import bindings as b


def normalize_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens and their count per document."""
    return b.table(spark, d, "documents").select("doc_id", F.size(t.tokenize("text")).cast("long").alias("n_tokens"), F.sha2(F.array_join(t.tokenize("text"), " "), 256).alias("tokens_sha256"))


def stem_terms_df(spark: SparkSession, d: str) -> DataFrame:
    """Document and collection frequency of every stem."""
    return r.postings(b.nodes(spark, d)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of every document."""
    return b.table(spark, d, "documents").select("doc_id", F.posexplode(t.sentences("text")).alias("pos", "sentence")).select("doc_id", F.col("pos").cast("long").alias("pos"), "sentence")


def fnv_hash(spark: SparkSession, d: str) -> DataFrame:
    """Hashes of part names."""
    return b.table(spark, d, "part").select("p_partkey", t.fnv1a(F.col("p_name").cast("string")).alias("hash"))


def slugs(spark: SparkSession, d: str) -> DataFrame:
    """Slugs of customer names."""
    return b.table(spark, d, "customer").select("c_custkey", t.slug(F.col("c_name").cast("string")).alias("slug"))


def tfidf_topk(spark: SparkSession, d: str) -> DataFrame:
    """The four best documents of every benchmark item."""
    return r.tfidf_topk(r.term_index(b.nodes(spark, d)), b.questions(spark, d)).select("question_id", "id", "score", "rank")


def vector_context(spark: SparkSession, d: str) -> DataFrame:
    """Their texts as one numbered context."""
    return r.context(tfidf_topk(spark, d), b.nodes(spark, d)).select("question_id", F.length("context").cast("long").alias("n_chars"), F.sha2("context", 256).alias("context_sha256"))


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = b.table(spark, d, "embeddings")
    queries = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), queries


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    """The four nearest others of every fiftieth vector."""
    return r.dense_topk(*_vectors(spark, d)).select("query_id", "id", "score", "rank")


def lexical_seeds(spark: SparkSession, d: str) -> DataFrame:
    """The two documents with most distinct terms of every benchmark item."""
    return r.lexical_seeds(r.term_index(b.nodes(spark, d)), b.questions(spark, d)).select("question_id", "id", "hits", "rank")


def budget_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """As many of sixteen hits as fill a context ten times the question's length."""
    nodes, asked = b.nodes(spark, d), b.questions(spark, d)
    chars = nodes.select("id", (F.length("title") + F.length("summary")).alias("chars"))
    budgets = asked.select(F.col("id").alias("question_id"), (F.length("text") * 10).alias("budget"))
    return r.within_budget(r.tfidf_topk(r.term_index(nodes), asked, 16).select("question_id", "id", "rank"), chars, budgets, 4)


def hybrid_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Lexical seeds, then up to three TF-IDF hits that they lack."""
    index, asked = r.term_index(b.nodes(spark, d)), b.questions(spark, d)
    return r.hybrid(r.lexical_seeds(index, asked).select("question_id", "id", "rank"), r.tfidf_topk(index, asked, 6).select("question_id", "id", "rank"))


def supporting_sentence(spark: SparkSession, d: str) -> DataFrame:
    """The sentence with most stems of the item among its four best documents."""
    return r.supporting_sentence(tfidf_topk(spark, d), b.nodes(spark, d), b.questions(spark, d)).select("question_id", "id", F.sha2("sentence", 256).alias("sentence_sha256"), "hits")


def extractive_answer(spark: SparkSession, d: str) -> DataFrame:
    """Answers of two sentences from the four best documents."""
    return r.extractive_answer(tfidf_topk(spark, d), b.nodes(spark, d), b.questions(spark, d))


def topk_terms(spark: SparkSession, d: str) -> DataFrame:
    """The twelve heaviest terms of every document."""
    return r.term_profiles(b.nodes(spark, d)).select("id", "term", "weight", "rank")


_LINES = f"""lines AS (
  SELECT question_id, id, CAST(pos AS INTEGER) AS pos, sentence, wanted, len(list_distinct(list_intersect(wanted, {s.terms("sentence")}))) AS hits FROM (
    SELECT question_id, id, unnest({s.sentences("summary")}) AS sentence, generate_subscripts({s.sentences("summary")}, 1) AS pos, wanted
    FROM ranked JOIN nodes USING (id) JOIN (SELECT item_id AS question_id, list_distinct({s.terms("text")}) AS wanted FROM benchmark) USING (question_id) WHERE rank <= 4))"""
_SEEDS = f"""hits AS (
  SELECT question_id, id, count(*) AS hits FROM (SELECT item_id AS question_id, unnest(list_distinct({s.terms("text")})) AS term FROM benchmark) JOIN posts USING (term) GROUP BY ALL
), seeds AS (SELECT question_id, id, hits, CAST(row_number() OVER (PARTITION BY question_id ORDER BY hits DESC, id) AS INTEGER) AS rank FROM hits QUALIFY rank <= 2)"""

QUERIES = {
    "tfidf_topk": (tfidf_topk, f"WITH {s.TFIDF} SELECT * FROM ranked WHERE rank <= 4"),
    "normalize_tokens": (normalize_tokens, f"SELECT doc_id, len(k) AS n_tokens, sha256(array_to_string(k, ' ')) AS tokens_sha256 FROM (SELECT doc_id, {s.tokens('text')} AS k FROM documents)"),
    "stem_terms_df": (stem_terms_df, f"WITH {s.POSTINGS} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM posts GROUP BY term"),
    "sentence_split": (sentence_split, f"SELECT doc_id, unnest(k) AS sentence, generate_subscripts(k, 1) - 1 AS pos FROM (SELECT doc_id, {s.sentences('text')} AS k FROM documents)"),
    "fnv_hash": (fnv_hash, "SELECT p_partkey, list_reduce(list_prepend(2166136261::BIGINT, [CAST(ord(c) AS BIGINT) FOR c IN string_split(p_name, '')]), lambda h, c: (xor(h, c) * 16777619) & 4294967295) AS hash FROM part"),
    "slugs": (slugs, f"SELECT c_custkey, 'u_' || left(regexp_replace(regexp_replace({s.normalize('c_name')}, '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 48) AS slug FROM customer"),
    "vector_context": (vector_context, f"WITH {s.TFIDF}, c AS (SELECT question_id, string_agg('[' || rank || '] ' || title || chr(10) || summary, chr(10) || chr(10) ORDER BY rank) AS x FROM ranked JOIN nodes USING (id) WHERE rank <= 4 GROUP BY question_id) SELECT question_id, length(x) AS n_chars, sha256(x) AS context_sha256 FROM c"),
    "dense_topk": (dense_topk, "WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0), x AS (SELECT query_id, vec_id AS id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 6) AS score FROM embeddings JOIN q ON vec_id <> query_id) SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM x QUALIFY rank <= 4"),
    "lexical_seeds": (lexical_seeds, f"WITH {s.POSTINGS}, {_SEEDS} SELECT * FROM seeds"),
    "budget_retrieval": (budget_retrieval, f"WITH {s.TFIDF}, run AS (SELECT question_id, id, rank, CAST(sum(length(title) + length(summary) + 4 + length(CAST(rank AS VARCHAR))) OVER (PARTITION BY question_id ORDER BY rank) + 2 * (rank - 1) AS BIGINT) AS length, 10 * length(b.text) AS budget FROM ranked JOIN nodes USING (id) JOIN benchmark b ON b.item_id = question_id WHERE rank <= 16), z AS (SELECT *, min(CASE WHEN length >= budget AND rank >= 4 THEN rank END) OVER (PARTITION BY question_id) AS stop FROM run) SELECT question_id, id, rank, length FROM z WHERE stop IS NULL OR rank <= stop"),
    "hybrid_retrieval": (hybrid_retrieval, f"WITH {s.TFIDF}, {_SEEDS} SELECT question_id, id, rank, 'first' AS part FROM seeds UNION ALL SELECT question_id, id, k AS rank, 'added' AS part FROM (SELECT question_id, id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY rank) AS INTEGER) AS k FROM (SELECT * FROM ranked WHERE rank <= 6) r ANTI JOIN seeds USING (question_id, id)) WHERE k <= 3"),
    "supporting_sentence": (supporting_sentence, f"WITH {s.TFIDF}, {_LINES} SELECT question_id, id, sha256(trim(regexp_replace(sentence, '[\\t-\\r \\x{{85}}\\x{{a0}}]+', ' ', 'g'))) AS sentence_sha256, CAST(hits AS INTEGER) AS hits FROM lines QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY hits DESC, id, pos) = 1"),
    "extractive_answer": (extractive_answer, f"WITH {s.TFIDF}, {_LINES}, best AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY hits DESC, length(sentence), id, pos) AS k FROM lines WHERE hits > 0 AND length(sentence) > 15 QUALIFY k <= 2) SELECT question_id, string_agg(sentence, ' ' ORDER BY k) AS answer FROM best GROUP BY question_id"),
    "topk_terms": (topk_terms, f"WITH {s.POSTINGS}, p AS (SELECT * FROM posts WHERE length(term) >= 4 AND NOT regexp_full_match(term, '[0-9]+')), w AS (SELECT id, term, round((1 + ln(tf)) * (ln((n + 1) / (df + 1)) + 1), 6) AS weight FROM p JOIN dfs USING (term), size) SELECT id, term, weight, CAST(row_number() OVER (PARTITION BY id ORDER BY weight DESC, term) AS INTEGER) AS rank FROM w QUALIFY rank <= 12"),
}
