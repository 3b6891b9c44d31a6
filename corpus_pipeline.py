"""A corpus from raw documents: five stages, each stored before the next one reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korrel.llm import decontamination, neardup, secrets, sentencepieces, toxicity
from korrel.plans.scratch import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on labelled rows of this stage's input, does not reject."""
    lexicon = toxicity.fit(docs, _table(spark, sf_dir, "labels").filter(~toxicity.held_out()))
    return toxicity.score(docs, lexicon, to="toxicity").filter(F.col("toxicity") < toxicity.THRESHOLD).select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group.

    Rows with a null doc_id are in no group and all stay. Rows that repeat a doc_id are one document with all their
    links: none stays where any of them is a copy, else one does, the first by text, lang, source and n_chars (nulls
    last).
    """
    found = neardup.near_duplicates(docs).filter("doc_id is not null").groupBy("doc_id").agg(F.min("kept").alias("kept"), F.count("*").alias("n"))
    marked = stored(found.filter("n > 1 or not kept"), "marked")
    known = docs.filter("doc_id is not null")
    once = known.join(marked.select("doc_id").hint("shuffle_hash"), "doc_id", "left_anti").select(*COLUMNS)
    values = [x for c in COLUMNS[1:] for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))]
    repeated = known.join(marked.filter("kept").select("doc_id"), "doc_id").groupBy("doc_id").agg(F.min(F.struct(*values)).alias("row"))
    nameless = docs.filter("doc_id is null").select(*COLUMNS)
    return once.union(repeated.select("doc_id", *(f"row.{c}" for c in COLUMNS[1:]))).union(nameless)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any item of the benchmark."""
    return decontamination.contaminated(docs, _table(spark, sf_dir, "benchmark")).filter(F.size("leaks") == 0).select(*COLUMNS)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mask and n_chars counted anew where any was."""
    found = secrets.scan(docs).withColumn("text", secrets.redacted(F.col("text"), F.col("secret_spans")))
    return found.withColumn("n_chars", F.when(F.size("secret_spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces: ids, their byte spans, and digests of ids and decoded text."""
    import public_tokenizers

    made = sentencepieces.encode(docs.select("doc_id", "text", "lang", "source"), public_tokenizers.path("piece_bpe_32k.model"))
    ids = F.concat_ws(",", F.col("piece_ids").cast("array<string>"))
    return made.select(
        "doc_id", "lang", "source", F.size("piece_ids").cast("long").alias("n_tokens"), F.col("piece_ids").alias("ids"), F.col("piece_begins").alias("begins"), F.col("piece_ends").alias("ends"),
        F.sha2(ids, 256).alias("ids_sha256"), F.sha2("piece_decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", not_toxic),
    ("near_duplicates", one_of_each),
    ("decontamination", without_leaks),
    ("secrets", without_secrets),
    ("sentencepieces", encoded),
]
#: The near-duplicate and toxicity stages are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what one stage returns is written to the shared folder and read by the next."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
