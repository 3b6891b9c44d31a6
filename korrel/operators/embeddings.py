"""Embeddings behind a stored cache: a text is encoded once under a model, whatever asks for it and however often."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korrel.plans.scratch import stored

#: Texts that an encoder is given at once.
BATCH = 8
CACHE = "digest binary, v array<double>"
Encode = Callable[[list[str]], list[list[float]]]


@dataclass(frozen=True)
class Model:
    """A name under which vectors are kept, and what encodes texts: vectors of one width, of length 1."""

    name: str
    encode: Encode

    def folder(self, cache: str) -> str:
        """Where a cache keeps this model's vectors."""
        return f"{cache}/{hashlib.sha256(self.name.encode()).hexdigest()}"


def character_shares(texts: list[str]) -> list[list[float]]:
    """Shares of the letters a to z and the digits, as vectors of length 1 (zeros without any): for want of a model."""
    out = []
    for text in texts:
        low = text.lower()
        counts = [low.count(c) for c in "abcdefghijklmnopqrstuvwxyz0123456789"]
        norm = math.sqrt(sum(n * n for n in counts)) or 1.0
        out.append([n / norm for n in counts])
    return out


def kept(spark: SparkSession, cache: str, model: Model) -> DataFrame:
    """(digest, v): what a cache holds of a model; empty where it holds nothing yet."""
    try:
        return spark.read.schema(CACHE).parquet(model.folder(cache))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE)


def embedded(texts: DataFrame, model: Model, cache: str, id: str = "id", text: str = "text") -> DataFrame:
    """(id, v): the vector of every row of texts; null texts are empty.

    Distinct texts that the cache lacks are encoded once each, BATCH at a time, and appended to it. Rows that repeat a
    text meet only its digest, so a frequent text is nobody's hot group. cache is a folder that all executors share.
    """
    spark = texts.sparkSession
    rows = texts.select(F.col(id).alias("id"), F.coalesce(text, F.lit("")).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    rows = stored(rows, "texts")
    first = rows.groupBy("digest").agg(F.min("text").alias("text"))  # equal digests are equal texts
    missing = first.join(kept(spark, cache, model).select("digest"), "digest", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            vectors = [np.asarray(v, "float64") for lo in range(0, len(texts), BATCH) for v in model.encode(texts[lo : lo + BATCH])]
            yield pd.DataFrame({"digest": batch["digest"], "v": vectors})

    missing.mapInPandas(run, CACHE).write.mode("append").parquet(model.folder(cache))
    # Vectors meet the rows as the cache has them: it is reduced only if a job that was begun twice appended a text twice.
    digests, vectors = rows.select("id", "digest"), kept(spark, cache, model)
    met = stored(digests.join(vectors, "digest").select("id", "v"), "vectors")
    if met.count() == rows.count():
        return met
    return stored(digests.join(vectors.groupBy("digest").agg(F.first("v").alias("v")), "digest").select("id", "v"), "vectors")
