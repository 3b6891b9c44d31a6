"""Token counts with a digest cache: a text that was counted once under a tokenizer is never encoded again."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from korrel.plans.scratch import stored

CACHE = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("n_tokens", T.LongType())])
#: Words whose counts a worker remembers; beyond that it starts anew.
REMEMBERED = 800_000
# White space as Unicode's White_Space has it.
_WS = "\t-\r \x85\xa0  -     　"


class Counter:
    """Counts tokens of texts inside a task, word by word where the tokenizer cuts at white space anyway."""

    def __init__(self, path: str):
        self.byte_level, self.special = False, []
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
            import json

            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            pre = spec.get("pre_tokenizer") or {}
            self.special = [x["content"] for x in spec.get("added_tokens", [])]
            self.byte_level = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not any(x.get("lstrip") or x.get("rstrip") for x in spec.get("added_tokens", []))
            self.whole = lambda texts: [len(x.ids) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        self.known: dict[str, int] = {}
        self.doubled = re.compile(f"[{_WS}]{{2}}").search
        self.cut = re.compile(f"[{_WS}]+[^{_WS}]*|[^{_WS}]+").findall

    def _chunks(self, text: str) -> list[str] | None:
        """The text cut where a white-space run follows other characters: no token reaches across. None: not to be cut."""
        if not self.byte_level or any(s in text for s in self.special):
            return None
        if self.doubled(text):
            return self.cut(text)
        first, *rest = text.split(" ")
        return [first, *map(" ".__add__, rest)] if first else list(map(" ".__add__, rest))

    def __call__(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text."""
        cut = [self._chunks(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        known, new, whole = self.known, set(), []
        for i, c in enumerate(cut):
            if c is None:
                whole.append(i)
            else:
                new.update(c)
        new = list(new.difference(known))
        for lo in range(0, len(new), 20_000):
            part = new[lo : lo + 20_000]
            known.update(zip(part, self.whole(part)))
        alone = dict(zip(whole, self.whole([texts[i] for i in whole]))) if whole else {}
        return [alone[i] if c is None else sum(map(known.__getitem__, c)) for i, c in enumerate(cut)]


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    """The worker's counter for a tokenizer file."""
    return Counter(path)


def version(path: str) -> str:
    """Digest of a tokenizer: its file and the release of the library that reads it."""
    import sentencepiece
    import tokenizers

    used = sentencepiece if path.endswith(".model") else tokenizers
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + used.__version__.encode()).hexdigest()


def read_cache(spark: SparkSession, cache: str, of: str) -> DataFrame:
    """The stored (digest, n_tokens) of one tokenizer version; empty where nothing is stored yet."""
    try:
        return spark.read.schema(CACHE).parquet(f"{cache}/{of}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE)


def count(docs: DataFrame, tokenizer: str, cache: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (key, n_bytes, n_tokens) per row of docs, in UTF-8 bytes and tokens.

    Null texts count as empty (0 tokens); keys may be null or repeat, repeated rows stay. Only texts whose digest
    the cache lacks are encoded, each distinct one once, and appended to it; what fails midway is simply missing
    from the cache. cache is a folder that all executors share. Columns other than key and text are not read.
    """
    spark, of = docs.sparkSession, version(tokenizer)
    rows = docs.select(F.col(key).alias("k"), F.coalesce(text, F.lit("")).alias("t")).withColumn("digest", F.unhex(F.md5("t")))
    missing = rows.groupBy("digest").agg(F.min("k").alias("first")).join(read_cache(spark, cache, of), "digest", "left_anti")
    # The text of one row of each missing digest. Its key is unlike any other's, so no hot text meets in one task.
    chosen = rows.alias("r").join(
        missing.withColumnRenamed("digest", "d").hint("shuffle_hash"),
        F.col("k").eqNullSafe(F.col("first")) & (F.col("digest") == F.col("d")),
    ).select("digest", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(c(part.column(1).to_pylist()), pa.int64())], names=["digest", "n_tokens"])

    counted = chosen.mapInArrow(run, CACHE).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    counted.write.mode("append").parquet(f"{cache}/{of}")
    # Stored, so that the join below has a plain table on either side and a hot digest's rows can be split.
    counts = stored(read_cache(spark, cache, of).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    return rows.select("k", "digest", F.octet_length("t").cast("long").alias("n_bytes")).join(counts, "digest").select(F.col("k").alias(key), "n_bytes", "n_tokens")
