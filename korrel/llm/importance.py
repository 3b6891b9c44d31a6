"""Importance resampling towards a target: hashed n-gram features, bucket gains, and a seeded draw without replacement.

Every block of texts has an integer dictionary of its words. An n-gram is a tuple of ids, packed into one integer;
each distinct tuple's bytes are put together and hashed once per block, and the buckets go back to the places of the
tuples. Documents' buckets are stored, so no text is read twice. What leaves the tasks for the driver is one number
per bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korrel.llm import wordids
from korrel.plans.scratch import stored
from korrel.plans.spread import spread

#: Buckets of features, words of the longest feature, per cent of documents to draw, words that a drawn one has at least.
BUCKETS, WORDS, SHARE, LEAST = 10_000, 2, 25, 20
SEED = 7
#: Bytes of text that share a dictionary: a worker holds some hundred bytes for each word of a block.
BLOCK = 2 << 20
#: Bytes that are no part of words.
INSIDE = wordids.kept((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
_FEATURES = "id {id}, n_words long, n_features long, buckets binary"


def _buckets(found: wordids.Words, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every feature of a block: all runs of 1 to `longest` words inside one text."""
    words, ids, rows = found.words.to_pylist(), found.ids, found.rows
    size = max(1, len(words))
    # Each level's tuples are numbered by an earlier tuple's number and a word: the tuple's hash goes on from the
    # earlier one's, over the blank and the word, so every distinct tuple's bytes are hashed once.
    tuples, hashes, at = ids, list(map(crc32, words)), np.arange(len(ids))
    out_rows, out = [rows], [np.array(hashes, np.int64)[ids] % buckets if len(ids) else np.zeros(0, np.int64)]
    for _ in range(longest - 1):
        follows = at + 1 < len(ids)
        follows[follows] = rows[at[follows]] == rows[at[follows] + 1]
        before, at = tuples[follows], at[follows] + 1
        packed = pa.array(before * size + ids[at]).dictionary_encode()
        distinct = packed.dictionary.to_numpy()
        blank = [crc32(b" ", h) for h in hashes]
        hashes = [crc32(words[w], blank[t]) for t, w in zip((distinct // size).tolist(), (distinct % size).tolist())]
        tuples = packed.indices.to_numpy().astype(np.int64)
        out_rows.append(rows[at])
        out.append(np.array(hashes, np.int64)[tuples] % buckets if len(tuples) else np.zeros(0, np.int64))
    return np.concatenate(out_rows), np.concatenate(out)


def features(texts: DataFrame, key: str, text: str, longest: int = WORDS, buckets: int = BUCKETS) -> DataFrame:
    """(id, n_words, n_features, buckets) per row of texts: its features' buckets as little-endian 16-bit numbers.

    Null texts have none; keys may be null or repeat; other columns are not read.
    """
    if not 0 < buckets <= 1 << 16:
        raise ValueError("a bucket is a 16-bit number")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in wordids.numbered(batch.column(1), INSIDE, block=BLOCK):
                n = found.hi - found.lo
                rows, values = _buckets(found, longest, buckets)
                order = np.argsort(rows, kind="stable")
                each = np.bincount(rows, minlength=n)
                ends = np.zeros(n + 1, np.int32)
                np.cumsum(2 * each, out=ends[1:])
                packed = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(values[order].astype("<u2"))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(found.lo, n), pa.array(np.diff(found.first)), pa.array(each), packed], names=["id", "n_words", "n_features", "buckets"])

    rows = spread(texts.select(F.col(key).alias("id"), F.col(text).alias("text")), "id")
    return rows.mapInArrow(run, _FEATURES.format(id=rows.schema["id"].dataType.simpleString()))


def _packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All buckets of a column of them, and where each row's begin."""
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]].view("<u2") if offsets[-1] > offsets[0] else np.zeros(0, "<u2"), (offsets - offsets[0]) // 2


def totals(made: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features fall into each bucket that has any; each task sums its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int64)
        for batch in batches:
            held += np.bincount(_packed(batch.column(0))[0], minlength=buckets)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(held[some])], names=["bucket", "n"])

    return made.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(own: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of all buckets: floor(1000 * ln of the target's smoothed share over the corpus's)."""
    spark = own.sparkSession
    total = lambda t, name: t.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias(name))
    each = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    each = each.join(own.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").na.fill(0)
    each = each.join(F.broadcast(total(own, "own")), how="left").join(F.broadcast(total(target, "all")), how="left")  # one row each
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    return each.select("bucket", F.floor(1000 * F.log((t + 1) * (F.col("own") + buckets) / ((s + 1) * (F.col("all") + buckets)))).alias("gain"))


def weighted(made: DataFrame, gain: list[int]) -> DataFrame:
    """(id, n_words, n_features, weight): the floored mean of the gains of each row's features; 0 where it has none."""
    table = np.array(gain, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, at = _packed(batch.column(3))
            sums = np.zeros(len(values) + 1, np.int64)
            np.cumsum(table[values], out=sums[1:])
            n = np.diff(at)
            weight = (sums[at[1:]] - sums[at[:-1]]) // np.maximum(n, 1)  # floors go down
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight)], names=["id", "n_words", "n_features", "weight"])

    return made.mapInArrow(run, _FEATURES.format(id=made.schema["id"].dataType.simpleString()).replace("buckets binary", "weight long"))


def noise(key: Column, seed: int = SEED) -> Column:
    """floor(-1000 * ln(-ln(u))) of a number u between 0 and 1 that seed and key fix."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with rank (from 1) in the given order over all of them.

    Ranges of the order are numbered apart and moved up by the sizes of those before, one number per range; no task
    sees more than a range. Rows that are equal in the order share a range.
    """
    # Numbered by its place among the partitions, which hold the ranges in order.
    at = F.monotonically_increasing_id()
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(dealt.select("*", F.shiftright(at, 33).cast("int").alias("range"), (at.bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("place")), "ranges")
    sizes = placed.groupBy("range").agg(F.max("place").alias("n"))
    before = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))  # a row per range
    return placed.join(F.broadcast(before), "range").withColumn("rank", F.col("before") + F.col("place")).drop("range", "place", "before")


def resample(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_key: str = "item_id", target_text: str = "text",
    share: int = SHARE, least: int = LEAST, seed: int = SEED, longest: int = WORDS, buckets: int = BUCKETS,
) -> DataFrame:
    """(key, n_features, weight, score, rank), all long, one row per row of docs.

    weight is the floored mean gain of a document's features, score adds seeded noise, so that taking the highest
    scores is a draw in proportion to importance. Of the N rows with a key and at least `least` words, floor(share *
    N / 100) get a rank, ties by key; other rows' rank is null. A null text is empty (weight 0); a null key has no
    noise, so its score is null, it is never drawn and not in N, but its features count. Rows that repeat a key are
    told apart by nothing and ranked next to each other. Empty tables give empty results, an empty target only gains of its smoothing.
    """
    made = stored(features(docs, key, text, longest, buckets), "features")
    own, wanted = totals(made, buckets), totals(features(target, target_key, target_text, longest, buckets), buckets)
    gain = [r["gain"] for r in gains(own, wanted, buckets).orderBy("bucket").collect()]  # one number per bucket
    scored = weighted(made, gain).withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    able = F.col("id").isNotNull() & (F.col("n_words") >= least)
    scored = stored(scored.withColumn("able", able), "scores")
    drawn = (scored.filter("able").count() * share) // 100
    order = [F.desc("score"), F.asc("id")]
    columns = lambda rank: [F.col("id").alias(key), "n_features", "weight", "score", rank.alias("rank")]
    inside = ranked(scored.filter("able"), order).select(*columns(F.when(F.col("rank") <= drawn, F.col("rank"))))
    return inside.union(scored.filter("not able").select(*columns(F.lit(None).cast("long"))))
