"""Repeated passages: windows of words that also stand in a document with a smaller id.

Every window has an anchor, the smallest hash of the short word runs in it, so equal windows have equal anchors.
Neighbouring windows with one anchor make a passage. Passages whose anchor only one document has are done with;
equal passages are reduced to the one with the smallest id; the different ones of an anchor meet in one shard, whose
FM-index finds the windows that they share. Anchors of very many different passages are dealt out by window instead.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from korrel.llm import wordhash
from korrel.llm.fmindex import FMIndex
from korrel.plans.scratch import stored

WINDOW = 50
RUN = 8
#: Different passages of one anchor that a shard takes; beyond that they are compared window by window.
IN_SHARD = 1000
#: Words of a shard, about.
SHARD_WORDS = 400_000
#: What tells rows apart: a key and the hash of a text under it. Rows that share both are copies, with the same spans.
ROW = ["doc_id", "row"]

_long, _int = T.LongType(), T.IntegerType()
_PASSAGES = T.StructType([T.StructField("a", _long), T.StructField("h", _long), T.StructField("n", _int), T.StructField("doc_id", _long), T.StructField("row", _long), T.StructField("start", _int)])
_PARTS = T.StructType([T.StructField("a", _long), T.StructField("h", _long), T.StructField("n", _int), T.StructField("doc_id", _long), T.StructField("words", T.ArrayType(_long)), T.StructField("offset", _int), T.StructField("w1", _long), T.StructField("w2", _long)])
_HITS = T.StructType([T.StructField("a", _long), T.StructField("h", _long), T.StructField("n", _int), T.StructField("lo", _int), T.StructField("hi", _int)])


def _arrow(schema: T.StructType) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64())}
    return pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in schema.fields])


def _passages(rows: DataFrame, window: int, run: int) -> DataFrame:
    """(anchor, content hash, length, doc_id, row, first word) of the passages of rows (doc_id, row, text)."""
    width, out = window - run + 1, _arrow(_PASSAGES)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in wordhash.blocks(batch, 2):
                hashes, first = wordhash.hashed(data, offsets)
                n = len(hashes)
                if n < window:
                    continue
                seq = wordhash.Sequences(hashes)
                at = np.arange(n - run + 1)
                least, reach = seq(at, at + run), 1
                while reach < width:
                    step = min(reach, width - reach)
                    least = np.minimum(least[:-step], least[step:])
                    reach += step
                i = np.arange(len(least))  # window starts
                doc = np.searchsorted(first, i, "right") - 1
                i = i[i + window <= first[doc + 1]]
                if not len(i):
                    continue
                doc, value = doc[i], least[i]
                new = np.ones(len(i), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
                began = i[np.flatnonzero(new)][np.cumsum(new) - 1]
                new |= (i - began) % width == 0  # long runs of one value are cut
                heads = np.flatnonzero(new)
                length = np.diff(np.append(heads, len(i))) + window - 1
                start = i[heads]
                own = batch.slice(lo, hi - lo).take(pa.array(doc[heads]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(value[heads].view(np.int64)), pa.array(seq(start, start + length).view(np.int64)), pa.array(length.astype(np.int32)),
                        own.column(0), own.column(1), pa.array((start - first[doc[heads]]).astype(np.int32)),
                    ], schema=out,
                )

    return rows.mapInArrow(cut, _PASSAGES)


def _parts(rows: DataFrame, passages: DataFrame, window: int, in_shard: int) -> DataFrame:
    """The passages (row, a, h, n, start, count) with the hashes of their words, or, where their anchor has more than
    in_shard of them, each window of the passage with two hashes of its words. Texts are moved once for both."""
    lists = passages.groupBy(F.col("first").alias("doc_id"), "row").agg(F.collect_list(F.struct("a", "h", "n", "start", (F.col("count") > in_shard).alias("crowded"))).alias("p"))
    wanted = rows.join(lists, ROW).select("doc_id", "row", "text", "p")
    out = _arrow(_PARTS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in wordhash.blocks(batch, 2):
                hashes, first = wordhash.hashed(data, offsets)
                one = two = None
                for doc, at, p in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), first.tolist(), batch.column(3).slice(lo, hi - lo).to_pylist()):
                    made = [{"a": x["a"], "h": x["h"], "n": x["n"], "doc_id": doc, "words": hashes[at + x["start"] : at + x["start"] + x["n"]].view(np.int64)} for x in p if not x["crowded"]]
                    if made:
                        yield pa.RecordBatch.from_pylist(made, schema=out)
                    for x in p:
                        if not x["crowded"]:
                            continue
                        if one is None or two is None:
                            one, two = wordhash.Sequences(hashes), wordhash.Sequences(wordhash.mix(hashes ^ np.uint64(0x2545F4914F6CDD1D)))
                        k = x["n"] - window + 1
                        s = at + x["start"] + np.arange(k)
                        same = [pa.array(np.full(k, x[c], t)) for c, t in (("a", np.int64), ("h", np.int64), ("n", np.int32))]
                        none = pa.nulls(k, pa.list_(pa.int64()))
                        yield pa.RecordBatch.from_arrays([*same, pa.array(np.full(k, doc)), none, pa.array(np.arange(k, dtype=np.int32)), pa.array(one(s, s + window).view(np.int64)), pa.array(two(s, s + window).view(np.int64))], schema=out)

    return wanted.mapInArrow(cut, _PARTS)


def _searched(contents: DataFrame, window: int) -> DataFrame:
    """(a, h, n, lo, hi): runs of words of a passage whose windows the shard's index also has under a smaller doc_id."""
    out = _arrow(_HITS)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        flat = table["words"].combine_chunks()
        flat = flat.flatten() if not isinstance(flat, pa.ChunkedArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
        n = table["n"].to_numpy()
        owners = table["doc_id"].to_numpy()
        index = FMIndex(np.split(flat.to_numpy(), np.cumsum(n)[:-1]), owners, window)
        which, lows, highs = [], [], []
        for k, least in enumerate(index.smallest_owners(index.codes)):
            hit = np.flatnonzero(np.diff(np.concatenate([[0], least < owners[k], [0]])))
            which += [k] * (len(hit) // 2)
            lows += hit[::2].tolist()
            highs += (hit[1::2] - 1 + window).tolist()
        own = table.select(["a", "h", "n"]).take(pa.array(which, pa.int64()))
        for b in own.append_column("lo", pa.array(lows, pa.int32())).append_column("hi", pa.array(highs, pa.int32())).to_batches():
            yield pa.RecordBatch.from_arrays(b.columns, schema=out)

    return contents.mapInArrow(search, _HITS)


def repeated_spans(rows: DataFrame, window: int = WINDOW, run: int = RUN, in_shard: int = IN_SHARD) -> DataFrame:
    """(doc_id, row, lo, hi): words lo..hi-1 of a row (doc_id, row, text) lie in windows that a smaller doc_id also has. May overlap."""
    spark = rows.sparkSession
    known = rows.filter("doc_id is not null")
    made = _passages(known, window, run)
    # Stored first, so that a hot anchor's rows can be split among tasks in the join.
    shared = stored(made.groupBy("a").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).filter("x < y").select("a"), "shared")
    made = stored(made.join(shared, "a", "left_semi"), "passages")
    same = ["a", "h", "n"]
    kinds = made.groupBy(*same).agg(F.min(F.struct("doc_id", "row", "start")).alias("least"))
    kinds = stored(kinds.select(*same, F.col("least.doc_id").alias("first"), F.col("least.row").alias("row"), F.col("least.start").alias("start")), "kinds")
    several = stored(kinds.groupBy("a").count().filter("count > 1"), "several")
    parts = stored(_parts(known, kinds.join(several, "a"), window, in_shard), "parts")
    contents = parts.filter("words is not null").select(*same, "doc_id", "words")
    words = contents.agg(F.sum("n")).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), words // SHARD_WORDS + 1)
    hits = _searched(contents.repartition(shards, "a"), window)

    # The rest: windows of anchors in so many different passages that one shard cannot take them.
    windows = parts.filter("words is null")
    least = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most")
    again = windows.join(stored(least, "least"), ["w1", "w2"]).filter("least < doc_id")
    hits = hits.union(again.select(*same, F.col("offset").alias("lo"), (F.col("offset") + window).cast("int").alias("hi")))

    of_kind = made.join(kinds.select(*same, "first"), same)
    copies = of_kind.filter("first < doc_id").select(*ROW, F.col("start").alias("lo"), (F.col("start") + F.col("n")).alias("hi"))
    firsts = of_kind.filter("first = doc_id").join(hits, same).select(*ROW, (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi")).alias("hi"))
    return copies.union(firsts)


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row (doc_id, n_words, n_removed, kept) per row of docs; kept is the words that stay, joined by one space.

    A word goes if a window of `window` consecutive words that covers it is, word for word, also in a row with a
    smaller key. Windows are judged on the input. Words are runs of other than \\x20 and \\x09-\\x0D, unchanged. Null
    and empty texts have no words and keep "". A row with a null key keeps all its words and takes none from others;
    rows that repeat a key take none from each other. Texts of fewer words than a window stay whole. Columns besides
    key and text are not read.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), F.col(text).alias("text"))
    spans = repeated_spans(rows, window).groupBy(*ROW).agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("spans"))
    schema = T.StructType([T.StructField("doc_id", _long), T.StructField("n_words", _long), T.StructField("n_removed", _long), T.StructField("kept", T.StringType())])
    out, word = _arrow(schema), re.compile(rb"[^\x20\x09-\x0D]+")

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo in range(0, batch.num_rows, 512):
                totals, removed, kept = [], [], []
                for t, spans in zip(batch.column(1).slice(lo, 512).to_pylist(), batch.column(2).slice(lo, 512).to_pylist()):
                    found = word.findall((t or "").encode())
                    stay = np.ones(len(found), bool)
                    for s in spans or ():
                        stay[s["lo"] : s["hi"]] = False
                    totals.append(len(found))
                    removed.append(len(found) - int(stay.sum()))
                    kept.append(b" ".join([w for w, s in zip(found, stay.tolist()) if s] if spans else found).decode())
                yield pa.RecordBatch.from_arrays([ids.slice(lo, 512), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], schema=out)

    return rows.join(spans, ROW, "left").select("doc_id", "text", "spans").mapInArrow(drop, schema)
