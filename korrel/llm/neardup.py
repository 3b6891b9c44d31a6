"""Near duplicates: MinHash signatures joined by an inverted index over their coordinates.

A document is posted under each (coordinate, value) of its signature. Two documents that agree in `matches` of
`coordinates` places agree in one of the (coordinates - matches + 1) rarest places of either (prefix), so only those
lists are merged; the frequent ones are skipped, and a candidate's other collisions are counted from the two
signatures. What survives is confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from korrel.llm import wordhash
from korrel.plans.components import components
from korrel.plans.scratch import stored

WORDS = 5
COORDINATES = 128
#: Of 128 coordinates a pair of similarity 0.75 shares 96 on average, with a deviation of 4.9; 74 leaves out about 1 in 10**5.
MATCHES = 74
PERCENT = 75
#: Documents of a list that are compared with each other at once, rows of a group of such comparisons, and pairs of
#: signatures that are held at a time.
BLOCK, GROUP_ROWS, PAIRS = 512, 20_000, 4096

_MARKS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType()), T.StructField("signature", T.ArrayType(T.IntegerType())), T.StructField("short", T.BinaryType())])
_SETS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))])


def _shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text; a shorter text is one shingle, one without words has none."""
    hashes, first = wordhash.hashed(data, offsets, fold=True)
    run, out = wordhash.Sequences(hashes), []
    n = len(hashes)
    last = np.maximum(n - words + 1, 0)
    grams = run(np.arange(last), np.arange(last) + words)
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
        if hi - lo >= words:
            out.append(np.unique(grams[lo : hi - words + 1]))
        elif hi > lo:
            out.append(run(np.array([lo]), np.array([hi])))
        else:
            out.append(grams[:0])
    return out


def _marks(docs: DataFrame, words: int, coordinates: int) -> DataFrame:
    """Per row of (doc_id, text): set size, a 128-bit digest of the shingle set, and the signature (null for none)."""
    rng = np.random.default_rng(975)
    factors = rng.integers(0, 1 << 63, coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = rng.integers(0, 1 << 63, coordinates, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in wordhash.blocks(batch, 1):
                sets = _shingles(data, offsets, words)
                sizes = np.array([len(s) for s in sets])
                full = np.flatnonzero(sizes)
                x = np.concatenate(sets)
                d = np.zeros((2, len(sets)), np.uint64)
                signatures = np.zeros((len(full), coordinates), np.uint32)
                if len(full):
                    at = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                    d[0, full] = np.add.reduceat(wordhash.mix(x + np.uint64(1)), at)
                    d[1, full] = np.bitwise_xor.reduceat(wordhash.mix(x ^ np.uint64(0x5851F42D4C957F2D)), at)
                    for i in range(coordinates):
                        signatures[:, i] = np.minimum.reduceat(((x * factors[i] + shifts[i]) >> np.uint64(32)).astype(np.uint32), at)
                ends = np.cumsum(np.where(sizes > 0, coordinates, 0))
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], ends]).astype(np.int32), mask=np.append(sizes == 0, False)), pa.array(signatures.ravel().view(np.int32))
                )
                short = np.zeros((len(sets), coordinates), np.uint8)
                short[full] = signatures.astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(sizes.astype(np.int64)), pa.array(d[0].view(np.int64)), pa.array(d[1].view(np.int64)), lists, pa.array([x.tobytes() for x in short], pa.binary())],
                    schema=pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("signature", pa.list_(pa.int32())), ("short", pa.binary())]),
                )

    return docs.mapInArrow(run, _MARKS)


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """Per row of (doc_id, text): the distinct shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in wordhash.blocks(batch, 1):
                sets = _shingles(data, offsets, words)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32)), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], schema=pa.schema([("doc_id", pa.int64()), ("shingles", pa.list_(pa.int64()))]))

    return docs.mapInArrow(run, _SETS)


def _rare_postings(reps: DataFrame, coordinates: int, matches: int) -> DataFrame:
    """(key, doc): each document under the rarest of its signature's places, as many as the prefix has.

    A place that one document alone has pairs with nothing, so it only uses up the prefix.
    """
    key = F.shiftleft(F.col("pos").cast("long"), 32).bitwiseOR(F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    postings = reps.select("doc", F.posexplode("signature").alias("pos", "value")).select("doc", key.alias("key"))
    counts = postings.groupBy("key").count().filter("count > 1")
    kept = postings.join(counts, "key").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("count", "key"))).alias("shared"))
    return (
        kept.filter(F.size("shared") >= matches)
        .select("doc", F.explode(F.slice("shared", 1, F.size("shared") - matches + 1)).alias("s"))
        .select(F.col("s.key").alias("key"), "doc")
    )


def _labelled(lists: DataFrame, known: DataFrame) -> DataFrame:
    """Postings (key, doc) with the component c of each document."""
    return lists.join(known.withColumnRenamed("node", "doc"), "doc", "left").select("key", "doc", F.coalesce("component", "doc").alias("c"))


def _confirmed(pairs: DataFrame, reps: DataFrame, sets: DataFrame, matches: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose signatures agree often enough and whose shingle sets are similar enough."""
    mark = lambda s: reps.select(F.col("doc").alias(s), F.col("signature").alias(f"sig_{s}"))
    own = lambda s: sets.select(F.col("doc_id").alias(s), F.col("shingles").alias(f"set_{s}"))
    agree = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    close = pairs.join(mark("a"), "a").join(mark("b"), "b").filter(agree >= matches).select("a", "b")
    both = close.join(own("a"), "a").join(own("b"), "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    return both.withColumn("common", common).filter(F.col("common") * 100 >= (F.size("set_a") + F.size("set_b") - F.col("common")) * percent).select("a", "b")


def _bytes(short: pd.Series, fill: int) -> np.ndarray:
    """A row of 128 bytes for each value; columns that it has none for are `fill`."""
    given = np.frombuffer(b"".join(short), np.uint8).reshape(len(short), -1)
    out = np.full((len(short), 128), fill, np.uint8)
    out[:, : given.shape[1]] = given
    return out


def _posted(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Of each row, the 128 places at which the document is posted, and its whole values there."""
    flags = np.stack([rows["low"].to_numpy(np.int64), rows["high"].to_numpy(np.int64)], 1)
    at = np.unpackbits(flags.view(np.uint8), axis=1, bitorder="little").astype(bool)
    values = np.zeros(at.shape, np.int32)
    values[at] = np.concatenate(list(rows["values"]))
    return at, values


def _ones(words: np.ndarray) -> np.ndarray:
    """How many bits are set in each last pair of words."""
    n = np.bitwise_count(words)
    return n[..., 0] + n[..., 1]


def _across(labelled: DataFrame, reps: DataFrame, sets: DataFrame, matches: int, percent: int) -> DataFrame:
    """Links (a, b), a > b, of documents of different components within a list.

    Documents outside a list's largest component are compared with all of the list, block by block, by one byte of
    each signature value. What agrees in enough places is gathered per straggler, not per pair, and taken only from
    the first list that both are in, by their whole values at the places at which they are posted, so that one list
    names a pair. Comparisons of short lists share a group. The shingle sets then meet in blocks of the documents
    around one component. Only confirmed links become rows.
    """
    parts = labelled.groupBy("key", "c").agg(F.count("*").alias("n"))
    heads = parts.groupBy("key").agg(F.max(F.struct("n", "c")).alias("head"), F.sum("n").alias("n"), F.count("*").alias("parts")).filter("parts > 1").withColumn("stray", F.col("n") - F.col("head.n"))
    cut = lambda n: F.greatest(F.ceil(n / BLOCK).cast("int"), F.lit(1))
    heads = stored(heads.select("key", F.col("head.c").alias("main"), cut(F.col("n")).alias("xs"), cut(F.col("stray")).alias("ss"), "n", "stray"), "heads")
    rows = heads.agg(F.sum(F.col("n") * F.col("ss") + F.col("stray") * F.col("xs"))).first()[0] or 0
    buckets = max(int(heads.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // GROUP_ROWS + 1)
    met = labelled.join(heads.drop("n", "stray"), "key")
    around = met.groupBy("main", "doc").agg(F.max((F.col("c") != F.col("main")).cast("int")).alias("stray"))
    around = stored(around, "around")
    sizes = stored(around.groupBy("main").agg(cut(F.count("*")).alias("blocks"), cut(F.sum("stray")).alias("groups")), "sizes")
    prefix = labelled.groupBy("doc").agg(
        F.coalesce(F.expr("bit_or(CASE WHEN shiftright(key, 32) < 64 THEN shiftleft(1L, CAST(shiftright(key, 32) AS INT)) END)"), F.lit(0).cast("long")).alias("low"),
        F.coalesce(F.expr("bit_or(CASE WHEN shiftright(key, 32) >= 64 THEN shiftleft(1L, CAST(shiftright(key, 32) AS INT) - 64) END)"), F.lit(0).cast("long")).alias("high"),
        F.array_sort(F.collect_list("key")).alias("keys"),  # as many as a prefix has, by place
    )
    low = lambda k: k.bitwiseAND(F.lit(0xFFFFFFFF))
    signed = lambda v: F.when(v >= 1 << 31, v - (1 << 32)).otherwise(v).cast("int")
    values = F.transform("keys", lambda k: signed(low(k)))
    marks = prefix.select("doc", "low", "high", values.alias("values")).join(reps.select("doc", "short"), "doc")
    lists = stored(met.join(sizes, "main").join(marks, "doc"), "mixed")
    at = lambda parts: F.pmod(F.xxhash64("doc"), F.col(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    bucket = F.pmod(F.xxhash64("key", "s", "x"), F.lit(buckets)).alias("bucket")
    own = [bucket, "key", "s", "x", "main", "blocks", at("blocks").alias("block"), at("groups").alias("grp"), "doc", "c", "low", "high", "values", "short"]
    strays = lists.filter("c <> main").withColumn("s", at("ss")).withColumn("x", each("xs")).select(own)
    every = lists.withColumn("x", at("xs")).withColumn("s", each("ss")).select(own)

    def compare(strays: pd.DataFrame, every: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(strays) and len(every):
            x, y = _bytes(every["short"], 0), _bytes(strays["short"], 1)
            (theirs, given), (mine, own) = _posted(every), _posted(strays)
            c, of = every["c"].to_numpy(), strays["c"].to_numpy()
            docs, blocks = every["doc"].to_numpy(), every["block"].to_numpy()
            main, grp, doc = strays["main"].to_numpy(), strays["grp"].to_numpy(), strays["doc"].to_numpy()
            members = every.groupby(within).indices
            for part, rows in strays.groupby(within).indices.items():
                others, place = members.get(part, ()), int(part[0]) >> 32
                step = max(1, PAIRS // max(1, len(others)))
                for lo in range(0, len(rows) if len(others) else 0, step):
                    some = rows[lo : lo + step]
                    same = np.packbits(y[some][:, None] == x[others], axis=-1, bitorder="little").view(np.uint64)
                    near = (_ones(same) >= matches) & (of[some][:, None] != c[others])
                    for i in np.flatnonzero(near.any(axis=1)):
                        k, hit = some[i], others[near[i]]
                        before = mine[k, :place] & theirs[hit, :place] & (own[k, :place] == given[hit, :place])
                        hit = hit[~before.any(axis=1)]
                        for block in np.unique(blocks[hit]):
                            out.append((main[k], int(block), int(grp[k]), doc[k], docs[hit[blocks[hit] == block]]))
        return pd.DataFrame(out, columns=["main", "block", "grp", "a", "others"])

    within = ["key", "s", "x"]
    near = strays.groupBy("bucket").cogroup(every.groupBy("bucket")).applyInPandas(compare, "main long, block int, grp int, a long, others array<long>")
    asked = near.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("own")), "a")
    given = around.join(sizes, "main").join(sets.select(F.col("doc_id").alias("doc"), F.col("shingles").alias("set")), "doc").withColumn("block", at("blocks")).withColumn("grp", each("groups")).select("main", "block", "grp", "doc", "set")

    def confirm(asked: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        if len(asked) and len(given):
            held = dict(zip(given["doc"], given["set"]))
            for doc, rows in asked.groupby("a"):
                mine = np.sort(rows["own"].iloc[0])
                others = np.unique(np.concatenate(list(rows["others"])))
                theirs = [held[o] for o in others]
                n = np.array([len(t) for t in theirs])
                flat = np.concatenate(theirs)
                hit = mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat
                common = np.add.reduceat(hit.astype(np.int64), np.concatenate([[0], np.cumsum(n)[:-1]]))
                linked = others[common * 100 >= (len(mine) + n - common) * percent]
                a.append(np.maximum(linked, doc))
                b.append(np.minimum(linked, doc))
        return pd.DataFrame({"a": np.concatenate(a) if a else np.zeros(0, np.int64), "b": np.concatenate(b) if b else np.zeros(0, np.int64)})

    block = ["main", "block", "grp"]
    return asked.groupBy(*block).cogroup(given.groupBy(*block)).applyInPandas(confirm, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, coordinates: int = COORDINATES, matches: int = MATCHES) -> DataFrame:
    """One row (doc_id, n_shingles, component_id, kept) per row of docs.

    Texts are compared as sets of `words`-word shingles, A-Z lower-cased; shorter texts are one shingle; null, empty
    and blank texts have none and link with nothing. Rows with a similarity of at least percent/100 are linked;
    component_id is the smallest key that links reach, kept tells whether it is the row's own. A row with a null key
    links with nothing: its component_id is null and it is kept. Rows that repeat a key count as one document with
    all their links. Columns besides key and text are not read. Copies with equal sets are one document from the
    start, and lists of near copies are reduced to their components before any pair is made.
    """
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    marks = stored(_marks(docs, words, coordinates), "marks")
    some = marks.filter("n_shingles > 0 and doc_id is not null")
    same = ["d1", "d2", "n_shingles"]
    groups = stored(some.groupBy(*same).agg(F.min("doc_id").alias("rep")), "groups")
    reps = some.join(groups, same).filter("doc_id = rep").select(F.col("doc_id").alias("doc"), "signature")
    lists = stored(_rare_postings(reps, coordinates, matches), "postings")
    reps = stored(marks.select(F.col("doc_id").alias("doc"), "signature", "short").join(lists.select("doc").distinct(), "doc", "left_semi"), "reps")

    # Each list's first document against the others: that many pairs, and most copies end up in one component.
    heads = stored(lists.groupBy("key").agg(F.min("doc").alias("b"), F.max("doc").alias("last")).filter("b < last"), "heads")
    stars = stored(lists.join(heads, "key").filter("doc <> b").groupBy(F.col("doc").alias("a"), "b").count(), "stars")
    ids = stars.select("a").union(stars.select("b")).distinct()
    sets = stored(_sets(docs.join(ids.withColumnRenamed("a", "doc_id").hint("shuffle_hash"), "doc_id"), words), "sets")
    links = stored(_confirmed(stars.select("a", "b"), reps, sets, matches, percent), "links")
    known = components(links, "a", "b")

    # What is left are pairs of different components within a list.
    more = stored(_across(_labelled(lists, known), reps, sets, matches, percent), "more")

    # A key that repeats with other texts joins their sets.
    owners = some.select("doc_id", *same).join(groups, same).groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b"))
    whole = components(links.union(more).union(owners.filter("a < b").select("a", "b")), "a", "b")

    rep = stored(groups.join(whole.withColumnRenamed("node", "rep"), "rep", "left").select(*same, F.coalesce("component", "rep").alias("of_set")), "sets_of")
    found = marks.select("doc_id", *same).join(rep, same, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("of_set", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
