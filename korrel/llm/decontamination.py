"""Benchmark decontamination: test items found in documents with up to a share of edits.

An item with an error budget e is cut into e + 1 pieces; a stretch of text within e edits holds at least one of them
unchanged. Exact hits of pieces (Aho-Corasick) give the places, Myers' bit-parallel distance the verdict. Items too
short for a budget are one piece and must stand as whole words. Texts and items are compared in lower case with each run
of white space as one space.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from korrel.plans.scratch import stored

#: Share of an item's characters that may be edited, and the shortest piece of an item that may be edited.
ERRORS, PIECE = 0.06, 12
#: Characters of items that one pass over the documents looks for, and blocks that a worker keeps ready for search.
BLOCK_CHARS, KEPT = 2_000_000, 1
#: Letters of scripts that put no blanks between words: a word may end beside any of them.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def normal(text: str | None) -> str:
    """Lower case, one space for each run of white space, none at the ends."""
    return " ".join((text or "").lower().split())


def budget(item: str, errors: float, piece: int) -> int:
    """Edits that an item may have; few enough that its pieces keep their length."""
    return max(0, min(int(len(item) * errors), len(item) // piece - 1))


def cut(item: str, edits: int) -> list[tuple[int, str]]:
    """(offset, piece): edits + 1 pieces of about equal length."""
    bounds = [len(item) * k // (edits + 1) for k in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(bounds, bounds[1:])]


def _parted(a: str, b: str) -> bool:
    """Whether a word may end between two characters that stand side by side; "" is a text's end."""
    return not (a.isalnum() and b.isalnum()) or bool(UNSPACED.match(a) or UNSPACED.match(b))


def whole(body: str, start: int, end: int) -> bool:
    """Whether body[start:end], which is not empty, begins and ends where words do."""
    return _parted(body[start - 1 : start] if start else "", body[start]) and _parted(body[end - 1], body[end : end + 1])


class Myers:
    """Edit distance of one pattern to the best-matching stretch of a text, a whole column of the table per step."""

    def __init__(self, pattern: str):
        self.size = len(pattern)
        self.places: dict[str, int] = {}
        for i, c in enumerate(pattern):
            self.places[c] = self.places.get(c, 0) | 1 << i

    def within(self, text: str, edits: int) -> int:
        """The least distance of the pattern to any substring of text, if at most `edits`, else edits + 1."""
        full, top = (1 << self.size) - 1, 1 << (self.size - 1)
        up, down, score, best = full, 0, self.size, self.size
        get = self.places.get
        for c in text:
            same = get(c, 0)
            level = same | down
            cross = (((same & up) + up) ^ up) | same
            plus, minus = down | ~(cross | up) & full, up & cross
            if plus & top:
                score += 1
            elif minus & top:
                score -= 1
            plus, minus = plus << 1 & full, minus << 1 & full  # a match may begin anywhere
            up, down = minus | ~(level | plus) & full, plus & level
            if score < best:
                best = score
        return min(best, edits + 1)


class Items:
    """Test items ready for search inside a task."""

    def __init__(self, rows: list[tuple[int, str]], errors: float, piece: int):
        import ahocorasick

        self.items = [(i, t, budget(t, errors, piece)) for i, t in rows]
        self.strict = {k for k, (_, _, edits) in enumerate(self.items) if not edits}
        where: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text, edits) in enumerate(self.items):
            for offset, part in cut(text, edits):
                where.setdefault(part, []).append((k, offset))
        self.auto = ahocorasick.Automaton()
        for part, places in where.items():
            self.auto.add_word(part, (len(part), places))
        self.auto.make_automaton()
        self.myers: dict[int, Myers] = {}

    def find(self, text: str | None) -> list[tuple[int, int]]:
        """(item id, edits) of every item in the text, with its least number of edits."""
        body = normal(text)
        near: dict[int, list[int]] = {}
        exact: set[int] = set()
        for end, (size, places) in self.auto.iter(body) if self.items else ():
            for k, offset in places:
                if k not in self.strict:
                    near.setdefault(k, []).append(end + 1 - size - offset)
                elif k not in exact and whole(body, end + 1 - size, end + 1):
                    exact.add(k)
        out = [(self.items[k][0], 0) for k in exact]
        for k, starts in near.items():
            ident, item, edits = self.items[k]
            best, reach, areas = edits + 1, -1, []
            for start in sorted(set(starts)):
                if body.startswith(item, start) if start >= 0 else False:
                    best = 0
                    break
                lo, hi = max(0, start - edits), start + len(item) + edits
                if lo > reach:
                    areas.append([lo, hi])
                areas[-1][1] = reach = hi
            if best:  # places that overlap are read once, and a start before the text's is one too
                if k not in self.myers:
                    self.myers[k] = Myers(item)
                for lo, hi in areas:
                    best = min(best, self.myers[k].within(body[lo:hi], edits))
                    if best == 0:
                        break
            if best <= edits:
                out.append((ident, best))
        return sorted(out)


_ready: dict[str, Items] = {}


def _items(name: str, rows: Callable[[], list[tuple[int, str]]], errors: float, piece: int) -> Items:
    """A block's items, built once in each worker."""
    if name not in _ready:
        while len(_ready) >= KEPT:
            del _ready[next(iter(_ready))]
        _ready[name] = Items(rows(), errors, piece)
    return _ready[name]


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", errors: float = ERRORS, piece: int = PIECE, item_key: str = "item_id", item_text: str = "text", to: str = "leaks") -> DataFrame:
    """docs with an array of (item_id, edits) in column `to`: the test items that stand in each text.

    An item stands in a text if a stretch of it is within errors * length edits (insertions, deletions, replacements
    of characters), as far as its pieces keep `piece` characters; one that may have none if it stands there unchanged,
    as whole words. Null and empty texts have none; items that are null or blank are not looked for; an id that
    repeats is found if any of its texts is, with the least edits. Rows and other columns stay. Items are broadcast in
    blocks of about BLOCK_CHARS characters. One block is one narrow pass; of several, each is a job of its own over
    stored texts that leaves only hits, and its broadcast is dropped, so a worker never holds more than one. Raises
    ValueError where the column exists already.
    """
    if to.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"column {to} exists already")
    if text not in docs.columns:
        raise ValueError(f"no column {text}")
    spark, own = docs.sparkSession, [f"c{i}" for i in range(len(docs.columns))]
    at, rows, names = docs.columns.index(text), docs.toDF(*own), docs.columns
    items = benchmark.select(F.col(item_key).cast("long").alias("item_id"), F.col(item_text).alias("text")).dropna()
    blocks = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS))
    kind = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("edits", T.IntegerType())]))

    def search(frame: DataFrame, column: int, block: int) -> tuple[DataFrame, Broadcast]:
        """frame with the block's hits in a last column, found."""
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        wanted = sorted({(r["item_id"], normal(r["text"])) for r in part.collect()})  # bounded: about BLOCK_CHARS characters
        held, name = spark.sparkContext.broadcast([(i, t) for i, t in wanted if t]), uuid.uuid4().hex
        arrow = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32())]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ready = _items(name, lambda: held.value, errors, piece)
            for batch in batches:
                for lo in range(0, batch.num_rows, 1024):
                    some = batch.slice(lo, 1024)
                    found = [[{"item_id": i, "edits": e} for i, e in ready.find(t)] for t in some.column(column).to_pylist()]
                    yield pa.RecordBatch.from_arrays([*some.columns, pa.array(found, arrow)], names=[*some.schema.names, "found"])

        return frame.mapInArrow(run, T.StructType([*frame.schema.fields, T.StructField("found", kind)])), held

    if blocks == 1:
        found, _ = search(rows, at, 0)
        first = F.aggregate("found", F.array().cast(kind), lambda a, x: F.when(F.exists(a, lambda y: y["item_id"] == x["item_id"]), a).otherwise(F.concat(a, F.array(x))))
        return found.select(*(F.col(c).alias(name) for c, name in zip(own, names)), first.alias(to))
    numbered = stored(rows.withColumn("row", F.monotonically_increasing_id()), "documents")
    hits = None
    for block in range(blocks):
        found, held = search(numbered.select("row", own[at]), 1, block)
        one = stored(found.filter(F.size("found") > 0).select("row", F.explode("found").alias("f")).select("row", "f.*"), "hits")
        held.unpersist()
        hits = one if hits is None else hits.union(one)
    listed = hits.groupBy("row", "item_id").agg(F.min("edits").alias("edits")).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("item_id", "edits"))).alias("found"))
    every = numbered.join(listed, "row", "left")
    return every.select(*(F.col(c).alias(name) for c, name in zip(own, names)), F.coalesce("found", F.array().cast(kind)).alias(to))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, whether it holds a test item, how many, and their ids in order, comma-joined."""
    made = contaminated(docs.select("doc_id", "text"), benchmark)
    ids = F.concat_ws(",", F.transform("leaks", lambda x: x["item_id"].cast("string")))
    return made.select("doc_id", (F.size("leaks") > 0).alias("contaminated"), F.size("leaks").cast("long").alias("n_items"), ids.alias("item_ids"), F.coalesce(F.array_max(F.transform("leaks", lambda x: x["edits"])), F.lit(0)).alias("most_edits"))
