"""Divergence of sources within a language: sums of absolute differences of smoothed term shares, exact in integers.

Shares of a pair of sources differ in all terms of the vocabulary, also in those that neither has. Terms present in
many groups (heavy) fill dense tiles, groups times terms, whose rows are subtracted from each other. Rare ones
(light) are kept as postings: their sum is that of the two groups' shares of an absent term, plus a correction for
every posting against an absent one, plus one for every two postings of the same term. Both partial sums are added.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korrel.llm import wordids
from korrel.plans.scratch import stored
from korrel.plans.spread import spread

#: Documents that a term of the vocabulary is in, ranks of a group's terms, and what counts are raised by.
LEAST, RANKS, SMOOTH, SCALE = 30, 50, 5, 1_000_000_000
#: A term is heavy from this share of a language's groups on. Terms of a tile, and groups of a block of its rows.
HEAVY, TILE, BLOCK = 0.25, 4096, 512
#: Bytes that are no part of terms.
INSIDE = wordids.kept((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of terms and documents that hold them, by group.

    Each task counts over its batches before anything is shuffled. Null texts, languages and sources are empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in wordids.numbered(batch.column(2), INSIDE, block=16 << 20):
                size = max(1, len(found.words))
                pairs = pa.StructArray.from_arrays([c.slice(found.lo, found.hi - found.lo) for c in batch.columns[:2]], ["lang", "source"])
                names: dict[tuple, int] = {}
                groups = np.array([names.setdefault((x["lang"], x["source"]), len(names)) for x in pairs.to_pylist()], np.int64)
                held, times = wordids.counted(found.rows * size + found.ids)  # once per document and term
                keys = groups[held // size] * size + held % size
                order = np.argsort(keys, kind="stable")
                keys, times = keys[order], times[order]
                starts = np.flatnonzero(np.diff(keys, prepend=-1))
                if not len(starts):
                    continue
                distinct, listed = keys[starts], list(names)
                take = lambda k, at: pa.array([x[k] for x in listed], pa.string()).take(pa.array(at))
                words = found.words.take(pa.array(distinct % size)).cast(pa.string())
                columns = [take(0, distinct // size), take(1, distinct // size), words, pa.array(np.add.reduceat(times, starts)), pa.array(np.diff(np.append(starts, len(keys))))]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

    empty = lambda c, to: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(to)
    rows = spread(docs.select(empty(lang, "lang"), empty(source, "source"), F.col(text).alias("text")))
    made = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return made.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: Column, total: Column, size: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * size)), exact; null where size is 0."""
    above = (count + SMOOTH).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.when(size > 0, F.expr("1L") + F.call_function("div", above, (total + SMOOTH * size).cast("decimal(19,0)")))


def _tile(terms: pd.DataFrame, base: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Sums over a tile's terms (at, shares: groups that have it and their shares) of the absolute differences
    between groups lo to hi and all groups; base is every group's share of a term that it does not have."""
    out = np.zeros((hi - lo, len(base)), np.int64)
    heavy = terms["heavy"].to_numpy(bool)
    dense = terms[heavy]
    for a in range(0, len(dense), 256):
        some = dense.iloc[a : a + 256]
        tile = np.repeat(base[:, None], len(some), axis=1)
        for j, (at, shares) in enumerate(zip(some["at"], some["shares"])):
            tile[at, j] = shares
        for i in range(lo, hi):
            out[i - lo] += np.abs(tile[i] - tile).sum(1)
    light = terms[~heavy]
    out += len(light) * np.abs(base[lo:hi, None] - base[None, :])
    if not len(light):
        return out
    sizes = np.array([len(x) for x in light["at"]])
    at, share, term = np.concatenate(light["at"].to_list()), np.concatenate(light["shares"].to_list()), np.repeat(np.arange(len(light)), sizes)

    # A posting of one group against an absent one of another: sums of |share - base| from sorted shares. In one
    # direction the group with the posting is the row, in the other the column.
    apart = lambda g: np.abs(base[g] - base)
    order = np.lexsort((share, at))
    cuts = np.searchsorted(at[order], np.arange(len(base) + 1))
    for g in range(len(base)):
        x = share[order[cuts[g] : cuts[g + 1]]]
        if not len(x):
            continue
        sums = np.concatenate([[0], np.cumsum(x)])
        k = np.searchsorted(x, base)
        against = base * k - sums[k] + (sums[-1] - sums[k]) - base * (len(x) - k) - len(x) * apart(g)
        if lo <= g < hi:
            out[g - lo] += against
        out[:, g] += against[lo:hi]
    # Two postings of one term: what was added for each of them alone goes, their own difference comes.
    ends = np.cumsum(sizes)
    for width in np.unique(sizes[sizes > 1]).tolist():
        rows = (ends[sizes == width] - width)[:, None] + np.arange(width)
        some = max(1, (1 << 20) // (width * width))
        for a in range(0, len(rows), some):
            g, p = at[rows[a : a + some]], share[rows[a : a + some]]
            x, y, px, py = g[:, :, None], g[:, None, :], p[:, :, None], p[:, None, :]
            fix = np.abs(px - py) - np.abs(px - base[y]) - np.abs(base[x] - py) + np.abs(base[x] - base[y])
            mine = (x >= lo) & (x < hi) & (x != y)
            np.add.at(out, (np.broadcast_to(x, fix.shape)[mine] - lo, np.broadcast_to(y, fix.shape)[mine]), fix[mine])
    return out


def pair_sums(terms: DataFrame, langs: DataFrame, tile: int = TILE, block: int = BLOCK, heavy: float = HEAVY) -> DataFrame:
    """(lang, a, b, value) of all groups a other than b of a language, numbered from 0.

    terms: (lang, term, at, shares), one row per term of the vocabulary; langs: (lang, size, base), size the number of
    its terms, base its groups' shares of an absent term in order. A task has one tile of terms against one block of
    groups; a language without terms has one tile without any.
    """
    tiles = F.greatest(F.lit(1), F.ceil(F.col("size") / tile)).cast("int")
    groups = F.size("base")
    cut = langs.withColumns({"tiles": tiles, "blocks": F.ceil(groups / block).cast("int"), "groups": groups})
    sides = F.col("tiles"), F.col("blocks")
    keys = cut.withColumn("tile", F.explode(F.sequence(F.lit(0), sides[0] - 1))).withColumn("block", F.explode(F.sequence(F.lit(0), sides[1] - 1)))
    dealt = terms.join(cut.select("lang", "tiles", "blocks", "groups"), "lang").select(
        "lang", F.pmod(F.xxhash64("term"), F.col("tiles")).cast("int").alias("tile"), F.explode(F.sequence(F.lit(0), sides[1] - 1)).alias("block"), "at", "shares", (F.size("at") >= F.col("groups") * heavy).alias("heavy"),
    )

    def run(key: tuple, own: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        if not len(given):
            return pd.DataFrame({"lang": [], "a": [], "b": [], "value": []})
        base = np.array(given["base"].iloc[0], np.int64)
        lo, hi = key[2] * block, min((key[2] + 1) * block, len(base))
        sums = _tile(own, base, lo, hi)
        a, b = np.repeat(np.arange(lo, hi), len(base)), np.tile(np.arange(len(base)), hi - lo)
        return pd.DataFrame({"lang": key[0], "a": a, "b": b, "value": sums.ravel()})[a != b]

    by = ["lang", "tile", "block"]
    sums = dealt.groupBy(*by).cogroup(keys.select(*by, "base").groupBy(*by)).applyInPandas(run, "lang string, a int, b int, value long")
    return sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST, ranks: int = RANKS, tile: int = TILE, block: int = BLOCK, heavy: float = HEAVY) -> DataFrame:
    """(lang, source, part, item, value, rank) of every group of documents by language and source.

    A language's vocabulary are its terms in at least `least` of its documents. Part 'pair' has the group's distance
    to every other source of the language, part 'term' its terms above the language's own share, to rank `ranks`. Null
    texts, languages and sources are ''; groups without terms have shares of absent terms; a language without
    vocabulary has distances 0 and no terms. Repeated rows count again. An empty table gives no rows.
    """
    empty = lambda c, to: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(to)
    every = docs.select(empty(lang, "lang"), empty(source, "source")).distinct()
    counts = stored(term_counts(docs, text, lang, source), "term-counts")
    # Partial sums first: at most one row per source and term is shuffled.
    whole = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all")).filter(F.col("docs") >= least)
    whole = stored(whole.select("lang", "term", "all"), "vocabulary")
    kept = stored(counts.join(whole, ["lang", "term"]).select("lang", "source", "term", "n", "all"), "postings")
    sizes = whole.groupBy("lang").agg(F.count("*").alias("size"), F.sum("all").alias("total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    groups = every.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["own", "size", "total"])
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1  # a row per source
    groups = stored(groups.withColumn("g", number).withColumn("absent", F.coalesce(_share(F.lit(0), F.col("own"), F.col("size")), F.lit(0))), "groups")

    shared = kept.join(groups, ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("own"), F.col("size")))
    above = F.col("p") - _share(F.col("all"), F.col("total"), F.col("size"))
    rank = lambda: F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item")))
    row = lambda part: ["lang", "source", F.lit(part).alias("part"), "item", "value", "rank"]
    best = shared.select("lang", "source", F.col("term").alias("item"), above.alias("value")).filter("value > 0")
    # The limit on rank is taken in every task before the shuffle as well.
    best = best.withColumn("rank", rank()).filter(F.col("rank") <= ranks).select(*row("term"))

    # An array of a term has a place per source at most.
    posted = F.array_sort(F.collect_list(F.struct("g", "p")))
    terms = shared.groupBy("lang", "term").agg(posted.alias("posted")).select("lang", "term", F.col("posted.g").alias("at"), F.col("posted.p").alias("shares"))
    langs = groups.groupBy("lang").agg(F.max("size").alias("size"), F.array_sort(F.collect_list(F.struct("g", "absent"))).alias("all")).select("lang", "size", F.col("all.absent").alias("base"))
    sums = pair_sums(terms, langs, tile, block, heavy)
    name = lambda side, to: groups.select("lang", F.col("g").alias(side), F.col("source").alias(to))
    pairs = sums.join(name("a", "source"), ["lang", "a"]).join(name("b", "item"), ["lang", "b"])
    pairs = pairs.select("lang", "source", "item", "value").withColumn("rank", rank()).select(*row("pair"))
    return pairs.union(best)
