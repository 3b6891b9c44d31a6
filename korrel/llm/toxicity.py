"""Toxicity: a weighted lexicon found by Aho-Corasick in folded text, normalised by length.

The lexicon's weights are learned from labelled rows: a fixed start list, and words and word beginnings that are
strongly more frequent in toxic texts. Texts are folded first (case, look-alike letters, digits for letters), and
hits inside an exception phrase do not count.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from korrel.plans.scratch import stored

#: Labelled rows that a model is fitted on at most (those with the smallest hashes of their ids), and its entries.
SAMPLE, ENTRIES = 8000, 2000
#: Evidence (log-likelihood ratio) and log-odds that a learned entry needs; the threshold of a toxic text.
EVIDENCE, ODDS, THRESHOLD = 40.0, 1.5, 0.3
#: Words that are toxic without any label, and phrases in which they are not.
START = "idiot idiots moron morons stupid scum trash loser losers clown worthless pathetic disgusting imbecile retard scumbag bastard whore slut vermin".split()
EXCEPTIONS = ["trash can", "trash bin", "trash collection", "take out the trash", "clown fish", "pond scum", "idiot proof", "idiot board", "class clown award", "moron test"]
START_WEIGHT = 4.0
#: Look-alike letters, and digits and signs that stand for letters.
HOMOGLYPHS = {0xFF41 + k: chr(97 + k) for k in range(26)} | {0xFF04: "$", 0xFF20: "@"} | str.maketrans("абвгдезіјклмопрстухуѕԁԛԝαβεικνορτυχ０１２３４５６７８９", "a6brde3ijkmmonpctyxysdqwabeiknoptux0123456789")
LEET = str.maketrans("013457@$!", "oieastasi")
_LOOKALIKE = re.compile("[" + "".join(map(chr, HOMOGLYPHS)) + "]").search
#: Characters without width, which part no words: soft hyphen, joiners, marks of direction, byte order mark.
UNSEEN = dict.fromkeys([0xAD, *range(0x200B, 0x2010), *range(0x2060, 0x2065), 0xFEFF])
_UNSEEN = re.compile("[" + "".join(map(chr, UNSEEN)) + "]").search
#: What may stand between a word and its end: digits and signs, as in "word5".
_TAIL = re.compile(r"[0-9@$!]*(?![^\W_])").match
_INSIDE = re.compile(r"(?<=[^\W\d_])[013457@$!]+(?=[^\W\d_])|(?<![\w@$!])[013457@$!]+(?=[^\W\d_])")
_WORDS = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    """Lower case without unseen characters, look-alikes of Latin letters as these, and digits or signs before or between letters as letters."""
    text = text.lower()
    if not text.isascii() and _UNSEEN(text):
        text = text.translate(UNSEEN)
    if not text.isascii() and _LOOKALIKE(text):
        text = re.sub(r"\w+", lambda m: m[0].translate(HOMOGLYPHS) if re.search("[a-z]", m[0].translate(HOMOGLYPHS)) else m[0], text)
    return _INSIDE.sub(lambda m: m[0].translate(LEET), text)


@dataclass
class Lexicon:
    """Weights of whole words and of word beginnings, and the logistic model of a text's two features."""

    words: dict[str, float]
    beginnings: dict[str, float]
    model: tuple[float, float, float] = (-3.0, 1.5, 1.0)

    def matcher(self):
        """A function from a text to (summed weight, hits, words)."""
        import ahocorasick

        auto = ahocorasick.Automaton()
        entries: dict[str, list[tuple[str, float]]] = {}
        for kind, held in (("w", self.words), ("b", self.beginnings), ("x", dict.fromkeys(EXCEPTIONS, 0.0))):
            for term, weight in held.items():
                entries.setdefault(term, []).append((kind, weight))
        for term, kinds in entries.items():
            auto.add_word(term, (len(term), kinds))
        auto.make_automaton()

        def match(text: str) -> tuple[float, int, int]:
            body = fold(text)
            best: dict[int, float] = {}  # weight by start
            spared: list[tuple[int, int]] = []
            for end, (n, kinds) in auto.iter(body) if entries else ():
                start = end - n + 1
                if start and body[start - 1].isalnum():
                    continue
                closed = end + 1 == len(body) or _TAIL(body, end + 1) is not None
                for kind, weight in kinds:
                    if kind == "x":
                        if closed:
                            spared.append((start, end))
                    elif closed or kind == "b":
                        best[start] = max(best.get(start, 0.0), weight)
            if spared:  # phrases that overlap make one stretch, so each hit is looked up once
                stretches: list[list[int]] = []
                for a, b in sorted(spared):
                    if stretches and a <= stretches[-1][1]:
                        stretches[-1][1] = max(stretches[-1][1], b)
                    else:
                        stretches.append([a, b])
                begins = [a for a, _ in stretches]
                best = {s: w for s, w in best.items() if not (k := bisect_right(begins, s)) or stretches[k - 1][1] < s}
            return sum(best.values()), len(best), max(1, len(body.split()))

        return match

    def score(self, total: float, hits: int, words: int) -> float:
        """The probability of label 1."""
        a, b, c = self.model
        z = a + b * math.log1p(100 * total / words) + c * math.log1p(hits)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _terms(rows: DataFrame) -> DataFrame:
    """(term, kind, toxic texts, clean texts) of rows (text, toxic), summed per batch before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = set(_WORDS.findall(fold(text or "")))
                found[toxic].update({("w", w) for w in words} | {("b", w[:k]) for w in words for k in range(4, min(9, len(w)))})
            keys = list(found[0].keys() | found[1].keys())
            yield pa.RecordBatch.from_pydict({"kind": [k for k, _ in keys], "term": [t for _, t in keys], "p": [found[1][k] for k in keys], "n": [found[0][k] for k in keys]})

    return rows.select("text", "toxic").mapInArrow(run, "kind string, term string, p long, n long").groupBy("kind", "term").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Lexicon:
    """A lexicon from labelled rows (key, toxic 0/1); null keys and labels and null texts are left out.

    At most `sample` rows are used. Equal texts are one, under their smallest key, and toxic if any label says so; so
    the same tables give the same lexicon. By that key's hash three of four serve for the entries, the fourth for the
    logistic model. Without toxic or without clean rows the start list and a fixed model stay.
    """
    rows = labels.filter(F.col("toxic").isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = rows.orderBy(F.xxhash64(key), key).limit(sample)
    # Broadcast: `sample` rows of two numbers at most.
    met = docs.select(key, F.col(text).alias("text")).filter("text is not null").join(F.broadcast(chosen), key)
    known = stored(met.groupBy("text").agg(F.min(key).alias(key), F.max("toxic").alias("toxic")), "labelled")
    for_words = known.filter(F.pmod(F.xxhash64(key), F.lit(4)) != 0)
    totals = {r["toxic"]: r["count"] for r in for_words.groupBy("toxic").count().collect()}
    found = Lexicon(dict.fromkeys(START, START_WEIGHT), {})
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    if not pos or not neg:
        return found
    p, n = F.col("p"), F.col("n")
    share = pos / (pos + neg)
    odds = F.log((p + 0.5) / (pos + 1)) - F.log((n + 0.5) / (neg + 1))
    part = lambda k, s: F.when(k > 0, k * F.log(k / ((p + n) * s))).otherwise(0.0)
    evidence = 2 * (part(p, share) + part(n, 1 - share))
    strong = _terms(for_words).withColumns({"odds": odds, "evidence": evidence}).filter((F.col("odds") >= ODDS) & (F.col("evidence") >= EVIDENCE))
    for r in strong.orderBy(F.desc("evidence"), "term", "kind").limit(ENTRIES).collect():  # bounded: ENTRIES rows
        if r["kind"] == "w":
            found.words[r["term"]] = max(found.words.get(r["term"], 0.0), r["odds"])
        else:
            found.beginnings[r["term"]] = r["odds"]
    # A beginning that says no more than a shorter one is left out.
    found.beginnings = {t: w for t, w in found.beginnings.items() if not any(found.beginnings.get(t[:k], -1) >= w - 0.2 for k in range(4, len(t)))}
    rest = sorted(_matched(known.filter(F.pmod(F.xxhash64(key), F.lit(4)) == 0).select("text", "toxic"), found, "text").select("total", "hits", "words", "toxic").collect())  # bounded: the sample
    if len({r["toxic"] for r in rest}) == 2:
        x = np.array([[1.0, math.log1p(100 * r["total"] / r["words"]), math.log1p(r["hits"])] for r in rest])
        y, prior = np.array([float(r["toxic"]) for r in rest]), np.array(found.model)
        w = prior.copy()
        for _ in range(60):
            q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + 0.5 * np.eye(3), x.T @ (y - q) - 0.5 * (w - prior))
            w = w + np.clip(step, -2, 2)
        found.model = (float(w[0]), float(w[1]), float(w[2]))
    return found


def _matched(docs: DataFrame, lexicon: Lexicon, text: str) -> DataFrame:
    """docs with columns total, hits and words, and the probability as score."""
    new = [T.StructField("total", T.DoubleType()), T.StructField("hits", T.LongType()), T.StructField("words", T.LongType()), T.StructField("score", T.DoubleType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = lexicon.matcher()
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                found = [match(t or "") for t in part.column(at).to_pylist()]
                columns = [pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64()), pa.array([lexicon.score(*f) for f in found], pa.float64())]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, *(f.name for f in new)])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *new]))


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text", to: str = "score") -> DataFrame:
    """docs with the probability of being toxic in column `to`.

    Null and empty texts have no hits. One narrow pass over whole texts; rows and other columns stay. Raises
    ValueError where docs has the column already.
    """
    if to.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"column {to} exists already")
    own = [f"c{i}" for i in range(len(docs.columns))]
    if text not in docs.columns:
        raise ValueError(f"no column {text}")
    made = _matched(docs.toDF(*own), lexicon, own[docs.columns.index(text)])
    return made.select(*(F.col(c).alias(name) for c, name in zip(own, docs.columns)), F.col("score").alias(to))


def held_out(key: str = "doc_id"):
    """Whether a row's label must not be learned from: crc32 of its id as text leaves 2 by 4."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score and predicted."""
    lexicon = fit(docs, labels.filter(~held_out()))
    made = score(docs.select("doc_id", "text"), lexicon)
    return made.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
