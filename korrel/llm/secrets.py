"""Secret scan with column functions alone: fixed patterns, and windows of high entropy in strings of one class."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korrel.llm.matching import bound, joined, masked, matches

#: Fixed patterns and lengths of the contract.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"  # runs are maximal, so shorter ones need not be looked at
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_mixed")
#: Characters of an entropy window.
WINDOW = 20
#: Candidate strings by class, and the bits per character that a window must reach. Random strings of 16 signs have
#: about 3.4 in 20 characters, random ones of 64 about 4.1; words of a natural language stay below 3.6.
CLASSES = {
    "entropy_hex": (r"(?<![0-9A-Fa-f])(?=[0-9A-Fa-f]*[A-Fa-f])(?=[A-Fa-f]*[0-9])[0-9A-Fa-f]{20,}", 3.0),
    "entropy_mixed": (r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}", 3.8),
}
#: Strings that look random but are no secrets: uuids, dates with times, paths and placeholders. Repeated groups are
#: possessive: Java matches others by recursion, and a long string of words would overflow the stack.
ALLOWED = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|^[0-9]{4}-[0-9]{2}-[0-9]{2}|example|placeholder|^/?(?:[a-z]++/)++[a-z0-9_-]*+$|abcdefghij|0123456789|x{6}|^[a-z]++(?:[-_][a-z]++)++[0-9]{0,4}+$"

SPANS = "array<struct<start:int,k:int,end:int,kind:string>>"


def _hot(value: Column, bits: float, window: int) -> Column:
    """(lo, hi) around all windows of at least so many bits per character; lo is -1 where none is.

    One pass: a step counts the character that enters and takes back the one that leaves, and corrects the sum of
    n * log2(n) over the counts by just those two.
    """
    signs = F.split(value, "")
    alphabet = F.array_distinct(signs)
    codes = bound(F.struct(signs.alias("signs"), alphabet.alias("alphabet")), lambda x: F.transform(x["signs"], lambda c: F.array_position(x["alphabet"], c).cast("int") - 1))
    # What enters and what leaves at each place; nothing leaves (-1) while the first window fills.
    moves = bound(codes, lambda c: F.zip_with(c, F.slice(F.concat(F.array_repeat(F.lit(-1), window), c), F.lit(1), F.size(c)), lambda x, y: F.struct(x.alias("come"), y.alias("gone"))))

    def weight(n: Column) -> Column:
        return F.when(n > 0, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))

    def step(state: Column, move: Column) -> Column:
        come, gone, at = move["come"], move["gone"], state["at"] + 1
        more, less = F.get(state["counts"], come), F.coalesce(F.get(state["counts"], F.when(gone >= 0, gone)), F.lit(0))
        change = weight(more + 1) - weight(more) + F.when(gone >= 0, weight(less - 1) - weight(less)).otherwise(F.lit(0.0))
        total = state["total"] + F.when(come == gone, F.lit(0.0)).otherwise(change)
        return F.struct(
            at.alias("at"),
            F.when(come == gone, state["counts"]).otherwise(F.transform(state["counts"], lambda n, j: F.when(j == come, n + 1).when(j == gone, n - 1).otherwise(n))).alias("counts"),
            total.alias("total"), state["lo"].alias("lo"), state["hi"].alias("hi"),
        )

    def seen(state: Column) -> Column:
        hot = (state["at"] >= window) & (F.lit(math.log2(window)) - state["total"] / window >= bits)
        return F.struct(
            state["at"].alias("at"), state["counts"].alias("counts"), state["total"].alias("total"),
            F.when(hot & (state["lo"] < 0), state["at"] - window).otherwise(state["lo"]).alias("lo"), F.when(hot, state["at"]).otherwise(state["hi"]).alias("hi"),
        )

    start = F.struct(F.lit(0).alias("at"), F.transform(alphabet, lambda _: F.lit(0)).alias("counts"), F.lit(0.0).alias("total"), F.lit(-1).alias("lo"), F.lit(-1).alias("hi"))
    # A step's window is judged when the next one begins, so that its total is computed once.
    return F.aggregate(moves, start, lambda state, move: step(seen(state), move), lambda s: F.struct(seen(s)["lo"].alias("lo"), seen(s)["hi"].alias("hi")))


def _judged(bits: float, window: int):
    """A function of a match that gives its start and the stretch of its hot windows."""

    def judged(m: Column) -> Column:
        return F.struct(m["start"].alias("at"), _hot(m["value"], bits, window).alias("hot"))

    return judged


def secret_spans(text: Column, window: int = WINDOW) -> tuple[Column, Column]:
    """Base spans and all spans of a text column, each an array of (start, k, end, kind) by start, then kind."""
    text = F.coalesce(text, F.lit(""))

    def spans(kind: str, found: Column) -> Column:
        k = KINDS.index(kind)
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("k"), m["end"].alias("end"), F.lit(kind).alias("kind")))

    maybe = (text.contains("=") | text.contains(":")) & text.rlike(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]""")
    base = [
        spans("assign", F.filter(matches(text, ASSIGN, maybe, 2), lambda m: F.length(m["part"]) >= 12)),
        spans("access", F.filter(matches(text, ACCESS, text.contains("AKIA")), lambda m: F.length(m["value"]) >= 18)),
        spans("hex", matches(text, HEX, text.rlike("[0-9a-f]{16}"))),
    ]
    added = []
    for kind, (pattern, bits) in CLASSES.items():
        candidates = F.filter(matches(text, pattern, text.rlike(pattern)), lambda m: ~m["value"].rlike(ALLOWED))
        scored = F.transform(candidates, _judged(bits, window))
        scored = F.filter(scored, lambda s: s["hot"]["lo"] >= 0)
        added.append(spans(kind, F.transform(scored, lambda s: F.struct((s["at"] + s["hot"]["lo"]).alias("start"), (s["at"] + s["hot"]["hi"]).alias("end")))))
    return F.array_sort(F.concat(*base)), F.array_sort(F.concat(*base, *added))


def scan(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with base_spans and secret_spans (SPANS: start, k, end, kind; code points, end exclusive).

    Null and empty texts have none. Kinds are assign, access and hex (fixed patterns; base_spans has only these), and
    entropy_hex and entropy_mixed: the stretch of a candidate string between its first and last window of high
    entropy, where the string is not on the allow list. One narrow pass of column functions; rows and other columns
    stay. Raises ValueError where docs has columns of the new names.
    """
    if clash := {"base_spans", "secret_spans"} & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    base, spans = secret_spans(F.col(text), window)
    return docs.withColumns({"base_spans": base, "secret_spans": spans})


def redacted(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with every stretch that spans cover replaced by one mask; spans must be ordered by start."""

    return masked(text, spans, lambda _: F.lit(mask))


def digests(docs: DataFrame) -> DataFrame:
    """Per document: counts of base spans by kind, a digest of them, all spans as text, and their number."""
    found = scan(docs.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(F.col("base_spans")), 256).alias("base_sha256"), joined(F.col("secret_spans")).alias("spans"), F.size("secret_spans").cast("long").alias("n_spans"))
