"""Where a pattern matches in a text column, with column functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements of a stretch that is folded by itself.
RUN = 256
MATCHES = "array<struct<start:int,end:int,value:string,part:string>>"


def matches(text: Column, pattern: str, where: Column, part: int = 0) -> Column:
    """The leftmost non-overlapping matches of a Java pattern: array of (start, end, value, part), in code points.

    What lies between the matches is found by splitting at the pattern, so starts are sums of lengths. Texts for
    which `where` is not true are not searched and have no match. part is the number of a group to give besides.
    """
    gaps, values = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(part)) if part else F.transform(values, lambda _: F.lit(None).cast("string"))
    zipped = F.arrays_zip(gaps.alias("gap"), values.alias("value"), parts.alias("part"))

    def step(state: Column, x: Column) -> tuple[Column, Column, Column]:
        start = state["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["value"]), F.lit(0))
        one = F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"), x["part"].alias("part"))
        return end, F.when(x["value"].isNull(), F.array().cast(MATCHES)).otherwise(F.array(one)), F.lit(False)

    return F.when(where, gathered(zipped, F.lit(0), step, MATCHES)).otherwise(F.array().cast(MATCHES))


def gathered(items: Column, start: Column, step, kind: str) -> Column:
    """A fold over an array that gathers elements: step(state, x) gives (next at, elements to add, whether they replace the last).

    state has `at` and `now`, the elements added last (at least one, if any was). A fold copies its state at every
    element, so stretches of RUN elements are folded by themselves and only then put behind the others.
    """
    state = lambda at, done, now: F.struct(at.alias("at"), done.alias("done"), now.alias("now"))

    def one(s: Column, x: Column) -> Column:
        at, more, instead = step(s, x)
        held = F.when(instead, F.slice(s["now"], F.lit(1), F.greatest(F.size(s["now"]) - 1, F.lit(0)))).otherwise(s["now"])
        return F.struct(at.alias("at"), F.when(F.size(more) > 0, F.concat(held, more)).otherwise(s["now"]).alias("now"))

    def stretch(s: Column, part: Column) -> Column:
        folded = F.aggregate(part, F.struct(s["at"].alias("at"), s["now"].alias("now")), one)
        last = lambda now: F.slice(now, F.lit(1), F.greatest(F.size(now) - 1, F.lit(0)))
        return bound(folded, lambda f: state(f["at"], F.concat(s["done"], last(f["now"])), F.slice(f["now"], F.greatest(F.size(f["now"]), F.lit(1)), F.lit(1))))

    none = F.array().cast(kind)
    parts = bound(items, lambda a: F.transform(F.sequence(F.lit(0), F.floor(F.size(a) / RUN).cast("int")), lambda j: F.slice(a, j * RUN + 1, F.lit(RUN))))
    return F.aggregate(parts, state(start, none, none), stretch, lambda s: F.concat(s["done"], s["now"]))


def bound(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def joined(spans: Column) -> Column:
    """kind:start:end of each element, comma-joined in the array's order."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def masked(text: Column, spans: Column, mask) -> Column:
    """The text with every stretch that spans cover replaced by mask(first span of it); spans must be ordered by start."""

    def step(state: Column, s: Column) -> tuple[Column, Column, Column]:
        piece = F.concat(F.substring(text, state["at"] + 1, s["start"] - state["at"]), mask(s))
        return F.greatest(state["at"], s["end"]), F.when(s["start"] >= state["at"], F.array(piece)).otherwise(F.array().cast("array<string>")), F.lit(False)

    tail = F.substring(text, F.array_max(F.transform(spans, lambda s: s["end"])) + 1, F.length(text))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(gathered(spans, F.lit(0), step, "array<string>"), ""), tail)).otherwise(text)
