"""Positioned runs of text as the text of pages and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from korrel.functions import text as t

#: Pages and characters of a document that are read.
PAGES, CHARACTERS = 80, 140_000
# Signs that no blank goes before.
CLOSING = r"^[,.;:!?»)%\]}]"


def page_texts(runs: DataFrame) -> DataFrame:
    """(doc, page, text) of runs (doc, page, run, str, eol): each page's runs in order, joined and cleaned; none where no text is left.

    A blank goes between two runs unless the earlier one ends with white space or a hyphen, or the later one begins
    with a closing sign; eol ends the line. Then words cut at a line's end are put together, and blanks at line ends,
    runs of blanks and more than two line ends in a row go. What a run sees of those before it is one sign, so the
    fold is a window over each page. Null strings are empty, a null eol is none.
    """
    value, end = F.coalesce("str", F.lit("")), F.coalesce("eol", F.lit(False))
    sign = F.when(end, "\n").when(value != "", F.substring(value, -1, 1))
    before = Window.partitionBy("doc", "page").orderBy("run")
    seen = runs.select("doc", "page", "run", value.alias("v"), end.alias("e"), sign.alias("sign"))
    seen = seen.withColumn("last", F.last("sign", ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1)))
    apart = (F.col("v") != "") & F.col("last").isNotNull() & ~F.col("last").rlike(r"(?U)[\s-]") & ~F.col("v").rlike(CLOSING)
    ended = F.when(F.col("v") != "", F.col("v").endswith("\n")).otherwise(F.coalesce(F.col("last") == "\n", F.lit(False)))
    piece = F.concat(F.when(apart, " ").otherwise(""), F.col("v"), F.when(F.col("e") & ~ended, "\n").otherwise(""))
    whole = seen.groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct("run", piece.alias("p")))).alias("all"))
    text = F.array_join(F.transform("all", lambda x: x["p"]), "")
    for pattern, to in ((r"(\p{L})-\n(?=\p{Ll})", "$1"), (r"[ \t]+\n", "\n"), (r"\n[ \t]+", "\n"), (r"[ \t]{2,}", " "), (r"\n{3,}", "\n\n")):
        text = F.regexp_replace(text, pattern, to)
    return whole.select("doc", "page", t.trim(text).alias("text")).filter("text <> ''")


def document_pages(texts: DataFrame, totals: DataFrame, pages: int = PAGES, characters: int = CHARACTERS) -> DataFrame:
    """(doc, page, text, start, end, cut): the pages (doc, page, text) that fit into a document's limits, with their places in its text.

    Pages are joined by two line ends; the page that reaches the limit is cut, those behind it are left out. totals
    (doc, n) has how many pages a document has: only the first `pages` are read. truncated documents: see truncated().
    """
    w = Window.partitionBy("doc").orderBy("page")
    read = texts.join(totals.select("doc"), "doc", "left_semi").filter(F.col("page") <= pages).withColumn("size", F.length("text"))
    after = F.sum(F.col("size") + 2).over(w) - 2  # where the page would end
    placed = read.withColumn("end", after).withColumn("start", F.col("end") - F.col("size"))
    earlier = F.when(F.row_number().over(w) > 1, F.col("start") - 2).otherwise(F.lit(0))
    room = placed.withColumn("left", F.lit(characters) - earlier).filter("left > 0")
    kept = F.expr("substring(text, 1, cast(left as int))")
    return room.select("doc", "page", kept.alias("text"), F.col("start").cast("int").alias("start"), (F.col("start") + F.least("size", "left")).cast("int").alias("end"), (F.col("size") > F.col("left")).alias("cut"))


def documents(kept: DataFrame, texts: DataFrame, totals: DataFrame) -> DataFrame:
    """(doc, text, pages, truncated) of kept pages; truncated where a page was cut or left out, or not read."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\n\n")
    own = kept.groupBy("doc").agg(joined.alias("text"), F.count("*").alias("pages"), F.max("cut").alias("cut"))
    had = texts.groupBy("doc").agg(F.count("*").alias("had"))
    rows = totals.join(own, "doc").join(had, "doc").withColumn("unread", F.col("n") > PAGES)
    return rows.select("doc", "text", "pages", (F.col("cut") | F.col("unread") | (F.col("had") > F.col("pages"))).alias("truncated"))
