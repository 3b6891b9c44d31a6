"""Proposed triples against their evidence: both ends must be known names, and one sentence must say what is claimed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korrel.functions import text as t
from korrel.plans.scratch import stored

#: Letters of the shortest name, and of a relation.
NAME, RELATION = 3, 32
# The type whose last word is a name too, and what stands for a relation without letters.
PERSON, NO_RELATION = "person", "bezug"
_SIDE = r"[^\p{L}\p{N}]"


def resolver(nodes: DataFrame) -> DataFrame:
    """(key, node): folded names with exactly one owner among nodes (id, title, type, optionally aliases).

    Names are titles, aliases and the last word of a person's title of several words. Names that several nodes own,
    of one or two letters, or null, resolve nothing. A node that has a name twice owns it once.
    """
    aliases = F.col("aliases") if "aliases" in nodes.columns else F.array().cast("array<string>")
    last = F.when((F.col("type") == PERSON) & F.col("title").contains(" "), F.substring_index("title", " ", -1))
    names = F.explode(F.concat(F.array("title", last), F.coalesce(aliases, F.array().cast("array<string>"))))
    keys = nodes.select("id", names.alias("name")).select("id", t.normalize(F.col("name")).alias("key")).filter(F.length("key") >= NAME)
    # One owner or several is settled by the smallest and the largest, which partial sums hold in two values.
    return keys.groupBy("key").agg(F.min("id").alias("node"), F.max("id").alias("other")).filter("node = other").select("key", "node")


def literal(value: Column) -> Column:
    """Pattern of a text as it stands, in any case, between signs that are no letters or digits; blanks match any."""
    quoted = F.regexp_replace(F.replace(t.trim(value), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), r"(?U)\s+", r"\\E(?U:\\s+)\\Q")
    return F.concat(F.lit(rf"(?iu)(?:^|{_SIDE})\Q"), quoted, F.lit(rf"\E(?=$|{_SIDE})"))


def placed_sentences(x: Column) -> Column:
    """Sentences of a text as structs (text, start, terms, folded), start counted from 0."""
    start = F.struct(F.array().cast("array<struct<text:string,start:int>>").alias("done"), F.lit(0).alias("at"))

    def step(state: Column, s: Column) -> Column:
        at = F.call_function("locate", s, x, state["at"] + 1) - 1
        return F.struct(F.concat(state["done"], F.array(F.struct(s.alias("text"), at.alias("start")))).alias("done"), (at + F.length(s)).alias("at"))

    found = F.aggregate(t.sentences(x), start, step, lambda s: s["done"])
    return F.transform(found, lambda s: F.struct(s["text"].alias("text"), s["start"].alias("start"), t.terms(s["text"]).alias("terms"), t.normalize(s["text"]).alias("folded")))


def judged(texts: DataFrame, proposed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every proposed triple (id, pos, subject, relation, object) of texts (id, text) with its verdict.

    Verdicts, the first that holds: 'unresolved' (an end is no unique name), 'self' (both are one node), 'unsupported'
    (no sentence holds subject and object as whole words and a stem of the relation, or the relation itself where it
    has no stems), 'repeated' (an earlier triple of the text gave the same edge), 'kept'. Kept and repeated ones have
    source, target, relation_key, and start and end of the first sentence that supports them. A null part, or a text that is missing or null, cannot be supported.
    Both sides of each join are stored tables or scans, so that the rows of a hot name can be split.
    """
    names = stored(resolver(nodes), "names")
    wanted = stored(proposed.select("id", "pos", "subject", "relation", "object"), "proposed")
    side = lambda c, to: names.select(F.col("key").alias(f"{c}_key"), F.col("node").alias(to))
    key = lambda c: t.normalize(t.trim(F.col(c))).alias(f"{c}_key")
    ends = wanted.select("*", key("subject"), key("object")).join(side("subject", "source"), "subject_key", "left")
    ends = stored(ends.join(side("object", "target"), "object_key", "left").drop("subject_key", "object_key"), "ends")
    able = ends.filter("source <> target")
    # Only texts with a resolved triple are cut into sentences.
    parts = texts.join(able.select("id").distinct(), "id", "left_semi").select("id", placed_sentences(F.col("text")).alias("parts"))
    parts = stored(parts, "sentences")

    def supports(s: Column) -> Column:
        stems = t.terms(F.col("relation"))
        said = F.when(F.size(stems) > 0, F.arrays_overlap(stems, s["terms"])).otherwise(F.contains(s["folded"], t.normalize(F.col("relation"))))
        return F.rlike(s["text"], literal(F.col("subject"))) & F.rlike(s["text"], literal(F.col("object"))) & said

    support = F.get(F.filter("parts", supports), F.lit(0))
    found = able.join(parts, "id").select("id", "pos", support.alias("s")).select("id", "pos", F.col("s.start").alias("start"), (F.col("s.start") + F.length("s.text")).alias("end"))
    slug = F.substring(F.regexp_replace(t.normalize(F.col("relation")), t.NOT_ALNUM, "_"), 1, RELATION)
    rows = ends.join(stored(found, "support"), ["id", "pos"], "left").withColumn("relation_key", F.when(slug == "", NO_RELATION).otherwise(slug))
    held = F.col("start").isNotNull()
    again = F.row_number().over(Window.partitionBy("id", "source", "target", "relation_key", held).orderBy("pos")) > 1  # a text's triples
    verdict = F.when(F.col("source").isNull() | F.col("target").isNull(), "unresolved").when(F.col("source") == F.col("target"), "self").when(~held, "unsupported").when(again, "repeated").otherwise("kept")
    return rows.withColumn("verdict", verdict)


def edges(decided: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, source, target, relation, label, start, end, evidence) of the kept triples; evidence is cut from the text."""
    kept = decided.filter("verdict = 'kept'").join(texts.select("id", "text"), "id")
    return kept.select("id", "source", "target", F.col("relation_key").alias("relation"), F.col("relation").alias("label"), "start", "end", t.excerpt(F.col("text"), F.col("start"), F.col("end")).alias("evidence"))


def rejects(decided: DataFrame) -> DataFrame:
    """(id, proposed, kept, repeated, unresolved, self_loops, unsupported) by text; repeated ones are no rejections."""
    count = lambda v, to: F.count_if(F.col("verdict") == v).alias(to)
    return decided.groupBy("id").agg(F.count("*").alias("proposed"), count("kept", "kept"), count("repeated", "repeated"), count("unresolved", "unresolved"), count("self", "self_loops"), count("unsupported", "unsupported"))
