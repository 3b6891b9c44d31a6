"""Retrieval: TF-IDF and dense indexes, top-k, contexts, and what builds on them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korrel.functions import text as t
from korrel.plans.scratch import stored


@dataclass
class TermIndex:
    """postings (id, term, tf) and df (term, df), both stored, and the number of documents as a one-row table."""

    postings: DataFrame
    df: DataFrame
    size: DataFrame


def token_counts(docs: DataFrame, key: list[str], text: Column) -> DataFrame:
    """(key, term, tf): stems of a text by row.

    Texts are only cut at ASCII signs, and the parts counted, before they are folded, cut at other signs, compared with
    the stop list and stemmed: so that is done once per distinct part of a row, and for most parts is not needed.
    """
    parts = docs.select(*key, F.explode(F.split(F.lower(text), t.ASCII_SIGNS)).alias("part")).groupBy(*key, "part").agg(F.count("*").alias("k"))
    ascii = F.length("part") == F.octet_length("part")
    words = parts.filter("part <> ''").select(*key, F.explode(F.when(ascii, F.array("part")).otherwise(F.split(t.normalize(F.col("part")), t.NOT_ALNUM))).alias("word"), "k")
    kept = words.filter((F.length("word") > 1) & ~F.col("word").isin(*t.STOP_WORDS))
    stemmed = F.when(F.right("word", F.lit(1)).isin(*t.LAST) & (F.length("word") > 4), t.stem(F.col("word"))).otherwise(F.col("word"))
    return kept.groupBy(*key, stemmed.alias("term")).agg(F.sum("k").alias("tf"))


def postings(docs: DataFrame, key: str = "id", title: str = "title", body: str = "summary") -> DataFrame:
    """(id, term, tf) over title and body; texts are dealt by id, so that their words are counted where they are."""
    own = docs.select(F.col(key).alias("id"), F.concat_ws(" ", title, body).alias("text"))
    spark = docs.sparkSession
    tasks = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return token_counts(own.repartition(tasks, "id"), ["id"], F.col("text"))


def idf(n: Column, df: Column) -> Column:
    """ln(1 + N / (1 + df)); a term that no document has counts as df 0."""
    return F.log(1 + n / (1 + F.coalesce(df, F.lit(0))))


def term_index(docs: DataFrame) -> TermIndex:
    """The TF-IDF index of docs (id, title, summary): one pass over the texts."""
    posts = stored(postings(docs), "postings")
    return TermIndex(posts, stored(posts.groupBy("term").agg(F.count("*").alias("df")), "df"), docs.agg(F.count("*").alias("n")))


def norms(index: TermIndex, tasks: int) -> DataFrame:
    """(id, norm) of all documents, dealt by id over so many tasks."""
    weighted = index.postings.join(index.df, "term").crossJoin(F.broadcast(index.size))  # one row
    squares = weighted.select("id", ((F.col("tf") * idf(F.col("n"), F.col("df"))) ** 2).alias("square"))
    return squares.repartition(tasks, "id").groupBy("id").agg(F.sqrt(F.sum("square")).alias("norm"))


#: Rows of postings that one task holds when they are dealt by document.
DEALT = 1 << 19


def dealt(index: TermIndex) -> tuple[DataFrame, int]:
    """The index's postings by document over some tasks, and their number.

    What is then joined to a small table and grouped by question and document stays in its task: of a question's hits,
    only a task's best are shuffled, not all of them.
    """
    tasks = max(index.df.sparkSession.sparkContext.defaultParallelism, -(-index.postings.count() // DEALT))
    return index.postings.repartition(tasks, "id"), tasks


def question_terms(questions: DataFrame) -> DataFrame:
    """(question_id, term, qtf) of questions (id, text)."""
    return token_counts(questions.select(F.col("id").alias("question_id"), "text"), ["question_id"], F.col("text")).withColumnRenamed("tf", "qtf")


def tfidf_topk(index: TermIndex, questions: DataFrame, k: int = 4) -> DataFrame:
    """(question_id, id, score, rank): the k documents of highest cosine, above 0; ties to the smaller id.

    Scores are rounded to six digits before they are ranked. Unseen query terms count in the query's norm. Postings are
    dealt by document, so a document's products are added up, divided by its norm and ranked where they arise. The
    result, k rows a question, is stored.
    """
    weights = question_terms(questions).join(index.df, "term", "left").crossJoin(F.broadcast(index.size)).withColumn("idf", idf(F.col("n"), F.col("df")))
    weights = stored(weights.select("question_id", "term", "qtf", "idf"), "weights")
    lengths = weights.groupBy("question_id").agg(F.sqrt(F.sum((F.col("qtf") * F.col("idf")) ** 2)).alias("qnorm"))
    posts, tasks = dealt(index)
    dots = posts.join(weights, "term").groupBy("question_id", "id").agg(F.sum(F.col("qtf") * F.col("tf") * F.col("idf") ** 2).alias("dot"))
    scored = dots.join(norms(index, tasks).hint("shuffle_hash"), "id").join(stored(lengths, "lengths"), "question_id").select("question_id", "id", F.round(F.col("dot") / (F.col("norm") * F.col("qnorm")), 6).alias("score"))
    return stored(top(scored.filter("score > 0"), "question_id", [F.desc("score"), F.asc("id")], k), "ranked")


def top(df: DataFrame, per: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key, numbered from 1 in column rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(per).orderBy(*order))).filter(F.col("rank") <= k)


def context(ranked: DataFrame, docs: DataFrame, per: str = "question_id") -> DataFrame:
    """(per, context): "[rank] title", a line end and the text of each hit, blank lines between."""
    lines = ranked.join(docs.select("id", "title", "summary"), "id").select(per, "rank", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), "title", F.lit("\n"), F.coalesce("summary", F.lit(""))).alias("line"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", "line")))
    return lines.groupBy(per).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n\n").alias("context"))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int = 4, rows: int = 4096) -> DataFrame:
    """(query_id, id, score, rank) of vectors (id, v) by inner product with queries (query_id, q), without equal ids.

    Queries and vectors meet in blocks of about `rows`, dealt by hash: each vector goes once to every block of
    queries. A block keeps k rows per query, so what is ranked at last is blocks times k rows.
    """
    n, m = vectors.count(), queries.count()
    xs, qs = max(1, -(-n // rows)), max(1, -(-m // rows))
    part = lambda c, of: F.pmod(F.xxhash64(c), F.lit(of)).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    given = vectors.select("id", F.col("v").cast("array<double>").alias("v")).withColumn("x", part("id", xs)).withColumn("y", each(qs))
    asked = queries.select("query_id", F.col("q").cast("array<double>").alias("q")).withColumn("y", part("query_id", qs)).withColumn("x", each(xs))

    def meet(asked: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(given):
            v, ids = np.stack(given["v"].to_numpy()), given["id"].to_numpy()
            for lo in range(0, len(asked), 256):
                some = asked.iloc[lo : lo + 256]
                scores = np.round(np.stack(some["q"].to_numpy()) @ v.T, 6)
                for q, line in zip(some["query_id"], scores):
                    line = np.where(ids == q, -np.inf, line)
                    least = np.partition(line, len(line) - k)[len(line) - k] if len(line) > k else -np.inf
                    at = np.flatnonzero((line >= least) & (line > -np.inf))  # ties at the end stay for now
                    best = at[np.lexsort((ids[at], -line[at]))[:k]]
                    out.append(pd.DataFrame({"query_id": q, "id": ids[best], "score": line[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "score": []})

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    met = asked.groupBy("x", "y").cogroup(given.groupBy("x", "y")).applyInPandas(meet, f"query_id {kind(queries, 'query_id')}, id {kind(vectors, 'id')}, score double")
    return top(met, "query_id", [F.desc("score"), F.asc("id")], k)


#: Documents that give floors, hits among rarer terms that are asked for, questions whose terms are looked up at once, and
#: about how many terms a question has.
WIDE, LEAST, QUESTIONS, TERMS = 64, 3, 1 << 15, 32


def lexical_seeds(index: TermIndex, questions: DataFrame, k: int = 2) -> DataFrame:
    """(question_id, id, hits, rank): documents by the number of distinct question terms that they hold.

    The documents with most terms give each question a floor: as many hits as its k best surely have. A document with
    so many holds some of the question's rarer terms, as the frequent ones alone are too few. So only these are looked
    up everywhere, and what holds enough of them is counted whole. The result, k rows a question, is stored.
    """
    asked = stored(question_terms(questions).select("question_id", "term"), "asked")
    best = _of_widest(index, asked, k)
    floors = best.groupBy("question_id").agg(F.when(F.count("*") == k, F.min("hits")).otherwise(1).alias("target"))
    return stored(top(_hits(index, asked, floors), "question_id", [F.desc("hits"), F.asc("id")], k), "seeds")


def most_hits(index: TermIndex, questions: DataFrame) -> DataFrame:
    """(question_id, hits): the largest number of a question's distinct terms that any document holds, if any is held.

    As lexical_seeds for one document, but which one does not matter, so only documents with more hits than the widest
    ones are looked for.
    """
    asked = stored(question_terms(questions).select("question_id", "term"), "asked")
    best = stored(_of_widest(index, asked, 1).select("question_id", "hits"), "floors")
    more = _hits(index, asked, best.select("question_id", (F.col("hits") + 1).alias("target")))
    return best.union(more.select("question_id", "hits")).groupBy("question_id").agg(F.max("hits").alias("hits"))


def _of_widest(index: TermIndex, asked: DataFrame, k: int) -> DataFrame:
    """(question_id, id, hits, rank): the k best for asked (question_id, term) among the documents with most terms."""
    wide = stored(index.postings.groupBy("id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(WIDE).select("id"), "wide")
    own = index.postings.join(F.broadcast(wide), "id", "left_semi").select("id", "term")
    return top(asked.join(own, "term").groupBy("question_id", "id").agg(F.count("*").alias("hits")), "question_id", [F.desc("hits"), F.asc("id")], k)


def _hits(index: TermIndex, asked: DataFrame, targets: DataFrame) -> DataFrame:
    """(question_id, id, hits): at least the documents with as many hits as targets (question_id, target; else 1), with all their hits.

    The rarer terms are looked up by 64-bit hashes of question, document and term, for QUESTIONS questions at a time.
    Where two hashes are equal, that only adds documents to those that are counted whole, by the terms themselves.
    """
    mark = lambda c: F.xxhash64(c)
    rare = stored(_rarer(index, asked, targets).select(mark("question_id").alias("q"), mark("term").alias("t"), "least"), "rarer")
    blocks = max(1, -(-rare.select("q").distinct().count() // QUESTIONS))
    tasks = max(index.df.sparkSession.sparkContext.defaultParallelism, -(-index.postings.count() // DEALT))
    posts = index.postings.select(mark("id").alias("d"), mark("term").alias("t")).repartition(tasks, "d")
    parts = []
    for block in range(blocks):
        met = posts.join(F.broadcast(rare.filter(F.pmod("q", F.lit(blocks)) == block)), "t").groupBy("q", "d").agg(F.count("*").alias("n"), F.min("least").alias("least"))
        parts.append(stored(met.filter("n >= least").select("q", "d"), "near"))
    near = reduce(DataFrame.union, parts)
    tasks = max(tasks, -(-near.count() * TERMS // DEALT))
    whole = near.join(asked.withColumn("q", mark("question_id")), "q").repartition(tasks, "d", "term").hint("shuffle_hash")
    whole = index.postings.select("id", "term", mark("id").alias("d")).join(whole, ["d", "term"])
    return whole.groupBy("question_id", "id").agg(F.count("*").alias("hits"))


def _rarer(index: TermIndex, asked: DataFrame, targets: DataFrame) -> DataFrame:
    """(question_id, term, least): terms of asked (question_id, term) of which a document of a question's target of hits holds `least`.

    Of m terms that documents have, the rarest m - target + least: without them, target - least are left. No document
    has more than m hits.
    """
    per = Window.partitionBy("question_id")
    ranked = asked.join(index.df, "term").select("question_id", "term", F.row_number().over(per.orderBy("df", "term")).alias("place"), F.count("*").over(per).alias("m"))
    known = ranked.join(targets, "question_id", "left").withColumn("target", F.coalesce("target", F.lit(1))).withColumn("least", F.least("target", F.lit(LEAST)))
    return known.filter((F.col("target") <= F.col("m")) & (F.col("place") <= F.col("m") - F.col("target") + F.col("least"))).select("question_id", "term", "least")


def within_budget(ranked: DataFrame, lengths: DataFrame, budgets: DataFrame, least: int) -> DataFrame:
    """The prefix of ranked (question_id, id, rank) up to where its context reaches the question's budget and `least` hits.

    lengths has (id, chars) of title and text; a rendered hit adds "[rank] ", a line end, and the gap before it.
    budgets has (question_id, budget). Where it is never reached, all stay.
    """
    by = Window.partitionBy("question_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    sign = F.length(F.col("rank").cast("string")) + 4
    run = ranked.join(lengths, "id").withColumn("length", F.sum(F.col("chars") + sign).over(by) + 2 * (F.col("rank") - 1)).join(budgets, "question_id")
    enough = F.when((F.col("length") >= F.col("budget")) & (F.col("rank") >= least), F.col("rank"))
    stop = F.min(enough).over(Window.partitionBy("question_id"))
    return run.withColumn("stop", stop).filter(F.col("stop").isNull() | (F.col("rank") <= F.col("stop"))).select("question_id", "id", "rank", "length")


def hybrid(first: DataFrame, second: DataFrame, extra: int = 3) -> DataFrame:
    """All of first (question_id, id, rank), then the first `extra` of second that it lacks; with their part."""
    more = top(second.join(first.select("question_id", "id"), ["question_id", "id"], "left_anti").withColumnRenamed("rank", "was"), "question_id", [F.asc("was")], extra)
    return first.select("question_id", "id", "rank", F.lit("first").alias("part")).union(more.select("question_id", "id", "rank", F.lit("added").alias("part")))


def sentences_of(docs: DataFrame) -> DataFrame:
    """(id, pos, sentence) of docs (id, summary)."""
    return docs.select("id", F.posexplode(t.sentences("summary")).alias("pos", "sentence"))


def sentence_hits(pairs: DataFrame, docs: DataFrame, questions: DataFrame) -> DataFrame:
    """(question_id, id, pos, sentence, hits): sentences of paired documents with the distinct question stems they hold."""
    own = docs.join(pairs.select("id").distinct(), "id", "left_semi")  # before texts are cut
    lines = stored(pairs.select("question_id", "id").join(sentences_of(own), "id"), "sentences")
    held = token_counts(lines, ["question_id", "id", "pos"], F.col("sentence")).join(question_terms(questions).select("question_id", "term"), ["question_id", "term"])
    counted = held.groupBy("question_id", "id", "pos").agg(F.count("*").cast("int").alias("hits"))
    return lines.join(counted, ["question_id", "id", "pos"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))


def supporting_sentence(pairs: DataFrame, docs: DataFrame, questions: DataFrame) -> DataFrame:
    """(question_id, id, sentence, hits): the sentence of each paired document with most distinct question stems; the first of equals."""
    best = top(sentence_hits(pairs, docs, questions), "question_id", [F.desc("hits"), F.asc("id"), F.asc("pos")], 1)
    return best.select("question_id", "id", t.compact(F.col("sentence")).alias("sentence"), "hits")


def extractive_answer(pairs: DataFrame, docs: DataFrame, questions: DataFrame) -> DataFrame:
    """(question_id, answer): the two sentences over 15 characters with most question stems, shorter ones first among equals."""
    scored = sentence_hits(pairs, docs, questions).withColumn("n", F.length("sentence")).filter("hits > 0 and n > 15")
    best = top(scored, "question_id", [F.desc("hits"), F.asc("n"), F.asc("id"), F.asc("pos")], 2)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "sentence"))), lambda x: x["sentence"])
    return best.groupBy("question_id").agg(F.array_join(ordered, " ").alias("answer"))


def term_profiles(docs: DataFrame, k: int = 12) -> DataFrame:
    """(id, term, weight, rank): the k heaviest terms by (1 + ln tf) * (ln((N + 1) / (df + 1)) + 1), stems of four or more that are no numbers."""
    posts = stored(postings(docs).filter((F.length("term") >= 4) & ~F.col("term").rlike("^[0-9]+$")), "profiles")
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-posts.count() // DEALT))
    size, df = docs.agg(F.count("*").alias("n")), posts.repartition(tasks, "term").groupBy("term").agg(F.count("*").alias("df"))
    weight = (1 + F.log("tf")) * (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1)
    # Terms are weighed where they are counted, and then dealt by document in portions, to be sorted once.
    weighted = posts.join(df.hint("shuffle_hash"), "term").crossJoin(F.broadcast(size)).select("id", "term", F.round(weight, 6).alias("weight"))
    return top(weighted.repartition(tasks, "id"), "id", [F.desc("weight"), F.asc("term")], k)
