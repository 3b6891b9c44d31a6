"""Experiment statistics: roll-ups, intervals, paired tests, agreement, pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korrel.functions.text import rounded
from korrel.plans.scratch import stored

SCORES = ("korrekt", "teilweise", "falsch", "enthaltung")
Z = 1.96


#: Stretches that an exact rank is looked for in, and what a row of the summary that bounds them may weigh.
STRETCHES, ACCURACY = 500, 5000


def exact_ranks(rows: DataFrame, key: str, value: str, places: dict[str, Column]) -> DataFrame:
    """(key, one column per place): the values at exact places, counted from 1, of each key's ascending values.

    places are expressions of n, the number of values that are no null. A mergeable summary cuts every key's values
    into stretches, whose counts say which one holds a place; only that one's distinct values are then put in order.
    So a key of very many rows is never one task's group or one row's buffer. Null keys are left out.
    """
    known = rows.select(key, F.col(value).cast("double").alias("v")).filter(F.col(key).isNotNull() & F.col("v").isNotNull())
    shares = F.array(*[F.lit(i / STRETCHES) for i in range(1, STRETCHES)])
    bounds = stored(known.groupBy(key).agg(F.percentile_approx("v", shares, ACCURACY).alias("bounds")), "bounds")
    part = F.size(F.filter(F.array_distinct("bounds"), lambda b: b < F.col("v")))
    counted = stored(known.join(bounds, key).select(key, part.alias("part"), "v").groupBy(key, "part", "v").agg(F.count("*").alias("k")), "values")
    parts = counted.groupBy(key, "part").agg(F.sum("k").alias("k"))
    w = Window.partitionBy(key)
    upto = parts.withColumns({"n": F.sum("k").over(w), "end": F.sum("k").over(w.orderBy("part"))}).withColumn("begin", F.col("end") - F.col("k"))  # a key has STRETCHES rows here
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), at.cast("long").alias("place")) for name, at in places.items()]))
    found = upto.select(key, "part", "begin", "end", wanted.alias("w")).filter((F.col("w.place") > F.col("begin")) & (F.col("w.place") <= F.col("end")))
    near = counted.join(found.select(key, "part", "begin", F.col("w.name").alias("name"), F.col("w.place").alias("place")), [key, "part"])
    run = F.sum("k").over(Window.partitionBy(key, "part", "name").orderBy("v")) + F.col("begin")
    at = near.withColumn("run", run).filter((F.col("run") >= F.col("place")) & (F.col("run") - F.col("k") < F.col("place")))
    return at.groupBy(key).agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in places])


def nearest_rank(p: float) -> Column:
    """The place max(1, ceil(p * n)) among n ascending values."""
    return F.greatest(F.lit(1), F.ceil(F.col("n") * p))


def upper_median() -> Column:
    """The place of the element at floor(n / 2), counted from 0, among n ascending values."""
    return F.floor(F.col("n") / 2) + 1


def by_condition(trials: DataFrame, conditions: DataFrame) -> DataFrame:
    """One row per condition, also for those without trials."""
    end = F.when(F.col("scope") == "end-to-end", F.col("latency_ms"))
    full = F.when(F.col("recall") >= 1, F.col("score") == "korrekt").cast("double")
    own = trials.withColumns({"e2e": end, "given": full}).groupBy("condition").agg(
        F.count("*").alias("n"), *[F.count_if(F.col("score") == s).alias(s) for s in SCORES], F.count("e2e").alias("latency_n"),
        F.floor(F.avg("context_chars") + 0.5).alias("mean_context"), F.round(F.avg("recall"), 6).alias("mean_recall"), F.round(F.avg("given"), 6).alias("accuracy_given_evidence"),
    )
    ranks = exact_ranks(trials.withColumn("e2e", end), "condition", "e2e", {"p50": nearest_rank(0.5), "p95": nearest_rank(0.95)})
    own = own.join(ranks, "condition", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n", *SCORES, "latency_n", "p50", "p95", "mean_context")]
    accuracy = F.coalesce(F.try_divide(F.col("korrekt"), F.col("n")), F.lit(0.0))
    return conditions.join(own, "condition", "left").select("condition", *zero, F.round(accuracy, 6).alias("accuracy"), "mean_recall", "accuracy_given_evidence")


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """Bounds of the 95 % Wilson interval of k of n; [0, 0] for none."""
    p = k / n
    centre, spread = p + Z * Z / (2 * n), Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))
    low, high = (centre - spread) / (1 + Z * Z / n), (centre + spread) / (1 + Z * Z / n)
    none = n == 0
    return F.when(none, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), low)), F.when(none, F.lit(0.0)).otherwise(F.least(F.lit(1.0), high))


def accuracy_intervals(trials: DataFrame, *keys: str) -> DataFrame:
    """n, correct, accuracy and Wilson bounds per observed combination of keys."""
    counted = trials.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("score") == "korrekt").alias("correct"))
    low, high = wilson(F.col("correct").cast("double"), F.col("n").cast("double"))
    return counted.select(*keys, "n", "correct", F.round(F.col("correct") / F.col("n"), 6).alias("accuracy"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def mcnemar_exact(b: Column, c: Column) -> Column:
    """Exact two-sided McNemar p of b and c discordant pairs; null for none. Terms are summed in logarithms."""
    n, k = (b + c).cast("double"), F.least(b, c)
    half = n * F.log(F.lit(0.5))
    terms = F.aggregate(
        F.sequence(F.lit(0).cast("long"), k.cast("long")), F.struct(half.alias("log"), F.lit(0.0).alias("sum")),
        lambda s, i: F.struct((s["log"] + F.when(i > 0, F.log(n - i + 1) - F.log(i.cast("double"))).otherwise(0.0)).alias("log"), (s["sum"] + F.exp(s["log"] + F.when(i > 0, F.log(n - i + 1) - F.log(i.cast("double"))).otherwise(0.0))).alias("sum")),
        lambda s: F.least(F.lit(1.0), 2 * s["sum"]),
    )
    return F.when(b + c > 0, terms)


def paired(trials: DataFrame, keys: list[str], contrasts: DataFrame) -> DataFrame:
    """A row per contrast (a, b) with pairs: condition a against b on equal keys, all contrasts in one join.

    Of b's rows with one key the last counts; a's rows all do.
    """
    right = trials.groupBy(*keys, F.col("condition").alias("b")).agg(F.max_by("score", "ord").alias("score_b"))
    left = trials.select(*keys, F.col("condition").alias("a"), F.col("score").alias("score_a")).join(contrasts.select("a", "b").distinct(), "a")
    pairs = left.join(right, [*keys, "b"])
    ok_a, ok_b = F.col("score_a") == "korrekt", F.col("score_b") == "korrekt"
    counted = pairs.groupBy("a", "b").agg(F.count("*").alias("pairs"), F.count_if(ok_a).alias("correct_a"), F.count_if(ok_b).alias("correct_b"), F.count_if(ok_a & ~ok_b).alias("a_only"), F.count_if(~ok_a & ok_b).alias("b_only"))
    share = lambda c: F.round(c / F.col("pairs"), 6)
    return counted.select(
        "a", "b", "pairs", share(F.col("correct_a")).alias("accuracy_a"), share(F.col("correct_b")).alias("accuracy_b"),
        share(F.col("correct_a") - F.col("correct_b")).alias("delta"), "a_only", "b_only", F.round(mcnemar_exact(F.col("a_only"), F.col("b_only")), 6).alias("p"),
    )


def cohens_kappa(ratings: DataFrame) -> DataFrame:
    """One row (kappa, n, agree) of ratings (a, b); rows with a null are left out; kappa is 1 where chance agrees fully."""
    cells = ratings.filter("a is not null and b is not null").groupBy("a", "b").agg(F.count("*").alias("n"))
    total = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))), F.lit(0)).alias("agree"))
    rows, columns = cells.groupBy("a").agg(F.sum("n").alias("x")), cells.groupBy(F.col("b").alias("a")).agg(F.sum("n").alias("y"))
    chance = rows.join(columns, "a").agg(F.coalesce(F.sum(F.col("x").cast("double") * F.col("y")), F.lit(0.0)).alias("xy"))
    both = total.crossJoin(chance)  # one row each
    po, pe = F.try_divide(F.col("agree"), F.col("n")), F.try_divide(F.col("xy"), F.col("n").cast("double") * F.col("n"))
    return both.select(F.round(F.when(pe >= 1, 1.0).otherwise(F.try_divide(po - pe, 1 - pe)), 6).alias("kappa"), "n", "agree")


def accuracy_pivot(trials: DataFrame, categories: list[str]) -> DataFrame:
    """condition by category accuracy; 0 where there is no trial."""
    hit = (F.col("score") == "korrekt").cast("double")
    return trials.groupBy("condition").agg(*[F.round(F.coalesce(F.avg(F.when(F.col("category") == c, hit)), F.lit(0.0)), 6).alias(c) for c in categories])


def running_score(answers: DataFrame, who: str, order: str) -> DataFrame:
    """answers with the correct count so far and the length of the current streak."""
    w = Window.partitionBy(who).orderBy(order)
    hit = F.col("correct").cast("int")
    with_miss = answers.withColumns({"so_far": F.sum(hit).over(w), "misses": F.sum(1 - hit).over(w)})
    return with_miss.withColumn("streak", F.sum(hit).over(Window.partitionBy(who, "misses").orderBy(order))).drop("misses")


def upper_medians(trials: DataFrame) -> DataFrame:
    """The upper median of latency per condition."""
    return exact_ranks(trials, "condition", "latency_ms", {"median": upper_median()})


def mean_context(trials: DataFrame) -> DataFrame:
    """Mean latency per condition to two digits, half up."""
    return trials.groupBy("condition").agg(rounded(F.round(F.avg("latency_ms"), 9), 2).alias("mean_ms"))


def effective(trials: DataFrame) -> DataFrame:
    """trials with score: the manual one where there is one, else the automatic."""
    return trials.withColumn("score", F.coalesce("manual_score", "auto_score"))


def consensus(trials: DataFrame) -> DataFrame:
    """trials with the manual score that both blind raters gave; where they differ or one is missing it stays."""
    return trials.withColumn("manual_score", F.when(F.col("blind_a") == F.col("blind_b"), F.col("blind_a")).otherwise(F.col("manual_score")))


def rating_state(trials: DataFrame) -> DataFrame:
    """trials with what their raters did: unrated (by a, by b), conflict or agreed."""
    a, b = F.col("blind_a").isNull(), F.col("blind_b").isNull()
    return trials.withColumns({"unrated_a": a, "unrated_b": b, "conflict": F.coalesce(~a & ~b & (F.col("blind_a") != F.col("blind_b")), F.lit(False)), "agreed": F.coalesce(F.col("blind_a") == F.col("blind_b"), F.lit(False))})


def rated(trials: DataFrame, ratings: DataFrame) -> DataFrame:
    """trials (id) with the newest rating (id, slot, score, ord) of each slot a and b set; other fields stay."""
    newest = ratings.groupBy("id").agg(*[F.max_by(F.when(F.col("slot") == s, F.col("score")), F.when(F.col("slot") == s, F.col("ord"))).alias(f"new_{s}") for s in "ab"])
    return trials.join(newest, "id", "left").withColumns({f"blind_{s}": F.coalesce(f"new_{s}", f"blind_{s}") for s in "ab"}).drop("new_a", "new_b")


def of_run(trials: DataFrame, run: str = "all", engine: str = "all") -> DataFrame:
    """trials of a run and an engine; all are wildcards, latest is the run of the trial with the largest ord."""
    out = trials if engine == "all" else trials.filter(F.col("engine") == engine)
    if run == "all":
        return out
    chosen = trials.agg(F.max_by("run_id", "ord").alias("run_id")) if run == "latest" else trials.select("run_id").filter(F.col("run_id") == run).distinct()
    return out.join(F.broadcast(chosen), "run_id", "left_semi")  # one row
