"""Running planned trials: answers, times and scores, appended once per trial and carried on after an end."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korrel.functions import text as t
from korrel.operators import scoring
from korrel.plans.scratch import stored

#: What tells a trial apart.
KEY = ["run_id", "repetition", "question_id", "condition"]
_MADE = "answer string, error string, generation_ms double, finished_at long"
Answer = Callable[[str], str]


def results(spark: SparkSession, folder: str) -> DataFrame | None:
    """The trials that a folder holds, one row for each, the first that was finished; None before the first run."""
    try:
        rows = spark.read.parquet(folder)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    rest = [c for c in rows.columns if c not in KEY]
    return rows.groupBy(*KEY).agg(F.min_by(F.struct(*rest), "finished_at").alias("r")).select(*KEY, "r.*")


def executed(planned: DataFrame, questions: DataFrame, answer: Answer, engine: str, folder: str) -> DataFrame:
    """Runs the planned trials (KEY, ids, context, prompt) that a folder does not hold yet, and returns (KEY, error) of those that failed.

    answer turns a prompt into text inside a task, trial by trial. A trial whose answer raises is left for the next run;
    the others are appended with answer, engine, times, score by the question's phrases, and recall and precision of its
    evidence. questions: (question_id, must, any_of, abstain, gold), at most one row each; trials without a question have
    no must and score as such. A job that ends half-way has appended what its tasks committed or nothing; a second run
    does the rest, and results() tells repeats apart. prepare_ms is the time for this run's plans, over all its trials.
    """
    spark = planned.sparkSession
    have, began = results(spark, folder), time.perf_counter()
    left = planned if have is None else planned.join(have.select(*KEY), KEY, "left_anti")
    todo = stored(left.select(*KEY, "ids", "context", "prompt"), "trials")
    count = todo.count()
    prepare = (time.perf_counter() - began) * 1000 / max(1, count)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for prompt in batch["prompt"]:
                at = time.perf_counter()
                try:
                    made = (answer(prompt), None)
                except Exception as e:  # one trial's failure is not another's
                    made = (None, f"{type(e).__name__}: {e}"[:500])
                rows.append((*made, (time.perf_counter() - at) * 1000, int(time.time() * 1000)))
            yield batch.assign(**dict(zip(("answer", "error", "generation_ms", "finished_at"), map(list, zip(*rows)))))

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in todo.schema)
    made = stored(todo.mapInPandas(run, f"{kind}, {_MADE}"), "answers")
    good = made.filter("error is null").join(questions.select("question_id", "must", "any_of", "abstain", "gold"), "question_id", "left")
    recall, precision = scoring.evidence(F.col("gold"), F.col("ids"))
    ms = lambda c: t.rounded(c, 1)
    scored = good.select(
        *KEY, "answer", F.lit(engine).alias("engine"), F.length("context").alias("context_chars"), F.col("ids").alias("retrieved"), F.lit("end-to-end").alias("latency_scope"),
        ms(F.lit(prepare) + F.col("generation_ms")).alias("latency_ms"), ms(F.lit(prepare)).alias("prepare_ms"), ms(F.col("generation_ms")).alias("generation_ms"),
        scoring.auto_score(F.col("answer"), F.coalesce("must", F.array().cast("array<string>")), F.col("any_of"), F.col("abstain")).alias("auto_score"), recall.alias("recall"), precision.alias("precision"), "finished_at",
    )
    scored.write.mode("append").parquet(folder)
    return made.filter("error is not null").select(*KEY, "error")


def hits_or_lexical(dense: Callable[[], DataFrame], lexical: Callable[[], DataFrame]) -> tuple[DataFrame, str]:
    """Dense hits and 'dense'; where they cannot be made, lexical ones and 'tfidf'."""
    try:
        return stored(dense(), "hits"), "dense"
    except Exception:  # whatever an encoder or its model raises, the run goes on
        return stored(lexical(), "hits"), "tfidf"
