"""Embedding cache, dense hits, and trials that are carried on."""

import pytest
from pyspark.sql import functions as F

from korrel.operators import embeddings, planner, trials
from korrel.operators.embeddings import Model


def test_texts_are_encoded_once(spark, tmp_path):
    cache, texts = str(tmp_path / "cache"), [(1, "eins"), (2, "zwei"), (3, "eins"), (4, None), (5, ""), (6, "drei" * 9000)]
    frame = lambda rows: spark.createDataFrame(rows, "id long, text string").repartition(3)

    def strict(wanted):
        def encode(some):
            if not set(some) <= wanted:
                raise AssertionError(some)
            return embeddings.character_shares(some)

        return encode

    known = {t or "" for _, t in texts}
    first = {r["id"]: list(r["v"]) for r in embeddings.embedded(frame(texts), Model("m", strict(known)), cache).collect()}
    assert first == {i: embeddings.character_shares([t or ""])[0] for i, t in texts}
    held = embeddings.kept(spark, cache, Model("m", len))
    assert held.count() == len(known)
    again = embeddings.embedded(frame(texts), Model("m", strict(set())), cache)  # nothing is missing
    assert {r["id"]: list(r["v"]) for r in again.collect()} == first
    more = embeddings.embedded(frame([*texts, (7, "neu")]), Model("m", strict({"neu"})), cache)
    assert more.count() == 7 and held.sparkSession.read.schema(embeddings.CACHE).parquet(Model("m", len).folder(cache)).count() == len(known) + 1
    with pytest.raises(Exception, match="AssertionError"):  # another model shares nothing
        embeddings.embedded(frame(texts), Model("other", strict(set())), cache).count()
    assert embeddings.embedded(frame([(1, "x")]).limit(0), Model("m", strict(set())), cache).count() == 0


def test_a_call_keeps_its_own_vectors(spark, tmp_path, monkeypatch):
    """Of a cache, only the vectors of the call's texts are stored again; a text that it holds twice counts once."""
    cache, model, counts = str(tmp_path / "cache"), Model("m", embeddings.character_shares), []
    frame = lambda rows: spark.createDataFrame(rows, "id long, text string")
    embeddings.embedded(frame([(i, f"text {i}") for i in range(40)]), model, cache)

    def stored(df, what, real=embeddings.stored):
        made = real(df, what)
        counts.append((what, made.count()))
        return made

    monkeypatch.setattr(embeddings, "stored", stored)
    assert embeddings.embedded(frame([(1, "text 7"), (2, "text 7")]), model, cache).count() == 2
    assert counts == [("texts", 2), ("vectors", 2)]
    held = embeddings.kept(spark, cache, model)
    held.filter("digest = unhex(sha2('text 7', 256))").write.mode("append").parquet(model.folder(cache))
    assert [r["id"] for r in embeddings.embedded(frame([(1, "text 7"), (2, "text 8")]), model, cache).orderBy("id").collect()] == [1, 2]


def test_dense_hits_fall_back(spark):
    nodes = spark.createDataFrame([("a", "Kant", "schrieb Kritik"), ("b", "Zoo", "xx yy zz"), ("c", "Hegel", None)], "id string, title string, summary string")
    asked = spark.createDataFrame([(1, "Wer schrieb die Kritik: Kant?")], "id int, text string")
    edges = spark.createDataFrame([], "source string, target string, relation string, label string")
    fine = planner.Retrieved(asked, nodes, edges, model=Model("m", embeddings.character_shares))
    rows, how = trials.hits_or_lexical(lambda: fine.hits, lambda: 1 / 0)
    assert how == "dense" and [r["id"] for r in rows.orderBy("rank").collect()][0] == "a" and rows.count() == 3

    def broken(texts):
        raise RuntimeError("no model")

    lexical = planner.Retrieved(asked, nodes, edges)
    rows, how = trials.hits_or_lexical(lambda: planner.Retrieved(asked, nodes, edges, model=Model("x", broken)).hits, lambda: lexical.hits)
    assert how == "tfidf" and [r["id"] for r in rows.collect()] == ["a"]


def test_trials_are_carried_on(spark, tmp_path):
    folder = str(tmp_path / "results")
    plans = [("run", 1, q, c, ["a", f"n{q}"], f"k{q}", f"{c} {q}") for q in range(6) for c in ("vector", "graph")]
    planned = spark.createDataFrame(plans, "run_id string, repetition int, question_id int, condition string, ids array<string>, context string, prompt string").repartition(3)
    questions = spark.createDataFrame([(q, [f"antwort {q}"], None, False, [f"n{q}", "z"]) for q in range(5)], "question_id int, must array<string>, any_of array<string>, abstain boolean, gold array<string>")
    assert trials.results(spark, folder) is None

    def first(prompt):
        if prompt.startswith("graph 3"):
            raise ValueError("kaputt")
        return f"Antwort {prompt[-1]}"

    half = planned.filter("question_id < 4")
    failed = trials.executed(half, questions, first, "e1", folder).collect()
    assert [(r["question_id"], r["condition"], r["error"]) for r in failed] == [(3, "graph", "ValueError: kaputt")]
    assert trials.results(spark, folder).count() == 7

    def second(prompt):
        if not prompt.endswith(("4", "5")) and prompt != "graph 3":
            raise AssertionError("was done before")
        return "keine Information"

    assert trials.executed(planned, questions, second, "e2", folder).count() == 0
    got = {(r["question_id"], r["condition"]): r for r in trials.results(spark, folder).collect()}
    assert len(got) == 12 and {k for k, r in got.items() if r["engine"] == "e2"} == {(3, "graph"), (4, "vector"), (4, "graph"), (5, "vector"), (5, "graph")}
    assert got[0, "vector"]["auto_score"] == "korrekt" and got[4, "vector"]["auto_score"] == "enthaltung"
    assert got[0, "vector"]["recall"] == 0.5 == got[0, "vector"]["precision"] and got[5, "graph"]["recall"] is None
    assert all(r["latency_ms"] >= r["generation_ms"] >= 0 and r["context_chars"] == 2 for r in got.values())
    spark.read.parquet(folder).limit(3).write.mode("append").parquet(folder)  # a task's rows come twice
    assert trials.results(spark, folder).count() == 12
    assert trials.executed(planned, questions, second, "e3", folder).count() == 0 and trials.results(spark, folder).filter(F.col("engine") == "e3").count() == 0
