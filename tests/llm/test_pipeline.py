"""The pipeline's stages on the smallest tables, and on strange ones."""

import corpus_pipeline
from korrel.llm import decontamination, neardup
from korrel.llm.secrets import scan


def test_stages(spark, small):
    docs, seen = spark.read.parquet(f"{small}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small).cache()
        seen.append(out.count())
        if name == "near_duplicates":
            kept = {r["doc_id"] for r in neardup.near_duplicates(docs).filter("kept").collect()}
            assert {r["doc_id"] for r in out.collect()} == kept
        if name == "decontamination":
            items = [decontamination.normal(r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
            assert not any(i in decontamination.normal(r["text"]) for r in out.collect() for i in items)
        if name == "secrets":
            assert scan(out).filter("size(base_spans) > 0").count() == 0
        if name != corpus_pipeline.STAGES[-1][0]:
            assert tuple(out.columns) == corpus_pipeline.COLUMNS
        docs = out
    assert seen[0] >= seen[1] >= seen[2] == seen[3] == seen[4] > 100


def test_strange_rows(spark, small):
    rows = [(None, None, None, None, None), (1, "", "x", None, 0), (1, "", "x", None, 0), (2, "wort " * 20_000, None, "s", None), (3, "kurz", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, small).count() >= 3
        assert stage(spark, docs.limit(0), small).count() == 0


def test_one_of_each_rows(spark, small):
    long = " ".join(f"wort{i}" for i in range(50))
    rows = [
        (None, long, "a", None, 1), (None, long, "a", None, 1), (None, None, None, None, None),  # in no group
        (1, long, "a", "s", 1), (2, long, "b", "s", 1), (3, "kurz", None, None, None),
        (4, "eins", "b", None, 4), (4, "eins", "a", "s", 4), (4, "eins", "a", "s", 4), (4, None, "a", "s", None),  # one document
        (5, "", None, None, 0), (5, long, None, None, 0),  # its second row is a copy of 1
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.one_of_each(spark, docs, small)
    assert sorted(map(tuple, out.collect()), key=str) == sorted([*rows[:4], rows[5], rows[7]], key=str)
