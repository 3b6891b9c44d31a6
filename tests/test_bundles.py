"""Export bundles and stored graphs, written and read again."""

from pyspark.sql import functions as F

from korrel.queries.imports import _trials
from korrel.sources import bundles, io


def test_bundle(spark, small, tmp_path):
    trials = io.normalized_trials(_trials(spark, small))
    n, path = trials.count(), str(tmp_path / "bundle")
    nodes, edges = spark.range(7).withColumnRenamed("id", "x"), spark.range(3)
    questions = spark.createDataFrame([("q2",), ("q1",)], "id string")
    about = bundles.header(spark, "korrel", "seeded", "Antworte.", ["vector", "graph"], nodes, edges, questions, n)
    bundles.write_bundle(trials, path, about)
    bundles.write_bundle(trials, path, about)  # written again, it is the same
    said, back, lines = bundles.read_bundle(spark, path)
    assert said == about and set(said) == {"exportedAt", "tool", "schemaVersion", "reproducibility", "timing", "ordering", "results"}
    assert said["reproducibility"]["questions"] == {"n": 2, "ids": ["q1", "q2"]} and said["reproducibility"]["corpus"] == {"nodes": 7, "edges": 3, "frozen": True}
    assert sorted(map(str, back.collect())) == sorted(map(str, trials.select(back.columns).collect())) and said["results"]["n"] == n
    assert sorted(r["value"] for r in lines.collect()) == sorted(r["line"] for r in io.csv_lines(trials).collect())
    assert spark.read.text(f"{path}/README").first()["value"] == bundles.README
    assert [r["value"] for r in spark.read.text(f"{path}/csv").limit(1).collect()] == [";".join(io.EXPORTED)]


ENTRY = dict.fromkeys("sourceId importScopeId sourceKind sourceTitle importedAt method confidence evidence page pageEnd section charStart charEnd url pageId revisionId targetTitle score threshold sharedTerms contentFingerprint".split())


def test_saved_graph(spark, tmp_path):
    folder = str(tmp_path / "graph")
    good, bad = ENTRY | {"sourceId": "s", "method": "m"}, ENTRY | {"sourceId": "s"}
    nodes = spark.createDataFrame([("a", "A", "t", "c", None, "", True, [good, bad, good]), ("a", "Z", "t", "c", None, "", True, []), ("", "x", "t", "c", None, "", True, []), ("b", None, "t", "c", None, "", True, []), ("d", "D", "t", "c", None, None, True, [])], io.NODE)
    edges = spark.createDataFrame([("a", "b", "r", "l", [good]), ("a", "b", "r", "l", [good]), ("a", "a", "r", "l", [good]), ("a", "b", "", "l", [good]), ("a", "b", "q", None, [good])], f"source string, target string, relation string, label string, provenance {io.PROVENANCE}")
    assert bundles.saved_graph(spark, folder) is None
    reports = spark.createDataFrame([(k, f"r{k}") for k in range(40)], "at long, report string")
    bundles.save_graph(folder, 1, nodes, edges, reports)
    n, e, r = bundles.saved_graph(spark, folder)
    assert [(x["id"], x["title"], len(x["provenance"])) for x in n.collect()] == [("a", "A", 1)]
    assert [(x["source"], x["relation"], x["target"], len(x["provenance"])) for x in e.collect()] == [("a", "r", "b", 1)]
    assert {x["at"] for x in r.collect()} == set(range(10, 40))
    bundles.save_graph(folder, 2, nodes.limit(0), edges.limit(0))  # without reports, the earlier ones stay
    n, _, r = bundles.saved_graph(spark, folder)
    assert n.count() == 0 and r.count() == 30 and bundles.saved_graph(spark, folder, 2)[0].count() == 1
    bundles.save_graph(folder, 2, nodes, edges, reports.filter("at < 2"))
    assert bundles.saved_graph(spark, folder)[0].count() == 1 and bundles.saved_graph(spark, folder)[2].count() == 2


def test_kept_research(spark):
    own = spark.createDataFrame([("a", "A")], "id string, title string")
    kind = f"source string, target string, relation string, label string, provenance {io.PROVENANCE}"
    entry = ENTRY | {"sourceId": "s", "method": "m"}
    have = spark.createDataFrame([("a", "b", "r", "alt", [entry])], kind)
    n, e = bundles.kept_research(own, have, spark.createDataFrame([("a", "neu"), ("b", "B"), ("b", "B")], "id string, title string"), spark.createDataFrame([("a", "b", "r", "neu", [entry]), ("b", "a", "r", "l", [])], kind))
    assert sorted(map(tuple, n.collect())) == [("a", "A"), ("b", "B")]
    assert {(x["source"], x["target"]): (x["label"], len(x["provenance"])) for x in e.select("source", "target", "label", F.col("provenance")).collect()} == {("a", "b"): ("alt", 1), ("b", "a"): ("l", 0)}
