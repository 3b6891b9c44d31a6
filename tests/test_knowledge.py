"""Triples with evidence, document imports, capped edges, quiz decks and growth against plain Python, with edge cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from korrel.operators import build, documents, growth, quiz, triples

NODES = "id string, title string, type string, aliases array<string>"


# Triples
def test_resolver_knows_last_names_and_drops_shared_ones(spark):
    nodes = spark.createDataFrame(
        [("h", "Georg Hegel", "person", ["G. W. F."]), ("k", "Immanuel Kant", "person", None), ("m", "Rolf Kant", "person", []), ("w", "Kritik der Vernunft", "work", None), ("x", "Hegel Haus", "place", None), ("o", "Ö", "place", None), ("n", None, "person", None), ("h", "Georg Hegel", "person", None)], NODES,
    )
    assert {tuple(r) for r in triples.resolver(nodes).collect()} == {("georg hegel", "h"), ("hegel", "h"), ("g. w. f.", "h"), ("immanuel kant", "k"), ("rolf kant", "m"), ("kritik der vernunft", "w"), ("hegel haus", "x")}


def test_triples_need_evidence(spark):
    nodes = spark.createDataFrame([("a", "Anna (Berg)", "person", None), ("b", "Bert", "person", None), ("c", "C++ Buch", "work", ["Buch"]), ("d", "Dora", "person", ["Do\\Era"])], NODES)
    text = "Anna  (Berg) kannte Bert gut. »Bert!« Er verfasste das C++ Buch. Dora lebte. BERT kritisierte dann Dora. Do\\Era mag Bert."
    texts = spark.createDataFrame([(1, text), (2, None), (3, "Bertram verfasste Doras Buch.")], "id long, text string")
    claims = [
        (1, 0, "Anna (Berg)", "kannte", "Bert"), (1, 1, "bert", "kritisierte", "dora"), (1, 2, "Bert", "verfasste", "C++ Buch"), (1, 3, "Bert", "kannte", "bert"), (1, 4, "Niemand", "kannte", "Bert"),
        (1, 5, "Anna (Berg)", "Kannte", " Bert "), (1, 6, "Dora", "mag", "Bert"), (1, 7, None, "mag", "Bert"), (1, 8, "Do\\Era", "mag", "Bert"), (1, 9, "Bert", "!!", "Anna (Berg)"), (1, 10, "Bert", "gut.", "Anna (Berg)"),
        (2, 0, "Bert", "kannte", "Dora"), (3, 0, "Bert", "verfasste", "Buch"), (9, 0, "Bert", "kannte", "Dora"),
    ]
    decided = triples.judged(texts, spark.createDataFrame(claims, "id long, pos int, subject string, relation string, object string"), nodes)
    got = {(r["id"], r["pos"]): r for r in decided.collect()}
    assert {k: r["verdict"] for k, r in got.items()} == {
        (1, 0): "kept", (1, 1): "kept", (1, 2): "kept", (1, 3): "self", (1, 4): "unresolved", (1, 5): "repeated", (1, 6): "unsupported", (1, 7): "unresolved", (1, 8): "kept", (1, 9): "unsupported", (1, 10): "kept",
        (2, 0): "unsupported", (3, 0): "unsupported", (9, 0): "unsupported",
    }
    assert text[got[1, 1]["start"] : got[1, 1]["end"]] == "BERT kritisierte dann Dora."
    made = {(r["source"], r["relation"], r["target"]): r for r in triples.edges(decided, texts).collect()}
    assert set(made) == {("a", "kannte", "b"), ("b", "kritisierte", "d"), ("b", "verfasste", "c"), ("d", "mag", "b"), ("b", "gut_", "a")} and made["a", "kannte", "b"]["label"] == "kannte"
    assert {r["id"]: tuple(r)[1:] for r in triples.rejects(decided).collect()} == {1: (11, 5, 1, 2, 1, 2), 2: (1, 0, 0, 0, 0, 1), 3: (1, 0, 0, 0, 0, 1), 9: (1, 0, 0, 0, 0, 1)}


# Capped edges
def greedy(pairs, per_a, per_b, symmetric):
    used, out = {}, set()
    for a, b, score, shared in sorted(pairs, key=lambda p: (-p[2], -p[3], p[0], p[1])):
        x, y = ("a", a), ("a" if symmetric else "b", b)
        if used.get(x, 0) < per_a and used.get(y, 0) < per_b:
            used[x], used[y] = used.get(x, 0) + 1, used.get(y, 0) + 1
            out.add((a, b))
    return out


@pytest.mark.parametrize(("symmetric", "limit"), [(True, 20_000), (False, 20_000), (True, 10)])
def test_capped_chain_of_ties(spark, monkeypatch, symmetric, limit):
    """A thousand equal pairs in a row are no thousand rounds; with small groups only, rounds still give the same."""
    monkeypatch.setattr(build, "SETTLED", limit)
    length = 1000 if limit > 10 else 12
    pairs = [(f"n{k:05d}", f"n{k + 1:05d}", 0.5, 3) for k in range(length)]
    r = random.Random(1)
    pairs += [(f"m{r.randint(0, 40):02d}", f"o{r.randint(0, 40):02d}", r.choice([0.3, 0.4]), r.choice([2, 3])) for _ in range(300 if limit > 10 else 20)]
    pairs = list({(a, b): (a, b, s, n) for a, b, s, n in pairs}.values())
    df = spark.createDataFrame(pairs, "a string, b string, score double, shared int")
    rounds, keep = [], build.stored
    monkeypatch.setattr(build, "stored", lambda df, what: keep(df, rounds.append(what) or what))
    cap = (1, 1) if symmetric else (2, 4)
    assert {(x["a"], x["b"]) for x in build.capped(df, "score", *cap, symmetric).collect()} == greedy(pairs, *cap, symmetric)
    assert rounds.count("taken") < 15


@pytest.mark.parametrize(("symmetric", "block", "levels"), [(True, 20, 200), (False, 20, 200), (True, 20, 3), (False, 20, 3), (True, 10_000, 3)])
def test_capped_in_blocks(spark, monkeypatch, symmetric, block, levels):
    """Blocks of falling scores are the greedy choice, also where ties make a block too large for one task; few are needed."""
    monkeypatch.setattr(build, "BLOCK", block, raising=False)
    r = random.Random(levels)
    pairs = {(f"n{a:02d}", f"n{b:02d}"): (r.randint(1, levels) / levels, r.choice([2, 3])) for a in range(24) for b in range(24) if a < b}
    pairs = [(a, b, *x) for (a, b), x in pairs.items()]
    df = spark.createDataFrame(pairs, "a string, b string, score double, shared int").repartition(3)
    parts, keep = [], build.stored
    monkeypatch.setattr(build, "stored", lambda df, what: keep(df, parts.append(what) or what))
    cap = (2, 2) if symmetric else (2, 4)
    assert {(x["a"], x["b"]) for x in build.capped(df, "score", *cap, symmetric).collect()} == greedy(pairs, *cap, symmetric)
    assert 0 < parts.count("blocks") < (3 if block > 1000 or levels == 3 else 25) + 1
    assert block < 1000 or "room" not in parts


# Imports
def test_import_of_documents(spark):
    words = "Haus Baum Wiese Garten Blume Sonne Regen Wolke".split()
    theme = " ".join(words)
    docs = [(1, "Erstes", f"{theme}. Anna Berg kam. " * 80), (2, "Zweites", None), (3, None, "kurz Doppelt"), (4, "Ähnlich!", f"{theme} {theme}"), (5, "Lang", "wort " * 3000)]
    frame = spark.createDataFrame(docs, "id long, title string, text string")
    nodes = spark.createDataFrame([("a", "Anna Berg", ""), ("d1", "Doppelt", ""), ("d2", "doppelt", ""), ("g", "Garten", f"{theme} {theme}"), ("z", "Anderes", "ganz andere Dinge")], "id string, title string, summary string")
    none = spark.createDataFrame([], "source string, relation string, target string")
    made = documents.Imported(frame, nodes, nodes.select("id"), none, most=3)
    parts = {(r["doc"], r["section"]): r for r in made.sections.collect()}
    assert {k for k in parts if k[0] != 5} == {(1, k) for k in (1, 2, 3)} | {(3, 1), (4, 1)} and all(len(r["text"]) <= 1100 for r in parts.values())
    by = {n: r for n, r in ((r["doc"], r) for r in made.report.collect())}
    assert set(by) == {1, 2, 3, 4, 5} and by[2]["empty"] and not by[2]["candidate_edges"] and by[2]["no_relation"]
    assert by[1]["truncated"] and by[5]["truncated"] and not by[4]["truncated"] and by[1]["candidate_nodes"] == 4 == by[1]["added_nodes"]
    assert by[1]["mentions"] == 6 and by[3]["skipped_edges"] == 2 and by[3]["mentions"] == 0
    edges = {(r["doc"], r["relation"], r["target"]): r for r in made.edges.collect()}
    assert (4, "erwaehnt", "g") in edges and (4, "thematisch_aehnlich", "g") not in edges  # what is mentioned is not inferred besides
    assert {r["label"] for r in edges.values()} <= set(documents.LABELS.values())
    assert len({r["source_id"] for r in by.values()}) == 5 and by[1]["topics"] == 3
    again = documents.Imported(frame, nodes, made.made_nodes.select("id"), made.edges.select("source", "relation", "target"), most=3).report.collect()
    assert all(r["added_nodes"] == 0 == r["added_edges"] and r["updated_nodes"] == by[r["doc"]]["candidate_nodes"] for r in again)
    assert documents.Imported(frame.limit(0), nodes, nodes.select("id"), none).report.count() == 0


def test_similar_is_the_cosine_of_all_terms(spark):
    import math
    from collections import Counter

    r = random.Random(3)
    words = [f"begriff{chr(97 + k)}x" for k in range(26)]
    weights = [1 / (k + 1) for k in range(26)]
    texts = lambda p, n: [(f"{p}{k}", "", " ".join(r.choices(words, weights, k=r.randint(0, 30)))) for k in range(n)]
    a, b = texts("a", 40), texts("b", 40)
    counts = {("s" if x[0][0] == "a" else "t", x[0]): Counter(w for w in x[2].split()) for x in a + b}
    df, n = Counter(w for c in counts.values() for w in c), 80
    weigh = {k: {w: round((1 + math.log(tf)) * (math.log((n + 1) / (df[w] + 1)) + 1), 6) for w, tf in c.items()} for k, c in counts.items()}
    want = {}
    for x, *_ in a:
        for y, *_ in b:
            p, q = weigh["s", x], weigh["t", y]
            shared = p.keys() & q.keys()
            norm = math.sqrt(sum(v * v for v in p.values()) * sum(v * v for v in q.values()))
            cosine = round(sum(p[w] * q[w] for w in shared) / norm, 6) if shared else 0
            if len(shared) >= 3 and cosine >= 0.26 and (x, y) != ("a0", "b0"):
                want[x, y] = (pytest.approx(cosine, abs=2e-6), len(shared))
    schema = "id string, title string, summary string"
    got = documents.similar(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), spark.createDataFrame([("a0", "b0")], "a string, b string"))
    found = {(x["a"], x["b"]): (x["score"], x["shared"]) for x in got.collect()}
    assert len(found) > 100 and found == want


def test_notes(spark):
    texts = [("Notiz A", "Anna Berg kam. Dann ging sie."), ("notiz a", "Älter."), (None, "x"), ("Leer", "  "), ("Lang", "Satz eins. " * 200)]
    nodes = spark.createDataFrame([("a", "Anna Berg", ""), ("u_notiz_a", "Notiz A", "")], "id string, title string, summary string")
    made, edges = documents.notes(spark.createDataFrame(texts, "title string, text string"), nodes)
    got = {r["id"]: r for r in made.collect()}
    assert set(got) == {"u_notiz_a", "u_lang"} and got["u_lang"]["shortened"] and got["u_notiz_a"]["title"] == "Notiz A"
    assert got["u_lang"]["summary"] == " ".join(["Satz eins."] * 6)
    assert [(r["source"], r["target"]) for r in edges.filter("relation = 'erwaehnt'").collect()] == [("u_notiz_a", "a")]


# Quiz
def test_deck_is_simple_seeded_and_whole(spark):
    r = random.Random(2)
    nodes = [(f"n{k}", f"Titel {k}", "xyz"[k % 3]) for k in range(60)] + [("hub", "Nabe", "x"), ("r1", "selten", "rar")]
    edges = [("hub", f"n{k}", "kennt", "kennt") for k in range(60)] + [(f"n{r.randint(0, 59)}", f"n{r.randint(0, 59)}", "zu", "führt zu") for _ in range(80)] + [("r1", "n1", "zu", "führt zu"), ("r1", "ghost", "zu", "führt zu"), ("n5", "n5", "zu", "selbst")]
    n, e = spark.createDataFrame(nodes, "id string, title string, type string"), spark.createDataFrame(edges, "source string, target string, relation string, label string")
    decks = [{x["start"]: x for x in quiz.deck(n.repartition(p), e.repartition(p), 2, 7).collect()} for p in (1, 5)]
    assert decks[0] == decks[1] and decks[0] != {x["start"]: x for x in quiz.deck(n, e, 2, 8).collect()}
    kind, known = {i: t for i, _, t in nodes}, {(a, rel, b) for a, b, rel, _ in edges}
    assert len(decks[0]) > 50
    for start, q in decks[0].items():
        path = [start] + [s["to"] for s in q["steps"]]
        assert len(path) == len(set(path)) == 3 and [s["from"] for s in q["steps"]] == path[:-1] and q["answer"] == path[-1]
        assert all((s["source"], s["relation"], s["target"]) in known and {s["from"], s["to"]} == {s["source"], s["target"]} and s["forward"] == (s["from"] == s["source"]) for s in q["steps"])
        assert len(set(q["options"])) == 4 and q["answer"] in q["options"] and {kind[o] for o in q["options"]} == {kind[q["answer"]]} and not set(q["options"]) & set(path[:-1])
    made = quiz.deck(n, e, 3, 7, spark.createDataFrame([("hub",), ("ghost",), ("r1",)], "node string"))
    rows = quiz.catalogue(made, n, 7).collect()
    assert {x["gold_path"][0] for x in rows} <= {"hub", "r1"} and all(len(x["gold_path"]) == 4 and x["text"].startswith("Starte bei »") and '"goldAnswer"' in x["entry"] for x in rows)
    assert quiz.path_graph(made).count() == 3 * len(rows)
    assert quiz.deck(n, e.limit(0), 2, 7).count() == 0 and quiz.deck(n.filter("type = 'rar'"), e, 2, 7).count() == 0


def test_draws_spread_over_neighbours(spark):
    """A hub's neighbours are drawn about equally often."""
    many = spark.range(2000).select(F.concat(F.lit("s"), "id").alias("start"))
    counts = [x["n"] for x in many.select(F.pmod(quiz.draw(F.lit(1), F.col("start"), F.lit(0)), F.lit(10)).alias("k")).groupBy("k").agg(F.count("*").alias("n")).collect()]
    assert len(counts) == 10 and min(counts) > 140 and max(counts) < 260


# Growth
def grown(edges, focus):
    joined = dict.fromkeys(focus, -1)
    for at, a, b in sorted(edges):
        if a in joined or b in joined:
            joined.setdefault(a, at)
            joined.setdefault(b, at)
    return joined


@pytest.mark.parametrize("kind", ["random", "chain", "backwards"])
def test_growth(spark, kind):
    r = random.Random(5)
    if kind == "random":
        edges = [(k, f"n{r.randint(0, 12_000)}", f"n{r.randint(0, 12_000)}") for k in range(10_000)]
        focus = ["n1", "n2", "n3", "other"]
    else:
        order = range(10_000) if kind == "chain" else reversed(range(10_000))
        edges, focus = [(at, f"n{k}", f"n{k + 1}") for at, k in enumerate(order)], ["n0"]
    e, f = spark.createDataFrame(edges, "ord long, source string, target string").repartition(5), spark.createDataFrame([(x,) for x in [*focus, None]], "node string")
    assert {x["node"]: x["joined"] for x in growth.joins(e, f).collect()} == grown(edges, focus)


def test_growth_graph(spark):
    edges = spark.createDataFrame([(0, "b", "c"), (1, "a", "b"), (2, "b", "d"), (3, "c", "e"), (4, None, "a"), (5, "d", "d")], "ord long, source string, target string")
    nodes = spark.createDataFrame([(x,) for x in "abcdef"], "id string")
    n, e = growth.growth_graph(nodes, edges, spark.createDataFrame([("a",)], "node string"))
    assert {x[0] for x in n.collect()} == {"a", "b", "d"} and {x["ord"] for x in e.collect()} == {1, 2, 5}
    n, e = growth.growth_graph(nodes, edges, spark.createDataFrame([], "node string"))
    assert n.count() == 6 and e.count() == 6


def test_chunks_equal_their_definition():
    def plain(text, size=1100):
        at, out = 0, []
        while at < len(text):
            while at < len(text) and text[at].isspace():
                at += 1
            if at >= len(text):
                break
            end = min(len(text), at + size)
            if end < len(text):
                marks = [text.rfind(m, 0, end + len(m)) for m in (". ", "! ", "? ", "» ", "\n\n", "\n", " ")]
                marks = [m for m in marks if m >= at + int(size * 0.55)]
                end = max(marks) + 1 if marks else end
            out.append((at, text[at:end].rstrip()))
            at = end
        return out

    r = random.Random(9)
    for _ in range(60):
        text = "".join(r.choice(["a" * r.randint(1, 30), " ", ". ", "\n", "\n\n", "  ", "»  "]) for _ in range(r.randint(0, 400)))
        assert [(b, p) for b, _, p in build.chunk(text)] == plain(text)


def test_shuffled_files_go_when_a_table_is_stored(spark):
    """What a stored table shuffled does not stay on disk, and the session's own setting comes back."""
    import os
    import time

    from korrel.plans import scratch

    dirs = [str(x) for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for d in dirs for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}
    had, before = files(), spark.conf.get(scratch.CLEANUP, None)
    made = scratch.stored(spark.range(0, 20_000, 1, 4).groupBy((F.col("id") % 997).alias("k")).agg(F.count("*").alias("n")), "counted")
    for _ in range(50):
        if not files() - had:
            break
        time.sleep(0.2)
    assert not files() - had and made.count() == 997 and spark.conf.get(scratch.CLEANUP, None) == before
    spark.conf.set(scratch.CLEANUP, "false")
    scratch.stored(spark.range(3), "three")
    assert spark.conf.get(scratch.CLEANUP) == "false"
    spark.conf.unset(scratch.CLEANUP)


def test_growth_stores_edges_once(spark, monkeypatch):
    """Blocks are found from the edges themselves, without a second table of their ends."""
    names = []
    monkeypatch.setattr(growth, "stored", lambda df, what, real=growth.stored: names.append(what) or real(df, what))
    edges = spark.createDataFrame([(0, "a", "b"), (5000, "c", "b"), (5001, "a", "c"), (9000, "b", "d")], "ord long, source string, target string")
    found = growth.joins(edges, spark.createDataFrame([("a",)], "node string"))
    assert {x["node"]: x["joined"] for x in found.collect()} == {"a": -1, "b": 0, "c": 5000, "d": 9000}
    assert set(names) == {"edges", "joins", "new"}


def test_import_keeps_texts_once(spark, monkeypatch):
    """The texts of sections are stored as sections, not as chunks besides."""
    names = []
    monkeypatch.setattr(documents, "stored", lambda df, what, real=documents.stored: names.append(what) or real(df, what))
    docs = spark.createDataFrame([(1, "T", "Ein Satz. " * 300)], "id long, title string, text string")
    none = spark.createDataFrame([], "id string, title string, summary string")
    made = documents.Imported(docs, none, none.select("id"), spark.createDataFrame([], "source string, relation string, target string"))
    assert made.made_nodes.count() == 4 and sorted(names) == ["documents", "sections"]


def test_text_hashes_are_stable_hashes(spark):
    from korrel.functions import text as t

    r = random.Random(5)
    texts = ["", "a", "ß𝄞é", "x" * 5000] + ["".join(r.choice("abcäöü 𝄞\n") for _ in range(r.choice([3, 40, 900]))) for _ in range(80)]
    want = [x[0] for x in spark.createDataFrame([(x,) for x in texts], "x string").coalesce(1).select(t.stable_hash("x")).collect()]
    assert documents.text_hashes(texts) == want and documents.text_hashes([]) == []
    real, documents.CODES = documents.CODES, 1000  # several parts
    try:
        assert documents.text_hashes(texts) == want
    finally:
        documents.CODES = real


def test_nodes_of_documents_need_no_edges(spark, small, monkeypatch):
    """document_nodes cuts and hashes texts once, and counts no words."""
    from korrel.queries import knowledge

    names = []
    for module in (documents, build):
        monkeypatch.setattr(module, "stored", lambda df, what, real=module.stored: names.append(what) or real(df, what))
    assert knowledge.document_nodes(spark, small).count() > 200 and sorted(names) == ["documents", "sections"]


def test_names_are_looked_for_once(spark, monkeypatch):
    """Mentions by names of one node and of several come from one look at the texts; the report joins no second one."""
    names = []
    monkeypatch.setattr(build, "stored", lambda df, what, real=build.stored: names.append(what) or real(df, what))
    docs = spark.createDataFrame([(1, "T", "Anna Berg sah den Doppelt."), (2, "U", "nichts")], "id long, title string, text string")
    nodes = spark.createDataFrame([("a", "Anna Berg", ""), ("d1", "Doppelt", ""), ("d2", "doppelt", "")], "id string, title string, summary string")
    made = documents.Imported(docs, nodes, nodes.select("id"), spark.createDataFrame([], "source string, relation string, target string"))
    by = {x["doc"]: x for x in made.report.collect()}
    assert by[1]["mentions"] == 1 and by[1]["skipped_edges"] == 2 and by[2]["no_relation"] and names.count("words") == 1


@pytest.mark.parametrize("heads", [0, 100])
def test_names_of_many_first_words(spark, monkeypatch, heads):
    monkeypatch.setattr(build, "HEADS", heads)
    docs = spark.createDataFrame([("d", "eins zwei drei vier, eins zwei"), ("e", "zwei"), ("f", None)], "id string, text string")
    nodes = spark.createDataFrame([("a", "Eins zwei drei vier"), ("b", "eins zwei"), ("c", "zwei"), ("c2", "Zwei!"), ("g", "vier eins zwei drei")], "id string, title string")
    found = {tuple(x) for x in build.named_nodes(docs, nodes).collect()}
    assert found == {("d", "a", False, 0), ("d", "b", False, 0), ("d", "c", True, 1), ("d", "c2", True, 1), ("e", "c", True, 0), ("e", "c2", True, 0)}


def test_copies_of_a_document_are_as_similar_as_one(spark):
    theme = "Haus Baum Wiese Garten Blume Sonne Regen Wolke"
    nodes = spark.createDataFrame([("g", "Anderes", theme), ("z", "Etwas", "ganz andere Dinge")], "id string, title string, summary string")
    none = spark.createDataFrame([], "source string, relation string, target string")
    scores = []
    for n in (1, 3):
        docs = spark.createDataFrame([(k, "Gleich", f"{theme}.") for k in range(n)], "id long, title string, text string")
        near = documents.Imported(docs, nodes, nodes.select("id"), none).edges.filter("relation = 'thematisch_aehnlich'").select("doc", "target", "score").collect()
        assert sorted(x["doc"] for x in near) == list(range(n))
        scores.append({(x["target"], x["score"]) for x in near})
    assert scores[0] == scores[1] and all(s <= 1 for _, s in scores[0])


# Pairs of profiles
def _profiled(n):
    """Profiles of a few terms each out of a frequent, a middling and many rare ones, and weights of all sizes."""
    r = random.Random(n)
    rows = []
    for i in range(n):
        terms = set(r.sample(["f1", "f2", "f3", "f4"], r.randint(0, 4))) | set(r.sample([f"m{k}" for k in range(12)], r.randint(0, 4))) | set(r.sample([f"r{k}" for k in range(60)], r.randint(0, 3)))
        rows += [(f"d{i:03d}", t, round(r.choice([0.1, 1.0, 5.0]) * (1 + r.random()), 6)) for t in terms]
    return rows


@pytest.mark.parametrize("tile", [3, 1024])
def test_pairs_in_tiles_are_all_pairs(spark, monkeypatch, tile):
    """Every pair is found once, whatever the tiles, and none is shuffled after it was met."""
    monkeypatch.setattr(build, "TILE", tile, raising=False)
    rows = _profiled(70)
    by = {}
    for i, t, w in rows:
        by.setdefault(i, {})[t] = w
    want, close = {}, {}
    for a, x in by.items():
        for b, y in by.items():
            both = x.keys() & y.keys()
            overlap = round(sum(min(x[t], y[t]) for t in both) / min(sum(x.values()), sum(y.values())), 6)
            cosine = round(sum(x[t] * y[t] for t in both) / math.sqrt(sum(w * w for w in x.values()) * sum(w * w for w in y.values())), 6)
            if a < b and len(both) >= 2 and overlap >= build.TOPIC_OVERLAP:
                want[a, b] = (overlap, len(both))
            if a != b and int(a[1:]) % 2 == 0 and len(both) >= 3 and cosine >= build.COSINE:
                close[a, b] = (cosine, len(both))
    df = spark.createDataFrame(rows, "id string, term string, weight double")
    found = build.topic_pairs(df)
    same = lambda rows, score, by: len(rows) == len(by) and all(by[x["a"], x["b"]] == (pytest.approx(x[score], abs=2e-6), x["shared"]) for x in rows)
    assert same(found.collect(), "overlap", want)
    ids = df.select("id").distinct()
    near = build.similarity_pairs(df, ids.filter("int(substring(id, 2)) % 2 = 0"), ids, spark.createDataFrame([("d000", "d001")], "a string, b string"))
    close.pop(("d000", "d001"), None)
    assert same(near.collect(), "cosine", close)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Aggregate" not in plan


def test_walks_carry_numbers(spark, monkeypatch):
    """What decks store on their way has neither the hashes that order it nor the edges that a walk took."""
    nodes = spark.createDataFrame([(f"n{k}", f"T{k}", "t") for k in range(8)], "id string, title string, type string")
    edges = spark.createDataFrame([(f"n{a}", f"n{b}", "r", "l") for a in range(8) for b in range(a)], "source string, target string, relation string, label string")
    held, keep = {}, quiz.stored
    monkeypatch.setattr(quiz, "stored", lambda df, what: keep(df, held.setdefault(what, df.columns) and what))
    made = quiz.deck(nodes, edges, 3, 5).collect()
    assert len(made) == 8 and all([s["from"] for s in r["steps"]][1:] == [s["to"] for s in r["steps"]][:-1] and r["steps"][0]["from"] == r["start"] for r in made)
    assert "mark" not in held["numbered"] and "steps" not in held["walks"]
