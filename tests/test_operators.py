"""Operators that SQL cannot express, and edge cases, against plain Python."""

import json
import random
import re
import unicodedata

import pandas as pd
import pytest
from pyspark.sql import functions as F

from korrel.functions import chat, validate
from korrel.functions import text as t
from korrel.operators import build, graph, merge, retrieval, schedule, scoring, stats
from korrel.plans.components import components
from korrel.sources import io
from korrel.streaming import live


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def fold(s):
    return re.sub("[̀-ͯ]", "", unicodedata.normalize("NFD", s.lower().replace("ß", "ss")))


def test_text(spark):
    r = random.Random(3)
    words = ["".join(r.choice("abcdeéüßÄñ'-. 1") for _ in range(r.randint(0, 20))) for _ in range(200)] + ["", "Verbindungen", "Fröhlichkeiten"]

    def stem(w):
        for suffix in t.SUFFIXES:
            if len(w) - len(suffix) >= 4 and w.endswith(suffix):
                return w[: -len(suffix)]
        return w

    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", t.normalize(F.col("w")).alias("n"), t.terms(F.col("w")).alias("k"), t.stable_hash(F.col("w")).alias("h")).collect()
    for row in rows:
        assert row["n"] == fold(row["w"])
        assert row["k"] == [stem(x) for x in re.split("[^a-z0-9]+", fold(row["w"])) if len(x) > 1 and x not in t.STOP_WORDS]
        h = 2166136261
        for c in row["w"]:
            h = (h ^ ord(c)) * 16777619 & 0xFFFFFFFF
        assert row["h"] == f"{h:08x}"
    assert one(spark, t.words_packed(F.lit("aa bb cccc d"), 5)) == ["aa bb", "cccc", "d"]
    assert one(spark, t.sentences(F.lit("Eins. Zwei! drei? Vier."))) == ["Eins.", "Zwei! drei?", "Vier."]
    assert one(spark, t.rounded(F.lit(-2.5), 0)) == -2.0


def test_chat(spark):
    assert one(spark, chat.is_follow_up(F.lit("Und wann war das?"))) and not one(spark, chat.is_follow_up(F.lit("Wer war Kant?")))
    assert one(spark, chat.contextualized(F.lit("Warum?"), F.lit("Wer war Kant?"))) == "Wer war Kant?\nAnschlussfrage: Warum?"
    assert one(spark, chat.without_fallback(F.lit("Wer war er, falls du es nicht weißt, nimm den Wissensbaum auf."))) == "Wer war er"
    assert one(spark, chat.command(F.lit("Bitte füge Platon in meinen Wissensbaum hinzu."))) == "Platon"
    assert one(spark, chat.command(F.lit("Wer war Platon?"))) is None
    assert one(spark, chat.route(F.lit("auto"), F.lit(0), F.lit("Wer beeinflusste wen?"))) == "graph"
    assert one(spark, chat.route(F.lit("auto"), F.lit(2), F.lit("x"))) == "hybrid"


def test_scoring(spark):
    s = lambda a, must, some, stay: one(spark, scoring.auto_score(F.lit(a), must, some, F.lit(stay)))
    must, none = F.array(F.lit("Kant")), F.lit(None).cast("array<string>")
    assert s("Es war KANT.", must, none, False) == "korrekt"
    assert s("Das ist nicht bekannt", must, none, False) == "enthaltung"
    assert s("Das ist nicht bekannt", must, none, True) == "korrekt"
    assert s("Hegel", must, none, False) == "falsch"
    assert s("Kant", F.array(F.lit("kant"), F.lit("hegel")), none, False) == "teilweise"
    recall, precision = scoring.evidence(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"), F.lit("c")))
    assert one(spark, recall) == 0.5 and abs(one(spark, precision) - 1 / 3) < 1e-9


def test_mcnemar_and_wilson(spark):
    assert abs(one(spark, stats.mcnemar_exact(F.lit(1), F.lit(5))) - 2 * (1 + 6) / 64) < 1e-9
    assert one(spark, stats.mcnemar_exact(F.lit(0), F.lit(0))) is None
    low, high = stats.wilson(F.lit(0.0), F.lit(0.0))
    assert (one(spark, low), one(spark, high)) == (0.0, 0.0)


def plain_schedule(questions, conditions, repetitions, seed):
    """The schedule in plain Python: a list shuffled from its last place down."""
    w = 0xFFFFFFFF

    def order(items, salt):
        x = seed ^ ((salt + 1) * 0x9E3779B1 & w)
        x = (x ^ x >> 16) * 0x85EBCA6B & w
        x = (x ^ x >> 13) * 0xC2B2AE35 & w
        at, out = x ^ x >> 16, sorted(items)
        for last in range(len(out) - 1, 0, -1):
            at = at + 0x6D2B79F5 & w
            y = (at ^ at >> 15) * (at | 1) & w
            y ^= y + ((y ^ y >> 7) * (y | 61) & w) & w
            k = int((y ^ y >> 14) / 2**32 * (last + 1))
            out[last], out[k] = out[k], out[last]
        return out

    base, rows = order(conditions, 0), []
    for r in range(1, repetitions + 1):
        for i, q in enumerate(order(questions, r)):
            rows += [(len(rows) + 1 + c, r, i + 1, c + 1, q, base[(i + r - 1 + c) % len(base)]) for c in range(len(base))]
    return rows


@pytest.mark.parametrize(("n", "m", "seed"), [(7, 3, 20260616), (1, 1, 0), (12, 5, 4294967295)])
def test_schedule(spark, n, m, seed):
    questions, conditions = [f"q{i:02}" for i in range(n)], [f"c{i}" for i in range(m)]
    frames = [spark.createDataFrame([(x,) for x in v], f"{c} string") for v, c in ((questions, "question"), (conditions, "condition"))]
    assert sorted(tuple(r) for r in schedule.schedule(*frames, 3, seed).collect()) == plain_schedule(questions, conditions, 3, seed)


def test_seeds(spark):
    got = spark.createDataFrame([(x,) for x in (None, float("nan"), float("inf"), -1.5, 4294967297.9, 7.9)], "s double").select(schedule.normalized_seed(F.col("s")).alias("n")).collect()
    assert [r["n"] for r in got] == [0, 0, 0, 4294967295, 1, 7]


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(160)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def plain_traversal(seeds, edges, wanted, titles, stems, depth, beam, most):
    """The search in plain Python, edge by edge."""
    inside, frontier, taken = list(seeds), list(seeds), []
    for level in range(depth):
        if len(inside) >= most:
            break
        before, options = set(inside), []
        for node in frontier:
            for s, t, r, label in edges:
                for other in [t] * (s == node) + [s] * (t == node):
                    score = len(wanted & stems(f"{label} {r} {titles[other]}")) + 2 * (other in before) + 0.5 * (level == 0)
                    options.append((-score, s, r, t, node, other))
        new = []
        for _, s, r, t, _, other in sorted(options):
            if len(inside) >= most:
                break
            if (s, r, t) in [x[:3] for x in taken] or other not in inside and len(new) >= beam:
                continue
            taken.append((s, r, t, level))
            if other not in inside:
                inside.append(other)
                new.append(other)
        frontier = new
    return inside, taken


def test_traversal_is_the_plain_search(spark):
    r = random.Random(8)
    words = ["haus", "baum", "weg", "berg", "tal"]
    ids = [f"n{i:02}" for i in range(60)]
    titles = {i: f"{r.choice(words)} {r.choice(words)}" for i in ids}
    edges = sorted({(r.choice(ids[:8] if r.random() < 0.5 else ids), r.choice(ids), r.choice(["kennt", "lehrt"])) for _ in range(220)})
    edges = [(s, t, rel, rel + " " + r.choice(words)) for s, t, rel in edges if s != t]
    asked = [(k, " ".join(r.sample(words, 2)) + " lehrt") for k in range(12)]
    seeds = [(k, i, p) for k, _ in asked[:-1] for p, i in enumerate(r.sample(ids, r.randint(1, 3)))]
    nodes = spark.createDataFrame([(i, t, "Text " + i) for i, t in titles.items()], "id string, title string, summary string")
    q = spark.createDataFrame(asked, "id long, text string")
    stems = stemmed
    for beam, most in ((1, 3), (4, 14), (2, 8)):
        sub = graph.traverse(spark.createDataFrame(seeds, "question_id long, id string, pos int"), spark.createDataFrame(edges, "source string, target string, relation string, label string"), q, nodes, 3, beam, most)
        got_edges, got_nodes = sub.edges.orderBy("question_id", "step").collect(), sub.nodes.orderBy("question_id", "pos").collect()
        texts = {x["question_id"]: x["context"] for x in graph.linearized(sub, nodes, q).collect()}
        for k, text in asked:
            inside, taken = plain_traversal([i for j, i, _ in seeds if j == k], edges, stems(text), titles, stems, 3, beam, most)
            assert [(x["source"], x["relation"], x["target"], x["level"]) for x in got_edges if x["question_id"] == k] == taken
            assert [x["id"] for x in got_nodes if x["question_id"] == k] == inside
            label = {(s, rel, t): lab for s, t, rel, lab in edges}
            head = "BEZIEHUNGEN (Wissensgraph):\n" + "\n".join(f"• {titles[s]} — {label[s, rel, t]} → {titles[t]}" for s, rel, t, _ in taken) + "\n\n" if taken else ""
            assert texts[k] == head + "ARTIKEL-AUSZÜGE:\n" + "\n\n".join(f"[{titles[i]}] Text {i}" for i in inside)


def stemmed(x):
    """Tokens without the first of the listed suffixes, for words of this test."""
    from korrel.functions.text import STEM, STOP_WORDS

    return {re.sub(STEM, r"\1", w) for w in re.split("[^a-z0-9]+", x.lower()) if len(w) > 1 and w not in STOP_WORDS}


def test_linking(spark):
    """Aliases, names of many words, the longest name first, and each stretch once."""
    nodes = spark.createDataFrame([("a", "Kant", ["Immanuel Kant"]), ("b", "Immanuel", None), ("c", "Die Kritik der reinen Vernunft in zweiter Auflage", None)], "id string, title string, aliases array<string>")
    q = spark.createDataFrame([(1, "Schrieb Immanuel Kant die Kritik der reinen Vernunft in zweiter Auflage?"), (2, "Kants Name"), (3, "Immanuel und Kant")], "id long, text string")
    assert sorted(tuple(r) for r in graph.link_entities(q, graph.aliased(nodes)).collect()) == [(1, "a", 1), (1, "c", 0), (3, "a", 1), (3, "b", 0)]
    best = spark.createDataFrame([(1, "z", 1), (2, "z", 1)], "question_id long, id string, rank int")
    assert sorted(tuple(r) for r in graph.with_fallback(graph.link_entities(q, graph.aliased(nodes)), best).filter("id = 'z'").collect()) == [(2, "z", 0)]


def test_traversal_keeps_a_hubs_edges_to_chosen_nodes(spark):
    far = [f"n{i:04}" for i in range(2100)] + ["z"]
    names = spark.createDataFrame([(c, f"Titel {c}", "x") for c in ["a", "b", *far]], "id string, title string, type string")
    edges = spark.createDataFrame([("a", n, "kennt", "kennt") for n in far] + [("a", "z", "sieht", "sieht"), ("b", "z", "lehrt", "lehrt")], "source string, target string, relation string, label string")
    q = spark.createDataFrame([(1, "Wen lehrt er?")], "id long, text string")
    seeds = spark.createDataFrame([(1, "a", 0), (1, "b", 1)], "question_id long, id string, pos int")
    taken = graph.traverse(seeds, edges, q, names, depth=2, beam=1).edges.orderBy("step").collect()
    assert [(r["source"], r["relation"], r["target"]) for r in taken if r["level"] == 0] == [("b", "lehrt", "z"), ("a", "kennt", "z"), ("a", "sieht", "z")]


def test_merge(spark):
    from korrel.queries.graph import _PROV as p

    none = (None,) * 11
    e = ("s", "i", "pdf", "m", "c", "e", *none)
    paged, terms, blank = ("s", "i", "wiki", "m", "d", "e", 3, *none[1:]), (*e[:15], ["x", "y"], None), ("s", "i", "pdf", "m", "c", "e", *none[:6], "", *none[7:])
    base = spark.createDataFrame([("a", "b", "r", "alt", [e])], f"source string, target string, relation string, label string, provenance {p}")
    more = spark.createDataFrame([("a", "b", "r", "neu", [e, ("t", *e[1:]), paged, terms, blank, (None, *e[1:])]), ("a", "a", "r", "x", [e]), ("b", "c", "r", "y", None)], base.schema)
    got = {(r["source"], r["target"]): (r["label"], [tuple(x)[:7] + (x["sharedTerms"],) for x in r["provenance"]]) for r in merge.merged_edges(base, more).collect()}
    # Entries that differ by page or shared terms alone are different; kind, confidence and blanks make no difference.
    assert got[("a", "b")] == ("alt", [(*e[:6], None, None), ("t", *e[1:6], None, None), ("s", "i", "wiki", "m", "d", "e", 3, None), (*e[:6], None, ["x", "y"])])
    assert got[("b", "c")] == ("y", []) and len(got) == 2
    united = more.filter("target = 'b'").select(merge.merged_provenance(F.concat(F.array(F.col("provenance")[0]), "provenance")).alias("u")).first()["u"]
    assert len(united) == 4
    assert merge.without_scope(base, "i").count() == 0 and merge.without_scope(base, "z").count() == 1
    first = merge.new_edges(base.withColumn("ord", F.lit(0)), more.withColumn("ord", F.lit(1)), "ord").select("source", "target").collect()
    assert sorted(tuple(r) for r in first) == [("a", "a"), ("b", "c")]


def test_snapshots(spark):
    a = spark.createDataFrame([("k", 5, "alt"), ("m", 2, "x")], "key string, updated_at long, value string")
    b = spark.createDataFrame([("k", 5, "neu"), ("m", 3, "y"), ("n", 1, "z")], a.schema)
    assert sorted(tuple(r) for r in merge.newest_snapshot(a, b).select("key", "value").collect()) == [("k", "alt"), ("m", "y"), ("n", "z")]
    assert sorted(tuple(r) for r in io.put_newer(a, b).select("key", "value").collect()) == [("k", "neu"), ("m", "y"), ("n", "z")]


def test_files(spark, tmp_path):
    """Graphs and trials are read with fixed schemas; broken files give no rows; exports hold what was put in."""
    (tmp_path / "graph.json").write_text('{"nodes": [{"id": "a", "title": "A", "provenance": [{"sourceId": "s", "method": "m", "page": 2, "sharedTerms": ["x"]}]}],\n "edges": [{"source": "a", "target": "b"}]}')
    nodes, edges = io.read_graph(spark, str(tmp_path / "graph.json"))
    assert nodes.first()["provenance"][0]["page"] == 2 and edges.count() == 1
    (tmp_path / "half.json").write_text('{"nodes": []}')
    assert [x.count() for x in io.read_graph(spark, str(tmp_path / "half.json"))] == [0, 0]
    (tmp_path / "trials.json").write_text('[{"latencyMs": 40.0, "prepareMs": 15, "latencyScope": "end-to-end", "answer": "a;\\"b\\"\\nc", "retrievedIds": ["x", "y"]}]')
    (tmp_path / "broken.json").write_text("[{")
    raw = io.read_trials(spark, str(tmp_path / "trials.json")).withColumn("ord", F.lit(0).cast("long"))
    assert io.read_trials(spark, str(tmp_path / "broken.json")).count() == 0
    t = io.normalized_trials(raw)
    row = t.first()
    assert (row["id"], row["repetitionId"], row["order"], row["generationMs"]) == ("legacy_0_0", "legacy_unknown_run_r1", 1, 25.0)
    io.write_csv(t, str(tmp_path / "out"))
    lines = [x for f in sorted((tmp_path / "out").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines[0].split(";") == io.EXPORTED and len(lines) == 2 and lines[1].endswith(';x|y;;"a;""b"" c"')
    assert '"schemaVersion":3' in io.json_documents(t.drop("ord")).first()["document"]


def test_answers_and_commands(spark):
    said = ["Kurz und gut.", "Er sagte: „Ja.“ Dann ging er nach Hause und dachte an", "Ein Satz, der endet.) Und noch einer, der nicht en", "kein Ende", "  ", "Das war Hegel (1807).\n\nUnd dann kam noch z. b"]
    rows = spark.createDataFrame(list(enumerate(said)), "i int, x string").select("i", *[c.alias(n) for c, n in zip(chat.completed(F.col("x")), ("text", "cut"))]).orderBy("i").collect()
    # A closing “ is none of the signs that may follow a sentence's end.
    assert [(r["text"], r["cut"]) for r in rows] == [(said[0], False), (chat.UNFINISHED, True), (chat.UNFINISHED, True), (chat.UNFINISHED, True), ("", False), (chat.UNFINISHED, True)]
    longer = spark.createDataFrame([("Das ist der erste ganze Satz (mit Klammer).) Und hier bricht es ab, weil",)], "x string").select(chat.completed(F.col("x"))[0].alias("t")).first()["t"]
    assert longer == "Das ist der erste ganze Satz (mit Klammer).)"
    asks = {"/wissen Kant": "Kant", "Bitte füge „Die Kritik“ in deinen Wissensgraphen hinzu!": "Die Kritik", "Füge ‚Kant?‘ in deinen Wissensbaum hinzu": "Kant", "Speichere »Kant« im Wissensbaum.": "»Kant«", "Nimm x in den Wissensgraph auf": None, "Wer war Kant?": None}
    got = spark.createDataFrame(list(enumerate(asks)), "i int, x string").select("i", chat.command(F.col("x")).alias("c")).orderBy("i").collect()
    assert [r["c"] for r in got] == list(asks.values())


def test_excerpt(spark):
    text = "Anfang " + "wort " * 100 + "ZIEL " + "mehr " * 100
    start = text.index("ZIEL")
    cut = one(spark, t.excerpt(F.lit(text), F.lit(start), F.lit(start + 4)))
    assert cut.startswith("…wort") and cut.endswith("mehr…") and "ZIEL" in cut and 300 <= len(cut) <= 330
    assert one(spark, t.excerpt(F.lit("kurz und gut"), F.lit(0), F.lit(4))) == "kurz und gut"


def test_chunks_cover_the_text(spark):
    r = random.Random(2)
    texts = ["", "   ", "kurz.", "".join(r.choice("ab. \n") for _ in range(5000)), "x" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    rows = build.chunks(df, 200).orderBy("id", "pos").collect()
    for i, text in enumerate(texts):
        own = [c for c in rows if c["id"] == i]
        assert all(c["text"] == text[c["start"] : c["end"]] and 0 < len(c["text"]) <= 201 for c in own)
        assert "".join("".join(c["text"].split()) for c in own) == "".join(text.split())


@pytest.mark.parametrize(("per_a", "per_b", "symmetric"), [(2, 2, True), (2, 4, False), (1, 1, True)])
def test_greedy_caps(spark, per_a, per_b, symmetric):
    """Rounds of best pairs are the greedy choice, with ties, chains and hubs."""
    r = random.Random(per_b)
    pairs = sorted({(r.randint(0, 12), r.randint(0, 40)) for _ in range(150)} | {(i, i + 1) for i in range(50, 70)})
    rows = [(a, b, round(r.choice([0.3, 0.5, r.random()]), 2), r.randint(2, 4)) for a, b in pairs if a < b]
    used, want = {}, set()
    for a, b, score, shared in sorted(rows, key=lambda x: (-x[2], -x[3], x[0], x[1])):
        ka, kb = ("x", a), ("x" if symmetric else "y", b)
        if used.get(ka, 0) < per_a and used.get(kb, 0) < per_b:
            want.add((a, b))
            used[ka], used[kb] = used.get(ka, 0) + 1, used.get(kb, 0) + 1
    df = spark.createDataFrame(rows, "a long, b long, overlap double, shared long")
    assert {(x["a"], x["b"]) for x in build.capped(df, "overlap", per_a, per_b, symmetric).collect()} == want
    assert build.capped(df.limit(0), "overlap", 2, 2, True).count() == 0


def test_exact_ranks(spark):
    r = random.Random(3)
    rows = [("a", round(r.gauss(0, 5), r.randint(0, 3))) for _ in range(3000)] + [("b", 1.0)] * 501 + [("c", float(i)) for i in range(7)] + [("d", None), (None, 1.0)]
    got = {x["key"]: x for x in stats.exact_ranks(spark.createDataFrame(rows, "key string, v double"), "key", "v", {"low": stats.nearest_rank(0.1), "mid": stats.upper_median(), "high": stats.nearest_rank(0.95)}).collect()}
    for key in "abc":
        v = sorted(x for k, x in rows if k == key)
        place = lambda p: v[max(1, -(-len(v) * p // 100)) - 1]  # noqa: E731, B023
        assert (got[key]["low"], got[key]["mid"], got[key]["high"]) == (place(10), v[len(v) // 2], place(95))
    assert set(got) == {"a", "b", "c"}


GAME = [(1, "join", 7), (2, "join", 7), (3, "join", 8), (4, "answer", 7), (5, "ask", 0), (6, "answer", 7), (7, "answer", 7), (8, "answer", 9), (9, "leave", 7), (10, "reveal", 0), (11, "reveal", 0), (12, "ask", 0), (40, "answer", 8), (41, "reveal", 0), (42, "ask", 0), (43, "ask", 0)]


def test_game(spark, tmp_path):
    rows = [(1, i, i * 1000, command, player) for i, command, player in GAME] + [(2, 50 + i, i, "join", i) for i in range(25)]
    df = spark.createDataFrame(rows, "room long, event_id long, at long, command string, player long")
    batch = sorted(tuple(r) for r in live.game(df, 2).collect())
    accepted = [r[1] for r in batch if r[0] == 1 and r[2]]
    assert accepted == [1, 3, 5, 6, 9, 10, 12, 41, 42] and batch[len(GAME) - 1][3:] == ("finished", 1, 1, 0)
    assert sum(r[2] for r in batch if r[0] == 2) == 20
    stream = streamed(spark, tmp_path, df, lambda x: live.game_stream(x, 2), "game")
    assert sorted(tuple(r) for r in stream.collect()) == batch


def streamed(spark, tmp_path, df, operator, name):
    """What a stream makes of a frame that comes in two files, one after the other."""
    folder = str(tmp_path / name)
    for part in (0, 1):
        (df.filter("event_id < 9") if part == 0 else df.filter("event_id >= 9")).coalesce(1).write.mode("append").parquet(folder)
    q = operator(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(folder)).writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_throttle_and_newer_states(spark, tmp_path):
    r = random.Random(6)
    rows = [(i % 3, i, i * 100 + r.randint(0, 50), r.randint(0, 30)) for i in range(60)]
    df = spark.createDataFrame(rows, "room long, event_id long, at long, revision long")
    last, want = {}, []
    for room, event, at, _ in rows:
        if room not in last or at - last[room] >= 600:
            want.append((room, event))
            last[room] = at
    assert sorted(tuple(x) for x in live.throttled(df, 600).collect()) == sorted(want)
    assert sorted(tuple(x) for x in streamed(spark, tmp_path, df, lambda x: live.throttled_stream(x, 600), "flushes").collect()) == sorted(want)
    highest, newer = {}, []
    for room, event, _, revision in rows:
        if revision > highest.get(room, -1):
            newer.append((room, event, revision))
            highest[room] = revision
    assert sorted(tuple(x) for x in streamed(spark, tmp_path, df, live.newer_states, "newer").collect()) == sorted(newer)


def test_outbox(spark):
    """A lobby, a join, a question, a reveal and the next question: the join's snapshot is overtaken."""
    df = spark.createDataFrame([(1, 1, "lobby"), (1, 2, "lobby"), (1, 3, "question"), (1, 4, "reveal"), (1, 5, "question"), (2, 1, "lobby"), (2, 2, "lobby"), (2, 3, "lobby")], "room long, event_id long, phase string")
    assert sorted((r["room"], r["event_id"]) for r in live.coalesced(df).collect()) == [(1, 1), (1, 3), (1, 4), (1, 5), (2, 1), (2, 3)]


def _limits(events, window, room_limit, own_limit):
    rooms, own, out = {}, {}, {}

    def take(held, key, now, limit):
        start, n = held.get(key, (None, 0))
        if start is None or start <= now - window:
            held[key] = (now, 1)
        elif n < limit:
            held[key] = (start, n + 1)
        else:
            return False
        return True

    for room, event, who, now in sorted(events, key=lambda e: (e[3], e[1])):
        out[event] = take(own, (room, who), now, own_limit) and take(rooms, room, now, room_limit)
    return out


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    r = random.Random(5)
    events = [(r.randint(0, 2), i, r.randint(0, 5), float(i * 3 + r.randint(0, 2))) for i in range(400)]
    df = spark.createDataFrame(events, "room long, event_id long, participant long, s double").select("room", "event_id", "participant", F.timestamp_seconds("s").alias("ts"))
    want = _limits(events, 60, 6, 2)
    got = {x["event_id"]: x["allowed"] for x in live.rate_limited_batch(df, 60, 6, 2).collect()}
    assert got == want
    for k in range(4):
        df.filter(F.floor(F.col("event_id") / 100) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = live.rate_limited(stream, 60, 6, 2).writeStream.format("memory").queryName("limits").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {x["event_id"]: x["allowed"] for x in spark.table("limits").collect()} == want


def test_validators(spark):
    assert one(spark, validate.room_code(F.lit("AB12CD"))) and not one(spark, validate.room_code(F.lit("ab12cd"))) and not one(spark, validate.room_code(F.lit(None).cast("string")))
    assert one(spark, validate.may_send(F.lit("host"), F.lit("state"))) and not one(spark, validate.may_send(F.lit("player"), F.lit("state")))


def test_dense_and_empty_inputs(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.0])], "id long, v array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, q array<double>")
    assert [(r["id"], r["score"]) for r in retrieval.dense_topk(v, q, 3).orderBy("rank").collect()] == [(1, 1.0), (2, 0.0), (3, -1.0)]
    docs = spark.createDataFrame([], "id string, title string, summary string")
    asked = spark.createDataFrame([(1, "frage")], "id long, text string")
    assert retrieval.tfidf_topk(retrieval.term_index(docs), asked).count() == 0


@pytest.mark.parametrize("n", [0, 1, 4, 5])
def test_medians(spark, n):
    x = [3.0, 1.0, 2.0, 9.0, 4.0][:n]
    df = spark.createDataFrame([("k", v) for v in x], "key string, v double")
    got = stats.exact_ranks(df, "key", "v", {"u": stats.upper_median(), "m": stats.nearest_rank(0.5)}).collect()
    assert [(r["u"], r["m"]) for r in got] == ([(sorted(x)[n // 2], sorted(x)[max(1, -(-n // 2)) - 1])] if n else [])


def test_file_size_takes_halves_to_the_even_digit(spark):
    assert [one(spark, t.file_size(F.lit(n))) for n in (1280, 1792, 1048576 * 5 // 4, 1300)] == ["1,2 KB", "1,8 KB", "1,2 MB", "1,3 KB"]


def test_a_large_run_is_several_documents(spark, monkeypatch):
    """No document holds more than RESULTS results; together they hold the run once, in order of place."""
    monkeypatch.setattr(io, "RESULTS", 8)
    df = spark.range(100).select(F.lit("r").alias("runId"), (F.col("id") % 7).cast("int").alias("order"), F.col("id").cast("string").alias("id"))
    made = [json.loads(r["document"]) for r in io.json_documents(df).orderBy("part").collect()]
    assert max(len(x["results"]) for x in made) <= 8 and all(x["count"] == len(x["results"]) for x in made)
    held = [(x["order"], x["id"]) for m in made for x in m["results"]]
    assert held == sorted((i % 7, str(i)) for i in range(100))


def test_profiles_are_computed_once(spark, small):
    """What classes and pairs read twice is a stored table, and no ranking of all terms."""
    from korrel.queries import build as queries

    plan = queries._profiles(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Scan parquet" in plan and "Window" not in plan and "Join" not in plan


@pytest.mark.parametrize("wide", [1, 3, 64])
def test_most_hits_of_any_document(spark, monkeypatch, wide):
    """Only documents with more hits than the widest are looked for, and the largest number is found whatever the widest have."""
    monkeypatch.setattr(retrieval, "WIDE", wide)
    monkeypatch.setattr(retrieval, "QUESTIONS", 7)
    near = []
    monkeypatch.setattr(retrieval, "stored", lambda df, what, real=retrieval.stored: near.append(made) or made if (made := real(df, what)) is not None and what == "near" else made)
    r = random.Random(wide)
    words = [f"wort{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(5)]
    docs = [(f"{i:03}", "", " ".join(r.sample(words, r.choice([1, 2, 4, 9])))) for i in range(80)]
    asked = [(f"{i}-0", " ".join(r.sample(words, r.randint(1, 9)))) for i in range(30)] + [("30-0", "nirgendwo"), ("31-0", None)]
    found = retrieval.most_hits(retrieval.term_index(spark.createDataFrame(docs, "id string, title string, summary string")), spark.createDataFrame(asked, "id string, text string"))
    plain = {q: max(len(set(x.split()) & set(text.split())) for _, _, text in docs) for q, x in asked if x and "wort" in x}
    assert {x["question_id"]: x["hits"] for x in found.collect()} == plain
    assert wide < 64 or sum(x.count() for x in near) < 60
    # Where the widest document has all terms of the questions, no other one is counted.
    near.clear()
    docs.append(("all", "", " ".join(words)))
    found = retrieval.most_hits(retrieval.term_index(spark.createDataFrame(docs, "id string, title string, summary string")), spark.createDataFrame(asked, "id string, text string"))
    assert {x["question_id"]: x["hits"] for x in found.collect()} == {q: len(x.split()) for q, x in asked if q in plain} and sum(x.count() for x in near) == 0


@pytest.mark.parametrize("k", [1, 2, 5])
def test_seeds_are_the_best_of_all_documents(spark, monkeypatch, k):
    """Floors, rarer terms and blocks of questions leave out no document, whatever its rank or ties."""
    monkeypatch.setattr(retrieval, "WIDE", 3)
    monkeypatch.setattr(retrieval, "QUESTIONS", 7)
    r = random.Random(k)
    words = [f"wort{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(5)]
    some = lambda n: " ".join(w for w in words if r.random() < n / (2 + words.index(w)))
    docs = [(f"{i:03}", "", some(r.choice([2, 4, 9]))) for i in range(120)]
    asked = [(i, some(6)) for i in range(30)] + [(30, "nirgendwo"), (31, "")]
    index = retrieval.term_index(spark.createDataFrame(docs, "id string, title string, summary string"))
    found = retrieval.lexical_seeds(index, spark.createDataFrame(asked, "id long, text string"), k)
    stems = lambda x: set(spark.createDataFrame(x, "id string, text string").select("id", F.explode(t.terms(F.col("text")))).collect())
    held, wanted = {}, {}
    for i, w in stems([(i, x) for i, _, x in docs]):
        held.setdefault(i, set()).add(w)
    for i, w in stems([(str(i), x) for i, x in asked]):
        wanted.setdefault(int(i), set()).add(w)
    best = []
    for q, w in wanted.items():
        hits = sorted((-len(w & h), i) for i, h in held.items() if w & h)[:k]
        best += [(q, i, -n, p + 1) for p, (n, i) in enumerate(hits)]
    assert sorted(tuple(x) for x in found.select("question_id", "id", "hits", "rank").collect()) == sorted(best)


def test_ranking_does_not_shuffle_all_hits(spark):
    """Products are added up where a document's postings are: what is grouped by question and document is not dealt again."""
    docs = spark.createDataFrame([("a", "x", "eins zwei"), ("b", "y", "zwei drei")], "id string, title string, summary string")
    index = retrieval.term_index(docs)
    posts, tasks = retrieval.dealt(index)
    grouped = posts.join(F.broadcast(spark.createDataFrame([(1, "zwei")], "question_id long, term string")), "term").groupBy("question_id", "id").count()
    plan = grouped._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert sorted(tuple(x) for x in retrieval.tfidf_topk(index, spark.createDataFrame([(1, "zwei vier")], "id long, text string")).select("question_id", "id", "rank").collect()) == [(1, "a", 1), (1, "b", 2)]


def test_mentions_shuffle_no_runs(spark, monkeypatch):
    """Runs of words meet the names where they stand; the last words of a text are found too."""
    plans = {}

    def stored(df, what, real=build.stored):
        plans[what] = df._jdf.queryExecution().executedPlan().toString()
        return real(df, what)

    monkeypatch.setattr(build, "stored", stored)
    docs = spark.createDataFrame([("d1", "und eins zwei drei vier"), ("d2", "vier"), ("d3", "eins zwei drei")], "id string, text string")
    names = spark.createDataFrame([("b1", "eins zwei drei vier"), ("b2", "Vier"), ("b3", "fehlt")], "id string, title string")
    assert sorted(tuple(x) for x in build.mention_edges(docs, names).collect()) == [("d1", "b1", 1), ("d1", "b2", 4), ("d2", "b2", 0)]
    assert "Exchange hashpartitioning(source" not in plans["places"]


def test_token_counts_fold_after_counting(spark):
    """Parts are folded as whole texts are, whatever signs and letters they hold, and a text's words stay in its task."""
    from korrel.functions import text as t
    from korrel.operators import retrieval

    letters = "aAeESsnß äÄéÉ\u0301\u0130\u212a\u03a3çŁł-_.,\u2013\u00a0\n\x00 1９²ﬁ"
    r = random.Random(7)
    rows = [(i, "".join(r.choice(letters) for _ in range(400))) for i in range(30)] + [(30, None), (31, ""), (32, "Die Wirkungen Wirkung WIRKUNGEN; Größe groesse GRÖSSEN.")]
    df = spark.createDataFrame(rows, "id long, text string")
    want = df.select("id", F.explode(t.terms(F.col("text"))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    made = retrieval.postings(df.withColumn("title", F.lit(None).cast("string")), body="text")
    assert {tuple(x) for x in made.select("id", "term", "tf").collect()} == {tuple(x) for x in want.collect()}
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_traversal_moves_only_edges_at_its_nodes(spark, monkeypatch):
    """A level keeps the edges at its own nodes; those elsewhere in the graph are not stored."""
    kept = []

    def stored(df, what, real=graph.stored):
        made = real(df, what)
        if what == "around":
            kept.append({(r["node"], r["other"]) for r in made.collect()})
        return made

    monkeypatch.setattr(graph, "stored", stored)
    names = spark.createDataFrame([(c, f"Titel {c}") for c in "abcyz"], "id string, title string")
    edges = spark.createDataFrame([(s, t, "kennt", "kennt") for s, t in ("ab", "cb", "yz", "zy")], "source string, target string, relation string, label string")
    sub = graph.traverse(spark.createDataFrame([(1, "a", 0)], "question_id long, id string, pos int"), edges, spark.createDataFrame([(1, "Wen kennt a?")], "id long, text string"), names)
    assert [(r["source"], r["target"], r["level"]) for r in sub.edges.orderBy("step").collect()] == [("a", "b", 0), ("c", "b", 1)]
    assert kept == [{("a", "b")}, {("b", "a"), ("b", "c")}, {("c", "b")}]


def test_names_are_folded_once(spark, monkeypatch):
    """Names meet questions from one stored table of keys; of nodes with one key the smallest id counts."""
    kept = {}

    def stored(df, what, real=graph.stored):
        made = real(df, what)
        kept[what] = {tuple(r) for r in made.select("key", "id").collect()}
        return made

    monkeypatch.setattr(graph, "stored", stored)
    names = spark.createDataFrame([("b", "Kant, Immanuel"), ("a", "kant  immanuel"), ("c", "Kant"), ("d", "-"), ("e", None)], "id string, title string")
    q = spark.createDataFrame([(1, "Wer war Kant Immanuel?"), (2, "Und Kant?")], "id long, text string")
    assert sorted(tuple(r) for r in graph.link_entities(q, names).collect()) == [(1, "a", 0), (2, "c", 0)]
    assert kept == {"keys": {("kant immanuel", "a"), ("kant", "c")}}


@pytest.mark.parametrize("few", [0, 1 << 16])
def test_paths_in_portions(spark, monkeypatch, few):
    """Edges are dealt in portions, a hub's in parts, and no path is lost or doubled; repeated edges are one, repeated starts are not."""
    for name, value in (("PORTION", 16), ("PART", 5), ("FEW", few)):
        monkeypatch.setattr(graph, name, value)
    r = random.Random(4)
    pairs = [("h", f"n{i:02}") for i in range(40)] + [(f"n{r.randint(0, 39):02}", f"n{r.randint(0, 39):02}") for _ in range(60)]
    pairs += [(b, a) for a, b in pairs[:9]] + [("h", "h"), ("x", None), ("n00", "x")]
    near = {}
    for a, b in pairs:
        if b is not None:
            near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)
    starts = ["h", "n00", "n00", "fehlt"]
    want = [(s, [s]) for s in starts]
    for _ in range(3):
        want = [(s, [*p, o]) for s, p in want for o in near.get(p[-1], ()) if o not in p]
    edges = spark.createDataFrame([(a, b, rel, rel) for a, b in pairs for rel in ("kennt", "lehrt")], "source string, target string, relation string, label string")
    made = graph.paths(edges, spark.createDataFrame([(s,) for s in starts], "node string"), 3)
    assert sorted(tuple(x) for x in made.collect()) == sorted((s, ">".join(p)) for s, p in want)
    assert made.rdd.getNumPartitions() >= 28  # 448 rows of edges from both ends, or more paths than that
