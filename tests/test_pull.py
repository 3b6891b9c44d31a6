"""Pulls of pages, continued link lists and text of positioned runs, on hand-made rows and against plain Python."""

import random
import re

from korrel.operators import pages_text, pull

LONG = " Dieser Text ist lang genug, um als Auszug einer Seite zu gelten, und nennt Jena, Weimar und Kant."


def rows(spark, schema, *values):
    return spark.createDataFrame(list(values), schema)


def graph(spark, roots, relations=pull.RELATIONS):
    pages = rows(
        spark, "page_id long, title string, extract string, disambiguation boolean",
        (1, "Hegel", "Georg Hegel." + LONG, False), (2, "Kant", "Immanuel Kant." + LONG, None), (3, "Jena", "Stadt Jena." + LONG, False), (4, "Weimar", "kurz", False), (5, "Phänomen", "Begriff." + LONG, True),
        (6, "Alt", "Doppelt." + LONG, False), (7, "alt", "Doppelt." + LONG, False), (None, "Nichts", LONG, False), (8, "Werk  der Vernunft", "Buch." + LONG, False),
    )
    links = rows(
        spark, "page_id long, pos int, label string",
        (1, 0, "Jena"), (1, 1, "Kant"), (1, 2, "kant "), (1, 3, "Weimar"), (1, 4, "Liste der Orte"), (1, 5, "1781"), (1, 6, "Hegel"), (2, 0, "Hegel"), (2, 1, "jena"), (2, 2, "Berlin"), (3, 0, "Kant"), (3, 1, "Saale"), (8, 0, "Alt"), (8, 1, ""), (8, 2, None),
    )
    redirects = rows(spark, "name string, page_id long", ("Weimar", 3), ("KdV", 8), ("Alt", 8))
    nodes = rows(
        spark, "id string, title string, custom boolean, page_id long",
        ("k", "Kant", False, None), ("j", "Jenaer", True, 3), ("b1", "Berlin", False, None), ("b2", "berlin", False, None), ("s", "Saale", False, None), ("p", "Privat", True, None), ("w", "Weimar", False, None),
    )
    return pull.Pull(pages, redirects, links, nodes, rows(spark, "pull long, ord int, page_id long", *roots), relations)


def test_pull_of_one_root(spark):
    p = graph(spark, [(10, 1, 1)])
    # Of the links that the extract names, longest first: Weimar's page is too short, so Hegel, Jena and Kant follow.
    members = [(r["page_id"], r["requested"], r["id"]) for r in p.members.orderBy("place").collect()]
    assert members == [(1, "Hegel", "wiki_1")]  # the two best neighbours are Weimar (too short) and Hegel itself
    assert {(r["source"], r["target"]) for r in p.edges.collect()} == {("wiki_1", "k"), ("wiki_1", "w")}
    report = p.report.first()
    assert (report["pages"], report["new_nodes"], report["relations"], report["failed_pages"], report["truncated"]) == (1, 1, 2, 1, False)


def test_pulls_resolve_rank_and_count(spark):
    p = graph(spark, [(1, 1, 2), (1, 2, 3), (1, 3, 5), (1, 4, 8), (2, 1, 8), (3, 1, 4), (3, 2, 77), (4, 1, None)], relations=2)
    members = {(r["pull"], r["page_id"]): (r["place"], r["id"]) for r in p.members.collect()}
    assert members[1, 2][1] == "k" and members[1, 3][1] == "j" and (1, 5) not in members and (1, 8) not in members  # only three roots count
    assert members[2, 8][1] == "wiki_8" and (2, 6) not in members and (2, 7) not in members  # two pages are called so
    edges = {(r["pull"], r["rank"]): (r["source"], r["target"]) for r in p.edges.collect()}
    assert edges[1, 1] == ("k", "j") and len([k for k in edges if k[0] == 1]) == 2
    report = {r["pull"]: r for r in p.report.collect()}
    assert report[1]["omitted_relations"] == 1 and report[1]["truncated"] and report[1]["relations"] == 2
    assert report[3]["pages"] == 0 and report[3]["scope"] is None and report[3]["failed_pages"] == 2
    every = graph(spark, [(1, 1, 2), (1, 2, 3), (1, 3, 5), (1, 4, 8)])
    assert every.report.first()["relations"] == report[1]["relations"] + report[1]["omitted_relations"] and every.report.first()["scope"] == report[1]["scope"]
    assert graph(spark, [(1, 1, 2)]).report.count() == 1


def test_links_go_on_by_token(spark):
    answers = rows(
        spark, "title string, token string, labels array<string>, next string",
        ("a", None, ["1", "2"], "t1"), ("a", "t1", ["3"], "t2"), ("a", "t2", ["4", "5"], None), ("b", None, [], "x"), ("b", "x", ["6"], "x"), ("c", "lost", ["7"], None), ("d", None, ["8"], "gone"),
    )
    got = sorted((r["title"], r["pos"], r["label"]) for r in pull.continued(answers).collect())
    assert got == [("a", k, str(k + 1)) for k in range(5)] + [("b", 0, "6"), ("d", 0, "8")]
    assert pull.continued(answers, 2).filter("title = 'a'").count() == 2


def plain(items):
    text = ""
    for value, eol in items:
        value = value or ""
        if value:
            if text and not re.match(r"[\s-]", text[-1]) and not re.match(r"[,.;:!?»)%\]}]", value[0]):
                text += " "
            text += value
        if eol and not text.endswith("\n"):
            text += "\n"
    for pattern, to in ((r"([A-Za-zäöüßÄ])-\n(?=[a-zäöüß])", r"\1"), (r"[ \t]+\n", "\n"), (r"\n[ \t]+", "\n"), (r"[ \t]{2,}", " "), (r"\n{3,}", "\n\n")):
        text = re.sub(pattern, to, text)
    return text.strip()


def test_runs_become_pages(spark):
    r = random.Random(8)
    pages = {(d, p): [(r.choice(["Wort", "ver-", "ein", "", " ", "\t", "ä", ".", "»", ") x", "-", "a\n", "\n", None, "Satz  mit"]), r.choice([True, False, False, None])) for _ in range(r.randint(0, 40))] for d in range(6) for p in range(1, 6)}
    runs = [(d, p, k, s, e) for (d, p), items in pages.items() for k, (s, e) in enumerate(items)]
    r.shuffle(runs)
    df = spark.createDataFrame(runs, "doc int, page int, run int, str string, eol boolean")
    got = {(x["doc"], x["page"]): x["text"] for x in pages_text.page_texts(df).collect()}
    assert got == {k: plain(v) for k, v in pages.items() if plain(v)}
    assert pages_text.page_texts(df.limit(0)).count() == 0


def test_pages_fit_a_document(spark):
    texts = rows(spark, "doc int, page int, text string", (1, 1, "a" * 50), (1, 3, "b" * 60), (1, 4, "c"), (2, 1, "kurz"), (2, 81, "zu weit"), (3, 2, "x" * 100))
    totals = rows(spark, "doc int, n int", (1, 4), (2, 90), (3, 2))
    kept = pages_text.document_pages(texts, totals, characters=100)
    got = {(r["doc"], r["page"]): (len(r["text"]), r["start"], r["end"], r["cut"]) for r in kept.collect()}
    assert got == {(1, 1): (50, 0, 50, False), (1, 3): (50, 52, 102, True), (2, 1): (4, 0, 4, False), (3, 2): (100, 0, 100, False)}
    whole = {r["doc"]: (r["text"], r["truncated"]) for r in pages_text.documents(kept, texts, totals).collect()}
    assert whole[1] == ("a" * 50 + "\n\n" + "b" * 50, True) and whole[2][1] and whole[3] == ("x" * 100, False)
