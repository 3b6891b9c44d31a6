"""The ten operators against brute force, the public libraries, and edge cases."""

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from korrel.llm import boosting, decontamination, html_text, neardup, pii, secrets, sentencepieces, substrings, token_counts, topk, toxicity
from korrel.llm.fmindex import FMIndex, Wavelet

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BPE = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, None, "s", None) for i, t in zip(ids or range(len(texts)), texts)], DOCS)


def strange(seed, n, alphabet="ab \n\r\t▁é😀x;{}1 "):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(n)]


EDGE = [None, "", " ", "\n\n", "a", "x" * 200_000, "wort " * 30_000, "wort " * 30_000, "\x00 \x1c", "<|endoftext|> <s> <0x0A>"]


# 1
def test_pieces_equal_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = strange(1, 400) + EDGE
    for r in sentencepieces.encode(frame(spark, texts), PIECES).collect():
        text = texts[r["doc_id"]] or ""
        assert r["piece_ids"] == sp.encode(text) and r["piece_decoded"] == sp.decode(r["piece_ids"])
        spans = list(zip(r["piece_begins"], r["piece_ends"]))
        assert all(a <= b for a, b in spans) and (not spans or (spans[0][0], spans[-1][1]) == (0, len(text.encode()))) and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))
    with pytest.raises(ValueError):
        sentencepieces.encode(frame(spark, ["a"]).withColumn("piece_ids", F.lit(1)), PIECES)
    assert sentencepieces.digests(frame(spark, []), PIECES).count() == 0


def test_pieces_decode_any_ids():
    import sentencepiece

    sp, c, r = sentencepiece.SentencePieceProcessor(model_file=PIECES), sentencepieces.codec(PIECES), random.Random(4)
    for _ in range(300):
        ids = [r.randint(3, 31999) if r.random() < 0.6 else r.randint(3, 258) for _ in range(r.randint(0, 12))]
        assert c.decode(ids) == sp.decode(ids)


def _compiled(rules):
    """A character map of one- and two-byte keys in the compiled form, for the test."""
    units, words, replaced = [0] * 1024, b"", {}
    for k, v in rules.items():
        replaced[k] = len(words)
        words += v + b"\0"
    base = {b"": 256}
    units[0] = 256 << 10
    free = 512
    for k in sorted(rules):
        for n in range(1, len(k) + 1):
            at, byte = base[k[: n - 1]], k[n - 1]
            place = at ^ byte
            if k[:n] not in base:
                base[k[:n]] = free
                units[place] = byte | ((place ^ free) << 10)
                free += 128
            if n == len(k):
                units[place] |= 1 << 8
                units[base[k]] = replaced[k] | 1 << 31
    import struct

    blob = struct.pack(f"<{len(units)}I", *units)
    return struct.pack("<I", len(blob)) + blob + words


def test_character_map_takes_the_longest_prefix_and_keeps_places():
    n = sentencepieces.Normalizer(_compiled({b"a": b"1", b"ab": b"xyz"}), False, False)
    data, align = n("cabad")
    assert data == b"cxyz1d" and align.tolist() == [0, 1, 1, 1, 3, 4, 5]
    squeezed = sentencepieces.Normalizer(b"", True, True)
    assert squeezed("  a  b ")[0].decode() == "▁a▁b"


# 2
def removed(texts):
    first, out = {}, {}
    words = {i: WORD.findall(t or "") for i, t in texts}
    for i in sorted(words):
        for k in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][k : k + 50]), i)
    for i, w in words.items():
        stay = [True] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                stay[k : k + 50] = [False] * 50
        out[i] = (len(w), stay.count(False), " ".join(x for x, s in zip(w, stay) if s))
    return out


@pytest.mark.parametrize("in_shard", [1, 1000])
def test_repeats(spark, monkeypatch, in_shard):
    r = random.Random(6)
    passage = [r.choice("abcdefgh") + str(r.randint(0, 50)) for _ in range(120)]
    texts = []
    for i in range(60):
        own = [r.choice("xyz") + str(r.randint(0, 500)) for _ in range(r.randint(0, 90))]
        a = r.randint(0, 60)
        texts.append(" ".join(own[:30] + (passage[a : a + r.randint(45, 120)] if i % 2 else []) + own[30:]))
    texts += [texts[1], "tick " * 300, "tick " * 200, *EDGE]
    monkeypatch.setattr(substrings.repeated_spans, "__defaults__", (50, 8, in_shard))
    want = removed(list(enumerate(texts)))
    got = {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept"]) for x in substrings.without_repeats(frame(spark, texts)).collect()}
    assert got == want and sum(n for _, n, _ in want.values()) > 1000


def test_repeats_keys(spark):
    text = " ".join(str(i) for i in range(60))
    rows = substrings.without_repeats(frame(spark, [text, text, text, text], [3, 3, None, 5])).collect()
    assert sorted((x["doc_id"] or 0, x["n_removed"]) for x in rows) == [(0, 0), (3, 0), (3, 0), (5, 60)]
    assert substrings.without_repeats(frame(spark, [])).count() == 0


def test_wavelet_and_index():
    r = np.random.default_rng(0)
    s = r.integers(0, 11, 500)
    w = Wavelet(s, 11)
    c, i = r.integers(0, 11, 300), r.integers(0, 501, 300)
    assert w.rank(c, i).tolist() == [int((s[:b] == a).sum()) for a, b in zip(c, i)]
    seqs = [r.integers(0, 3, n).astype(np.int64) for n in (6, 9, 5, 12, 5)]
    owners = np.array([4, 2, 9, 7, 1])
    for own, found in zip(seqs, (x := FMIndex(seqs, owners, 5)).smallest_owners(x.codes)):
        assert found.tolist() == [min(o for o, t in zip(owners, seqs) for k in range(len(t) - 4) if (t[k : k + 5] == own[j : j + 5]).all()) for j in range(len(own) - 4)]


# 3
def test_toxicity(spark, small):
    match = toxicity.Lexicon(dict.fromkeys(toxicity.START, 4.0), {"réeux": 3.0}).matcher()
    hits = lambda t: match(t)[1]
    assert hits("You IDIOT!") == 1 and hits("1d10t") == 1 and hits("іdіot") == 1 and hits("idiotic") == 0
    assert hits("the trash can and trash") == 1 and hits("réeuxment") == 1 and hits("stupid$$$ a$$$") == 1 and hits("") == 0
    docs = frame(spark, ["a b stupid idiot scum", None, "", "fine words here", EDGE[6]])
    scored = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))).collect()}
    assert scored[0] > 0.3 > max(scored[i] for i in (1, 2, 3, 4)) and all(0 <= s <= 1 for s in scored.values())


def test_toxicity_against_plain_search():
    """Every entry looked for by itself at every place, in texts of look-alikes, digits, unseen signs and exceptions."""
    words, beginnings = dict.fromkeys(toxicity.START, 4.0) | {"ab": 1.0}, {"réeux": 3.0, "idio": 2.0}
    match, r = toxicity.Lexicon(words, beginnings).matcher(), random.Random(31)
    assert [match(t)[1] for t in ("you loser5", "idi0t5", "ＩＤＩＯＴ", "id\u200biot", "id\u00adiot", "idiotx5", "loser 5")] == [1, 1, 1, 1, 1, 1, 1]
    assert match("moronic")[1] == 0 and match("scum5x")[1] == 0

    def plain(text):
        body, hits = toxicity.fold(text), {}
        spared = set()
        for phrase in toxicity.EXCEPTIONS:
            for a in range(len(body)):
                b = a + len(phrase)
                if body.startswith(phrase, a) and not (a and body[a - 1].isalnum()) and re.match(r"[0-9@$!]*(?![^\W_])", body[b:]):
                    spared |= set(range(a, b))
        for held, whole in ((words, True), (beginnings, False)):
            for term, weight in held.items():
                for a in range(len(body)):
                    if body.startswith(term, a) and not (a and body[a - 1].isalnum()) and (not whole or re.match(r"[0-9@$!]*(?![^\W_])", body[a + len(term) :])):
                        hits[a] = max(hits.get(a, 0.0), weight)
        hits = {a: w for a, w in hits.items() if a not in spared}
        return sum(hits.values()), len(hits), max(1, len(body.split()))

    parts = ["idiot", "1d10t", "idi0t5", "trash can", "trash", "clown fish", "fish", "scum", "pond ", " ", " ", "-", "_", "5", "$$", "réeux", "ment", "і", "Ｉ", "\u200b", "ab", "loser"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 9)))
        assert match(text) == plain(text), text


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.predictions(spark.read.parquet(f"{d}/documents.parquet"), labels).filter("held_out").join(labels, "doc_id").select("predicted", "toxic").toPandas()
    hit = got[got.predicted == 1]
    assert hit.toxic.mean() > 0.9 and len(hit[hit.toxic == 1]) / got.toxic.sum() > 0.8


def test_toxicity_repeats(spark):
    """Equal texts under several ids and labels give one lexicon, whatever the order of the rows; odd rows have a score."""
    r = random.Random(4)
    docs = [(i, " ".join(r.choice(["gut", "haus", "baum", "weg"]) for _ in range(30)) + (" grobzunge" if i % 3 == 0 else f" wort{i % 7}")) for i in range(400)]
    docs += [(i + 1000, t) for i, t in docs[:200]]
    labels = [(i, int(i % 3 == 0 or i == 1004)) for i, _ in docs]
    made = []
    for order in (docs, docs[::-1]):
        d = spark.createDataFrame(order, "doc_id long, text string").repartition(3)
        made.append(toxicity.fit(d, spark.createDataFrame(labels, "doc_id long, toxic int")))
    assert made[0] == made[1] and "grobzunge" in made[0].words
    odd = spark.createDataFrame([(None, "grobzunge"), (5, None), (5, ""), (5, "idiot trash can " * 20_000)], "doc_id long, text string")
    assert toxicity.score(odd, made[0]).count() == 4 and toxicity.score(odd.limit(0), made[0]).count() == 0
    with pytest.raises(ValueError):
        toxicity.score(odd.withColumn("Score", F.lit(1)), made[0])


# 4
SECRETS = ["token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\"", "password: short secret:hunter2hunter2hunter2", "token:secret:longvalue123456789", "PassWord='ab.cd_ef=gh-ij' é AKIAABCDEFGHIJ1234 AKIA123", "0123456789abcdef0123 deadbeef", "api_key=abcdefghijkl apikey:zzzzzzzzzzzz", "key eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9 end", "123e4567-e89b-12d3-a456-426614174000", "f" * 60]


def secret_spans(x):
    x = x or ""
    o = [(m.start(), 0, m.end(), "assign") for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", x, re.ASCII) if len(m[2]) >= 12]
    o += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m[0]) >= 18]
    o += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", x) if len(m[0]) >= 16]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(o))


def test_secrets(spark):
    texts = SECRETS + EDGE + strange(8, 300, "token=: \"'abcdef0123456789AKI")
    rows = {r["doc_id"]: r for r in secrets.digests(frame(spark, texts)).collect()}
    for i, x in enumerate(texts):
        assert rows[i]["base_sha256"] == hashlib.sha256(secret_spans(x).encode()).hexdigest(), x
    assert "entropy_mixed" in rows[6]["spans"] and rows[7]["spans"] == "" and "entropy" not in rows[8]["spans"]
    masked = secrets.scan(frame(spark, SECRETS)).select("doc_id", secrets.redacted(F.col("text"), F.col("secret_spans")).alias("t")).collect()
    assert {r["doc_id"]: r["t"] for r in masked}[0] == '[SECRET]"'
    with pytest.raises(ValueError):
        secrets.scan(frame(spark, ["a"]).withColumn("secret_spans", F.lit(1)))


def test_secrets_long_runs(spark):
    """Runs that once overflowed Java's stack or took quadratic time, and strings of low entropy beside others."""
    runs = ["ab-" * 60_000 + "1x", "ab/" * 60_000 + "1", "a1" * 100_000, "A" * 10**6, "token=" * 20_000, "AKIA" * 50_000, "f3 " * 30_000, "ab-" * 9 + "1x " + "ab-" * 12 + "1y"]
    rows = {r["doc_id"]: r["spans"] for r in secrets.digests(frame(spark, runs)).collect()}
    assert [rows[i] for i in (0, 1, 3, 7)] == [""] * 4 and rows[2] == "hex:0:200000" and rows[5] == "access:0:200000"


def test_secrets_rows(spark):
    """Repeated rows, null ids and an empty table."""
    docs = spark.createDataFrame([(1, "AKIA" + "B" * 20), (1, "AKIA" + "B" * 20), (None, None)], "doc_id long, text string")
    assert sorted(r["spans"] for r in secrets.digests(docs).collect()) == ["", "access:0:24", "access:0:24"]
    assert secrets.digests(docs.limit(0)).count() == 0


def test_entropy_is_exact(spark):
    r = random.Random(9)
    values = ["".join(r.choice("0123456789abcdef") for _ in range(r.randint(20, 60))) for _ in range(40)]

    def best(v, bits):
        hot = [i for i in range(len(v) - 19) if -sum(c / 20 * np.log2(c / 20) for c in Counter(v[i : i + 20]).values()) >= bits - 1e-9]
        return (hot[0], hot[-1] + 20) if hot else (-1, -1)

    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", secrets._hot(F.col("v"), 3.33, 20).alias("h")).collect()
    assert all((x["h"]["lo"], x["h"]["hi"]) == best(x["v"], 3.33) for x in rows)


# 5
def test_html(spark):
    page = "<html><head><title>x</title></head><body><div class='top-menu'><a href=1>Home</a></div><div><div class=content><h1>T &amp; U</h1><p>One,<br>two <b>th</b>ree, four and more words to count.<p>Next, paragraph with text.</div><aside>Side</aside></div><div id='comments'><p>Nice, really nice, good post, thanks.</p></div><footer>foot</footer><script>var a='<p>no</p>'</script></body></html>"
    assert html_text.main_text(page) == "T & U\n\nOne, two three, four and more words to count.\n\nNext, paragraph with text."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p></p>") == ""
    assert html_text.main_text("just text") == "just text"
    assert html_text.main_text("<p>" * 3000 + "deep, text") == "deep, text"
    pages = spark.createDataFrame([(1, "u", page), (2, None, None), (2, None, "")], "page_id long, url string, html string")
    assert sorted(r["n_chars"] for r in html_text.texts(pages).collect()) == [0, 0, len(html_text.main_text(page))]


def test_html_known_pages():
    """Pages put together from known paragraphs and known clutter, in several layouts; the paragraphs must come back."""
    r = random.Random(31)
    say = lambda n: " ".join(r.choice(["river", "stone,", "light", "walks", "under", "the", "old", "bridge,", "and"]) for _ in range(n)).capitalize() + "."
    clutter = [
        "<nav><ul><li><a href=/>Home</a><li><a href=/a>All</a></ul></nav>", "<div class='cookie-notice'>We use cookies. <button>OK</button></div>", "<div id=sidebar><h3>Related</h3><a href=/x>More of this</a></div>",
        "<form><input name=q><label>Search</label></form>", "<script>if (a < b) { c('<p>no</p>') }</script>", "<div class='ad banner'>Buy now, cheap, fast!</div>", "<!-- <p>hidden</p> -->", "<p style='display: none'>Secret</p>",
    ]
    for layout in ("<article>{}</article>", "<main><div>{}</div></main>", "<div class=content>{}</div>", "<div id=page><div class=post>{}</div></div>", "<table><tr><td>{}</td></tr></table>"):
        for _ in range(6):
            paragraphs = [say(r.randint(25, 60)) for _ in range(r.randint(3, 6))]
            inner = "".join(f"<p>{x.replace(' the ', ' <em>the</em> ', 1)}</p>\n" + (r.choice(clutter[4:8]) if r.random() < 0.4 else "") for x in paragraphs)
            r.shuffle(clutter)
            page = f"<html><head><title>T</title></head><body><header>Site</header>{clutter[0]}{clutter[1]}{layout.format(inner)}<div class=comments><p>First! Nice, really, nice.</p></div>{clutter[2]}<footer>Imprint, 2020</footer></body></html>"
            assert html_text.main_text(page) == "\n\n".join(paragraphs), page


def test_html_time():
    """Deep, unclosed and hostile pages take time in proportion to their length."""
    for make in (lambda n: "<div>a " * n, lambda n: '<a "x ' * n, lambda n: '<a ="x ' * n, lambda n: "<a " * n + '=">"', lambda n: "<p><table><td>" + "<b>" * n + "</p>" * n, lambda n: "<div class=ad>x " * n, lambda n: "<table><tr><td>x" * n):
        began = time.perf_counter()
        html_text.main_text(make(30_000))
        assert time.perf_counter() - began < 10


def test_html_rows(spark):
    """Null and empty pages, repeated rows, an empty table, a clash, and an extra column."""
    page = "<article><p>" + "Ein Satz, noch einer. " * 20 + "</p></article>"
    rows = spark.createDataFrame([(1, "u", page), (1, "u", page), (None, None, None), (2, "v", "")], "page_id long, url string, html string")
    got = sorted(((x["page_id"] or 0), x["n_chars"]) for x in html_text.texts(rows.withColumn("text", F.lit("x")).withColumn("c0", F.lit(1))).collect())
    assert got == [(0, 0), (1, 439), (1, 439), (2, 0)] and html_text.texts(rows.limit(0)).count() == 0
    with pytest.raises(ValueError):
        html_text.extract(rows.withColumn("TEXT", F.lit(1)))


def test_html_wrappers():
    p = "A paragraph, with commas, and words enough to count as one of an article. " * 3
    menu = "<div class='nav'>" + "<a href=1>Some long link text, of a menu</a> " * 30 + "</div>"
    text = f"{p.strip()}\n\n{p.strip()}"
    inner = f"<div class=body><p>{p}</p><p>{p}</p></div>"
    teasers = "<div class='related'><article><p>Another story, elsewhere</p></article></div>"
    for wrapper in ("div class='layout has-sidebar'", "div id='page-with-comments'", "form", "section class='banner ad' role=form"):
        tag = wrapper.split()[0]
        for body in (inner, f"<article>{inner}</article>", f"<main>{inner}</main>"):
            assert html_text.main_text(f"<body>{menu}<{wrapper}>{body}<div class='sidebar'><p>Side, text</p></div></{tag}></body>") == text
            assert html_text.main_text(f"<body>{menu}{body}<{wrapper}><p>Side, text</p></{tag}></body>") == text
        assert html_text.main_text(f"<body><{wrapper}>{inner}</{tag}>{teasers}</body>") == text
        assert html_text.main_text(f"<body><{wrapper}><p>Short.</p></{tag}>{menu}</body>") == "Short."
    assert html_text.main_text(f"<body><div class=share><p>{p}</p></div><div class=social><p>{p}</p></div><p>x</p><div class=related><p>{p}</p></div></body>").count("A paragraph") == 9
    assert html_text.main_text(f"<body><article>{inner}</article><div id=comments>{inner * 5}</div></body>") == text
    assert html_text.main_text(f"<body><p>{p}<span class=ad>Buy, now</span></p><p>{p}</p></body>") == text
    assert html_text.main_text("<body><div class=comments hidden><p>gone</p></div></body>") == ""


def test_html_pages(spark, small):
    import html

    for r in spark.read.parquet(f"{small}/pages.parquet").collect():
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", re.sub("</?b>", "", inner).replace("<br>", " "))
        want = "\n\n".join(z for z in (" ".join(html.unescape(re.sub("<[^>]*>", "", q)).split()) for q in parts) if z)
        assert html_text.main_text(r["html"]) == want


def test_html_names_inside_an_article():
    """Names that only hold a word of a role, leads and ends in boxes of their own, and comments by another name."""
    body = "<p>" + "Ein Satz, noch einer. " * 20 + "</p>"
    starts = lambda page: [x[:12] for x in html_text.main_text(page).split("\n\n")]
    assert starts(f"<article><h1 class='page-header'>Titel</h1>{body}</article>") == ["Titel", "Ein Satz, no"]
    page = f"<article><div class='article-header'><h1>Titel</h1></div>{body}<div class='share-price'><p>Kurs stieg.</p></div><div class='share-buttons'>Teilen</div><section id='responses'><p>Toll, danke, gern.</p></section></article>"
    assert starts(page) == ["Titel", "Ein Satz, no", "Kurs stieg."]
    page = f"<div class=page-header><p>Kopf</p></div><div id=story><div class=lead><p>Lead in.</p></div><div class=text>{body}{body}</div><div><p>Ende.</p></div><div class=cookie><p>Wir nutzen Cookies.</p></div><div><a href=x>Mehr</a></div></div>"
    assert starts(page) == ["Lead in.", "Ein Satz, no", "Ein Satz, no", "Ende."]


# 6
def test_token_counts(spark, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    texts = [t for t in EDGE] + strange(7, 300, ["a", "b", " ", "\n", "\xa0", "é", "'s", "1", "<|endoftext|>", "\x1c", "!"])
    want = {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    cache = str(tmp_path / "cache")
    docs = frame(spark, texts)
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.count(docs, BPE, cache).collect()} == want
    stored = token_counts.read_cache(spark, cache, token_counts.version(BPE))
    assert stored.count() == len({t or "" for t in texts})
    again = frame(spark, [*texts, "neu", "neu"], [*range(len(texts)), None, 1])
    assert token_counts.count(again, BPE, cache).count() == len(texts) + 2
    assert stored.sparkSession.read.parquet(f"{cache}/{token_counts.version(BPE)}").count() == len({t or "" for t in texts}) + 1
    assert token_counts.count(frame(spark, []), BPE, str(tmp_path / "none")).count() == 0


# 7
def test_topk(spark):
    r = np.random.default_rng(1)
    vectors = [(int(i), [float(x) for x in v]) for i, v in zip(range(300), r.normal(size=(300, 8)).astype(np.float32))]
    vectors += [(400, vectors[0][1]), (401, None), (402, [float("nan")] * 8), (403, [None] * 8), (None, vectors[1][1]), (404, [])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    whole = {i: np.floor(256 * np.array(v, np.float64)).astype(np.int64) for i, v in vectors if i is not None and v and None not in v and np.isfinite(v).all()}
    want = set()
    for q in whole:
        if q % 50 == 0:
            best = sorted((-int(whole[q] @ whole[x]), x) for x in whole if x != q)[:5]
            want |= {(q, k + 1, x, -s) for k, (s, x) in enumerate(best)}
    assert {tuple(x) for x in topk.top_k(df).collect()} == want
    assert topk.top_k(df.filter("vec_id is null")).count() == 0


def test_topk_widths(spark):
    """Vectors meet those of their own width, in whatever order the rows come."""
    rows = [(50, [0.5, 0.25]), (1, [0.5, 0.5]), (2, [1.0, 0.0, 0.0]), (100, [1.0, 1.0, 0.0]), (150, [2.0])]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "vec_id long, embedding array<float>").coalesce(1)
        assert {tuple(x) for x in topk.top_k(df).collect()} == {(50, 1, 1, 128 * 128 + 64 * 128), (100, 1, 2, 256 * 256)}


def test_topk_large(spark):
    """Bounds hold for large components too."""
    r = np.random.default_rng(5)
    v = (r.normal(size=(600, 6)) * 4000).astype(np.float64)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    whole = np.floor(256 * v).astype(np.int64)
    want = {(q, k + 1, x, int(whole[q] @ whole[x])) for q in range(0, 600, 50) for k, x in enumerate(sorted((x for x in range(600) if x != q), key=lambda x: (-int(whole[q] @ whole[x]), x))[:5])}
    assert {tuple(x) for x in topk.top_k(df).collect()} == want


def test_topk_is_exact(spark):
    """Scores above 2**53, and one at the end of the 64-bit integers, are whole."""
    r = np.random.default_rng(6)
    v = r.normal(size=(120, 64)) * 1e6
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    whole = [[int(c) for c in x] for x in np.floor(256 * v)]
    score = lambda a, b: sum(x * y for x, y in zip(whole[a], whole[b]))
    want = {(q, k + 1, x, score(q, x)) for q in range(0, 120, 50) for k, x in enumerate(sorted((x for x in range(120) if x != q), key=lambda x: (-score(q, x), x))[:5])}
    assert {tuple(x) for x in topk.top_k(df).collect()} == want
    x, q = np.array([[1 << 31, 1 << 31, -1], [1 << 31, -(1 << 31), 5]], np.int64), np.array([1 << 31, 1 << 31, 1], np.int64)
    assert topk._products(x, q).tolist() == [(1 << 63) - 1, 5]
    with pytest.raises(OverflowError):
        topk._products(x, q + 1)


# 8
def component_of(texts):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in texts:
        w = WORD.findall((t or "").translate(lower))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in sets:
        for j in sets:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_duplicates(spark):
    r = random.Random(11)
    texts = []
    for _ in range(6):
        base = [r.choice("abcdefghij") + str(r.randint(0, 99)) for _ in range(r.randint(60, 160))]
        for _ in range(25):
            own = list(base)
            for _ in range(r.randint(0, 6)):
                own[r.randrange(len(own))] = "neu" + str(r.randint(0, 9999))
            texts.append(" ".join(own))
    texts += [*EDGE, "a b c", "A B C", "a b", *texts[:3]]
    want = component_of(list(enumerate(texts)))
    rows = neardup.near_duplicates(frame(spark, texts)).collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in rows} == want
    assert all(x["kept"] == (x["doc_id"] == x["component_id"]) for x in rows)


def test_near_duplicate_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    test_near_duplicates(spark)


def test_near_duplicate_keys(spark):
    a, b = "eins zwei drei vier fünf sechs", "ganz andere worte stehen hier nun"
    rows = neardup.near_duplicates(frame(spark, [a, b, a, a, b], [7, 7, None, 9, 2])).collect()
    assert sorted((x["doc_id"] or 0, x["component_id"] or 0, x["kept"]) for x in rows) == [(0, 0, True), (2, 2, True), (7, 2, False), (7, 2, False), (9, 2, False)]
    assert neardup.near_duplicates(frame(spark, [])).count() == 0


# 9
def distance(p, t):
    prev = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        now = [i]
        for j, b in enumerate(t, 1):
            now.append(min(prev[j] + 1, now[-1] + 1, prev[j - 1] + (a != b)))
        prev = now
    return min(prev)


def test_myers_distance():
    r = random.Random(12)
    for _ in range(200):
        p, t = ("".join(r.choice("abc") for _ in range(r.randint(lo, 90))) for lo in (1, 0))
        assert decontamination.Myers(p).within(t, len(p)) == min(distance(p, t), len(p) + 1)


def test_decontamination(spark):
    r = random.Random(13)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8)))
    items = [(k, " ".join(word() for _ in range(r.randint(8, 40)))) for k in range(20)] + [(99, "short"), (98, None), (None, "x" * 50)]
    texts = []
    for k in range(80):
        body = list(items[k % 20][1])
        for _ in range(r.randint(0, 14)):
            at = r.randrange(len(body))
            body[at : at + r.randint(0, 1)] = r.choice(["", "z", "q"])
        texts.append(" ".join(word() for _ in range(20)) + " " + "".join(body).upper() + "\n" + " ".join(word() for _ in range(20)))
    texts += EDGE
    rows = decontamination.contaminated(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    clean = {k: decontamination.normal(t) for k, t in items if k is not None and t and len(t) >= 40}
    for x in rows[:90]:
        text = decontamination.normal(texts[x["doc_id"]])
        if len(text) > 2000:
            continue
        want = {(k, d) for k, i in clean.items() if (d := distance(i, text)) <= decontamination.budget(i, decontamination.ERRORS, decontamination.PIECE)}
        assert {tuple(y) for y in x["leaks"]} == want
    cut = [items[0][1][2:] + " " + "ab " * 30, "ab " * 30 + items[0][1][:-2]]  # a text that begins or ends within an item
    assert [x["leaks"] for x in decontamination.contaminated(frame(spark, cut), spark.createDataFrame(items[:1], "item_id long, text string")).orderBy("doc_id").collect()] == [[(0, 2)], [(0, 2)]]
    none = decontamination.contaminated(frame(spark, ["a"]), spark.createDataFrame([], "item_id long, text string")).first()
    assert none["leaks"] == []


def test_decontamination_short_items(spark):
    items = [(1, "What is  2+2?"), (2, "Rom"), (3, "首都はどこ"), (4, " "), (5, "C++"), (6, "a" * 39), (7, "Rom")]
    texts = ["so: what\nis 2+2? four", "Romane und Aromen", "in ROM.", "日本の首都はどこですか", "c++", "x" + "a" * 39, "a" * 39 + "-", "whats is 2+2?", "what is 2+2", "", None, "Rom"]
    rows = decontamination.contaminated(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")).orderBy("doc_id").collect()
    assert [[k for k, _ in x["leaks"]] for x in rows] == [[1], [], [2, 7], [3], [5], [6], [6], [], [], [], [], [2, 7]]  # an item of 39 letters may have edits, so its word may go on
    assert all(e == 0 for x in rows for _, e in x["leaks"])


def test_decontamination_budgets_follow_length(spark):
    """No length switches edits off: an item has as many as its share and its pieces allow."""
    item = "was ist die hauptstadt von island bitte"
    assert len(item) == 39 and decontamination.budget(item, decontamination.ERRORS, decontamination.PIECE) == 2
    texts = [item, item.replace("haupt", "haubt"), item.replace("haupt", "haubt").replace("island", "izland"), item.replace("a", "u"), "kurz ja"]
    rows = decontamination.contaminated(frame(spark, texts), spark.createDataFrame([(1, item), (2, "kurz nein"), (3, "kurz")], "item_id long, text string")).orderBy("doc_id").collect()
    assert [[tuple(y) for y in x["leaks"]] for x in rows] == [[(1, 0)], [(1, 1)], [(1, 2)], [], [(3, 0)]]


def test_decontamination_in_blocks(spark, monkeypatch):
    """Five blocks of items find what one does, with null and repeated ids, repeated rows and extra columns."""
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8)))
    items = [(k % 35, " ".join(word() for _ in range(12))) for k in range(40)]
    texts = [" ".join(word() for _ in range(9)) + " " + items[k][1] + " " + items[-k][1].replace("a", "z", 1) for k in range(40)] + [None, "", "x", "x"]
    docs = frame(spark, texts, [None, 5, 5, *range(3, len(texts))]).withColumn("row", F.lit(1)).withColumn("found", F.lit("f")).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    shown = lambda: sorted((str(x) for x in decontamination.contaminated(docs, bench).collect()))
    one = shown()
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", sum(len(t) for _, t in items) // 5 + 1)
    assert shown() == one and len(one) == len(texts) and sum("item_id" in x for x in one) >= 40
    with pytest.raises(ValueError):
        decontamination.contaminated(docs.withColumn("LEAKS", F.lit(1)), bench)


# 10
PERSONAL = ["write to a.b+c@mail.example.com, or x@y.z_q@r.s", "10.0.0.1 and 256.1.1.1 and 1.2.3.4.5.6.7.8", "4111 1111 1111 1111 or 4111111111111112", "+49 (30) 123-4567 and +1", "mail me: jane.doe (at) firma (dot) de", "call (212) 555-0199 now", "é 1.2.3.004 é"]


def personal_spans(x):
    x = x or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda s: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0
    o = [(0, m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    o += [(1, m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m[0].split("."))]
    o += [(2, m.start(), m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    o += [(3, m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 8 <= len(digits(m[0])) <= 15]
    return ",".join(f"{k}:{a}:{b}" for _, a, b, k in sorted(o))


def test_personal_data(spark):
    texts = PERSONAL + EDGE + ["1" * 100_000, "a." * 50_000 + "@b.c", "a@" + "b." * 20_000 + "c"] + strange(14, 400, "ab.@_1 2-+()\n") + strange(15, 300, "0123456789.- +()@x")
    rows = {r["doc_id"]: r for r in pii.digests(frame(spark, texts)).collect()}
    for i, x in enumerate(texts):
        assert rows[i]["base_sha256"] == hashlib.sha256(personal_spans(x).encode()).hexdigest(), x[:80]
    assert "email_spelt" in rows[4]["spans"] and "number_phone" in rows[5]["spans"]


def test_personal_data_rows(spark):
    """Repeated rows, an empty table, clashing names, and many matches in one text."""
    docs = spark.createDataFrame([(1, "x a@b.co"), (1, "x a@b.co"), (None, None)], "doc_id long, text string")
    assert sorted(r["spans"] for r in pii.digests(docs).collect()) == ["", "email:2:8", "email:2:8"]
    assert pii.digests(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pii.scan(docs.withColumn("PII_spans", F.lit(1)))
    many = pii.digests(frame(spark, ["1.2.3.4 " * 20_000])).first()
    assert many["n_ip"] == many["n_spans"] == 20_000


def test_personal_data_overlaps(spark):
    """Fixed spans stay and push out what overlaps them; of candidates the likelier stays; all are masked."""
    span = lambda k, a, b, p: (k, a, b, f"k{k}", p)
    cases = [
        ([span(0, 5, 9, 1.0), span(4, 0, 6, 0.9), span(5, 8, 12, 0.99), span(5, 20, 22, 0.9)], [(5, 9), (20, 22)]),
        ([span(4, 0, 10, 0.91), span(5, 5, 12, 0.99), span(6, 11, 15, 0.95)], [(5, 12)]),
        ([span(0, 0, 10, 1.0), span(1, 5, 7, 1.0), span(4, 8, 12, 0.9)], [(0, 10), (5, 7)]),
    ]
    for spans, kept in cases:
        got = spark.createDataFrame([(spans,)], f"s {pii._SPAN}").select(pii._resolved(F.col("s"), 4).alias("s")).first()["s"]
        assert sorted((x["start"], x["end"]) for x in got) == kept
    text = "mail bo@example.org, call (212) 555-0142 today"
    found = pii.scan(frame(spark, [text])).select(pii.redacted(F.col("text"), F.col("pii_spans")).alias("t")).first()["t"]
    assert found == "mail [EMAIL], call [NUMBER_PHONE] today"


#: Written by hand, apart from the made-up examples: personal data, and what only looks like it.
THEIRS = [
    "you may write to jane.doe [at] posteo [dot] net any time", "contact: k.meier (at) firma (dot) de", "Telefon: 030 4567 8912, abends", "please call (415) 555-0134 tomorrow", "my cell: 415-555-0134 thanks",
    "her social security number 078-05-1120 was leaked", "SSN: 219-09-9999", "IBAN DE89 3704 0044 0532 0130 00 bitte", "account GB29 NWBK 6016 1331 9268 19 at the bank", "paid with card 4929123456789012 yesterday",
]
NOTHING = [
    "we met at noon.Then we left", "order 4500 1234 567890 shipped", "invoice 12.345.678 pieces", "version 000-12-0000 of the part", "serial 1234567890123 of the build", "build 00000000001234 passed", "article 12/3456/78901 euro",
    "he looked at stone dot maps", "part AB12CDEF01234567 fits", "page 3120 4450 120000 of the issue",
]


def test_personal_data_recall(spark):
    rows = {r["doc_id"]: r["n_spans"] for r in pii.digests(frame(spark, THEIRS + NOTHING)).collect()}
    caught, spared = sum(rows[i] > 0 for i in range(len(THEIRS))), sum(rows[len(THEIRS) + i] == 0 for i in range(len(NOTHING)))
    assert caught >= 8 and spared >= 9, (caught, spared)


def test_trees_as_columns_equal_numpy(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(400, 3))
    y = x[:, 0] + x[:, 1] ** 2 > 0.5
    model = boosting.fit(x, y, np.arange(len(x)) % 4 == 3)
    rows = spark.createDataFrame([tuple(map(float, v)) for v in x], "a double, b double, c double").select(model.column(F.array("a", "b", "c")).alias("p")).collect()
    assert np.allclose([q["p"] for q in rows], model.probability(x)) and ((model.probability(x) > 0.5) == y).mean() > 0.9
