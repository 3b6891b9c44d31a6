"""Importance resampling, source divergence and token files against plain Python and the library, with edge cases."""

import glob
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from korrel.llm import divergence, importance, tokenfiles, wordids

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
FEATURE, TERM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"), re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
DOCS = "doc_id long, text string, lang string, source string, id string, rank int, buckets string"
EDGE = [None, "", " ", "\n\n", "a", "Ä ä É́é 1a2 \x00b\x1cc", "x" * 100_000, "wort " * 20_000, "wort " * 20_000, "😀😀 😀", "l'été <|endoftext|> I'm  don't a　b <|EndOfText|>", "ΣΑΣ İx ǅ"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], DOCS)


def texts(seed, n, alphabet="ab cdé AB1'😀\n\t-", longest=60):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, longest))) for _ in range(n)]


def test_words_are_numbered_exactly():
    column = pa.array([*texts(1, 300), *EDGE, None])
    for block in (1, 50, 1 << 20):
        got = [[f.words[int(i)].as_py().decode() for i in f.ids[f.first[k] : f.first[k + 1]]] for f in wordids.numbered(column, importance.INSIDE, block=block) for k in range(f.hi - f.lo)]
        assert got == [FEATURE.findall((t or "").translate(LOWER)) for t in column.to_pylist()]
    assert list(wordids.numbered(column.slice(3, 0), importance.INSIDE)) == []
    with pytest.raises(ValueError):
        wordids.kept((0, 200))


# 11
def resampled(docs, target, share=25, least=20, longest=2, buckets=10_000):
    def features(t):
        w = FEATURE.findall((t or "").translate(LOWER))
        runs = [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]
        return len(w), [zlib.crc32(x.encode()) % buckets for x in runs]

    made = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for *_, f in made for b in f), Counter(b for x in target for b in features(x)[1])
    ns, nt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets)))) for b in range(buckets)]
    out = []
    for i, n, f in made:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = None if i is None else int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, None if h is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((x for x in out if x[0] is not None and x[5] >= least), key=lambda x: (-x[3], x[0]))
    for k, x in enumerate(able[: share * len(able) // 100]):
        x[4] = k + 1
    return sorted((tuple(x[:5]) for x in out), key=repr)


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_importance(spark, longest):
    rows = [(i, t) for i, t in enumerate(texts(2, 300, longest=200) + EDGE)] + [(None, "a b c " * 20), (None, None)]
    target = [*texts(3, 20, longest=100), None]
    docs = frame(spark, [(i, t, None, None) for i, t in rows])
    got = importance.resample(docs, spark.createDataFrame(list(enumerate(target)), "item_id long, text string"), longest=longest, least=3).collect()
    assert sorted((tuple(r) for r in got), key=repr) == resampled(rows, target, least=3, longest=longest)
    assert {r["rank"] for r in got} - {None} == set(range(1, 1 + sum(r["rank"] is not None for r in got)))


def test_importance_of_little(spark):
    docs, none = frame(spark, [(1, "a " * 30, None, None), (1, "a " * 30, None, None), (2, None, None, None)]), spark.createDataFrame([], "item_id long, text string")
    got = sorted(tuple(r) for r in importance.resample(docs, none, share=100).collect())
    assert [r[0] for r in got] == [1, 1, 2] and sorted(r[4] for r in got[:2]) == [1, 2] and got[2][1:3] == (0, 0) and got[2][4] is None
    assert importance.resample(docs.limit(0), none).count() == 0
    with pytest.raises(ValueError):
        importance.features(docs, "doc_id", "text", buckets=1 << 17)


def test_ranks_over_ranges(spark):
    rows = spark.range(5000).selectExpr("id", "cast(id * 7919 % 50 as int) as v").repartition(7)
    got = [(r["v"], r["id"]) for r in importance.ranked(rows, [rows["v"].desc(), rows["id"].asc()]).orderBy("rank").collect()]
    assert got == sorted(((i * 7919 % 50, i) for i in range(5000)), key=lambda x: (-x[0], x[1]))


# 12
def audited(rows, least, ranks):
    count, held, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        group = (lang or "", source or "")
        words = TERM.findall((text or "").translate(LOWER))
        groups.add(group)
        count[group].update(words)
        held[group[0]].update(set(words))
    out = set()
    for lang in {g[0] for g in groups}:
        terms, sources = [t for t, n in held[lang].items() if n >= least], [g[1] for g in groups if g[0] == lang]
        share = lambda n, total: 1 + 1_000_000_000 * (n + 5) // (total + 5 * len(terms))  # noqa: B023, E731
        total = {s: sum(count[lang, s][t] for t in terms) for s in sources}
        p = {s: {t: share(count[lang, s][t], total[s]) for t in terms} for s in sources}
        q = {t: share(sum(count[lang, s][t] for s in sources), sum(total.values())) for t in terms}
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in terms), o.encode()) for o in sources if o != s)
            own = sorted((q[t] - p[s][t], t.encode()) for t in terms if count[lang, s][t] and p[s][t] > q[t])[:ranks]
            out |= {(lang, s, part, item.decode(), -v, k + 1) for part, found in (("pair", pairs), ("term", own)) for k, (v, item) in enumerate(found)}
    return out


@pytest.mark.parametrize(("tile", "block", "heavy"), [(4096, 512, 0.25), (3, 2, 0.25), (8, 5, 2.0), (8, 512, 0.0)])
def test_divergence(spark, tile, block, heavy):
    """The same sums with all terms light, all heavy, and both."""
    r = random.Random(4)
    words = ["der", "Die", "das", "été", "ça", "x", "yy", "ÄÄ", "ää", "z1z", *"abcdefgh"]
    rows = [(" ".join(r.choices(words[: 3 + k % 15], k=r.randint(0, 30))), r.choice(["de", "fr", None]), f"s{k % 9 if k % 3 else 0}") for k in range(400)]
    rows += [(t, "de", None) for t in EDGE] + [("once only", "xx", "a"), (None, "xx", "b"), ("", "yy", "alone")]
    got = divergence.audit(frame(spark, [(k, *x) for k, x in enumerate(rows)]), least=4, ranks=5, tile=tile, block=block, heavy=heavy).collect()
    want = audited(rows, 4, 5)
    assert len(got) == len(want) and {tuple(x) for x in got} == want
    assert {x[4] for x in want if x[0] == "xx"} == {0}


def test_divergence_of_nothing(spark):
    assert divergence.audit(frame(spark, [])).count() == 0


def test_shares_are_exact_for_large_counts(spark):
    df = spark.createDataFrame([(9_000_000_000_000_000, 9_100_000_000_000_000, 1_000_000), (0, 0, 0)], "n long, total long, size long")
    got = [x[0] for x in df.select(divergence._share(df["n"], df["total"], df["size"])).collect()]
    assert got == [1 + 1_000_000_000 * (9_000_000_000_000_000 + 5) // (9_100_000_000_000_000 + 5_000_000), None]


# 13
def encoded(rows):
    from tokenizers import Tokenizer

    t, at, out = Tokenizer.from_file(TOKENIZER), 0, []
    for key, text in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, (x[1] or "").encode())):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    return out


def test_token_files(spark, tmp_path):
    rows = [(k, t) for k, t in enumerate(texts(5, 400) + EDGE)] + [(7, "again"), (7, None), (None, "nameless"), (None, "nameless")]
    random.Random(1).shuffle(rows)
    want = encoded(rows)
    docs = frame(spark, [(k, t, None, None) for k, t in rows]).repartition(5)
    folder = str(tmp_path / "ids")
    tokenfiles.write(docs, folder, TOKENIZER, length=16, size=3000)
    got = sorted((tuple(r) for r in tokenfiles.read(spark, folder).collect()), key=lambda r: r[1])
    assert got == [w[:4] for w in want]
    files = sorted(map(tokenfiles.TokenFile, glob.glob(folder + "/part-*")), key=lambda f: (f.place["part"], f.place["file"]))
    assert len(files) > 3
    flat = []
    for f in files:
        for i in range(len(f)):
            ids, mask = f.ids(i), f.mask(i).to_numpy(zero_copy_only=False)
            assert len(ids) == len(mask) == 16 and not ids.flags.owndata and not ids[~mask].any() and (mask.all() or i == len(f) - 1)
            flat += ids[mask].tolist()
        with pytest.raises(IndexError):
            f.ids(len(f))
    assert flat == [x for w in want for x in w[4]]


def test_token_files_of_nothing(spark, tmp_path):
    assert tokenfiles.token_files(frame(spark, []), TOKENIZER, str(tmp_path / "none")).count() == 0
    got = tokenfiles.token_files(frame(spark, [(1, None, None, None)]), TOKENIZER).collect()
    assert [tuple(r) for r in got] == [(1, 0, 1, zlib.crc32(b"\1\0\0\0"))]


def test_chunks_are_cut_where_no_piece_reaches():
    """Random strings of signs, marks, letters of several scripts and parts of special tokens, against the library."""
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(TOKENIZER), tokenfiles.Encoder(TOKENIZER)
    rows = [*texts(11, 3000, "aZ'tsédÀ×÷»«.,=!_\u0338\u0301\u0327İſK5٣ \n　\x1c\x00ßΣ"), *texts(12, 500, ["<|endoftext|>", "<|", "endoftext", "|>", " ", "'re", "x", "<|ENDOFTEXT|>"], 12)]
    got = [ids[edges[k] : edges[k + 1]].tolist() for lo, hi, ids, edges in e(pa.array(rows)) for k in range(hi - lo)]
    assert e.cut and got == [t.encode(x, add_special_tokens=False).ids for x in rows]


def test_encoders_that_cannot_be_cut(spark, tmp_path):
    """A tokenizer that keeps white space is given whole texts, and its larger ids wider places."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(path), tokenfiles.Encoder(path)
    rows = [x or "" for x in EDGE[:6]] + texts(6, 50)
    assert not e.cut and tokenfiles.Encoder(TOKENIZER).cut
    for lo, hi, ids, edges in e(pa.array(rows), 1):
        assert [ids[edges[k - lo] : edges[k - lo + 1]].tolist() for k in range(lo, hi)] == [[*t.encode(x, add_special_tokens=False).ids, 1] for x in rows[lo:hi]]
