"""Personal data, with column functions alone: generators propose spans, boosted trees choose among them.

The fixed kinds (email, ip, card, phone) always stay. Looser generators add candidates that may overlap them and each
other; each gets features of its format and of the text around it, and a calibrated probability; of candidates that overlap
the likelier stays. The trees are fitted on the driver from EXAMPLES made-up spans (a fixed rule, no rows of the
input) and applied as an expression; calibration and threshold come from formats that the fit has not seen.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korrel.llm.boosting import Boosted, fit, threshold
from korrel.llm.matching import gathered, joined, masked, matches

#: Fixed patterns of the contract. Possessive repeats and the guards before them change no match, only the work on
#: long runs: a leftmost match begins where a run of its first characters does, or where the last match ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
#: High-recall generators: kind, pattern, what a text must hold.
GENERATORS = {
    "email_spelt": (r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}\x20?(?:\(dot\)|\[dot\]|\x20dot\x20|\.)\x20?[A-Za-z]{2,12}\b", r"(?i)[(\[\x20]at[)\]\x20]"),
    "number_phone": (r"(?<![0-9A-Za-z.-])\(?[0-9]{2,4}\)?[\x20./-][0-9]{3,4}[\x20./-][0-9]{3,6}(?![0-9A-Za-z-])", "[0-9]{3}"),
    "number_id": (r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", "[0-9]-[0-9]{2}-[0-9]"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}"),
    "digits": (r"(?<![0-9A-Za-z.])[0-9]{13,19}(?![0-9A-Za-z])", "[0-9]{13}"),
}
#: Words that speak for one group of kinds, and words that speak against all.
CUES = {"mail": r"mail|contact|write|reach|schreib|écri|escrib|corre[ou]", "phone": r"phone|call|tel|mobil|fax|whatsapp|cell|anruf|appel|llam|ruf", "card": r"card|visa|pay|iban|account|bank|konto|carte|tarjeta|compte|cuenta|zahl", "id": r"ssn|social|passport|tax|ausweis|sécurité|seguridad|steuer"}
AGAINST = r"version|order|invoice|isbn|issue|page|part|model|date|year|build|serial|ticket|article|\bat (?:the|a|an)\b"
#: Made-up examples that the trees are fitted on, and the precision that a threshold must reach on the fourth part,
#: whose formats differ from those of the other three.
EXAMPLES, PRECISION = 2400, 0.95
AROUND = 32


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    signs = F.split(F.reverse(digits), "")
    twice = lambda d: F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
    values = F.transform(signs, lambda c, i: F.when(i % 2 == 1, twice(c.try_cast("int"))).otherwise(c.try_cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, b: a + b) % 10 == 0


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def base_matches(text: Column) -> dict[str, Column]:
    """The fixed kinds: array of (start, end, value, part) by kind."""
    small = lambda part: F.length(F.regexp_replace(part, "^0+", "")) <= 3
    part_ok = lambda part: small(part) & (F.regexp_replace(part, "^0+(?=[0-9])", "").try_cast("int") <= 255)
    card = lambda m: F.when(F.length(_digits(m["value"])).between(16, 19), _luhn(_digits(m["value"]))).otherwise(F.lit(False))
    return {
        "email": matches(text, EMAIL, text.contains("@")),
        "ip": F.filter(matches(text, IP, text.rlike(r"[0-9]\.[0-9]++\.[0-9]")), lambda m: F.forall(F.split(m["value"], r"\."), part_ok)),
        "card": F.filter(matches(text, CARD, text.rlike("[0-9](?:[ -]?[0-9]){15}")), card),
        "phone": F.filter(matches(text, PHONE, text.rlike(r"\+[0-9]")), lambda m: F.length(_digits(m["value"])).between(8, 15)),
    }


# The same features twice: as numpy values of examples, and as columns of candidates.
def _features(kind: str, before: str, value: str, after: str) -> list[float]:
    digits = re.sub("[^0-9]", "", value)
    alnum = re.sub("[^A-Za-z0-9]", "", value)
    cues = [float(bool(re.search(p, before, re.I))) for p in CUES.values()]
    return [
        float(list(GENERATORS).index(kind)), float(len(value)), float(len(digits)), len(digits) / len(value), float(len(value) - len(alnum)),
        float(bool(re.search(r"\(|\[", value))), float(len(set(digits))), float(digits[:1] == "0"), *cues,
        float(bool(re.search(AGAINST, before, re.I))), float(bool(re.search(r"[:=#]\s*$", before))), float(bool(re.match(r"\s*[%€$]|\s+(?:euro|dollar|percent|pieces)", after, re.I))),
    ]


def _columns(kind: Column, before: Column, value: Column, after: Column) -> Column:
    yes = lambda c: c.cast("double")
    digits, alnum = _digits(value), F.regexp_replace(value, "[^A-Za-z0-9]", "")
    number = lambda c: F.length(c).cast("double")
    return F.array(
        kind.cast("double"), number(value), number(digits), number(digits) / number(value), number(value) - number(alnum),
        yes(value.rlike(r"\(|\[")), F.size(F.array_distinct(F.filter(F.split(digits, ""), lambda c: c != ""))).cast("double"), yes(digits.startswith("0")),
        *[yes(before.rlike(f"(?i){p}")) for p in CUES.values()],
        yes(before.rlike(f"(?i){AGAINST}")), yes(before.rlike(r"[:=#]\s*$")), yes(after.rlike(r"(?i)^(?:\s*[%€$]|\s+(?:euro|dollar|percent|pieces))")),
    )


def _examples(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n made-up candidates, whether they are personal data, and whether they are held out.

    Each is the kind's usual format and surroundings, or a decoy's. Every fourth is held out and takes its format and
    its cue from lists of its own.
    """
    r = random.Random(59)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    name = lambda: "".join(r.choice("aeiourstnlmk") for _ in range(r.randint(3, 9)))
    end = lambda: r.choice(["com", "org", "net", "de"])
    # Formats by kind: for the fit, and held out.
    true = {
        "email_spelt": ([lambda: f"{name()}.{name()} (at) {name()} (dot) {end()}", lambda: f"{name()} [at] {name()} [dot] {end()}", lambda: f"{name()}{num(2)} at {name()} dot {end()}"], [lambda: f"{name()}(at){name()}.{end()}", lambda: f"{name()}_{name()} [at] {name()}.{end()}"]),
        "number_phone": ([lambda: f"({num(3)}) {num(3)}-{num(4)}", lambda: f"{num(3)}-{num(3)}-{num(4)}", lambda: f"0{num(2)} {num(4)} {num(4)}"], [lambda: f"{num(3)}.{num(3)}.{num(4)}", lambda: f"0{num(3)}/{num(4)}/{num(3)}"]),
        "number_id": ([lambda: f"{num(3)}-{num(2)}-{num(4)}"], [lambda: f"{num(3)}-{num(2)}-{num(4)}"]),
        "iban": ([lambda: f"{r.choice(['DE', 'FR', 'ES'])}{num(2)} " + " ".join(num(4) for _ in range(4)) + f" {num(2)}", lambda: f"GB{num(2)} {''.join(r.choice('ABCDEFGHKLM') for _ in range(4))} {num(4)} {num(4)} {num(4)}"], [lambda: f"{r.choice(['IT', 'AT', 'NL'])}{num(2)}{num(16)}"]),
        "digits": ([lambda: f"{r.choice('456')}{num(15)}"], [lambda: f"3{num(14)}"]),
    }
    false = {
        "email_spelt": ([lambda: f"{name()} at {name()}.{name().title()}", lambda: f"{name()} at {name()} dot {name()}"], [lambda: f"{name()} at {name()}. {name().title()}"]),
        "number_phone": ([lambda: f"{r.randint(1, 31):02}.{num(3)}.{num(3)}", lambda: f"{num(4)} {num(4)} {num(6)}"], [lambda: f"{num(2)}/{num(4)}/{num(5)}"]),
        "number_id": ([lambda: f"000-{num(2)}-0000"], [lambda: f"000-{num(2)}-{num(4)}"]),
        "iban": ([lambda: "".join(r.choice("ABCDEFGHKLM") for _ in range(2)) + num(2) + "".join(r.choice("ABCDEF0123456789") for _ in range(12))], [lambda: "".join(r.choice("PQRSTUVW") for _ in range(2)) + num(2) + "".join(r.choice("GHJKLMNP0123456789") for _ in range(16))]),
        "digits": ([lambda: "0" * 10 + num(4), lambda: num(13), lambda: "1" + num(12)], [lambda: num(14), lambda: "0" * 6 + num(10)]),
    }
    cues = {
        "email_spelt": (["mail me: ", "contact ", "schreib an "], ["write to ", "correo "]), "number_phone": (["call ", "phone: ", "Tel. ", "appelez le "], ["mobile ", "Fax: "]),
        "number_id": (["ssn ", "social security number "], ["tax id: ", "Ausweis "]), "iban": (["IBAN ", "account "], ["bank: ", "Konto "]), "digits": (["card ", "visa: "], ["paid with ", "tarjeta "]),
    }
    decoys = (["version ", "order ", "invoice ", "isbn ", "article "], ["serial ", "ticket #", "build ", "part "])
    x, y, h = [], [], []
    for k in range(n):
        held = k % 4 == 3
        kind, real = r.choice(list(GENERATORS)), r.random() < 0.5
        value = r.choice((true if real or r.random() < 0.4 else false)[kind][held])()
        before = f"{name()} {name()} "
        if r.random() < (0.7 if real else 0.05):
            before += r.choice(cues[kind][held])
        elif not real and r.random() < 0.7:
            before += r.choice(decoys[held])
        after = r.choice([" and", ".", ", ", " " + name()] if real else [" pieces", " euro", " and", ".", " %"])
        x.append(_features(kind, before[-AROUND:], value, after))
        y.append(real)
        h.append(held)
    return np.array(x), np.array(y), np.array(h)


@lru_cache(maxsize=1)
def model() -> tuple[Boosted, float]:
    """The trees and the calibrated threshold; the same at every call."""
    x, y, held = _examples(EXAMPLES)
    trees = fit(x, y, held)
    return trees, threshold(trees, x[held], y[held], PRECISION)


#: A span with its kind's number, and the probability; the same with features in its place.
_SPAN = "array<struct<k:int,start:int,end:int,kind:string,p:double>>"


def _candidates(body: Column, first: int) -> Column:
    """Every generator's spans with their probability; kinds are numbered from `first`."""

    def described(k: int, kind: str):
        def one(m: Column) -> Column:
            at = F.greatest(m["start"] - AROUND, F.lit(0))
            before, after = F.substring(body, at + 1, m["start"] - at), F.substring(body, m["end"] + 1, F.lit(AROUND))
            return F.struct(F.lit(first + k).alias("k"), m["start"].alias("start"), m["end"].alias("end"), F.lit(kind).alias("kind"), m["value"].alias("value"), before.alias("before"), after.alias("after"))

        return one

    found = [F.transform(matches(body, pattern, body.rlike(needs)), described(k, kind)) for k, (kind, (pattern, needs)) in enumerate(GENERATORS.items())]
    # Features are computed once per candidate; the trees then read them.
    featured = F.transform(F.concat(*found), lambda m: F.struct(m["k"].alias("k"), m["start"].alias("start"), m["end"].alias("end"), m["kind"].alias("kind"), _columns(m["k"] - first, m["before"], m["value"], m["after"]).alias("f")))
    trees, _ = model()
    return F.transform(featured, lambda m: F.struct(m["k"].alias("k"), m["start"].alias("start"), m["end"].alias("end"), m["kind"].alias("kind"), trees.column(m["f"]).alias("p")))


def _resolved(spans: Column, fixed: int) -> Column:
    """Spans in order of start: those of the first `fixed` kinds all, of others that overlap the likelier, none over a fixed one."""

    def step(state: Column, x: Column) -> tuple[Column, Column, Column]:
        at, sure = state["at"], x["k"] < fixed
        over = x["start"] < at["end"]
        taken = ~over | sure | (~at["sure"] & (x["p"] > at["p"]))
        beside = over & at["sure"]
        now = F.struct(F.when(beside, F.greatest(at["end"], x["end"])).otherwise(x["end"]).alias("end"), x["p"].alias("p"), (sure | beside).alias("sure"))
        return F.when(taken, now).otherwise(at), F.when(taken, F.array(x)).otherwise(F.array().cast(_SPAN)), over & ~at["sure"] & taken

    ordered = F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["k"].alias("k"), s.alias("s")))), lambda o: o["s"])
    return gathered(ordered, F.struct(F.lit(0).alias("end"), F.lit(0.0).alias("p"), F.lit(False).alias("sure")), step, _SPAN)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with base_spans and pii_spans: arrays of (k, start, end, kind, p), by kind as listed, then start.

    base_spans has the fixed kinds; pii_spans has these and every other candidate whose probability p reaches the
    calibrated threshold (p is 1 for fixed kinds), unless it overlaps a fixed one or, from its start on, a likelier
    candidate. Code points, end exclusive. Null and empty texts have none. One narrow pass of column functions: rows
    and other columns stay as they are. Raises ValueError where docs has columns of the new names.
    """
    if clash := {"base_spans", "pii_spans"} & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    body = F.coalesce(F.col(text), F.lit(""))
    _, cut = model()

    def span(kind: str, k: int, found: Column) -> Column:
        return F.transform(found, lambda m: F.struct(F.lit(k).alias("k"), m["start"].alias("start"), m["end"].alias("end"), F.lit(kind).alias("kind"), F.lit(1.0).alias("p")))

    base = F.array_sort(F.concat(*[span(kind, k, found) for k, (kind, found) in enumerate(base_matches(body).items())]))
    likely = F.filter(_candidates(body, len(KINDS)), lambda m: m["p"] >= cut)
    marked = docs.withColumns({"base_spans": base, "pii_spans": likely})
    every = F.when(F.size("pii_spans") > 0, F.array_sort(_resolved(F.concat("base_spans", "pii_spans"), len(KINDS)))).otherwise(F.col("base_spans"))
    return marked.withColumn("pii_spans", every)


def redacted(text: Column, spans: Column) -> Column:
    """The text with every stretch that spans cover replaced by its first kind in brackets; spans in any order."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return masked(text, ordered, lambda s: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))


def _is(kind: str):
    return lambda s: s["kind"] == kind


def digests(docs: DataFrame) -> DataFrame:
    """Per document: counts of base spans by kind, a digest of them, all spans as text, and their number."""
    found = scan(docs.select("doc_id", "text"))
    counts = [F.size(F.filter("base_spans", _is(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base_spans")), 256).alias("base_sha256"), joined(F.col("pii_spans")).alias("spans"), F.size("pii_spans").cast("long").alias("n_spans"))
