"""Text as column expressions: folding, tokens, stems, sentences, hashes. None of them leaves the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words and suffixes, in their order.
STOP_WORDS = (
    "aber alle allem allen aller alles als also am an ander andere anderem anderen anderer anderes auch auf aus bei bin bis bist da damit dann das dass dein deine dem den denn der des dessen die dies diese diesem diesen dieser dieses doch dort du durch ein eine einem einen einer eines er es etwas für gegen gewesen hab habe haben hat hatte hatten hier hin hinter ich ihr ihre im in indem ins ist ja jede jedem jeden jeder jedes kann kein keine können könnte machen man mehr mein meine mit muss musste nach nicht nichts noch nun nur ob oder ohne sehr sein seine sich sie sind so über um und uns unser unter vom von vor war waren was weiter welche welchem welchen welcher welches wenn werde werden wie wieder will wir wird wirst wo wurde wurden zu zum zur zwar zwischen wer wessen welch nenne"
).split()
SUFFIXES = "ungen heiten keiten ung heit keit isch lich ern en er es em e s n".split()
STEM = f"^(.{{4,}}?)(?:{'|'.join(SUFFIXES)})$"
NOT_ALNUM = "[^a-z0-9]+"
#: Signs that no folding makes a letter of, in lower-case text, and letters that the suffixes end with.
ASCII_SIGNS, LAST = r"[\x00-/:-`{-\x7f]+", tuple(sorted({s[-1] for s in SUFFIXES}))


def _fold_table() -> tuple[str, str]:
    """Lower-case letters that decompose into one base letter and marks, and those base letters."""
    pairs = []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and all(unicodedata.combining(c) for c in base[1:]):
            pairs.append((chr(code), base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


FOLD_FROM, FOLD_TO = _fold_table()


def bound(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def normalize(x: Column) -> Column:
    """Lower case, ß as ss, no accents."""
    return F.regexp_replace(F.translate(F.replace(F.lower(x), F.lit("ß"), F.lit("ss")), FOLD_FROM, FOLD_TO), "[\u0300-\u036f]", "")


def tokenize(x: Column) -> Column:
    """Tokens of two or more letters or digits that are no stop words; null gives null."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.filter(F.split(normalize(x), NOT_ALNUM), lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t))


def stem(t: Column) -> Column:
    """The token without its first listed suffix, where four characters stay."""
    return F.regexp_replace(t, STEM, "$1")


def terms(x: Column) -> Column:
    """Stems of the tokens, duplicates kept."""
    return F.transform(tokenize(x), stem)


def sentences(x: Column) -> Column:
    """Parts that end with . ! ? or » before white space and a capital, digit or »; trimmed, without empty ones."""
    parts = F.split(x, r"(?<=[.!?»])(?U:\s+)(?=[A-ZÄÖÜ»0-9])")
    return F.filter(F.transform(parts, trim), lambda s: s != "")


def trim(x: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def compact(x: Column) -> Column:
    """White-space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def slug(x: Column) -> Column:
    """u_ and the folded text with _ for other characters, 48 characters of it."""
    return F.concat(F.lit("u_"), F.substring(F.regexp_replace(F.regexp_replace(normalize(x), NOT_ALNUM, "_"), "^_+|_+$", ""), 1, 48))


def fnv1a(x: Column) -> Column:
    """FNV-1a, 32 bits, over the code points of the basic plane, as a long."""
    codes = F.transform(F.filter(F.split(x, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c) * 16777619).bitwiseAND(F.lit(4294967295)))


def stable_hash(x: Column) -> Column:
    """fnv1a as eight hex digits."""
    return F.lpad(F.lower(F.hex(fnv1a(x))), 8, "0")


def edge_key(source: Column, relation: Column, target: Column) -> Column:
    """source, relation and target with NUL between."""
    return F.concat_ws("\0", source, relation, target)


def rounded(x: Column, digits: int) -> Column:
    """Half up toward plus infinity."""
    k = float(10**digits)
    return F.floor(x * k + 0.5) / k


def excerpt(text: Column, start: Column, end: Column, width: int = 320, snap: int = 24) -> Column:
    """About `width` characters around [start, end), from and to a blank within `snap`, collapsed, … where something is cut."""
    n = F.length(text)
    first = F.greatest(F.lit(0), F.least(start, n))
    last = F.greatest(first, F.least(end, n))
    room = F.greatest(F.lit(0), F.floor((F.lit(width) - (last - first)) / 2).cast("int"))
    lo, hi = F.greatest(F.lit(0), first - room), F.least(n, last + room)
    # The last blank up to lo, and the first one from hi on, looked for in a stretch of `snap` characters.
    back = F.reverse(F.substring(text, F.greatest(F.lit(1), lo - snap + 2), lo + 1 - F.greatest(F.lit(0), lo - snap + 1)))
    behind = F.instr(back, " ")
    ahead = F.instr(F.substring(text, hi + 1, F.lit(snap)), " ")
    begin = F.when((lo > 0) & (behind > 0), lo - behind + 2).otherwise(lo)
    stop = F.when((hi < n) & (ahead > 0), hi + ahead - 1).otherwise(hi)
    body = compact(F.substring(text, begin + 1, stop - begin))
    return F.concat(F.when(begin > 0, "…").otherwise(""), body, F.when(stop < n, "…").otherwise(""))


def canonical_url(language: Column, title: Column) -> Column:
    """The address of an article: blanks as underscores, the rest percent-encoded."""
    path = F.replace(F.url_encode(F.replace(compact(title), F.lit(" "), F.lit("_"))), F.lit("+"), F.lit("%20"))
    kept = path
    for code, sign in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):  # fixed values: signs that stay
        kept = F.replace(kept, F.lit(code), F.lit(sign))
    return F.concat(F.lit("https://"), language, F.lit(".wikipedia.org/wiki/"), kept)


def page_key(page_id: Column, title: Column) -> Column:
    """What tells pages apart: the id where there is one, else the folded title."""
    return F.when(page_id.isNotNull(), F.concat(F.lit("id:"), page_id.cast("string"))).otherwise(F.concat(F.lit("title:"), compact(normalize(title))))


def language_tag(tag: Column) -> Column:
    """Trimmed, the first underscore as a hyphen, lower case."""
    return F.lower(F.regexp_replace(trim(tag), "^([^_]*)_", "$1-"))


def display_name(name: Column, otherwise: str = "Gast", width: int = 20) -> Column:
    """Collapsed and cut to `width` characters; a fixed name where nothing is left."""
    cut = F.substring(compact(F.coalesce(name, F.lit(""))), 1, width)
    return F.when(cut == "", F.lit(otherwise)).otherwise(cut)


def file_size(size: Column) -> Column:
    """Bytes as text in B, KB or MB, with a decimal comma; halves of the last digit to the even one."""
    digits = lambda x: F.replace(F.format_string("%.1f", F.bround(x, 1)), F.lit("."), F.lit(","))
    mb = digits(size / 1048576.0)
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1048576, F.concat(digits(size / 1024.0), F.lit(" KB"))).otherwise(F.concat(mb, F.lit(" MB")))


def words_packed(x: Column, width: int) -> Column:
    """Words put together greedily into parts of at most `width` characters; a longer word is a part of its own."""
    words = F.filter(F.split(compact(x), " "), lambda w: w != "")

    def step(state: Column, w: Column) -> Column:
        fits = (state["now"] == "") | (F.length(state["now"]) + 1 + F.length(w) <= width)
        now = F.when(state["now"] == "", w).when(fits, F.concat_ws(" ", state["now"], w)).otherwise(w)
        return F.struct(F.when(fits, state["done"]).otherwise(F.concat(state["done"], F.array(state["now"]))).alias("done"), now.alias("now"))

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))
    return F.aggregate(words, start, step, lambda s: F.filter(F.concat(s["done"], F.array(s["now"])), lambda p: p != ""))
