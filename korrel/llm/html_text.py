"""Main text of web pages by scoring their tree.

Paragraphs give points for their length and commas to the elements around them; an element's points are discounted by
the share of its text that stands in links. The best element and those of its siblings that score well are the
article; menus, forms, adverts and the like are taken out of it by tag, role, and class. A form, role or class is no
reason to take out what holds the page's article, and none at all where next to nothing would be left.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements whose content is no text, elements that are never part of an article, and elements that begin a block.
RAW = frozenset({"script", "style", "textarea", "title", "xmp", "noembed", "noframes", "iframe"})
LEFT_OUT = RAW | frozenset({"head", "nav", "header", "footer", "aside", "noscript", "template", "button", "select", "svg", "object", "canvas", "dialog", "menu", "input", "label"})
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCKS - frozenset("body caption dd dt html legend li summary tbody td tfoot th thead tr".split())
#: An element of the key ends an open one of the values, up to an element of the bound.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"})}
#: Elements that are no part of an article unless they are wrapped around it.
WRAPPERS = frozenset({"form", "fieldset"})
#: Shares of the page's paragraph points from which an element is not left out: with all the page's articles inside,
#: and where no article is left otherwise. A text of fewer characters and a smaller share of the page is next to nothing.
WITH_ARTICLE, WITHOUT, LITTLE, LITTLE_SHARE = 0.25, 0.5, 250, 0.25
#: Words in a class or id that mark what is no article.
UNLIKELY = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus discussion footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notification overlay pager pagination popup promo promoted promotion related reply replies responses share sharing sidebar signup social sponsor sponsored subscribe teaser toolbar widget".split()
)
#: Words of these that name parts of an article too ("article-header", "share-price"): they count in a name of these and
#: of words for roles and boxes alone, and not at a heading.
AMBIGUOUS = frozenset({"header", "share"})
BESIDE = frozenset("area bar block box button buttons container desktop fixed global icon icons inner links list main mobile page section site sticky tools top wrap wrapper".split())
HEADINGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})
#: Blocks of plain text.
PLAIN = HEADINGS | {"p", "blockquote", "pre"}
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: A comment, a declaration, or a tag; quotes count after "=" alone. A tag without an end takes the rest of the page.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?i)(?<![^\s\"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?")
WORD = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")


class _Element:
    __slots__ = ("articles", "block", "chars", "doubt", "inside", "kept", "linked", "mains", "marked", "out", "parent", "plain", "points", "score", "tag")

    def __init__(self, tag: str, parent: _Element | None, out: bool, doubt: int = 0):
        self.tag, self.parent, self.out, self.doubt = tag, parent, out, doubt
        #: The nearest element from here upward that form, role or class speak against, and the nearest block.
        self.marked: _Element | None = self if doubt else parent.marked if parent else None
        self.block: _Element = self if parent is None or tag in BLOCKS else parent.block
        self.points, self.articles, self.mains = 0.0, 0, 0
        self.score, self.chars, self.linked, self.plain, self.inside, self.kept = 0.0, 0, 0, 0, True, False


class _Open:
    """The elements that are open, and where the ones of each tag are among them."""

    def __init__(self, root: _Element):
        self.stack, self.at, self.links = [root], {}, 0

    def push(self, e: _Element) -> None:
        self.at.setdefault(e.tag, []).append(len(self.stack))
        self.stack.append(e)
        self.links += e.tag == "a"

    def last(self, *tags: str) -> int:
        """The place of the innermost open element of the tags; 0 for none."""
        return max((places[-1] for t in tags if (places := self.at.get(t))), default=0)

    def first(self, tags: frozenset[str] | set[str], beyond: int) -> int:
        """The place of the outermost open element of the tags that lies inside place `beyond`; 0 for none."""
        found = [places[bisect_right(places, beyond)] for t in tags if (places := self.at.get(t)) and places[-1] > beyond]
        return min(found, default=0)

    def close(self, upto: int) -> None:
        for e in self.stack[upto:]:
            self.at[e.tag].pop()
            self.links -= e.tag == "a"
        del self.stack[upto:]


#: What speaks against an element: nothing, its being a form, its role or class; or it is left out in any case.
NOTHING, FORM, NAMED, OUT = 0, 1, 2, 3


def _named(tag: str, value: str) -> bool:
    """Whether a class or id says that an element is no part of an article."""
    for name in value.split():
        words = {w.lower() for w in WORD.findall(name)}
        marks = words & UNLIKELY
        if marks - AMBIGUOUS or marks and tag not in HEADINGS and words <= UNLIKELY | BESIDE:
            return True
    return False


def _against(tag: str, attributes: str) -> int:
    if tag in LEFT_OUT:
        return OUT
    found = FORM if tag in WRAPPERS else NOTHING
    if not attributes or tag in ("html", "body", "article", "main"):
        return found
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return OUT
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return OUT
        if name == "role" and value.lower() in ROLES or name in ("class", "id") and _named(tag, value):
            found = NAMED
    return found


#: Stretches of a block's text: the nearest marked element around each, the stretch, and whether it is a link.
_Parts = list[tuple["_Element | None", str, bool]]


def _blocks(page: str) -> tuple[list[tuple[_Element, _Parts]], list[_Element], list[_Element]]:
    """(block element, stretches of its text) outside what is left out in any case, the articles and mains, all elements.

    Elements come in the order in which they open, so a parent stands before what it holds.
    """
    root = _Element("#root", None, False)
    opened, parts, found, articles, every = _Open(root), [], [], [], [root]

    def flush() -> None:
        if parts:
            found.append((opened.stack[-1].block, parts.copy()))
            parts.clear()

    def say(text: str) -> None:
        if text and not opened.stack[-1].out:
            parts.append((opened.stack[-1].marked, html.unescape(text) if "&" in text else text, opened.links > 0))

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in BLOCKS:
                flush()
            k = opened.last(tag)
            # An inline element ends inside its block only, and a paragraph's or list's end not beyond its table.
            bound = opened.last("table") if tag in BLOCKS and tag in ("p", "div", "li") else 0 if tag in BLOCKS else _place(opened)
            if k and k >= bound:
                opened.close(k)
            continue
        if tag == "br":
            say(" ")
            continue
        if tag in BLOCKS:
            flush()
            if tag in CLOSES_P:
                k = opened.last("p")
                if k and k > opened.last("table", "button", "object"):
                    opened.close(k)
        if tag in ENDS:
            ended, bounds = ENDS[tag]
            beyond = opened.last(*bounds)
            k = opened.first(ended, beyond) if tag == "tr" else opened.last(*ended)
            if k > beyond:
                opened.close(k)
        if tag in VOID:
            continue
        if tag in RAW and not m[3].rstrip().endswith("/"):
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
            continue
        against = _against(tag, m[3])
        above = opened.stack[-1]
        e = _Element(tag, above, above.out or against == OUT, against % OUT)
        every.append(e)
        opened.push(e)
        if tag in ("article", "main") and not e.out:
            articles.append(e)
    flush()
    return found, articles, every


def _place(opened: _Open) -> int:
    """The place of the innermost open block."""
    return opened.at[block.tag][-1] if (block := opened.stack[-1].block).parent is not None else 0


def _joined(parts: _Parts) -> tuple[str, int]:
    """The text of stretches and how many of its characters stand in links."""
    text = " ".join("".join(x for _, x, _ in parts).split())
    return text, min(sum(len(x) for _, x, link in parts if link), len(text))


def _points(text: str) -> float:
    return 1 + text.count(",") + min(len(text) / 100, 3)


def _spare(blocks: list[tuple[_Element, _Parts]], articles: list[_Element], every: list[_Element]) -> None:
    """Takes the doubt from the elements that are wrapped around the page's article."""
    total, mains = 0.0, sum(e.tag == "main" for e in articles)
    marked = [e for e in every if e.doubt]
    for _, parts in blocks:
        groups: dict[int, _Parts] = {}
        for part in parts:
            groups.setdefault(id(part[0]), []).append(part)
        for group in groups.values():
            text, linked = _joined(group)
            points = _points(text) * (1 - linked / len(text)) if linked * 2 < len(text) else 0.0  # lists of links are no paragraphs
            total += points
            if group[0][0] is not None:
                group[0][0].points += points
    for article in articles:
        if article.marked is not None:
            article.marked.articles += 1
            article.marked.mains += article.tag == "main"
    for e in reversed(marked):  # inner ones first
        above = e.parent.marked
        if above is not None:
            above.points, above.articles, above.mains = above.points + e.points, above.articles + e.articles, above.mains + e.mains
    for e in marked:
        if mains and e.mains == mains or articles and e.articles == len(articles) and e.points > total * WITH_ARTICLE:
            e.doubt = NOTHING
    _allow(every, NOTHING)
    if not any(a.inside for a in articles):
        for e in marked:
            if e.points > total * WITHOUT:
                e.doubt = NOTHING


def _allow(every: list[_Element], allowed: int) -> None:
    """Notes at each element whether nothing but what is allowed speaks against it and those around it."""
    for e in every:
        e.inside = (e.parent is None or e.parent.inside) and e.doubt in (NOTHING, allowed)


def main_text(page: str | None) -> str:
    """The article's blocks in page order, two line ends between them; "" where there is none. Linear in the page's length.

    Where that leaves fewer than LITTLE characters, outside any article or main, and less than LITTLE_SHARE of what the page
    has otherwise, elements whose class or role speaks against them are taken in: a page may be named all over like a notice.
    """
    blocks, articles, every = _blocks(page or "")
    if any(part[0] is not None for _, parts in blocks for part in parts):
        _spare(blocks, articles, every)
        text, sure, _ = _best(blocks, every, NOTHING)
        if sure or len(text) >= LITTLE:
            return text
        more, _, plain = _best(blocks, every, NAMED)
        return more if plain * 2 > len(more) and len(text) < LITTLE_SHARE * plain else text
    return _best(blocks, every, NOTHING)[0]


def _best(blocks: list[tuple[_Element, _Parts]], every: list[_Element], allowed: int) -> tuple[str, bool, int]:
    """The text of the best element and its siblings, whether it is an article or main, and its characters outside links.

    What is marked by more than `allowed` is left out; NAMED allows roles and classes, but no forms.
    """
    _allow(every, allowed)
    for e in every:
        e.score, e.chars, e.linked, e.plain = 25.0 if e.tag in ("article", "main") else 0.0, 0, 0, 0
    found, scored = [], {}
    for block, parts in blocks:
        text, linked = _joined([p for p in parts if p[0] is None or p[0].inside])
        if not text:
            continue
        found.append((block, text, linked))
        block.chars += len(text)
        block.linked += linked
        block.plain += len(text) if block.tag in PLAIN else 0
        points = _points(text)
        above = block if block.tag in ("div", "section", "article", "main", "body", "#root") else block.parent
        for share in (1.0, 0.5):
            if above is not None:
                above.score += points * share
                scored[id(above)] = above
                above = above.parent
    if not scored:
        return "", False, 0
    for e in reversed(every):  # inner ones first
        if e.parent is not None:
            e.parent.chars += e.chars
            e.parent.linked += e.linked
            e.parent.plain += e.plain
    worth = {k: e.score * (1 - e.linked / max(e.chars, 1)) for k, e in scored.items()}
    best = max(scored.values(), key=lambda e: worth[id(e)])
    least = max(10.0, worth[id(best)] * 0.2)
    for e in every:
        if e is best:
            e.kept = True
        elif e.parent is not None and e.parent is best.parent:
            paragraph = e.tag in ("p", "h1", "h2", "h3", "blockquote", "pre") and e.linked < 0.25 * max(e.chars, 1)
            # A lead or an end in a box of its own, beside the best one inside the same story.
            part = best.parent.tag not in ("#root", "html", "body") and e.plain * 2 > e.chars and e.linked < 0.25 * e.chars
            e.kept = paragraph or part or worth.get(id(e), 0) >= least
        else:
            e.kept = e.parent is not None and e.parent.kept
    chosen = [(text, linked) for block, text, linked in found if block.kept]
    return "\n\n".join(text for text, _ in chosen), best.tag in ("article", "main"), sum(len(text) - linked for text, linked in chosen)


def extract(pages: DataFrame, page: str = "html", to: str = "text") -> DataFrame:
    """pages with the main text of each in column `to`; null and empty pages give "".

    Character references are decoded, white space inside a block becomes one space, blocks are parted by two line
    ends. One narrow pass; rows and other columns stay. Raises ValueError where the column exists already.
    """
    if to.lower() in {c.lower() for c in pages.columns}:
        raise ValueError(f"column {to} exists already")
    if page not in pages.columns:
        raise ValueError(f"no column {page}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(page)
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                texts = [main_text(x) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, to])

    return pages.mapInArrow(run, T.StructType([*pages.schema.fields, T.StructField(to, T.StringType())]))


def texts(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text and its length in code points."""
    made = extract(pages.select("page_id", "url", "html"))
    return made.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
