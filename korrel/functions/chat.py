"""Chat turns as column expressions: follow-ups, fallbacks, routing, commands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from korrel.functions.text import FOLD_FROM, FOLD_TO, compact, trim

_B, _E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
# Cues of follow-up questions, of a request to look things up, and of relational questions.
FOLLOW_UP = (
    rf"(?i)^(?:und|aber|warum|wieso|wie genau|wann|wo|welche davon|wer davon|was bedeutet das|was geschah dann){_E}",
    rf"(?i){_B}(?:dessen|deren|dieses werk|dieser philosoph|diese person|der genannte|die genannte|dort|davon|dabei|damit|ihm|ihn){_E}",
    rf"(?i)^(?:was|wer|warum|wieso|wie|wann|wo|welche){_E}[^?!.]*{_B}(?:er|sie){_E}",
)
FALLBACK = r"(?iu)[,.;]?(?U:\s*falls\s+du\s+(?:es\s+)?nicht\s+)wei(?:ß|sst|ßt)[^.!?]*(?:wissensbaum|wissensgraph(?:en)?)[^.!?]*[.!?]?$"


def is_follow_up(question: Column) -> Column:
    """Whether a question leans on the one before."""
    q = trim(question)
    return q.rlike(FOLLOW_UP[0]) | q.rlike(FOLLOW_UP[1]) | q.rlike(FOLLOW_UP[2])


def wants_fallback(question: Column) -> Column:
    """Whether it ends with the request to look the answer up in the graph."""
    return trim(question).rlike(FALLBACK)


def without_fallback(question: Column) -> Column:
    """The question without that request and the punctuation before it."""
    cut = F.regexp_replace(question, FALLBACK, "")
    return F.when(cut == question, trim(question)).otherwise(trim(F.regexp_replace(cut, r"(?U)[\s,;:.!?]+$", "")))


def contextualized(question: Column, previous: Column) -> Column:
    """A follow-up with the previous question before it, without the fallback request."""
    clean = without_fallback(question)
    return F.when(is_follow_up(clean) & previous.isNotNull() & (previous != ""), F.concat(previous, F.lit("\nAnschlussfrage: "), clean)).otherwise(clean)


# Stems of relational questions.
RELATIONAL = "verbind|zusammenh|bezieh|zwischen|weg von|reihenfolge|über wen|beeinfluss|kritisiert|lehrer|schüler|nachfolger|heirat|studiert|gemeinsam"


def route(mode: Column, linked: Column, question: Column) -> Column:
    """An explicit mode, else hybrid for two or more linked entities, else graph for relational words, else vector."""
    # A word boundary in ASCII before an umlaut holds only after a letter, digit or underscore.
    cue = rf"(?iu)(?:{_B}(?:{RELATIONAL.replace('über wen|', '')})|(?<=[A-Za-z0-9_])über wen)"
    return F.when(mode.isNotNull() & (mode != "auto"), mode).when(linked >= 2, "hybrid").when(question.rlike(cue), "graph").otherwise("vector")


# How a sentence ends, where one may be cut, and what stands for an answer that cannot be cut.
SENTENCE_END = r"""[.!?…]["'»”)\]]*$"""
SENTENCE_CUT = r"""(?s)^(.*[.!?…]["'»”)\]]*)(?:\s+[A-ZÄÖÜ0-9„“"']|$)"""
UNFINISHED = "Die lokale Antwort konnte innerhalb des Ausgabelimits nicht vollständig formuliert werden. Bitte frage etwas gezielter nach."
LEAST = 24


def completed(answer: Column) -> tuple[Column, Column]:
    """The collapsed answer up to its last sentence end, where it does not end with one, and whether it was cut.

    What is shorter than LEAST characters then gives way to a fixed sentence. An empty answer stays, uncut.
    """
    text = compact(answer)
    whole = (text == "") | text.rlike(SENTENCE_END)
    head = trim(F.regexp_extract(text, SENTENCE_CUT, 1))
    return F.when(whole, text).when(F.length(head) >= LEAST, head).otherwise(F.lit(UNFINISHED)), ~whole


# The forms of a request to add knowledge, of one to open a view, and the signs that quote a topic.
_GRAPH = "wissens(?:baum|graph(?:en)?)"
ADD = (
    r"^/(?:wissen|knowledge)\s+(.+)$",
    rf"^(?:bitte\s+)?füge\s+(?:bitte\s+)?(?:in|zu)\s+(?:deinen|meinen|den|dem)\s+{_GRAPH}\s+(.+?)\s+hinzu[.!?]?$",
    rf"^(?:bitte\s+)?füge\s+(?:bitte\s+)?(.+?)\s+(?:in|zu)\s+(?:deinen|meinen|den|dem)\s+{_GRAPH}\s+hinzu[.!?]?$",
    rf"^(?:bitte\s+)?nimm\s+(.+?)\s+in\s+(?:deinen|meinen|den)\s+{_GRAPH}\s+auf[.!?]?$",
    rf"^(?:bitte\s+)?ergänze\s+(?:deinen|meinen|den)\s+{_GRAPH}\s+um\s+(.+?)[.!?]?$",
    rf"^(?:bitte\s+)?speichere\s+(.+?)\s+(?:im|in\s+(?:deinem|meinem|dem))\s+{_GRAPH}[.!?]?$",
)
EXPLORER = r"^(?:öffne|zeige)(?:\s+mir)?\s+(?:den|meinen)?\s*(?:wissensraum|wissensbaum|graph(?:en)?|graph-explorer)$"
ARENA = (r"^(?:öffne|zeige)(?:\s+mir)?\s+(?:die\s+)?(?:live-)?arena$", r"^(?:vergleiche|vergleich)\s+(?:vektor-rag\s+(?:und|mit)\s+graph-rag|graph-rag\s+(?:und|mit)\s+vektor-rag)$")
QUOTES = "„“”\"'‚‘’"


def topic(said: Column) -> Column:
    """A topic without the quotes around it, then without its end marks."""
    return trim(F.regexp_replace(F.regexp_replace(compact(said), f"^[{QUOTES}]+|[{QUOTES}]+$", ""), "[.!?]+$", ""))


def command(text: Column) -> Column:
    """The topic of a request to add knowledge, else null: by the first form that fits, 2 to 160 characters."""
    said = compact(text)
    found = F.lit(None).cast("string")
    for form in reversed(ADD):
        found = F.when(said.rlike("(?iu)" + form), topic(F.regexp_extract(said, "(?iu)" + form, 1))).otherwise(found)
    return F.when(F.length(found).between(2, 160), found)


def action(text: Column) -> Column:
    """A request as struct<kind, topic, view>: add-wikipedia with its topic, open-view with explorer or arena, else null."""
    asked, said = command(text), F.regexp_replace(compact(text), "[.!?]+$", "")
    view = F.when(said.rlike("(?iu)" + EXPLORER), "explorer").when(said.rlike("(?iu)" + ARENA[0]) | said.rlike("(?iu)" + ARENA[1]), "arena")
    none = F.lit(None).cast("string")
    kind = F.when(asked.isNotNull(), "add-wikipedia").when(view.isNotNull(), "open-view")
    return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), asked.alias("topic"), F.when(asked.isNull(), view).otherwise(none).alias("view")))


def comparable(title: Column) -> Column:
    """A title for comparison: topic() without accents, lower case, other signs as blanks."""
    folded = F.regexp_replace(F.translate(F.lower(topic(title)), FOLD_FROM, FOLD_TO), "[\u0300-\u036f]", "")
    return F.trim(F.regexp_replace(folded, "[^a-z0-9ß]+", " "))


# The question's mark in a prompt, the context's, the history's heading, and limits in characters.
ASKED, CONTEXT, HISTORY = "\n\nFRAGE:", "KONTEXT:\n", "BISHERIGER GESPRÄCHSVERLAUF (nur für sprachliche Bezüge):"
NOTICE = "\n\n[… Kontext für das lokale Modell gekürzt …]"
BUDGET, TAIL, HEAD, ROOM = 10_500, 800, 1_000, 2_000
QUESTION_LIMIT, CONTEXT_LIMIT, HISTORY_LIMIT = 1200, 5000, 1800


def _last(text: Column, mark: str) -> Column:
    """Where a mark last stands, from 0; -1 for nowhere."""
    parts = F.split(text, F.lit("\\Q" + mark + "\\E"), -1)
    return F.when(F.size(parts) > 1, F.length(text) - F.length(F.element_at(parts, -1)) - len(mark)).otherwise(-1)


def shortened(system: Column, user: Column) -> Column:
    """A prompt within the budget: its head, a notice, and the part from the last question on."""
    room = F.greatest(F.lit(ROOM), F.lit(BUDGET) - F.length(system))
    at = _last(user, ASKED)
    tail = F.when(at >= 0, F.substring(user, at + 1, F.length(user))).otherwise(F.right(user, F.lit(TAIL)))
    head = F.greatest(F.lit(HEAD), room - F.length(tail) - len(NOTICE))
    return F.when(F.length(user) <= room, user).otherwise(F.concat(F.substring(user, F.lit(1), head), F.lit(NOTICE), tail))


def prompt_parts(user: Column) -> Column:
    """struct<question, context, history> of a prompt, each within its limit; the history keeps its end."""
    at = _last(user, ASKED)
    before = F.when(at >= 0, F.substring(user, F.lit(1), at)).otherwise(F.lit(""))
    question = trim(F.when(at >= 0, F.substring(user, at + len(ASKED) + 1, F.length(user))).otherwise(user))
    mark = F.instr(before, CONTEXT)
    context = trim(F.when(mark > 0, F.substring(before, mark + len(CONTEXT), F.length(before))).otherwise(F.lit("")))
    told = F.when(mark > 0, F.substring(before, F.lit(1), mark - 1)).otherwise(F.lit(""))
    history = trim(F.regexp_replace(told, r"^\Q" + HISTORY + r"\E(?U:\s*)", ""))
    return F.struct(F.substring(question, 1, QUESTION_LIMIT).alias("question"), F.substring(context, 1, CONTEXT_LIMIT).alias("context"), F.right(history, F.lit(HISTORY_LIMIT)).alias("history"))


def prompt(*sections: Column) -> Column:
    """Sections that are not blank, with blank lines between."""
    kept = F.filter(F.array(*sections), lambda x: x.isNotNull() & (trim(x) != ""))
    return F.array_join(kept, "\n\n")
