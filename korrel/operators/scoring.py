"""Scoring of answers and of retrieved evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from korrel.functions.text import normalize

# Phrases of an abstention.
ABSTENTIONS = (
    "keine gesicherte information",
    "keine information",
    "nicht im korpus",
    "nicht bekannt",
    "weiss ich nicht",
    "kann ich nicht beantworten",
    "enthalte mich",
    "liegt mir nicht vor",
    "existiert nicht",
    "finde ich im bereitgestellten kontext keine",
    "kann die demo-engine nicht antworten",
)


def is_abstention(answer: Column) -> Column:
    """Whether the folded answer holds one of the phrases; null gives false."""
    folded = normalize(F.coalesce(answer, F.lit("")))
    found = F.lit(False)
    for phrase in ABSTENTIONS:
        found = found | folded.contains(phrase)
    return found


def auto_score(answer: Column, must: Column, any_of: Column, expect_abstain: Column) -> Column:
    """korrekt, teilweise, falsch or enthaltung, by phrases that must or may stand in the folded answer."""
    folded = normalize(F.coalesce(answer, F.lit("")))
    hits = F.size(F.filter(must, lambda m: folded.contains(normalize(m))))
    any_ok = any_of.isNull() | F.exists(any_of, lambda m: folded.contains(normalize(m)))
    silent = is_abstention(answer)
    return (
        F.when(F.coalesce(expect_abstain, F.lit(False)), F.when(silent, "korrekt").otherwise("falsch")).when(silent, "enthaltung")
        .when((hits == F.size(must)) & any_ok, "korrekt").when(hits > 0, "teilweise").otherwise("falsch")
    )


def evidence(gold: Column, retrieved: Column) -> tuple[Column, Column]:
    """Recall and precision of a retrieved list; null recall without gold, null precision without hits to judge."""
    hits = F.size(F.filter(gold, lambda g: F.array_contains(retrieved, g)))
    none, empty = F.coalesce(F.size(gold), F.lit(0)) == 0, F.coalesce(F.size(retrieved), F.lit(0)) == 0
    return F.when(none, F.lit(None).cast("double")).when(empty, 0.0).otherwise(hits / F.size(gold)), F.when(none | empty, F.lit(None).cast("double")).otherwise(hits / F.size(retrieved))
