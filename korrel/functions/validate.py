"""Constraints of events and states as boolean columns; a null anywhere gives false."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def holds(c: Column) -> Column:
    """c, with false for null."""
    return F.coalesce(c, F.lit(False))


def safe_id(x: Column) -> Column:
    """1 to 128 letters, digits, dots, colons, hyphens or underscores."""
    return holds(x.rlike(r"^[A-Za-z0-9._:-]{1,128}$"))


def bounded(x: Column, least: int, most: int) -> Column:
    """Trimmed length within bounds."""
    return holds(F.length(F.trim(x)).between(least, most))


def room_code(x: Column) -> Column:
    """Six capitals or digits."""
    return holds(x.rlike("^[A-Z0-9]{6}$"))


def whole(x: Column, most: int) -> Column:
    """A whole number from 0."""
    return holds((x == F.floor(x)) & x.between(0, most))


def question(q: Column) -> Column:
    """Two to eight options with distinct ids and bounded titles."""
    ids = F.transform(q["options"], lambda o: o["id"])
    return holds(safe_id(q["id"]) & bounded(q["prompt"], 1, 500) & F.size(ids).between(2, 8) & (F.size(F.array_distinct(ids)) == F.size(ids)) & F.forall(q["options"], lambda o: bounded(o["title"], 1, 200)))


def player(p: Column) -> Column:
    """Bounds of a player's fields."""
    return holds(safe_id(p["id"]) & bounded(p["name"], 1, 20) & p["color"].rlike("^#[0-9A-Fa-f]{6}$") & whole(p["score"], 1_000_000) & whole(p["streak"], 1000) & p["answered"].isNotNull())


def may_send(role: Column, event: Column) -> Column:
    """Hosts publish states; players join, answer, leave and ask for the state."""
    return holds(((role == "host") & (event == "state")) | ((role == "player") & event.isin("join", "answer", "leave", "sync")))


PHASES = ("lobby", "question", "reveal", "finished")


def timestamp(x: Column) -> Column:
    """A finite number above 0."""
    return holds((x > 0) & ~F.isnan(x.cast("double")) & (x.cast("double") < float("inf")))


def distinct(values: Column) -> Column:
    """Whether an array repeats nothing."""
    return holds(F.size(F.array_distinct(values)) == F.size(values))


def reveal(r: Column, q: Column) -> Column:
    """A reveal's bounds; with a question, the right answer must be one of its options."""
    ids = r["graphNodeIds"]
    known = q.isNull() | F.exists(q["options"], lambda o: o["id"] == r["correctId"])
    return holds(safe_id(r["correctId"]) & bounded(r["explanation"], 1, 2000) & bounded(r["classification"], 1, 500) & (F.size(ids) <= 100) & F.forall(ids, safe_id) & distinct(ids) & known)


def state(s: Column, room: Column | None = None) -> Column:
    """A published state: bounds of its fields, distinct players, and what its phase must and must not have."""
    q, r, phase = s["question"], s["reveal"], s["phase"]
    players = F.transform(s["players"], lambda p: p["id"])
    shape = (
        F.when(phase == "lobby", q.isNull() & s["deadlineMs"].isNull() & r.isNull()).when(phase == "question", q.isNotNull() & s["deadlineMs"].isNotNull() & r.isNull())
        .when(phase == "reveal", q.isNotNull() & s["deadlineMs"].isNull() & r.isNotNull()).when(phase == "finished", s["deadlineMs"].isNull()).otherwise(False)
    )
    ok = (s["version"] == 1) & room_code(s["roomCode"]) & (s["revision"] >= 1) & safe_id(s["hostId"]) & phase.isin(*PHASES)
    ok = ok & whole(s["questionIndex"], 99) & s["totalQuestions"].between(1, 100) & (s["questionIndex"] < s["totalQuestions"]) & (q.isNull() | question(q))
    ok = ok & (s["deadlineMs"].isNull() | timestamp(s["deadlineMs"])) & (F.size(s["players"]) <= 20) & F.forall(s["players"], player) & distinct(players)
    ok = ok & (s["answerCount"] >= 0) & (s["answerCount"] <= F.size(players)) & timestamp(s["updatedAt"]) & (r.isNull() | reveal(r, q)) & shape
    return holds(ok) if room is None else holds(ok & (s["roomCode"] == F.upper(F.trim(room))))


def join_payload(p: Column) -> Column:
    """Who joins: id, name and colour."""
    return holds(safe_id(p["id"]) & bounded(p["name"], 1, 20) & p["color"].rlike("^#[0-9A-Fa-f]{6}$"))


def answer_payload(p: Column) -> Column:
    """An answer: player, question, option and time."""
    return holds(safe_id(p["playerId"]) & safe_id(p["questionId"]) & safe_id(p["optionId"]) & timestamp(p["at"]))


def suggestion_payload(p: Column) -> Column:
    """A suggested topic and who suggests it."""
    return holds(safe_id(p["id"]) & safe_id(p["playerId"]) & bounded(p["playerName"], 1, 24) & bounded(p["topic"], 1, 80))


def decision_payload(p: Column) -> Column:
    """The decision on a suggestion."""
    return holds(safe_id(p["id"]) & bounded(p["topic"], 1, 80) & p["accepted"].isNotNull() & bounded(p["message"], 1, 500))


def room_active(asked: Column, room: Column, expires: Column, now: Column) -> Column:
    """Whether a room's code is asked for and has not expired; without an expiry it is closed."""
    return holds((asked == room) & (now <= expires))


def request(p: Column) -> Column:
    """Bounds of a request to the server: participant, question, context and history."""
    size = lambda x, most: F.length(F.coalesce(x, F.lit(""))) <= most
    return holds(p["participantId"].rlike("^[A-Za-z0-9_-]{8,64}$") & F.length(F.trim(p["question"])).between(1, 1200) & size(p["context"], 5000) & size(p["history"], 1800))


def allowed_origin(origin: Column, allowed: list[str]) -> Column:
    """The origin without its last slash if it is allowed, else the first allowed one."""
    plain = F.regexp_replace(F.coalesce(origin, F.lit("")), "/$", "")
    return F.when(plain.isin(*allowed), plain).otherwise(F.lit(allowed[0]))
