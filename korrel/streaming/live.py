"""Live events: stateful operators on streams, each with a batch twin that the tests compare it with."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from korrel.functions.text import compact, display_name

WINDOW_S, ROOM_LIMIT, PARTICIPANT_LIMIT = 60, 28, 4
_ALLOWED = "room long, event_id long, participant long, allowed boolean"
_STATE = "room_start double, room_count int, members array<struct<id:long,start:double,count:int>>"


def _consume(start: float | None, count: int, now: float, window: float, limit: int) -> tuple[bool, float, int]:
    """One request against a window that begins with its first request."""
    if start is None or start <= now - window:
        return True, now, 1
    return (True, start, count + 1) if count < limit else (False, start, count)


def _limited(rows: pd.DataFrame, state: tuple | None, window: float, room_limit: int, own_limit: int) -> tuple[pd.DataFrame, tuple]:
    start, count, members = state if state is not None else (None, 0, [])
    held = {(m["id"] if isinstance(m, dict) else m[0]): ((m["start"], m["count"]) if isinstance(m, dict) else (m[1], m[2])) for m in members}
    allowed = []
    for who, when in zip(rows["participant"], rows["ts"]):
        now = when.timestamp() if isinstance(when, datetime) else float(when)
        own_start, own_count = held.get(who, (None, 0))
        ok, own_start, own_count = _consume(own_start, own_count, now, window, own_limit)
        held[who] = (own_start, own_count)
        if ok:  # a participant's request counts even where the room then refuses it
            ok, start, count = _consume(start, count, now, window, room_limit)
        allowed.append(ok)
    # A window that is over says the same as none, so the state holds only the participants of one window.
    latest = max((s for s, _ in held.values()), default=0.0)
    kept = [(int(k), float(s), int(c)) for k, (s, c) in held.items() if s > latest - window]
    return rows.assign(allowed=allowed)[["room", "event_id", "participant", "allowed"]], (start, count, kept)


def rate_limited(events: DataFrame, window: float = WINDOW_S, room_limit: int = ROOM_LIMIT, own_limit: int = PARTICIPANT_LIMIT, idle_ms: int | None = None) -> DataFrame:
    """(room, event_id, participant, allowed) of a stream (room, event_id, participant, ts): two limits per request.

    Each room and participant has a window that its own first request opens. State is kept per room: the room's
    window and those of its participants that are not over.
    """

    def step(rows: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        return _limited(rows.sort_values(["ts", "event_id"]), state, window, room_limit, own_limit)

    return _by_room_stream(events, step, _ALLOWED, _STATE, idle_ms)


def _by_room_stream(events: DataFrame, step, out: str, kept: str, idle_ms: int | None) -> DataFrame:
    """step(rows of a room, state or None) -> (rows, state), with a state for each room.

    With idle_ms a room without events for so long is forgotten. Such a query runs batches without data too, so it
    never ends by itself: use it with a continuous trigger, not with availableNow.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        made, new = step(pd.concat(list(batches)), state.get if state.exists else None)
        state.update(new)
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield made

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return events.groupBy("room").applyInPandasWithState(run, out, kept, "append", timeout)


def rate_limited_batch(events: DataFrame, window: float = WINDOW_S, room_limit: int = ROOM_LIMIT, own_limit: int = PARTICIPANT_LIMIT) -> DataFrame:
    """The batch twin: one room's events at a time, in order."""

    def step(rows: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        return _limited(rows, state, window, room_limit, own_limit)

    return _by_room_batch(events, step, ["ts", "event_id"], _ALLOWED)


def _by_room_batch(events: DataFrame, step, order: list[str], out: str) -> DataFrame:
    """step over each room's rows in order, a batch at a time: sequential by room, as the state is, but never a room at once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        room, state = None, None
        for batch in batches:
            for key, rows in batch.groupby("room", sort=True):
                if key != room:
                    room, state = key, None
                made, state = step(rows, state)
                yield made

    return events.repartition("room").sortWithinPartitions("room", *order).mapInPandas(run, out)


def newer_states(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """States (room, event_id, revision) of a stream whose revision is above all before them in their room."""

    def step(rows: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        rows = rows.sort_values("event_id")
        before = rows["revision"].cummax().shift()
        before.iloc[0] = state[0] if state is not None else None
        highest = before.cummax() if state is not None else before
        keep = highest.isna() | (rows["revision"] > highest)
        return rows[keep][["room", "event_id", "revision"]], (int(max([rows["revision"].max(), *(state or ())])),)

    return _by_room_stream(events, step, "room long, event_id long, revision long", "highest long", idle_ms)


def coalesced(events: DataFrame, room: str = "room", order: str = "event_id") -> DataFrame:
    """What an outbox that was blocked sends of states (room, order, phase): every change of phase, and the room's last state.

    Other states are snapshots: a newer one or a later change stands for them.
    """
    w = Window.partitionBy(room).orderBy(order)
    flagged = events.withColumns({"change": F.coalesce(F.lag("phase").over(w) != F.col("phase"), F.lit(True)), "last": F.lead(order).over(w).isNull()})
    return flagged.filter("change or last").drop("last")


def published(events: DataFrame, order: str = "event_id") -> DataFrame:
    """Events (room, order, at in ms) with the revision they are published under and a strictly increasing updated_at.

    updated_at is the time, but at least one more than the last one: the largest of at - place so far, plus the place.
    """
    w = Window.partitionBy("room").orderBy(order)
    placed = events.withColumn("revision", F.row_number().over(w).cast("long"))
    return placed.withColumn("updated_at", F.max(F.col("at") - F.col("revision")).over(w) + F.col("revision"))


def auto_reveals(events: DataFrame, seconds: float = 18.0, late_ms: int = 40, order: str = "event_id") -> DataFrame:
    """(room, order, fires_at) of questions (phase question, at in ms) that nothing else ends before their deadline."""
    w = Window.partitionBy("room").orderBy(order)
    due = F.col("at") + int(seconds * 1000) + late_ms
    ended = F.lead("at").over(w)
    return events.withColumn("ended", ended).filter((F.col("phase") == "question") & (F.col("ended").isNull() | (F.col("ended") >= due))).select("room", order, due.alias("fires_at"))


def cleaned_topic(topic: Column, width: int = 80) -> Column:
    """Collapsed and cut; null where nothing is left."""
    return F.nullif(F.substring(compact(F.coalesce(topic, F.lit(""))), 1, width), F.lit(""))


_FLUSHED = "room long, event_id long"


def _flushes(wait_ms: int):
    def step(rows: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        last, keep = state[0] if state is not None else None, []
        for at in rows["at"]:
            keep.append(last is None or at - last >= wait_ms)
            last = int(at) if keep[-1] else last
        return rows[keep][["room", "event_id"]], (last,)

    return step


def throttled(events: DataFrame, wait_ms: int = 600) -> DataFrame:
    """(room, event_id) of events (room, event_id, at) that are published at once: at least wait_ms after the last such."""
    return _by_room_batch(events, _flushes(wait_ms), ["at", "event_id"], _FLUSHED)


def throttled_stream(events: DataFrame, wait_ms: int = 600, idle_ms: int | None = None) -> DataFrame:
    """The same on a stream."""
    step = _flushes(wait_ms)
    return _by_room_stream(events, lambda rows, state: step(rows.sort_values(["at", "event_id"]), state), _FLUSHED, "last long", idle_ms)


PLAYERS, DEADLINE_MS = 20, 18_000
_GAME = "room long, event_id long, accepted boolean, phase string, question int, players int, answers int"
_GAME_STATE = "phase string, question int, deadline long, players array<struct<id:long,answered:boolean>>"


def _commanded(total: int):
    def step(rows: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        phase, question, deadline, held = state if state is not None else ("lobby", -1, None, [])
        players = {(p["id"] if isinstance(p, dict) else p[0]): bool(p["answered"] if isinstance(p, dict) else p[1]) for p in held}
        out = []
        for e in rows.itertuples():
            ok = False
            if e.command == "ask" and phase in ("lobby", "reveal"):
                ok = True
                if question + 1 < total:
                    phase, question, deadline, players = "question", question + 1, int(e.at) + DEADLINE_MS, dict.fromkeys(players, False)
                else:
                    phase, deadline = "finished", None
            elif e.command == "reveal" and phase == "question":
                ok, phase, deadline = True, "reveal", None
            elif e.command == "join" and e.player not in players and len(players) < PLAYERS:
                ok = True
                players[e.player] = False
            elif e.command == "leave" and e.player in players:
                ok = True
                del players[e.player]
            elif e.command == "answer" and phase == "question" and e.at <= deadline and not players.get(e.player, True):
                ok = players[e.player] = True
            out.append((e.room, e.event_id, ok, phase, question, len(players), sum(players.values())))
        made = pd.DataFrame(out, columns=["room", "event_id", "accepted", "phase", "question", "players", "answers"])
        return made, (phase, question, deadline, [(int(i), a) for i, a in players.items()])

    return step


def game(events: DataFrame, total: int = 10) -> DataFrame:
    """Each room's quiz, from events (room, event_id, at in ms, command, player): whether a command takes effect, and what is then.

    ask begins the next of `total` questions from the lobby or a reveal, or finishes after the last; reveal ends a
    question; join adds a player below PLAYERS; leave removes one and counts anew; an answer counts once, in time by
    the host's clock. A command that does not fit changes nothing.
    """
    return _by_room_batch(events, _commanded(total), ["event_id"], _GAME)


def game_stream(events: DataFrame, total: int = 10, idle_ms: int | None = None) -> DataFrame:
    """The same on a stream."""
    step = _commanded(total)
    return _by_room_stream(events, lambda rows, state: step(rows.sort_values("event_id"), state), _GAME, _GAME_STATE, idle_ms)


def scored_answers(answers: DataFrame, seconds: float = 18.0) -> DataFrame:
    """(room, player, question, correct, gain, streak): each player's first answer to a question, scored.

    A right answer gains 1000, up to 1000 more for the time left, and 100 per right answer directly before.
    """
    first = answers.groupBy("room", "player", "question").agg(F.min_by(F.struct("event_id", "correct", "elapsed"), "event_id").alias("a")).select("room", "player", "question", "a.*")
    w = Window.partitionBy("room", "player").orderBy("event_id")
    hit = F.col("correct").cast("int")
    runs = first.withColumn("miss", F.sum(1 - hit).over(w))
    streak = F.sum(hit).over(Window.partitionBy("room", "player", "miss").orderBy("event_id"))
    scored = runs.withColumn("streak", streak)
    left = F.greatest(F.lit(0.0), 1 - F.col("elapsed") / seconds)
    gain = F.when(F.col("correct"), 1000 + F.floor(1000 * left + 0.5) + 100 * (F.col("streak") - 1)).otherwise(0)
    return scored.select("room", "player", "question", "event_id", "correct", gain.cast("long").alias("gain"), F.when(F.col("correct"), F.col("streak")).otherwise(0).cast("long").alias("streak"))


def leaderboard(scored: DataFrame, names: DataFrame) -> DataFrame:
    """(room, player, name, score, streak, place): the players of each room by score, running streak, and name.

    names: (player, name), at most one row each; a player without one is a guest. Names are in German order, players of
    equal names by id. A streak is that of the last answer.
    """
    total = scored.groupBy("room", "player").agg(F.sum("gain").alias("score"), F.max_by("streak", "event_id").alias("streak"))
    named = total.join(names.select("player", "name"), "player", "left").withColumn("name", display_name(F.col("name")))
    order = [F.desc("score"), F.desc("streak"), F.collate("name", "de").asc(), F.asc("player")]
    return named.select("room", "player", "name", "score", "streak", F.row_number().over(Window.partitionBy("room").orderBy(*order)).alias("place"))
