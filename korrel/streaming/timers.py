"""Live events with timers: the outbox that sends at intervals, reveals by themselves, and the host's inbox.

Each operator is a step over one room's events in order and what is due between them. A batch runs it over whole
rooms; a stream keeps its state and lets the watermark set off what is due. Both give the same rows, as far as the
watermark has come.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Milliseconds between two sends of a room, a question's time, and how long after it the reveal comes.
INTERVAL_MS, QUESTION_MS, LATE_MS = 600, 18_000, 40
HELD = 20
_SENT = "room long, event_id long, sent_at long, replay boolean"
_OUTBOX = "phase string, question int, current long, queue array<long>, snapshot long, replay boolean, last long, due long"
_REVEALED = "room long, event_id long, fires_at long"
_ACCEPTED = "room long, event_id long"
State = list


class Timed:
    """One room's step: new events, and what is due by a time. State is a list of plain values; due is its last one."""

    out: str
    kept: str
    start: State

    def begun(self, held: State) -> State:
        """A state that steps may change, of held values."""
        return [list(x) if isinstance(x, (list, tuple)) else x for x in held]

    def event(self, state: State, row, emit: Callable) -> None:
        """Takes one event into the state."""
        raise NotImplementedError

    def fire(self, state: State, emit: Callable) -> None:
        """Does what is due, and sets what is due next."""
        raise NotImplementedError

    def until(self, state: State, now: int, emit: Callable) -> None:
        """Everything that is due by now, at its own time."""
        while state[-1] is not None and state[-1] <= now:
            self.fire(state, emit)

    def over(self, state: State, rows: pd.DataFrame, emit: Callable) -> None:
        """A room's events in order, each after what was due before it."""
        for row in rows.itertuples():
            self.until(state, int(row.at), emit)
            self.event(state, row, emit)
            self.until(state, int(row.at), emit)


class _Outbox(Timed):
    out, kept, start = _SENT, _OUTBOX, [None, None, None, [], None, False, None, None]

    def __init__(self, interval: int):
        self.interval = interval

    def begun(self, held: State) -> State:
        # The line grows where states come faster than they are sent: taking from it must not copy it.
        return [deque(x) if isinstance(x, (list, tuple)) else x for x in held]

    def event(self, state: State, row, emit: Callable) -> None:
        phase, question, current = state[:3]
        if row.command == "sync":  # the newest state is published anew
            if current is None:
                return
            state[4], state[5] = current, True
        else:
            state[:3] = row.phase, int(row.question), int(row.event_id)
            if current is None or (phase, question) != (row.phase, int(row.question)):
                state[3].append(int(row.event_id))
                state[4] = None
            else:
                state[4], state[5] = int(row.event_id), False
        if state[7] is None:
            state[7] = int(row.at) if state[6] is None else max(int(row.at), state[6] + self.interval)

    def fire(self, state: State, emit: Callable) -> None:
        at = state[7]
        if state[3]:
            emit(state[3].popleft(), at, False)
        else:
            emit(state[4], at, bool(state[5]))
            state[4] = None
        state[6] = at
        state[7] = at + self.interval if state[3] or state[4] is not None else None


class _Reveal(Timed):
    out, kept, start = _REVEALED, "event_id long, due long", [None, None]

    def __init__(self, wait: int):
        self.wait = wait

    def event(self, state: State, row, emit: Callable) -> None:
        asked = row.phase == "question"
        state[:] = [int(row.event_id), int(row.at) + self.wait] if asked else [None, None]

    def fire(self, state: State, emit: Callable) -> None:
        emit(state[0], state[1])
        state[:] = [None, None]


def _columns(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _frame(rows: list, schema: str) -> pd.DataFrame:
    kinds = {"long": "int64", "boolean": "bool", "int": "int64", "string": "object"}
    made = pd.DataFrame(rows, columns=_columns(schema))
    return made.astype({x.split()[0]: kinds[x.split()[1]] for x in schema.split(", ")})


def _batch(events: DataFrame, step: Timed, until: int | None) -> DataFrame:
    """The step over each room's events (room, event_id, at, ...) in order, sequential by room, a batch at a time.

    until: a time up to which timers run on after a room's last event; None for no end.
    """
    end = (1 << 62) if until is None else until

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        room, state, made = None, None, []
        emit = lambda *x: made.append((room, *x))
        for batch in batches:
            for key, rows in batch.groupby("room", sort=True):
                if key != room:
                    if state is not None:
                        step.until(state, end, emit)
                    room, state = key, step.begun(step.start)
                step.over(state, rows, emit)
            yield _frame(made, step.out)
            made.clear()
        if state is not None:
            step.until(state, end, emit)
            yield _frame(made, step.out)

    return events.repartition("room").sortWithinPartitions("room", "at", "event_id").mapInPandas(run, step.out)


def _stream(events: DataFrame, step: Timed) -> DataFrame:
    """The same on a stream with a watermark; what is due goes off when the watermark passes it."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        made: list = []
        emit = lambda *x: made.append((key[0], *x))
        state = step.begun(held.get if held.exists else step.start)
        if not held.hasTimedOut:
            step.over(state, pd.concat(list(batches)).sort_values(["at", "event_id"]), emit)
        now = held.getCurrentWatermarkMs()
        step.until(state, now, emit)
        held.update(tuple(list(x) if isinstance(x, deque) else x for x in state))
        if state[-1] is not None:
            held.setTimeoutTimestamp(max(state[-1], now + 1))
        yield _frame(made, step.out)

    return events.groupBy("room").applyInPandasWithState(run, step.out, step.kept, "append", GroupStateTimeout.EventTimeTimeout)


def sent(events: DataFrame, interval_ms: int = INTERVAL_MS, until: int | None = None) -> DataFrame:
    """(room, event_id, sent_at, replay): what each room's outbox sends of states (room, event_id, at in ms, phase, question, command).

    A state with another phase or question than the one before waits in line; others are snapshots, of which the
    newest counts, and none that an own later change stands for. One is sent at once, or interval_ms after the last
    send: so the last state of a burst goes out when the interval ends, and nothing is lost. The command 'sync' asks for
    the newest state again. What is due at a time goes out before events of that time. Rows come in order of at, then event_id.
    """
    return _batch(events, _Outbox(interval_ms), until)


def sent_stream(events: DataFrame, interval_ms: int = INTERVAL_MS) -> DataFrame:
    """The same on a stream with a watermark on its times."""
    return _stream(events, _Outbox(interval_ms))


def revealed_stream(events: DataFrame, seconds: float = QUESTION_MS / 1000, late_ms: int = LATE_MS) -> DataFrame:
    """(room, event_id, fires_at) of a stream of states (room, event_id, at in ms, phase): questions that nothing ends in their time.

    The batch twin is live.auto_reveals.
    """
    return _stream(events, _Reveal(int(seconds * 1000) + late_ms))


def revealed(events: DataFrame, seconds: float = QUESTION_MS / 1000, late_ms: int = LATE_MS, until: int | None = None) -> DataFrame:
    """The same step over whole rooms."""
    return _batch(events, _Reveal(int(seconds * 1000) + late_ms), until)


class _Inbox(Timed):
    out, kept, start = _ACCEPTED, "held array<string>, due long", [[], None]

    def event(self, state: State, row, emit: Callable) -> None:
        if row.id not in state[0]:
            state[0] = [*state[0], row.id][-HELD:]
            emit(int(row.event_id))


def accepted(suggestions: DataFrame) -> DataFrame:
    """(room, event_id) of suggestions (room, event_id, id) that an inbox of the last HELD takes: those it does not hold then."""
    return _batch(suggestions.withColumn("at", F.lit(0).cast("long")), _Inbox(), None)


def accepted_stream(suggestions: DataFrame) -> DataFrame:
    """The same on a stream with a watermark and times (at)."""
    return _stream(suggestions, _Inbox())


def inbox(suggestions: DataFrame) -> DataFrame:
    """(room, id, topic, event_id) that each room's inbox holds at last."""
    rank = F.row_number().over(Window.partitionBy("room").orderBy(F.desc("event_id")))
    taken = accepted(suggestions).withColumn("rank", rank).filter(F.col("rank") <= HELD).select("event_id")
    return suggestions.join(taken, "event_id").select("room", "id", "topic", "event_id")
