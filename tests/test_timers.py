"""Outbox, reveals, inbox and moderated commits: batch against plain Python, stream against batch."""

import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from korrel.streaming import live, moderation, timers

EVENTS = "room long, event_id long, at long, phase string, question int, command string, id string"


def events(seed, n=120, rooms=3):
    r, out, at = random.Random(seed), [], 1_000_000
    for i in range(n):
        at += r.choice([0, 10, 150, 700, 3000, 20_000] if r.random() < 0.4 else [0, 10, 150])
        out.append((r.randint(1, rooms), i, at, r.choice(["question", "reveal", "lobby"]), r.randint(0, 1), r.choice(["state", "state", "state", "sync"]), f"s{r.randint(0, 30)}"))
    return out


def outbox(rows, until):
    """The rule told from the sender's side: every millisecond at which something is due."""
    out = []
    for room in {x[0] for x in rows}:
        line, shot, current, last, timer = [], None, None, None, None

        def flush(upto, room=room):
            nonlocal line, shot, last, timer
            while timer is not None and timer <= upto:
                if line:
                    out.append((room, line.pop(0), timer, False))
                else:
                    out.append((room, *shot[:1], timer, shot[1]))
                    shot = None
                last, timer = timer, (timer + 600 if line or shot else None)

        for _, event, at, phase, question, command, _ in sorted((x for x in rows if x[0] == room), key=lambda x: (x[2], x[1])):
            flush(at)
            if command == "sync":
                if current is None:
                    continue
                shot = (current[0], True)
            elif current is None or current[1:] != (phase, question):
                line.append(event)
                shot, current = None, (event, phase, question)
            else:
                shot, current = (event, False), (event, phase, question)
            timer = timer if timer is not None else at if last is None else max(at, last + 600)
            flush(at)
        flush(until)
    return sorted(out)


def streamed(spark, tmp_path, rows, operator, name):
    """What a stream makes of rows in four files, with a late event of another room that moves the watermark on."""
    folder, end = str(tmp_path / name), rows[-1][2] + 100_000
    last = [(99, 10_000, end, "lobby", 0, "state", "z"), (99, 10_001, end + 1, "lobby", 0, "state", "z")]
    for part in [*[rows[k : k + 30] for k in range(0, len(rows), 30)], last[:1], last[1:]]:
        spark.createDataFrame(part, EVENTS).withColumn("ts", F.timestamp_millis("at")).coalesce(1).write.mode("append").parquet(folder)
    schema = spark.read.parquet(folder).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder).withWatermark("ts", "0 seconds")
    q = operator(stream).writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert not q.isActive
    return spark.table(name).filter("room <> 99"), end


def test_outbox_sends_the_last_state_of_a_burst(spark):
    """A burst: transitions leave in order, 600 ms apart; the state between them never does, the last one does."""
    rows = [(1, 1, 0, "lobby", 0, "state", ""), (1, 2, 10, "lobby", 0, "state", ""), (1, 3, 20, "question", 0, "state", ""), (1, 4, 30, "reveal", 0, "state", ""), (1, 5, 40, "question", 1, "state", ""), (1, 6, 50, "question", 1, "state", ""), (1, 7, 5000, "", 0, "sync", ""), (2, 8, 0, "", 0, "sync", "")]
    got = timers.sent(spark.createDataFrame(rows, EVENTS)).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 0, False), (1, 3, 600, False), (1, 4, 1200, False), (1, 5, 1800, False), (1, 6, 2400, False), (1, 6, 5000, True)]
    assert timers.sent(spark.createDataFrame([], EVENTS)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_outbox_stream(spark, tmp_path, seed):
    rows = events(seed)
    got, end = streamed(spark, tmp_path, rows, timers.sent_stream, f"sent{seed}")
    want = outbox(rows, end)
    df = spark.createDataFrame(rows, EVENTS)
    assert sorted(tuple(r) for r in timers.sent(df, until=end).collect()) == want and any(r[3] for r in want)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_reveals_on_a_stream(spark, tmp_path):
    rows = events(3)
    got, end = streamed(spark, tmp_path, rows, timers.revealed_stream, "revealed")
    df = spark.createDataFrame(rows, EVENTS)
    batch = sorted(tuple(r) for r in timers.revealed(df, until=end).collect())
    assert batch and sorted(tuple(r) for r in got.collect()) == batch
    assert batch == sorted(tuple(r) for r in live.auto_reveals(df).filter(F.col("fires_at") <= end).collect())


def test_inbox_takes_back_what_it_no_longer_holds(spark, tmp_path):
    rows = [(1, i, 1000 + i, "", 0, "", f"s{(i * 7) % 31 if i % 3 else i % 5}") for i in range(90)]
    want, held = [], []
    for room, i, *_, key in rows:
        if key not in held:
            held = [*held, key][-20:]
            want.append((room, i))
    df = spark.createDataFrame(rows, EVENTS)
    assert sorted(tuple(r) for r in timers.accepted(df).collect()) == want and len(want) > 31
    assert {r["id"] for r in timers.inbox(df.withColumn("topic", F.lit("t"))).collect()} == set(held)
    got, _ = streamed(spark, tmp_path, rows, timers.accepted_stream, "accepted")
    assert sorted(tuple(r) for r in got.collect()) == want


PROVENANCE = "array<struct<sourceId:string,importScopeId:string,sourceKind:string,sourceTitle:string,method:string,page:int,pageEnd:int,section:int,charStart:int,charEnd:int,revisionId:long,targetTitle:string,score:double,threshold:double,sharedTerms:array<string>,contentFingerprint:string,evidence:string,confidence:string>>"


def test_moderated_commits_happen_once(spark, tmp_path):
    nodes = spark.createDataFrame([], f"id string, title string, type string, community string, aliases array<string>, summary string, provenance {PROVENANCE}")
    edges = spark.createDataFrame([], f"source string, target string, relation string, label string, provenance {PROVENANCE}")
    base = spark.createDataFrame([("u_logik",)], "id string")
    ask, say = "room long, id string, topic string, ts timestamp", "room long, id string, accepted boolean, ts timestamp"
    time = lambda m: f"timestamp'2026-01-01 00:{m:02d}:00'"
    rows = lambda schema, *parts: [spark.createDataFrame([(*x[:-1], None) for x in p], schema).drop("ts").join(spark.createDataFrame([(*x[:2], x[-1]) for x in p], "room long, id string, m int"), ["room", "id"]).withColumn("ts", F.make_timestamp(F.lit(2026), F.lit(1), F.lit(1), F.lit(0), "m", F.lit(0))).drop("m").select(*[c.split()[0] for c in schema.split(", ")]) for p in parts]
    assert time(1)
    asked = rows(ask, [(1, "a", "Hannah Arendt", 1), (1, "b", "Ethik", 2), (1, "c", "Logik", 2)], [(2, "d", "ethik", 3), (2, "e", "Nie entschieden", 4)])
    said = rows(say, [(1, "a", True, 2), (1, "b", True, 3), (1, "c", True, 3)], [(2, "d", True, 5), (1, "x", True, 5), (2, "e", False, 6)])
    for name, parts in (("asked", asked), ("said", said)):
        for part in parts:
            part.coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    read = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    folder = str(tmp_path / "graph")
    assert moderation.graph(spark, folder) is None
    commit, seen = moderation.committer(folder, base, nodes, edges), {}

    def twice(batch, number):
        kept = batch.persist()
        commit(kept, number)
        first = sorted(map(str, moderation.graph(spark, folder)[0].collect()))
        commit(kept, number)  # the batch comes again
        assert sorted(map(str, moderation.graph(spark, folder)[0].collect())) == first
        seen[number] = kept.count()

    joined = moderation.decided(read("asked", ask), read("said", say))
    q = joined.writeStream.foreachBatch(twice).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None and sum(seen.values()) == 5
    made, _ = moderation.graph(spark, folder)
    got = {r["id"]: r for r in made.collect()}
    assert set(got) == {"u_hannah_arendt", "u_ethik"} and len(got["u_ethik"]["provenance"]) == 2  # two rooms, the base's id is refused
    table = moderation.decided(*[x.unionByName(y) for x, y in (asked, said)])
    assert {(r["id"], r["accepted"]) for r in table.collect()} == {("a", True), ("b", True), ("c", True), ("d", True), ("e", False)}


def test_a_long_line_is_not_copied():
    """States that come faster than they are sent wait in line, each taken in and sent in constant time."""
    step, out = timers._Outbox(1000), []
    state = step.begun(step.start)
    rows = pd.DataFrame({"event_id": range(200_000), "at": range(200_000), "phase": ["a", "b"] * 100_000, "question": 0, "command": "state"})
    begun = time.process_time()
    step.over(state, rows, lambda *x: out.append(x))
    step.until(state, 1 << 62, lambda *x: out.append(x))
    assert [x[0] for x in out] == list(range(200_000)) and time.process_time() - begun < 20
    assert not step.start[3]
