"""Streams: topics that fail apart, entries that expire, and games played by chained stateful operators, whatever the batches."""

from __future__ import annotations

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from navgraph.operators import games
from navgraph.streaming import events, state
from navgraph.streaming.topics import Topics

SOURCE = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
HOUR = 3_600_000


def write_files(spark, folder, batches, schema):
    """One file a batch, in the order of their times, so that a stream takes them one by one."""
    for n, rows in enumerate(batches):
        part = str(folder / f"w{n}")
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(part)
        name = next(f for f in os.listdir(part) if f.endswith(".parquet"))
        os.makedirs(folder / "in", exist_ok=True)
        os.rename(f"{part}/{name}", folder / "in" / f"{n}.parquet")
        os.utime(folder / "in" / f"{n}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))
    return str(folder / "in")


def at(ms):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(milliseconds=ms)


def millis(ms):
    return int((at(ms) - datetime.datetime(1970, 1, 1)).total_seconds() * 1000)


def event(i, ms, game, kind):
    return (i, at(ms), game, kind, 1.0, "{}")


def ids(spark, path):
    return sorted(r.event_id for r in spark.read.parquet(path).collect()) if os.path.exists(path) else []


def test_a_failing_handler_holds_nobody_up_and_loses_nothing(spark, tmp_path):
    batches = [[event(10 * n + k, n * HOUR + k, 1, ("click", "purchase")[k % 2]) for k in range(4)] for n in range(3)]
    source = write_files(spark, tmp_path, batches, SOURCE)
    topics, broken = Topics(spark, lambda: events.event_stream(spark, source, 1), str(tmp_path / "topics")), [True]

    def keep(name, fails=lambda number: False):
        def write(batch, number):
            if fails(number):
                raise ValueError("the sink is away")
            batch.write.mode("overwrite").parquet(str(tmp_path / name / f"batch={number}"))

        return write

    topics.subscribe("move_completed", "solver", keep("solver", lambda number: number == 1 and broken[0]))
    topics.subscribe("move_completed", "viewers", keep("viewers"))
    topics.subscribe("game_ended", "storage", keep("storage"))
    topics.start(once=True)
    topics.tend(once=True, restarts=2)
    states = {s.handler: s.state for s in topics.all.values()}
    assert states == {"solver": "failed", "viewers": "done", "storage": "done"}
    failed = topics.all["move_completed", "solver"]
    assert failed.restarts == 2 and len(failed.errors) == 3 and all("the sink is away" in e for e in failed.errors)
    moves, ends = [0, 2, 10, 12, 20, 22], [1, 3, 11, 13, 21, 23]
    assert ids(spark, str(tmp_path / "viewers")) == moves and ids(spark, str(tmp_path / "storage")) == ends and ids(spark, str(tmp_path / "solver")) == [0, 2]
    broken[0] = False
    write_files(spark, tmp_path / "more", [[event(99, 9 * HOUR, 1, "click")]], SOURCE)
    os.rename(tmp_path / "more" / "in" / "0.parquet", tmp_path / "in" / "9.parquet")
    topics.start(once=True)
    topics.tend(once=True)
    assert {s.state for s in topics.all.values()} == {"done"}
    assert ids(spark, str(tmp_path / "solver")) == ids(spark, str(tmp_path / "viewers")) == [*moves, 99] and ids(spark, str(tmp_path / "storage")) == ends


def test_a_failing_handler_recovers_by_itself(spark, tmp_path):
    source = write_files(spark, tmp_path, [[event(n, n * HOUR, 1, "click")] for n in range(3)], SOURCE)
    topics, tries = Topics(spark, lambda: events.event_stream(spark, source, 1), str(tmp_path / "topics")), []

    def write(batch, number):
        tries.append(number)
        if tries.count(1) == 1 and number == 1:
            raise ValueError("once")
        batch.write.mode("overwrite").parquet(str(tmp_path / "out" / f"batch={number}"))

    s = topics.subscribe("move_completed", "solver", write)
    topics.start(once=True)
    topics.tend(once=True)
    assert s.state == "done" and s.restarts == 1 and tries == [0, 1, 1, 2] and ids(spark, str(tmp_path / "out")) == [0, 1, 2]


def test_game_states_over_batches_out_of_order(spark, tmp_path):
    batches = [[event(1, 5 * HOUR, 1, "click"), event(2, HOUR, 2, "purchase")], [event(3, 2 * HOUR, 1, "view"), event(4, 3 * HOUR, 2, "click")], [event(5, 4 * HOUR, 1, "click")]]
    out = events.drain(events.fold_games(events.event_stream(spark, write_files(spark, tmp_path, batches, SOURCE), 1)), "update", ["game_id"])
    assert {r.game_id: (r.moves, r.solved, r.ended, r.last_event) for r in out.collect()} == {1: (2, 1, False, 1), 2: (1, 0, True, 4)}


ENTRY = "key bigint, ts timestamp, event_id bigint, put boolean, value string"


def lives(spark, folder, batches, ttl_s=3600):
    state.use_rocksdb(spark)
    source = write_files(spark, folder, [[(k, at(ms), i, put, f"v{i}") for i, (k, ms, put) in rows] for rows in batches], ENTRY)
    stream = spark.readStream.schema(ENTRY).option("maxFilesPerTrigger", 1).parquet(source)
    return events.run_through(state.lifetimes(stream, ttl_s), "append").orderBy("_batch").collect()


def test_an_untouched_entry_expires_and_a_touched_one_does_not(spark, tmp_path):
    steps = [(1, 0, True), (2, 0, True), (2, 0.8 * HOUR, False), (3, 1.2 * HOUR, False), (2, 1.6 * HOUR, False), (1, 1.9 * HOUR, False), (2, 2.2 * HOUR, False)]
    out = lives(spark, tmp_path, [[x] for x in enumerate(steps)])
    own = lambda key: [(r.kind, r.at) for r in out if r.key == key]
    assert own(1) == [("put", millis(0)), ("expired", millis(HOUR)), ("miss", millis(1.9 * HOUR))]
    assert [k for k, _ in own(2)] == ["put", "hit", "hit", "hit"] and [k for k, _ in own(3)] == ["miss"]
    # The timer drops the entry as soon as time has passed its end, not when somebody asks for it.
    assert next(r._batch for r in out if r.key == 1 and r.kind == "expired") < next(r._batch for r in out if r.key == 1 and r.kind == "miss")


def lives_brute(steps, ttl):
    """What becomes of entries by a plain loop, as (key, kind) counts; entries that live at the end are left out."""
    out, held, now = [], {}, max(ms for _, ms, _ in steps)
    for key, ms, put in steps:
        if key in held and ms - held[key] > ttl:
            out.append((key, "expired"))
            del held[key]
        if put or key in held:
            held[key] = ms
        out.append((key, "put" if put else "hit" if key in held else "miss"))
    return sorted(out + [(k, "expired") for k, ms in held.items() if ms + ttl < now])


@pytest.mark.parametrize("cut", [1, 7, 60])
def test_entries_for_any_batches(spark, tmp_path, cut):
    rng, ms, steps = random.Random(11), 0, []
    for _ in range(60):
        ms += rng.randrange(1, HOUR // 2)
        steps.append((rng.randrange(4), ms, rng.random() < 0.3))
    size = -(-len(steps) // min(cut, 6)) if cut < 60 else len(steps)
    numbered = list(enumerate(steps))
    out = lives(spark, tmp_path, [numbered[k : k + size] for k in range(0, len(numbered), size)])
    assert sorted((r.key, r.kind) for r in out) == lives_brute(steps, HOUR)


PLAY = "game_id string, task_id string, target_page_title string, max_steps bigint, players bigint, turn bigint, attempt bigint, to_page_title string, error string"


def played_rows():
    """Games of three tasks with all kinds of ends, and one task with a game that nobody plays."""
    rng, attempts, configs = random.Random(5), [], []
    for g in range(24):
        name, task = f"g{g}", f"t{g % 4}"
        configs.append((name, task, "T", rng.choice([2, 4, 9]), 6))
        if g == 23:
            continue
        for turn in range(1, rng.randrange(1, 7)):
            tries = rng.choice([["ok"], ["ok"], ["ok"], ["model_invalid_link", "ok"], ["app_navigation_error", "model_no_tool_call"], ["provider_timeout"]])
            for k, error in enumerate(tries, 1):
                page = rng.choice(["T", "A", "B", "C"]) if error == "ok" else None
                attempts.append((name, turn, k, page, None if error == "ok" else error))
    return attempts, configs


@pytest.mark.parametrize("cut", ["one", "in order", "shuffled", "backwards"])
def test_played_games_for_any_batches(spark, tmp_path, cut):
    attempts, configs = played_rows()
    rows = [(g, t, target, most, n, None, None, None, None) for g, t, target, most, n in configs] + [(g, None, None, None, None, *rest) for g, *rest in attempts]
    if cut == "shuffled":
        random.Random(1).shuffle(rows)
    if cut == "backwards":
        rows.reverse()
    size = len(rows) if cut == "one" else -(-len(rows) // 4)
    source = write_files(spark, tmp_path, [rows[k : k + size] for k in range(0, len(rows), size)], PLAY)
    state.use_rocksdb(spark)
    out = events.run_through(state.played(spark.readStream.schema(PLAY).option("maxFilesPerTrigger", 1).parquet(source)), "append").collect()
    tries = spark.createDataFrame(attempts, "game_id string, turn int, attempt int, to_page_title string, error string")
    made = spark.createDataFrame(configs, "game_id string, task_id string, target_page_title string, max_steps int, players int")
    want = {r.game_id: (r.status, r.steps) for r in games.outcomes(tries, made).collect()}
    last = {r.game_id: (r.status, r.steps) for r in sorted((r for r in out if r.game_id), key=lambda r: (r._batch, r.steps, r.type == "game_ended"))}
    assert last == want and {"won", "lost_max_steps", "lost_invalid_move", "error", "in_progress", "not_started"} == {s for s, _ in want.values()}
    over = {g for g, (s, _) in want.items() if s in games.FINISHED}
    assert sorted(r.game_id for r in out if r.type == "game_ended") == sorted(over)  # each end is told once
    tasks = {r.task_id: (r.games, r.finished) for r in sorted((r for r in out if r.game_id is None), key=lambda r: (r._batch, r.finished))}
    assert tasks == {f"t{k}": (6, sum(int(g[1:]) % 4 == k for g in over)) for k in range(4)}
    assert sorted(r.task_id for r in out if r.type == "task_ended") == sorted(t for t, (n, done) in tasks.items() if n == done)


def test_games_of_a_group_share_a_state_and_are_played_together(spark, tmp_path):
    """One group for all games, in two batches, the second of which has the games themselves: nothing is told before, and all as by one window a game."""
    attempts, configs = played_rows()
    rows = [[(g, None, None, None, None, *rest) for g, *rest in attempts], [(g, t, target, most, n, None, None, None, None) for g, t, target, most, n in configs]]
    source = write_files(spark, tmp_path, rows, PLAY)
    state.use_rocksdb(spark)
    out = events.run_through(state.played(spark.readStream.schema(PLAY).option("maxFilesPerTrigger", 1).parquet(source), groups=1), "append").collect()
    tries = spark.createDataFrame(attempts, "game_id string, turn int, attempt int, to_page_title string, error string")
    made = spark.createDataFrame(configs, "game_id string, task_id string, target_page_title string, max_steps int, players int")
    want = {r.game_id: (r.status, r.steps) for r in games.outcomes(tries, made).collect()}
    assert {r._batch for r in out} == {1} and sorted((r.game_id, r.status, r.steps) for r in out if r.game_id) == sorted((g, *s) for g, s in want.items())
