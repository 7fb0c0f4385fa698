"""Keyed state that outlives batches: a cache whose entries have a lifetime, and games and tasks that are played as a stream."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from navgraph.operators.games import FINISHED, MAX_ATTEMPTS, RETRY_ERRORS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State that is larger than memory, with checkpoints of its changes alone; processors with timers need it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


class Entries(StatefulProcessor):
    """One entry a key: put, read while it lives, and dropped when it has not been touched for ``ttl`` milliseconds."""

    def __init__(self, ttl: int) -> None:
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "touched bigint, value string, hits bigint")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = self.entry.get()
        before, touched = held, held[0] if held else None
        value, hits = (held[1], held[2]) if held else (None, 0)
        for r in sorted(rows, key=lambda r: (r.at, r.event_id)):
            at = r.at if touched is None else max(r.at, touched)
            if touched is not None and at - touched > self.ttl:
                yield Row(key=key[0], at=touched + self.ttl, kind="expired", value=value, hits=hits)
                touched, value, hits = None, None, 0
            if r.put:
                touched, value = at, r.value
                yield Row(key=key[0], at=r.at, kind="put", value=value, hits=hits)
            elif touched is None:
                yield Row(key=key[0], at=r.at, kind="miss", value=None, hits=0)
            else:
                touched, hits = at, hits + 1
                yield Row(key=key[0], at=r.at, kind="hit", value=value, hits=hits)
        if before is not None and touched != before[0]:
            self.handle.deleteTimer(before[0] + self.ttl + 1)
        if touched is None:
            self.entry.clear()
        else:
            self.entry.update((touched, value, hits))
            if before is None or touched != before[0]:
                self.handle.registerTimer(touched + self.ttl + 1)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        held = self.entry.get()
        if held is not None and expiredTimerInfo.getExpiryTimeInMs() == held[0] + self.ttl + 1:
            self.entry.clear()
            yield Row(key=key[0], at=held[0] + self.ttl, kind="expired", value=held[1], hits=held[2])

    def close(self) -> None:
        pass


def lifetimes(events: DataFrame, ttl_seconds: float, delay: str = "0 seconds") -> DataFrame:
    """key, at (milliseconds), kind (put, hit, miss, expired), value, hits: what becomes of a cache's entries.

    ``events`` is a stream of key, ts, event_id, put (else it is a read) and
    value. A put and a read of a living entry touch it; an entry that has not
    been touched for longer than the lifetime is dropped, by a timer as soon as
    the watermark (``delay`` behind the latest time) has passed its end, or at
    the next event of its key, and reads miss from then on. State is one value
    and one timer a living key. Events of a key count in the order of their time
    within a batch, and none counts as earlier than one before it.
    """
    at = F.unix_millis("ts")
    rows = events.withWatermark("ts", delay).select("key", "ts", at.alias("at"), "event_id", "put", "value")
    return rows.groupBy("key").transformWithState(Entries(int(ttl_seconds * 1000)), "key bigint, at bigint, kind string, value string, hits bigint", "Append", "EventTime")


#: Groups that games are dealt to by hash; a group's games are one state, and its rows of a batch are worked off together.
GROUPS = 256
#: Statuses by number: what a game is known to be, the finished ones from 2 on; -1 before it is created.
STATUSES = ("not_started", "in_progress", *FINISHED)
WON, LOST_STEPS, LOST_MOVES, ERROR = (STATUSES.index(s) for s in ("won", "lost_max_steps", "lost_invalid_move", "error"))
_GAME = {"game_id": "object", "task_id": "object", "target_page_title": "object", "max_steps": "int64", "players": "int64", "status": "int64", "steps": "int64", "turn": "int64", "failed": "int64"}
_TRY = {"game_id": "object", "turn": "int64", "attempt": "int64", "to_page_title": "object", "error": "object"}


def _empty(columns: dict[str, str]) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series(dtype=kind) for c, kind in columns.items()})


def _packed(df: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(df, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes, columns: dict[str, str]) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(data)).read_all().to_pandas().astype(columns)


def play(games: pd.DataFrame, tries: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Take each game's attempts in the order of turn and attempt, as far as they are there: the games after it, and attempts that still wait.

    ``tries`` are one a game, turn and attempt. All games go on by one attempt at
    a time together, so there are as many rounds as the longest game has attempts.
    """
    games, order = games.reset_index(drop=True), pd.Index(games["game_id"])
    tries = tries.assign(game=order.get_indexer(tries["game_id"])).sort_values(["game", "turn", "attempt"], kind="stable", ignore_index=True)
    game, when, nth = (tries[c].to_numpy() for c in ("game", "turn", "attempt"))
    failed_try = tries["error"].notna().to_numpy()
    fatal = failed_try & ~tries["error"].isin(RETRY_ERRORS).to_numpy()
    target = games["target_page_title"].to_numpy(object)
    hit = ~failed_try & tries["to_page_title"].notna().to_numpy() & (tries["to_page_title"].to_numpy(object) == target[np.maximum(game, 0)] if len(games) else np.zeros(len(tries), bool))
    status, steps, turn, failed = (games[c].to_numpy(copy=True) for c in ("status", "steps", "turn", "failed"))
    most, known = games["max_steps"].to_numpy(), games["task_id"].notna().to_numpy()
    status[known & (status < 0)] = 0
    at, end = np.searchsorted(game, np.arange(len(games)), "left"), np.searchsorted(game, np.arange(len(games)), "right")
    live = np.flatnonzero(known & (status < 2) & (at < end))
    while len(live):
        x, t, f = at[live], turn[live], failed[live] + 1
        early = (when[x] < t) | ((when[x] == t) & (nth[x] < f))  # an attempt that is over
        due = (when[x] == t) & (nth[x] == f)
        g, x = live[due], x[due]
        bad, dead = failed_try[x], fatal[x]
        good = g[~bad]
        steps[good] += 1
        turn[good] += 1
        failed[good] = 0
        failed[g[bad & ~dead]] += 1
        status[g] = 1
        status[good[steps[good] >= most[good]]] = LOST_STEPS
        status[g[hit[x]]] = WON
        status[g[dead]] = ERROR
        status[g[bad & ~dead & (failed[g] >= MAX_ATTEMPTS)]] = LOST_MOVES
        live = live[early | due]
        at[live] += 1
        live = live[(status[live] < 2) & (at[live] < end[live])]
    games = games.assign(status=status, steps=steps, turn=turn, failed=failed)
    left = (when > turn[game]) | ((when == turn[game]) & (nth > failed[game])) if len(games) else np.zeros(len(tries), bool)
    return games, tries.loc[left & (status[game] < 2) if len(games) else left, list(_TRY)]


class Games(StatefulProcessor):
    """The turns of a group of games: attempts are taken in the order of turn and attempt, however they come, until one ends the game."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.group = handle.getValueState("group", "games binary, waiting binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = self.group.get() if self.group.exists() else None
        games, waiting = (_unpacked(held[0], _GAME), _unpacked(held[1], _TRY)) if held else (_empty(_GAME), _empty(_TRY))
        new = pd.concat(list(rows), ignore_index=True)
        is_try = new["turn"].notna()
        made = new.loc[~is_try, ["game_id", "task_id", "target_page_title", "max_steps", "players"]].drop_duplicates("game_id", keep="last")
        more = new.loc[is_try & new["attempt"].notna(), list(_TRY)].astype(_TRY)
        tries = (pd.concat([waiting, more], ignore_index=True) if len(waiting) else more).drop_duplicates(["game_id", "turn", "attempt"], keep="last")
        unknown = pd.Index(made["game_id"]).append(pd.Index(tries["game_id"])).unique().difference(pd.Index(games["game_id"]), sort=False)
        fresh = pd.DataFrame({"game_id": unknown, "task_id": None, "target_page_title": None, "max_steps": 0, "players": 0, "status": -1, "steps": 0, "turn": 1, "failed": 0}).astype(_GAME)
        games = pd.concat([games, fresh], ignore_index=True) if len(games) else fresh
        place = pd.Index(games["game_id"]).get_indexer(made["game_id"])
        for c in ("task_id", "target_page_title", "max_steps", "players"):
            values = games[c].to_numpy(copy=True)
            values[place] = made[c].astype(_GAME[c]).to_numpy()
            games[c] = values
        before = games["status"].to_numpy(), games["steps"].to_numpy()
        games, waiting = play(games, tries)
        self.group.update((_packed(games), _packed(waiting)))
        status, steps = games["status"].to_numpy(), games["steps"].to_numpy()
        told = games[(status >= 0) & ((status != before[0]) | (steps != before[1]))]
        if len(told):
            code = told["status"].to_numpy()
            yield pd.DataFrame({"task_id": told["task_id"].to_numpy(), "game_id": told["game_id"].to_numpy(), "status": np.array(STATUSES, object)[code], "steps": told["steps"].to_numpy(), "players": told["players"].to_numpy(), "ended": code >= 2})

    def close(self) -> None:
        pass


class Tasks(StatefulProcessor):
    """A task's games: passes on what it hears of them, and tells when how many of them are over, and once that all are."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.task = handle.getValueState("task", "players bigint, ended bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = self.task.get() if self.task.exists() else None
        players, ended = held or (None, 0)
        none = lambda n: pd.array([None] * n, "Int64")
        for r in rows:
            if not len(r):
                continue
            over = r["ended"].to_numpy(bool)
            players, ended = int(r["players"].iloc[-1]), ended + int(over.sum())
            yield pd.DataFrame({"type": np.where(over, "game_ended", "game_state"), "task_id": key[0], "game_id": r["game_id"].to_numpy(), "status": r["status"].to_numpy(), "steps": r["steps"].to_numpy(), "games": none(len(r)), "finished": none(len(r))})
        self.task.update((players, ended))
        if held is None or ended != held[1]:
            yield pd.DataFrame({"type": ["task_ended" if ended == players else "task_state"], "task_id": [key[0]], "game_id": [None], "status": [None], "steps": none(1), "games": [players], "finished": [ended]})

    def close(self) -> None:
        pass


def played(rows: DataFrame, groups: int = GROUPS) -> DataFrame:
    """type, task_id, game_id, status, steps, games, finished: what a stream of games and attempts comes to.

    ``rows`` has game_id, and either task_id, target_page_title, max_steps and
    players (how many games the task has) of a game that is created, or turn,
    attempt, to_page_title and error of an attempt, where turn is null in the
    first kind. Two stateful operators in a row: games turn attempts into moves
    and ends (as ``operators.games.outcomes`` has it), tasks count the ends of
    their games. The last row of each game and task is the same however its rows
    are dealt to batches: an attempt that comes early waits for its turn. An
    attempt after a game's end is dropped, as is its state's list of waiting
    ones. A turn whose second attempt never comes stays open.

    Games are dealt to ``groups`` by hash, so the state is read and written once
    a group and batch, and attempts are worked off as columns.
    """
    kinds = "task_id string, game_id string, status string, steps bigint, players bigint, ended boolean"
    dealt = rows.withColumn("_group", F.pmod(F.xxhash64("game_id"), F.lit(groups)))
    games = dealt.groupBy("_group").transformWithStateInPandas(Games(), kinds, "Append", "None")
    return games.groupBy("task_id").transformWithStateInPandas(Tasks(), "type string, task_id string, game_id string, status string, steps bigint, games bigint, finished bigint", "Append", "None")
