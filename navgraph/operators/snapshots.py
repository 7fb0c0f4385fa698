"""Solver results of running games as a versioned snapshot with a log of changes, so that a viewer who comes back needs only what is new."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navgraph.session import materialize
from navgraph.sources.tables import Commits

#: What a row of results or a log holds: a result (page and its value) or the end of its game (ended, no page).
COLUMNS = ("game_id", "page_title", "length", "paths", "at", "event_id", "ended")


def live_results(rows: DataFrame) -> DataFrame:
    """The results that hold after ``rows`` (``COLUMNS``): of each game and page the last, by time and event, unless the game ended later.

    Results that hold are rows of the same kind, so those of a snapshot and the
    rows since then give what all rows give: earlier rows can be forgotten.
    """
    when = F.struct("at", "event_id")
    ends = rows.filter("ended").groupBy("game_id").agg(F.max(when).alias("end"))
    value = F.struct("length", "paths", "at", "event_id")
    last = rows.filter("NOT ended").groupBy("game_id", "page_title").agg(F.max_by(value, when).alias("v"))
    held = last.join(ends, "game_id", "left").filter(F.col("end").isNull() | (F.struct("v.at", "v.event_id") > F.col("end")))
    return held.select("game_id", "page_title", "v.length", "v.paths", "v.at", "v.event_id", F.lit(False).alias("ended"))


class Snapshots:
    """Versions of the results that hold. Each has the state as a whole, the rows that led to it from the version before, and the time up to which rows are in it."""

    def __init__(self, commits: Commits) -> None:
        self.commits = commits

    def advance(self, rows: DataFrame, upto) -> int:
        """A new version with the rows after the last version's time, up to ``upto``; state, log and time are committed together."""
        now, before = self.commits.version(), self.upto()
        new = rows.select(*COLUMNS).filter(F.col("at") <= F.lit(upto))
        new = materialize(new.filter(F.col("at") > F.lit(before)) if before is not None else new, "changes")
        state = live_results(self.commits.read("state", now).unionByName(new) if now else new)
        time = rows.sparkSession.range(1).select(F.lit(upto).alias("upto"))
        return self.commits.append(replace=("state", "upto"), state=state, log=new, upto=time)

    def upto(self, version: int | None = None):
        found = self.commits.read("upto", version)
        return None if found is None else found.first()[0]

    def state(self, version: int | None = None) -> DataFrame | None:
        return self.commits.read("state", version)

    def changes(self, since: int, version: int | None = None) -> DataFrame | None:
        """The rows between two versions, read from the logs of those alone; None if there are none."""
        return self.commits.read("log", version, since)

    def caught_up(self, state: DataFrame, since: int) -> DataFrame:
        """What a viewer who has ``state`` of version ``since`` sees now."""
        new = self.changes(since)
        return state if new is None else live_results(state.unionByName(new))


def complete(games: DataFrame, results: DataFrame) -> DataFrame:
    """game_id, status, steps and solver_results of each game: from page, length and paths, sorted by page; none: an empty array."""
    own = results.groupBy("game_id").agg(F.sort_array(F.collect_list(F.struct("page_title", "length", "paths"))).alias("solver_results"))
    none = F.expr("CAST(array() AS array<struct<page_title:string,length:bigint,paths:array<string>>>)")
    return games.select("game_id", "status", "steps").join(own, "game_id", "left").withColumn("solver_results", F.coalesce("solver_results", none))
